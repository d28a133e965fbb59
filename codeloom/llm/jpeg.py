"""Baseline JPEG, as Motion-JPEG frames use it: an entropy codec, and transforms over whole arrays of blocks."""

from __future__ import annotations

from functools import cache

import numpy as np

_N = np.arange(8)
DCT = np.sqrt(2 / 8) * np.cos((2 * _N[None, :] + 1) * _N[:, None] * np.pi / 16)
DCT[0] /= np.sqrt(2)
#: Natural position of the i-th coefficient in zigzag order.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8) if (i // 8 + i % 8) % 2 else (i % 8))))
LUMA = np.array([16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62, 18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99])

# Typical Huffman tables (counts by code length, then symbols), which Motion-JPEG frames without tables imply.
_DC = bytes(range(12))
_AC_L = bytes.fromhex(
    "0102030004110512213141061351610722711432819 1a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a434445464748494a535455565758595a636465666768696a737475767778797a838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa".replace(" ", "")
)
_AC_C = bytes.fromhex(
    "0001020311040521310612415107617113223281081442 91a1b1c109233352f0156272d10a162434e125f11718191a262728292a35363738393a434445464748494a535455565758595a636465666768696a737475767778797a82838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae2e3e4e5e6e7e8e9eaf2f3f4f5f6f7f8f9fa".replace(" ", "")
)
DEFAULT = {
    (0, 0): (bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]), _DC),
    (1, 0): (bytes([0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125]), _AC_L),
    (0, 1): (bytes([0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0]), _DC),
    (1, 1): (bytes([0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119]), _AC_C),
}


@cache
def codes(counts: bytes, symbols: bytes) -> dict[int, tuple[int, int]]:
    """symbol -> (code, length)."""
    out, code, i = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[symbols[i]] = code, length
            code, i = code + 1, i + 1
        code <<= 1
    return out


#: Bits a look-up of a code and its value takes at most at once; longer ones take the slow way.
PEEK = 16


@cache
def decoder(counts: bytes, symbols: bytes, dc: bool) -> tuple[list[int], list[int], list[int]]:
    """For every 16 bits that may come: how many bits a code and its value take together, by how many coefficients it goes on, and the value.

    Bits 0: no such code. If code and value take more than 16 bits, their
    number is negative and the value is how many bits the code alone takes.
    """
    if len(counts) != 16 or len(symbols) != sum(counts):
        raise ValueError("broken Huffman table")
    bits, steps, values = [0] * 65536, [0] * 65536, [0] * 65536
    for s, (code, length) in codes(counts, symbols).items():
        run, n = (0, s) if dc else (s >> 4, s & 15)
        if code >> length or n > 15:
            raise ValueError("broken Huffman table")
        lo, size = code << (16 - length), 1 << (16 - length)
        # An end of block goes past every coefficient, a run of sixteen zeros has no value.
        step = 1 if dc else 64 if s == 0 else run + 1
        steps[lo : lo + size] = [step] * size
        if length + n > 16:
            bits[lo : lo + size], values[lo : lo + size] = [-(length + n)] * size, [length] * size
            continue
        bits[lo : lo + size] = [length + n] * size
        if n:
            rest = 1 << (16 - length - n)
            for v in range(1 << n):
                values[lo + v * rest : lo + (v + 1) * rest] = [v if v >> (n - 1) else v - (1 << n) + 1] * rest
    return bits, steps, values


def encode_gray(image: np.ndarray, quality: np.ndarray = LUMA, tables: bool = True) -> bytes:
    """A grey image (height, width) of uint8 as a baseline frame; edges are repeated up to whole blocks."""
    h, w = image.shape
    padded = np.pad(image, ((0, -h % 8), (0, -w % 8)), mode="edge").astype(float) - 128
    blocks = padded.reshape(padded.shape[0] // 8, 8, -1, 8).swapaxes(1, 2).reshape(-1, 8, 8)
    levels = np.rint((DCT @ blocks @ DCT.T).reshape(-1, 64) / quality).astype(int)[:, ZIGZAG]
    dc_codes, ac_codes = codes(*DEFAULT[0, 0]), codes(*DEFAULT[1, 0])
    bits, n, last = 0, 0, 0

    def magnitude(v: int) -> tuple[int, int]:
        size = abs(v).bit_length()
        return size, v if v >= 0 else v + (1 << size) - 1

    for block in levels.tolist():
        size, extra = magnitude(block[0] - last)
        last = block[0]
        code, length = dc_codes[size]
        bits, n = (((bits << length) | code) << size) | extra, n + length + size
        run = 0
        top = max((i for i in range(1, 64) if block[i]), default=0)
        for v in block[1 : top + 1]:
            if not v:
                run += 1
                continue
            while run > 15:
                code, length = ac_codes[0xF0]
                bits, n, run = (bits << length) | code, n + length, run - 16
            size, extra = magnitude(v)
            code, length = ac_codes[run << 4 | size]
            bits, n, run = (((bits << length) | code) << size) | extra, n + length + size, 0
        if top < 63:
            code, length = ac_codes[0]
            bits, n = (bits << length) | code, n + length
    pad = -n % 8
    data = (((bits << pad) | ((1 << pad) - 1)).to_bytes((n + pad) // 8, "big")).replace(b"\xff", b"\xff\x00")
    part = lambda marker, body: bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body
    out = b"\xff\xd8" + part(0xDB, b"\0" + bytes(quality[ZIGZAG].tolist()))
    out += part(0xC0, bytes([8, *h.to_bytes(2, "big"), *w.to_bytes(2, "big"), 1, 1, 0x11, 0]))
    if tables:
        out += part(0xC4, b"\x00" + b"".join(DEFAULT[0, 0])) + part(0xC4, b"\x10" + b"".join(DEFAULT[1, 0]))
    return out + part(0xDA, bytes([1, 1, 0, 0, 63, 0])) + data + b"\xff\xd9"


def decode(frame: bytes) -> list[np.ndarray]:
    """The planes of a baseline frame (luma first), each at its own resolution.

    ValueError, and nothing else, if it isn't one, is cut off, or holds what no
    encoder writes. The work is bounded by the frame's bytes: a block takes two
    bits at least, so a size that the bytes can't fill is refused before any
    memory is taken for it.
    """
    try:
        return _decode(frame)
    except (IndexError, KeyError, ZeroDivisionError, OverflowError, TypeError) as e:
        raise ValueError("broken frame") from e


def _decode(frame: bytes) -> list[np.ndarray]:
    if frame[:2] != b"\xff\xd8":
        raise ValueError("no start of image")
    at, quant, huff, parts, interval, size = 2, {}, dict(DEFAULT), [], 0, (0, 0)
    while True:
        while at < len(frame) and frame[at] == 0xFF and at + 1 < len(frame) and frame[at + 1] == 0xFF:
            at += 1
        if at + 4 > len(frame) or frame[at] != 0xFF:
            raise ValueError("no scan")
        marker, n = frame[at + 1], int.from_bytes(frame[at + 2 : at + 4], "big")
        if n < 2:
            raise ValueError("broken segment")
        body, at = frame[at + 4 : at + 2 + n], at + 2 + n
        if marker == 0xDB:
            while body:
                wide, k = divmod(body[0], 16)
                step = 2 if wide else 1
                table = np.zeros(64)
                table[ZIGZAG] = np.frombuffer(body[1 : 1 + 64 * step], ">u2" if wide else "u1")
                quant[k], body = table, body[1 + 64 * step :]
        elif marker in (0xC0, 0xC1):
            if body[0] != 8:
                raise ValueError("not of 8 bits")
            size = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            parts = [[body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]] for i in range(body[5])]
        elif marker in (0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF):
            raise ValueError("not baseline")
        elif marker == 0xC4:
            while body:
                counts = body[1:17]
                huff[body[0] >> 4, body[0] & 15], body = (counts, body[17 : 17 + sum(counts)]), body[17 + sum(counts) :]
        elif marker == 0xDD:
            interval = int.from_bytes(body[:2], "big")
        elif marker == 0xDA:
            chosen = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
            break
    if not parts or not all(size) or any(p[0] not in chosen or p[3] not in quant for p in parts):
        raise ValueError("scan without frame or tables")
    if any(not 1 <= f <= 4 for p in parts for f in p[1:3]):
        raise ValueError("sampling factor out of range")
    wide, high = max(p[1] for p in parts), max(p[2] for p in parts)
    if len(parts) == 1:
        parts[0][1:3] = wide, high = 1, 1
    across, down = -(-size[1] // (8 * wide)), -(-size[0] // (8 * high))
    if across * down * sum(p[1] * p[2] for p in parts) * 2 > 8 * (len(frame) - at):
        raise ValueError("too large for its bytes")
    tables = [(decoder(*huff[0, chosen[p[0]] >> 4], True), decoder(*huff[1, chosen[p[0]] & 15], False)) for p in parts]
    end = frame.rfind(b"\xff\xd9")
    segments = [b""]
    rest, i = frame[at : end if end > at else len(frame)], 0
    while (j := rest.find(b"\xff", i)) >= 0:
        if j + 1 < len(rest) and 0xD0 <= rest[j + 1] <= 0xD7:
            segments[-1] += rest[i:j]
            segments.append(b"")
        else:
            segments[-1] += rest[i : j + 1]
        i = j + 2
    segments[-1] += rest[i:]
    # The blocks of an MCU in order: component, and its block's place in it.
    plan = [(k, v, h) for k, p in enumerate(parts) for v in range(p[2]) for h in range(p[1])]
    places: list[list[int]] = [[] for _ in parts]
    values: list[list[int]] = [[] for _ in parts]
    mcu = 0
    for segment in segments:
        # Windows of 24 bits at every byte, so that 16 bits at any place are one look-up.
        b = np.frombuffer(segment + b"\xff" * 8, np.uint8).astype(np.int64)
        window = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]).tolist()
        pos, last, limit = 0, [0] * len(parts), 8 * len(segment)
        for _ in range(interval or across * down):
            if mcu >= across * down:
                break
            y, x = divmod(mcu, across)
            for k, v, h in plan:
                p = parts[k]
                base = ((y * p[2] + v) * across * p[1] + x * p[1] + h) * 64
                where, what = places[k], values[k]
                i, (bits, steps, amounts) = 0, tables[k][0]
                while i < 64:
                    if pos >= limit:
                        raise ValueError("broken scan")
                    w = (window[pos >> 3] >> (8 - (pos & 7))) & 0xFFFF
                    n, amount = bits[w], amounts[w]
                    if n > 0:
                        pos += n
                    elif n < 0:
                        extra = -n - amount
                        pos += amount
                        amount = ((window[pos >> 3] >> (8 - (pos & 7))) & 0xFFFF) >> (16 - extra)
                        pos += extra
                        if not amount >> (extra - 1):
                            amount -= (1 << extra) - 1
                    else:
                        raise ValueError("broken scan")
                    if i:
                        i += steps[w]
                        if amount:
                            if i > 64:
                                raise ValueError("broken scan")
                            where.append(base + i - 1)
                            what.append(amount)
                    else:
                        last[k] += amount
                        where.append(base)
                        what.append(last[k])
                        i, (bits, steps, amounts) = 1, tables[k][1]
            mcu += 1
    if mcu < across * down:
        raise ValueError("scan cut off")
    planes = []
    for p, where, what in zip(parts, places, values, strict=True):
        level = np.zeros((down * p[2], across * p[1], 64))
        at_ = np.array(where)
        level.reshape(-1)[at_ - at_ % 64 + ZIGZAG[at_ % 64]] = what
        pixels = DCT.T @ (level * quant[p[3]]).reshape(*level.shape[:2], 8, 8) @ DCT
        full = np.clip(np.rint(pixels + 128), 0, 255).astype(np.uint8).swapaxes(1, 2).reshape(level.shape[0] * 8, -1)
        planes.append(full[: -(-size[0] * p[2] // high), : -(-size[1] * p[1] // wide)])
    return planes
