"""AVI Motion-JPEG: frames by the file's index, shots by adaptive histogram differences, a row for each clip.

The file's ``idx1`` index, or its OpenDML indexes (``indx`` and ``ix##``), place
the frames; without an index the ``movi`` list is walked. Every frame of
Motion-JPEG is intra-coded and is decoded whole. A shot begins where half the L1
distance of neighbouring grey histograms exceeds both a floor and what is usual
around it (mean and deviations of the differences near it), at the peak.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import jpeg
from codeloom.runtime import table

KERNEL = np.array([1, 2, 3, 4, 3, 2, 1]) / 16
BINS, FLOOR, DEVIATIONS, AROUND = 32, 0.3, 2.0, 4
OUT = "media_id long, clip int, start_frame int, end_frame int, start_s double, end_s double, cut_strength double, bad_frames int"


@dataclass
class Movie:
    seconds_a_frame: float
    frames: list[bytes]


def chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(id, begin, end) of each chunk's content; a chunk that runs over the end is cut there."""
    while at + 8 <= end:
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        yield name, at + 8, min(at + 8 + size, end)
        at += 8 + size + size % 2


def parse(data: bytes) -> Movie:
    """The first video stream. ValueError if data is no AVI file with one."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("no AVI file")
    rate, number, supers, movi, index, streams = 0.0, None, [], [], b"", 0
    for riff, start, stop in chunks(data, 0, len(data)):
        if riff != b"RIFF":
            continue
        for name, a, b in chunks(data, start + 4, stop):
            kind = data[a : a + 4] if name == b"LIST" else b""
            if kind == b"hdrl":
                for name2, a2, b2 in chunks(data, a + 4, b):
                    if name2 == b"avih" and b2 - a2 >= 4:
                        rate = rate or struct.unpack_from("<I", data, a2)[0] / 1e6
                    if name2 == b"LIST" and data[a2 : a2 + 4] == b"strl":
                        video = False
                        for name3, a3, b3 in chunks(data, a2 + 4, b2):
                            if name3 == b"strh" and data[a3 : a3 + 4] == b"vids" and number is None and b3 - a3 >= 28:
                                video, number = True, streams
                                scale, per = struct.unpack_from("<II", data, a3 + 20)
                                rate = scale / per if per else rate
                            if name3 == b"indx" and video:
                                n = min(struct.unpack_from("<I", data, a3 + 4)[0], max(0, (b3 - a3 - 24) // 16))
                                supers = [struct.unpack_from("<QII", data, a3 + 24 + 16 * i)[:2] for i in range(n)]
                        streams += 1
            elif kind == b"movi":
                movi.append((a, b))
            elif name == b"idx1":
                index = data[a:b]
    if number is None or not movi:
        raise ValueError("no video stream")
    names = {b"%02d%s" % (number, k) for k in (b"dc", b"db")}
    frames: list[bytes] = []
    # An index may name each byte of the file once; one that names more is broken.
    room = len(data)
    for offset, _ in dict.fromkeys(supers):
        if data[offset : offset + 2] != b"ix" or offset + 32 > len(data):
            continue
        n, base = struct.unpack_from("<I", data, offset + 12)[0], struct.unpack_from("<Q", data, offset + 20)[0]
        for i in range(n):
            if offset + 40 + 8 * i > len(data):
                break
            a, size = struct.unpack_from("<II", data, offset + 32 + 8 * i)
            size &= 0x7FFFFFFF
            room -= max(size, 1)
            if room < 0:
                raise ValueError("index names more than the file holds")
            frames.append(data[base + a : base + a + size])
    if not frames and index:
        entries = [struct.unpack_from("<4sIII", index, 16 * i) for i in range(len(index) // 16)]
        entries = [e for e in entries if e[0] in names]
        # Offsets count from the file's begin or from the list's type.
        base = 0 if entries and data[entries[0][2] : entries[0][2] + 4] in names else movi[0][0]
        if sum(e[3] for e in entries) > len(data):
            raise ValueError("index names more than the file holds")
        frames = [data[base + e[2] + 8 : base + e[2] + 8 + e[3]] for e in entries]
    if not frames:
        walk = [(a + 4, b) for a, b in movi]
        while walk:
            a, b = walk.pop(0)
            for name, x, y in chunks(data, a, b):
                if name in names:
                    frames.append(data[x:y])
                elif name == b"LIST" and data[x : x + 4] == b"rec ":
                    walk.insert(0, (x + 4, y))
    return Movie(rate or 1 / 25, frames)


def histograms(frames: list[bytes], bins: int = BINS) -> tuple[np.ndarray, int]:
    """Grey histograms, each of sum 1 and smoothed over neighbouring bins, so that light drifting over a bin's edge is no cut, and how many frames were bad: such a frame counts as the one before it."""
    out, bad = [], 0
    for f in frames:
        try:
            luma = jpeg.decode(f)[0]
            counts = np.bincount(luma.ravel().astype(int) * bins // 256, minlength=bins) / luma.size
            out.append(np.convolve(np.pad(counts, 3), KERNEL, "same"))
        except ValueError:
            bad += 1
            out.append(out[-1] if out else None)
    first = next((h for h in out if h is not None), None)
    return np.array([first if h is None else h for h in out]) if first is not None else np.zeros((0, bins + 6)), bad


def cuts(hist: np.ndarray, floor: float = FLOOR, deviations: float = DEVIATIONS, around: int = AROUND) -> list[tuple[int, float]]:
    """(frame, difference) of each frame that begins a new shot."""
    if len(hist) < 2:
        return []
    d = np.abs(np.diff(hist, axis=0)).sum(1) / 2
    out = []
    for i, x in enumerate(d):
        near = np.concatenate([d[max(0, i - around) : i], d[i + 1 : i + 1 + around]])
        usual = near[near < x] if len(near) else near
        limit = usual.mean() + deviations * usual.std() if len(usual) else 0.0
        peak = (i == 0 or d[i - 1] < x) and (i + 1 == len(d) or d[i + 1] <= x)
        if x > floor and x > limit and peak:
            out.append((i + 1, float(x)))
    return out


def clip_rows(media: bytes | None) -> list[tuple]:
    """(clip, start_frame, end_frame, start_s, end_s, cut_strength, bad_frames); [] for null, unreadable, or frameless media."""
    try:
        movie = parse(media or b"")
    except (ValueError, struct.error):
        return []
    hist, bad = histograms(movie.frames)
    if not len(hist):
        return []
    at = [(0, 0.0), *cuts(hist)]
    ends = [*[f for f, _ in at[1:]], len(hist)]
    s = movie.seconds_a_frame
    return [(i, a, b, a * s, b * s, d, bad) for i, ((a, d), b) in enumerate(zip(at, ends, strict=True))]


def clips(media: DataFrame) -> DataFrame:
    """A row for each clip of media (media_id, content). Null, damaged and frameless media give none, a damaged frame counts as the one before it; null ids stay null; repeated rows give their clips each; other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32()] * 3 + [pa.float64()] * 3 + [pa.int32()]
        for batch in batches:
            at, rows = [], []
            for i, content in enumerate(batch.column(1)):
                made = clip_rows(content.as_py())
                at += [i] * len(made)
                rows += made
            if rows:
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *columns], [x.split()[0] for x in OUT.split(", ")])

    return media.select(F.col("media_id").cast("long").alias("media_id"), F.col("content").cast("binary").alias("content")).mapInArrow(run, OUT)


def write_avi(frames: list[bytes], width: int, height: int, fps: int = 25, index: str = "idx1") -> bytes:
    """An AVI file of Motion-JPEG frames. index: idx1, opendml or none."""
    chunk = lambda name, body: name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)
    movi, places = b"movi", []
    for f in frames:
        places.append((len(movi), len(f)))
        movi += chunk(b"00dc", f)
    avih = struct.pack("<14I", 1_000_000 // fps, 0, 0, 0x10, len(frames), 0, 1, 0, width, height, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, fps, 0, len(frames), 0, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)

    def header(indx: bytes) -> bytes:
        strl = b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf) + (chunk(b"indx", indx) if indx else b"")
        return chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + chunk(b"LIST", strl))

    if index == "opendml":
        blank = header(b"\0" * 40)
        movi_at = 12 + len(blank) + 8
        standard = struct.pack("<HBBI4sQI", 2, 0, 1, len(frames), b"00dc", movi_at, 0) + b"".join(struct.pack("<II", a + 8, n) for a, n in places)
        ix_at = movi_at + len(movi)
        movi += chunk(b"ix00", standard)
        head = header(struct.pack("<HBBI4s12xQII", 4, 0, 0, 1, b"00dc", ix_at, len(standard) + 8, len(frames)))
        body = b"AVI " + head + chunk(b"LIST", movi)
    else:
        body = b"AVI " + header(b"") + chunk(b"LIST", movi)
        if index == "idx1":
            body += chunk(b"idx1", b"".join(struct.pack("<4sIII", b"00dc", 0x10, a, n) for a, n in places))
    return chunk(b"RIFF", body)


def shot_plan(vector: np.ndarray) -> list[tuple[int, int]]:
    """(frames, level) of each shot of the test movie that a vector stands for; neighbouring levels are far apart."""
    v = np.abs(np.nan_to_num(np.asarray(vector, float)))
    digits = (v * 1000).astype(int) if len(v) else np.zeros(1, int)
    out, level = [], int(digits[0] % 160) + 24
    for i in range(1 + int(digits.sum() % 4)):
        out.append((3 + int(digits[i % len(digits)] % 4), level))
        level = (level + 90 + int(digits[(i + 1) % len(digits)] % 20) - 24) % 192 + 24
    return out


def movie_of(vector: np.ndarray | None) -> bytes | None:
    """A small grey movie with texture from the vector's numbers and shots by shot_plan; None for null."""
    if vector is None:
        return None
    v = np.nan_to_num(np.asarray(vector, float))
    texture = np.resize(v if len(v) else np.zeros(1), (16, 16))
    texture = texture / max(1e-9, np.abs(texture).max()) * 6
    frames = []
    for n, level in shot_plan(vector):
        for k in range(n):
            frames.append(jpeg.encode_gray(np.clip(level + k * 0.5 + np.roll(texture, k, 1), 0, 255).astype(np.uint8)))
    return write_avi(frames, 16, 16)


def media_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(media_id, content): the given tables hold no media, so each row of embeddings stands for a movie made of its numbers."""

    @F.pandas_udf("binary")
    def make(vectors):  # noqa: ANN001, ANN202
        return vectors.map(movie_of)

    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("media_id"), make("embedding").alias("content"))


def op6_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every clip of every movie of ``media_table``; edge cases are those of ``clips``."""
    return clips(media_table(spark, sf_dir))
