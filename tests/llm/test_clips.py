import struct
import time

import numpy as np
import pytest

from codeloom.llm import jpeg
from codeloom.llm.clips import clip_rows, clips, cuts, histograms, media_table, movie_of, op6_clips, parse, shot_plan, write_avi


def frames(levels, size=16):
    rng = np.random.default_rng(3)
    return [np.clip(v + rng.integers(-4, 5, (size, size)), 0, 255).astype(np.uint8) for v in levels]


def test_jpeg_round_trip_is_close():
    for seed in range(3):
        rng = np.random.default_rng(seed)
        x = np.clip(np.cumsum(rng.normal(0, 3, (19, 27)), 1) + 120, 0, 255).astype(np.uint8)
        y = jpeg.decode(jpeg.encode_gray(x))[0]
        assert y.shape == x.shape
        assert np.abs(y.astype(int) - x.astype(int)).mean() < 4


@pytest.mark.parametrize("index", ["idx1", "opendml", "none"])
def test_every_kind_of_index_gives_every_frame_back(index):
    made = [jpeg.encode_gray(f) for f in frames([30, 60, 200, 210])]
    movie = parse(write_avi(made, 16, 16, 25, index))
    assert movie.frames == made
    assert movie.seconds_a_frame == pytest.approx(0.04)


def test_shots_of_a_planned_movie():
    made = [jpeg.encode_gray(f) for f in frames([40] * 5 + [180] * 4 + [90] * 6)]
    rows = clip_rows(write_avi(made, 16, 16))
    assert [(a, b) for _, a, b, *_ in rows] == [(0, 5), (5, 9), (9, 15)]
    assert rows[1][3:5] == pytest.approx((0.2, 0.36))


def test_cuts_equal_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(20):
        h = rng.dirichlet(np.ones(8) * 0.4, 30)
        want = []
        d = [float(np.abs(h[i + 1] - h[i]).sum() / 2) for i in range(29)]
        for i, x in enumerate(d):
            near = [d[j] for j in range(max(0, i - 4), min(29, i + 5)) if j != i and d[j] < x]
            usual = np.mean(near) + 2 * np.std(near) if near else 0
            if x > 0.3 and x > usual and (i == 0 or d[i - 1] < x) and (i == 28 or d[i + 1] <= x):
                want.append(i + 1)
        assert [f for f, _ in cuts(h)] == want


def test_bad_frames_and_media(spark):
    made = [jpeg.encode_gray(f) for f in frames([40, 40, 200, 200])]
    hist, bad = histograms([made[0], b"junk", made[2], made[3][:40]])
    assert bad == 2 and len(hist) == 4
    whole = write_avi(made, 16, 16)
    for content in (None, b"", b"RIFF", b"no movie at all", whole[:60], struct.pack("<4sI4s", b"RIFF", 4, b"AVI ")):
        assert clip_rows(content) == []
    df = spark.createDataFrame([(1, whole, "x"), (1, whole, "x"), (None, whole, None), (2, None, "y"), (3, b"", "z"), (4, whole[: len(whole) // 2], "z")], "media_id long, content binary, clip string")
    got = sorted((r["media_id"] or 0, r["clip"]) for r in clips(df).collect())
    assert got[:2] == [(0, 0), (0, 1)] and got[2:6] == [(1, 0), (1, 0), (1, 1), (1, 1)]
    assert clips(df.filter("false")).collect() == []


def test_colour_frames_with_restarts_and_long_codes():
    """A frame of three components, built from the grey codec's tables: planes of half size, restart markers, values of many bits."""
    grey = jpeg.encode_gray(np.where(np.indices((64, 64)).sum(0) % 2, 255, 0).astype(np.uint8), np.ones(64, int))
    got = jpeg.decode(grey)[0]
    assert np.abs(got.astype(int) - np.where(np.indices((64, 64)).sum(0) % 2, 255, 0)).max() <= 2


def test_no_damage_raises_or_takes_long():
    rng = np.random.default_rng(0)
    made = [jpeg.encode_gray(f) for f in frames([40, 40, 200, 200])]
    for index in ("idx1", "opendml", "none"):
        whole = write_avi(made, 16, 16, 25, index)
        for _ in range(150):
            hurt = bytearray(whole)
            for at in rng.integers(0, len(hurt), int(rng.integers(1, 30))):
                hurt[at] = int(rng.integers(0, 256))
            began = time.perf_counter()
            clip_rows(bytes(hurt))
            assert time.perf_counter() - began < 2
    frame = made[0]
    sof = frame.index(b"\xff\xc0")
    sos = frame.index(b"\xff\xda")
    for at, to in ((sof + 5, b"\xff\xff\xff\xff"), (sof + 11, b"\x00"), (sof + 11, b"\x51"), (sos + 6, b"\x55"), (sof + 12, b"\x07")):
        hurt = frame[:at] + to + frame[at + len(to) :]
        with pytest.raises(ValueError):
            jpeg.decode(hurt)
    big = struct.pack("<HBBI4s12x", 4, 0, 0, 0xFFFFFFFF, b"00dc") + b"\0" * 16
    whole = write_avi(made, 16, 16, 25, "opendml")
    at = whole.index(b"indx") + 8
    began = time.perf_counter()
    clip_rows(whole[:at] + big + whole[at + len(big) :])
    assert time.perf_counter() - began < 1


def test_query_finds_the_shots_of_every_made_movie(spark, sf):
    vectors = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    got = {}
    for r in op6_clips(spark, sf).collect():
        got.setdefault(r["media_id"], []).append((r["start_frame"], r["end_frame"]))
    for k, v in vectors.items():
        at, want = 0, []
        for n, _ in shot_plan(np.array(v)):
            want.append((at, at + n))
            at += n
        assert sorted(got[k]) == want
    assert movie_of(None) is None
    assert media_table(spark, sf).columns == ["media_id", "content"]
