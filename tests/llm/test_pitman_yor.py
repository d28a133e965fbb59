import random
from math import exp, log

import numpy as np
import pyarrow as pa
import pytest

from codeloom.llm.pitman_yor import BURN_IN, EXACT, ORDER, SAMPLES, TABLE, Lookup, Seats, count_grams, expand, fit, mask, op1_pitman_yor, packed, part_of, score, squeeze, stirling
from codeloom.llm.words import U, buffers


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(0)
    words = ["alpha", "beta", "gamma", "delta", "epsilon"]
    return spark.createDataFrame([(i, " ".join(rng.choice(words, 60))) for i in range(60)], "doc_id long, text string")


def grams(text, order=ORDER):
    return packed(*buffers(pa.array([text])), order)


def tables(model):
    """level -> sequence -> (probability, weight of falling back)."""
    out = {}
    for r in model.collect():
        keys, p, b = expand(r["keys"], r["n"], U, True), expand(r["prob"], r["n"], np.float64), expand(r["back"], r["n"], np.float64)
        out.setdefault(r["level"], {}).update({int(k): (float(x), float(y)) for k, x, y in zip(keys, p, b, strict=True)})
    return out


def probability(held, low, x, k):
    """One sequence, by plain look-ups."""
    x &= int(mask(k))
    if k == 1:
        return float(low[x >> 8 & 255, x & 255])
    if x in held.get(k, {}):
        return held[k][x][0]
    back = {key >> 8: b for key, (_, b) in held.get(k, {}).items()} if not hasattr(probability, "memo") else None
    if back is None:
        back = probability.memo.setdefault((id(held), k), {key >> 8: b for key, (_, b) in held.get(k, {}).items()})
    return back.get(x >> 8, 1.0) * probability(held, low, x, k - 1)


probability.memo = {}


def test_arrays_survive_compression():
    rng = np.random.default_rng(0)
    for kind in (np.uint64, np.int64, np.float32, np.float64):
        a = (rng.random(1000) * 2**50).astype(kind)
        assert (expand(squeeze(a), len(a), kind) == a).all()
    a = np.sort(rng.integers(0, 1 << 63, 1000, dtype=np.uint64))
    assert (expand(squeeze(a, True), len(a), np.uint64, True) == a).all()
    assert len(expand(squeeze(a[:0], True), 0, np.uint64, True)) == 0


def test_counts_equal_brute_force(spark, corpus):
    want = {}
    for r in corpus.collect():
        for k in grams(r["text"]).tolist():
            want[k] = want.get(k, 0) + 1
    got = {}
    for r in count_grams(corpus, 5).collect():
        keys = expand(r["keys"], r["n"], U, True)
        assert (part_of(keys, 5) == r["p"]).all()
        got |= dict(zip(keys.tolist(), expand(r["c"], r["n"], np.int64).tolist(), strict=True))
    assert got == want


def test_stirling_by_recursion():
    s, d = stirling(0.4, 12), 0.4
    exact = {(0, 0): 1.0}
    for c in range(12):
        for t in range(c + 2):
            exact[c + 1, t] = exact.get((c, t - 1), 0) + (c - d * t) * exact.get((c, t), 0)
    for (c, t), v in exact.items():
        assert v == pytest.approx(exp(s[c, t]) if np.isfinite(s[c, t]) else 0)


@pytest.mark.parametrize("d", [0.1, 0.3, 0.5, 0.62, 0.8, 0.9])
def test_logarithms_beyond_the_table_equal_the_recursion(d):
    exact, seats = stirling(d, 900), Seats(d, 1.0)
    for c in (TABLE + 1, 500, 900):
        t = np.arange(1, c + 1)
        assert seats.log_s(np.full(c, c), t) == pytest.approx(exact[c, 1 : c + 1], abs=0.15 if d == 0.9 else 0.07)


@pytest.mark.parametrize(("c", "base"), [(2, 0.3), (6, 0.3), (EXACT, 0.02), (EXACT + 1, 0.3), (31, 0.02), (100, 0.3), (150, 0.02), (400, 0.05), (700, 0.5)])
def test_production_sweeps_give_the_posterior_of_tables(c, base):
    """One dish, one restaurant: started as fit does, after its burn-in, over its samples, p(t) is new-table weights times S(c, t)."""
    d, theta, n = 0.5, 1.0, 3000
    seats, rng = Seats(d, theta), np.random.default_rng(2)
    t, counts = np.full(n, round(c**d)), np.zeros(c + 1)
    for sweep in range(BURN_IN + SAMPLES):
        t = seats.sit(np.full(n, c), t, np.arange(n), np.full(n, base), rng)
        counts += np.bincount(t, minlength=c + 1) * (sweep >= BURN_IN)
    s = stirling(d, c)
    logs = np.array([sum(log(theta + d * j) for j in range(1, k)) + k * log(base) + s[c, k] for k in range(1, c + 1)])
    want = np.exp(logs - logs.max())
    want /= want.sum()
    k = np.arange(1, c + 1)
    got = counts[1:] / counts.sum()
    assert got @ k == pytest.approx(want @ k, rel=0.03)
    assert np.sqrt(got @ k**2 - (got @ k) ** 2) == pytest.approx(np.sqrt(want @ k**2 - (want @ k) ** 2), rel=0.1, abs=0.02)


class Restaurant:
    """A Chinese restaurant with every table's size, seated one customer at a time."""

    def __init__(self, parent, d, theta):
        self.parent, self.d, self.theta, self.at, self.c, self.t = parent, d, theta, {}, 0, 0

    def p(self, x):
        sizes = self.at.get(x, [])
        up = self.parent.p(x) if self.parent else 1 / 256
        return (sum(sizes) - self.d * len(sizes) + (self.theta + self.d * self.t) * up) / (self.theta + self.c)

    def add(self, x, rng):
        sizes = self.at.setdefault(x, [])
        up = self.parent.p(x) if self.parent else 1 / 256
        i = rng.choices(range(len(sizes) + 1), [s - self.d for s in sizes] + [(self.theta + self.d * self.t) * up])[0]
        self.c += 1
        if i < len(sizes):
            sizes[i] += 1
            return
        sizes.append(1)
        self.t += 1
        if self.parent:
            self.parent.add(x, rng)

    def leave(self, x, rng):
        sizes = self.at[x]
        i = rng.choices(range(len(sizes)), sizes)[0]
        sizes[i] -= 1
        self.c -= 1
        if not sizes[i]:
            sizes.pop(i)
            self.t -= 1
            if self.parent:
                self.parent.leave(x, rng)


def test_log_probabilities_equal_a_sampler_that_seats_every_customer(spark):
    """The whole hierarchy against explicit tables: three levels, one customer out and in again at a time."""
    rng = random.Random(1)
    texts = ["".join(rng.choices("abcd ", [5, 3, 2, 1, 2], k=90)) for _ in range(6)] + ["abcabcabcabcabc"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    order = 3
    model, low = fit(docs, order=order, burn_in=8, samples=16, parts=2)
    got = {r["doc_id"]: r["log_prob"] for r in score(docs, model, low, order=order, parts=2).collect()}
    seen = {}
    moves = [g for t in texts for g in grams(t, order).tolist()]
    counts = {}
    for g in moves:
        counts[g] = counts.get(g, 0) + 1
    n1, n2 = (sum(c == k for c in counts.values()) for k in (1, 2))
    d = min(max(n1 / (n1 + 2 * n2), 0.1), 0.9)
    root = Restaurant(None, d, 1.0)
    for g in moves:
        one = seen.setdefault((g >> 8) & 255, Restaurant(root, d, 1.0))
        seen.setdefault((g >> 8, 2), Restaurant(one, d, 1.0)).add(g & 255, rng)
    sums = {}
    burn, n = 60, 150
    for sweep in range(burn + n):
        for g in moves:
            r = seen[g >> 8, 2]
            r.leave(g & 255, rng)
            r.add(g & 255, rng)
        if sweep >= burn:
            for g in counts:
                sums[g] = sums.get(g, 0) + seen[g >> 8, 2].p(g & 255) / n
    for i, t in enumerate(texts):
        want = sum(log(sums[g]) for g in grams(t, order).tolist())
        assert got[i] == pytest.approx(want, rel=0.02)


def test_scores_equal_plain_look_ups(spark, corpus, weird):
    """Every document, those the model has not seen too, byte by byte from the model's rows."""
    model, low = fit(corpus, parts=3)
    held = tables(model)
    for docs in (corpus, weird.filter("doc_id <> 6 OR doc_id IS NULL")):
        got = sorted(((r["doc_id"], r["n_bytes"], r["log_prob"]) for r in score(docs, model, low, parts=3).collect()), key=str)
        want = []
        for r in docs.select("doc_id", "text").collect():
            x = grams(r["text"] or "").tolist()
            want.append((r["doc_id"], len(x), sum(log(probability(held, low, k, ORDER - 1)) for k in x) if x else None))
        want.sort(key=str)
        assert [r[:2] for r in got] == [r[:2] for r in want]
        for a, b in zip(got, want, strict=True):
            assert a[2] == pytest.approx(b[2], rel=1e-5) if b[2] is not None else a[2] is None


def test_probabilities_sum_to_one_and_beat_a_flat_model(spark, corpus):
    model, low = fit(corpus, parts=4)
    rows = [r.asDict() for r in model.collect()]
    for text in ("alpha ", "gamma", "zzzzz", "a\x00b"):
        head = int(grams(text)[-1])
        x = np.array(sorted(((head << 8) & ((1 << 56) - 1)) | b for b in range(256)), np.uint64)
        p = part_of(x, 4)[0]
        assert Lookup([r for r in rows if r["p"] == p], low).probability(x).sum() == pytest.approx(1, abs=1e-4)
    test = spark.createDataFrame([(1, "alpha beta gamma delta epsilon alpha"), (2, "qzx vwk jjj qqq")], "doc_id long, text string")
    got = {r["doc_id"]: r["perplexity"] for r in score(test, model, low, parts=4).collect()}
    assert got[1] < 3 < 50 < got[2]


def test_edge_cases(spark, weird, nothing):
    rows = score(weird, *fit(weird)).collect()
    assert len(rows) == weird.count()
    for r in rows:
        assert (r["log_prob"] is None) == (r["n_bytes"] == 0)
    model, low = fit(nothing)
    assert model.count() == 0
    assert score(nothing, model, low).collect() == []
    r = score(weird.filter("doc_id = 9"), model, low).first()
    assert r["perplexity"] == pytest.approx(256, rel=1e-3)


def test_query_scores_every_document(spark, sf):
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    rows = op1_pitman_yor(spark, sf).collect()
    assert len(rows) == n
    assert all(1 < r["perplexity"] < 256 for r in rows if r["n_bytes"])
