"""Hierarchical Pitman-Yor language model over bytes, contexts of up to six bytes.

A context of k bytes is a restaurant whose parent is the context without its
oldest byte; contexts with the same ending share that parent, up to the empty
context over the uniform distribution. The state of a restaurant is for each
byte its customers c and tables t; customers of a parent are the tables of its
children. Seatings are sampled by Gibbs with the sizes of tables integrated
out: the tables of one dish, all others standing, have the distribution

    p(t) ~ S(c, t) (d H)^t Gamma(theta / d + T + t)

where S are generalised Stirling numbers, H is the parent's probability of the
dish and T the other tables of the restaurant. Up to ``EXACT`` customers t is
drawn from it, above by ``STEPS`` Metropolis steps, whose chain has the same
distribution. S comes from its recursion up to ``TABLE`` customers, beyond from
its alternating series where that converges and by saddle point elsewhere, both
within 0.07 of the logarithm (0.15 at a discount of 0.9). A sweep goes from the longest contexts to the
shortest: as tables open and close below, a parent's customers come and go, and
its own tables are drawn anew for those it then has. What is not sequential:
dishes of a restaurant are drawn in two halves, each given the other, and H is
that of the sweep's begin. Predictive probabilities are averaged over the
sweeps after burn-in; perplexity uses these averages.

Distribution: contexts are dealt to parts by their last two bytes, so every
restaurant of two bytes or more shares its part with its parents down to that
length, and a sweep is one narrow stage. The 256 x 256 table counts of one-byte
contexts, bounded whatever the corpus, come to the driver, where the two lowest
levels are sampled. To score, documents are dealt to groups; each group asks
the parts for the probabilities of its distinct sequences, and they come back
to it. Neither model nor texts are ever in one place, and parts and groups grow
in number with the bytes of the corpus. Sequences and numbers travel as
compressed arrays.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import lgamma, log, pi, sin

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.words import U, buffers, mix, pieces
from codeloom.runtime import keep, release, table

ORDER, THETA, BURN_IN, SAMPLES, SEED = 7, 1.0, 6, 3, 5
EXACT, TABLE, STEPS = 24, 256, 12
BYTES_A_PART, LEAST_PARTS, MOST_PARTS = 1 << 24, 12, 1 << 16


def packed(data: np.ndarray, offsets: np.ndarray, order: int) -> np.ndarray:
    """For each byte of the rows, it and the order - 1 bytes before it in its row (0 before the row's begin), the nearest lowest."""
    base = int(offsets[0])
    d = data[base : int(offsets[-1])].astype(U)
    starts = offsets[:-1] - base
    out = d.copy()
    for j in range(1, order):
        older = np.zeros_like(d)
        older[j:] = d[:-j] if len(d) > j else d[:0]
        for r in range(j):
            at = starts + r
            older[at[at < len(d)]] = 0
        out |= older << U(8 * j)
    return out


def mask(level: int) -> np.uint64:
    return U((1 << (8 * (level + 1))) - 1)


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part of each sequence, by the two bytes before its last."""
    return (mix((keys >> U(8)) & U(0xFFFF)) % U(parts)).astype(np.int64)


def parts_for(n_bytes: int) -> int:
    return int(min(max(n_bytes // BYTES_A_PART, LEAST_PARTS), MOST_PARTS))


# -- arrays as compressed bytes --
def squeeze(a: np.ndarray, rising: bool = False) -> bytes:
    """Bytes of an array, plane by plane; rising: as differences."""
    a = np.diff(a, prepend=a.dtype.type(0)) if rising else a
    planes = np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T)
    return pa.compress(planes.tobytes(), "zstd", asbytes=True)


def expand(data: bytes, n: int, kind: type, rising: bool = False) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = np.frombuffer(pa.decompress(data, n * size, "zstd", asbytes=True), np.uint8).reshape(size, n).T
    a = np.ascontiguousarray(raw).view(kind).reshape(n)
    return np.cumsum(a, dtype=kind) if rising else a


# -- counting --
def merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held])
    by = np.argsort(keys)
    keys, counts = keys[by], counts[by]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = np.sort(x)
    first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])[: len(x)])
    return x[first], np.diff(np.append(first, len(x)))


def count_grams(docs: DataFrame, parts: int, order: int = ORDER) -> DataFrame:
    """(p, n, keys, c): how often each byte sequence of that order occurs in all texts, one row a part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            data, offsets = buffers(batch.column(0))
            for lo, hi in pieces(offsets, 1 << 22):
                x = packed(data, offsets[lo : hi + 1], order)
                if len(x):
                    held.append(distinct(x))
                if sum(len(k) for k, _ in held) > 6_000_000:
                    yield from dealt(*merged(held), parts)
                    held.clear()
        if held:
            yield from dealt(*merged(held), parts)

    def one(t: pa.Table) -> pa.Table:
        held = [(expand(k, n, U, True), expand(c, n, np.int64)) for n, k, c in zip(*(t.column(i).to_pylist() for i in (1, 2, 3)), strict=True)]
        keys, counts = merged(held)
        return pa.table([t.column(0)[:1], pa.array([len(keys)], pa.int32()), pa.array([squeeze(keys, True)], pa.binary()), pa.array([squeeze(counts)], pa.binary())], ["p", "n", "keys", "c"])

    schema = "p int, n int, keys binary, c binary"
    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
    return rows.repartition(parts, "p").groupBy("p").applyInArrow(one, schema)


def dealt(keys: np.ndarray, counts: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """Sorted sequences and their counts as a row for each part."""
    p = part_of(keys, parts).astype(np.uint16)
    by = np.argsort(p, kind="stable")
    p, keys, counts = p[by], keys[by], counts[by]
    first = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]])[: len(p)])
    for a, b in zip(first.tolist(), np.append(first, len(p))[1:].tolist(), strict=True):
        yield pa.RecordBatch.from_arrays([pa.array([p[a]], pa.int32()), pa.array([b - a], pa.int32()), pa.array([squeeze(keys[a:b], True)], pa.binary()), pa.array([squeeze(counts[a:b])], pa.binary())], ["p", "n", "keys", "c"])


# -- seating --
def log_gamma(x: np.ndarray) -> np.ndarray:
    """log Gamma of positive numbers."""
    y = np.asarray(x, float)
    low = np.flatnonzero(y < 8)
    if len(low):
        y = y.copy()
        z = y[low]
        shift = np.log(z * (z + 1) * (z + 2) * (z + 3) * (z + 4) * (z + 5) * (z + 6) * (z + 7))
        y[low] += 8
    z = 1 / (y * y)
    out = (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / y
    if len(low):
        out[low] -= shift
    return out


def stirling(d: float, size: int = TABLE) -> np.ndarray:
    """Logarithms of S(c, t; d): ways to seat c customers at t tables, as weighted by the process."""
    out = np.full((size + 1, size + 2), -np.inf)
    out[0, 0] = 0
    t = np.arange(size + 2)
    for c in range(size):
        stay = np.where(c - d * t > 0, np.log(np.maximum(c - d * t, 1e-300)), -np.inf) + out[c]
        out[c + 1, 1:] = np.logaddexp(out[c, :-1], stay[1:])
    return out


class Seats:
    """Gibbs draws of the tables of dishes, for given discount and concentration."""

    def __init__(self, d: float, theta: float) -> None:
        self.d, self.theta = d, theta
        self.table = stirling(d)
        u = np.concatenate([np.logspace(-30, -3, 2000), np.linspace(0.001, 0.999, 4000)])
        z = np.concatenate([1 - u, np.logspace(-3, -8, 500)])
        u = np.concatenate([u, 1 - z[len(u) :]])
        f, f1, f2 = -np.expm1(d * np.where(z < 0.5, np.log1p(-np.minimum(z, 0.5)), np.log(u))), d * u ** (d - 1), d * (1 - d) * u ** (d - 2)
        share, a = f / (z * f1), z * f1 / f
        by = np.argsort(share)
        self.share = np.log(share[by])
        self.exponent = (np.log(f) - np.where(z < 0.5, np.log(z), np.log1p(-u)) / share)[by]
        self.spread = np.log(np.maximum(a + z * z * f2 / f - a * a, 1e-300))[by]
        #: Terms of the series: discount times their number, sign, and what does not depend on c and t.
        self.terms = []
        for j in range(1, 25):
            x = d * j
            if abs(x - round(x)) > 1e-9:
                # 1 / Gamma(-x) by reflection
                sign = -1.0 if sin(pi * x) > 0 else 1.0
                self.terms.append((j, x, sign * (-1) ** j, lgamma(1 + x) + log(abs(sin(pi * x)) / pi)))

    def prepared(self, c: np.ndarray) -> tuple:
        """What log S(c, .) needs of dishes of more than TABLE customers: their places and numbers, log c!, and the series' terms but for t."""
        big = np.flatnonzero(c > TABLE)
        C = c[big].astype(float)
        whole = log_gamma(C + 1)
        return big, C, whole, [sign * np.exp(log_gamma(C - x) - whole + fixed) for _, x, sign, fixed in self.terms] if len(big) else []

    def log_s(self, c: np.ndarray, t: np.ndarray, ready: tuple | None = None) -> np.ndarray:
        """log S(c, t), 1 <= t <= c."""
        big, C, whole, series = ready or self.prepared(c)
        out = self.table[np.minimum(c, TABLE), np.minimum(t, TABLE)]
        if not len(big):
            return out
        T = t[big].astype(float)
        x = np.log(T / C)
        # As in Stirling's own formula a twelfth is over for each customer that opened no table.
        coefficient = T * np.interp(x, self.share, self.exponent) - 0.5 * (np.log(2 * pi * T) + np.interp(x, self.share, self.spread)) - 1 / (12 * np.maximum(C - T, 1))
        few = np.flatnonzero(T * C**-self.d <= 4)
        if len(few):
            t_few, choose, j = T[few], np.ones(len(few)), 0
            total, size, last = np.zeros(len(few)), np.zeros(len(few)), np.zeros(len(few))
            for (to, *_), w in zip(self.terms, series, strict=True):
                while j < to:
                    choose, j = choose * np.maximum(t_few - j, 0) / (j + 1), j + 1
                term = w[few] * choose
                last = np.abs(term)
                total += term
                size += last
            sure = (total > 1e-7 * size) & (last < 1e-3 * total)
            coefficient[few[sure]] = np.log(total[sure])
        out[big] = np.where(C == T, 0.0, whole - log_gamma(T + 1) - T * log(self.d) + coefficient)
        return out

    def draw(self, c: np.ndarray, t: np.ndarray, others: np.ndarray, base: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """Tables of dishes of c customers, t tables before, given the other tables of their restaurants and the parents' probabilities."""
        out = np.ones(len(c), np.int64)
        a, lean = self.theta / self.d + others, np.log(self.d * np.maximum(base, 1e-300))
        small = np.flatnonzero((c > 1) & (c <= EXACT))
        by = small[np.argsort(c[small], kind="stable")]
        sizes, first = np.unique(c[by], return_index=True)
        for n, lo, hi in zip(sizes.tolist(), first.tolist(), np.append(first, len(by))[1:].tolist(), strict=True):
            i = by[lo:hi]
            k = np.arange(1, n + 1)
            logs = self.table[n, 1 : n + 1] + lean[i, None] * k + np.cumsum(np.log(a[i, None] + (k - 1)), 1)
            p = np.cumsum(np.exp(logs - logs.max(1, keepdims=True)), 1)
            out[i] = 1 + (p < rng.random(len(i))[:, None] * p[:, -1:]).sum(1)
        i = np.flatnonzero(c > EXACT)
        if len(i):
            C, now, a, lean = c[i], np.clip(t[i], 1, c[i]), a[i], lean[i]
            ready = self.prepared(C)
            level = self.log_s(C, now, ready) + now * lean + log_gamma(a + now)
            for s in range(STEPS):
                step = rng.geometric(1 / (1 + np.sqrt(C**self.d) / (1 + s % 3))) * rng.choice([-1, 1], len(i))
                to = now + step
                fits = (to >= 1) & (to <= C)
                to = np.where(fits, to, now)
                new = self.log_s(C, to, ready) + to * lean + log_gamma(a + to)
                go = fits & (np.log(rng.random(len(i))) < new - level)
                now, level = np.where(go, to, now), np.where(go, new, level)
            out[i] = now
        return out

    def sit(self, c: np.ndarray, t: np.ndarray, first: np.ndarray, base: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """All dishes of some restaurants drawn once, in two random halves. first: where each restaurant's dishes begin."""
        t = np.clip(t, 1, c)
        size = np.diff(np.append(first, len(c)))
        half = rng.random(len(c)) < 0.5
        # A dish of one customer has one table.
        for some in (np.flatnonzero(half & (c > 1)), np.flatnonzero(~half & (c > 1))):
            if not len(some):
                continue
            others = np.repeat(np.add.reduceat(t, first), size)[some] - t[some]
            t[some] = self.draw(c[some], t[some], others, base[some], rng)
        return t

    def predict(self, c: np.ndarray, t: np.ndarray, first: np.ndarray, base: np.ndarray) -> np.ndarray:
        """Probability of each dish in its restaurant."""
        size = np.diff(np.append(first, len(c)))
        whole = np.repeat(self.theta + np.add.reduceat(c, first), size)
        return np.maximum(c - self.d * t, 0) / whole + np.repeat(self.theta + self.d * np.add.reduceat(t, first), size) / whole * base


def first_of(keys: np.ndarray) -> np.ndarray:
    ctx = keys >> U(8)
    return np.flatnonzero(np.concatenate([[True], ctx[1:] != ctx[:-1]]))


class Part:
    """The restaurants of two bytes or more that end alike: for each level its sequences (sorted), customers, tables, and sums of probabilities."""

    def __init__(self, keys: np.ndarray, c: np.ndarray, order: int) -> None:
        self.top = order - 1
        self.keys = {self.top: keys}
        for k in range(self.top - 1, 1, -1):
            self.keys[k] = np.unique(self.keys[k + 1] & mask(k))
        self.first = {k: first_of(v) for k, v in self.keys.items()}
        self.up = {k: np.searchsorted(self.keys[k - 1], self.keys[k] & mask(k - 1)) for k in range(3, self.top + 1)}
        self.c, self.t = {self.top: c}, {}
        self.sums = {k: np.zeros(len(v)) for k, v in self.keys.items()}

    def below(self, k: int) -> np.ndarray:
        """Customers of level k - 1: the tables of level k."""
        return np.bincount(self.up[k], self.t[k], len(self.keys[k - 1])).astype(np.int64)

    def begin(self, d: float) -> None:
        for k in range(self.top, 1, -1):
            self.t[k] = np.clip(np.round(self.c[k] ** d), 1, self.c[k]).astype(np.int64)
            if k > 2:
                self.c[k - 1] = self.below(k)

    def resume(self, t: dict[int, np.ndarray], sums: dict[int, np.ndarray]) -> None:
        self.sums = sums
        for k in range(self.top, 1, -1):
            self.t[k] = t[k]
            if k > 2:
                self.c[k - 1] = self.below(k)

    def bases(self, low: np.ndarray, seats: Seats) -> dict[int, np.ndarray]:
        keys = self.keys[2]
        out = {2: low[((keys >> U(8)) & U(255)).astype(int), (keys & U(255)).astype(int)]}
        for k in range(3, self.top + 1):
            out[k] = seats.predict(self.c[k - 1], self.t[k - 1], self.first[k - 1], out[k - 1])[self.up[k]]
        return out

    def sweep(self, low: np.ndarray, seats: Seats, rng: np.random.Generator, sample: bool) -> None:
        """Every dish of every restaurant seated anew, from the longest contexts to the shortest. low: probabilities of one-byte contexts, [context, byte]."""
        base = self.bases(low, seats)
        for k in range(self.top, 1, -1):
            self.t[k] = seats.sit(self.c[k], self.t[k], self.first[k], base[k], rng)
            if k > 2:
                self.c[k - 1] = self.below(k)
        if sample:
            base = self.bases(low, seats)
            for k in range(2, self.top + 1):
                self.sums[k] = self.sums[k] + seats.predict(self.c[k], self.t[k], self.first[k], base[k])

    def upward(self) -> tuple[np.ndarray, np.ndarray]:
        """Customers that this part sends to one-byte contexts: (context and byte, customers)."""
        at, inverse = np.unique((self.keys[2] & mask(1)).astype(np.int64), return_inverse=True)
        return at, np.bincount(inverse, self.t[2], len(at)).astype(np.int64)


class Low:
    """The restaurants of one-byte contexts and of the empty one: matrices [context, byte] and vectors [byte]."""

    def __init__(self) -> None:
        self.t1, self.t0 = np.zeros((256, 256), np.int64), np.zeros(256, np.int64)

    def sample(self, c1: np.ndarray, seats: Seats, rng: np.random.Generator) -> np.ndarray:
        """Probabilities [context, byte] after every dish is seated anew, given the customers c1."""
        at = np.flatnonzero(c1.ravel())
        c, t, first, uniform = c1.ravel()[at], self.t1.ravel()[at], first_of(at.astype(U)), np.full(256, 1 / 256)
        t = np.where(t > 0, t, np.round(c**seats.d)).astype(np.int64)

        def root() -> tuple[np.ndarray, np.ndarray]:
            c0 = np.bincount(at % 256, np.clip(t, 1, c), 256).astype(np.int64)
            back = (seats.theta + seats.d * self.t0.sum()) / (seats.theta + c0.sum())
            return c0, np.maximum(c0 - seats.d * np.minimum(self.t0, c0), 0) / (seats.theta + c0.sum()) + back / 256

        if not self.t0.any():
            self.t0 = np.minimum(root()[0], 1)
        t = seats.sit(c, t, first, root()[1][at % 256], rng)
        c0 = root()[0]
        held = np.flatnonzero(c0)
        t0 = seats.sit(c0[held], self.t0[held], np.zeros(1, int), uniform[held], rng)
        self.t0 = np.zeros(256, np.int64)
        self.t0[held] = t0
        self.t1 = np.zeros((256, 256), np.int64)
        self.t1.ravel()[at] = t
        total = (seats.theta + c1.sum(1))[:, None]
        return np.maximum(c1 - seats.d * self.t1, 0) / total + (seats.theta + seats.d * self.t1.sum(1))[:, None] / total * root()[1]


STATE = "p int, n array<int>, keys binary, c binary, t array<binary>, s array<binary>, up array<struct<k:int,t:long>>"


def fit(docs: DataFrame, order: int = ORDER, theta: float = THETA, burn_in: int = BURN_IN, samples: int = SAMPLES, seed: int = SEED, parts: int | None = None) -> tuple[DataFrame, np.ndarray]:
    """The model: (p, level, n, keys, prob, back), a row for each part and level of contexts of two bytes or more, and probabilities [context, byte] of one-byte contexts.

    prob are averages over the samples; back is, for each sequence, the weight
    with which its context falls back to its parent's averages such that its
    probabilities add up to one. The discount is the count-of-counts estimate
    n1 / (n1 + 2 n2). Null and empty texts bring nothing; of no text at all the
    model is uniform.
    """
    spark = docs.sparkSession
    if parts is None:
        parts = parts_for(docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0)
    grams = keep(count_grams(docs, parts, order))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [expand(c, n, np.int64) for n, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([int((c == 1).sum()) for c in held], pa.int64()), pa.array([int((c == 2).sum()) for c in held], pa.int64())], ["a", "b"])

    n1, n2 = grams.select("n", "c").mapInArrow(tally, "a long, b long").agg(F.sum("a"), F.sum("b")).first()
    out = "p int, level int, n int, keys binary, prob binary, back binary"
    if n1 is None:
        return spark.createDataFrame([], out), np.full((256, 256), 1 / 256)
    d = float(np.clip(n1 / max(1, n1 + 2 * n2), 0.1, 0.9))
    seats, lower, rng = Seats(d, theta), Low(), np.random.default_rng(seed)
    low, low_sum = np.full((256, 256), 1 / 256), np.zeros((256, 256))
    levels = list(range(order - 1, 1, -1))

    def opened(row: dict) -> Part:
        n = row["n"][0]
        part = Part(expand(row["keys"], n, U, True), expand(row["c"], n, np.int64), order)
        if row["t"] is None:
            part.begin(d)
        else:
            part.resume(*({k: expand(b, len(part.keys[k]), kind) for k, b in zip(levels, row[c], strict=True)} for c, kind in (("t", np.int64), ("s", np.float64))))
        return part

    nothing = [F.lit(None).cast(k).alias(c) for c, k in (("t", "array<binary>"), ("s", "array<binary>"), ("up", "array<struct<k:int,t:long>>"))]
    state = grams.select("p", F.array("n").alias("n"), "keys", "c", *nothing)
    before = grams
    for s in range(burn_in + samples):
        sent = spark.sparkContext.broadcast(low)  # 256 x 256 numbers, whatever the corpus

        def run(batches: Iterator[pa.RecordBatch], s: int = s, sent=sent) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            for batch in batches:
                for row in batch.to_pylist():
                    part = opened(row)
                    part.sweep(sent.value, seats, np.random.default_rng([seed, s, row["p"]]), s >= burn_in)
                    up = pa.array([[{"k": int(k), "t": int(t)} for k, t in zip(*part.upward(), strict=True)]], pa.list_(pa.struct([("k", pa.int32()), ("t", pa.int64())])))
                    blobs = [pa.array([[squeeze(v[k]) for k in levels]], pa.list_(pa.binary())) for v in (part.t, part.sums)]
                    yield pa.RecordBatch.from_arrays([pa.array([row["p"]], pa.int32()), pa.array([row["n"]], pa.list_(pa.int32())), *(pa.array([row[c]], pa.binary()) for c in ("keys", "c")), *blobs, up], ["p", "n", "keys", "c", "t", "s", "up"])

        state = keep(state.mapInArrow(run, STATE))
        c1 = np.zeros(65536, np.int64)
        for r in state.select(F.explode("up").alias("u")).groupBy("u.k").agg(F.sum("u.t").alias("t")).collect():
            c1[r["k"]] = r["t"]
        release(before)
        before = state
        low = lower.sample(c1.reshape(256, 256), seats, rng)
        if s >= burn_in:
            low_sum += low
    mean = low_sum / samples
    sent = spark.sparkContext.broadcast(mean)

    def weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                part = opened(row)
                above = {}
                for k in reversed(levels):
                    keys, own = part.keys[k], part.sums[k] / samples
                    parent = sent.value[((keys >> U(8)) & U(255)).astype(int), (keys & U(255)).astype(int)] if k == 2 else above[k - 1][part.up[k]]
                    above[k] = own
                    left = 1 - np.add.reduceat(own, part.first[k])
                    back = np.where(left > 0, left / np.maximum(1 - np.add.reduceat(parent, part.first[k]), 1e-12), 0)
                    back = np.repeat(back, np.diff(np.append(part.first[k], len(keys))))
                    made = [pa.array([x], pa.binary()) for x in (squeeze(keys, True), squeeze(own), squeeze(back))]
                    yield pa.RecordBatch.from_arrays([pa.array([row["p"]], pa.int32()), pa.array([k], pa.int32()), pa.array([len(keys)], pa.int32()), *made], ["p", "level", "n", "keys", "prob", "back"])

    model = keep(state.mapInArrow(weights, out))
    release(state)
    return model, mean


class Lookup:
    """A part's rows of the model as sorted arrays."""

    def __init__(self, rows: list[dict], low: np.ndarray) -> None:
        self.low, self.levels = low, {}
        for r in rows:
            keys = expand(r["keys"], r["n"], U, True)
            first = first_of(keys)
            self.levels[r["level"]] = keys, expand(r["prob"], r["n"], np.float64), keys[first] >> U(8), expand(r["back"], r["n"], np.float64)[first]

    def probability(self, x: np.ndarray, k: int | None = None) -> np.ndarray:
        """Of sorted sequences x; one not seen falls back to the parents of its context."""
        k = max(self.levels, default=1) if k is None else k
        x = x & mask(k)
        if k == 1:
            return self.low[((x >> U(8)) & U(255)).astype(int), (x & U(255)).astype(int)]
        keys, p, contexts, back = self.levels[k]
        at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
        out = p[at]
        miss = np.flatnonzero(keys[at] != x)
        if len(miss):
            y = x[miss]
            c = np.minimum(np.searchsorted(contexts, y >> U(8)), len(contexts) - 1)
            weight = np.where(contexts[c] == y >> U(8), back[c], 1)
            out[miss] = weight * self.probability(y, k - 1)
        return out


def score(docs: DataFrame, model: DataFrame, low: np.ndarray, order: int = ORDER, parts: int | None = None) -> DataFrame:
    """(doc_id, n_bytes, log_prob, perplexity) of every row, order at most 7; the last two null for null and empty texts.

    parts must be what ``fit`` had, if it was given. Null and repeated doc_ids
    are scored like others; other columns are not read. An empty table gives no
    rows.
    """
    spark = docs.sparkSession
    n_bytes = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    parts = parts or parts_for(n_bytes)
    groups = max(LEAST_PARTS, n_bytes // BYTES_A_PART)
    sent = spark.sparkContext.broadcast(low)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    grouped = rows.withColumn("g", group_of(groups)).repartition(groups, "g")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            gs = batch.column(0).to_numpy()
            for g in np.unique(gs).tolist():
                mine = held.setdefault(g, [])
                data, offsets = buffers(batch.column(1).filter(pa.array(gs == g)))
                for lo, hi in pieces(offsets, 1 << 22):
                    mine.append(distinct(packed(data, offsets[lo : hi + 1], order))[0])
                if len(mine) > 8:
                    mine[:] = [distinct(np.concatenate(mine))[0]]
        for g, mine in held.items():
            keys = distinct(np.concatenate(mine))[0]
            for b in dealt(keys, np.zeros(len(keys), np.int8), parts):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g], pa.int64()), pa.array([None], pa.int32()), b.column(1), b.column(2), *[pa.array([None], pa.binary())] * 2], names=["p", "g", "level", "n", "keys", "prob", "back"])

    wire = "p int, g long, level int, n int, keys binary, prob binary, back binary"
    asked = grouped.select("g", "text").mapInArrow(ask, wire)
    met = asked.unionByName(model.withColumn("g", F.lit(None).cast("long"))).repartition(parts, "p").sortWithinPartitions("p", F.col("level").isNull())

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, ready = None, [], None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["p"] != now:
                    now, held, ready = row["p"], [], None
                if row["level"] is not None:
                    held.append(row)
                    continue
                ready = ready or Lookup(held, sent.value)
                p = ready.probability(expand(row["keys"], row["n"], U, True)).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array([row["g"]], pa.int64()), pa.array([now], pa.int32()), pa.array([row["n"]], pa.int32()), pa.array([squeeze(p)], pa.binary())], ["g", "p", "n", "prob"])

    answered = met.mapInArrow(answer, "g long, p int, n int, prob binary").repartition(groups, "g")
    out = "doc_id long, n_bytes long, log_prob double, perplexity double"

    def one(texts: pa.Table, found: pa.Table) -> pa.Table:
        ids, column = (pa.concat_arrays(texts.column(c).chunks) for c in ("doc_id", "text"))
        data, offsets = buffers(column)
        total, some = np.zeros(len(ids)), [np.zeros(0, U)]
        parts_of_256 = [(at, min(hi, at + 256)) for lo, hi in pieces(offsets, 1 << 21) for at in range(lo, hi, 256)]
        for at, to in parts_of_256:
            some.append(distinct(packed(data, offsets[at : to + 1], order))[0])
            if len(some) > 8:
                some[:] = [distinct(np.concatenate(some))[0]]
        keys = distinct(np.concatenate(some))[0]
        log_p = np.empty(len(keys))
        answers = sorted(zip(*(found.column(c).to_pylist() for c in ("p", "n", "prob")), strict=True))
        by = np.argsort(part_of(keys, parts).astype(np.uint16), kind="stable")
        log_p[by] = np.log(np.concatenate([np.zeros(0, np.float32), *(expand(b, n, np.float32) for _, n, b in answers)]).astype(float))
        for at, to in parts_of_256:
            # Sequence and row in one number: one sort puts equal sequences together and keeps whose they are.
            row = np.repeat(np.arange(to - at, dtype=np.uint8), np.diff(offsets[at : to + 1]))
            x = np.sort(packed(data, offsets[at : to + 1], order) << U(8) | row)
            first = np.flatnonzero(np.concatenate([[True], x[1:] >> U(8) != x[:-1] >> U(8)])[: len(x)])
            each = np.repeat(log_p[np.searchsorted(keys, x[first] >> U(8))], np.diff(np.append(first, len(x))))
            total[at:to] = np.bincount((x & U(255)).astype(np.uint8), each, to - at)
        size = np.diff(offsets)
        none = size == 0
        return pa.table([ids, pa.array(size, pa.int64()), pa.array(total, mask=none), pa.array(np.exp(-total / np.maximum(size, 1)), mask=none)], ["doc_id", "n_bytes", "log_prob", "perplexity"])

    return grouped.groupBy("g").cogroup(answered.groupBy("g")).applyInArrow(one, out)


def group_of(groups: int) -> Column:
    return F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups))


def op1_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability and perplexity of every document under the model of all documents; edge cases are those of ``fit`` and ``score``."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, *fit(docs))
