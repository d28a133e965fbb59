"""Toxicity from the nearest labelled examples by exact TF-IDF cosine in a block-max inverted index.

Fitting reads labelled documents, at most ``MAX_EXAMPLES`` of each class (those
of least hash; a documented bound). Terms are all words of these examples, with
their document frequencies in all documents. Weighting departs from plain
TF-IDF in one way: a word whose frequencies differ between the classes
(chi-square, Bonferroni corrected over all words) has its weight multiplied by
the chi-square over its limit. A word that no example holds can match nothing,
and counts in the length of its text as one of a single document.

Words are runs of letters and digits in lower case, held by their 64-bit hashes.

Examples are ordered by the language of their common words and their length
and cut into blocks of ``BLOCK``; each term's postings are cut likewise. A piece
that a quarter of its block's examples are in is a column of the block's dense
matrix and keeps its greatest weight; the others stay lists, which are short and
added up at once. These sums and a text's weights times the maxima bound the
cosines of a block. Blocks of the greatest bounds are scored first, and then
only those whose bound reaches the k-th cosine found, many texts at a time, so
the k nearest are exact. A document is never its own neighbour.
Distance-weighted votes are calibrated by isotonic regression on the examples'
own votes, at the classes' true rates. A text that shares no term with any
example has no neighbours and takes the rate of toxic labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice
from math import log
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.words import PUNCTUATION, U, buffers, pieces, segment, spaced, spans
from codeloom.runtime import cut, table

MAX_EXAMPLES, K, REJECT, SEED = 4000, 15, 0.5, 3
BLOCK, CLUSTERS, FIRST_BLOCKS, TOGETHER = 64, 16, 3, 64
SCHEMA = "doc_id long, score double, vote double, toxic boolean, evidence array<struct<doc_id:long,similarity:double,toxic:int>>"


def plain(text: Column) -> Column:
    """The text in lower case; '' for null."""
    return F.lower(F.coalesce(text.cast("string"), F.lit("")))


def bags(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For pieces of a column of plain texts: the first row and that after the last, and row (from the first), word and count of each distinct word of a row, in this order."""
    data, offsets = buffers(column)
    if len(offsets) > 1:
        data, offsets = spaced(data[offsets[0] : offsets[-1]]), offsets - offsets[0]
    for lo, hi in pieces(offsets, 1 << 18):
        words = segment(data, offsets[lo : hi + 1], PUNCTUATION)
        row = words.rows()
        by = np.lexsort((words.hash, row))
        row, word = row[by], words.hash[by]
        first = np.flatnonzero(np.concatenate([[True], (word[1:] != word[:-1]) | (row[1:] != row[:-1])])) if len(row) else np.zeros(0, int)
        yield lo, hi, row[first], word[first], np.diff(np.append(first, len(row)))


@dataclass
class Index:
    """Everything a task needs: bounded by the words of MAX_EXAMPLES examples, whatever the corpus.

    ``words`` are the terms' sorted hashes; ``rows`` the examples, each its
    terms and weights. What ``build`` adds is made anew on each worker: lists
    (of term t those from ``begin[t]`` to ``begin[t + 1]``), the blocks' dense
    matrices, and the greatest weight of each of their columns.
    """

    words: np.ndarray
    idf: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    rows: list[tuple[np.ndarray, np.ndarray]]
    prior: float
    unseen: float = 1.0
    steps: tuple[np.ndarray, np.ndarray] = (np.zeros(0), np.zeros(0))
    bare: float = 0.0
    made: dict = field(default_factory=dict)

    def __getstate__(self) -> dict:
        """What is sent: the terms and weights of the examples, in one array each."""
        return {k: v for k, v in self.__dict__.items() if k not in ("shared", "rows", "made")} | {"flat": self._flat()}

    def __setstate__(self, state: dict) -> None:
        """On a worker only what ``build`` makes is held, not the examples' own vectors."""
        flat = state.pop("flat")
        self.__dict__.update(state | {"rows": [], "made": {}})
        self._cut(*flat)

    def _flat(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        f, w = (np.concatenate([np.zeros(0, k), *[r[i] for r in self.rows]]).astype(k, copy=False) for i, k in enumerate((np.int32, np.float32)))
        return np.array([len(f) for f, _ in self.rows], np.int32), f, w

    def arrange(self) -> Index:
        """Put like examples together."""
        order = arrangement(self.rows, len(self.idf))
        self.ids, self.labels, self.rows, self.made = self.ids[order], self.labels[order], [self.rows[i] for i in order], {}
        return self

    def build(self) -> dict:
        if not self.made:
            self._cut(*self._flat())
        return self.made

    def _cut(self, sizes: np.ndarray, f: np.ndarray, weight: np.ndarray) -> None:
        """Cut the postings of each term into blocks of examples."""
        n_blocks = -(-len(sizes) // BLOCK)
        by = np.argsort(f, kind="stable").astype(np.int32)
        f, weight = f[by], weight[by]
        place = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[by]
        del by
        change = np.ones(len(f), bool)
        change[1:] = (f[1:] != f[:-1]) | (place[1:] // BLOCK != place[:-1] // BLOCK)
        starts = np.flatnonzero(change).astype(np.int32)
        del change
        size = np.diff(np.append(starts, np.int32(len(f))))
        thick = np.flatnonzero(size >= BLOCK // 4)
        term, at = f[starts[thick]], place[starts[thick]] // BLOCK
        common = np.unique(term)
        column = np.full(len(self.idf), -1, np.int32)
        column[common] = np.arange(len(common))
        most = np.zeros((len(common), n_blocks))
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for b in range(n_blocks):
            mine = np.flatnonzero(at == b)
            matrix = np.zeros((BLOCK, len(mine)))
            begin, n = starts[thick[mine]], size[thick[mine]]
            some = spans(begin, begin + n)
            matrix[place[some] - b * BLOCK, np.repeat(np.arange(len(mine)), n)] = weight[some]
            most[column[term[mine]], b] = matrix.max(0, initial=0)
            held.append((column[term[mine]], matrix))
        thin = np.repeat(size < BLOCK // 4, size)
        self.made = {"begin": np.concatenate([[0], np.cumsum(np.bincount(f[thin], minlength=len(self.idf)))]).astype(np.int32), "place": place[thin], "weight": weight[thin], "column": column, "most": most, "dense": held}

    def vectors(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of each plain text its terms and weights, as parts of a vector of length one over all its words."""
        for lo, hi, row, word, count in bags(column):
            at = np.searchsorted(self.words, word)
            known = self.words[np.minimum(at, len(self.words) - 1)] == word if len(self.words) else np.zeros(len(word), bool)
            w = (1 + np.log(count)) * np.where(known, self.idf[np.minimum(at, len(self.idf) - 1)] if len(self.idf) else 0.0, self.unseen)
            length = np.sqrt(np.bincount(row, w * w, hi - lo))
            f, w, row = at[known], (w / length[row])[known], row[known]
            ends = np.searchsorted(row, np.arange(hi - lo + 1))
            yield from ((f[a:b], w[a:b]) for a, b in zip(ends, ends[1:], strict=False))

    def nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], owns: list[int | None], k: int = K) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each vector the examples of the k greatest positive cosines, and these; ties go to the lesser doc_id. owns: the doc_ids of the texts, which are no neighbours of theirs."""
        m = self.build()
        n_blocks = m["most"].shape[1]
        score, dense = np.zeros((len(queries), n_blocks * BLOCK)), np.zeros((len(queries), len(m["most"])))
        left, least, mine = np.zeros((len(queries), n_blocks), bool), np.zeros(len(queries)), []
        for i, ((f, w), own) in enumerate(zip(queries, owns, strict=True)):
            mine.append(np.flatnonzero(self.ids == own) if own is not None else np.zeros(0, int))
            if not len(f) or not n_blocks:
                continue
            begin, end = m["begin"][f], m["begin"][f + 1]
            at = spans(begin, end)
            score[i] = np.bincount(m["place"][at], m["weight"][at] * np.repeat(w, end - begin), score.shape[1])
            column = m["column"][f]
            on = column >= 0
            column, v = column[on], w[on]
            dense[i, column] = v
            by_block = score[i].reshape(n_blocks, BLOCK)
            bound = by_block.max(1) + v @ m["most"][column]
            first = np.argsort(-bound, kind="stable")[: FIRST_BLOCKS + (k - 1) // BLOCK]
            for b in first.tolist():
                columns, matrix = m["dense"][b]
                by_block[b] += matrix @ dense[i, columns]
            score[i, mine[-1]] = 0
            some = by_block[first].ravel()
            least[i] = np.partition(some, len(some) - k)[len(some) - k] if len(some) > k else 0.0
            left[i] = (bound > 0) & (bound >= least[i] - 1e-6)
            left[i, first] = False
        for b in range(n_blocks):
            who = np.flatnonzero(left[:, b])
            if len(who):
                columns, matrix = m["dense"][b]
                score[who, b * BLOCK : (b + 1) * BLOCK] += dense[np.ix_(who, columns)] @ matrix.T
        out = []
        for i, own in enumerate(mine):
            score[i, own] = 0
            rows = np.flatnonzero(score[i] > max(0.0, least[i] - 1e-6))
            near = np.round(score[i, rows], 9)
            by = np.lexsort((self.ids[rows], -near))
            by = by[near[by] > 0][:k]
            out.append((rows[by], near[by]))
        return out

    def vote(self, rows: np.ndarray, similarity: np.ndarray) -> float:
        """Share of toxic among neighbours, weighted by the inverse of their distance, with one neighbour of the prior."""
        near = 1 / (1.05 - np.minimum(similarity, 1))
        return float((near @ self.labels[rows] + self.prior) / (near.sum() + 1))

    def voted(self, ids: pa.Array, texts: pa.Array, k: int = K) -> Iterator[tuple[float | None, np.ndarray, np.ndarray]]:
        """Of each plain text the vote (None without neighbours), its neighbours and their cosines."""
        owns, vectors = ids.to_pylist(), self.vectors(texts)
        for lo in range(0, len(owns), TOGETHER):
            for rows, near in self.nearest(list(islice(vectors, TOGETHER)), owns[lo : lo + TOGETHER], k):
                yield (self.vote(rows, near) if len(rows) else None), rows, near

    def calibrated(self, vote: float | None) -> float:
        x, y = self.steps
        return self.bare if vote is None else float(np.interp(vote, x, y)) if len(x) else self.prior


def arrangement(rows: list[tuple[np.ndarray, np.ndarray]], n_terms: int) -> np.ndarray:
    """An order in which examples of like common words, and of like length among these, stand together: it only makes bounds tight."""
    held = np.bincount(np.concatenate([np.zeros(0, int), *[f for f, _ in rows]]), minlength=n_terms)
    common = np.flatnonzero(held >= max(2, len(rows) // 50))
    at = np.full(n_terms, -1)
    at[common] = np.arange(len(common))
    m = np.zeros((len(rows), len(common)), np.float32)
    for i, (f, w) in enumerate(rows):
        m[i, at[f][at[f] >= 0]] = w[at[f] >= 0]
    m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)
    group = np.zeros(len(rows), int)
    if len(rows) > CLUSTERS:
        centre = m[np.linspace(0, len(rows) - 1, CLUSTERS).astype(int)]
        for _ in range(6):
            group = np.argmax(m @ centre.T, 1)
            centre = np.stack([m[group == c].mean(0) if (group == c).any() else centre[c] for c in range(CLUSTERS)])
            centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-9)
    return np.lexsort(([len(f) for f, _ in rows], group)) if rows else np.zeros(0, int)


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the ends of each pool and its mean."""
    pools: list[list[float]] = []
    order = np.argsort(x, kind="stable")
    for a, b, c in zip(x[order], y[order], w[order], strict=True):
        pools.append([a, a, b * c, c])
        while len(pools) > 1 and (pools[-2][2] * pools[-1][3] >= pools[-1][2] * pools[-2][3] or pools[-2][1] == pools[-1][0]):
            last = pools.pop()
            pools[-1] = [pools[-1][0], last[1], pools[-1][2] + last[2], pools[-1][3] + last[3]]
    xs = np.array([v for p in pools for v in p[:2]])
    return xs, np.array([p[2] / p[3] for p in pools for _ in range(2)])


def fit(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES, seed: int = SEED) -> Index:
    """The index from labelled documents; labels without a document, or null, are left out, a doc_id labelled twice is toxic if one of its labels says so.

    Of several rows of one doc_id the greatest text is its example. Without
    examples of both classes the index is empty and every score the rate of
    toxic labels (0 without any).
    """
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rates = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    order = [F.xxhash64("doc_id", F.lit(seed)), F.col("doc_id")]
    sample = known.filter("toxic = 1").orderBy(*order).limit(max_examples).union(known.filter("toxic = 0").orderBy(*order).limit(max_examples))
    prior = rates.get(1, 0) / max(1, sum(rates.values()))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), plain(F.col("text")).alias("text"))
    # The sample holds at most 2 * max_examples ids, so it is broadcast.
    picked = cut(texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.first("toxic").alias("toxic")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(1).to_numpy()
            for lo, _, row, word, _ in bags(batch.column(0)):
                by, at = np.unique(word, return_inverse=True)
                bad = np.bincount(at, toxic[lo + row], len(by)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(by.view(np.int64)), pa.array(bad), pa.array(np.bincount(at, minlength=len(by)) - bad)], ["term", "bad", "good"])

    sizes = {r["toxic"]: r["count"] for r in picked.groupBy("toxic").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    # Bounded by the examples' texts: all their words.
    counted = picked.select("text", "toxic").mapInArrow(count, "term long, bad long, good long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).toArrow() if n1 and n0 else None
    if counted is None or not len(counted):
        return Index(np.zeros(0, U), np.zeros(0), np.zeros(0, np.int64), np.zeros(0), [], prior, bare=prior)
    words = counted.column("term").to_numpy().view(U)
    by = np.argsort(words)
    words, bad, good = words[by], *(counted.column(c).to_numpy()[by].astype(float) for c in ("bad", "good"))
    n, limit = n1 + n0, NormalDist().inv_cdf(1 - 0.05 / len(words) / 2) ** 2
    spread = n1 * n0 * (bad + good) * (n - bad - good)
    chi = np.divide((bad * (n0 - good) - good * (n1 - bad)) ** 2 * n, spread, out=np.zeros(len(words)), where=spread > 0)
    telling = np.where(chi > limit, chi / limit, 1.0)
    terms_of = spark.sparkContext.broadcast(words)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = terms_of.value
        df = np.zeros(len(known) + 1, np.int64)  # the last is the number of texts
        for batch in batches:
            for _, _, _, word, _ in bags(batch.column(0)):
                at = np.minimum(np.searchsorted(known, word), len(known) - 1)
                df += np.bincount(at[known[at] == word], minlength=len(df))
            df[-1] += batch.num_rows
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(df[some])], ["term", "df"])

    t = texts.select("text").mapInArrow(frequencies, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(len(words) + 1)
    df[t.column(0).to_numpy()] = t.column(1).to_numpy()
    index = Index(words, (np.log((1 + df[-1]) / (1 + df[:-1])) + 1) * telling, np.zeros(0, np.int64), np.zeros(0), [], prior, log((1 + df[-1]) / 2) + 1, bare=prior)
    terms_of.destroy()
    # Bounded: at most 2 * max_examples texts.
    t = picked.select("doc_id", "text", "toxic").toArrow().combine_chunks()
    ids, toxic = t.column("doc_id").to_numpy(), t.column("toxic").to_numpy()
    rows = [(f.astype(np.int32), w.astype(np.float32)) for f, w in index.vectors(pa.concat_arrays(t.column("text").chunks))]
    live = sorted((i for i, (f, _) in enumerate(rows) if len(f)), key=lambda i: ids[i])
    index.ids, index.labels, index.rows = ids[live].astype(np.int64), toxic[live].astype(float), [rows[i] for i in live]
    index.arrange()
    index.shared = spark.sparkContext.broadcast(index)
    shared = index.shared

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([v for v, _, _ in shared.value.voted(batch.column(0), batch.column(1))], pa.float64()), batch.column(2)], ["vote", "toxic"])

    t = picked.select("doc_id", "text", "toxic").mapInArrow(votes, "vote double, toxic int").filter("vote IS NOT NULL").toArrow()
    if len(t):
        y = t.column("toxic").to_numpy().astype(float)
        index.steps = isotonic(t.column("vote").to_numpy(), y, np.where(y == 1, prior / n1, (1 - prior) / n0))
    return index


def sent(spark: SparkSession, index: Index) -> Broadcast:
    """The index on all executors; one that ``fit`` sent already is not sent again."""
    return index.shared if hasattr(index, "shared") else spark.sparkContext.broadcast(index)


def score(docs: DataFrame, index: Index, k: int = K, reject: float = REJECT) -> DataFrame:
    """(doc_id, score, vote, toxic, evidence) of every row; evidence are the neighbours, nearest first, never of the row's own doc_id.

    A null or empty text has no term: no neighbours, a null vote. Null and
    repeated doc_ids are scored like others; other columns are not read. An
    empty table gives no rows.
    """
    shared, steps = sent(docs.sparkSession, index), index.steps
    kinds = [("doc_id", pa.int64()), ("similarity", pa.float64()), ("toxic", pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = shared.value
        at.steps = steps
        for batch in batches:
            votes, size, held, sims = [], [0], [np.zeros(0, int)], [np.zeros(0)]
            for vote, rows, near in at.voted(batch.column(0), batch.column(1), k):
                votes.append(vote)
                size.append(len(rows))
                held.append(rows)
                sims.append(near)
            scores, rows = [at.calibrated(v) for v in votes], np.concatenate(held)
            inner = pa.StructArray.from_arrays([pa.array(at.ids[rows]), pa.array(np.concatenate(sims)), pa.array(at.labels[rows].astype(np.int32))], fields=[pa.field(*x) for x in kinds])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(votes, pa.float64()), pa.array([s >= reject for s in scores], pa.bool_()), pa.ListArray.from_arrays(pa.array(np.cumsum(size), pa.int32()), inner)], ["doc_id", "score", "vote", "toxic", "evidence"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), plain(F.col("text")).alias("text"))
    return rows.mapInArrow(run, SCHEMA)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score, vote, verdict and evidence of every document, by the examples that ``labels`` names.

    Edge cases are those of ``fit`` and ``score``: null and empty texts have no
    evidence and the base rate, repeated rows are scored each.
    """
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows scored as toxic; columns as they came. Every row is scored on its own text, so ids need not be unique; a null doc_id is no example's."""
    index = fit(docs, labels)
    shared, steps = sent(docs.sparkSession, index), index.steps

    @F.arrow_udf("boolean")
    def clean(ids: pa.Array, texts: pa.Array) -> pa.Array:
        at = shared.value
        at.steps = steps
        return pa.array([at.calibrated(vote) < REJECT for vote, _, _ in at.voted(ids, texts)], pa.bool_())

    return docs.filter(clean(F.col("doc_id").cast("long"), plain(F.col("text"))))


def exact(index: Index, f: np.ndarray, w: np.ndarray, k: int = K, own: int | None = None) -> list[int]:
    """The same neighbours by brute force, for tests."""
    every = []
    for i, (g, v) in enumerate(index.rows):
        if index.ids[i] == own:
            continue
        x = np.zeros(len(index.idf))
        x[g] = v
        s = round(float(w @ x[f]), 9)
        if s > 0:
            every.append((-s, int(index.ids[i]), i))
    return [i for _, _, i in sorted(every)[:k]]


