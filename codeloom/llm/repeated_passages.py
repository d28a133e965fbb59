"""Repeated passages by a collection's BWT and common prefixes, built column by column.

Finds every word that lies in a passage of ``min_words`` words which occurs
elsewhere too, in another text or in the same one.

A passage's anchor is the least hash of its 10-word sequences, and equal
passages have equal anchors, so only passages around anchors seen at least
twice can matter. Passages of a text that share an anchor overlap and make one
window; every passage is in one window only. Windows are shuffled by anchor,
those of equal words as one row, and only such rows fetch their words.
Each partition then builds the Burrows-Wheeler order of its
windows' suffixes by inserting one symbol per window each round, from the
windows' ends: suffix cX goes where the order of X and the symbol's earlier
occurrences put it, and its common prefix with its neighbours follows from those
of X. Between rounds the order is a file in the shared folder, read and written
in sequence; only common prefixes and shifts are held in memory. Runs of
suffixes with min_words words in common are repeated passages, unless all stand
at one place of one text. What a part holds in memory besides (its windows'
words, ranks, prefixes and shifts) is bounded by ``WINDOWS_A_PARTITION``.

An anchor of more than ``HOT`` different windows (words that stand in a million
different surroundings) is more than a part can hold. Equal passages around one
anchor are equal from their first word on, so these windows' passages are
counted by their hashes instead, over all tasks, with the same result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.llm.words import SAME, WHITE, U, Words, buffers, mix, pieces, powers, segment
from codeloom.runtime import keep, release, shared_dir, table

MIN_WORDS, GRAM, WINDOWS_A_PARTITION, HOT, BLOCK = 50, 10, 12_000, 48_000, 1 << 18
NONE = np.iinfo(np.int64).max


class Collection:
    """The growing order of suffixes, as one file a round.

    A row is a suffix: its first symbol (0: the empty suffix), the place of the
    suffix without it, its common prefix with the row before, its window and
    its offset there. First symbols in order of place are the transform's
    inverted lists; ``transform`` gives the transform itself.
    """

    def __init__(self, contents: list[np.ndarray], folder: str) -> None:
        self.contents = contents
        # Offsets and common prefixes are at most a window's words.
        self.short = np.uint8 if max(map(len, contents), default=0) < 255 else np.uint16
        self.KINDS = (np.int32, np.int32, self.short, np.int32, self.short)
        self.store, base = fs.FileSystem.from_uri(folder)
        self.folder = f"{base.rstrip('/')}/bwt-{uuid.uuid4().hex}"
        self.store.create_dir(self.folder, recursive=True)
        self.blocks: list[int] = []
        self.path = ""

    def close(self) -> None:
        self.store.delete_dir(self.folder)

    def read(self) -> Iterator[list[np.ndarray]]:
        with self.store.open_input_stream(self.path) as f:
            for n in self.blocks:
                yield [np.frombuffer(f.read(n * np.dtype(k).itemsize), k) for k in self.KINDS]

    def _next(self, number: int, blocks: Iterator[list[np.ndarray]]) -> None:
        path, old, sizes = f"{self.folder}/{number}", self.path, []
        with self.store.open_output_stream(path) as f:
            for block in blocks:
                sizes.append(len(block[0]))
                for column, kind in zip(block, self.KINDS, strict=True):
                    f.write(np.ascontiguousarray(column, kind))
        self.blocks, self.path = sizes, path
        if old:
            self.store.delete_file(old)

    def build(self) -> None:
        m = len(self.contents)
        size = np.array([len(c) for c in self.contents])
        flat = np.concatenate([*self.contents, np.zeros(0, np.int32)])
        ends = np.cumsum(size)
        every = np.arange(m)
        self._next(0, iter([[np.zeros(m), every, np.zeros(m), every, size]]))
        place = every.copy()
        lcp, shift = np.zeros(m, self.short), np.zeros(m, np.int64)
        for j in range(1, int(size.max(initial=0)) + 1):
            live = np.flatnonzero(size >= j)
            symbol = flat[ends[live] - j].astype(np.int64)
            key = (symbol << 32) | place[live]
            by = np.argsort(key)
            live, key = live[by], key[by]
            self._least = None
            fresh: list[np.ndarray] = []
            at_all: list[np.ndarray] = []
            self._next(j, self._merge(key, live, size[live] - j, lcp, shift, fresh, at_all))
            at = np.concatenate(at_all)
            place[live] = at
            n = len(lcp)
            old = at - np.arange(len(at))
            # The file holds places as they were before this round; the next read moves them.
            shift = np.cumsum(np.bincount(old, minlength=n + 1))[:n]
            lcp = np.concatenate(fresh)

    def _merge(self, key: np.ndarray, window: np.ndarray, offset: np.ndarray, lcp: np.ndarray, shift: np.ndarray, fresh: list[np.ndarray], at_all: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
        """Blocks of the next file: the old rows with the new ones put in."""
        done, begun, before = 0, 0, np.int64(-1)
        rest = list(self.blocks)
        for old in self.read():
            rest.pop(0)
            psi = old[1].astype(np.int64)
            psi = psi + shift[psi]
            keys = (old[0].astype(np.int64) << 32) | psi
            to = len(key) if not rest else int(np.searchsorted(key, keys[-1]))
            own = key[done:to]
            local = np.searchsorted(keys, own) + np.arange(len(own))
            n = len(keys) + len(own)
            is_new = np.zeros(n, bool)
            is_new[local] = True
            merged = np.empty(n, np.int64)
            merged[is_new], merged[~is_new] = own, keys
            common = np.empty(n, self.short)
            common[~is_new] = old[2]
            touched = is_new.copy()
            touched[1:] |= is_new[:-1]
            at = np.flatnonzero(touched)
            previous = np.where(at > 0, merged[at - 1], before)
            common[at] = self._prefix(previous, merged[at], lcp)
            win, off = np.empty(n, np.int32), np.empty(n, self.short)
            win[is_new], win[~is_new] = window[done:to], old[3]
            off[is_new], off[~is_new] = offset[done:to], old[4]
            at_all.append(local + begun)
            fresh.append(common)
            before, done, begun = merged[-1], to, begun + n
            for lo in range(0, n, BLOCK):
                part = slice(lo, lo + BLOCK)
                yield [merged[part] >> 32, merged[part] & 0xFFFFFFFF, common[part], win[part], off[part]]

    def _prefix(self, previous: np.ndarray, now: np.ndarray, lcp: np.ndarray) -> np.ndarray:
        """Common prefixes of neighbours given by (symbol, place of the rest): 0, or 1 and the least common prefix between the rests."""
        out = np.zeros(len(now), np.int64)
        same = np.flatnonzero((previous >> 32 == now >> 32) & (now >> 32 > 0))
        if not len(same):
            return out.astype(self.short)
        lo, hi = (previous[same] & 0xFFFFFFFF) + 1, now[same] & 0xFFFFFFFF
        span = hi - lo + 1
        level = np.frexp(span.astype(float))[1] - 1
        if self._least is None:
            self._least = [lcp]
        while len(self._least) <= level.max():
            last, step = self._least[-1], 1 << (len(self._least) - 1)
            self._least.append(np.minimum(last[:-step], last[step:]))
        best = np.empty(len(same), np.int64)
        for k in np.unique(level):
            i = np.flatnonzero(level == k)
            t = self._least[k]
            best[i] = np.minimum(t[lo[i]], t[hi[i] - (1 << int(k)) + 1])
        out[same] = best.astype(np.int64) + 1
        return out.astype(self.short)

    def transform(self) -> Iterator[np.ndarray]:
        """The Burrows-Wheeler transform, by block: the symbol before each suffix, -1 before a whole window."""
        for _, _, _, win, off in self.read():
            yield np.array([self.contents[w][o - 1] if o else -1 for w, o in zip(win, off, strict=True)], np.int64)


def repeated_offsets(windows: Collection, count: np.ndarray, doc: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, offset, least doc) of suffixes that share min_words words with another place.

    count: how many places hold the window; doc: the least doc_id among them.
    """
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    held: list[np.ndarray] = []
    size_of = np.array([len(c) for c in windows.contents])

    def settle(lcp: np.ndarray, win: np.ndarray, off: np.ndarray) -> None:
        if not len(lcp):
            return
        first = np.flatnonzero(np.concatenate([[True], lcp[1:] < min_words]))
        size = np.diff(np.append(first, len(lcp)))
        several = (size > 1) | (np.maximum.reduceat(count[win], first) > 1)
        long = size_of[win[first]] - off[first] >= min_words
        good = np.repeat(long & several, size)
        least = np.repeat(np.minimum.reduceat(doc[win], first), size)
        found.append((win[good], off[good].astype(np.int64), least[good]))

    for _, _, lcp, win, off in windows.read():
        now = [np.concatenate([h, c]) for h, c in zip(held, (lcp, win, off), strict=True)] if held else [lcp, win, off]
        open_from = int(np.flatnonzero(np.concatenate([[True], now[0][1:] < min_words]))[-1])
        settle(*(c[:open_from] for c in now))
        held = [c[open_from:] for c in now]
    if held:
        settle(*held)
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def anchored_windows(words: Words, min_words: int, gram: int) -> tuple[np.ndarray, ...]:
    """(anchor hash, row, first word, words) of each window: the passages of min_words words that share their anchor.

    A passage's anchor is the least hash among its sequences of gram words, the
    leftmost if several are least. Every passage is in one window.
    """
    g, at = words.grams(gram)
    width = min_words - gram + 1
    if len(g) < width:
        return np.zeros(0, U), *(np.zeros(0, np.int64) for _ in range(3))
    row = words.rows()[at]
    best, done = np.arange(len(g)), 1
    lesser = lambda a, b: np.where(g[b] < g[a], b, a)
    while done * 2 <= width:
        best, done = lesser(best[:-done], best[done:]), done * 2
    if width > done:
        best = lesser(best[: done - width], best[width - done :])
    s = np.flatnonzero(row[: len(best)] == row[width - 1 :])
    if not len(s):
        return np.zeros(0, U), *(np.zeros(0, np.int64) for _ in range(3))
    best = best[s]
    begins = np.flatnonzero(np.concatenate([[True], (best[1:] != best[:-1]) | (np.diff(s) != 1)]))
    ends = np.append(begins[1:], len(s)) - 1
    first = at[s[begins]]
    return g[best[begins]], row[best[begins]], first, at[s[ends]] + min_words - first


def sequence_hash(words: Words, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Hash of each sequence of n words from ``first``."""
    up, down = powers(len(words.hash) + 1)
    total = np.zeros(len(words.hash) + 1, U)
    np.cumsum(words.hash * up[: len(words.hash)], out=total[1:])
    return mix((total[first + n] - total[first]) * down[first] + n.astype(U))


def counted_spans(windows: DataFrame, min_words: int) -> DataFrame:
    """(fp, code, a, b, least): what ``order`` finds of windows (fp, code, places, doc, content), by counting the hashes of all their passages."""

    def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(4))
            for lo, hi in pieces(offsets):
                words = segment(data, offsets[lo : hi + 1], WHITE, SAME)
                n = np.diff(words.first) - min_words + 1
                row = np.repeat(np.arange(hi - lo), n)
                at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                code = sequence_hash(words, words.first[row] + at, np.full(len(row), min_words))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, hi - lo).take(pa.array(row)) for i in range(4)), pa.array(at.astype(np.int32)), pa.array(code.view(np.int64))], ["fp", "code", "places", "doc", "at", "passage"])

    every = keep(windows.select("fp", "code", "places", "doc", "content").mapInArrow(passages, "fp long, code long, places long, doc long, at int, passage long"))
    often = every.groupBy("fp", "passage").agg(F.sum("places").alias("n"), F.min("doc").alias("least")).filter("n > 1").select("fp", "passage", "least")
    found = every.select("fp", "code", "at", "passage").join(often, ["fp", "passage"])
    by = Window.partitionBy("fp", "code").orderBy("at")
    opened = found.withColumn("new", F.when(F.col("at") - F.lag("at").over(by) <= min_words, 0).otherwise(1))
    numbered = opened.withColumn("run", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("fp", "code", "run").agg(F.min("at").alias("a"), (F.max("at") + min_words).alias("b"), F.min("least").alias("least")).select("fp", "code", "a", "b", "least")


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(doc_id, start_word, end_word, n_words, first_doc_id): the maximal stretches of words that lie in repeated passages.

    Words stand between ASCII white space and are compared by 64-bit hashes.
    ``first_doc_id`` is the least doc_id in which one of the stretch's passages
    occurs. Texts of fewer words, null and empty texts have none. Rows equal in
    doc_id and text are one text; a null doc_id is reported as null. Other
    columns are not read.
    """
    if not gram <= min_words <= 32_000:
        raise ValueError("min_words must be at least gram and at most 32,000")
    spark = docs.sparkSession
    folder = shared_dir(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("rk", F.xxhash64("doc_id", "text"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, rk = batch.column(0), batch.column(1).to_numpy()
            data, offsets = buffers(batch.column(2))
            for lo, hi in pieces(offsets):
                words = segment(data, offsets[lo : hi + 1], WHITE, SAME)
                fp, row, first, n = anchored_windows(words, min_words, gram)
                code = sequence_hash(words, first, n)
                start = (first - words.first[row]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), pa.array(code.view(np.int64)), doc.slice(lo, hi - lo).take(pa.array(row)), pa.array(rk[lo:hi][row]), pa.array(start), pa.array(n.astype(np.int32))], ["fp", "code", "doc_id", "rk", "start", "n"])

    placed = keep(rows.select("doc_id", "rk", "text").mapInArrow(find, "fp long, code long, doc_id long, rk long, start int, n int").distinct())
    kinds = placed.repartition("fp").groupBy("fp", "code").agg(F.count("*").alias("places"), F.min("doc_id").alias("doc"), F.min(F.struct("rk", "start", "n")).alias("at"))
    kinds = kinds.withColumn("total", F.sum("places").over(Window.partitionBy("fp"))).filter("total > 1")
    kinds = keep(kinds.select("fp", "code", "places", "doc", F.col("at.rk").alias("rk"), F.col("at.start").alias("start"), F.col("at.n").alias("n")))
    parts = max(1, -(-kinds.count() // WINDOWS_A_PARTITION))
    # At most one for each ``hot`` windows; joined, not broadcast.
    many = keep(kinds.groupBy("fp").count().filter(F.col("count") > hot).select("fp"))
    wanted = kinds.groupBy("rk").agg(F.array_sort(F.collect_list(F.struct("start", "n", "fp", "code", "places", "doc"))).alias("wanted"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(0))
            lists = batch.column(1)
            for lo, hi in pieces(offsets):
                words = segment(data, offsets[lo : hi + 1], WHITE, SAME)
                part = lists.slice(lo, hi - lo)
                inner = part.flatten()
                row = np.repeat(np.arange(hi - lo), part.value_lengths().to_numpy())
                first = words.first[row] + inner.field("start").to_numpy()
                begin = offsets[lo:hi][row] + words.start[first]
                end = offsets[lo:hi][row] + words.end[first + inner.field("n").to_numpy() - 1]
                content = pa.array([data[a:b].tobytes() for a, b in zip(begin.tolist(), end.tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([inner.field(c) for c in ("fp", "code", "places", "doc")] + [content], ["fp", "code", "places", "doc", "content"])

    # Repeated rows have one rk; any of them shows its words.
    texts = rows.select("rk", "text").join(wanted, "rk").dropDuplicates(["rk"]).select("text", "wanted")
    windows = texts.mapInArrow(fetch, "fp long, code long, places long, doc long, content binary")

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held).combine_chunks()
        words = segment(*buffers(t.column("content").chunk(0)), WHITE, SAME)
        _, symbols = np.unique(words.hash, return_inverse=True)
        collection = Collection(np.split((symbols + 1).astype(np.int32), words.first[1:-1]), folder)
        try:
            collection.build()
            doc = t.column("doc").fill_null(NONE).to_numpy()
            win, off, least = repeated_offsets(collection, t.column("places").to_numpy(), doc, min_words)
        finally:
            collection.close()
        if not len(win):
            return
        by = np.lexsort((off, win))
        win, off, least = win[by], off[by], least[by]
        first = np.flatnonzero(np.concatenate([[True], (win[1:] != win[:-1]) | (off[1:] - off[:-1] > min_words)]))
        last = np.append(first[1:], len(win)) - 1
        least = np.minimum.reduceat(least, first)
        fp, code = t.column("fp").to_numpy()[win[first]], t.column("code").to_numpy()[win[first]]
        yield pa.RecordBatch.from_arrays([pa.array(fp), pa.array(code), pa.array(off[first].astype(np.int32)), pa.array((off[last] + min_words).astype(np.int32)), pa.array(least, mask=least == NONE)], ["fp", "code", "a", "b", "least"])

    kind = "fp long, code long, a int, b int, least long"
    if many.isEmpty():
        spans = keep(windows.repartition(parts, "fp").mapInArrow(order, kind))
    else:
        windows = keep(windows)
        spans = windows.join(many, "fp", "left_anti").repartition(parts, "fp").mapInArrow(order, kind)
        spans = keep(spans.unionByName(counted_spans(windows.join(many, "fp", "left_semi"), min_words)))
        release(windows)
    release(kinds, many)
    found = placed.join(spans, ["fp", "code"]).select("doc_id", "rk", (F.col("start") + F.col("a")).alias("a"), (F.col("start") + F.col("b")).alias("b"), "least")
    by_start = Window.partitionBy("rk").orderBy("a", "b")
    reach = F.max("b").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    opened = found.withColumn("new", F.when(F.coalesce(F.col("a") > reach, F.lit(True)), 1).otherwise(0))
    numbered = opened.withColumn("run", F.sum("new").over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
    merged = numbered.groupBy("rk", "run").agg(F.first("doc_id").alias("doc_id"), F.min("a").alias("start_word"), F.max("b").alias("end_word"), F.min("least").alias("first_doc_id"))
    return merged.select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "first_doc_id")


def op4_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stretch of repeated passages of MIN_WORDS words in all documents; edge cases are those of ``repeated_passages``."""
    return repeated_passages(table(spark, sf_dir, "documents"))
