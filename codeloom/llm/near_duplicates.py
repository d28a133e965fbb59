"""MinHash near-duplicates: universal hash minima, banding, verification, components.

Plan: one pass over the texts makes signatures; equal signatures collapse to
one row, so copies cost one row each whatever their number; band keys are
shuffled with ids alone; only buckets of two or more fetch signatures. Within a
bucket the edges returned span exactly the components of its verified pairs, so
a bucket of n similar rows gives n - 1 edges and not n * n.

A bucket of more than ``HOT`` rows is not one task's: every row is compared with
the bucket's first row, which settles all that are linked to it. Only if rows
are left over, pairs of these with any row are sought by prefix filtering: a
pair that agrees in enough minima shares one of the minima that remain when each
row leaves out its most frequent ones, so rows meet again in the rare minima
they share. Buckets that are still hot after two rounds of this are compared
block by block. Components over all edges come from alternating large-star and
small-star, cut at each round.

A node is a row: its doc_id and 48 bits of a hash of its text as one number, in
the order of doc_id. A null doc_id comes after all others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.words import LOWER, PUNCTUATION, U, buffers, mix, pieces, segment, whole_groups
from codeloom.runtime import cut, keep, release, table

#: 42 bands of 3 minima and an agreement of 0.44 find a pair of Jaccard 0.5 with probability 0.9.
SHINGLE, BANDS, ROWS, THRESHOLD, SEED = 3, 42, 3, 0.44, 11
HOT, BLOCK, HOT_ROUNDS = 8192, 4096, 2
NODE, WIDTH, NO_ID = "decimal(38,0)", 1 << 48, 10**19


def coefficients(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Of n multiply-add-shift hashes, a universal family on 64 bits: the high half of a * x + b, a odd."""
    raw = mix(np.arange(1, 2 * n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed))
    return raw[:n] | U(1), raw[n:]


def signature_rows(column: pa.Array, shingle: int, n: int, seed: int) -> list[bytes | None]:
    """Minima of each text; None where it has no word. Fewer words than a shingle make one shingle."""
    a, b = coefficients(n, seed)
    data, offsets = buffers(column)
    out: list[bytes | None] = []
    for lo, hi in pieces(offsets):
        words = segment(data, offsets[lo : hi + 1], PUNCTUATION, LOWER)
        counts = np.diff(words.first)
        grams, at = words.grams(shingle)
        row = words.rows()[at]
        short = np.flatnonzero((counts > 0) & (counts < shingle))
        if len(short):
            extra = []
            for i in short:
                h = U(counts[i])
                for w in words.hash[words.first[i] : words.first[i + 1]]:
                    h = mix(np.array([h ^ w], U))[0]
                extra.append(h)
            grams, row = np.concatenate([grams, np.array(extra, U)]), np.concatenate([row, short])
            order = np.argsort(row, kind="stable")
            grams, row = grams[order], row[order]
        some = np.flatnonzero(counts > 0)
        minima = np.empty((len(some), n), np.uint32)
        if len(some):
            begins = np.searchsorted(row, some)
            for j in range(n):
                minima[:, j] = np.minimum.reduceat(((grams * a[j] + b[j]) >> U(32)).astype(np.uint32), begins)
        here: list[bytes | None] = [None] * (hi - lo)
        # The low half of a minimum tells minima apart as well as all of it, but for one pair in 65,536.
        for i, m in zip(some.tolist(), minima.astype(np.uint16), strict=True):
            here[i] = m.tobytes()
        out += here
    return out


def node_of(doc_id: Column, text: Column) -> Column:
    """A row's number: rows of one doc_id and one text have one number."""
    ids = F.coalesce(doc_id.cast("decimal(20,0)"), F.lit(str(NO_ID)).cast("decimal(20,0)"))
    return (ids * F.lit(str(WIDTH)).cast("decimal(15,0)") + F.pmod(F.xxhash64(text), F.lit(WIDTH)).cast("decimal(15,0)")).cast(NODE)


def id_of(node: Column) -> Column:
    """The doc_id of a node, null for none."""
    low = F.pmod(node, F.lit(str(WIDTH)).cast("decimal(15,0)"))
    whole = ((node - low) / F.lit(str(WIDTH)).cast("decimal(15,0)")).cast("decimal(20,0)")
    return F.when(whole < F.lit(str(NO_ID)).cast("decimal(20,0)"), whole.cast("long"))


def signatures(docs: DataFrame, shingle: int = SHINGLE, n: int = BANDS * ROWS, seed: int = SEED) -> DataFrame:
    """(node, doc_id, k, sig) of every row of docs; sig is null where the text has no word.

    k stands for the signature; that two different ones have the same takes about 2 ** 32 of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = pa.array(signature_rows(batch.column(2), shingle, n, seed), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), sig], ["node", "doc_id", "sig"])

    text = F.col("text").cast("string")
    rows = docs.select(node_of(F.col("doc_id").cast("long"), text).alias("node"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    return rows.mapInArrow(run, f"node {NODE}, doc_id long, sig binary").withColumn("k", F.xxhash64("sig"))


def spanning(ids: np.ndarray, sigs: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Edges that span the components of all pairs agreeing in ``threshold`` of their minima."""
    edges, left = [], np.arange(len(ids))
    need = int(np.ceil(threshold * sigs.shape[1] - 1e-9))
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            hit = np.empty(len(left), bool)
            for lo in range(0, len(left), 65536):
                hit[lo : lo + 65536] = (sigs[left[lo : lo + 65536]] == sigs[x]).sum(1) >= need
            found, left = left[hit], left[~hit]
            edges += [(int(ids[x]), int(ids[y])) for y in found]
            front += found.tolist()
    return edges


def bucket_edges(members: DataFrame, signed: DataFrame, threshold: float) -> DataFrame:
    """(a, b) spanning the components within each bucket; members: (bucket, k), buckets of at most HOT rows; signed: (k, sig)."""
    grouped = members.join(signed, "k").repartition("bucket").sortWithinPartitions("bucket")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "bucket"):
            t = t.combine_chunks()
            bucket, ids = t.column("bucket").to_numpy(), t.column("k").to_numpy()
            sigs = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint16).reshape(len(ids), -1)
            cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(ids)]
            edges = [e for lo, hi in zip(cuts, cuts[1:], strict=False) for e in spanning(ids[lo:hi], sigs[lo:hi], threshold)]
            if edges:
                a, b = zip(*edges, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return grouped.select("k", "bucket", "sig").mapInArrow(run, "a long, b long")


def sized(keyed: DataFrame) -> DataFrame:
    """(bucket, n, least) of the buckets of two or more rows; of buckets that hold the same rows one."""
    per = keyed.groupBy("bucket").agg(F.count("*").alias("n"), F.min("k").alias("least"), F.max("k").alias("__most"), F.sum(F.xxhash64("k").cast("decimal(20,0)")).alias("__sum"))
    return per.groupBy("n", "least", "__most", "__sum").agg(F.min("bucket").alias("bucket")).select("bucket", "n", "least")


def shared(keyed: DataFrame) -> DataFrame:
    """The rows of keyed whose bucket holds two or more; counted before they are shuffled, so a hot bucket is a row of each task."""
    live = keyed.groupBy("bucket").count().filter("count > 1").select("bucket")
    return keyed.join(live.hint("merge"), "bucket")


def minima_of(sig: Column, n: int) -> Column:
    """The minima of a signature, each with its position, as numbers."""
    return F.array(*[F.xxhash64(F.lit(i), F.substring(sig, 2 * i + 1, 2)) for i in range(n)])


def verified_edges(signed: DataFrame, bands: int, rows: int, threshold: float, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """(a, b) spanning the near-duplicate components within every bucket; signed: (k, sig), one row a signature."""
    width, n = rows * 2, bands * rows
    need = int(np.ceil(threshold * n - 1e-9))
    keys = F.array(*[F.xxhash64(F.lit(i), F.substring("sig", i * width + 1, width)) for i in range(bands)])
    keyed = signed.select(F.explode(keys).alias("bucket"), "k")
    edges, held_tables = None, []
    for turn in range(HOT_ROUNDS + 1):
        keyed = keep(shared(keyed))
        buckets = keep(sized(keyed))
        held_tables += [keyed, buckets]
        cool = bucket_edges(keyed.join(buckets.filter(F.col("n") <= hot).select("bucket"), "bucket"), signed, threshold)
        edges = cool if edges is None else edges.union(cool)
        large = buckets.filter(F.col("n") > hot)
        if large.isEmpty():
            break
        held = keyed.join(large, "bucket")
        if turn == HOT_ROUNDS:
            # Every pair of blocks is a bucket of its own: quadratic work, but spread and exact.
            parts = F.ceil(F.col("n") / block).cast("int")
            mine = F.pmod(F.xxhash64("k", F.lit(1)), parts)
            other = F.explode(F.sequence(F.lit(0), parts - 1))
            dealt = held.select("bucket", "k", mine.cast("int").alias("i"), other.alias("j"))
            pairs = dealt.select(F.xxhash64("bucket", F.least("i", "j"), F.greatest("i", "j")).alias("bucket"), "k")
            edges = edges.union(bucket_edges(pairs, signed, threshold))
            break
        # Rows against the first row of their bucket.
        first = large.select("bucket", "least").join(signed.withColumnRenamed("k", "least").withColumnRenamed("sig", "__sig"), "least")
        agree = F.aggregate(F.zip_with(minima_of(F.col("sig"), n), minima_of(F.col("__sig"), n), lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
        tested = keep(held.select("bucket", "k").join(signed, "k").join(first, "bucket").select("bucket", "k", "least", (agree >= need).alias("linked"), "sig"))
        edges = edges.union(tested.filter("linked AND k <> least").select(F.col("least").alias("a"), F.col("k").alias("b")))
        # Left over: rows not linked to the first, against any row, by the rarest of their minima.
        live = tested.groupBy("bucket").agg(F.max(~F.col("linked")).alias("some")).filter("some").select("bucket")
        tokens = tested.join(live, "bucket").select("bucket", "k", "linked", F.explode(minima_of(F.col("sig"), n)).alias("token"))
        often = tokens.groupBy("bucket", "token").agg(F.count("*").alias("often"), F.max(~F.col("linked")).alias("some"))
        ranked = tokens.join(often.filter("often > 1"), ["bucket", "token"]).groupBy("bucket", "k").agg(F.array_sort(F.collect_list(F.struct("often", "token", "some"))).alias("shared"))
        # Minima of one row only come first in the order of rarity; what the prefix has room for besides is shared.
        room = F.greatest(F.size("shared") - F.lit(need - 1), F.lit(0))
        rare = ranked.select("bucket", "k", F.explode(F.slice("shared", F.lit(1), room)).alias("t")).filter("t.some")
        keyed = rare.select(F.xxhash64("bucket", "t.token").alias("bucket"), "k")
        held_tables.append(tested)
    out = keep(edges.dropDuplicates(["a", "b"]))
    release(*held_tables)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, root): every node of edges (a, b) with the least node of its component.

    Alternates large-star (every larger neighbour moves to the least
    neighbour) and small-star (a node and its smaller neighbours move to the
    least) until the set of edges no longer changes.
    """
    now = keep(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
        before, now = now, keep(small.select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).filter("a <> b").distinct())
        release(before)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())


def linked_groups(docs: DataFrame, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, threshold: float = THRESHOLD, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Signatures (node, doc_id, sig) of every row of docs, and (node, root, links) of the nodes in groups of two or more.

    links counts a node's edges: one for each copy of equal signature that it
    stands for, or to what stands for it, and those to near-duplicates that
    connect the group.
    """
    signed = cut(signatures(docs, shingle, bands * rows, seed))
    worded = signed.filter("sig IS NOT NULL")
    unique = keep(worded.groupBy("k").agg(F.min("node").alias("rep"), F.first("sig").alias("sig")))
    copies = worded.select("k", "node").join(unique.select("k", "rep").hint("merge"), "k").filter("node <> rep").select(F.col("node").alias("a"), F.col("rep").alias("b"))
    found = verified_edges(unique.select("k", "sig"), bands, rows, threshold)
    reps = unique.select("k", "rep")
    near = found.join(reps.toDF("a", "x"), "a").join(reps.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b")).filter("a <> b")
    edges = keep(near.union(copies))
    release(found)
    links = edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
    return signed, components(edges).join(links, "node")


def near_duplicate_groups(docs: DataFrame, **how: object) -> DataFrame:
    """(doc_id, group_id) of every row in a group of two or more, group_id the least doc_id of it.

    Two rows pair if at least ``threshold`` of their minima over lower-case
    word shingles agree and they share a band; groups are the connected
    components of all pairs. A null or wordless text belongs to no group; a
    null doc_id is reported as null, and as group_id only if all of the group
    are. Rows of one doc_id are rows of their own if their texts differ.
    Other columns are never read.
    """
    signed, roots = linked_groups(docs, **how)
    return signed.join(roots, "node").select("doc_id", id_of(F.col("root")).alias("group_id"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class (group_id), its number of links, and whether it is the one that stays.

    Null and wordless texts are classes of their own, without links; of exactly
    repeated rows each is listed, all with one class and verdict.
    """
    signed, roots = linked_groups(table(spark, sf_dir, "documents"))
    joined = signed.select("node", "doc_id").join(roots, "node", "left")
    return joined.select("doc_id", F.coalesce(id_of(F.col("root")), "doc_id").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce(F.col("root") == F.col("node"), F.lit(True)).alias("keep"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs with one row of each group: the one of least doc_id (of one doc_id's rows any one of the group); columns as they came.

    Of rows equal in doc_id and text one stays, the least of its other columns;
    rows of one doc_id and different texts are different rows. Null and wordless
    texts stay, all of them.
    """
    signed, roots = linked_groups(docs)
    gone = roots.filter("node <> root").select(F.col("node").alias("__node"))
    repeated = keep(signed.filter("sig IS NOT NULL").groupBy("node").count().filter("count > 1").select(F.col("node").alias("__node")))
    # The row goes along as one struct, so that no column of it can clash.
    rows = docs.select(F.struct(*[docs[c].alias(c) for c in docs.columns]).alias("row"), node_of(docs["doc_id"].cast("long"), docs["text"].cast("string")).alias("__node"))
    # Texts are shuffled at any size, so that what holds for a small table holds for a large one.
    kept = rows.join(gone.hint("merge"), "__node", "left_anti")
    if repeated.isEmpty():
        return kept.select("row.*")
    once = kept.join(repeated, "__node", "left_anti").select("row.*")
    again = kept.join(repeated, "__node", "left_semi").groupBy("__node").agg(F.min("row").alias("least")).select("least.*")
    return once.unionByName(again)
