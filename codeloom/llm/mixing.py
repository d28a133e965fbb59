"""Temperature mixing of sources, realised as budgeted block permutations.

Source i with share p_i of all tokens gets weight p_i ** a / sum(p_j ** a). The
exponent a in [0, 1] is bisected: for ``max_repeats`` the least a (the flattest
mixture) at which no source is read more than that many times within the
budget; for ``entropy`` the a whose mixture has that entropy in nats.

Weights become rows block by block. Documents of a source fall into blocks by
hash; in each epoch the blocks have a new pseudo-random order, and documents a
new one within their block. Rows are taken in that order while the tokens
before them stay under the source's budget. Running sums are taken in three
levels: over 2 ** ``RANGE_BITS`` ranges of a source's block order, over the
blocks of a range, and over the documents of a block, so no window spans a
source. The exponent is bisected on the cluster, several steps a pass, so
sources may be many; only sums come to the driver.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.runtime import cut, keep, table

MAX_REPEATS, BLOCK_DOCS, SEED, STEPS = 1.25, 256, 7, 40
#: Bits of the block order that make a range, steps of the bisection a pass, and sources up to which their table (about 100 bytes each) is broadcast.
RANGE_BITS, STEPS_A_PASS, BROADCAST_SOURCES = 12, 8, 50_000


def tokens_of(text: Column) -> Column:
    """Words between white space (space, tab, line ends); 0 for null or empty."""
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit("[^ \\t\\n\\r\\f]+")).cast("long")


def source_of(docs: DataFrame) -> Column:
    return F.coalesce(docs["source"].cast("string"), F.lit("")).alias("source")


def key_of(docs: DataFrame) -> Column:
    """What a document is drawn by: its doc_id, or a digest of its text where it has none."""
    return F.coalesce(docs["doc_id"].cast("long").cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(docs["text"].cast("string"), F.lit(""))))).alias("key")


def flat_enough(totals: DataFrame, whole: float, points: list[float], budget: float, max_repeats: float | None, entropy: float | None) -> list[bool]:
    """Whether the mixture of each exponent meets the target: sums over all sources, one pass for all points."""
    import math

    log = F.ln(F.col("total") / F.lit(whole))
    each = totals.select("total", log.alias("l"), F.explode(F.array(*[F.lit(float(a)) for a in points])).alias("a")).withColumn("e", F.exp(F.col("a") * F.col("l")))
    got = {r["a"]: r for r in each.groupBy("a").agg(F.sum("e").alias("s"), F.max(F.col("e") * F.lit(float(budget)) / F.col("total")).alias("top"), F.sum(F.col("e") * F.col("a") * F.col("l")).alias("x")).collect()}
    if max_repeats is not None:
        return [got[a]["top"] <= max_repeats * got[a]["s"] for a in points]
    return [math.log(got[a]["s"]) - got[a]["x"] / got[a]["s"] <= entropy for a in points]


def exponent(totals: DataFrame, whole: float, budget: float, max_repeats: float | None, entropy: float | None, steps: int = STEPS) -> float:
    """The bisected exponent; 1 (the natural mixture), with a warning, if no exponent meets the target."""
    zero, one = flat_enough(totals, whole, [0.0, 1.0], budget, max_repeats, entropy)
    if zero:
        return 0.0
    if not one:
        warnings.warn("no exponent in [0, 1] meets the target; the natural mixture is taken", stacklevel=2)
        return 1.0
    lo, hi, done = 0.0, 1.0, 0
    while done < steps:
        deep = min(STEPS_A_PASS, steps - done)
        n = 1 << deep
        points = [lo + (hi - lo) * i / n for i in range(1, n)]
        ok = flat_enough(totals, whole, points, budget, max_repeats, entropy)
        a, b = 0, n
        while b - a > 1:
            mid = (a + b) // 2
            a, b = (a, mid) if ok[mid - 1] else (mid, b)
        lo, hi, done = lo + (hi - lo) * a / n, lo + (hi - lo) * b / n, done + deep
    return hi


def hashed(*parts: Column) -> Column:
    """A number in [0, 2**60) that DuckDB can compute as well."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 15), 16, 10).cast("long")


def source_weights(totals: DataFrame, budget: float | None, max_repeats: float | None, entropy: float | None) -> tuple[DataFrame, int]:
    """(source, total, docs, target) of each source, target in tokens, and the number of sources."""
    n, whole = totals.agg(F.count("*"), F.sum("total")).first()
    if not n:
        return totals.select("source", "total", "docs", F.lit(0).cast("long").alias("target")), 0
    whole, budget = float(whole), float(whole if budget is None else budget)
    a = exponent(totals, whole, budget, max_repeats, entropy)
    raw = F.exp(F.lit(a) * F.ln(F.col("total") / F.lit(whole)))
    s = totals.agg(F.sum(raw)).first()[0]
    return totals.select("source", "total", "docs", F.floor(raw / F.lit(s) * F.lit(budget)).cast("long").alias("target")), n


def block_of(seed: int, blocks: Column, key: Column) -> Column:
    return hashed(F.lit(seed), key) % blocks


def place_of_block(seed: int, source: Column, epoch: Column, block: Column) -> Column:
    """Blocks of a source are read in this order, ties by their number."""
    return hashed(F.lit(seed), source, epoch, block)


def place_in_block(seed: int, epoch: Column, key: Column) -> Column:
    """Documents of a block are read in this order, ties by their key."""
    return hashed(F.lit(seed), epoch, key)


def planned(docs: DataFrame, budget: float | None, max_repeats: float | None, entropy: float | None, block_docs: int, seed: int) -> tuple[DataFrame, DataFrame, int]:
    """What plan_mixture gives, with the number of ``blocks`` of each source; the documents that have tokens; the number of sources."""
    base = docs.select(key_of(docs), F.col("doc_id").cast("long").alias("doc_id"), source_of(docs), tokens_of(F.col("text")).alias("n_tokens")).filter("n_tokens > 0")
    base = cut(base.groupBy("source", "key").agg(F.first("doc_id").alias("doc_id"), F.sum("n_tokens").alias("n_tokens")))
    totals = keep(base.groupBy("source").agg(F.sum("n_tokens").alias("total"), F.count("*").alias("docs")))
    sources, n_sources = source_weights(totals, budget, max_repeats, entropy)
    sized = sources.select("source", "total", "target", F.ceil(F.col("docs") / block_docs).cast("long").alias("blocks"))
    placed = base.join(F.broadcast(sized) if n_sources <= BROADCAST_SOURCES else sized, "source").withColumn("block", block_of(seed, F.col("blocks"), F.col("key")))
    epochs = F.floor((F.col("target") + F.col("total") - 1) / F.col("total")).cast("int")
    placed = placed.filter("target > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), (epochs - 1).cast("long"))))
    blocks = placed.groupBy("source", "epoch", "block").agg(F.sum("n_tokens").alias("in_block"))
    blocks = blocks.withColumn("at", place_of_block(seed, F.col("source"), F.col("epoch"), F.col("block")))
    blocks = blocks.withColumn("range", F.shiftright("at", 60 - RANGE_BITS))
    ahead = lambda *by: Window.partitionBy("source", "epoch", *by).rowsBetween(Window.unboundedPreceding, -1)
    ranges = blocks.groupBy("source", "epoch", "range").agg(F.sum("in_block").alias("in_range"))
    ranges = ranges.select("source", "epoch", "range", F.coalesce(F.sum("in_range").over(ahead().orderBy("range")), F.lit(0)).alias("before_range"))
    within = F.coalesce(F.sum("in_block").over(ahead("range").orderBy("at", "block")), F.lit(0))
    blocks = blocks.withColumn("within", within).join(ranges, ["source", "epoch", "range"]).select("source", "epoch", "block", (F.col("before_range") + F.col("within")).alias("ahead"))
    inner = ahead("block").orderBy(place_in_block(seed, F.col("epoch"), F.col("key")), "key")
    taken = placed.join(blocks, ["source", "epoch", "block"])
    before = F.col("epoch") * F.col("total") + F.col("ahead") + F.coalesce(F.sum("n_tokens").over(inner), F.lit(0))
    return taken.withColumn("before", before).filter("before < target"), base, n_sources


def plan_mixture(docs: DataFrame, budget: float | None = None, max_repeats: float | None = MAX_REPEATS, entropy: float | None = None, block_docs: int = BLOCK_DOCS, seed: int = SEED) -> DataFrame:
    """(source, doc_id, key, n_tokens, epoch, block, before): every copy the mixture takes, ``before`` the tokens of its source ahead of it.

    Rows that repeat a doc_id within a source are drawn together, as one
    document of all their tokens; rows without doc_id by their text. A null
    source is a source of its own, named ''. Documents without tokens are not
    taken: there is nothing to draw. An empty table gives no rows. Of extra
    columns none is read.
    """
    return planned(docs, budget, max_repeats, entropy, block_docs, seed)[0].select("source", "doc_id", "key", "n_tokens", "epoch", "block", "before")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the mixture over documents, no source read more than MAX_REPEATS times."""
    return plan_mixture(table(spark, sf_dir, "documents")).drop("key")


def mix_documents(docs: DataFrame) -> DataFrame:
    """docs as the mixture has them: rows left out or repeated, columns as they came.

    A source is read whole in each epoch but its last, and there up to one
    document. So a row's copies follow from its own key and where its source
    ends, a few numbers a source, which are broadcast: texts stay where they
    are read. Where sources are too many for that, rows are joined by key.
    """
    taken, base, n_sources = planned(docs, None, MAX_REPEATS, None, BLOCK_DOCS, SEED)
    # The row goes along as one struct, so that no column of it can clash.
    rows = docs.select(F.struct(*[docs[c].alias(c) for c in docs.columns]).alias("row"), key_of(docs).alias("__key"), source_of(docs).alias("__source"))
    if n_sources > BROADCAST_SOURCES:
        copies = taken.groupBy(F.col("key").alias("__key"), F.col("source").alias("__source")).agg(F.count("*").cast("int").alias("copies"))
        counted = rows.join(copies, ["__key", "__source"])
    else:
        last = F.struct("epoch", place_of_block(SEED, F.col("source"), F.col("epoch"), F.col("block")).alias("at"), "block", place_in_block(SEED, F.col("epoch"), F.col("key")).alias("within"), "key")
        ends = keep(taken.groupBy(F.col("source").alias("__source")).agg(F.max("blocks").alias("blocks"), F.max_by(last, "before").alias("last")))
        # A row without tokens goes along with rows of its doc_id that have some; only such rows are looked up.
        blank = ~F.coalesce(F.col("row.text").cast("string"), F.lit("")).rlike("[^ \\t\\n\\r\\f]")
        known = base.select(F.col("key").alias("__key"), F.col("source").alias("__source"))
        drawn = rows.filter(~blank).unionByName(rows.filter(blank).join(known, ["__key", "__source"], "left_semi"))
        epoch, block = F.col("last.epoch"), block_of(SEED, F.col("blocks"), F.col("__key"))
        place = F.struct(place_of_block(SEED, F.col("__source"), epoch, block).alias("at"), block.alias("block"), place_in_block(SEED, epoch, F.col("__key")).alias("within"), F.col("__key").alias("key"))
        in_last = place <= F.struct("last.at", "last.block", "last.within", "last.key")
        counted = drawn.join(F.broadcast(ends), "__source").withColumn("copies", (epoch + in_last.cast("long")).cast("int"))
    return counted.withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select("row.*")


SQL = f"""
WITH RECURSIVE base AS (
  SELECT doc_id, coalesce(doc_id::VARCHAR, 'text:' || md5(coalesce(text, ''))) AS key, coalesce(source, '') AS source,
         CASE WHEN t = '' THEN 0 ELSE len(string_split_regex(t, ' +')) END::BIGINT AS n_tokens
  FROM (SELECT doc_id, text, source, trim(translate(coalesce(text, ''), chr(9) || chr(10) || chr(13) || chr(12), '    '), ' ') AS t FROM documents)),
ranked AS (SELECT source, key, first(doc_id) AS doc_id, sum(n_tokens)::BIGINT AS n_tokens FROM base WHERE n_tokens > 0 GROUP BY source, key),
totals AS (SELECT source, sum(n_tokens)::DOUBLE AS total, count(*) AS docs FROM ranked GROUP BY source),
whole AS (SELECT sum(total) AS whole FROM totals),
bisect AS (
  SELECT 0 AS step, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi
  UNION ALL
  SELECT step + 1, CASE WHEN ok THEN lo ELSE (lo + hi) / 2 END, CASE WHEN ok THEN (lo + hi) / 2 ELSE hi END
  FROM (SELECT step, lo, hi,
          (SELECT max(exp((b.lo + b.hi) / 2 * ln(total / whole)) * whole / total)
             <= {MAX_REPEATS} * sum(exp((b.lo + b.hi) / 2 * ln(total / whole))) FROM totals, whole) AS ok
        FROM bisect b WHERE step < {STEPS})),
chosen AS (
  SELECT CASE WHEN (SELECT max(whole / total) <= {MAX_REPEATS} * count(*) FROM totals, whole) THEN 0.0 ELSE max_by(hi, step) END AS a FROM bisect),
sized AS (
  SELECT source, total::BIGINT AS total, ((docs + {BLOCK_DOCS - 1}) // {BLOCK_DOCS})::BIGINT AS blocks,
         floor(exp(a * ln(total / whole)) / sum(exp(a * ln(total / whole))) OVER () * whole)::BIGINT AS target
  FROM totals, whole, chosen),
placed AS (
  SELECT r.source, r.doc_id, r.key, r.n_tokens, s.total, s.target, e.epoch::BIGINT AS epoch,
         ('0x' || left(md5('{SEED}:' || key), 15))::BIGINT % s.blocks AS block
  FROM ranked r JOIN sized s ON r.source = s.source AND s.target > 0, LATERAL (SELECT unnest(generate_series(0, (s.target + s.total - 1) // s.total - 1)) AS epoch) e),
blocked AS (
  SELECT source, epoch, block,
         coalesce(sum(sum(n_tokens)) OVER (PARTITION BY source, epoch ORDER BY ('0x' || left(md5('{SEED}:' || source || ':' || epoch || ':' || block), 15))::BIGINT, block
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM placed GROUP BY source, epoch, block),
taken AS (
  SELECT source, doc_id, n_tokens, epoch, block, target,
         (epoch * total + ahead + coalesce(sum(n_tokens) OVER (PARTITION BY source, epoch, block
           ORDER BY ('0x' || left(md5('{SEED}:' || epoch || ':' || key), 15))::BIGINT, key
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS before
  FROM placed JOIN blocked USING (source, epoch, block))
SELECT source, doc_id, n_tokens, epoch, block, before FROM taken WHERE before < target
"""
