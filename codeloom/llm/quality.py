"""Quality rules with risk-controlled thresholds.

Each rule scores a text from 0 to 1, higher being worse. For each stratum (lang)
and rule, cutoffs of a grid fixed beforehand are tested from lenient to strict
on the labelled documents: that of n good ones the k which the cutoff rejects
come from a false-rejection rate above ``epsilon / rules`` is an exact binomial
test at level ``delta / (strata * rules)``; testing stops at the first cutoff
not certified (fixed sequence, so the grid itself costs nothing). Bonferroni
over rules and strata makes all statements hold together with probability
1 - delta, and the rates of a stratum's rules add up to at most epsilon. Of
certified cutoffs the one is taken that rejects most bad documents, a good one
counting ``COST`` times, the more lenient on ties; a rule that would reject no
bad one is not used.
"""

from __future__ import annotations

from math import exp, lgamma, log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.runtime import cut, table

EPSILON, DELTA, COST, STEPS = 0.05, 0.1, 10.0, 20
#: Up to so many strata the table of their cutoffs (some 100 bytes each) is broadcast, beyond it is joined.
BROADCAST_STRATA = 50_000
GRID = [round(0.9 * 0.8**j, 6) for j in range(STEPS)]
WORD = "[^ \\t\\n\\r\\f]+"
RULES = ("symbols", "shouting", "emphasis", "repeats", "dup_lines")


def scores(text: Column) -> dict[str, Column]:
    """The rules, on rows that have __words and __lines: shares of markup-like symbols, capitals and ! or ? among characters, of words equal to the one before, and of lines that stood before. 0 for null or empty text."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    n = F.greatest(F.length(t), F.lit(1))
    # What is left after all else is taken out: few characters, so little is copied.
    share = lambda others: F.length(F.regexp_replace(t, others, "")) / n
    words, lines = F.col("__words"), F.col("__lines")
    before = F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0)))
    after = F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0)))
    same = F.size(F.filter(F.zip_with(after, before, lambda a, b: a == b), lambda e: e))
    return {
        "symbols": share(r"[^|#$%&*<>{}^~=_@]+"),
        "shouting": share(r"\P{Lu}+"),
        "emphasis": share("[^!?]+"),
        "repeats": same / F.greatest(F.size(words), F.lit(1)),
        "dup_lines": 1 - F.size(F.array_distinct(lines)) / F.size(lines),
    }


def certified(k: int, n: int, rate: float, level: float) -> bool:
    """Whether P(Binomial(n, rate) <= k) <= level, computed exactly."""
    if k > rate * n:
        return False
    terms = [lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * log(rate) + (n - i) * log(1 - rate) for i in range(k + 1)]
    return sum(exp(t) for t in terms) <= level


def choose(counts: list[dict], epsilon: float = EPSILON, delta: float = DELTA, grid: list[float] = GRID) -> dict[tuple[str, str], float]:
    """Cutoff of each (stratum, rule) from counts: stratum, rule, good, bad (totals), and lists good_over, bad_over by cutoff."""
    strata = {c["stratum"] for c in counts}
    rate, level = epsilon / len(RULES), delta / max(1, len(strata) * len(RULES))
    out = {}
    for c in counts:
        best = None
        for j, cutoff in enumerate(grid):
            if not c["good"] or not certified(c["good_over"][j], c["good"], rate, level):
                break
            gain = c["bad_over"][j] / max(1, c["bad"]) - COST * (c["good_over"][j] / c["good"])
            if c["bad_over"][j] and gain > 0 and (best is None or gain > best[0] + 1e-12):
                best = gain, cutoff
        if best:
            out[c["stratum"], c["rule"]] = best[1]
    return out


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, stratum (lang; '' for null) and each rule's score, of every row."""
    t = F.coalesce(docs["text"].cast("string"), F.lit(""))
    # Words and lines are columns of their own: the rules use them several times.
    docs = docs.select(docs["doc_id"], docs["lang"], docs["text"], F.regexp_extract_all(t, F.lit(WORD), F.lit(0)).alias("__words"), F.split(t, "\n").alias("__lines"))
    made = scores(F.col("text"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("stratum"), *[made[r].alias(r) for r in RULES])


def cutoffs(scored_docs: DataFrame, labels: DataFrame, epsilon: float = EPSILON, delta: float = DELTA) -> dict[tuple[str, str], float]:
    """The chosen cutoffs. Labels that are null or have no document are left out; of several for a doc_id the lowest counts.

    What comes to the driver is a row for each stratum and rule.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    both = scored_docs.join(known, "doc_id")
    long = both.select("stratum", "quality", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("score")) for r in RULES])).alias("x"))
    over = lambda q: [F.sum(F.when((F.col("quality") == q) & (F.col("x.score") > c), 1).otherwise(0)) for c in GRID]
    total = lambda q: F.sum(F.when(F.col("quality") == q, 1).otherwise(0))
    rows = long.groupBy("stratum", F.col("x.rule").alias("rule")).agg(total(1).alias("good"), total(0).alias("bad"), F.array(*over(1)).alias("good_over"), F.array(*over(0)).alias("bad_over")).collect()
    return choose([r.asDict() for r in rows], epsilon, delta)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, stratum, scores, rejected_by (rules, comma-separated; '' if none) and keep, of every row of docs.

    Null and empty texts score 0 and stay; a null lang is the stratum '';
    repeated rows are judged each; an empty table gives no rows, and without
    enough labels nothing is rejected. Other columns are not read.
    """
    made = cut(scored(docs))
    at = cutoffs(made, labels)
    strata = sorted({s for s, _ in at})
    table_ = docs.sparkSession.createDataFrame([(s, *[at.get((s, r)) for r in RULES]) for s in strata], "stratum string, " + ", ".join(f"__{r} double" for r in RULES))
    joined = made.join(F.broadcast(table_) if len(strata) <= BROADCAST_STRATA else table_, "stratum", "left")
    by = F.concat_ws(",", *[F.when(F.col(r) > F.col(f"__{r}"), F.lit(r)) for r in RULES])
    return joined.withColumn("rejected_by", by).withColumn("keep", F.col("rejected_by") == "").select("doc_id", "stratum", *RULES, "rejected_by", "keep")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores and verdict of every document; edge cases are those of ``judge``."""
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_GRID_SQL = ", ".join(f"({j}, {c}::DOUBLE)" for j, c in enumerate(GRID))
SQL = f"""
WITH texts AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t FROM documents),
split AS (SELECT doc_id, stratum, t, greatest(length(t), 1) AS n, regexp_extract_all(t, '[^ \\t\\n\\r\\f]+') AS w, string_split(t, chr(10)) AS l FROM texts),
scored AS (
  SELECT doc_id, stratum,
    (length(t) - length(regexp_replace(t, '[|#$%&*<>{{}}^~=_@]+', '', 'g'))) / n AS symbols,
    (length(t) - length(regexp_replace(t, '\\p{{Lu}}+', '', 'g'))) / n AS shouting,
    (length(t) - length(regexp_replace(t, '[!?]+', '', 'g'))) / n AS emphasis,
    len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) / greatest(len(w), 1) AS repeats,
    1 - len(list_distinct(l)) / len(l) AS dup_lines
  FROM split),
known AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE doc_id IS NOT NULL AND quality IN (0, 1) GROUP BY doc_id),
long AS (
  SELECT stratum, quality, rule, score FROM (
    UNPIVOT (SELECT stratum, quality, symbols, shouting, emphasis, repeats, dup_lines FROM scored JOIN known USING (doc_id))
    ON symbols, shouting, emphasis, repeats, dup_lines INTO NAME rule VALUE score)),
grid(j, cutoff) AS (VALUES {_GRID_SQL}),
counts AS (
  SELECT stratum, rule, j, cutoff,
    count(*) FILTER (quality = 1) AS good, count(*) FILTER (quality = 0) AS bad,
    count(*) FILTER (quality = 1 AND score > cutoff) AS k, count(*) FILTER (quality = 0 AND score > cutoff) AS caught
  FROM long, grid GROUP BY ALL),
tested AS (
  SELECT *, good > 0 AND k <= {EPSILON / len(RULES)} * good AND
    (SELECT sum(exp(lgamma(good + 1) - lgamma(i + 1) - lgamma(good - i + 1) + i * ln({EPSILON / len(RULES)}) + (good - i) * ln({1 - EPSILON / len(RULES)})))
     FROM (SELECT unnest(range(0, least(k, ({EPSILON / len(RULES)} * good)::BIGINT + 1) + 1)) AS i))
    <= {DELTA} / ((SELECT count(DISTINCT stratum) FROM long) * {len(RULES)}) AS ok
  FROM counts),
passing AS (
  SELECT *, caught / greatest(bad, 1) - {COST} * (k / greatest(good, 1)) AS gain
  FROM (SELECT *, bool_and(ok) OVER (PARTITION BY stratum, rule ORDER BY j) AS certified FROM tested)
  WHERE certified AND caught > 0),
chosen AS (
  SELECT stratum, rule, cutoff FROM passing WHERE gain > 0
  QUALIFY row_number() OVER (PARTITION BY stratum, rule ORDER BY round(gain, 11) DESC, j) = 1),
cuts AS (
  SELECT stratum, {", ".join(f"max(cutoff) FILTER (rule = '{r}') AS c_{r}" for r in RULES)} FROM chosen GROUP BY stratum),
judged AS (
  SELECT s.*, concat_ws(',', {", ".join(f"CASE WHEN {r} > c_{r} THEN '{r}' END" for r in RULES)}) AS rejected_by
  FROM scored s LEFT JOIN cuts USING (stratum))
SELECT *, rejected_by = '' AS keep FROM judged
"""
