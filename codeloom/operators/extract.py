"""Functions, calls, imports, nodes and statistics of files, as tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.text import analyse_string, unquoted
from codeloom.sources.facts import explode_part, facts


def nodes(files: DataFrame, kinds: Iterable[str] | None = None, want: Iterable[str] = ("text",)) -> DataFrame:
    """Nodes of the given kinds (all if None); ids count parents first, ``last`` is the greatest id below a node."""
    return explode_part(facts(files, ["nodes"], kinds=kinds, want=want), "nodes")


def functions(files: DataFrame) -> DataFrame:
    return explode_part(facts(files, ["functions"]), "functions")


def calls(files: DataFrame) -> DataFrame:
    return explode_part(facts(files, ["calls"]), "calls")


def calls_within(files: DataFrame) -> DataFrame:
    """(path, func_id, func, ...call) of the calls inside each function's body, nested functions' calls included: an interval join within a file."""
    made = facts(files, ["functions", "calls"])
    pairs = made.select("path", F.explode("functions").alias("f"), "calls").select("path", "f", F.filter("calls", lambda c: (c["id"] > F.col("f")["body_id"]) & (c["id"] <= F.col("f")["body_last"])).alias("inside"))
    return pairs.select("path", F.col("f.id").alias("function_id"), F.col("f.name").alias("function"), F.explode("inside").alias("c")).select("path", "function_id", "function", "c.*")


def imports(files: DataFrame) -> DataFrame:
    """Plain imports first, then from-imports, by ``position``; names as they are matched by rules, aliases as written."""
    made = facts(files, ["imports"])
    return made.select("path", F.posexplode("imports").alias("position", "x")).select("path", "position", "x.*")


def call_targets(files: DataFrame) -> DataFrame:
    """Distinct (path, target)."""
    return calls(files).select("path", F.col("qn").alias("target")).distinct()


def file_stats(files: DataFrame) -> DataFrame:
    """Lines, lines that aren't blank, functions, calls, imports and bytes of each file; nulls for one without a tree."""
    return facts(files, ["stats"]).select("path", "stats.*")


def syntax_errors(files: DataFrame) -> DataFrame:
    """A row for each line that Python refuses (stage ``partial``), or one for a file that has no tree."""
    return explode_part(facts(files, ["errors"]), "errors")


def node_at(files: DataFrame, line: int, column: int) -> DataFrame:
    """The innermost node at a 0-based position of every file; at a border the node that ends there wins, as the earlier sibling."""
    inside = (
        (F.col("sl") <= line) & (F.col("el") >= line) & ((F.col("sl") < line) | (F.col("sc") <= column)) & ((F.col("el") > line) | (F.col("ec") >= column))
    )
    hit = nodes(files).filter(inside)
    # Going down takes the first child that holds the position: the least id at each depth under the branch taken before.
    w = Window.partitionBy("path").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    hit = hit.withColumn("__d", F.max("depth").over(w))
    chain = hit.withColumn("__cut", F.coalesce((F.col("depth") <= F.col("__d")), F.lit(False)))
    first_cut = chain.groupBy("path").agg(F.min(F.when(F.col("__cut"), F.col("id"))).alias("__stop"))
    kept = chain.join(first_cut, "path").filter(F.col("__stop").isNull() | (F.col("id") < F.col("__stop")))
    return kept.withColumn("__n", F.row_number().over(Window.partitionBy("path").orderBy(F.desc("id")))).filter("__n = 1").drop("__n", "__d", "__cut", "__stop")


def snippets(files: DataFrame, spans: DataFrame, context: int = 2) -> DataFrame:
    """spans (path, start_line, end_line; 1-based) with code_snippet: their lines and ``context`` lines around."""
    lines = facts(files, ["lines"])
    start = F.greatest(F.lit(0), F.col("start_line") - 1 - context)
    length = F.least(F.size("lines"), F.col("end_line") + context) - start
    return spans.join(lines, "path").withColumn("code_snippet", F.array_join(F.slice("lines", start + 1, F.greatest(length, F.lit(0))), "\n")).drop("lines")


def string_analysis(files: DataFrame) -> DataFrame:
    """Every string literal with what its content looks like."""
    s = explode_part(facts(files, ["strings"]), "strings")
    return s.withColumn("a", analyse_string(unquoted(F.col("text")))).select("path", "id", "text", "sl", "sc", "a.*")
