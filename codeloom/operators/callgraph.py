"""Call graphs: symbols, call edges, entry points, external and unresolved calls of every file at once.

The parser gives each call with its caller and each file with its name maps;
targets, kinds and confidences are then map lookups and CASE expressions on
the file's own row, so building a graph shuffles nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.catalog import BUILTINS
from codeloom.runtime import apart, keep
from codeloom.sources.facts import explode_part, facts

ENTRY_NAMES = ("execute", "handler", "main", "run", "start")
ENTRY_DECORATORS = ("app.route", "click.command", "task")


@dataclass
class Graph:
    """Tables of all files, keyed by path: symbols, edges, entry_points(path, name), scopes."""

    symbols: DataFrame
    edges: DataFrame
    entry_points: DataFrame
    scopes: DataFrame

    def external_calls(self) -> DataFrame:
        """(path, callee, calls) of callees that are no symbol of their file."""
        names = self.symbols.select("path", F.col("qualified_name").alias("callee"))
        return self.edges.join(apart(names), ["path", "callee"], "left_anti").groupBy("path", "callee").agg(F.count("*").alias("calls"))

    def unresolved(self) -> DataFrame:
        """(path, call_expression, line) of calls that lead nowhere known."""
        lost = (F.col("confidence") < 0.5) | (~F.col("internal") & ~F.col("callee").startswith("<builtin>") & ~F.col("callee").contains("."))
        return self.edges.filter(lost).select("path", "call_expression", "line")


def dotted_target(qn: Column, scope: Column) -> Column:
    """Target of a dotted name: through what its head was imported as, or stands for."""
    head = F.substring_index(qn, ".", 1)
    tail = F.substring(qn, F.length(head) + 1, F.length(qn))
    stands = F.coalesce(F.element_at(scope["aliases"], head), F.when(F.array_contains(scope["names"], head), head))
    return F.coalesce(
        F.concat(F.element_at(scope["imports"], head), tail),
        F.when(F.array_contains(scope["modules"], head), qn),
        F.concat(stands, tail),
        qn,
    )


def call_target(fn: Column, qn: Column, scope: Column) -> Column:
    """Name a call leads to: an alias or symbol of the module, a dotted name, an import, a built-in, or the name as written."""
    return F.coalesce(
        F.element_at(scope["aliases"], fn),
        F.when(F.array_contains(scope["names"], fn), fn),
        F.when(qn.contains("."), dotted_target(qn, scope)),
        F.element_at(scope["imports"], fn),
        F.when(fn.isin(*BUILTINS), F.concat(F.lit("<builtin>."), fn)),
        F.when(qn != "", qn),
        fn,
    )


def call_kind(fn: Column, qn: Column, caller: Column, callee: Column, stands_for: Column) -> Column:
    """recursive, indirect (a dotted call whose last name stands for something else) or direct."""
    return F.when(caller == callee, "recursive").when((qn.contains(".") | (qn != fn)) & stands_for.isNotNull() & (stands_for != fn), "indirect").otherwise("direct")


def call_confidence(internal: Column, callee: Column) -> Column:
    return F.when(internal, 1.0).when(callee.startswith("<builtin>"), 0.9).when(callee.contains("."), 0.7).otherwise(0.3)


def graph(files: DataFrame, strict: bool = False, materialise: bool = True) -> Graph:
    """The graph of every file. materialise: write the parsed facts once, so that its tables don't parse again."""
    made = facts(files, ["symbols", "scope", "calls"], strict=strict)
    if materialise:
        made = keep(made)
    symbols = explode_part(made, "symbols")
    known = F.transform("symbols", lambda s: s["qualified_name"])
    calls = made.select("path", "scope", known.alias("known"), F.explode("calls").alias("c"))
    c = F.col("c")
    resolved = calls.withColumn("callee", call_target(c["fn"], c["qn"], F.col("scope")))
    resolved = resolved.withColumn("internal", F.array_contains("known", F.col("callee")))
    stands = F.coalesce(F.element_at("scope.aliases", c["fn"]), F.when(F.array_contains("scope.names", c["fn"]), c["fn"]))
    edges = resolved.filter("c.caller IS NOT NULL").select(
        "path", c["id"].alias("ord"), c["caller"].alias("caller"), "callee", call_kind(c["fn"], c["qn"], c["caller"], F.col("callee"), stands).alias("call_type"),
        (c["sl"] + 1).alias("line"), (c["sc"] + 1).alias("column"), c["text"].alias("call_expression"), (c["conditional"] if strict else F.lit(False)).alias("is_conditional"),
        call_confidence(F.col("internal"), F.col("callee")).alias("confidence"), "internal",
    )
    called = resolved.filter("internal AND (c.top_level OR c.main_block)").select("path", F.col("callee").alias("name"))
    named = symbols.filter(F.col("name").isin(*ENTRY_NAMES) | F.arrays_overlap("decorators", F.array(*[F.lit(d) for d in ENTRY_DECORATORS]))).select("path", F.col("qualified_name").alias("name"))
    scopes = made.select("path", "scope.total_scopes", F.col("scope.max_level").alias("max_nesting_level"), "scope.functions_per_scope", F.size("scope.imports").alias("imports_discovered"), F.col("scope.modules").alias("module_imports"))
    return Graph(symbols, edges, called.union(named).distinct(), scopes)
