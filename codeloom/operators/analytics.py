"""Graph analytics over edge tables of any size.

Graphs are rows (path, caller, callee), one graph for each path; edges are a
bag, and only those between symbols count. Degrees, roots, leaves, impact and
reachability are joins and aggregates over all graphs together: reachability is
a frontier loop, one join a round for all paths, each round's frontier written
to the shared folder. Enumerations whose result is bounded by a graph of one
file (cycles, paths, components, betweenness) run graph by graph in Arrow
batches.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from codeloom.functions.text import complexity_bucket
from codeloom.operators.callgraph import Graph
from codeloom.runtime import apart, keep, release
from codeloom.sources.facts import column

KEY = ["path"]


def internal(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose ends are both symbols: (path, caller, callee, ord), duplicates kept."""
    names = symbols.select("path", F.col("qualified_name").alias("__n")).distinct()
    e = edges.select("path", "caller", "callee", "ord")
    e = e.join(apart(names.withColumnRenamed("__n", "caller")), ["path", "caller"], "left_semi")
    return e.join(apart(names.withColumnRenamed("__n", "callee")), ["path", "callee"], "left_semi").select("path", "caller", "callee", "ord")


def callers(edges: DataFrame, name: str) -> DataFrame:
    return edges.filter(F.col("callee") == name).select("path", "caller", "line")


def callees(edges: DataFrame, name: str) -> DataFrame:
    return edges.filter(F.col("caller") == name).select("path", "callee", "line")


def call_counts(edges: DataFrame) -> DataFrame:
    """(path, caller, callee, calls)."""
    return edges.groupBy("path", "caller", "callee").agg(F.count("*").alias("calls"))


def roots(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Symbols that nothing calls."""
    return symbols.select("path", F.col("qualified_name").alias("name")).join(apart(edges.select("path", F.col("callee").alias("name"))), ["path", "name"], "left_anti")


def leaves(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Symbols that call nothing."""
    return symbols.select("path", F.col("qualified_name").alias("name")).join(apart(edges.select("path", F.col("caller").alias("name"))), ["path", "name"], "left_anti")


def self_recursive(edges: DataFrame) -> DataFrame:
    """A row for each edge from a function to itself."""
    return edges.filter((F.col("caller") == F.col("callee")) & (F.col("call_type") == "recursive")).select("path", F.col("caller").alias("name"))


def degrees(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(path, name, in_degree, out_degree, total_degree) of every symbol of a graph that has internal edges."""
    e = internal(symbols, edges)
    ends = e.select("path", F.explode(F.array(F.struct(F.col("caller").alias("name"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("callee").alias("name"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("x"))
    counted = ends.groupBy("path", F.col("x.name").alias("name")).agg(F.sum("x.i").alias("in_degree"), F.sum("x.o").alias("out_degree"))
    # Read off the counts, so that the edges are shuffled once.
    names = symbols.select("path", F.col("qualified_name").alias("name")).distinct().join(apart(counted.select("path").distinct()), "path", "left_semi")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("in_degree", "out_degree")]
    return names.join(apart(counted), ["path", "name"], "left").select("path", "name", *zero, (F.coalesce("in_degree", F.lit(0)) + F.coalesce("out_degree", F.lit(0))).cast("long").alias("total_degree"))


def default_entries(symbols: DataFrame, edges: DataFrame, entry_points: DataFrame) -> DataFrame:
    """(path, entry): a graph's entry points, or its roots where it has none."""
    have = entry_points.select("path", F.col("name").alias("entry")).distinct()
    bare = roots(symbols, edges).join(apart(have.select("path").distinct()), "path", "left_anti").select("path", F.col("name").alias("entry"))
    return have.union(bare)


def reach(symbols: DataFrame, edges: DataFrame, entries: DataFrame, max_rounds: int | None = None, strict: bool = False) -> DataFrame:
    """(path, entry, name, dist): what each entry reaches over internal edges, and by how few calls.

    entries: (path, entry); those that are no symbol are skipped. In a graph
    without internal edges nothing is reachable, not even an entry (strict mode:
    the entries are). Every round joins the frontier alone, and what it has seen
    is written once a round, so lineage stays flat; the loop ends with an empty
    frontier. ``max_rounds`` leaves out what is farther away than that.
    """
    e = keep(internal(symbols, edges).select("path", "caller", "callee").distinct())
    names = symbols.select("path", F.col("qualified_name").alias("entry")).distinct()
    start = entries.select("path", "entry").distinct().join(apart(names), ["path", "entry"], "left_semi")
    if not strict:
        start = start.join(apart(e.select("path").distinct()), "path", "left_semi")
    frontier = keep(start.select("path", "entry", F.col("entry").alias("name"), F.lit(0).alias("dist")))
    rounds = [frontier]
    dist = 0
    while max_rounds is None or dist < max_rounds:
        dist += 1
        step = rounds[-1].join(apart(e), (rounds[-1]["path"] == e["path"]) & (rounds[-1]["name"] == e["caller"])).select(rounds[-1]["path"], "entry", F.col("callee").alias("name")).distinct()
        seen = rounds[0]
        for r in rounds[1:]:
            seen = seen.union(r)
        step = keep(step.join(apart(seen), ["path", "entry", "name"], "left_anti").withColumn("dist", F.lit(dist)).select("path", "entry", "name", "dist"))
        if step.isEmpty():
            release(step)
            break
        rounds.append(step)
        if len(rounds) > 8:
            merged = rounds[0]
            for r in rounds[1:-1]:
                merged = merged.union(r)
            merged = keep(merged)
            release(*rounds[:-1])
            rounds = [merged, rounds[-1]]
    out = rounds[0]
    for r in rounds[1:]:
        out = out.union(r)
    return out


def reachable(reached: DataFrame) -> DataFrame:
    """(path, name, dist): reached from any entry, by the shortest way."""
    return reached.groupBy("path", "name").agg(F.min("dist").alias("dist"))


def reach_tree(symbols: DataFrame, edges: DataFrame, reached: DataFrame) -> DataFrame:
    """(path, entry, caller, callee): the distinct internal edges that an entry's chains go along."""
    e = internal(symbols, edges).select("path", "caller", "callee").distinct()
    return reached.select("path", "entry", F.col("name").alias("caller")).join(apart(e), ["path", "caller"]).select("path", "entry", "caller", "callee")


def unreachable_share(symbols: DataFrame, reached: DataFrame) -> DataFrame:
    """(path, reachable, unreachable) counts of every graph."""
    r = reachable(reached).select("path", F.col("name").alias("qualified_name"), F.lit(1).alias("hit"))
    s = symbols.select("path", "qualified_name").distinct().join(apart(r), ["path", "qualified_name"], "left")
    return s.groupBy("path").agg(F.count("hit").alias("reachable"), F.count_if(F.col("hit").isNull()).alias("unreachable"))


def dead_code(symbols: DataFrame, reached: DataFrame) -> DataFrame:
    """Symbols that no entry reaches."""
    return symbols.select("path", F.col("qualified_name").alias("name")).join(apart(reached.select("path", "name")), ["path", "name"], "left_anti")


def impact(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """What a change of each symbol touches: callers, dependencies, callers that call nothing else, a score, and whether it is critical."""
    e = keep(internal(symbols, edges).groupBy("path", "caller", "callee").agg(F.count("*").alias("calls")))
    only = e.groupBy("path", "caller").agg(F.sum("calls").alias("__n")).filter("__n = 1").select("path", "caller", F.lit(True).alias("only"))
    up = e.select("path", "caller", F.col("callee").alias("name")).join(apart(only), ["path", "caller"], "left")
    up = up.groupBy("path", "name").agg(F.array_sort(F.collect_list("caller")).alias("direct_callers"), F.array_sort(F.collect_list(F.when(F.col("only"), F.col("caller")))).alias("potential_dead_code"))
    down = e.groupBy("path", F.col("caller").alias("name")).agg(F.array_sort(F.collect_set("callee")).alias("dependencies"))
    none = F.array().cast("array<string>")
    out = symbols.select("path", F.col("qualified_name").alias("name")).distinct().join(apart(up), ["path", "name"], "left").join(apart(down), ["path", "name"], "left")
    out = out.select("path", "name", *[F.coalesce(c, none).alias(c) for c in ("direct_callers", "dependencies", "potential_dead_code")])
    callers_, dead = F.size("direct_callers"), F.size("potential_dead_code")
    return out.withColumn("impact_score", callers_ + dead).withColumn("is_critical", (callers_ > 3) | (dead > 0))


# -- one graph at a time --


class Adjacency:
    """A graph's symbols in order, and its internal edges in order with their multiplicity."""

    def __init__(self, names: list[str], pairs: list[tuple[str, str]]) -> None:
        self.names = list(dict.fromkeys(names))
        known = set(self.names)
        self.next: dict[str, list[str]] = {}
        for a, b in pairs:
            if a in known and b in known:
                self.next.setdefault(a, []).append(b)

    def shortest(self, a: str, b: str) -> list[str] | None:
        """The first of the shortest paths; None without one, or if a calls nothing."""
        if a not in self.next:
            return None
        came: dict[str, str | None] = {a: None}
        queue = deque([a])
        while queue:
            x = queue.popleft()
            if x == b:
                path = []
                at: str | None = x
                while at is not None:
                    path.append(at)
                    at = came[at]
                return path[::-1]
            for y in self.next.get(x, ()):
                if y not in came:
                    came[y] = x
                    queue.append(y)
        return None

    def paths(self, a: str, b: str, limit: int = 10, longest: int = 10) -> list[list[str]]:
        """Simple paths in edge order, at most ``limit``; a path of more than ``longest`` nodes is not followed further."""
        if not self.next:
            return []
        out: list[list[str]] = []
        stack = [[a]]
        while stack and len(out) < limit:
            p = stack.pop()
            if p[-1] == b:
                out.append(p)
            elif len(p) <= longest:
                stack.extend([*p, y] for y in reversed(self.next.get(p[-1], ())) if y not in p)
        return out

    def chains(self, a: str, limit: int) -> tuple[list[list[str]], bool]:
        """The first ``limit`` simple call chains from a, shorter first, and whether there are more: their number can be exponential."""
        out: list[list[str]] = []
        queue = deque([[a]] if self.next else [])
        while queue and len(out) < limit:
            p = queue.popleft()
            out.append(p)
            # What would come after the limit is not even queued.
            queue.extend(islice(([*p, y] for y in dict.fromkeys(self.next.get(p[-1], ())) if y not in p), limit + 1 - len(out) - len(queue)))
        return out, bool(queue)

    def cycles(self) -> list[list[str]]:
        """A cycle for each edge that leads back into the path a depth-first walk stands on; loops of one function are left out."""
        out: list[list[str]] = []
        visited: set[str] = set()
        for start in self.names:
            if start in visited:
                continue
            path, on = [start], {start}
            visited.add(start)
            stack = [iter(self.next.get(start, ()))]
            while stack:
                for y in stack[-1]:
                    if y not in visited:
                        visited.add(y)
                        path.append(y)
                        on.add(y)
                        stack.append(iter(self.next.get(y, ())))
                        break
                    if y in on:
                        cycle = [*path[path.index(y) :], y]
                        if len(cycle) > 2:
                            out.append(cycle)
                else:
                    stack.pop()
                    on.discard(path.pop())
        return out

    def betweenness(self, sample: int = 10) -> dict[str, float]:
        """Of each symbol, how many of the shortest paths among the first ``sample`` symbols lead through it, over sample squared."""
        first = self.names[:sample]
        hits = dict.fromkeys(self.names, 0)
        for a in first:
            for b in first:
                if a != b:
                    for x in (self.shortest(a, b) or [])[1:-1]:
                        hits[x] += 1
        return {n: h / max(1, len(first) ** 2) for n, h in hits.items()}

    def components(self, strict: bool) -> list[list[str]]:
        """Groups that call each other. Compatible mode gives what a depth-first walk meets first; strict mode strongly connected components."""
        if strict:
            groups = self._strong()
        else:
            groups, visited = [], set()
            for s in self.names:
                if s in visited:
                    continue
                group, stack = [], [s]
                while stack:
                    x = stack.pop()
                    if x in visited:
                        continue
                    visited.add(x)
                    group.append(x)
                    stack.extend(reversed(self.next.get(x, ())))
                groups.append(group)
        return [g for g in groups if len(g) > 1 or any(x in self.next.get(x, ()) for x in g)]

    def _strong(self) -> list[list[str]]:
        index: dict[str, int] = {}
        low: dict[str, int] = {}
        on: set[str] = set()
        held: list[str] = []
        out = []
        for root in self.names:
            if root in index:
                continue
            work = [(root, iter(self.next.get(root, ())))]
            index[root] = low[root] = len(index)
            held.append(root)
            on.add(root)
            while work:
                x, rest = work[-1]
                for y in rest:
                    if y not in index:
                        index[y] = low[y] = len(index)
                        held.append(y)
                        on.add(y)
                        work.append((y, iter(self.next.get(y, ()))))
                        break
                    if y in on:
                        low[x] = min(low[x], index[y])
                else:
                    work.pop()
                    if work:
                        low[work[-1][0]] = min(low[work[-1][0]], low[x])
                    if low[x] == index[x]:
                        group = []
                        while True:
                            y = held.pop()
                            on.discard(y)
                            group.append(y)
                            if y == x:
                                break
                        out.append(sorted(group))
        return out


#: A worker remembers what it found in graphs of so many names, calls and rows in all, and hands on so many rows at a time.
REMEMBERED, ROWS = 1 << 16, 4096


def each_graph(batches: Iterable[pa.RecordBatch], run: Callable[[Adjacency], list[tuple]], arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    """run's rows, with path in front, for batches of (path, names, callers, callees); it runs once for graphs that are alike and come near each other."""
    memo: dict[tuple, list[tuple]] = {}
    size = 0
    paths: list[str | None] = []
    rows: list[tuple] = []

    def ready() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([column(list(c), f.type) for c, f in zip((paths, *zip(*rows, strict=True)), arrow, strict=True)], schema=arrow)
        paths.clear()
        rows.clear()
        return out

    for batch in batches:
        for lo in range(0, batch.num_rows, 64):
            for path, *graph in zip(*(c.slice(lo, 64).to_pylist() for c in batch.columns), strict=True):
                key = tuple(tuple(x or ()) for x in graph)
                found = memo.get(key)
                if found is None:
                    found = run(Adjacency(graph[0], list(zip(key[1], key[2], strict=True))))
                    weight = sum(map(len, key)) + len(found)
                    if size + weight > REMEMBERED:
                        memo, size = {}, 0
                    memo[key] = found
                    size += weight
                paths += [path] * len(found)
                rows += found
                if len(rows) >= ROWS:
                    yield ready()
    if rows:
        yield ready()


def per_graph(symbols: DataFrame, edges: DataFrame, run: Callable[[Adjacency], list[tuple]], schema: str) -> DataFrame:
    """run over each path's Adjacency; its rows with path in front. One shuffle; a task holds one graph at a time."""
    s = symbols.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("ord", "qualified_name"))).alias("s"))
    e = edges.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("ord", "caller", "callee"))).alias("e"))
    both = s.join(apart(e), "path", "left").select("path", F.col("s.qualified_name").alias("names"), F.col("e.caller").alias("a"), F.col("e.callee").alias("b"))
    kind = T.StructType.fromDDL(f"path string, {schema}")
    arrow = to_arrow_schema(kind)
    return both.mapInArrow(lambda batches: each_graph(batches, run, arrow), kind)


def cycles(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    return per_graph(symbols, edges, lambda g: [(i, c) for i, c in enumerate(g.cycles())], "number int, cycle array<string>")


def components(symbols: DataFrame, edges: DataFrame, strict: bool = False) -> DataFrame:
    return per_graph(symbols, edges, lambda g: [(i, c) for i, c in enumerate(g.components(strict))], "number int, members array<string>")


def betweenness(symbols: DataFrame, edges: DataFrame, sample: int = 10) -> DataFrame:
    return per_graph(symbols, edges, lambda g: list(g.betweenness(sample).items()) if g.next else [], "name string, betweenness double")


def shortest_path(symbols: DataFrame, edges: DataFrame, a: str, b: str) -> DataFrame:
    """(path, nodes) of each graph that has one."""
    return per_graph(symbols, edges, lambda g: [(p,)] if (p := g.shortest(a, b)) else [], "nodes array<string>")


def all_paths(symbols: DataFrame, edges: DataFrame, a: str, b: str, limit: int = 10) -> DataFrame:
    return per_graph(symbols, edges, lambda g: [(i, p) for i, p in enumerate(g.paths(a, b, limit))], "number int, nodes array<string>")


def call_chains(symbols: DataFrame, edges: DataFrame, entries: list[str], limit: int) -> DataFrame:
    """Simple chains from the entries, the first ``limit`` of each; ``more`` tells whether others follow.

    Walks that revisit functions are never listed, yet a graph of n functions
    can have about e * (n - 1)! simple chains; ``reach_tree`` holds the edges of
    all of them in a table no larger than the graph.
    """

    def run(g: Adjacency) -> list[tuple]:
        out = []
        for x in entries:
            if x in g.names:
                chains, more = g.chains(x, limit)
                out += [(x, i, c, more) for i, c in enumerate(chains)]
        return out

    return per_graph(symbols, edges, run, "entry string, number int, chain array<string>, more boolean")


def centrality(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    return degrees(symbols, edges).join(apart(betweenness(symbols, edges)), ["path", "name"])


def critical(symbols: DataFrame, edges: DataFrame, k: int = 5) -> DataFrame:
    """The k symbols of each graph with the most calls and betweenness; ties in symbol order."""
    order = symbols.groupBy("path", F.col("qualified_name").alias("name")).agg(F.min("ord").alias("ord"))
    scored = centrality(symbols, edges).join(apart(order), ["path", "name"])
    w = Window.partitionBy("path").orderBy(F.desc(F.col("total_degree") + F.col("betweenness")), "ord")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).drop("ord")


def statistics(g: Graph, reached: DataFrame) -> DataFrame:
    """A row of totals for each graph, and the histogram of complexity."""
    s = g.symbols.groupBy("path").agg(F.count("*").alias("total_functions"), F.avg("complexity").alias("avg_complexity"), F.max("complexity").alias("max_complexity"), F.array_sort(F.collect_list(F.when(F.col("complexity") > 10, F.col("qualified_name")))).alias("high_complexity"), *[F.count_if(F.col("node_type") == t).alias(f"{t}s") for t in ("function", "method")])
    buckets = g.symbols.groupBy("path", complexity_bucket(F.col("complexity")).alias("b")).agg(F.count("*").alias("n")).groupBy("path").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("b", "n")))).alias("complexity_distribution"))
    lost = (F.col("confidence") < 0.5) | (~F.col("internal") & ~F.col("callee").startswith("<builtin>") & ~F.col("callee").contains("."))
    e = g.edges.groupBy("path").agg(F.count("*").alias("total_calls"), F.count_if(~F.col("internal")).alias("external_calls"), F.count_if(lost).alias("unresolved_calls"), F.count_if((F.col("caller") == F.col("callee")) & (F.col("call_type") == "recursive")).alias("recursive_functions"), *[F.count_if(F.col("call_type") == t).alias(f"{t}_calls") for t in ("direct", "indirect", "recursive")])
    count = lambda df, name: df.groupBy("path").agg(F.count("*").alias(name))
    r = reachable(reached).groupBy("path").agg(F.count("*").alias("reachable_functions"), F.max("dist").alias("max_call_depth"))
    out = s.join(apart(buckets), "path", "left").join(apart(e), "path", "left").join(apart(count(g.entry_points, "entry_points")), "path", "left")
    out = out.join(apart(count(leaves(g.symbols, g.edges), "leaf_functions")), "path", "left").join(apart(count(roots(g.symbols, g.edges), "root_functions")), "path", "left").join(apart(r), "path", "left")
    out = out.na.fill(0, ["total_calls", "external_calls", "unresolved_calls", "recursive_functions", "direct_calls", "indirect_calls", "recursive_calls", "entry_points", "leaf_functions", "root_functions", "reachable_functions", "max_call_depth"])
    return out.withColumn("unreachable_functions", F.col("total_functions") - F.col("reachable_functions")).withColumn("avg_calls_per_function", F.round(F.col("total_calls") / F.greatest("total_functions", F.lit(1)), 2))
