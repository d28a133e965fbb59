"""Registered queries over whole tables, each with SQL that computes its answer from the tables alone.

The SQL never sees the engine: it derives from ``events`` what the made source
files must contain (see ``sources.corpus``), so a wrong parse, match, join or
fold shows as a difference.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import text as X
from codeloom.functions.catalog import SEVERITIES
from codeloom.operators import analytics, callgraph, extract, scan, taint
from codeloom.plans import exports, reports
from codeloom.plans.registry import QUERIES, SQL, query
from codeloom.runtime import table
from codeloom.sources import corpus
from codeloom.sources.facts import explode_part, facts
from codeloom.sources.rules import load_dir

# What each statement of the made files is, by the kind of event.
_LINES = f"""lines AS (
  SELECT user_id, user_id::VARCHAR AS path, event_type, row_number() OVER w + {corpus.HEADER_LINES} AS line, row_number() OVER w AS rn
  FROM events WHERE user_id IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""
_RULED = """ruled AS (
  SELECT *, CASE event_type WHEN 'purchase' THEN 'PY.OS.SYSTEM' WHEN 'signup' THEN 'PY.HASH.WEAK' WHEN 'view' THEN 'PY.SUBPROCESS.SHELL' END AS rule_id,
    CASE event_type WHEN 'signup' THEN 'medium' ELSE 'high' END AS severity,
    CASE event_type WHEN 'purchase' THEN 'os.system(x)' WHEN 'signup' THEN 'hashlib.md5(b)' WHEN 'view' THEN 'subprocess.run(c, shell=True)' END AS code
  FROM lines WHERE event_type IN ('purchase', 'signup', 'view'))"""


def _findings(spark: SparkSession, sf_dir: str, **how: object) -> DataFrame:
    return scan.scan(corpus.event_files(spark, sf_dir), load_dir().rules, **how)


@query(f"WITH {_LINES}, {_RULED} SELECT rule_id, severity, count(*) AS count FROM ruled GROUP BY ALL")
def findings_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: parse, match all rules, group by rule."""
    return reports.by_rule(_findings(spark, sf_dir)).select("rule_id", "severity", "count")


_BY_SEVERITY = ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in SEVERITIES)


@query(f"WITH {_LINES}, {_RULED} SELECT path, {_BY_SEVERITY} FROM ruled GROUP BY path")
def findings_by_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.by_severity(_findings(spark, sf_dir))


@query(f"WITH {_LINES}, {_RULED} SELECT path, bool_or(severity = 'high') AS found FROM ruled GROUP BY path")
def has_high_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.has_findings(_findings(spark, sf_dir), "high")


_HEADER_SQL = "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in corpus.HEADER.split("\n")[:-1]) + "]"


@query(f"""WITH {_LINES}, {_RULED},
whole AS (SELECT path, list_concat({_HEADER_SQL}, list('    ' || CASE event_type WHEN 'error' THEN 'x = input()' WHEN 'purchase' THEN 'os.system(x)' WHEN 'signup' THEN 'hashlib.md5(b)'
  WHEN 'view' THEN 'subprocess.run(c, shell=True)' WHEN 'click' THEN 'y = 1' ELSE 'pass' END ORDER BY rn)) AS every FROM lines GROUP BY path)
SELECT path, rule_id, line AS start_line, 5 AS start_column, line AS end_line, 5 + length(code) AS end_column, code AS node_text, array_to_string(every[line - 2 : line + 2], chr(10)) AS code_snippet
FROM ruled JOIN whole USING (path)""")
def finding_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _findings(spark, sf_dir).select("path", "rule_id", *[F.col(c).cast("long").alias(c) for c in ("start_line", "start_column", "end_line", "end_column")], "node_text", "code_snippet")


@query(f"WITH {_LINES}, {_RULED} SELECT path, count(*) AS count FROM ruled WHERE severity = 'high' GROUP BY path")
def rule_filter_min_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _findings(spark, sf_dir, min_severity="high").groupBy("path").agg(F.count("*").alias("count"))


@query(f"WITH {_LINES}, {_RULED} SELECT path, rule_id, count(*) AS count FROM ruled WHERE rule_id <> 'PY.HASH.WEAK' GROUP BY ALL")
def exclude_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _findings(spark, sf_dir, exclude=["PY.HASH.WEAK"]).groupBy("path", "rule_id").agg(F.count("*").alias("count"))


@query(f"WITH {_LINES}, {_RULED} SELECT path, rule_id, count(*) AS count FROM ruled WHERE rule_id IN ('PY.HASH.WEAK', 'PY.OS.SYSTEM') GROUP BY ALL")
def rule_filter_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _findings(spark, sf_dir, ids=["PY.OS.SYSTEM", "PY.HASH.WEAK"]).groupBy("path", "rule_id").agg(F.count("*").alias("count"))


@query(f"""WITH {_LINES}, {_RULED}, files AS (SELECT DISTINCT path FROM lines), per AS (SELECT path, count(rule_id) AS n, {_BY_SEVERITY} FROM files LEFT JOIN ruled USING (path) GROUP BY path)
SELECT count(*) AS files_scanned, 0::BIGINT AS unscanned_files, sum(n)::BIGINT AS total_findings, {", ".join(f"sum({s})::BIGINT AS {s}" for s in SEVERITIES)}, count(*) FILTER (n > 0) AS files_with_findings,
count(*) FILTER (n = 0) AS clean_files, sum(high) > 0 AS has_high_severity, (9 * count(*))::BIGINT AS rules_applied FROM per""")
def report_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = corpus.event_files(spark, sf_dir)
    rules = load_dir().rules
    return reports.totals(scan.scan_totals(files, rules))


_TARGETS = "CASE event_type WHEN 'error' THEN 'input' WHEN 'purchase' THEN 'os.system' WHEN 'signup' THEN 'hashlib.md5' WHEN 'view' THEN 'subprocess.run' END"


@query(f"WITH {_LINES} SELECT DISTINCT path, {_TARGETS} AS target FROM lines WHERE {_TARGETS} IS NOT NULL")
def call_targets_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.call_targets(corpus.event_files(spark, sf_dir))


@query(f"""WITH {_LINES} SELECT path, count(*) + {corpus.HEADER_LINES} AS total_lines, count(*) + {corpus.HEADER_LINES - 1} AS non_empty_lines, 1::BIGINT AS functions,
count(*) FILTER ({_TARGETS} IS NOT NULL) AS calls, 5::BIGINT AS imports FROM lines GROUP BY path""")
def file_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = extract.file_stats(corpus.event_files(spark, sf_dir))
    return s.select("path", *[F.col(c).cast("long").alias(c) for c in ("total_lines", "non_empty_lines", "functions", "calls", "imports")])


@query(f"WITH {_LINES} SELECT path, 'handle' AS function, {_TARGETS} AS qn, count(*) AS calls FROM lines WHERE {_TARGETS} IS NOT NULL GROUP BY ALL")
def calls_within_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.calls_within(corpus.event_files(spark, sf_dir)).groupBy("path", "function", "qn").agg(F.count("*").alias("calls"))


@query(f"""WITH {_LINES}, kinds AS (SELECT DISTINCT path FROM lines)
SELECT path, position, kind, module, names FROM kinds, (VALUES (0, 'import', 'os', 'os'), (1, 'import', 'hashlib', 'hashlib'), (2, 'import', 'shlex', 'shlex'), (3, 'import', 'subprocess', 'subprocess'), (4, 'from', 'html', 'html,escape')) v(position, kind, module, names)""")
def import_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.imports(corpus.event_files(spark, sf_dir)).select("path", "position", "kind", "module", F.array_join("names", ",").alias("names"))


@query(f"""WITH {_LINES} SELECT path, count(*) FILTER (event_type = 'error') AS sources_found, count(*) FILTER (event_type = 'error') AS sinks_found, 0::BIGINT AS sanitizers_found FROM lines GROUP BY path""")
def taint_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taint.count_matches(corpus.event_files(spark, sf_dir))


@query(f"""WITH {_LINES} SELECT path, count(*) FILTER (event_type = 'error') AS sources_found, count(*) FILTER (event_type IN ('purchase', 'view')) AS sinks_found, 0::BIGINT AS sanitizers_found FROM lines GROUP BY path""")
def taint_counters_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taint.count_matches(corpus.event_files(spark, sf_dir), strict=True, heuristics=False)


_SEEN = "max(CASE WHEN event_type = 'error' THEN line END) OVER (PARTITION BY user_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS source_line"


@query(f"""WITH {_LINES}, seen AS (SELECT *, {_SEEN} FROM lines)
SELECT path, 'x' AS source, source_line, 'system' AS sink, 'command_exec' AS sink_type, line AS sink_line, false AS is_sanitized, 'user' AS labels, 'high' AS severity FROM seen WHERE event_type = 'purchase' AND source_line IS NOT NULL""")
def taint_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(taint.analyse(corpus.event_files(spark, sf_dir), counted=False))


def _paths(analysed: DataFrame) -> DataFrame:
    p = taint.taint_paths(analysed)
    return p.select("path", "source", F.col("source_line").cast("long").alias("source_line"), "sink", "sink_type", F.col("sink_line").cast("long").alias("sink_line"), "is_sanitized", F.array_join("labels", ",").alias("labels"), "severity")


@query(f"""WITH {_LINES}, seen AS (SELECT *, {_SEEN} FROM lines),
clean AS (SELECT *, coalesce(bool_or(event_type = 'signup' AND source_line IS NOT NULL) OVER (PARTITION BY user_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS is_sanitized FROM seen)
SELECT path, 'x' AS source, source_line, 'system' AS sink, 'command_exec' AS sink_type, line AS sink_line, is_sanitized, 'user' AS labels, 'high' AS severity FROM clean WHERE event_type = 'purchase' AND source_line IS NOT NULL""")
def taint_sanitized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(taint.analyse(corpus.event_files(spark, sf_dir, corpus.CLEANING), counted=False))


@query(f"""WITH {_LINES}, seen AS (SELECT *, {_SEEN} FROM lines), per AS (SELECT path, count(*) FILTER (event_type = 'error') AS e, count(*) FILTER (event_type = 'purchase' AND source_line IS NOT NULL) AS p FROM seen GROUP BY path)
SELECT path, e AS sources_found, e AS sinks_found, 0::BIGINT AS sanitizers_found, p AS paths, p AS vulnerable, 0::BIGINT AS sanitized FROM per""")
def taint_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taint.file_summary(taint.analyse(corpus.event_files(spark, sf_dir)))


@query(f"""WITH {_LINES}, seen AS (SELECT *, {_SEEN} FROM lines)
SELECT path, 'User input function' AS from_var, 'x' AS to_var, 'source' AS operation, true AS preserves_taint, line FROM lines WHERE event_type = 'error'
UNION ALL SELECT path, 'x', 'z', unnest(['sanitize', 'assignment']), unnest([false, true]), line FROM seen WHERE event_type = 'signup' AND source_line IS NOT NULL""")
def taint_flow_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = taint.flow_edges(taint.analyse(corpus.event_files(spark, sf_dir, corpus.CLEANING), counted=False))
    return f.select("path", "from_var", "to_var", "operation", "preserves_taint", F.col("line").cast("long").alias("line"))


@query(f"""WITH {_LINES}, seen AS (SELECT *, {_SEEN} FROM lines) SELECT path, 'high' AS severity, count(*) AS paths FROM seen WHERE event_type = 'purchase' AND source_line IS NOT NULL GROUP BY path""")
def taint_by_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taint.by_severity(taint.taint_paths(taint.analyse(corpus.event_files(spark, sf_dir), counted=False)))


@query(f"""WITH {_LINES}, seen AS (SELECT *, {_SEEN} FROM lines) SELECT path, 'command_exec' AS sink_type, count(*) AS paths FROM seen WHERE event_type = 'purchase' AND source_line IS NOT NULL GROUP BY path""")
def taint_by_sink_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taint.by_sink_type(taint.taint_paths(taint.analyse(corpus.event_files(spark, sf_dir), counted=False)))


@query(f"""WITH {_LINES}, kinds AS (SELECT DISTINCT path FROM lines) SELECT path, module, categories FROM kinds, (VALUES ('os', 'command_execution'), ('subprocess', 'command_execution')) v(module, categories)""")
def dangerous_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taint.dangerous_imports(corpus.event_files(spark, sf_dir)).select("path", "module", F.array_join("categories", ",").alias("categories"))


# -- call graphs of sessions --
_CALLS = """moves AS (SELECT user_id::VARCHAR AS path, event_type AS caller, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS callee FROM events WHERE user_id IS NOT NULL),
symbols AS (SELECT DISTINCT path, caller AS name FROM moves), edges AS (SELECT DISTINCT path, caller, callee FROM moves WHERE callee IS NOT NULL)"""


def _graph(spark: SparkSession, sf_dir: str) -> callgraph.Graph:
    return callgraph.graph(corpus.session_files(spark, sf_dir))


@query(f"WITH {_CALLS} SELECT path, caller, callee, CASE WHEN caller = callee THEN 'recursive' ELSE 'direct' END AS call_type, 1.0::DOUBLE AS confidence, false AS is_conditional FROM edges")
def call_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir).edges.select("path", "caller", "callee", "call_type", "confidence", "is_conditional")


@query(f"WITH {_CALLS} SELECT path, name, 'function' AS node_type, 1 AS complexity FROM symbols")
def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir).symbols.select("path", "name", "node_type", "complexity")


@query(f"WITH {_CALLS} SELECT path, caller AS name FROM edges WHERE caller = callee")
def self_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.self_recursive(_graph(spark, sf_dir).edges)


@query(f"""WITH {_CALLS}, i AS (SELECT path, callee AS name, count(*) AS n FROM edges GROUP BY ALL), o AS (SELECT path, caller AS name, count(*) AS n FROM edges GROUP BY ALL)
SELECT path, name, coalesce(i.n, 0) AS in_degree, coalesce(o.n, 0) AS out_degree, coalesce(i.n, 0) + coalesce(o.n, 0) AS total_degree FROM symbols LEFT JOIN i USING (path, name) LEFT JOIN o USING (path, name)
WHERE path IN (SELECT path FROM edges)""")
def degree_centrality(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _graph(spark, sf_dir)
    return analytics.degrees(g.symbols, g.edges)


@query(f"""WITH {_CALLS}, counted AS (SELECT path, count(*) AS total_functions FROM symbols GROUP BY path), e AS (SELECT path, count(*) AS total_calls, count(*) FILTER (caller = callee) AS recursive_functions FROM edges GROUP BY path),
l AS (SELECT path, count(*) AS leaf_functions FROM symbols s WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.path = s.path AND e.caller = s.name) GROUP BY path),
r AS (SELECT path, count(*) AS root_functions FROM symbols s WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.path = s.path AND e.callee = s.name) GROUP BY path)
SELECT path, total_functions, coalesce(total_calls, 0) AS total_calls, coalesce(recursive_functions, 0) AS recursive_functions, coalesce(leaf_functions, 0) AS leaf_functions, coalesce(root_functions, 0) AS root_functions,
0::BIGINT AS external_calls, 0::BIGINT AS unresolved_calls, 0::BIGINT AS entry_points, round(coalesce(total_calls, 0) / total_functions, 2) AS avg_calls_per_function, total_functions AS low_complexity
FROM counted LEFT JOIN e USING (path) LEFT JOIN l USING (path) LEFT JOIN r USING (path)""")
def graph_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _graph(spark, sf_dir)
    reached = analytics.reach(g.symbols, g.edges, analytics.default_entries(g.symbols, g.edges, g.entry_points))
    s = analytics.statistics(g, reached)
    return s.select("path", "total_functions", "total_calls", "recursive_functions", "leaf_functions", "root_functions", "external_calls", "unresolved_calls", "entry_points", "avg_calls_per_function", F.element_at("complexity_distribution", "0-5").alias("low_complexity"))


@query(f"""WITH RECURSIVE {_CALLS}, r AS (SELECT DISTINCT path, 'view' AS name FROM edges WHERE (path, 'view') IN (SELECT (path, name) FROM symbols) UNION SELECT e.path, e.callee FROM r JOIN edges e ON e.path = r.path AND e.caller = r.name)
SELECT path, name FROM r""")
def session_reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _graph(spark, sf_dir)
    entries = g.scopes.select("path", F.lit("view").alias("entry"))
    return analytics.reach(g.symbols, g.edges, entries).select("path", "name")


@query(f"""WITH {_LINES}, n AS (SELECT path, event_type, count(*) AS calls FROM lines GROUP BY ALL)
SELECT path, CASE event_type WHEN 'error' THEN '<builtin>.input' WHEN 'purchase' THEN 'os.os.system' WHEN 'signup' THEN 'hashlib.hashlib.md5' WHEN 'view' THEN 'subprocess.subprocess.run' END AS callee, calls,
CASE event_type WHEN 'error' THEN 0.9 ELSE 0.7 END::DOUBLE AS confidence FROM n WHERE event_type IN ('error', 'purchase', 'signup', 'view')""")
def external_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = callgraph.graph(corpus.event_files(spark, sf_dir))
    sure = g.edges.groupBy("path", "callee").agg(F.max("confidence").alias("confidence"))
    return g.external_calls().join(sure, ["path", "callee"])


@query()
def session_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _graph(spark, sf_dir)
    return analytics.cycles(g.symbols, g.edges)


@query(f"""WITH RECURSIVE {_CALLS}, r AS (SELECT path, caller AS a, callee AS b FROM edges UNION SELECT r.path, r.a, e.callee FROM r JOIN edges e ON e.path = r.path AND e.caller = r.b),
both_ways AS (SELECT x.path, x.a, x.b FROM r x JOIN r y ON y.path = x.path AND y.a = x.b AND y.b = x.a)
SELECT DISTINCT path, string_agg(b, ',' ORDER BY b) OVER (PARTITION BY path, a ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS members FROM both_ways""")
def session_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of functions that reach each other: those on a common cycle, or on one of their own."""
    g = _graph(spark, sf_dir)
    return analytics.components(g.symbols, g.edges, strict=True).select("path", F.array_join("members", ",").alias("members"))


@query()
def critical_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _graph(spark, sf_dir)
    return analytics.critical(g.symbols, g.edges)


@query(f"""WITH {_CALLS}, n AS (SELECT path, count(*) AS nodes FROM symbols GROUP BY path), e AS (SELECT path, count(*) AS edges FROM edges GROUP BY path)
SELECT path, f.format, nodes, coalesce(edges, 0)::BIGINT AS edges FROM n LEFT JOIN e USING (path), (VALUES ('json'), ('graphml'), ('cytoscape'), ('dot')) f(format)""")
def graph_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every session's graph as DOT, JSON, GraphML and Cytoscape, and how many nodes and edges each document has."""
    g = _graph(spark, sf_dir)
    reached = analytics.reach(g.symbols, g.edges, analytics.default_entries(g.symbols, g.edges, g.entry_points))
    d = F.col("document")
    count = lambda pattern: F.regexp_count(d, F.lit(pattern)).cast("long")
    at = lambda p: F.get_json_object(d, p).cast("long")
    out = None
    for name, make, nodes, edges in (
        ("dot", exports.dot, count(r'(?m)^    "[^"]+" \['), count(" -> ")),
        ("json", exports.graph_json, at("$.statistics.total_nodes"), at("$.statistics.total_edges")),
        ("graphml", exports.graphml, count("<node "), count("<edge ")),
        ("cytoscape", exports.cytoscape, count('"group":"nodes"'), count('"group":"edges"')),
    ):
        one = make(g, reached).select("path", F.lit(name).alias("format"), nodes.alias("nodes"), edges.alias("edges"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""WITH {_LINES}, {_RULED}, f AS (SELECT DISTINCT path FROM lines), r AS (SELECT path, count(*) AS n, min(line) AS first FROM ruled GROUP BY path)
SELECT path, coalesce(n, 0)::BIGINT AS finding_count, coalesce(n, 0)::BIGINT AS listed, coalesce(first, 0)::BIGINT AS first_line, 9::BIGINT AS rules_applied FROM f LEFT JOIN r USING (path)""")
def scan_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file's findings as a JSON object, read back: how many it says and lists, and where the first is."""
    files = corpus.event_files(spark, sf_dir)
    rules = load_dir().rules
    findings = scan.scan(files, rules)
    d = reports.file_documents(scan.file_results(files, findings, rules), findings)
    read = d.select(F.from_json("document", "file string, finding_count long, rules_applied long, findings array<struct<location:struct<line:long>>>").alias("d"))
    number = lambda c, name: F.coalesce(c.cast("long"), F.lit(0).cast("long")).alias(name)
    return read.select(F.col("d.file").alias("path"), number(F.col("d.finding_count"), "finding_count"), number(F.size("d.findings"), "listed"), number(F.try_element_at("d.findings", F.lit(1))["location"]["line"], "first_line"), number(F.col("d.rules_applied"), "rules_applied"))


@query(f"""WITH {_LINES}, seen AS (SELECT *, {_SEEN} FROM lines), per AS (SELECT path, count(*) FILTER (event_type = 'error') AS e, count(*) FILTER (event_type = 'purchase' AND source_line IS NOT NULL) AS p, min(line) FILTER (event_type = 'purchase' AND source_line IS NOT NULL) AS first FROM seen GROUP BY path)
SELECT path, e AS sources_found, p AS total_paths, p AS listed, coalesce(first, 0)::BIGINT AS first_sink FROM per""")
def taint_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file's taint report as a JSON object, read back."""
    d = reports.taint_documents(taint.analyse(corpus.event_files(spark, sf_dir)))
    at = lambda p: F.get_json_object("document", p)
    number = lambda c, name: F.coalesce(c.cast("long"), F.lit(0).cast("long")).alias(name)
    return d.select(at("$.file_path").alias("path"), number(at("$.summary.sources_found"), "sources_found"), number(at("$.summary.total_paths"), "total_paths"), number(F.json_array_length(at("$.paths")), "listed"), number(at("$.paths[0].sink.line"), "first_sink"))


# -- graph analytics on an edge table --
_TRADE = """nodes AS (SELECT n_name AS name FROM nation), edges AS (
  SELECT a.n_name AS caller, b.n_name AS callee FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation a ON s_nationkey = a.n_nationkey JOIN nation b ON c_nationkey = b.n_nationkey)"""


@query(f"""WITH {_TRADE}, i AS (SELECT callee AS name, count(*) AS n FROM edges GROUP BY ALL), o AS (SELECT caller AS name, count(*) AS n FROM edges GROUP BY ALL)
SELECT name, coalesce(i.n, 0) AS in_degree, coalesce(o.n, 0) AS out_degree FROM nodes LEFT JOIN i USING (name) LEFT JOIN o USING (name)""")
def trade_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edge for every line item: a bag of edges among few names."""
    s, e = corpus.nation_graph(spark, sf_dir)
    return analytics.degrees(s, e).select("name", "in_degree", "out_degree")


@query(f"WITH {_TRADE} SELECT name, 'root' AS kind FROM nodes WHERE name NOT IN (SELECT callee FROM edges) UNION ALL SELECT name, 'leaf' FROM nodes WHERE name NOT IN (SELECT caller FROM edges)")
def trade_roots_and_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, e = corpus.nation_graph(spark, sf_dir)
    kind = lambda df, k: df.select("name", F.lit(k).alias("kind"))
    return kind(analytics.roots(s, e), "root").union(kind(analytics.leaves(s, e), "leaf"))


_ROOTS = """roots AS (SELECT path, name AS entry FROM symbols s WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.path = s.path AND e.callee = s.name) AND path IN (SELECT path FROM edges))"""


@query(f"""WITH RECURSIVE {_CALLS}, {_ROOTS}, walk AS (SELECT path, entry, entry AS name, 0 AS dist FROM roots UNION SELECT w.path, w.entry, e.callee, w.dist + 1 FROM walk w JOIN edges e ON e.path = w.path AND e.caller = w.name WHERE w.dist < 8)
SELECT path, entry, name, min(dist) AS dist FROM walk GROUP BY ALL""")
def session_reach_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From every function that nothing calls; a session has six kinds of events at most, so no way is longer than eight."""
    g = _graph(spark, sf_dir)
    entries = analytics.roots(g.symbols, g.edges).select("path", F.col("name").alias("entry"))
    return analytics.reach(g.symbols, g.edges, entries).select("path", "entry", "name", "dist")


@query(f"""WITH RECURSIVE {_CALLS}, {_ROOTS}, r AS (SELECT path, entry AS name FROM roots UNION SELECT e.path, e.callee FROM r JOIN edges e ON e.path = r.path AND e.caller = r.name) SELECT path, name FROM symbols WHERE (path, name) NOT IN (SELECT (path, name) FROM r)""")
def session_dead_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _graph(spark, sf_dir)
    entries = analytics.roots(g.symbols, g.edges).select("path", F.col("name").alias("entry"))
    return analytics.dead_code(g.symbols, analytics.reach(g.symbols, g.edges, entries))


@query(f"""WITH {_CALLS}, lone AS (SELECT path, caller FROM edges GROUP BY ALL HAVING count(*) = 1), u AS (SELECT e.path, e.callee AS name, e.caller, l.caller IS NOT NULL AS alone FROM edges e LEFT JOIN lone l ON l.path = e.path AND l.caller = e.caller),
up AS (SELECT path, name, string_agg(caller, ',' ORDER BY caller) AS direct_callers, coalesce(string_agg(caller, ',' ORDER BY caller) FILTER (alone), '') AS potential_dead_code, count(*) AS n, count(*) FILTER (alone) AS dead FROM u GROUP BY ALL),
down AS (SELECT path, caller AS name, string_agg(callee, ',' ORDER BY callee) AS dependencies FROM edges GROUP BY ALL)
SELECT path, name, coalesce(direct_callers, '') AS direct_callers, coalesce(dependencies, '') AS dependencies, coalesce(potential_dead_code, '') AS potential_dead_code, coalesce(n + dead, 0) AS impact_score, coalesce(n > 3 OR dead > 0, false) AS is_critical
FROM symbols LEFT JOIN up USING (path, name) LEFT JOIN down USING (path, name)""")
def session_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _graph(spark, sf_dir)
    i = analytics.impact(g.symbols, g.edges)
    return i.select("path", "name", *[F.array_join(c, ",").alias(c) for c in ("direct_callers", "dependencies", "potential_dead_code")], F.col("impact_score").cast("long").alias("impact_score"), "is_critical")


# -- text --
_SECRET = " OR ".join(f"regexp_matches(text, '{p}')" for p in X.SECRETS.values())


@query(f"""SELECT doc_id, length(text) AS length, regexp_matches(text, '{X.SQL_WORDS}') AS sql, regexp_matches(text, '{X.SHELL_CHARACTERS}') AS shell, regexp_matches(text, '{X.URL}') AS url, ({_SECRET}) AS secrets FROM documents WHERE text IS NOT NULL""")
def string_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    return d.select("doc_id", X.analyse_string(F.col("text")).alias("a")).select("doc_id", "a.*")


@query(" UNION ALL ".join(f"SELECT '{k}' AS kind, count(*) FILTER (regexp_matches(text, '{p}')) AS texts FROM documents" for k, p in X.SECRETS.items()))
def secret_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").agg(*[F.count_if(F.col("text").rlike(p)).alias(k) for k, p in X.SECRETS.items()])
    return t.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("texts")) for k in X.SECRETS])).alias("x")).select("x.*")


# Words end where neither letter, mark, digit nor underscore follows; two spaces for each other character keep neighbours apart.
_COUNT = lambda words: f"len(regexp_extract_all(' ' || regexp_replace(text, '[^\\p{{L}}\\p{{M}}\\p{{N}}_]', '  ', 'g') || ' ', '(?i) ({words}) '))"


@query(f"""WITH c AS (SELECT doc_id, greatest(1, floor(1 + (4 * {_COUNT("elif|for|if|while")} + 2 * {_COUNT("and|or")} + {_COUNT("assert|break|continue|else|except|finally|raise|return|try|with|yield")}) / 4))::INT AS complexity FROM documents WHERE text IS NOT NULL)
SELECT doc_id, complexity, (complexity // 5 * 5)::VARCHAR || '-' || (complexity // 5 * 5 + 5)::VARCHAR AS bucket FROM c""")
def text_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", X.complexity(F.col("text")).alias("complexity"))
    return d.withColumn("bucket", X.complexity_bucket(F.col("complexity")))


@query()
def conversation_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations read as code: most have no tree and give an error row each, and no task fails."""
    c = table(spark, sf_dir, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("path"), F.col("text").alias("code"))
    return explode_part(facts(c, ["errors"]), "errors")


@query("""WITH w AS (SELECT DISTINCT lower(p_brand) AS name FROM part UNION SELECT DISTINCT lower(replace(event_type, '-', '_')) || '_data' FROM events)
SELECT name, CASE WHEN regexp_matches(name, 'get_input|input|raw_input|read_input|stdin') THEN 'user_input' WHEN regexp_matches(name, 'argparse|args|arguments|argv') THEN 'sys_argv' WHEN regexp_matches(name, 'env') THEN 'env_var'
WHEN regexp_matches(name, 'args|body|cookies|data|form|headers|json|params|query|request|values') THEN 'flask_request' WHEN regexp_matches(name, 'load|open|read') THEN 'file_read' WHEN regexp_matches(name, 'download|fetch|get|receive|recv') THEN 'network_read' END AS source_type FROM w""")
def guessed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codeloom.functions.classify import guessed_source

    a = table(spark, sf_dir, "part").select(F.lower("p_brand").alias("name"))
    b = table(spark, sf_dir, "events").select(F.concat(F.lower(F.replace("event_type", F.lit("-"), F.lit("_"))), F.lit("_data")).alias("name"))
    return a.union(b).distinct().select("name", guessed_source(F.col("name"), F.col("name"))["type"].alias("source_type"))


# These add themselves to the registry.
from codeloom.plans import gallery_queries  # noqa: E402, F401
