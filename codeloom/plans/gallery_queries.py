"""Queries over the gallery, with the rows that each of its texts must give, worked out by hand.

The SQL knows nothing of the engine: it says, for each text by its number, what
is to be found and in which line, and joins that with ``events``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.operators import analytics, callgraph, extract, scan, taint
from codeloom.plans import exports, reports
from codeloom.plans.registry import query
from codeloom.sources.facts import explode_part, facts
from codeloom.sources.gallery import RULES_YAML, expected, files
from codeloom.sources.rules import SHIPPED, load_dir, load_text, rules_table, validate_dir


def line(c: str = "start_line") -> Column:
    return F.col(c).cast("long").alias("line")


# -- rules --
_TEXT = {"rule_id": "text", "pattern": "int", "line": "line", "start_column": "int", "node_type": "text"}
_CUSTOM = [
    (0, "G.IMPORT", 0, 3, 1, "import_from_statement"),
    (1, "G.IMPORT", 0, 1, 1, "import_statement"), (1, "G.IMPORT", 0, 2, 1, "import_from_statement"), (1, "G.REGEX", 0, 3, 1, "identifier"), (1, "G.ASSIGN", 0, 4, 1, "assignment"), (1, "G.STRING.NAME", 0, 4, 10, "string"),
    (1, "G.ASSIGN", 0, 6, 1, "augmented_assignment"), (1, "G.STRING.REGEX", 0, 6, 11, "string"), *[(1, f"G.CALL.{k}", 0, 7, 1, "call") for k in ("NAME", "EQUALS", "NUMBER", "REGEX", "PRESENT")],
    *[(1, f"G.CALL.{k}", 0, 8, 1, "call") for k in ("NAME", "QUALIFIED", "MODULE", "BOOL", "CONTAINS", "ABSENT")], (1, "G.CALL.MODULE", 0, 9, 1, "call"), (1, "G.TWICE", 0, 9, 1, "call"), (1, "G.TWICE", 1, 9, 1, "call"),
]


@query(expected("rules", _TEXT, _CUSTOM))
def gallery_custom_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kind of pattern and of argument test, on text beyond ASCII too; a rule that can't be compiled leaves the others alone."""
    f = scan.scan(files(spark, sf_dir, "rules"), load_text(RULES_YAML).rules)
    return f.select("path", "rule_id", F.col("pattern").cast("long").alias("pattern"), line(), F.col("start_column").cast("long").alias("start_column"), "node_type")


@query(expected("rules", {"rule_id": "text", "line": "line"}, [(1, "G.TWICE", 9)]))
def gallery_strict_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two patterns of a rule on one node strict mode reports one; only critical rules are applied."""
    f = scan.scan(files(spark, sf_dir, "rules"), load_text(RULES_YAML).rules, min_severity="critical", strict=True)
    return f.select("path", "rule_id", line())


_GOOD = {"PY.EVAL.USE": "ast.literal_eval(text)", "PY.PICKLE.LOAD": "json.loads(data)", "PY.REQUESTS.VERIFY_FALSE": "requests.get(url)", "PY.SQL.INJECTION": "cursor.execute(query, values)", "PY.YAML.UNSAFE_LOAD": "yaml.safe_load(data)", "PY.SECRET.HARDCODED": 'os.environ["API_KEY"]'}
_SHIPPED = [("PY.REQUESTS.VERIFY_FALSE", "medium", 0, 8), ("PY.YAML.UNSAFE_LOAD", "high", 1, 9), ("PY.YAML.UNSAFE_LOAD", "high", 1, 10), ("PY.PICKLE.LOAD", "high", 0, 11), ("PY.EVAL.USE", "high", 0, 12), ("PY.SQL.INJECTION", "high", 0, 13), ("PY.SECRET.HARDCODED", "high", 0, 14)]


@query(expected("rules", {"rule_id": "text", "severity": "text", "pattern": "int", "line": "line", "remediation": "text"}, [(0, r, s, p, n, "Consider using: " + _GOOD[r]) for r, s, p, n in _SHIPPED]))
def gallery_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shipped rules that plain made files never meet, and their remediations."""
    f = scan.scan(files(spark, sf_dir, "rules"), load_dir().rules)
    return f.select("path", "rule_id", "severity", F.col("pattern").cast("long").alias("pattern"), line(), "remediation")


@query(expected("rules", {"finding_count": "int", "rules_applied": "int", "bad_rules": "text"}, [(0, 1, 17, "G.BAD"), (1, len(_CUSTOM) - 1, 17, "G.BAD")]))
def gallery_file_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a scan says of each file, the rule that could not be applied among it."""
    f, rules = files(spark, sf_dir, "rules"), load_text(RULES_YAML).rules
    r = scan.file_results(f, scan.scan(f, rules), rules)
    return r.select("path", "finding_count", F.col("rules_applied").cast("long").alias("rules_applied"), F.array_join(F.transform("errors", lambda e: F.regexp_extract(e, "rule ([A-Z.]+):", 1)), ",").alias("bad_rules"))


@query(expected("rules", {"position": "int", "rule_id": "text", "line": "line"}, [(0, i, r, n) for i, (r, n) in enumerate([*[(r, n) for r, s, _, n in _SHIPPED if s == "high"], ("PY.REQUESTS.VERIFY_FALSE", 8)], 1)]))
def gallery_console_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of medium severity and more as a console lists them: by severity, then by line."""
    f = reports.listed(scan.scan(files(spark, sf_dir, "rules"), load_dir().rules), "medium")
    w = Window.partitionBy("path").orderBy(F.desc("sev_rank"), "start_line", "start_column")
    return f.select("path", F.row_number().over(w).cast("long").alias("position"), "rule_id", line())


@query(expected("rules", {"rule_id": "text", "level": "text", "line": "line", "n_columns": "int", "fix": "text"}, [(0, r, "error" if s == "high" else "warning", n, w, "Consider using: " + _GOOD[r]) for (r, s, _, n), w in zip(_SHIPPED, map(len, ("requests.get(url, verify=False)", "yaml.load(data)", "yaml.load(data, Loader=Safe)", "pickle.loads(data)", 'eval("1")', 'cursor.execute("select")', 'API_KEY = "x"')), strict=True)]))
def gallery_sarif(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings as SARIF results, read back from their JSON."""
    r = reports.sarif_results(scan.scan(files(spark, sf_dir, "rules"), load_dir().rules))
    at = lambda p: F.get_json_object("result", p)
    region = "$.locations[0].physicalLocation.region."
    return r.select("path", at("$.ruleId").alias("rule_id"), at("$.level").alias("level"), at(region + "startLine").cast("long").alias("line"), (at(region + "endColumn").cast("long") - at(region + "startColumn").cast("long")).alias("n_columns"), at("$.fixes[0].description.text").alias("fix"))


@query(expected("rules", {"finding_count": "int", "first_rule": "text", "first_line": "line0", "n_errors": "int"}, [(0, 7, "PY.REQUESTS.VERIFY_FALSE", 8, 0), (1, 0, "", None, 0)]))
def gallery_scan_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file's JSON object, read back: counts, the first finding, errors."""
    f, rules = files(spark, sf_dir, "rules"), load_dir().rules
    found = scan.scan(f, rules)
    d = reports.file_documents(scan.file_results(f, found, rules), found)
    at = lambda p: F.get_json_object("document", p)
    return d.select(at("$.file").alias("path"), at("$.finding_count").cast("long").alias("finding_count"), F.coalesce(at("$.findings[0].rule_id"), F.lit("")).alias("first_rule"), F.coalesce(at("$.findings[0].location.line").cast("long"), F.lit(0)).alias("first_line"), F.coalesce(F.json_array_length(at("$.errors")), F.lit(0)).cast("long").alias("n_errors"))


_LISTED = [
    ("PY.EVAL.USE", "high", "code-execution,injection"), ("PY.OS.SYSTEM", "high", "command-execution,injection"), ("PY.PICKLE.LOAD", "high", "code-execution,deserialization"), ("PY.SECRET.HARDCODED", "high", "credentials"),
    ("PY.SQL.INJECTION", "high", "database,injection,sql"), ("PY.SUBPROCESS.SHELL", "high", "command-execution,injection"), ("PY.YAML.UNSAFE_LOAD", "high", "code-execution,deserialization"),
    ("PY.HASH.WEAK", "medium", "cryptography,weak-algorithm"), ("PY.REQUESTS.VERIFY_FALSE", "medium", "network-security,ssl"),
]
_values = lambda rows: ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


@query(f"SELECT * FROM (VALUES {_values([(i, *r) for i, r in enumerate(_LISTED)])}) v(position, id, severity, tags)")
def rules_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shipped rules as they are listed: by severity as text, then by id."""
    t = rules_table(spark, load_dir().listing())
    w = Window.orderBy("severity", "id")  # bounded by the rule files
    return t.select((F.row_number().over(w) - 1).alias("position"), "id", "severity", F.array_join("tags", ",").alias("tags"))


@query(f"""WITH r AS (SELECT * FROM (VALUES {_values(_LISTED)}) v(id, severity, tags)), t AS (SELECT unnest(string_split(tags, ',')) AS tag FROM r)
SELECT 'severity' AS what, severity AS name, count(*) AS n FROM r GROUP BY ALL UNION ALL SELECT 'tag', tag, count(*) FROM t GROUP BY ALL UNION ALL SELECT 'total', '', count(*) FROM r""")
def rules_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = reports.rule_statistics(load_dir().rules)
    rows = [("severity", k, v) for k, v in s["severity_counts"].items() if v] + [("tag", k, v) for k, v in s["tag_counts"].items()] + [("total", "", s["total_rules"])]
    return spark.createDataFrame(rows, "what string, name string, n long")


@query("SELECT 1::BIGINT AS files, 1::BIGINT AS valid_files, 9::BIGINT AS rules, 0::BIGINT AS error_count")
def rules_validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = validate_dir(SHIPPED)
    return spark.createDataFrame([tuple(v[k] for k in ("files", "valid_files", "rules", "error_count"))], "files long, valid_files long, rules long, error_count long")


# -- symbols --
_SYMBOL = {"qualified_name": "text", "node_type": "text", "line": "line", "end_line": "line", "parameters": "text", "is_async": "bool", "is_generator": "bool", "complexity": "int", "docstring": "text", "decorators": "text"}
_SIZE, _LOAD, _TOP, _IN = (5, 9, "self", False, False, 3), (11, 13, "self,n=3,*rest", True, True, 2), (15, 20, "a,b=2", False, False, 2), (16, 19, "c", False, False, 2)
_M, _INNER = (4, 7, "self", False, False, 1), (5, 6, "", False, False, 1)
_COMPATIBLE = [
    *[(0, q, k, *v, None, "") for q, k, v in (("Outer.size", "method", _SIZE), ("Outer.load", "method", _LOAD), ("size", "function", _SIZE), ("load", "function", _LOAD), ("top_$T", "function", _TOP), ("top_$T.inner", "function", _IN), ("inner", "function", _IN))],
    (2, "after_$T", "function", 4, 5, "", False, False, 1, None, ""),
    *[(1, q, "method" if q[0] in "AB" else "function", *_M, None, "") for q in ("A..B.m", "A.m", "B.m", "m")],
    *[(1, q, "method" if q[0] in "AB" else "function", *_INNER, None, "") for q in ("A..B..m.inner", "A..B.inner", "A..m.inner", "A.inner", "B..m.inner", "B.inner", "m.inner", "inner")],
]
_STRICT = [(2, "after_$T", "function", 4, 5, "", False, False, 1, None, ""), (0, "Outer.size", "method", *_SIZE, "Docs.", "property"), (0, "Outer.load", "method", *_LOAD, None, ""), (0, "top_$T", "function", *_TOP, None, ""), (0, "top_$T.inner", "function", *_IN, None, ""), (1, "A.B.m", "method", *_M, None, ""), (1, "A.B.m.inner", "function", *_INNER, None, "")]


def _symbols(spark: SparkSession, sf_dir: str, strict: bool) -> DataFrame:
    s = explode_part(facts(files(spark, sf_dir, "symbols"), ["symbols"], strict=strict), "symbols")
    return s.select("path", "qualified_name", "node_type", line(), F.col("end_line").cast("long").alias("end_line"), F.array_join("parameters", ",").alias("parameters"), "is_async", "is_generator", F.col("complexity").cast("long").alias("complexity"), "docstring", F.array_join("decorators", ",").alias("decorators"))


@query(expected("symbols", _SYMBOL, _COMPATIBLE))
def gallery_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes, methods, nested, async and generator functions under every chain of enclosing definitions."""
    return _symbols(spark, sf_dir, False)


@query(expected("symbols", _SYMBOL, _STRICT))
def gallery_symbols_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same once each, with decorators and docstrings."""
    return _symbols(spark, sf_dir, True)


@query(expected("symbols", {"total_scopes": "int", "max_level": "int", "imports": "text", "functions": "text"}, [(0, 9, 2, "", "<module>=4,Outer=2,inner=0,load=0,size=0,top_$T=1"), (1, 16, 4, "os", "<module>=2,A=2,B=2,inner=0,m=1"), (2, 2, 1, "", "<module>=1,after_$T=0")]))
def gallery_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = facts(files(spark, sf_dir, "symbols"), ["scope"])
    per = F.array_sort(F.transform(F.map_entries("scope.functions_per_scope"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    number = lambda c: F.coalesce(F.col(f"scope.{c}").cast("long"), F.lit(-1)).alias(c)
    text = lambda c, name: F.coalesce(F.array_join(c, ","), F.lit("")).alias(name)
    return s.select("path", number("total_scopes"), number("max_level"), text("scope.modules", "imports"), text(per, "functions"))


@query(expected("symbols", {"stage": "text", "line": "line"}, [(2, "partial", 1)]))
def gallery_syntax_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.syntax_errors(files(spark, sf_dir, "symbols")).select("path", "stage", line("line"))


@query(expected("symbols", {"kind": "text", "line": "line", "n_children": "int"}, [(0, "class_definition", 1, 4), (0, "decorated_definition", 4, 2), (0, "if_statement", 7, 4), (0, "for_statement", 12, 6), (0, "while_statement", 17, 4), (1, "class_definition", 2, 4), (1, "class_definition", 3, 4)]))
def gallery_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of some kinds, and how many children each has."""
    kinds = ["class_definition", "decorated_definition", "if_statement", "for_statement", "while_statement"]
    every = extract.nodes(files(spark, sf_dir, "symbols"), want=())
    n = every.groupBy("path", F.col("parent").alias("id")).agg(F.count("*").alias("n_children"))
    return every.filter(F.col("type").isin(*kinds)).join(n, ["path", "id"]).select("path", F.col("type").alias("kind"), (F.col("sl") + 1).cast("long").alias("line"), "n_children")


@query(expected("graphs", {"type": "text", "text": "text"}, []).replace("SELECT path", "SELECT path").split("SELECT path")[0] + "SELECT path, CASE WHEN n > 0 THEN 'comment' WHEN k = 0 THEN 'identifier' ELSE 'identifier' END AS type, CASE WHEN n > 0 THEN '# a note' WHEN k = 0 THEN 'a' ELSE 'run' END AS text FROM made")
def gallery_node_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The innermost node at the fifth byte of the first line: a comment, or the name of the first function."""
    return extract.node_at(files(spark, sf_dir, "graphs"), 0, 4).select("path", "type", "text")


# -- calls --
_EDGE = {"caller": "text", "callee": "text", "call_type": "text", "line": "line", "confidence": "double", "is_conditional": "bool"}
_H = "helper_$T"
_EDGES = [
    (_H, "math.floor", "direct", 6, 0.7), ("main", _H, "direct", 9, 1.0), ("main", _H, "direct", 11, 1.0), ("main", "os.os.getcwd", "direct", 13, 0.7), ("main", _H, "direct", 14, 1.0), ("main", "root", "direct", 15, 0.3), ("main", _H, "direct", 15, 1.0),
    ("main", "<builtin>.print", "direct", 16, 0.9), ("main", "js.dumps", "direct", 16, 0.7), ("main", "nowhere", "direct", 17, 0.3), ("main", _H, "direct", 18, 1.0), ("main", _H, "indirect", 19, 1.0), ("main", "main", "recursive", 20, 1.0),
]
_EDGES_STRICT = [
    (_H, "math.floor", "direct", 6, 0.7, False), ("main", _H, "direct", 9, 1.0, False), ("main", "alias", "direct", 11, 0.3, False), ("main", "os.getcwd", "direct", 13, 0.7, True), ("main", _H, "direct", 14, 1.0, True), ("main", "math.sqrt", "direct", 15, 0.7, False),
    ("main", _H, "direct", 15, 1.0, True), ("main", "<builtin>.print", "direct", 16, 0.9, False), ("main", "json.dumps", "direct", 16, 0.7, False), ("main", "nowhere", "direct", 17, 0.3, False), ("main", _H, "direct", 18, 1.0, False), ("main", "obj.alias", "direct", 19, 0.7, False), ("main", "main", "recursive", 20, 1.0, False),
]


def _calls(spark: SparkSession, sf_dir: str, strict: bool = False) -> callgraph.Graph:
    return callgraph.graph(files(spark, sf_dir, "calls"), strict=strict, materialise=False)


@query(expected("calls", _EDGE, [(0, *e, False) for e in _EDGES]))
def gallery_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls through aliases, imports, built-ins and objects, recursive, indirect and unresolved ones."""
    return _calls(spark, sf_dir).edges.select("path", "caller", "callee", "call_type", line("line"), "confidence", "is_conditional")


@query(expected("calls", _EDGE, [(0, *e) for e in _EDGES_STRICT]))
def gallery_edges_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calls(spark, sf_dir, True).edges.select("path", "caller", "callee", "call_type", line("line"), "confidence", "is_conditional")


@query(expected("calls", {"name": "text"}, [(0, _H), (0, "main")]))
def gallery_entry_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Called at top level, called in the main block, or named as an entry."""
    return _calls(spark, sf_dir).entry_points


@query(expected("calls", {"call_expression": "text", "line": "line"}, [(0, "root(4)", 15), (0, "nowhere(6)", 17)]))
def gallery_unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calls(spark, sf_dir).unresolved().select("path", "call_expression", line("line"))


@query(expected("calls", {"caller": "text", "callee": "text", "calls": "int"}, [(0, a, b, sum(e[:2] == (a, b) for e in _EDGES)) for a, b in dict.fromkeys(e[:2] for e in _EDGES)]))
def gallery_call_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.call_counts(_calls(spark, sf_dir).edges)


@query(expected("calls", {"role": "text", "other": "text", "line": "line"}, [(0, "caller", e[0], e[3]) for e in _EDGES if e[1] == _H] + [(0, "callee", e[1], e[3]) for e in _EDGES if e[0] == _H]))
def gallery_callers_and_callees(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _calls(spark, sf_dir).edges.withColumn("plain", F.col("callee").startswith("helper_"))
    up = analytics.callers(e.withColumn("callee", F.when(F.col("plain"), "helper").otherwise(F.col("callee"))), "helper").select("path", F.lit("caller").alias("role"), F.col("caller").alias("other"), line("line"))
    down = analytics.callees(e.withColumn("caller", F.when(F.col("caller").startswith("helper_"), "helper").otherwise(F.col("caller"))), "helper").select("path", F.lit("callee").alias("role"), F.col("callee").alias("other"), line("line"))
    return up.union(down)


@query(expected("calls", {"alias": "text", "name": "text", "module": "text"}, [(0, "os", None, "os"), (0, "js", None, "json"), (0, None, "math", "math"), (0, None, "root", "math"), (0, None, "floor", "math")]))
def gallery_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each imported name or alias leads to."""
    return taint.module_imports(files(spark, sf_dir, "calls")).select("path", "alias", "name", "module")


# -- graphs --
def _graphs(spark: SparkSession, sf_dir: str) -> callgraph.Graph:
    return callgraph.graph(files(spark, sf_dir, "graphs"))


def _reached(g: callgraph.Graph) -> DataFrame:
    return analytics.reach(g.symbols, g.edges, analytics.default_entries(g.symbols, g.edges, g.entry_points))


@query(expected("graphs", {"cycle": "text"}, [(0, "b,d,b")]))
def gallery_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _graphs(spark, sf_dir)
    return analytics.cycles(g.symbols, g.edges).select("path", F.array_join("cycle", ",").alias("cycle"))


@query(expected("graphs", {"mode": "text", "members": "text"}, [(0, "strict", "b,d"), (0, "strict", "lone"), (0, "compatible", "a,b,d,e,c"), (0, "compatible", "lone"), (1, "compatible", "run,step_$T")]))
def gallery_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strongly connected functions; in compatible mode what a walk in order meets first."""
    g = _graphs(spark, sf_dir)
    part = lambda strict, mode: analytics.components(g.symbols, g.edges, strict).select("path", F.lit(mode).alias("mode"), F.array_join("members", ",").alias("members"))
    return part(True, "strict").union(part(False, "compatible"))


@query(expected("graphs", {"kind": "text", "number": "int", "nodes": "text"}, [(0, "shortest", 0, "a,b,d,e"), (0, "all", 0, "a,b,d,e"), (0, "all", 1, "a,c,d,e")]))
def gallery_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _graphs(spark, sf_dir)
    short = analytics.shortest_path(g.symbols, g.edges, "a", "e").select("path", F.lit("shortest").alias("kind"), F.lit(0).cast("long").alias("number"), F.array_join("nodes", ",").alias("nodes"))
    every = analytics.all_paths(g.symbols, g.edges, "a", "e").select("path", F.lit("all").alias("kind"), F.col("number").cast("long").alias("number"), F.array_join("nodes", ",").alias("nodes"))
    return short.union(every)


@query(expected("graphs", {"number": "int", "chain": "text", "more": "bool"}, [(0, i, c, False) for i, c in enumerate(("a", "a,b", "a,c", "a,b,d", "a,c,d", "a,b,d,e", "a,c,d,e", "a,c,d,b"))]))
def gallery_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _graphs(spark, sf_dir)
    return analytics.call_chains(g.symbols, g.edges, ["a"], 100).select("path", F.col("number").cast("long").alias("number"), F.array_join("chain", ",").alias("chain"), "more")


@query(expected("graphs", {"name": "text", "betweenness": "double"}, [(0, n, b) for n, b in (("a", 0.0), ("b", 2 / 36), ("c", 0.0), ("d", 4 / 36), ("e", 0.0), ("lone", 0.0))] + [(1, n, 0.0) for n in ("run", "step_$T", "unused")]))
def gallery_betweenness(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _graphs(spark, sf_dir)
    return analytics.betweenness(g.symbols, g.edges)


@query(expected("graphs", {"rank": "int", "name": "text", "total_degree": "int"}, [(0, 1, "d", 4), (0, 2, "b", 3), (0, 3, "a", 2), (0, 4, "c", 2), (0, 5, "lone", 2), (1, 1, "run", 2), (1, 2, "step_$T", 2), (1, 3, "unused", 0)]))
def gallery_critical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five functions of most calls and betweenness, ties in their order."""
    g = _graphs(spark, sf_dir)
    return analytics.critical(g.symbols, g.edges).select("path", F.col("rank").cast("long").alias("rank"), "name", "total_degree")


@query(expected("graphs", {"what": "text", "a": "text", "b": "text", "dist": "int"}, [(0, "reached", "a", n, d) for n, d in (("a", 0), ("b", 1), ("c", 1), ("d", 2), ("e", 3))] + [(0, "tree", a, b, -1) for a, b in ("ab", "ac", "bd", "cd", "de", "db")] + [(0, "dead", "lone", "", -1), (1, "reached", "run", "run", 0), (1, "reached", "run", "step_$T", 1), (1, "tree", "run", "step_$T", -1), (1, "dead", "unused", "", -1)]))
def gallery_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What entries reach and how far it is, the edges on the way, and what is never reached: entry points where a file has them, else functions that nothing calls."""
    g = _graphs(spark, sf_dir)
    r = _reached(g)
    none = F.lit(-1).cast("long")
    reached = r.select("path", F.lit("reached").alias("what"), F.col("entry").alias("a"), F.col("name").alias("b"), F.col("dist").cast("long").alias("dist"))
    tree = analytics.reach_tree(g.symbols, g.edges, r).select("path", F.lit("tree"), "caller", "callee", none)
    dead = analytics.dead_code(g.symbols, r).select("path", F.lit("dead"), "name", F.lit(""), none)
    return reached.union(tree).union(dead)


_SHAPE = [(0, 6, 7, 5, 0), (1, 3, 2, 2, 1)]


@query(expected("graphs", {"format": "text", "nodes": "int", "edges": "int", "reached": "int", "entries": "int"}, [(k, f, *rest) for k, *rest in _SHAPE for f in ("json", "graphml", "cytoscape")] + [(k, "dot", n, e, -1, -1) for k, n, e, _, _ in _SHAPE]))
def gallery_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every graph as JSON, GraphML, Cytoscape and DOT, read back: nodes, edges, those reached, entries."""
    g = _graphs(spark, sf_dir)
    r = _reached(g)
    d = F.col("document")
    count = lambda pattern: F.regexp_count(d, F.lit(pattern)).cast("long")
    of = lambda df, name, *c: df.select("path", F.lit(name).alias("format"), *[x.alias(n) for x, n in zip(c, ("nodes", "edges", "reached", "entries"), strict=True)])
    at = lambda p: F.get_json_object(d, p).cast("long")
    out = of(exports.graph_json(g, r), "json", at("$.statistics.total_nodes"), at("$.statistics.total_edges"), at("$.statistics.reachable_functions"), at("$.statistics.entry_points"))
    out = out.union(of(exports.graphml(g, r), "graphml", count("<node "), count("<edge "), count('key="reachable">True'), count('key="entry_point">True')))
    out = out.union(of(exports.cytoscape(g, r), "cytoscape", count('"group":"nodes"'), count('"group":"edges"'), count('"reachable":true'), count('"entry_point":true')))
    none = F.lit(-1).cast("long")
    return out.union(of(exports.dot(g, r), "dot", count(r'(?m)^    "[^"]+" \['), count(" -> "), none, none))


# -- flows --
@query(expected("flows", {"sources_found": "int", "sinks_found": "int", "sanitizers_found": "int"}, [(0, 7, 0, 1), (1, 7, 4, 3)]))
def gallery_taint_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources by catalogue, by name and as attributes; sinks that only a name tells; sanitizers and queries with parameters."""
    return taint.count_matches(files(spark, sf_dir, "flows"))


@query(expected("flows", {"sources_found": "int", "sinks_found": "int", "sanitizers_found": "int"}, [(0, 7, 4, 1), (1, 7, 13, 3)]))
def gallery_taint_counts_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taint.count_matches(files(spark, sf_dir, "flows"), strict=True)


_PATH = {"func": "text", "source": "text", "source_line": "line", "sink": "text", "sink_type": "text", "line": "line", "severity": "text", "is_sanitized": "bool", "sanitizers": "text", "path_length": "int", "variables": "text"}
_USER, _ARGV, _ENV = "User input function", "Command line argument (sys.argv)", "Environment variable"
_PATHS = [
    (0, "web_$T", "b", 6, "system", "command_exec", 8, "high", True, "html.escape", 2, "b,a"),
    (0, "grown", "q", 11, "system", "command_exec", 13, "high", False, "", 1, "q," + _ARGV),
    (0, "loops", "k", 18, "popen", "command_exec", 19, "high", False, "", 1, "k," + _ENV), (0, "loops", "k", 18, "popen", "command_exec", 21, "high", False, "", 1, "k," + _ENV),
    (1, "tried", "z", 6, "system", "command_exec", 10, "high", False, "", 1, "z," + _USER),
    (1, "chosen", "z", 15, "system", "command_exec", 17, "high", False, "", 1, "z," + _USER), (1, "chosen", "z", 15, "popen", "command_exec", 19, "high", False, "", 1, "z," + _USER),
    (1, "opened", "name", 24, "open", "path_traversal", 25, "high", False, "", 1, "name," + _USER), (1, "opened", "name", 24, "sq.connect", "http_request", 27, "medium", False, "", 1, "name," + _USER),
    (1, "opened", "name", 24, "system", "command_exec", 33, "high", True, "int", 3, f"name,{_USER},n"),
]
_PATHS_STRICT = [
    (0, "grown", "q", 11, "os.system", "command_exec", 13, "high", False, "", 1, "q," + _ARGV),
    (0, "loops", "k", 18, "os.popen", "command_exec", 19, "high", False, "", 1, "k," + _ENV), (0, "loops", "k", 18, "os.popen", "command_exec", 21, "high", False, "", 1, "k," + _ENV),
    *[(1, "tried", "z", 6, "os.system", "command_exec", n, "high", False, "", 1, "z," + _USER) for n in (8, 10, 12)],
    *[(1, "chosen", "z", 15, s, "command_exec", n, "high", False, "", 1, "z," + _USER) for s, n in (("os.system", 17), ("os.popen", 19), ("remove", 21))],
    (1, "opened", "name", 24, "open", "path_traversal", 25, "high", False, "", 1, "name," + _USER), (1, "opened", "name", 24, "sq.connect", "http_request", 27, "medium", False, "", 1, "name," + _USER),
]


def _paths(spark: SparkSession, sf_dir: str, strict: bool) -> DataFrame:
    p = taint.taint_paths(taint.analyse(files(spark, sf_dir, "flows"), strict=strict, counted=False))
    return p.select("path", "func", "source", F.col("source_line").cast("long").alias("source_line"), "sink", "sink_type", line("sink_line"), "severity", "is_sanitized", F.array_join("sanitizers", ",").alias("sanitizers"), F.col("path_length").cast("long").alias("path_length"), F.array_join("variables_involved", ",").alias("variables"))


@query(expected("flows", _PATH, _PATHS))
def gallery_taint_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths through requests, arguments, environment, loops, conditions, try, with, augmented assignment and return."""
    return _paths(spark, sf_dir, False)


@query(expected("flows", _PATH, _PATHS_STRICT))
def gallery_taint_paths_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with every branch visited, and sanitized or overwritten variables clean."""
    return _paths(spark, sf_dir, True)


_FLOW = [
    (0, "Web request data (Flask/Django)", "a", "source", 6, True), (0, "a", "b", "sanitize", 7, False), (0, "a", "b", "assignment", 7, True), (0, _ARGV, "q", "source", 11, True), (0, "q", "<return>", "return", 14, True), (0, _ENV, "k", "source", 18, True),
    (1, _USER, "z", "source", 6, True), (1, _USER, "z", "source", 15, True), (1, _USER, "name", "source", 24, True), (1, "open().read", "text", "source", 26, True), (1, "name", "n", "sanitize", 31, False), (1, "name", "n", "assignment", 31, True),
]


@query(expected("flows", {"from_var": "text", "to_var": "text", "operation": "text", "line": "line", "preserves_taint": "bool"}, _FLOW))
def gallery_flow_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = taint.flow_edges(taint.analyse(files(spark, sf_dir, "flows"), counted=False))
    return f.select("path", "from_var", "to_var", "operation", line("line"), "preserves_taint")


@query(expected("flows", {"position": "int", "source": "text", "line": "line", "severity": "text"}, [(k, i, p[2], p[6], p[7]) for k in (0, 1) for i, p in enumerate(sorted((p for p in _PATHS if p[0] == k), key=lambda p: (p[7] != "high", p[6])), 1)]))
def gallery_taint_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths as they are reported: most severe first, then by the sink's line."""
    p = taint.taint_paths(taint.analyse(files(spark, sf_dir, "flows"), counted=False))
    w = Window.partitionBy("path").orderBy(F.array_position(F.array(*[F.lit(s) for s in ("critical", "high", "medium", "low")]), F.col("severity")), "sink_line")
    return p.select("path", F.row_number().over(w).cast("long").alias("position"), "source", line("sink_line"), "severity")


@query(expected("flows", {"total_paths": "int", "vulnerable_paths": "int", "sanitized_paths": "int", "sources_found": "int", "first_source": "text"}, [(0, 4, 3, 1, 7, "b"), (1, 6, 5, 1, 7, "z")]))
def gallery_taint_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file's taint report, read back from its JSON."""
    d = reports.taint_documents(taint.analyse(files(spark, sf_dir, "flows")))
    at = lambda p: F.get_json_object("document", p)
    return d.select(at("$.file_path").alias("path"), *[at(f"$.summary.{c}").cast("long").alias(c) for c in ("total_paths", "vulnerable_paths", "sanitized_paths", "sources_found")], at("$.paths[0].source.variable").alias("first_source"))


@query(expected("flows", {"variable": "text", "object": "text"}, [(1, "f", "file"), (1, "c", "database_cursor"), (1, "sock", "socket")]))
def gallery_io_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taint.io_objects(files(spark, sf_dir, "flows"))


@query(expected("flows", {"object": "text", "variables": "int"}, [(1, "file", 1), (1, "database_cursor", 1), (1, "socket", 1)]))
def gallery_io_object_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taint.io_object_counts(files(spark, sf_dir, "flows"))
