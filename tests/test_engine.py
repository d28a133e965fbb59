"""Rules, graphs and taint on small files whose findings were worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from codeloom.functions import catalog as K
from codeloom.functions import classify as C
from codeloom.functions.judge import Judge, parameterised, semantic_sink, semantic_source
from codeloom.operators import analytics, callgraph, extract, scan, taint
from codeloom.plans import exports, reports
from codeloom.sources.facts import facts
from codeloom.sources.files import from_columns, from_strings, read_path
from codeloom.sources.rules import RuleError, load_dir, load_text, pick, rule_of, validate_dir

RISKY = """import os
import subprocess
import hashlib
import requests


def one(name):
    os.system("ls " + name)
    subprocess.run(name, shell=True)
    subprocess.run([name], shell=False)
    return hashlib.md5(name)


def two(url):
    return requests.get(url, verify=False), requests.get(url)


if __name__ == "__main__":
    one(two("x"))
"""
FLOWS = """import os
import shlex
import sys

def direct():
    a = input()
    os.system(a)

def cleaned():
    a = input()
    b = shlex.quote(a)
    os.system(b)

def passed(p):
    os.system(p)

def branch():
    if len(sys.argv) > 1:
        a = sys.argv[1]
    else:
        a = "x"
    with open(a) as f:
        return f

def caught():
    try:
        pass
    except ValueError:
        a = input()
        os.system(a)

def reset():
    a = input()
    a = "clean"
    os.system(a)
"""


def findings(spark, code, rules=None, **how):
    return scan.scan(from_strings(spark, code), rules or load_dir().rules, **how)


def hits(spark, code, yaml):
    loaded = load_text(yaml)
    assert not loaded.errors
    return sorted((r["node_type"], r["node_text"]) for r in findings(spark, code, loaded.rules).collect())


def test_shipped_rules_on_a_risky_file(spark):
    got = sorted((r["rule_id"], r["severity"], r["start_line"], r["start_column"]) for r in findings(spark, RISKY).collect())
    assert got == [("PY.HASH.WEAK", "medium", 11, 12), ("PY.OS.SYSTEM", "high", 8, 5), ("PY.REQUESTS.VERIFY_FALSE", "medium", 15, 12), ("PY.SUBPROCESS.SHELL", "high", 9, 5)]
    one = findings(spark, RISKY, ids=["PY.OS.SYSTEM"]).first()
    assert one["code_snippet"] == "\n".join(RISKY.splitlines()[5:10])
    assert RISKY.encode()[one["start_byte"] : one["end_byte"]].decode() == one["node_text"]
    assert one["remediation"].startswith("Consider using: ")
    assert findings(spark, RISKY, min_severity="critical").count() == 0
    assert findings(spark, RISKY, exclude=["PY.OS.SYSTEM", "PY.HASH.WEAK"]).count() == 2


RULE = "id: T\ntitle: t\nseverity: low\nmessage: m\npatterns:\n"


def test_every_kind_of_pattern(spark):
    code = 'import os.path\nfrom a import b\npassword = "hunter2"\nn = r\'x\'\nf(mode="w", n=3, q=\'it\')\n'
    assert hits(spark, code, RULE + "- {kind: assignment, name: password}") == [("assignment", 'password = "hunter2"')]
    assert hits(spark, code, RULE + "- {kind: import, name: a}") == [("import_from_statement", "from a import b")]
    assert hits(spark, code, RULE + "- {kind: import, name: os}") == []
    assert hits(spark, code, RULE + "- {kind: string_literal, name: hunter}") == [("string", '"hunter2"')]
    assert hits(spark, code, RULE + "- {kind: string_literal, regex: \"^r'\"}") == [("string", "r'x'")]
    assert hits(spark, code, RULE + "- {kind: call, name: f}")[0][0] == "call"
    texts = [t for t, _ in hits(spark, "x = 'abc'", RULE + "- {kind: regex, regex: 'a[b]c'}")]
    assert texts == ["assignment", "expression_statement", "module", "string"]
    for test, n in (("equals: w", 1), ("equals: r", 0), ("contains: w", 1), ("regex: '^.w.$'", 1), ("present: false", 0), ("present: true", 1)):
        assert len(hits(spark, code, RULE + f"- {{kind: call, callee: {{name: f, args: [{{name: mode, {test}}}]}}}}")) == n, test
    assert len(hits(spark, code, RULE + "- {kind: call, callee: {name: f, args: [{name: n, equals: 3}]}}")) == 1
    assert len(hits(spark, code, RULE + "- {kind: call, callee: {name: f, args: [{name: q, equals: it}, {name: zz, present: false}]}}")) == 1
    assert len(hits(spark, code, RULE + "- {kind: call, callee: {name: f, args: [{name: zz, contains: x}]}}")) == 0
    assert len(hits(spark, "a.b.c(); a.c()", RULE + "- {kind: call, callee: {module: a.b}}")) == 1


def test_a_long_chain_is_reached_whole(spark):
    names = [f"f{i}" for i in range(110)]
    s, e = table(spark, list(zip(names, names[1:])))
    reached = analytics.reach(s, e, spark.createDataFrame([("g", "f0")], "path string, entry string"))
    assert {(r["name"], r["dist"]) for r in reached.collect()} == {(n, i) for i, n in enumerate(names)}
    assert analytics.reach(s, e, spark.createDataFrame([("g", "f0")], "path string, entry string"), max_rounds=6).count() == 7


def test_a_rule_that_cannot_be_compiled_is_an_error_and_others_apply(spark):
    rules = load_text("- {id: A, title: t, severity: low, message: m, patterns: [{kind: call, name: f}]}\n- {id: B, title: t, severity: low, message: m, patterns: [{kind: regex, regex: '(a)?(?(1)b|c)'}]}\n- {id: C, title: t, severity: low, message: m, patterns: [{kind: regex, regex: '('}]}").rules
    files = from_strings(spark, "f()")
    found = scan.scan(files, rules)
    assert [r["rule_id"] for r in found.collect()] == ["A"]
    assert set(scan.rule_errors(spark, rules)) == {"B", "C"}
    r = scan.file_results(files, found, rules).first()
    assert r["finding_count"] == 1 and len(r["errors"]) == 2 and r["errors"][0].startswith("Error applying rule B: ")


def test_conditions_are_told_in_strict_mode(spark):
    code = "def f(x):\n    a()\n    if b():\n        c()\n    elif d():\n        e()\n    while g():\n        h()\n    y = i() and j()\n    k() if l() else m()\n    try:\n        n()\n    except E:\n        o()\n"
    got = {r["callee"]: r["is_conditional"] for r in callgraph.graph(from_strings(spark, code), strict=True).edges.collect()}
    assert {k for k, v in got.items() if v} == set("cdehjkmo") and {k for k, v in got.items() if not v} == set("abgiln")
    assert not any(r["is_conditional"] for r in callgraph.graph(from_strings(spark, code)).edges.collect())


def test_two_patterns_of_a_rule_hit_twice_unless_strict(spark):
    rules = load_text(RULE + "- {kind: call, name: f}\n- {kind: call, callee: {anyOf: [f]}}").rules
    assert findings(spark, "f()", rules).count() == 2
    assert findings(spark, "f()", rules, strict=True).count() == 1


def test_severity_filter_is_monotone_and_partitions_add_up(spark):
    counts = [findings(spark, RISKY, min_severity=s).count() for s in ("low", "medium", "high", "critical")]
    assert counts == sorted(counts, reverse=True)
    rules = load_dir().rules
    assert sum(findings(spark, RISKY, ids=[r.id]).count() for r in rules) == counts[0]


def test_rule_files(tmp_path):
    (tmp_path / "a.yaml").write_text(RULE + "- {kind: call, name: f}")
    (tmp_path / "bad.yml").write_text("id: [")
    (tmp_path / "list.yaml").write_text("- {id: x}\n- " + RULE.replace("\n", "\n  ") + "- {kind: call, name: g}")
    loaded = load_dir(str(tmp_path))
    assert [r.id for r in loaded.rules] == ["T", "T"] and len(loaded.errors) == 1
    v = validate_dir(str(tmp_path))
    assert (v["files"], v["valid_files"], v["rules"], v["error_count"]) == (3, 2, 2, 2)
    with pytest.raises(FileNotFoundError):
        load_dir(str(tmp_path / "none"))
    with pytest.raises(RuleError):
        rule_of({"id": "x", "title": "t", "message": "m", "severity": "huge", "patterns": []})
    stats = reports.rule_statistics(load_dir().rules)
    assert stats["total_rules"] == 9 and stats["severity_counts"] == {"critical": 0, "high": 7, "medium": 2, "low": 0}
    assert reports.rule_statistics([]) == {"total_rules": 0}
    assert [r.severity for r in load_dir().listing()] == ["high"] * 7 + ["medium"] * 2
    assert len(pick(load_dir().rules, min_severity="high")) == 7


def test_files_without_a_tree_are_error_rows(spark):
    files = spark.createDataFrame([("a", b"x = 1"), ("b", b"a b\n" * 50), ("c", None), ("d", b"\xff\xfe")], "path string, code binary")
    assert {r["path"]: r["stage"] for r in scan.scan_errors(files).collect()} == {"b": "syntax", "c": "read", "d": "decode"}
    f = scan.scan(files, load_dir().rules)
    r = {x["path"]: x for x in scan.file_results(files, f, 8).collect()}
    assert r["a"]["rules_applied"] == 8 and r["b"]["rules_applied"] == 0 and r["b"]["errors"]


def test_one_bad_line_does_not_hide_the_others(spark):
    code = "import os\ndef broken(:\n    os.system(a)\nprint 'old'\ndef fine():\n    x = (1,\n    os.system(b)\n"
    files = from_strings(spark, code)
    found = scan.scan(files, load_dir().rules)
    assert [(r["rule_id"], r["start_line"]) for r in found.orderBy("start_line").collect()] == [("PY.OS.SYSTEM", 3), ("PY.OS.SYSTEM", 7)]
    errors = extract.syntax_errors(files).collect()
    assert sorted((r["stage"], r["line"]) for r in errors) == [("partial", 2), ("partial", 4), ("partial", 6)]
    r = scan.file_results(files, found, load_dir().rules).first()
    assert r["rules_applied"] == 9 and r["finding_count"] == 2 and len(r["errors"]) == 3
    bad = extract.nodes(files, ["ERROR"]).orderBy("id").collect()
    assert [n["text"].split("\n")[0] for n in bad] == ["def broken(:", "print 'old'", "x = (1,"]
    assert [r["name"] for r in extract.functions(files).collect()] == ["fine"]


def test_extraction(spark):
    d = from_strings(spark, RISKY)
    assert [r["name"] for r in extract.functions(d).orderBy("id").collect()] == ["one", "two"]
    assert {r["qn"] for r in extract.calls_within(d).filter("function = 'two'").collect()} == {"requests.get"}
    s = extract.file_stats(d).first()
    assert (s["total_lines"], s["functions"], s["calls"], s["imports"]) == (19, 2, 8, 4)
    assert extract.node_at(from_strings(spark, "ab = cd"), 0, 2).first()["text"] == "ab"
    assert extract.node_at(from_strings(spark, "ab = cd"), 0, 5).first()["text"] == "cd"
    assert extract.node_at(from_strings(spark, "f(a, b)"), 0, 5).first()["text"] == "b"
    a = extract.string_analysis(from_strings(spark, "q = 'SELECT 1'; u = 'https://x.y'; k = 'my password'")).orderBy("id").collect()
    assert [(r["sql"], r["url"], r["secrets"]) for r in a] == [(True, False, False), (False, True, False), (False, False, True)]
    spans = spark.createDataFrame([("<string>", 1, 1)], "path string, start_line int, end_line int")
    assert extract.snippets(d, spans).first()["code_snippet"] == "\n".join(RISKY.splitlines()[:3])
    assert from_columns(spark.range(1), F.lit("p"), F.lit("x = 1")).first()["code"] == "x = 1"


GRAPH = """import os
from m import helper as h, other

class Job:
    def run(self):
        step()
        self.stop()

    def stop(self):
        other()

def step():
    leaf()
    step()
    print(os.path.join("a"))

def leaf():
    unknown()

alias = leaf

def uses():
    alias()

run = 1
if __name__ == "__main__":
    uses()
"""


def test_call_graph_compatible(spark):
    g = callgraph.graph(from_strings(spark, GRAPH))
    names = {r["qualified_name"]: r["node_type"] for r in g.symbols.collect()}
    assert names == {"Job.run": "method", "run": "function", "Job.stop": "method", "stop": "function", "step": "function", "leaf": "function", "uses": "function"}
    e = sorted((r["caller"], r["callee"], r["call_type"], r["confidence"]) for r in g.edges.collect())
    assert e == sorted([
        ("run", "step", "direct", 1.0), ("run", "stop", "direct", 1.0), ("stop", "m.other", "direct", 0.7), ("step", "leaf", "direct", 1.0), ("step", "step", "recursive", 1.0),
        ("step", "<builtin>.print", "direct", 0.9), ("step", "os.os.path.join", "direct", 0.7), ("leaf", "unknown", "direct", 0.3), ("uses", "leaf", "direct", 1.0),
    ])
    assert {r["name"] for r in g.entry_points.collect()} == {"uses", "run", "Job.run"}
    assert {(r["callee"], r["calls"]) for r in g.external_calls().collect()} == {("m.other", 1), ("<builtin>.print", 1), ("os.os.path.join", 1), ("unknown", 1)}
    assert [r["call_expression"] for r in g.unresolved().collect()] == ["unknown()"]
    strict = callgraph.graph(from_strings(spark, GRAPH), strict=True)
    assert {r["qualified_name"] for r in strict.symbols.collect()} == {"Job.run", "Job.stop", "step", "leaf", "uses"}


def test_nested_definitions(spark):
    code = "class A:\n    def m(self):\n        def inner():\n            pass\n"
    g = callgraph.graph(from_strings(spark, code))
    assert [r["qualified_name"] for r in g.symbols.orderBy("ord").collect()] == ["A.m", "A..m.inner", "A.inner", "m", "m.inner", "inner"]
    ten = "\n".join("    " * i + f"def f{i}():" for i in range(10)) + "\n" + "    " * 10 + "pass\n"
    assert callgraph.graph(from_strings(spark, ten)).symbols.count() == 2**10 - 1
    deep = "\n".join("    " * i + f"def f{i}():" for i in range(16)) + "\n" + "    " * 16 + "pass\n"
    made = facts(from_strings(spark, deep), ["symbols", "errors"]).first()
    assert len({s["name"] for s in made["symbols"]}) == 16 and [e["stage"] for e in made["errors"]] == ["symbols"]


def table(spark, pairs, names=None):
    names = names or list(dict.fromkeys(x for p in pairs for x in p))
    s = spark.createDataFrame([("g", n, i) for i, n in enumerate(names)], "path string, qualified_name string, ord int")
    return s, spark.createDataFrame([("g", a, b, i) for i, (a, b) in enumerate(pairs)], "path string, caller string, callee string, ord int")


def test_analytics_on_an_edge_table(spark):
    s, e = table(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("a", "d"), ("a", "d"), ("d", "x")], ["a", "b", "c", "d", "e"])
    reached = analytics.reach(s, e, spark.createDataFrame([("g", "a"), ("g", "zz")], "path string, entry string"))
    assert {(r["name"], r["dist"]) for r in reached.collect()} == {("a", 0), ("b", 1), ("d", 1), ("c", 2)}
    assert {r["name"] for r in analytics.dead_code(s, reached).collect()} == {"e"}
    assert {(r["caller"], r["callee"]) for r in analytics.reach_tree(s, e, reached).collect()} == {("a", "b"), ("b", "c"), ("c", "a"), ("a", "d")}
    assert tuple(analytics.unreachable_share(s, reached).first())[1:] == (4, 1)
    assert {r["name"] for r in analytics.roots(s, e).collect()} == {"e"} == {r["name"] for r in analytics.leaves(s, e).collect()}
    d = {r["name"]: (r["in_degree"], r["out_degree"]) for r in analytics.degrees(s, e).collect()}
    assert d == {"a": (1, 3), "b": (1, 1), "c": (1, 1), "d": (2, 0), "e": (0, 0)}
    i = {r["name"]: r for r in analytics.impact(s, e).collect()}
    assert i["c"]["direct_callers"] == ["b"] == i["c"]["potential_dead_code"] and i["c"]["impact_score"] == 2 and i["c"]["is_critical"]
    assert i["d"]["potential_dead_code"] == [] and not i["d"]["is_critical"]
    assert [r["cycle"] for r in analytics.cycles(s, e).collect()] == [["a", "b", "c", "a"]]
    assert [r["members"] for r in analytics.components(s, e, strict=True).collect()] == [["a", "b", "c"]]
    assert [sorted(r["members"]) for r in analytics.components(s, e).collect()] == [["a", "b", "c", "d"]]
    assert analytics.shortest_path(s, e, "b", "d").first()["nodes"] == ["b", "c", "a", "d"]
    assert analytics.shortest_path(s, e, "d", "d").count() == 0
    assert len(analytics.all_paths(s, e, "a", "d").collect()) == 2
    assert [r["chain"] for r in analytics.call_chains(s, e, ["b"], 10).orderBy("number").collect()] == [["b"], ["b", "c"], ["b", "c", "a"], ["b", "c", "a", "d"]]
    cut = analytics.call_chains(s, e, ["b"], 2).orderBy("number").collect()
    assert [r["chain"] for r in cut] == [["b"], ["b", "c"]] and all(r["more"] for r in cut)
    b = {r["name"]: r["betweenness"] for r in analytics.betweenness(s, e).collect()}
    assert b["a"] == pytest.approx(3 / 25) and b["e"] == 0
    assert analytics.critical(s, e, 1).first()["name"] == "a"
    none = e.filter("false")
    assert analytics.reach(s, none, spark.createDataFrame([("g", "a")], "path string, entry string")).count() == 0
    assert analytics.reach(s, none, spark.createDataFrame([("g", "a")], "path string, entry string"), strict=True).count() == 1


def test_long_chains_are_reached(spark):
    s, e = table(spark, [(f"n{i}", f"n{i + 1}") for i in range(25)])
    got = analytics.reach(s, e, spark.createDataFrame([("g", "n0")], "path string, entry string"))
    assert {r["name"]: r["dist"] for r in got.collect()} == {f"n{i}": i for i in range(26)}


def paths(spark, strict):
    return {(r["func"], r["source"], r["sink"], r["sink_type"], r["is_sanitized"]) for r in taint.taint_paths(taint.analyse(from_strings(spark, FLOWS), strict=strict)).collect()}


def test_taint_compatible(spark):
    assert paths(spark, False) == {
        ("direct", "a", "system", "command_exec", False), ("cleaned", "b", "system", "command_exec", True),
        ("branch", "a", "open", "path_traversal", False), ("reset", "a", "system", "command_exec", False),
    }


def test_taint_strict(spark):
    assert paths(spark, True) == {("direct", "a", "os.system", "command_exec", False), ("branch", "a", "open", "path_traversal", False), ("caught", "a", "os.system", "command_exec", False)}


def test_classification_by_expressions(spark):
    rows = [("system", "os.system", "os"), ("run_query", "db.run_query", None), ("execute", "cursor.execute", None), ("fetch", "api.fetch", None), ("getvalue", "x.getvalue", "flask.wrappers"), ("print", "print", None)]
    df = spark.createDataFrame(rows, "fn string, qn string, module string")
    fn, qn, m = F.col("fn"), F.col("qn"), F.col("module")
    got = df.select("fn", C.sink(fn, qn, m)["type"].alias("compat"), C.sink(fn, qn, m, strict=True)["type"].alias("strict"), C.source(fn, qn, m)["type"].alias("source"), C.sanitizer(fn, qn)["name"].alias("clean"), C.guessed_sanitizer(fn)["type"].alias("guess"), F.array_join(C.module_categories(m), ",").alias("cats"))
    r = {x["fn"]: x for x in got.collect()}
    assert r["system"]["compat"] is None and r["system"]["strict"] == "command_exec" and r["system"]["cats"] == "command_execution"
    assert r["run_query"]["compat"] == "sql_exec" and r["execute"]["strict"] == "sql_exec" and r["execute"]["compat"] is None
    assert r["fetch"]["compat"] == "http_request" and r["fetch"]["source"] == "network_read"
    assert r["getvalue"]["cats"] == "web_framework" and r["print"]["clean"] == "int"


def test_imports_and_objects(spark):
    d = from_strings(spark, "import os, json, subprocess as sp\nfrom flask import request\ndef f(p):\n    with open(p) as g, socket.socket() as s, lock:\n        pass\n")
    assert {r["module"] for r in taint.dangerous_imports(d).collect()} == {"os", "subprocess"}
    m = {(r["alias"], r["name"], r["module"]) for r in taint.module_imports(d).collect()}
    assert ("sp", None, "subprocess") in m and (None, "request", "flask") in m and (None, "flask", "flask") in m
    assert {(r["variable"], r["object"]) for r in taint.io_objects(d).collect()} == {("g", "file"), ("s", "socket")}


def test_catalogue_lookups_and_names(spark):
    from codeloom.functions import catalog as K

    assert [e.name for e in K.entries_of(K.SOURCES, kind="env_var")] == ["os.environ"] and len(K.entries_of(K.SINKS, label="critical")) == 2
    assert K.severity_of("eval") == "critical" and K.severity_of("nothing") == "medium"
    assert K.trusts(K.entry_named(K.SINKS, "os.path.join"), 1) and not K.trusts(K.entry_named(K.SINKS, "eval"), 1)
    assert K.effective(K.entry_named(K.SANITIZERS, "shlex.quote"), {"env"}) and not K.effective(K.entry_named(K.SANITIZERS, "int"), {"file"})
    assert {"os", "io", "logging"} <= K.all_modules()
    df = spark.createDataFrame([("sp", "sp.run", {"sp": "subprocess"}, {"quote": "shlex"}), ("quote", "quote", {}, {"quote": "shlex"}), ("z", "z.q", {}, {})], "n string, qn string, a map<string,string>, f map<string,string>")
    got = df.select(C.module_of(F.col("qn"), F.col("a"), F.col("f")), C.resolved_name(F.col("n"), F.col("a"), F.col("f"))).collect()
    assert [tuple(r) for r in got] == [("subprocess", "subprocess"), ("shlex", "shlex.quote"), (None, "z")]
    d = from_strings(spark, "def f(p):\n    with open(p) as g, open(p) as h:\n        pass\n")
    assert tuple(taint.io_object_counts(d).first())[1:] == ("file", 2)


def test_own_catalogue_entries(spark):
    from codeloom.functions.catalog import SINKS, SOURCES, Entry

    code = "def f():\n    a = fetch_all()\n    launch(1, a)\n"
    sources = (*SOURCES, Entry("fetch_all", None, "network_read", "network", ("fetch_all",)))
    sinks = (*SINKS, Entry("launch", None, "command_exec", "critical", ("launch",), params=(1,)))
    got = taint.taint_paths(taint.analyse(from_strings(spark, code), strict=True, heuristics=False, sources=sources, sinks=sinks)).collect()
    assert [(r["source"], r["sink"], r["labels"], r["severity"]) for r in got] == [("a", "launch", ["network"], "critical")]


def test_reports(spark, tmp_path):
    files = from_strings(spark, [("a.py", RISKY), ("b.py", "x = 1\n"), ("c.py", "def (")])
    rules = load_dir().rules
    f = scan.scan(files, rules)
    r = scan.file_results(files, f, len(rules))
    t = reports.totals(r).first()
    assert (t["files_scanned"], t["total_findings"], t["clean_files"], t["has_high_severity"]) == (3, 4, 2, True)
    a, b, merged = (str(tmp_path / n) for n in ("a.json", "b.json", "s.sarif"))
    reports.write_json(r, f, a)
    reports.write_json(r.filter("path = 'a.py'"), f, b)
    assert reports.valid_json(a) and not reports.valid_json(merged)
    doc = json.loads(open(a).read())
    assert doc["summary"]["findings_by_severity"] == {"critical": 0, "high": 2, "medium": 2, "low": 0} and len(doc["results"]) == 3
    m = reports.merge_reports(spark, [a, b])
    assert m["scan_info"]["files_scanned"] == 4 and m["scan_info"]["total_findings"] == 8
    reports.write_sarif(r, f, rules, merged)
    assert reports.valid_sarif(merged)
    run = json.loads(open(merged).read())["runs"][0]
    assert len(run["results"]) == 4 and {x["level"] for x in run["results"]} == {"error", "warning"} and len(run["tool"]["driver"]["rules"]) == 4
    assert "PY.OS.SYSTEM" in reports.text_report(r, f) and "PY.HASH.WEAK" not in reports.text_report(r, f, "high")
    assert [x["rule_id"] for x in reports.by_rule(f).collect()][:2] == ["PY.OS.SYSTEM", "PY.SUBPROCESS.SHELL"]
    assert json.loads(json.dumps(reports.empty_sarif()))["runs"][0]["results"] == []
    an = taint.analyse(from_strings(spark, FLOWS))
    d = json.loads(reports.taint_documents(an).first()["document"])
    assert d["summary"]["total_paths"] == len(d["paths"]) == 4
    assert "(sanitized: shlex.quote)" in reports.taint_text(taint.taint_paths(an))
    assert {x["severity"]: x["paths"] for x in taint.by_severity(taint.taint_paths(an)).collect()} == {"high": 4}


def test_graph_documents(spark):
    import xml.etree.ElementTree as ET

    g = callgraph.graph(from_strings(spark, GRAPH))
    reached = analytics.reach(g.symbols, g.edges, analytics.default_entries(g.symbols, g.edges, g.entry_points))
    dot = exports.dot(g, reached, exports.Options(parameters=True, clustering=True)).first()["document"]
    assert dot.startswith("digraph") and '"step" -> "step" [color=red, style=bold, label="14"];' in dot and 'label="run(self)"' in dot
    j = json.loads(exports.graph_json(g, reached).first()["document"])
    assert j["statistics"]["total_edges"] == 9 - 1 + 1 and j["statistics"]["entry_points"] == 3
    assert {n["id"] for n in j["nodes"] if n["type"] == "external"} == {"m.other", "os.os.path.join", "unknown"}
    x = ET.fromstring(exports.graphml(g, reached).first()["document"].encode())
    assert len([n for n in x.iter() if n.tag.endswith("}edge")]) == 5
    c = json.loads(exports.cytoscape(g, reached).first()["document"])
    assert len(c["elements"]) == 12
    only = json.loads(exports.graph_json(g, reached, exports.Options(only_reachable=True, include_external=False)).first()["document"])
    assert {n["id"] for n in only["nodes"]} == {r["name"] for r in analytics.reachable(reached).collect()}


def test_paths_on_disk_and_a_stream(spark, tmp_path):
    from codeloom.streaming.watch import counts_by_window, stream_findings, watch

    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.py").write_text(RISKY)
    (tmp_path / "in" / "deep" / "b.py").write_text("import os\nos.popen('x')\n")
    (tmp_path / "in" / "c.txt").write_text("no")
    assert read_path(spark, str(tmp_path / "in")).count() == 2
    assert read_path(spark, str(tmp_path / "in" / "a.py")).count() == 1
    with pytest.raises(ValueError, match="no Python"):
        read_path(spark, str(tmp_path / "in" / "c.txt"))
    files = watch(spark, str(tmp_path / "in"))
    for name, df, mode in (("found", stream_findings(files, load_dir().rules).select("rule_id"), "append"), ("counted", counts_by_window(files, load_dir().rules), "complete")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert spark.table("found").count() == 5
    assert spark.table("counted").agg(F.sum("findings")).first()[0] == 5


def test_command_line(spark, tmp_path, capsys):
    from codeloom.cli import main

    folder = str(tmp_path / "demo")
    assert main(["demo", folder]) == 0
    assert main(["scan", folder, "--format", "text"]) == 1
    assert "PY.OS.SYSTEM" in capsys.readouterr().out
    assert main(["scan", folder + "/secure.py", "--format", "json", "-o", str(tmp_path / "r.json")]) == 0
    assert main(["taint", folder]) == 1
    assert main(["graph", folder, "--format", "dot", "-o", str(tmp_path / "g.dot")]) == 0
    assert main(["analyze", folder, "--cycles", "--dead-code", "--critical", "2", "-o", str(tmp_path / "a.json")]) == 0
    assert json.loads((tmp_path / "a.json").read_text())["statistics"]
    assert main(["rules", "--severity", "medium"]) == 0
    assert main(["validate", folder]) == 0
    assert main(["scan", str(tmp_path / "none")]) == 2


@pytest.mark.parametrize("strict", [False, True])
def test_plain_and_column_classification_agree(spark, strict):
    """Over every name, pattern and word of the catalogues, in modules of every kind."""
    names = {x for e in (*K.SOURCES, *K.SINKS, *K.SANITIZERS) for x in (e.name, e.qualified or "", *e.patterns)}
    names |= {w for words in (*K.SINK_WORDS.values(), *K.SOURCE_WORDS.values()) for w in words} | {f"{m}.thing" for m in K.DANGEROUS} | {"", "plain", "Run_Query", "pickle.load", "marshal.loads", "os.path.exists"}
    modules = [None, "os", "sqlite3", "flask.app", "requests", "jinja2", "yaml", "code", "harmless"]
    rows = [(n.rsplit(".", 1)[-1], n, m) for n in sorted(names) for m in modules]
    df = spark.createDataFrame(rows, "fn string, qn string, module string")
    fn, qn, m = F.col("fn"), F.col("qn"), F.col("module")
    got = df.select(C.source(fn, qn, m).alias("source"), C.sink(fn, qn, m, strict=strict).alias("sink"), C.sanitizer(fn, qn).alias("sanitizer"), C.semantic_sink(fn, qn).alias("structure"), C.source_access(qn).alias("access")).collect()
    judge = Judge(K.SOURCES, K.SINKS, K.SANITIZERS, True, strict)
    plain = lambda r: None if r is None else r.asDict()
    for (f, q, mod), r in zip(rows, got, strict=True):
        assert plain(r["source"]) == judge.source(f, q, mod), (f, q, mod)
        assert plain(r["sink"]) == judge.sink(f, q, mod), (f, q, mod)
        assert plain(r["sanitizer"]) == judge.sanitizer(f, q), (f, q)
        assert plain(r["structure"]) == semantic_sink(f, q), (f, q)
        assert r["access"] == judge.access(q), q


def test_plain_and_column_structure_agree(spark):
    texts = [("subscript", "sys.argv[1]", "sys.argv", None, None), ("subscript", "argv[0]", "argv", None, None), ("subscript", "os.environ['a']", "os.environ", None, None), ("call", "os.getenv('a')", None, "getenv", "os.getenv"), ("call", "sys.stdin.read()", None, "read", "sys.stdin.read"), ("attribute", "request.args", None, None, None), ("call", "INPUT()", None, "INPUT", "INPUT"), ("identifier", "request.args", None, None, None), ("call", "f()", None, "f", "f")]
    df = spark.createDataFrame(texts, "kind string, text string, base string, fn string, qn string")
    c = [F.col(x) for x in df.columns]
    got = df.select(C.semantic_source(*c, False).alias("a"), C.semantic_source(*c, True).alias("b")).collect()
    assert [tuple(r) for r in got] == [(semantic_source(*t, False), semantic_source(*t, True)) for t in texts]
    calls = [("execute", ["'a %s'", "x"]), ("execute", ["'a %s'"]), ("execute", ["'a ?'"]), ("execute", ["f\"a ?\""]), ("execute", ["'%d and %s'"]), ("Execute", []), ("executemany", ["q", "v"]), ("run", ["'?'"])]
    df = spark.createDataFrame([(f, a) for f, a in calls], "fn string, args array<string>")
    got = [r[0] for r in df.select(C.parameterised(F.col("fn"), F.size("args"), F.try_element_at("args", F.lit(1)))).collect()]
    assert got == [parameterised(f, a) for f, a in calls]
