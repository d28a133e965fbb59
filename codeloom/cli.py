"""Command line: scan, rules, validate, demo, graph, analyze, taint. Exit codes: 0 clean, 1 findings, 2 an error."""

from __future__ import annotations

import argparse
import json
import os
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.catalog import SEVERITIES
from codeloom.operators import analytics, callgraph, scan, taint
from codeloom.plans import exports, reports
from codeloom.runtime import ship
from codeloom.sources.files import read_path
from codeloom.sources.rules import SHIPPED, load_dir, pick, validate_dir

DEMO = {
    "vulnerable.py": "import os\nimport hashlib\n\n\ndef remove():\n    name = input()\n    os.system('rm ' + name)\n\n\ndef digest(text):\n    return hashlib.md5(text)\n\n\nif __name__ == '__main__':\n    remove()\n",
    "secure.py": "import hashlib\nfrom pathlib import Path\n\n\ndef remove(name):\n    Path(name).unlink()\n\n\ndef digest(text):\n    return hashlib.sha256(text)\n",
}


def session() -> SparkSession:
    os.environ.setdefault("PYTHONPATH", str(Path(__file__).resolve().parent.parent))
    spark = SparkSession.builder.appName("codeloom").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def _out(text: str, target: str | None) -> None:
    Path(target).write_text(text, encoding="utf-8") if target else sys.stdout.write(text)


def cmd_scan(a: argparse.Namespace) -> int:
    files = read_path(session(), a.path)
    loaded = load_dir(a.rules)
    rules = pick(loaded.rules, a.rule, a.min_severity, a.exclude)
    findings = scan.scan(files, rules, strict=a.strict).cache()
    results = scan.file_results(files, findings, rules, timed=True).cache()
    target = a.output or f"report.{a.format}"
    if a.format == "json":
        reports.write_json(results, findings, target)
    elif a.format == "sarif":
        reports.write_sarif(results, findings, rules, target)
    else:
        _out(reports.text_report(results, findings), a.output)
    return int(not findings.isEmpty())


def cmd_rules(a: argparse.Namespace) -> int:
    found = load_dir(a.rules).listing(a.severity, a.tag)
    for r in found:
        print(f"{r.severity:<8} {r.id:<28} {r.title} [{', '.join(r.tags or ())}]")
    print(json.dumps(reports.rule_statistics(found)))
    return 0


def cmd_validate(a: argparse.Namespace) -> int:
    v = validate_dir(a.rules)
    print(json.dumps(v, default=list))
    return int(v["error_count"] > 0)


def cmd_demo(a: argparse.Namespace) -> int:
    folder = Path(a.folder)
    folder.mkdir(parents=True, exist_ok=True)
    for name, code in DEMO.items():
        (folder / name).write_text(code, encoding="utf-8")
    return 0


def _graph(a: argparse.Namespace) -> tuple[callgraph.Graph, DataFrame]:
    g = callgraph.graph(read_path(session(), a.path), strict=a.strict)
    entries = analytics.default_entries(g.symbols, g.edges, g.entry_points)
    if getattr(a, "entry", None):
        entries = g.scopes.select("path", F.explode(F.array(*[F.lit(e) for e in a.entry])).alias("entry"))
    return g, analytics.reach(g.symbols, g.edges, entries, strict=a.strict)


def cmd_graph(a: argparse.Namespace) -> int:
    g, reached = _graph(a)
    make = {"dot": exports.dot, "json": exports.graph_json, "graphml": exports.graphml, "cytoscape": exports.cytoscape}[a.format]
    o = exports.Options(include_external=not a.internal, only_reachable=a.reachable, include_unresolved=a.unresolved, layout=a.layout, parameters=a.parameters, clustering=a.clusters)
    _out("\n".join(r["document"] for r in make(g, reached, o).orderBy("path").toLocalIterator()), a.output)
    return 0


def cmd_analyze(a: argparse.Namespace) -> int:
    g, reached = _graph(a)
    parts = {"statistics": analytics.statistics(g, reached)}
    if a.cycles:
        parts["cycles"] = analytics.cycles(g.symbols, g.edges)
    if a.dead_code:
        parts["dead_code"] = analytics.dead_code(g.symbols, reached)
    if a.critical:
        parts["critical"] = analytics.critical(g.symbols, g.edges, a.critical)
    if a.impact:
        parts["impact"] = analytics.impact(g.symbols, g.edges).filter(F.col("name") == a.impact)
    f = Path(a.output).open("w", encoding="utf-8") if a.output else sys.stdout
    try:
        # Row by row: no list of all files' rows is ever held.
        for i, (name, df) in enumerate(parts.items()):
            f.write((",\n" if i else "{") + json.dumps(name) + ": [")
            rows = df.select(F.to_json(F.struct("*")).alias("d"))
            for j, r in enumerate(rows.toLocalIterator()):
                f.write((",\n " if j else "\n ") + r["d"])
            f.write("]")
        f.write("}\n")
    finally:
        if a.output:
            f.close()
    return 0


def cmd_taint(a: argparse.Namespace) -> int:
    analysed = taint.analyse(read_path(session(), a.path), strict=a.strict, heuristics=not a.no_heuristics).cache()
    paths = taint.taint_paths(analysed)
    if a.format == "json":
        _out("[" + ",\n".join(r["document"] for r in reports.taint_documents(analysed).orderBy("path").toLocalIterator()) + "]\n", a.output)
    else:
        _out(reports.taint_text(paths, not a.no_sanitized), a.output)
    return int(not paths.filter("NOT is_sanitized").isEmpty())


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="codeloom", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, run, *, path: bool = True) -> argparse.ArgumentParser:  # noqa: ANN001
        c = sub.add_parser(name)
        c.set_defaults(run=run)
        if path:
            c.add_argument("path")
            c.add_argument("--output", "-o")
            c.add_argument("--strict", action="store_true")
        return c

    c = add("scan", cmd_scan)
    c.add_argument("--rules", default=SHIPPED)
    c.add_argument("--format", choices=["json", "sarif", "text"], default="text")
    c.add_argument("--rule", action="append")
    c.add_argument("--exclude", action="append", default=[])
    c.add_argument("--min-severity", choices=SEVERITIES)
    c = add("rules", cmd_rules, path=False)
    c.add_argument("--rules", default=SHIPPED)
    c.add_argument("--severity", choices=SEVERITIES)
    c.add_argument("--tag")
    add("validate", cmd_validate, path=False).add_argument("rules")
    add("demo", cmd_demo, path=False).add_argument("folder")
    c = add("graph", cmd_graph)
    c.add_argument("--format", choices=["dot", "json", "graphml", "cytoscape"], default="dot")
    c.add_argument("--entry", action="append")
    c.add_argument("--layout", choices=list(exports.LAYOUTS), default="hierarchical")
    for flag in ("--internal", "--reachable", "--unresolved", "--parameters", "--clusters"):
        c.add_argument(flag, action="store_true")
    c = add("analyze", cmd_analyze)
    c.add_argument("--entry", action="append")
    c.add_argument("--cycles", action="store_true")
    c.add_argument("--dead-code", action="store_true")
    c.add_argument("--critical", type=int, default=0)
    c.add_argument("--impact")
    c = add("taint", cmd_taint)
    c.add_argument("--format", choices=["json", "text"], default="text")
    c.add_argument("--no-sanitized", action="store_true")
    c.add_argument("--no-heuristics", action="store_true")
    return p


def main(argv: list[str] | None = None) -> int:
    try:
        a = parser().parse_args(argv)
        return a.run(a)
    except (OSError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
