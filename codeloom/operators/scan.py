"""Rule scan: rules compiled to boolean Columns, evaluated over one pass of candidate nodes.

The files are parsed once; only node kinds that some rule can match are
emitted. Every node gets the array of (rule, pattern) pairs it matches, and
only nodes with a match are exploded and joined with the rules, which are a
bounded, driver-made table. The pass is narrow: no shuffle before the reports.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from py4j.protocol import Py4JJavaError
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.catalog import SEVERITIES
from codeloom.functions.classify import any_of
from codeloom.functions.text import remediation, unquoted
from codeloom.sources.facts import IMPORTS, facts
from codeloom.sources.rules import Argument, Pattern, Rule, pick

CANDIDATES = {"call": ("call",), "assignment": ("assignment", "augmented_assignment"), "import": IMPORTS, "string_literal": ("string",)}


def java_regex(pattern: str) -> str:
    """A Python pattern as Java reads it: named groups, text ends, brackets inside character classes, Unicode classes, and the newline as the only line end."""
    unicode = True
    if m := re.match(r"\(\?([aiLmsux]+)\)", pattern):
        unicode = "a" not in m.group(1)
        rest = "".join(c for c in m.group(1) if c in "imsx")
        pattern = (f"(?{rest})" if rest else "") + pattern[m.end() :]
    out, i, inside = ["(?dU)" if unicode else "(?d)"], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            out.append("\\z" if pattern[i + 1] == "Z" else pattern[i : i + 2])
            i += 2
            continue
        if not inside and pattern.startswith("(?P<", i):
            out.append("(?<")
            i += 4
            continue
        if not inside and (m := re.match(r"\(\?P=(\w+)\)", pattern[i:])):
            out.append(rf"\k<{m.group(1)}>")
            i += m.end()
            continue
        if inside and c == "[":
            out.append("\\[")
        elif inside and c == "&" and pattern.startswith("&&", i):
            out.append("\\&")
        else:
            out.append(c)
        if c == "[" and not inside:
            inside = True
            if pattern.startswith("^", i + 1):
                out.append("^")
                i += 1
            if pattern.startswith("]", i + 1):
                out.append("\\]")
                i += 1
        elif c == "]" and inside:
            inside = False
        i += 1
    return "".join(out)


def regexes(rule: Rule) -> list[str]:
    return [x for p in rule.patterns for x in (p.regex, *(a.regex for a in (p.callee.args if p.callee else ()))) if x]


def rule_errors(spark: SparkSession, rules: Iterable[Rule]) -> dict[str, str]:
    """rule_id -> what is wrong, of rules with a pattern that Python or the executors' Java can't compile: these are not applied, the others are."""
    out: dict[str, str] = {}
    for r in rules:
        for pattern in regexes(r):
            try:
                re.compile(pattern)
                spark._jvm.java.util.regex.Pattern.compile(java_regex(pattern))
            except (re.error, RecursionError) as e:
                out.setdefault(r.id, f"Error applying rule {r.id}: {e}")
            except (Py4JJavaError, IllegalArgumentException) as e:
                why = str(e.java_exception.getMessage() if isinstance(e, Py4JJavaError) else e).splitlines()[0]
                out.setdefault(r.id, f"Error applying rule {r.id}: not a pattern of Java's: {why}")
    return out


def argument_holds(kw: Column, a: Argument) -> Column:
    """Whether a call's keyword arguments pass a test: presence first, then the first of equals, contains and regex decides."""
    if not a.name:
        return F.lit(True)
    value = F.element_at(kw, F.lit(a.name))
    there = value.isNotNull()
    present = there == F.lit(a.present) if a.present is not None else F.lit(True)
    if a.equals is not None:
        t = F.trim(value)
        if isinstance(a.equals, bool):
            test = F.lower(t) == str(a.equals).lower()
        elif isinstance(a.equals, str):
            quoted = t.rlike("(?s)^['\"]") & t.rlike("(?s)['\"]$")
            test = F.when(quoted, F.substring(t, F.lit(2), F.greatest(F.length(t) - 2, F.lit(0)))).otherwise(t) == a.equals
        else:
            test = t == str(a.equals)
    elif a.contains is not None:
        test = value.contains(a.contains)
    elif a.regex is not None:
        test = value.rlike(java_regex(a.regex))
    else:
        return present
    return present & there & F.coalesce(test, F.lit(False))


def pattern_holds(p: Pattern, node: Column | None = None) -> Column:
    """A pattern as a condition on a node's columns type, text, fn, qn, kw, names, or on a struct of these."""
    kind, text, fn, qn, kw, names = (F.col(c) if node is None else node[c] for c in ("type", "text", "fn", "qn", "kw", "names"))
    no = F.lit(False)
    if p.kind == "call":
        c = p.callee
        if c is None:
            return (kind == "call") & (fn == p.name) if p.name else no
        tests = [kind == "call"]
        if c.name:
            tests.append(fn == c.name)
        if c.qualified_name:
            tests.append(qn == c.qualified_name)
        if c.any_of:
            tests.append(qn.isin(*c.any_of) | fn.isin(*c.any_of))
        if c.module:
            tests.append(qn.startswith(c.module + "."))
        tests += [argument_holds(kw, a) for a in c.args]
        out = tests[0]
        for t in tests[1:]:
            out = out & t
        return out
    if p.kind == "assignment":
        return kind.isin(*CANDIDATES["assignment"]) & text.contains(p.name) if p.name else no
    if p.kind == "import":
        return kind.isin(*IMPORTS) & F.array_contains(names, p.name) if p.name else no
    if p.kind == "string_literal":
        if p.name:
            return (kind == "string") & unquoted(text).contains(p.name)
        return (kind == "string") & text.rlike(java_regex(p.regex)) if p.regex else no
    return text.rlike(java_regex(p.regex)) if p.regex else no


def matches(files: DataFrame, patterns: list[Pattern]) -> DataFrame:
    """Nodes (path, id, type, ...) that any of the patterns hits, each once, in the order of the text."""
    return _candidates(files, patterns).filter(any_of(F.coalesce(pattern_holds(p), F.lit(False)) for p in patterns)).orderBy("path", "id")


def _candidates(files: DataFrame, patterns: Iterable[Pattern]) -> DataFrame:
    kinds = {p.kind for p in patterns}
    types = None if "regex" in kinds else {t for k in kinds for t in CANDIDATES[k]}
    made = facts(files, ["nodes"], kinds=types, want=("text", "snippet"))
    return made.select("path", F.explode("nodes").alias("x")).select("path", "x.*")


def scan(files: DataFrame, rules: list[Rule], ids: Iterable[str] | None = None, min_severity: str | None = None, exclude: Iterable[str] = (), strict: bool = False) -> DataFrame:
    """Findings of all files: one row for each node and pattern that match (in strict mode for each node and rule).

    Columns: path, rule_id, title, severity, sev_rank, message, pattern, the
    1-based place, the byte span, code_snippet, confidence, remediation,
    node_type, node_text (100 characters) and rule_tags. Files without a tree
    give none; see ``scan_errors``. Rules that can't be applied are left out;
    see ``rule_errors``.
    """
    spark = files.sparkSession
    active = pick(rules, ids, min_severity, exclude)
    bad = rule_errors(spark, active)
    active = [r for r in active if r.id not in bad]
    pairs = [(i, j, p) for i, r in enumerate(active) for j, p in enumerate(r.patterns)]
    nodes = _candidates(files, [p for _, _, p in pairs] or [Pattern("call")])
    if strict:
        hits = [F.when(any_of(F.coalesce(pattern_holds(p), F.lit(False)) for p in r.patterns), F.struct(F.lit(i).alias("rule"), F.lit(0).alias("pattern"))) for i, r in enumerate(active)]
    else:
        hits = [F.when(F.coalesce(pattern_holds(p), F.lit(False)), F.struct(F.lit(i).alias("rule"), F.lit(j).alias("pattern"))) for i, j, p in pairs]
    if not hits:
        hits = [F.lit(None).cast("struct<rule:int,pattern:int>")]
    found = nodes.withColumn("hit", F.explode(F.array_compact(F.array(*hits))))
    # A row for each rule, made on the driver: bounded by the rule files, not by the data.
    rows = [(i, r.id, r.title, r.severity, r.rank, r.message, list(r.tags or ()), (r.examples or {}).get("good")) for i, r in enumerate(active)]
    table = spark.createDataFrame(rows, "rule int, rule_id string, title string, severity string, sev_rank int, message string, tags array<string>, good string")
    return found.join(F.broadcast(table), F.col("hit.rule") == F.col("rule")).select(
        "path", "rule_id", "title", "severity", "sev_rank", "message", F.col("hit.pattern").alias("pattern"), F.col("id").alias("node_id"),
        (F.col("sl") + 1).alias("start_line"), (F.col("sc") + 1).alias("start_column"), (F.col("el") + 1).alias("end_line"), (F.col("ec") + 1).alias("end_column"),
        F.col("sb").alias("start_byte"), F.col("eb").alias("end_byte"), F.col("snippet").alias("code_snippet"), F.lit(1.0).alias("confidence"),
        remediation(F.col("rule_id"), F.col("good")).alias("remediation"), F.col("type").alias("node_type"),
        F.substring("text", 1, 100).alias("node_text"), F.col("tags").alias("rule_tags"),
    )


def scan_errors(files: DataFrame) -> DataFrame:
    """(path, stage, message, line, column) of files that have no tree, and of lines (stage ``partial``) that have none in files that have one."""
    return facts(files, ["errors"]).select("path", F.explode("errors").alias("e")).select("path", "e.*")


def _treeless() -> Column:
    """Whether a file's errors say that it has no tree."""
    return F.exists("errors", lambda e: ~e["stage"].isin("partial", "symbols"))


def file_results(files: DataFrame, findings: DataFrame, rules: int | list[Rule], timed: bool = False) -> DataFrame:
    """A row for each file: its findings by severity and in all, how many rules were applied, and its errors, those of rules that can't be applied among them.

    timed: with scan_time_ms, what building the file's tree took, by far the
    most of its scan; the tree is then built once more.
    """
    bad = [] if isinstance(rules, int) else list(rule_errors(files.sparkSession, rules).values())
    n_rules = rules if isinstance(rules, int) else len(rules)
    counts = findings.groupBy("path").agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES], F.count("*").alias("finding_count"))
    errors = facts(files, ["errors", "parse_ms", "stats"] if timed else ["errors"])
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("finding_count", *SEVERITIES)]
    applied = F.when(_treeless(), 0).otherwise(n_rules).alias("rules_applied")
    time = [F.col("parse_ms").alias("scan_time_ms")] if timed else []
    return errors.join(counts, "path", "left").select("path", *zero, applied, *time, F.when(F.size("errors") > 0, F.col("errors.message")).otherwise(F.array(*[F.lit(b) for b in bad]).cast("array<string>")).alias("errors"))


def scan_totals(files: DataFrame, rules: list[Rule]) -> DataFrame:
    """What ``file_results`` gives, for those who want no findings: each file is parsed once and its findings counted in its own row, so nothing is shuffled."""
    bad = rule_errors(files.sparkSession, rules)
    active = [r for r in rules if r.id not in bad]
    patterns = [p for r in active for p in r.patterns] or [Pattern("call")]
    types = None if any(p.kind == "regex" for p in patterns) else {t for p in patterns for t in CANDIDATES[p.kind]}
    made = facts(files, ["nodes", "errors"], kinds=types, want=("text",))
    hits = lambda n, s: sum((F.coalesce(pattern_holds(p, n), F.lit(False)).cast("int") for r in active if r.severity == s for p in r.patterns), F.lit(0))
    per = F.aggregate("nodes", F.array(*[F.lit(0)] * len(SEVERITIES)), lambda a, n: F.zip_with(a, F.array(*[hits(n, s) for s in SEVERITIES]), lambda x, y: x + y))
    counted = made.select("path", per.alias("__n"), _treeless().alias("__bad"), F.col("errors.message").alias("errors"))
    by = [F.coalesce(F.col("__n")[i], F.lit(0)).cast("long").alias(s) for i, s in enumerate(SEVERITIES)]
    applied = F.when(F.col("__bad"), 0).otherwise(len(rules)).alias("rules_applied")
    out = counted.select("path", *by, applied, F.when(F.size("errors") > 0, F.col("errors")).otherwise(F.array(*[F.lit(b) for b in bad.values()]).cast("array<string>")).alias("errors"))
    return out.select("path", sum((F.col(s) for s in SEVERITIES), F.lit(0)).cast("long").alias("finding_count"), *SEVERITIES, "rules_applied", "errors")
