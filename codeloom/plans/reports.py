"""Reports from findings and taint paths: totals, groupings, JSON, SARIF 2.1.0, plain text, merging.

Rows are turned to JSON by expressions on the executors; the driver only puts
the head and tail of a document around them as they stream by.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from datetime import UTC, datetime
from pathlib import Path
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.catalog import SEVERITIES
from codeloom.sources.rules import Rule

TOOL, VERSION = "codeloom", "0.1.0"
LEVELS = {"critical": "error", "medium": "warning", "low": "note"} | {"high": "error"}
SARIF_SCHEMA = "https://json.schemastore.org/sarif-2.1.0.json"
SINK_LABELS = {
    "command_exec": "Command execution", "code_eval": "Code evaluation", "sql_exec": "SQL execution", "file_write": "File write", "template_render": "Template rendering",
    "http_request": "HTTP request", "serialization": "Deserialization", "log_output": "Log output", "path_traversal": "Path traversal",
}
REPORT = """scan_info struct<tool:string,version:string,timestamp:string,files_scanned:long,total_findings:long>,
 summary struct<findings_by_severity:map<string,long>,has_high_severity:boolean>,
 results array<struct<file:string,finding_count:long,scan_time_ms:double,rules_applied:long,findings:array<struct<rule_id:string,title:string,severity:string,message:string,
 location:struct<file:string,line:int,column:int,end_line:int,end_column:int,byte_offset:struct<start:int,end:int>>,confidence:double,remediation:string,code_snippet:string,metadata:struct<node_type:string,node_text:string,rule_tags:array<string>>>>,errors:array<string>>>"""


def now() -> str:
    return datetime.now(UTC).isoformat().replace("+00:00", "Z")


def severity_counts() -> list[Column]:
    return [F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES]


def by_severity(findings: DataFrame) -> DataFrame:
    """(path, low, medium, high, critical) of files with findings."""
    return findings.groupBy("path").agg(*severity_counts())


def has_findings(findings: DataFrame, at_least: str = "low") -> DataFrame:
    """(path, found): whether a file has a finding at least that severe."""
    return findings.groupBy("path").agg(F.bool_or(F.col("sev_rank") >= SEVERITIES.index(at_least)).alias("found"))


def totals(results: DataFrame) -> DataFrame:
    """One row over file results: files, those without a tree, findings, by severity, whether any is high or critical, files with and without findings, and of timed results their time."""
    sums = [F.coalesce(F.sum(s), F.lit(0)).alias(s) for s in SEVERITIES]
    with_ = F.count_if(F.col("finding_count") > 0)
    unscanned = F.count_if((F.size("errors") > 0) & (F.col("rules_applied") == 0)).alias("unscanned_files")
    time = [F.round(F.sum("scan_time_ms"), 3).alias("total_time_ms"), F.round(F.avg("scan_time_ms"), 3).alias("avg_time_ms")] if "scan_time_ms" in results.columns else []
    out = results.agg(F.count("*").alias("files_scanned"), unscanned, *time, F.coalesce(F.sum("finding_count"), F.lit(0)).alias("total_findings"), *sums, with_.alias("files_with_findings"), F.coalesce(F.sum("rules_applied"), F.lit(0)).cast("long").alias("rules_applied"))
    return out.withColumn("clean_files", F.col("files_scanned") - F.col("files_with_findings")).withColumn("has_high_severity", F.col("high") + F.col("critical") > 0)


def by_rule(findings: DataFrame) -> DataFrame:
    """A row for each rule: count and occurrences by place; most severe and most frequent first."""
    place = F.struct("path", F.col("start_line").alias("line"), F.col("start_column").alias("column"))
    g = findings.groupBy("rule_id").agg(F.min_by(F.struct("title", "severity", "sev_rank"), F.struct("path", "node_id")).alias("x"), F.count("*").alias("count"), F.array_sort(F.collect_list(place)).alias("occurrences"))
    return g.orderBy(F.desc("x.sev_rank"), F.desc("count"), "rule_id").select("rule_id", "x.title", "x.severity", "count", "occurrences")


def rule_statistics(rules: Iterable[Rule]) -> dict:
    rules = list(rules)
    if not rules:
        return {"total_rules": 0}
    tags: dict[str, int] = {}
    for r in rules:
        for t in r.tags or ():
            tags[t] = tags.get(t, 0) + 1
    return {"total_rules": len(rules), "severity_counts": {s: sum(r.severity == s for r in rules) for s in SEVERITIES}, "tag_counts": tags, "rule_ids": [r.id for r in rules]}


def listed(findings: DataFrame, at_least: str = "low") -> DataFrame:
    """Findings at least that severe, by severity and line, as a console shows them."""
    return findings.filter(F.col("sev_rank") >= SEVERITIES.index(at_least)).orderBy(F.desc("sev_rank"), "path", "start_line", "start_column")


def file_documents(results: DataFrame, findings: DataFrame) -> DataFrame:
    """(path, document): the JSON object of each file."""
    location = F.struct(
        F.col("path").alias("file"), F.col("start_line").alias("line"), F.col("start_column").alias("column"), "end_line", "end_column",
        F.struct(F.col("start_byte").alias("start"), F.col("end_byte").alias("end")).alias("byte_offset"),
    )
    meta = F.struct("node_type", "node_text", "rule_tags").alias("metadata")
    one = F.struct("node_id", "rule_id", "title", "severity", "message", location.alias("location"), "confidence", "remediation", "code_snippet", meta)
    grouped = findings.groupBy("path").agg(F.array_sort(F.collect_list(one)).alias("f"))
    none = F.expr("filter(f, x -> false)")
    rows = results.join(grouped, "path", "left")
    slim = F.transform(F.coalesce("f", none, F.array()), lambda x: x.dropFields("node_id"))
    doc = F.struct(F.col("path").alias("file"), "finding_count", *(["scan_time_ms"] if "scan_time_ms" in results.columns else []), "rules_applied", slim.alias("findings"), F.when(F.size("errors") > 0, F.col("errors")).alias("errors"))
    return rows.select("path", F.to_json(doc).alias("document"))


def write_json(results: DataFrame, findings: DataFrame, target: str) -> None:
    """One JSON document of a scan, streamed file by file."""
    t = totals(results).first()
    head = {
        "scan_info": {"tool": TOOL, "version": VERSION, "timestamp": now(), "files_scanned": t["files_scanned"], "total_findings": t["total_findings"]},
        "summary": {"findings_by_severity": {s: t[s] for s in SEVERITIES}, "has_high_severity": t["has_high_severity"]},
    }
    with Path(target).open("w", encoding="utf-8") as f:
        f.write(json.dumps(head)[:-1] + ', "results": [')
        for i, r in enumerate(file_documents(results, findings).orderBy("path").toLocalIterator()):
            f.write(("," if i else "") + "\n" + r["document"])
        f.write("\n]}\n")


def write_json_lines(results: DataFrame, findings: DataFrame, folder: str) -> None:
    """The same file by file, as text written by the executors: for scans too large for one document."""
    file_documents(results, findings).select(F.col("document").alias("value")).write.text(folder)


def valid_json(target: str) -> bool:
    try:
        json.loads(Path(target).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return False
    return True


def merge_reports(spark: SparkSession, paths: list[str]) -> dict:
    """One report of several: results one after the other, counts anew, the head of the first that can be read."""
    docs = spark.read.schema(REPORT + ", _corrupt_record string").option("multiLine", True).json(paths).withColumn("from", F.input_file_name()).filter("scan_info IS NOT NULL OR results IS NOT NULL")
    whole = lambda p: unquote(re.sub(r"^\w+:/*", "/", str(p))) if re.match(r"^\w+:", str(p)) else str(Path(p).absolute())
    heads = {whole(r["from"]): r["scan_info"] for r in docs.select("from", "scan_info").collect()}
    order = [heads[whole(p)] for p in paths if heads.get(whole(p))]
    if not order:
        raise ValueError("no report can be read")
    files = docs.select(F.explode("results").alias("r")).select("r.*")
    found = files.select(F.explode("findings").alias("f")).select("f.severity")
    counts = found.agg(*severity_counts(), F.count("*").alias("n")).first()
    return {
        "scan_info": order[0].asDict() | {"files_scanned": files.count(), "total_findings": counts["n"]},
        "summary": {"findings_by_severity": {s: counts[s] for s in SEVERITIES}, "has_high_severity": counts["high"] + counts["critical"] > 0},
        "results": [json.loads(r[0]) for r in files.select(F.to_json(F.struct("*"))).toLocalIterator()],
    }


def sarif_results(findings: DataFrame) -> DataFrame:
    """(path, node_id, result): each finding as a SARIF result."""
    level = F.lit("warning")
    for s, v in LEVELS.items():
        level = F.when(F.col("severity") == s, v).otherwise(level)
    uri = F.when(F.col("path").rlike("^[a-z]+:"), F.col("path")).otherwise(F.concat(F.lit("file://"), F.when(F.col("path").startswith("/"), "").otherwise("/"), F.col("path")))
    region = F.struct(
        F.col("start_line").alias("startLine"), F.col("start_column").alias("startColumn"), F.col("end_line").alias("endLine"), F.col("end_column").alias("endColumn"),
        F.col("start_byte").alias("charOffset"), (F.col("end_byte") - F.col("start_byte")).alias("charLength"),
    )
    context = F.when(F.length("code_snippet") > 0, F.struct(F.struct(F.col("code_snippet").alias("text")).alias("snippet")))
    physical = F.struct(F.struct(uri.alias("uri")).alias("artifactLocation"), region.alias("region"), context.alias("contextRegion"))
    fixes = F.when(F.col("remediation").isNotNull(), F.array(F.struct(F.struct(F.col("remediation").alias("text")).alias("description"))))
    result = F.struct(
        F.col("rule_id").alias("ruleId"), F.lit(0).alias("ruleIndex"), level.alias("level"), F.struct(F.col("message").alias("text")).alias("message"),
        F.array(F.struct(physical.alias("physicalLocation"))).alias("locations"), fixes.alias("fixes"), F.struct("confidence", "node_type", "node_text", "rule_tags").alias("properties"),
    )
    return findings.select("path", "node_id", F.to_json(result).alias("result"))


def write_sarif(results: DataFrame, findings: DataFrame, rules: Iterable[Rule], target: str) -> None:
    used = {r["rule_id"] for r in findings.select("rule_id").distinct().collect()}
    listed_rules = []
    for r in rules:
        if r.id in used:
            text = r.description or r.message
            one = {"id": r.id, "name": r.id, "shortDescription": {"text": r.title}, "properties": {"tags": list(dict.fromkeys(("security", *(r.tags or ()))))}, "fullDescription": {"text": text}, "defaultConfiguration": {"level": LEVELS[r.severity]}}
            listed_rules.append(one | ({"helpUri": r.references[0]} if r.references else {}))
    at = now()
    with Path(target).open("w", encoding="utf-8") as f:
        f.write('{"version": "2.1.0", "$schema": "' + SARIF_SCHEMA + '", "runs": [{"tool": ')
        f.write(json.dumps({"driver": {"version": VERSION, "name": TOOL, "rules": listed_rules}}))
        f.write(', "invocations": ' + json.dumps([{"endTimeUtc": at, "startTimeUtc": at, "executionSuccessful": True, "properties": {"filesScanned": results.count()}}]))
        f.write(', "results": [')
        for i, r in enumerate(sarif_results(findings).orderBy("path", "node_id").toLocalIterator()):
            f.write(("," if i else "") + "\n" + r["result"])
        f.write('\n], "artifacts": [')
        artifacts = results.select("path", F.to_json(F.struct(F.struct(F.col("path").alias("uri")).alias("location"), F.struct(F.col("rules_applied").alias("rulesApplied"), F.col("finding_count").alias("findingCount"), "errors").alias("properties"))).alias("a"))
        for i, r in enumerate(artifacts.orderBy("path").toLocalIterator()):
            f.write(("," if i else "") + "\n" + r["a"])
        f.write("\n]}]}\n")


def valid_sarif(target: str) -> bool:
    """Whether a file has a SARIF document's version, schema, and runs with a tool and results each."""
    try:
        d = json.loads(Path(target).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return False
    runs = d.get("runs") if isinstance(d, dict) else None
    return bool(runs) and {"version", "$schema"} <= set(d) and all({"tool", "results"} <= set(r) for r in runs)


def empty_sarif() -> dict:
    return {"version": "2.1.0", "$schema": SARIF_SCHEMA, "runs": [{"results": [], "tool": {"driver": {"version": VERSION, "name": TOOL, "rules": []}}}]}


def text_report(results: DataFrame, findings: DataFrame, at_least: str = "low", shown: int | None = None) -> str:
    """The scan as plain text: totals, then findings by severity."""
    t = totals(results).first()
    out = [f"{t['files_scanned']} files ({t['unscanned_files']} could not be read), {t['total_findings']} findings: " + ", ".join(f"{t[s]} {s}" for s in reversed(SEVERITIES))]
    if "scan_time_ms" in results.columns:
        out.append(f"{t['total_time_ms']:.1f} ms in all, {t['avg_time_ms']:.2f} ms a file, {t['rules_applied']} rules applied")
    out.append("")
    rows = listed(findings, at_least)
    for r in (rows if shown is None else rows.limit(shown)).toLocalIterator():
        out.append(f"{r['severity']:<8} {r['path']}:{r['start_line']}:{r['start_column']} {r['rule_id']} {r['message']}")
    return "\n".join(out) + "\n"


def taint_documents(analysed: DataFrame) -> DataFrame:
    """(path, document): a file's taint summary and paths as JSON."""
    p = F.transform("paths", lambda p: F.struct(
        F.struct(p["source"].alias("variable"), p["source_type"].alias("type"), p["source_location"].alias("location"), p["source_line"].alias("line")).alias("source"),
        F.struct(p["sink"].alias("function"), p["sink_type"].alias("type"), p["sink_line"].alias("line")).alias("sink"),
        p["labels"].alias("taint_labels"), p["path_edges"].alias("flow"), p["is_sanitized"].alias("is_sanitized"), p["sanitizers"].alias("sanitizers"), p["severity"].alias("severity"), p["confidence"].alias("confidence"),
    ))
    safe = F.size(F.filter("paths", lambda x: x["is_sanitized"]))
    summary = F.struct(F.col("sources_found"), F.col("sinks_found"), F.col("sanitizers_found"), F.size("paths").alias("total_paths"), (F.size("paths") - safe).alias("vulnerable_paths"), safe.alias("sanitized_paths"))
    return analysed.select("path", F.to_json(F.struct(F.col("path").alias("file_path"), summary.alias("summary"), p.alias("paths"))).alias("document"))


def taint_text(paths: DataFrame, sanitized: bool = True) -> str:
    """Paths as plain text, most severe first."""
    rows = paths if sanitized else paths.filter("NOT is_sanitized")
    rank = F.array_position(F.array(*[F.lit(s) for s in reversed(SEVERITIES)]), F.col("severity"))
    out = []
    for r in rows.filter(F.col("severity").isin(*SEVERITIES)).orderBy("path", rank, "sink_line").toLocalIterator():
        mark = " (sanitized: " + ", ".join(r["sanitizers"]) + ")" if r["is_sanitized"] else ""
        out.append(f"{r['severity']:<8} {r['path']}: {r['source']} (line {r['source_line']}) -> {r['sink']} (line {r['sink_line']}), {SINK_LABELS.get(r['sink_type'], r['sink_type'])}{mark}")
    return "\n".join(out) + ("\n" if out else "")
