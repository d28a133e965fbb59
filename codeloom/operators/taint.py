"""Taint analysis within functions: from sources of untrusted data, past sanitizers, to sinks.

One narrow pass and no shuffle: inside an Arrow batch a file is parsed, the
calls of its functions' statements are classified (each distinct call once a
task) and a fold over each function's statements follows the variables. Only
what was found leaves the pass.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions import catalog as K
from codeloom.functions import classify as C
from codeloom.functions.catalog import Entry
from codeloom.functions.judge import Judge, parameterised, semantic_source
from codeloom.sources.facts import File, call_arguments, facts, function_name, per_file, qualified_name

EDGE = "struct<from_var:string,to_var:string,operation:string,line:int,preserves_taint:boolean,sanitizer:string>"
PATHS = (
    "array<struct<func:string,func_id:int,source:string,source_type:string,source_location:string,source_line:int,sink:string,sink_type:string,sink_line:int,"
    f"labels:array<string>,path_edges:array<{EDGE}>,is_sanitized:boolean,sanitizers:array<string>,severity:string,confidence:double>>"
)
FLOWS = "array<struct<func_id:int,seq:int,from_var:string,to_var:string,operation:string,line:int,preserves_taint:boolean,sanitizer:string>>"


def count_calls(file: File, judge: Judge) -> tuple[int, int, int]:
    """sources_found, sinks_found and sanitizers_found of a file."""
    sources = sinks = sanitizers = 0
    for n in file.all:
        if n.type == "call":
            fn, qn = function_name(n), qualified_name(n)
            sources += judge.source(fn, qn) is not None
            sinks += judge.sink(fn, qn) is not None
            sanitizers += judge.sanitizer(fn, qn) is not None
            sanitizers += "execute" in fn.lower() and parameterised(fn, [a.text for a in call_arguments(n)])
    for a in file.accesses():
        sources += judge.access(a["text"]) is not None
    return sources, sinks, sanitizers


def classified(s: dict, judge: Judge) -> dict:
    """A statement with what its expression is: a source by structure or by catalogue, a sanitizer, a sink."""
    r = s["rhs"]
    kind, fn, qn, call = r["type"], r.get("fn"), r.get("qn"), r["type"] == "call"
    about = (kind, r["text"], r["base"], fn, qn)
    return s | {
        "idents": r["idents"], "args": r.get("args"), "is_call": call, "read": semantic_source(*about, False), "read_call": semantic_source(*about, True),
        "source": judge.source(fn, qn, r["module"]) if call else None, "sanitizer": judge.sanitizer(fn, qn) if call else None, "sink": judge.trusted(fn, qn, r["module"]) if call else None,
    }


class Flow:
    """The state of one function: variable -> [labels, line], and what was found so far."""

    def __init__(self, func: str, func_id: int, strict: bool, removed: dict[str, set[str]]) -> None:
        self.func, self.func_id, self.strict, self.removed = func, func_id, strict, removed
        self.state: dict[str, tuple[frozenset[str], int]] = {}
        self.edges: list[dict] = []
        self.paths: list[dict] = []
        self.seq = 0

    def tainted(self, idents: list[str] | None) -> list[str]:
        return [x for x in idents or () if x in self.state and self.state[x][0]]

    def edge(self, a: str, b: str, operation: str, line: int, sanitizer: str | None = None) -> None:
        self.edges.append({"from_var": a, "to_var": b, "operation": operation, "line": line, "preserves_taint": sanitizer is None, "sanitizer": sanitizer, "func_id": self.func_id, "seq": self.seq})

    def mark(self, target: str, label: str, line: int) -> None:
        self.state[target] = frozenset([label]), line

    def merge(self, variables: list[str], target: str) -> None:
        labels = frozenset().union(*(self.state[v][0] for v in variables))
        self.state[target] = labels, *self.state[variables[0]][1:]

    def step(self, s: dict) -> None:
        self.seq = s["seq"]
        op, target, idents = s["op"], s["target"], s["idents"]
        if op == "return":
            for v in self.tainted(idents):
                self.edge(v, "<return>", "return", s["line"])
        elif op == "augment":
            found = self.tainted(idents) + ([target] if target in self.state else [])
            if any(self.state[v][0] for v in found):
                live = [v for v in found if self.state[v][0]]
                self.merge(live, target)
        elif op == "call":
            self.sink(s)
        else:
            self.assign(s, target, idents)

    def assign(self, s: dict, target: str, idents: list[str]) -> None:
        before = self.tainted(idents)
        fresh = False
        if s["read"]:
            self.mark(target, "user", s["line"])
            self.edge(s["read"], target, "source", s["line"])
            fresh = True
        if s["is_call"]:
            line = s["call_line"]
            if s["read_call"]:
                if not (self.strict and s["read"]):
                    self.mark(target, "user", line)
                    self.edge(s["read_call"], target, "source", line)
                fresh = True
            elif s["source"]:
                self.mark(target, s["source"]["label"], line)
                self.edge(s["source"]["name"], target, "source", line)
                fresh = True
            cleaner = s["sanitizer"]
            if cleaner:
                for arg in s["args"] or ():
                    found = self.tainted(arg)
                    if found:
                        if target in self.state:
                            labels, *place = self.state[target]
                            self.state[target] = labels - set(cleaner["removes"]), *place
                        for v in found:
                            self.edge(v, target, "sanitize", line, cleaner["name"])
            self.sink(s)
            if self.strict and cleaner:
                live = [v for v in before if self.state.get(v, (frozenset(),))[0] - set(cleaner["removes"])]
                if live:
                    self.merge(live, target)
                    self.state[target] = self.state[target][0] - set(cleaner["removes"]), *self.state[target][1:]
                elif not fresh and not s["nested"]:
                    self.state.pop(target, None)
                return
        found = self.tainted(idents)
        if found:
            self.merge(found, target)
            for v in found:
                self.edge(v, target, "assignment", s["line"])
        elif self.strict and not fresh and not s["nested"]:
            self.state.pop(target, None)

    def sink(self, s: dict) -> None:
        sink = s["sink"]
        if not sink:
            return
        for i, arg in enumerate(s["args"] or ()):
            if sink["params"] and i not in sink["params"]:
                continue
            for v in self.tainted(arg):
                self.path_to(v, sink, s["call_line"])

    def path_to(self, variable: str, sink: dict, line: int) -> None:
        """A path with the edges that touch the variable; in strict mode all edges that lead to it."""
        labels, source_line = self.state[variable]
        if self.strict:
            wanted, used = {variable}, []
            for e in reversed(self.edges):
                if e["to_var"] in wanted:
                    used.append(e)
                    wanted.add(e["from_var"])
            used.reverse()
        else:
            used = [e for e in self.edges if variable in (e["to_var"], e["from_var"])]
        cleaners = [e["sanitizer"] for e in used if e["sanitizer"]]
        safe = any(not e["preserves_taint"] for e in used) or any(labels & self.removed.get(c, set()) for c in cleaners)
        self.paths.append({
            "func": self.func, "func_id": self.func_id, "source": variable, "source_type": "user_input", "source_line": source_line,
            "sink": sink["name"], "sink_type": sink["type"], "sink_line": line, "labels": sorted(labels), "path_edges": used, "is_sanitized": safe,
            "sanitizers": cleaners, "severity": sink["severity"], "confidence": 0.8,
        })


def count_matches(files: DataFrame, strict: bool = False, heuristics: bool = True, sources: Iterable[Entry] = K.SOURCES, sinks: Iterable[Entry] = K.SINKS, sanitizers: Iterable[Entry] = K.SANITIZERS) -> DataFrame:
    """(path, sources_found, sinks_found, sanitizers_found) of every file, without following any data."""
    judge = Judge(sources, sinks, sanitizers, heuristics, strict)

    def one(file: File | None) -> tuple:
        return count_calls(file, judge) if file else (0, 0, 0)

    return per_file(files, one, "sources_found long, sinks_found long, sanitizers_found long", strict)


def analyse(files: DataFrame, strict: bool = False, heuristics: bool = True, sources: Iterable[Entry] = K.SOURCES, sinks: Iterable[Entry] = K.SINKS, sanitizers: Iterable[Entry] = K.SANITIZERS, counted: bool = True) -> DataFrame:
    """(path, sources_found, sinks_found, sanitizers_found, paths, flows) of every file.

    Without ``counted`` the three counters are null: for those who want paths
    and flows alone.

    Compatible mode keeps the quirks of substring catalogues (an exact sink is
    lost, clean reassignment doesn't clear, paths hold only edges that touch
    their variable); strict mode does without them. A file without a tree has
    no paths and zero counts. Add entries to the catalogues for your own.
    """
    sanitizers = list(sanitizers)
    judge, removed = Judge(sources, sinks, sanitizers, heuristics, strict), {e.name: set(e.removes) for e in sanitizers}
    count = count_calls if counted else lambda file, judge: (None, None, None)

    def one(file: File | None) -> tuple:
        if file is None:
            return (*((0, 0, 0) if counted else (None, None, None)), [], [])
        found: list[dict] = []
        edges: list[dict] = []
        flow: Flow | None = None
        for s in file.stmts():
            if flow is None or flow.func_id != s["func_id"]:
                flow = Flow(s["func"], s["func_id"], strict, removed)
                flow.paths = found
            mark = len(flow.edges)
            flow.step(classified(s, judge))
            edges += flow.edges[mark:]
        return (*count(file, judge), found, edges)

    made = per_file(files, one, f"sources_found long, sinks_found long, sanitizers_found long, paths {PATHS}, flows {FLOWS}", strict)
    # A pass that shares what texts have in common knows no paths.
    return made.withColumn("paths", F.transform("paths", lambda p: p.withField("source_location", F.concat_ws(":", F.coalesce("path", F.lit("None")), p["source_line"]))))


def taint_paths(analysed: DataFrame) -> DataFrame:
    """A row for each path, with its length and the variables it involves."""
    p = analysed.select("path", F.explode("paths").alias("p")).select("path", "p.*")
    touched = F.concat(F.array("source"), F.transform("path_edges", lambda e: e["from_var"]), F.transform("path_edges", lambda e: e["to_var"]))
    return p.withColumn("path_length", F.size("path_edges")).withColumn("variables_involved", F.array_distinct(touched))


def flow_edges(analysed: DataFrame) -> DataFrame:
    return analysed.select("path", F.explode("flows").alias("f")).select("path", "f.*")


def file_summary(analysed: DataFrame) -> DataFrame:
    """Counters of each file: sources, sinks, sanitizers, paths, vulnerable and sanitized ones."""
    safe = F.size(F.filter("paths", lambda p: p["is_sanitized"]))
    return analysed.select("path", "sources_found", "sinks_found", "sanitizers_found", F.size("paths").cast("long").alias("paths"), (F.size("paths") - safe).cast("long").alias("vulnerable"), safe.cast("long").alias("sanitized"))


def by_severity(paths: DataFrame) -> DataFrame:
    """(path, severity, paths) of the four severities, most severe first."""
    rank = F.array_position(F.array(*[F.lit(s) for s in reversed(K.SEVERITIES)]), F.col("severity"))
    return paths.filter(F.col("severity").isin(*K.SEVERITIES)).groupBy("path", "severity").agg(F.count("*").alias("paths")).orderBy("path", rank)


def by_sink_type(paths: DataFrame) -> DataFrame:
    return paths.groupBy("path", "sink_type").agg(F.count("*").alias("paths"))


def module_imports(files: DataFrame) -> DataFrame:
    """(path, alias, module, categories) of imported modules, and of imported names with the module they come from (``name``)."""
    m = facts(files, ["modules"])
    plain = m.select("path", F.explode("modules.aliases").alias("alias", "module")).withColumn("name", F.lit(None).cast("string"))
    named = m.select("path", F.explode("modules.names").alias("name", "module")).withColumn("alias", F.lit(None).cast("string"))
    return plain.unionByName(named).select("path", "alias", "name", "module", C.module_categories(F.col("module")).alias("categories"))


def dangerous_imports(files: DataFrame) -> DataFrame:
    """Distinct (path, module, categories) of imported modules that a category names."""
    return module_imports(files).filter("alias IS NOT NULL").filter(F.size("categories") > 0).select("path", "module", "categories").distinct()


def io_objects(files: DataFrame) -> DataFrame:
    """(path, variable, object) of variables that a with statement binds to a file, socket, response, cursor or process."""
    made = facts(files, ["nodes"], kinds=["with_item"], want=("text",))
    text = made.select("path", F.explode("nodes").alias("n")).select("path", F.col("n.text").alias("text"))
    got = text.select("path", F.regexp_extract("text", r"(?s)^([\w.]+)\s*\(.*\)\s*as\s+([\w.]+)\s*$", 1).alias("qn"), F.regexp_extract("text", r"(?s)^([\w.]+)\s*\(.*\)\s*as\s+([\w.]+)\s*$", 2).alias("variable")).filter("qn <> ''")
    return got.select("path", "variable", C.io_object(F.substring_index("qn", ".", -1), F.col("qn")).alias("object")).filter("object IS NOT NULL")


def io_object_counts(files: DataFrame) -> DataFrame:
    """(path, object, variables): how many variables each kind of object is bound to."""
    return io_objects(files).groupBy("path", "object").agg(F.countDistinct("variable").alias("variables"))
