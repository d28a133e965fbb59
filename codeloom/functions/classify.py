"""Calls, expressions and modules classified by built-in expressions: CASE chains in the order of the catalogues.

Every function takes and gives Columns, so it runs inside whole-stage codegen
and works on plain columns as well as inside ``transform`` over arrays.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeloom.functions import catalog as K
from codeloom.functions.catalog import Entry


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(or_, conditions, F.lit(False))


def holds(text: Column, words: Iterable[str]) -> Column:
    """Whether text contains any of the words: one pattern of all of them, compiled once, costs less than a test for each."""
    words = list(words)
    return text.rlike("|".join(re.escape(w) for w in words)) if words else F.lit(False)


def cases(branches: list[tuple[Column, Column]]) -> Column:
    """The value of the first true condition; null if none is."""
    if not branches:
        return F.lit(None)
    out = F.when(*branches[0])
    for condition, value in branches[1:]:
        out = out.when(condition, value)
    return out


def entries_match(fn: Column, qn: Column, entries: Iterable[Entry]) -> Column:
    """Whether a call is one of the entries: its last name is an entry's name or pattern, or its full name is qualified so or holds a pattern."""
    entries = list(entries)
    names = list(dict.fromkeys(x for e in entries for x in (e.name, *e.patterns)))
    full = [e.qualified for e in entries if e.qualified]
    patterns = list(dict.fromkeys(p for e in entries for p in e.patterns))
    # A qualified name that holds one of the patterns anyway needs no test of its own.
    full = [q for q in full if not any(p in q for p in patterns)]
    tests = [fn.isin(*names)] if names else []
    if full:
        tests.append(qn.isin(*full))
    return any_of([*tests, holds(qn, patterns)])


def entry_matches(fn: Column, qn: Column, e: Entry) -> Column:
    return entries_match(fn, qn, [e])


def _source(name: Column | str, kind: str, label: str, confidence: float) -> Column:
    name = F.lit(name) if isinstance(name, str) else name
    return F.struct(name.alias("name"), F.lit(kind).alias("type"), F.lit(label).alias("label"), F.lit(confidence).alias("confidence"))


def _sink(name: Column | str, kind: str, severity: str, confidence: float, params: Iterable[int] = (0,)) -> Column:
    name = F.lit(name) if isinstance(name, str) else name
    places = F.array(*[F.lit(p) for p in params]) if params else F.lit(None).cast("array<int>")
    return F.struct(name.alias("name"), F.lit(kind).alias("type"), F.lit(severity).alias("severity"), F.lit(confidence).alias("confidence"), places.alias("params"))


def module_is(module: Column, category: str) -> Column:
    return module.rlike("^(" + "|".join(re.escape(m) for m in K.MODULES[category]) + ")")


def module_categories(module: Column) -> Column:
    """Array of the categories a module's name begins like; empty for a harmless one."""
    return F.array_compact(F.array(*[F.when(module_is(module, c), F.lit(c)) for c in K.TOLD]))


def known_source(fn: Column, qn: Column, entries: Iterable[Entry] = K.SOURCES) -> Column:
    return cases([(entry_matches(fn, qn, e), _source(e.name, e.kind, e.label, K.EXACT)) for e in entries])


def guessed_source(fn: Column, qn: Column, module: Column | None = None) -> Column:
    low, full, w = F.lower(fn), F.lower(qn), K.SOURCE_WORDS
    name = F.when(qn != "", qn).otherwise(fn)
    branches = []
    if module is not None:
        branches += [
            (module_is(module, "web_framework") & holds(full, w["web"]), _source(name, "flask_request", "user", K.CONTEXT)),
            (module_is(module, "network") & holds(low, w["network"]), _source(name, "network_read", "network", K.CONTEXT)),
        ]
    branches += [
        (holds(low, w["input"]), _source(name, "user_input", "user", K.NAME)),
        (holds(full, w["cli"]), _source(name, "sys_argv", "user", K.NAME)),
        (holds(low, w["env"]), _source(name, "env_var", "env", K.NAME)),
        (holds(full, w["web"]), _source(name, "flask_request", "user", K.NAME)),
        (holds(low, w["file"]), _source(name, "file_read", "file", K.WEAK)),
        (holds(low, w["network"]), _source(name, "network_read", "network", K.WEAK)),
    ]
    return cases(branches)


def source(fn: Column, qn: Column, module: Column | None = None, entries: Iterable[Entry] = K.SOURCES, heuristics: bool = True) -> Column:
    """struct(name, type, label, confidence) of a call that brings untrusted data in; null for others."""
    known = known_source(fn, qn, entries)
    return F.coalesce(known, guessed_source(fn, qn, module)) if heuristics else known


def source_access(text: Column, entries: Iterable[Entry] = K.SOURCES) -> Column:
    """Name of the source that an attribute or a subscripted expression stands for; null for others."""
    tests = []
    for e in entries:
        hit = holds(text, e.patterns)
        if e.qualified:
            hit = F.lit(e.qualified).contains(text) | hit
        tests.append((hit, F.lit(e.name)))
    return cases(tests)


def known_sink(fn: Column, qn: Column, entries: Iterable[Entry] = K.SINKS, longest: bool = False) -> Column:
    """The catalogue's sink: the first that matches, or with ``longest`` the one of the longest matching pattern."""
    entries = list(entries)
    if not longest:
        return cases([(entry_matches(fn, qn, e), _sink(e.name, e.kind, e.label, K.EXACT, e.params)) for e in entries])
    flat = [(p, e) for e in entries for p in {e.name, e.qualified or e.name, *e.patterns}]
    flat.sort(key=lambda x: (-len(x[0]), entries.index(x[1]), x[0]))
    return cases([((fn == p) | qn.contains(p), _sink(e.name, e.kind, e.label, K.EXACT, e.params)) for p, e in flat])


def guessed_sink(fn: Column, qn: Column, module: Column | None = None) -> Column:
    low, w = F.lower(fn), K.SINK_WORDS
    name = F.when(qn != "", qn).otherwise(fn)
    make = lambda kind, severity, confidence: _sink(name, kind, severity, confidence)
    branches = []
    if module is not None:
        for category, words, kind, severity in (
            ("command_execution", "command", "command_exec", "high"),
            ("code_evaluation", "code", "code_eval", "critical"),
            ("sql_database", "sql", "sql_exec", "high"),
            ("serialization", "serialization", "serialization", "high"),
            ("template_engine", "template", "template_render", "high"),
        ):
            branches.append((module_is(module, category) & holds(low, w[words]), make(kind, severity, K.CONTEXT)))
    branches += [
        (holds(low, w["command"]) & holds(low, w["sql"]), make("sql_exec", "high", K.NAME)),
        (holds(low, w["command"]), make("command_exec", "high", K.NAME)),
        (holds(low, w["code"]), make("code_eval", "critical", K.NAME)),
        (holds(low, w["sql"]), make("sql_exec", "high", K.NAME)),
        (holds(low, w["write"]), make("file_write", "medium", K.NAME)),
        (holds(low, w["network"]), make("http_request", "medium", K.WEAK)),
        (holds(low, w["template"]), make("template_render", "medium", K.WEAK)),
        (holds(low, w["serialization"]), make("serialization", "high", K.NAME)),
    ]
    return cases(branches)


def sink(fn: Column, qn: Column, module: Column | None = None, entries: Iterable[Entry] = K.SINKS, heuristics: bool = True, strict: bool = False) -> Column:
    """struct(name, type, severity, confidence, params) of a call that trusts its arguments; null for others.

    Compatible mode gives no sink for a call the catalogue knows (there an
    exact match is lost); strict mode gives the catalogue's.
    """
    entries = list(entries)
    guess = guessed_sink(fn, qn, module) if heuristics else F.lit(None)
    if strict:
        return F.coalesce(known_sink(fn, qn, entries, longest=True), guess)
    return F.when(~entries_match(fn, qn, entries), guess)


def sanitizer(fn: Column, qn: Column, entries: Iterable[Entry] = K.SANITIZERS) -> Column:
    """struct(name, type, removes) of a call that makes data safe; null for others."""
    made = lambda e: F.struct(F.lit(e.name).alias("name"), F.lit(e.kind).alias("type"), F.array(*[F.lit(r) for r in e.removes]).alias("removes"))
    return cases([(entry_matches(fn, qn, e), made(e)) for e in entries])


def guessed_sanitizer(fn: Column) -> Column:
    """struct(type, removes, confidence) by the name alone; a library function, no analysis uses it."""
    low, w = F.lower(fn), K.SANITIZER_WORDS
    made = lambda kind, removes, c: F.struct(F.lit(kind).alias("type"), F.array(*[F.lit(r) for r in removes]).alias("removes"), F.lit(c).alias("confidence"))
    escape = holds(low, w["escape"])
    return cases([
        (escape & holds(low, ("html", "xss")), made("html_escape", ["user"], K.NAME)),
        (escape & holds(low, ("cmd", "quote", "shell")), made("shell_escape", ["user", "env"], K.NAME)),
        (escape & holds(low, ("uri", "url")), made("url_encode", ["user"], K.NAME)),
        (escape & holds(low, ("db", "sql")), made("sql_escape", ["user"], K.NAME)),
        (escape, made("generic_escape", ["user"], K.WEAK)),
        (holds(low, w["validation"]), made("validation", ["user"], K.WEAK)),
        (holds(low, w["normalization"]), made("normalization", ["user"], K.WEAK)),
        (holds(low, w["conversion"]), made("type_conversion", ["user"], K.NAME)),
    ])


def parameterised(fn: Column, n_args: Column, first_arg: Column) -> Column:
    """Whether a call is a query with parameters: an execute of two arguments, or of one text with a place-holder and no formatting."""
    t = F.coalesce(first_arg, F.lit(""))
    head = F.substring(t, F.lit(1), F.greatest(F.length(t) - 5, F.lit(0)))
    text = (t.contains("%s") | t.contains("?")) & ~t.contains('f"') & ~t.contains(".format(") & ~head.contains("%")
    return F.lower(fn).contains("execute") & ((n_args >= 2) | ((n_args == 1) & text))


def semantic_source(kind: Column, text: Column, base: Column, fn: Column, qn: Column, as_call: bool) -> Column:
    """What an expression reads by its structure: arguments, environment, standard input, a web request; with ``as_call`` also input()."""
    call, subscript = kind == "call", kind == "subscript"
    web = kind.isin("call", "attribute", "subscript") & holds(text, K.WEB_ACCESS)
    branches = [
        (subscript & (base.contains("sys.argv") | (base == "argv")), F.lit("Command line argument (sys.argv)")),
        ((subscript & base.contains("environ")) | (call & fn.contains("getenv")), F.lit("Environment variable")),
        (call & (qn.contains("sys.stdin") | qn.contains("stdin.read")), F.lit("Standard input")),
        (web, F.lit("Web request data (Flask/Django)")),
    ]
    if as_call:
        branches.append((call & F.lower(fn).isin("input", "raw_input"), F.lit("User input function")))
    return cases(branches)


def semantic_sink(fn: Column, qn: Column) -> Column:
    """struct(category, severity, confidence) of a sink by what it is called on; null for others."""
    made = lambda c, s, p: F.struct(F.lit(c).alias("category"), F.lit(s).alias("severity"), F.lit(p).alias("confidence"))
    head = F.substring_index(qn, ".", 1)
    branches = [
        (fn.isin(*K.BUILTINS_EVALUATING), made("code_evaluation", "critical", 0.95)),
        (fn.isin("file", "open"), made("path_traversal", "high", 0.9)),
        (fn.isin("load", "loads") & (qn.contains("pickle") | qn.contains("marshal")), made("deserialization", "critical", 0.95)),
    ]
    branches += [(qn.contains(".") & (head == m), made(c, s, 0.9)) for m, (c, s) in K.DANGEROUS.items()]
    return cases(branches)


def io_object(fn: Column, qn: Column) -> Column:
    """Kind of object that a constructor call makes (file, socket, ...); null for others."""
    return cases([(qn.contains(c) | (fn == c.rsplit(".", 1)[-1]), F.lit(kind)) for c, kind in K.IO_OBJECTS])


def module_of(qn: Column, aliases: Column, names: Column) -> Column:
    """Module a call leads into: that of its dotted name's head, or the one its bare name came from; null if neither is imported."""
    return F.when(qn.contains("."), F.element_at(aliases, F.substring_index(qn, ".", 1))).otherwise(F.element_at(names, qn))


def resolved_name(name: Column, aliases: Column, names: Column) -> Column:
    """A name as its imports spell it: an alias's module, a from-import's module and name, or the name itself."""
    return F.coalesce(F.element_at(aliases, name), F.concat(F.element_at(names, name), F.lit("."), name), name)
