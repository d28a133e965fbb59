"""Rules: YAML files to typed rules, checked on the driver.

A file holds one rule, a list of rules, or a set ``{name, rules: [...]}``. Of a
list each bad rule is reported and the others stay; a set with a bad rule is
refused whole.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession

from codeloom.functions.catalog import SEVERITIES

KINDS = ("call", "assignment", "import", "string_literal", "regex")
SHIPPED = str(Path(__file__).resolve().parent.parent / "rules")
SCHEMA = """id string, title string, severity string, sev_rank int, message string, description string,
 patterns array<struct<kind:string,name:string,regex:string,callee_name:string,callee_qualified:string,any_of:array<string>,module:string,
 args:array<struct<name:string,equals_kind:string,equals:string,contains:string,regex:string,present:boolean>>>>,
 examples map<string,string>, tags array<string>, `references` array<string>"""


class RuleError(ValueError):
    pass


@dataclass(frozen=True)
class Argument:
    """A test of a keyword argument. equals keeps its YAML type: true is not "true"."""

    name: str
    equals: str | bool | int | float | None = None
    contains: str | None = None
    regex: str | None = None
    present: bool | None = None


@dataclass(frozen=True)
class Callee:
    name: str | None = None
    qualified_name: str | None = None
    any_of: tuple[str, ...] | None = None
    module: str | None = None
    args: tuple[Argument, ...] = ()


@dataclass(frozen=True)
class Pattern:
    kind: str
    callee: Callee | None = None
    name: str | None = None
    regex: str | None = None


@dataclass(frozen=True)
class Rule:
    id: str
    title: str
    severity: str
    message: str
    patterns: tuple[Pattern, ...]
    description: str | None = None
    examples: dict[str, str] | None = None
    tags: tuple[str, ...] | None = None
    references: tuple[str, ...] | None = None

    @property
    def rank(self) -> int:
        return SEVERITIES.index(self.severity)


@dataclass
class Loaded:
    """Rules in the order of their files, and (file, message) of what was refused."""

    rules: list[Rule] = field(default_factory=list)
    errors: list[tuple[str, str]] = field(default_factory=list)

    def add(self, rule: Rule) -> Loaded:
        self.rules.append(rule)
        return self

    def by_id(self, rule_id: str) -> Rule | None:
        return next((r for r in self.rules if r.id == rule_id), None)

    def by_severity(self, severity: str) -> list[Rule]:
        return [rule for rule in self.rules if severity == rule.severity]

    def by_tag(self, tag: str) -> list[Rule]:
        return [r for r in self.rules if tag in (r.tags or ())]

    def listing(self, severity: str | None = None, tag: str | None = None) -> list[Rule]:
        """Rules of exactly a severity and with a tag, by severity as text and id."""
        return sorted((r for r in self.rules if severity in (None, r.severity) and (tag is None or tag in (r.tags or ()))), key=lambda r: (r.severity, r.id))


def _text(raw: dict, key: str, needed: bool = False) -> str | None:
    v = raw.get(key)
    if v is None and not needed:
        return None
    if not isinstance(v, str):
        raise RuleError(f"{key}: a text is needed")
    return v


def _texts(raw: dict, key: str) -> tuple[str, ...] | None:
    v = raw.get(key)
    if v is None:
        return None
    if not isinstance(v, list) or not all(isinstance(x, str) for x in v):
        raise RuleError(f"{key}: a list of texts is needed")
    return tuple(v)


def _argument(raw: object) -> Argument:
    if not isinstance(raw, dict):
        raise RuleError("args: a mapping is needed")
    equals, present = raw.get("equals"), raw.get("present")
    if equals is not None and not isinstance(equals, (str, bool, int, float)):
        raise RuleError("equals: a text, number or boolean is needed")
    if present is not None and not isinstance(present, bool):
        raise RuleError("present: a boolean is needed")
    return Argument(_text(raw, "name", True), equals, _text(raw, "contains"), _text(raw, "regex"), present)


def _pattern(raw: object) -> Pattern:
    if not isinstance(raw, dict) or raw.get("kind") not in KINDS:
        raise RuleError(f"kind: one of {', '.join(KINDS)} is needed")
    callee = raw.get("callee")
    if callee is not None:
        if not isinstance(callee, dict):
            raise RuleError("callee: a mapping is needed")
        callee = Callee(_text(callee, "name"), _text(callee, "qualified_name"), _texts(callee, "anyOf"), _text(callee, "module"), tuple(_argument(a) for a in callee.get("args") or ()))
    return Pattern(raw["kind"], callee, _text(raw, "name"), _text(raw, "regex"))


def rule_of(raw: object) -> Rule:
    """A checked rule. RuleError says what is wrong."""
    if not isinstance(raw, dict):
        raise RuleError("a mapping is needed")
    if raw.get("severity") not in SEVERITIES:
        raise RuleError(f"severity: one of {', '.join(SEVERITIES)} is needed")
    patterns = raw.get("patterns")
    if not isinstance(patterns, list):
        raise RuleError("patterns: a list is needed")
    examples = raw.get("examples")
    if examples is not None and not (isinstance(examples, dict) and all(isinstance(v, str) for v in examples.values())):
        raise RuleError("examples: a mapping of texts is needed")
    return Rule(
        _text(raw, "id", True), _text(raw, "title", True), raw["severity"], _text(raw, "message", True), tuple(_pattern(p) for p in patterns),
        _text(raw, "description"), examples, _texts(raw, "tags"), _texts(raw, "references"),
    )


def load_text(text: str, where: str = "<string>", into: Loaded | None = None) -> Loaded:
    out = into if into is not None else Loaded()
    try:
        raw = yaml.safe_load(text)
        if isinstance(raw, dict) and "rules" in raw:
            if not isinstance(raw["rules"], list):
                raise RuleError("rules: a list is needed")
            out.rules += [rule_of(r) for r in raw["rules"]]
        elif isinstance(raw, list):
            for i, r in enumerate(raw):
                try:
                    out.rules.append(rule_of(r))
                except RuleError as e:
                    out.errors.append((f"{where}[{i}]", str(e)))
        else:
            out.rules.append(rule_of(raw))
    except (RuleError, yaml.YAMLError) as e:
        out.errors.append((where, str(e)))
    return out


def load_dir(folder: str = SHIPPED, suffixes: Iterable[str] = (".yaml",)) -> Loaded:
    """Rules of all files below a folder. FileNotFoundError if there is none; a bad file is an error row and the others count."""
    base = Path(folder)
    if not base.is_dir():
        raise FileNotFoundError(folder)
    out = Loaded()
    for p in sorted(x for x in base.rglob("*") if x.suffix in set(suffixes) and x.is_file()):
        try:
            load_text(p.read_text(encoding="utf-8"), str(p), out)
        except (OSError, UnicodeDecodeError) as e:
            out.errors.append((str(p), str(e)))
    return out


def validate_dir(folder: str, shown: int = 5) -> dict:
    """Files seen, files with at least one rule, rules, and the first errors, of .yaml and .yml files."""
    base = Path(folder)
    seen = good = 0
    every = Loaded()
    for p in sorted(x for x in base.rglob("*") if x.suffix in (".yaml", ".yml")):
        seen += 1
        one = load_text(p.read_text(encoding="utf-8", errors="replace"), str(p))
        good += bool(one.rules)
        every.rules += one.rules
        every.errors += one.errors
    return {"files": seen, "valid_files": good, "rules": len(every.rules), "errors": every.errors[:shown], "error_count": len(every.errors)}


def pick(rules: Iterable[Rule], ids: Iterable[str] | None = None, min_severity: str | None = None, exclude: Iterable[str] = ()) -> list[Rule]:
    """Rules named by ids (all if there are none), at least as severe, and not excluded."""
    wanted, gone = set(ids or ()), set(exclude)
    least = SEVERITIES.index(min_severity) if min_severity else 0
    return [r for r in rules if (not wanted or r.id in wanted) and r.rank >= least and r.id not in gone]


def rules_table(spark: SparkSession, rules: Iterable[Rule]) -> DataFrame:
    rows = []
    for r in rules:
        patterns = []
        for p in r.patterns:
            c = p.callee or Callee()
            args = [(a.name, None if a.equals is None else type(a.equals).__name__, None if a.equals is None else str(a.equals), a.contains, a.regex, a.present) for a in c.args]
            patterns.append((p.kind, p.name, p.regex, c.name, c.qualified_name, list(c.any_of) if c.any_of is not None else None, c.module, args))
        rows.append((r.id, r.title, r.severity, r.rank, r.message, r.description, patterns, r.examples, list(r.tags) if r.tags is not None else None, list(r.references) if r.references is not None else None))
    return spark.createDataFrame(rows, SCHEMA)
