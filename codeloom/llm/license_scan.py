"""Licence scan with ordered signature rules.

One Aho-Corasick pass over the lower-case text, its gaps (white space and
comment marks) folded to one space, finds which keywords it holds; only their
rules' patterns run. Detections resolve by priority: in order of
priority, length, place and rule, one is dropped if a kept one's interval
contains it.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.license_rules import RULES
from codeloom.runtime import table

GAP = r"[\s*#;/]+"
Rule = tuple[str, int, str, re.Pattern]


def parse_rules(text: str = RULES) -> list[Rule]:
    out = []
    for line in text.strip().splitlines():
        licence, priority, keyword, pattern = line.split(" | ", 3)
        # A space outside a character class is a gap.
        spaced, depth = "", False
        for i, c in enumerate(pattern):
            if c in "[]" and pattern[i - 1 : i] != "\\":
                depth = c == "["
            spaced += r"(?:%s)" % GAP if c == " " and not depth else c
        out.append((licence, int(priority), keyword.strip(), re.compile(spaced, re.IGNORECASE)))
    return out


#: The marks of GAP, and what ignoring case takes for i, s and k besides their capitals.
FOLD = str.maketrans({**dict.fromkeys("*#;/", " "), "\u0130": "i", "\u0131": "i", "\u017f": "s", "\u212a": "k"})


def folded(text: str) -> str:
    """Lower case, each run of white space and comment marks as one space."""
    return " ".join(text.translate(FOLD).lower().split())


@cache
def _ready(text: str) -> tuple[list[Rule], ahocorasick.Automaton]:
    rules = parse_rules(text)
    machine = ahocorasick.Automaton()
    for keyword in {folded(r[2]) for r in rules}:
        machine.add_word(keyword, tuple(i for i, r in enumerate(rules) if folded(r[2]) == keyword))
    machine.make_automaton()
    return rules, machine


def resolve(hits: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Of (priority, start, end, rule), those that no stronger one contains, by place."""
    hits = sorted(set(hits), key=lambda h: (-h[0], h[1] - h[2], h[1], h[3]))
    starts = sorted({h[1] for h in hits})
    reach = [0] * (len(starts) + 1)  # a Fenwick tree: the farthest end of those kept that begin at or before a start
    kept: list[tuple[int, int, int, int]] = []
    for h in hits:
        i = rank = bisect_right(starts, h[1])
        far = 0
        while i:
            far, i = max(far, reach[i]), i & (i - 1)
        if far >= h[2]:
            continue
        kept.append(h)
        while rank <= len(starts):
            reach[rank], rank = max(reach[rank], h[2]), rank + (rank & -rank)
    return sorted(kept, key=lambda h: (h[1], h[2], h[3]))


def detect(text: str | None, rules_text: str = RULES, prefilter: bool = True) -> list[tuple[str, int, int, int, int]]:
    """(licence, rule, priority, start, end) of the detections that stay; [] for null or empty text."""
    if not text:
        return []
    rules, machine = _ready(rules_text)
    if prefilter:
        on = sorted({i for _, group in machine.iter(folded(text)) for i in group})
    else:
        on = range(len(rules))
    hits = [(rules[i][1], m.start(), m.end(), i) for i in on for m in rules[i][3].finditer(text) if m.end() > m.start()]
    return [(rules[i][0], i, p, a, b) for p, a, b, i in resolve(hits)]


def scan_licenses(docs: DataFrame, rules_text: str = RULES) -> DataFrame:
    """A row for each detection: doc_id, licence, rule, priority, start, end in characters.

    Null and empty texts give none; a null doc_id stays null; repeated rows are
    reported once each; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = [], []
            for i, text in enumerate(batch.column(1)):
                hits = detect(text.as_py(), rules_text)
                at += [i] * len(hits)
                found += hits
            if found:
                licence, rule, priority, start, end = zip(*found, strict=True)
                columns = [pa.array(licence), *(pa.array(c, pa.int32()) for c in (rule, priority, start, end))]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *columns], ["doc_id", "licence", "rule", "priority", "start", "end"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, licence string, rule int, priority int, start int, end int")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every licence detection in every document; edge cases are those of ``scan_licenses``."""
    return scan_licenses(table(spark, sf_dir, "documents"))
