import random
import re

from codeloom.llm.license_rules import RULES
from codeloom.llm.license_scan import detect, op3_license_scan, parse_rules, resolve, scan_licenses


def brute(text):
    """All patterns on the whole text, without keywords; then the same resolution, written out."""
    rules = parse_rules(RULES)
    hits = [(r[1], m.start(), m.end(), i) for i, r in enumerate(rules) for m in r[3].finditer(text or "") if m.end() > m.start()]
    kept = []
    for h in sorted(hits, key=lambda h: (-h[0], -(h[2] - h[1]), h[1], h[3])):
        if all(not (k[1] <= h[1] and h[2] <= k[2]) for k in kept):
            kept.append(h)
    return sorted((rules[i][0], i, p, a, b) for p, a, b, i in kept)


def test_hundreds_of_rules_each_with_a_keyword():
    rules = parse_rules(RULES)
    assert len(rules) >= 200
    assert all(r[2] == r[2].lower() and r[2] for r in rules)


def test_query_equals_brute_force_without_prefilter(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = sorted((d["doc_id"], *x) for d in docs for x in brute(d["text"]))
    assert sorted(tuple(r) for r in op3_license_scan(spark, sf).collect()) == want
    assert want


def test_known_notices():
    name = lambda t: [d[0] for d in detect(t)]
    assert name("# Licensed under the Apache License,\n#  Version 2.0 (the License)") == ["Apache-2.0"]
    assert name("SPDX-License-Identifier: MIT") == ["MIT"]
    assert name("This is free software under the MIT License.") == ["MIT"]
    assert name("nothing of the kind, just a permit") == []


def test_containment_and_priority():
    kept = resolve([(50, 0, 10, 1), (90, 2, 8, 2), (50, 3, 7, 3), (50, 8, 20, 4), (50, 0, 10, 0)])
    assert kept == [(50, 0, 10, 0), (90, 2, 8, 2), (50, 8, 20, 4)]


def test_edge_cases(spark, weird, nothing):
    rows = scan_licenses(weird).collect()
    assert {(r["doc_id"], r["licence"]) for r in rows} == {(8, "MIT")}
    assert scan_licenses(nothing).collect() == []
    assert detect(None) == detect("") == []
    assert re.compile(r"x")


def made(node, rng):
    """A text that a parsed pattern matches, gaps as comment marks or line ends; look-arounds and \\b add nothing."""
    out = ""
    for op, av in node:
        name = str(op)
        if name == "LITERAL":
            out += chr(av)
        elif name == "ANY":
            out += " "
        elif name == "IN":
            kinds = [(str(o), v) for o, v in av]
            if ("LITERAL", ord("*")) in kinds and ("LITERAL", ord("#")) in kinds:
                out += rng.choice(["\n", " ", "*", "#"])
            else:
                o, v = next((k for k in [rng.choice(kinds)] if k[0] in ("LITERAL", "RANGE")), ("CATEGORY", None))
                out += chr(v) if o == "LITERAL" else chr(v[0]) if o == "RANGE" else "1" if any("NOT" not in str(v) and ("DIGIT" in str(v) or "WORD" in str(v)) for _, v in kinds) else " "
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            low, high, inner = av
            for _ in range(rng.randint(low, min(high, low + 2))):
                out += made(inner, rng)
        elif name == "SUBPATTERN":
            out += made(av[3], rng)
        elif name == "BRANCH":
            out += made(rng.choice(av[1]), rng)
    return out


def test_wrapped_headers_equal_brute_force():
    """Keywords lose nothing, wherever a notice is wrapped and whatever its comment marks."""
    rng = random.Random(0)
    for text in ("licensed under the MIT\n# License", "the GNU General Public\n * License, version 2", "Creative\n# Commons Attribution 4.0", "the MİT Lıcenſe"):
        assert [d[:5] for d in detect(text)] == brute(text) != []
    for rule in parse_rules(RULES):
        hit = 0
        for _ in range(12):
            text = made(re._parser.parse(rule[3].pattern, re.IGNORECASE), rng)
            hit += bool(rule[3].search(text))
            assert detect(text) == brute(text), (rule[:3], text)
        assert hit, rule
