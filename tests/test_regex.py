"""Patterns of rules mean the same to Java as to Python."""

import re

import pytest
from pyspark.sql import functions as F

from codeloom.functions import text as X
from codeloom.operators.scan import java_regex
from codeloom.sources.facts import complexity

PATTERNS = [r"[;&|`$(){}[\]]", r"(?P<q>['\"])x(?P=q)", r"a\Z", r"[[a]b", r"[^[]z", r"[]a]+", r"[a&&b]", r"\[x\]", r"(?i)SELECT\b", r"^\s*def\s", r"a{2,3}", r"[\]\[]"]
TEXTS = ["", "a;b", "'x'", '"x\'', "ba", "ba\n", "[b", "ab", "cz", "[z", "]]a", "&", "a&b", "[x]", "select 1", "selected", "  def f", "aaa", "x]y", "plain"]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_translated_patterns_match_alike(spark, pattern):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    got = [r[0] for r in df.select(F.col("t").rlike(java_regex(pattern))).collect()]
    assert got == [bool(re.search(pattern, t)) for t in TEXTS]


WIDE = ["é", "naïve idée", "caféé", "٣٤", "a\u00a0b", "É", "straße", "ΣΑΣ", "漢字", "x\r\ny", "a\u2028b", "end\n", "tok_É1", ""]


@pytest.mark.parametrize("pattern", [r"\w", r"\w{4}é", r"^\w+$", r"\d+", r"\D", r"\s", r"\bid", r"\Bé", r"(?i)é", r"(?i)^TOK_é\w$", r"(?i)σ", r"(?a)\w+é", r"^.+$", r"(?m)^y$", r"(?s)x.*y", r"d$", r"[^\W\d_]{5}", r"(?ia)É"])
def test_patterns_mean_the_same_beyond_ascii(spark, pattern):
    df = spark.createDataFrame([(t,) for t in WIDE], "t string")
    got = [r[0] for r in df.select(F.col("t").rlike(java_regex(pattern))).collect()]
    assert got == [bool(re.search(pattern, t)) for t in WIDE]


def test_complexity_of_columns_and_of_files_is_one(spark):
    texts = ["if x and y: return 1", "éif ifé if", "IF For whilE", "naïve or else", "", "for_ if_", "try-except;finally"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(X.complexity(F.col("t"))).collect()] == [complexity(t) for t in texts]


def test_string_tests_equal_python(spark):
    texts = [*TEXTS, "my password", "AKIA" + "A1" * 8, "0" * 31, "f" * 32, "https://x", "HTTP://x", " http://x", "UPDATE t", "updates", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r["a"] for r in df.select(X.analyse_string(F.col("t")).alias("a")).collect()]
    for t, a in zip(texts, got, strict=True):
        if t is None:
            assert a is None
            continue
        assert a["length"] == len(t)
        assert a["sql"] == bool(re.search(r"(?i)\b(?:alter|create|drop|delete|update|insert|select)\b", t))
        assert a["shell"] == any(c in ";&|`$(){}[]" for c in t)
        assert a["url"] == t.lower().startswith(("http://", "https://"))
        assert a["secrets"] == any(re.search(p, t) for p in X.SECRETS.values())
    kinds = [r[0] for r in df.select(X.secret_kinds(F.col("t"))).collect()]
    assert kinds[texts.index("my password")] == ["keyword"] and kinds[-1] == []
    assert kinds[texts.index("f" * 32)] == ["hex32"]


def test_unquoting_and_buckets(spark):
    df = spark.createDataFrame([("'''a'''", 0), ("f\"x\"", 4), ('"\'q\'"', 5), ("plain", 12)], "t string, c int")
    got = [tuple(r) for r in df.select(X.unquoted(F.col("t")), X.complexity_bucket(F.col("c"))).collect()]
    assert got == [("a", "0-5"), ('f"x', "0-5"), ("q", "5-10"), ("plain", "10-15")]
    code = "if a and b:\n    return 1\nelse:\n    raise X"
    from codeloom.sources.facts import complexity

    assert df.limit(1).select(X.complexity(F.lit(code))).first()[0] == complexity(code) == 3
