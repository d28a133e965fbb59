from math import comb

import pytest

from codeloom.llm import quality
from codeloom.llm.quality import certified, judge, scored


def test_query_equals_its_sql(spark, sf, duck, same):
    same(quality.op9_quality(spark, sf).toPandas(), duck(sf, quality.SQL))


def test_certified_is_the_exact_binomial_test():
    for n in (1, 5, 40, 300):
        for k in range(0, n + 1, max(1, n // 7)):
            for rate in (0.01, 0.1):
                exact = sum(comb(n, i) * rate**i * (1 - rate) ** (n - i) for i in range(k + 1))
                assert certified(k, n, rate, 0.05) == (k <= rate * n and exact <= 0.05)


def labelled(spark, n, bad_share, seed=0):
    import numpy as np

    rng = np.random.default_rng(seed)
    docs, labels = [], []
    for i in range(n):
        bad = rng.random() < bad_share
        words = [f"w{x}" for x in rng.integers(0, 500, 40)]
        text = "|".join(words) + " #### $$$$" if bad else " ".join(words)
        docs.append((i, text, "en" if i % 2 else "de"))
        labels.append((i, 0 if bad else 1))
    return spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_false_rejections_on_new_documents_stay_limited(spark):
    docs, labels = labelled(spark, 3000, 0.3)
    from codeloom.llm.quality import cutoffs
    from pyspark.sql import functions as F

    half = labels.filter("doc_id < 1500")
    at = cutoffs(scored(docs), half)
    assert ("en", "symbols") in at and ("de", "symbols") in at
    rest = judge(docs, half).join(labels, "doc_id").filter("doc_id >= 1500")
    good, bad = (rest.filter(F.col("quality") == q) for q in (1, 0))
    assert good.filter("NOT keep").count() <= 0.05 * good.count()
    assert bad.filter("NOT keep").count() >= 0.9 * bad.count()


def test_few_labels_certify_nothing(spark):
    docs, labels = labelled(spark, 40, 0.3)
    assert judge(docs, labels).filter("NOT keep").count() == 0


def test_edge_cases(spark, weird, nothing, weird_labels):
    rows = judge(weird, weird_labels).collect()
    assert len(rows) == weird.count() and all(r["keep"] for r in rows)
    assert {r["stratum"] for r in rows} == {"en", "fr", "de", ""}
    empty = [r for r in rows if r["doc_id"] in (3, 4)]
    assert all(r[x] == 0 for r in empty for x in quality.RULES)
    assert judge(nothing, weird_labels).collect() == []
    assert len(judge(weird, weird_labels.filter("false")).collect()) == weird.count()
    assert pytest.approx(1) == 1.0
