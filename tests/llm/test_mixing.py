import random
import time
from collections import Counter
from math import exp, log

import pytest

from codeloom.llm import mixing
from codeloom.llm.mixing import exponent, mix_documents, plan_mixture


def test_query_equals_its_sql(spark, sf, duck, same):
    same(mixing.op2_mixing(spark, sf).toPandas(), duck(sf, mixing.SQL))


def bisected(totals, whole, budget, max_repeats, entropy):
    """One step at a time, on plain numbers."""
    lo, hi = 0.0, 1.0

    def ok(a):
        raw = [exp(a * log(t / whole)) for t in totals]
        w = [r / sum(raw) for r in raw]
        if max_repeats is not None:
            return max(x * budget / t for x, t in zip(w, totals, strict=True)) <= max_repeats
        return -sum(x * log(x) for x in w) <= entropy

    if ok(lo):
        return lo
    for _ in range(40):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if ok(mid) else (mid, hi)
    return hi


def test_exponent_meets_its_target(spark):
    totals = [1000, 100, 10]
    df = spark.createDataFrame([(t,) for t in totals], "total long")
    a = exponent(df, 1110, 1110, 2.0, None)
    assert a == pytest.approx(bisected(totals, 1110, 1110, 2.0, None), abs=1e-11)
    raw = [(t / 1110) ** a for t in totals]
    repeats = [w / sum(raw) * 1110 / t for w, t in zip(raw, totals, strict=True)]
    assert max(repeats) == pytest.approx(2.0, abs=1e-6)
    a = exponent(df, 1110, 1110, None, 0.6)
    raw = [(t / 1110) ** a for t in totals]
    assert -sum(r / sum(raw) * log(r / sum(raw)) for r in raw) == pytest.approx(0.6, abs=1e-6)
    same = spark.createDataFrame([(5,), (5,)], "total long")
    assert exponent(same, 10, 10, 1.0, None) == 0
    with pytest.warns(UserWarning, match="natural mixture"):
        assert exponent(df, 1110, 1110, 0.5, None) == 1


def test_many_sources_are_not_broadcast(spark, monkeypatch):
    rows = [(i, "w " * (1 + i % 7), f"s{i % 3}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = sorted(tuple(r) for r in plan_mixture(df).collect())
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 1)
    assert sorted(tuple(r) for r in plan_mixture(df).collect()) == want


def test_brute_force_of_weights_and_budgets(spark):
    rows = [(i, "w " * (1 + i % 7), f"s{i % 3}" if i % 9 else "rare") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = plan_mixture(df, max_repeats=3.0).toPandas()
    totals = {}
    for _, t, s in rows:
        totals[s] = totals.get(s, 0) + len(t.split())
    whole = sum(totals.values())
    a = bisected([totals[s] for s in sorted(totals)], whole, whole, 3.0, None)
    raw = {s: (t / whole) ** a for s, t in totals.items()}
    for s in totals:
        target = int(raw[s] / sum(raw.values()) * whole)
        part = got[got.source == s].sort_values("before")
        assert (part["before"].tolist() == part["n_tokens"].cumsum().shift(fill_value=0).tolist())
        assert target <= part["n_tokens"].sum() < target + 7
        for _, e in part.groupby("epoch"):
            assert e["doc_id"].is_unique


def test_edge_cases(spark, weird, nothing):
    got = plan_mixture(weird).toPandas()
    assert set(got["doc_id"].dropna()) <= {1, 2, 6, 7, 8, 9}
    assert got["doc_id"].isna().any()
    assert plan_mixture(nothing).collect() == []
    mixed = mix_documents(weird)
    assert mixed.columns == weird.columns
    ids = [r["doc_id"] for r in mixed.collect()]
    assert 1 in ids and None in ids
    assert mix_documents(nothing).collect() == []


def test_documents_come_as_often_as_the_plan_takes_them(spark, monkeypatch):
    made = random.Random(5)
    rows = []
    for i in range(3000):
        text = made.choice(["", None, " \t\n", *["w " * made.randint(1, 9) for _ in range(12)]])
        doc = made.choice([None, i, i, i, made.randrange(200)])
        rows.append((doc, text if doc is not None or not text or not text.strip() else f"{text}{i % 700}", made.choice([None, "", "a", "a", "a", "a", "b", "c c", "rare"] if i % 50 else ["one"]), i))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n long")
    keyed = df.select("n", mixing.key_of(df), mixing.source_of(df)).collect()
    taken = Counter((r["key"], r["source"]) for r in plan_mixture(df).collect())
    want = Counter({r["n"]: taken[r["key"], r["source"]] for r in keyed})
    live = {(d, s or "") for d, t, s, _ in rows if t and t.strip()}
    along = [n for d, t, s, n in rows if d is not None and not (t and t.strip()) and (d, s or "") in live]
    assert {0, 1, 2} <= set(want.values()) and any(want[n] for n in along)
    assert Counter(r["n"] for r in mix_documents(df).collect()) == +want
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 1)
    assert Counter(r["n"] for r in mix_documents(df).collect()) == +want


def test_texts_stay_where_they_are_read(spark, tmp_path):
    made = random.Random(3)
    rows = [(i, " ".join(f"{made.getrandbits(64):x}" for _ in range(1000)), f"s{i % 3}") for i in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/in")

    def shuffled():
        time.sleep(0.5)  # the figures lag behind, up to the next task's end
        spark.range(1).foreach(lambda _: None)
        spark._jsc.sc().listenerBus().waitUntilEmpty()
        return spark._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()

    limit = "spark.sql.autoBroadcastJoinThreshold"
    usual = spark.conf.get(limit)
    spark.conf.set(limit, "-1")  # as on a plan too large for it
    try:
        before = shuffled()
        mix_documents(spark.read.parquet(f"{tmp_path}/in")).write.parquet(f"{tmp_path}/out")
    finally:
        spark.conf.set(limit, usual)
    assert 0 < shuffled() - before < 0.1 * sum(len(t) for _, t, _ in rows)
