"""Every stage against brute force on what came before it, and the whole as the driver runs it."""

import pyarrow as pa
import pytest

from codeloom.llm.license_scan import detect
from codeloom.llm.secret_scan import find
from codeloom.llm.toxicity import exact, fit
from codeloom.runtime import table

import corpus_pipeline as P


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    docs = table(spark, sf, "documents")
    out = [("documents", docs)]
    folder = tmp_path_factory.mktemp("stages")
    for name, stage in P.STAGES:
        stage(spark, docs, sf).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out.append((name, docs))
    return dict(out)


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_names_and_columns(stages):
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_duplicates", "secrets", "mixing", "packing"]
    for name in ("toxicity", "near_duplicates", "secrets", "mixing"):
        assert stages[name].columns == stages["documents"].columns


def test_toxicity_keeps_what_exact_neighbours_clear(spark, sf, stages):
    docs = stages["documents"]
    index = fit(docs, table(spark, sf, "labels"))
    keep = []
    for r in docs.collect():
        f, w = next(index.vectors(pa.array([(r["text"] or "").lower()])))
        near = exact(index, f, w, own=r["doc_id"]) if len(f) else []
        if near:
            x = {int(i): 0.0 for i in near}
            for i in near:
                g, v = index.rows[i]
                x[i] = round(float(sum(a * b for k, a in zip(f, w, strict=True) for q, b in zip(g, v, strict=True) if k == q)), 9)
            import numpy as np

            s = index.calibrated(index.vote(np.array(near), np.array([x[i] for i in near])))
        else:
            s = index.bare
        if s < 0.5:
            keep.append(r["doc_id"])
    assert ids(stages["toxicity"]) == sorted(keep)


def test_one_of_each_group_stays(stages):
    before, after = stages["toxicity"], stages["near_duplicates"]
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    kept = {r["doc_id"]: r["text"] for r in after.collect()}
    assert set(kept) < set(texts)
    assert set(kept.values()) <= set(texts.values())
    live = [t for t in kept.values() if t and t.split()]
    assert len(set(live)) == len(live)


def test_secrets_are_masked_and_all_rows_stay(stages):
    before, after = stages["near_duplicates"], stages["secrets"]
    assert ids(before) == ids(after)
    old = {r["doc_id"]: r for r in before.collect()}
    for r in after.collect():
        assert find(r["text"]) == []
        if not find(old[r["doc_id"]]["text"]):
            assert r == old[r["doc_id"]]
    assert detect("") == []


def test_mixture_repeats_rows_within_its_budget(stages):
    before, after = stages["secrets"].toPandas(), stages["mixing"].toPandas()
    size = lambda df: df["text"].str.split().str.len()
    total = size(before).groupby(before["source"]).sum()
    got = size(after).groupby(after["source"]).sum()
    longest = size(before).groupby(before["source"]).max()
    assert set(got.index) <= set(total.index)
    assert abs(got.sum() - total.sum()) <= longest.sum()
    assert all(got[s] <= 1.25 * total[s] + longest[s] for s in got.index)
    assert set(after["doc_id"]) <= set(before["doc_id"])


def test_packs_hold_every_token(stages):
    before, after = stages["mixing"].toPandas(), stages["packing"].toPandas()
    assert after["tokens"].sum() == before["text"].str.split().str.len().sum()
    assert (after.groupby("pack")["tokens"].sum() <= 4096).all()
    assert (after.groupby("pack")["segments"].sum() <= 16).all()


def test_run_gives_what_the_stages_give(spark, sf, stages):
    assert P.ORACLE_SQL is None
    got = sorted(tuple(r) for r in P.run(spark, sf).collect())
    assert got == sorted(tuple(r) for r in stages["packing"].collect())


def test_edge_cases(spark, sf, weird, nothing):
    for docs in (weird, nothing):
        for name, stage in P.STAGES[:-1]:
            out = stage(spark, docs, sf)
            assert out.columns == docs.columns, name
            out.collect()
        P.STAGES[-1][1](spark, docs, sf).collect()
