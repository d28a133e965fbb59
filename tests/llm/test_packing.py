import numpy as np
import pytest

from codeloom.llm.packing import GROUP_ITEMS, MAX_LOSS, MAX_SEGMENTS, MAX_TOKENS, conversation_items, fill, group_of, op7_packing, pack_documents, pack_items


def brute(sizes, limits):
    """The heuristic written out with plain loops."""
    left = list(range(len(sizes)))
    share = sizes / limits
    demand = share.sum(0) / max(share.sum(), 1e-12)
    bins = []
    while left:
        room, inside = list(limits), []
        while True:
            best = None
            for i in left:
                if i in inside or any(s > r for s, r in zip(sizes[i], room, strict=True)):
                    continue
                v = sum(share[i][k] * demand[k] * room[k] / limits[k] for k in range(3))
                if best is None or v > best[0] + 1e-12:
                    best = v, i
            if best is None:
                break
            inside.append(best[1])
            room = [r - s for r, s in zip(room, sizes[best[1]], strict=True)]
        bins.append(inside)
        left = [i for i in left if i not in inside]
    return bins


@pytest.mark.parametrize("seed", range(4))
def test_fill_equals_brute_force(seed):
    rng = np.random.default_rng(seed)
    sizes = np.stack([rng.integers(1, 100, 40), rng.integers(1, 4, 40), rng.integers(0, 60, 40)], 1).astype(float)
    limits = np.array([128.0, 8, 70])
    pack, slot = fill(sizes, limits)
    got = [[int(i) for i in sorted(np.flatnonzero(pack == b), key=lambda i: slot[i])] for b in range(pack.max() + 1)]
    assert got == brute(sizes, limits)


def whole(items, got, limits):
    """Nothing is lost, nothing breaks a limit, and places follow one another."""
    for _, g in got.sort_values("slot").groupby("pack"):
        assert (g[["tokens", "segments", "loss"]].sum() <= limits).all()
        assert g["slot"].tolist() == list(range(len(g)))
        assert g["first_token"].tolist() == (g["tokens"].cumsum() - g["tokens"]).tolist()
    assert got["tokens"].sum() == items["tokens"].sum()
    assert got["loss"].sum() == items["loss"].sum()


def test_query_keeps_limits_and_loses_nothing(spark, sf):
    items = conversation_items(spark.read.parquet(f"{sf}/conversations.parquet")).toPandas()
    got = op7_packing(spark, sf).toPandas()
    assert set(got["conv_id"]) == set(items["id"])
    whole(items, got, [4096, 16, 3072])


def test_every_item_is_in_some_pack_for_many_groups(spark):
    rows = [(i, i % 50 + 1, i % 5, min(i % 40, i % 50)) for i in range(3000)]
    items = spark.createDataFrame(rows, "id long, tokens long, segments long, loss long")
    got = pack_items(items, 200, 12, 150, group_items=100).toPandas()
    assert sorted(got["id"]) == [r[0] for r in rows]
    whole(items.toPandas(), got, [200, 12, 150])


def test_edge_cases(spark, weird, nothing):
    items = spark.createDataFrame([(1, 10_000, 1, 9_000), (2, None, None, None), (None, 5, 1, 5), (3, 5, 40, 5), (3, 5, 1, 99), (4, 0, 0, 0)], "id long, tokens long, segments long, loss long")
    got = pack_items(items).toPandas()
    assert got[got["id"] == 1]["tokens"].sum() == 10_000 and (got[got["id"] == 1]["tokens"] <= 4096).all()
    assert got[(got["id"] == 3)]["loss"].sum() == 10
    assert got["id"].isna().sum() == 1 and (got["id"] == 2).sum() == 1 and (got["id"] == 4).sum() == 1
    packed = pack_documents(weird).toPandas()
    assert packed["doc_id"].isna().sum() == 2 and (packed["doc_id"] == 2).sum() == 2 and (packed["doc_id"] == 6).sum() > 10
    assert pack_documents(nothing).collect() == []
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversation_items(none).collect() == []


def test_query_equals_brute_force(spark, sf):
    """Every bin of the query, group by group, by plain loops over items cut by hand."""
    limits = np.array([MAX_TOKENS, MAX_SEGMENTS, MAX_LOSS], float)
    made = []
    for r in conversation_items(spark.read.parquet(f"{sf}/conversations.parquet")).collect():
        size = [r["tokens"], max(1, r["segments"]), min(r["loss"], r["tokens"])]
        n = max(1, *(-(-s // int(m)) for s, m in zip(size, limits, strict=True)))
        for k in range(n):
            made.append((r["id"], k, *[max(s * (k + 1) // n - s * k // n, low) for s, low in zip(size, (0, 1, 0), strict=True)]))
    groups = -(-len(made) // GROUP_ITEMS)
    keyed = spark.createDataFrame(made, "id long, piece long, tokens long, segments long, loss long").withColumn("g", group_of(groups)).collect()
    want = set()
    for g in range(groups):
        items = sorted((tuple(r)[:5] for r in keyed if r["g"] == g), key=lambda r: (r[0] is not None, r[0] or 0, *r[1:]))
        for b, inside in enumerate(brute(np.array([i[2:] for i in items], float), limits)):
            want |= {(items[i][0], items[i][1], (g << 32) + b, slot) for slot, i in enumerate(inside)}
    assert {(r["conv_id"], r["piece"], r["pack"], r["slot"]) for r in op7_packing(spark, sf).collect()} == want


def test_pieces_tell_where_they_begin(spark):
    got = pack_items(spark.createDataFrame([(1, 10_000, 1, 10_000)], "id long, tokens long, segments long, loss long")).orderBy("piece").collect()
    assert [r["from_token"] for r in got] == [sum(x["tokens"] for x in got[:i]) for i in range(len(got))]
