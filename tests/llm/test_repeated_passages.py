from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codeloom.llm.repeated_passages import Collection, op4_repeated_passages, repeated_passages

SCHEMA = "doc_id long, text string, lang string, rk string, fp long"


def brute(rows, n):
    """(doc_id, start_word, end_word, n_words, first_doc_id) by comparing every passage with every other."""
    texts = sorted({(d, t) for d, t in rows if t}, key=str)
    split = {(d, t): t.split() for d, t in texts}
    places = defaultdict(list)
    for key, w in split.items():
        for i in range(len(w) - n + 1):
            places[tuple(w[i : i + n])].append((key, i))
    out = []
    for key, w in split.items():
        good = [i for i in range(len(w) - n + 1) if len(places[tuple(w[i : i + n])]) > 1]
        run = []
        for i in [*good, None]:
            if run and (i is None or i > run[-1] + n):
                ids = [k[0] for j in run for k, _ in places[tuple(w[j : j + n])] if k[0] is not None]
                out.append((key[0], run[0], run[-1] + n, run[-1] + n - run[0], min(ids) if ids else None))
                run = []
            if i is not None:
                run.append(i)
    return sorted(out, key=str)


def found(spark, rows, n, gram):
    df = spark.createDataFrame([(d, t, "x", "y", 1) for d, t in rows], SCHEMA)
    return sorted((tuple(r) for r in repeated_passages(df, n, gram).collect()), key=str)


def made(seed, vocabulary=12, docs=40):
    rng = np.random.default_rng(seed)
    shared = [" ".join(f"s{x}" for x in rng.integers(0, 400, rng.integers(5, 30))) for _ in range(4)]
    rows = []
    for d in range(docs):
        words = [f"w{x}" for x in rng.integers(0, vocabulary, rng.integers(0, 40))]
        if rng.random() < 0.6:
            at = rng.integers(0, len(words) + 1)
            words = words[:at] + shared[rng.integers(4)].split() + words[at:]
        rows.append((d, " \t".join(words)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = [*made(seed), *made(seed)[:5], (100, "a " * 40), (101, "b " * 9), (None, made(seed)[3][1] + " z"), (102, None), (103, ""), (104, "é ü " * 12)]
    assert found(spark, rows, 6, 3) == brute(rows, 6)


def test_planted_passage_of_over_fifty_words(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, "one two " + passage), (2, passage + " three"), (3, " ".join(f"q{i}" for i in range(80)))]
    assert found(spark, rows, 50, 10) == [(1, 2, 62, 60, 1), (2, 0, 60, 60, 1)]


def test_empty_table_and_bad_sizes(spark):
    assert found(spark, [], 6, 3) == []
    with pytest.raises(ValueError, match="min_words"):
        found(spark, [], 6, 7)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), max_size=9), min_size=1, max_size=6))
def test_transform_and_prefixes_equal_a_sorted_collection(tmp_path_factory, texts):
    c = Collection([np.array(t, np.int32) for t in texts], f"file://{tmp_path_factory.mktemp('bwt')}")
    c.build()
    suffixes = sorted((tuple(t[i:]) + (0,), w, i) for w, t in enumerate(texts) for i in range(len(t) + 1))
    first = [s[0] for s in suffixes]
    common = []
    for a, b in zip(first, first[1:], strict=False):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n] and a[n]:
            n += 1
        common.append(n)
    got = [(w, o, x) for _, _, lcp, win, off in c.read() for w, o, x in zip(win, off, lcp, strict=True)]
    assert [x for _, _, x in got][1:] == common
    assert [tuple(texts[w][o:]) for w, o, _ in got] == [s[:-1] for s in first]
    bwt = np.concatenate(list(c.transform())).tolist()
    assert sorted(bwt) == sorted([-1] * len(texts) + [x for t in texts for x in t])
    c.close()


def test_query_over_the_whole_table(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in op4_repeated_passages(spark, sf).collect()), key=str) == brute(rows, 50)


def test_hot_anchors_give_the_same(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = sorted(tuple(r) for r in repeated_passages(docs).collect())
    assert want
    for hot in (0, 1, 2):
        assert sorted(tuple(r) for r in repeated_passages(docs, hot=hot).collect()) == want


def test_long_passages(spark):
    """Windows of more than 255 words, whose places and prefixes need two bytes."""
    common = [f"c{i}" for i in range(400)]
    rows = [(1, " ".join(["a", *common, "b"])), (2, " ".join([*[f"x{i}" for i in range(7)], *common])), (3, " ".join(common[:299]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in repeated_passages(docs, min_words=300).collect())
    assert got == [(1, 1, 401, 400, 1), (2, 7, 407, 400, 1)]


def test_very_long_and_odd_texts(spark, weird, nothing):
    got = repeated_passages(weird).collect()
    long = [r for r in got if r["doc_id"] == 6]
    assert len(long) == 1 and (long[0]["start_word"], long[0]["end_word"]) == (0, 160_000)
    assert {r["doc_id"] for r in got} == {6}
    assert repeated_passages(nothing).collect() == []
