import numpy as np
import pyarrow as pa
import pytest

from codeloom.llm import toxicity
from codeloom.llm.toxicity import K, drop_toxic, exact, fit, isotonic, op10_toxicity, score



def vector(index, text):
    """Of one text, in lower case."""
    return next(index.vectors(pa.array([(text or "").lower()])))


BAD = ["vile", "nasty", "rotten", "filthy"]


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(0)
    docs, labels = [], []
    for i in range(600):
        toxic = i % 5 == 0
        words = [f"w{x}" for x in rng.integers(0, 300, int(rng.integers(5, 80)))]
        if toxic:
            for _ in range(int(rng.integers(2, 6))):
                words.insert(int(rng.integers(0, len(words))), str(rng.choice(BAD)))
        docs.append((i, " ".join(words)))
        if i < 400:
            labels.append((i, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy(planted):
    docs, labels = planted
    rows = score(docs, fit(docs, labels)).filter("doc_id >= 400").collect()
    truth = {r["doc_id"]: r["doc_id"] % 5 == 0 for r in rows}
    assert sum(r["toxic"] == truth[r["doc_id"]] for r in rows) >= 0.97 * len(rows)
    assert all(r["evidence"] for r in rows if r["toxic"])
    assert not any(r["toxic"] for r in rows if not truth[r["doc_id"]])


@pytest.mark.parametrize("block", [4, 64])
def test_neighbours_equal_brute_force(planted, monkeypatch, block):
    monkeypatch.setattr(toxicity, "BLOCK", block)
    docs, labels = planted
    index = fit(docs, labels).arrange()
    for r in docs.filter("doc_id >= 300").collect():
        f, w = vector(index, r["text"])
        if len(f):
            assert index.nearest([(f, w)], [None])[0][0].tolist() == exact(index, f, w)
            both = index.nearest([(f, w)] * 2, [r["doc_id"], None], k=3)
            assert [rows.tolist() for rows, _ in both] == [exact(index, f, w, 3, r["doc_id"]), exact(index, f, w, 3)]


def test_query_equals_brute_force_and_no_row_cites_itself(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    index = fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    got = {r["doc_id"]: r for r in op10_toxicity(spark, sf).collect()}
    for r in docs.collect():
        near = exact(index, *vector(index, r["text"]), own=r["doc_id"])
        assert [e["doc_id"] for e in got[r["doc_id"]]["evidence"]] == index.ids[near].tolist()
        assert r["doc_id"] not in index.ids[near]


def test_isotonic_rises_and_keeps_the_mean():
    rng = np.random.default_rng(1)
    x, y = rng.random(200), (rng.random(200) < 0.4).astype(float)
    xs, ys = isotonic(x, y, np.ones(200))
    assert (np.diff(ys) >= -1e-12).all() and (np.diff(xs) >= 0).all()
    assert np.interp(x, xs, ys).mean() == pytest.approx(y.mean(), abs=0.05)


def test_query_scores_every_document_and_finds_labelled_toxic_ones(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = op10_toxicity(spark, sf).collect()
    assert len(rows) == docs.count()
    assert all(0 <= r["score"] <= 1 and len(r["evidence"]) <= K for r in rows)


def test_edge_cases(spark, weird, nothing, weird_labels, planted):
    for labels in (weird_labels, weird_labels.filter("false"), weird_labels.filter("toxic = 0")):
        rows = score(weird, fit(weird, labels)).collect()
        assert len(rows) == weird.count()
        kept = drop_toxic(weird, labels)
        assert kept.columns == weird.columns
    docs, labels = planted
    index = fit(docs, labels)
    rows = score(weird, index).collect()
    assert len(rows) == weird.count()
    assert all(r["vote"] is None and r["evidence"] == [] for r in rows if not r["vote"])
    assert score(nothing, index).collect() == []
    assert drop_toxic(nothing, labels).collect() == []
    assert drop_toxic(weird, labels).count() == weird.count()


def test_copies_of_toxic_examples_without_telling_words_are_found(spark, planted):
    """Texts of words that occur once each have no significant term; their copies are still nearest to them."""
    docs, labels = planted
    plain = [(1000 + i, " ".join(f"q{i}x{j}" for j in range(30))) for i in range(5)]
    copies = [(2000 + i, text) for i, (_, text) in enumerate(plain)]
    every = docs.union(spark.createDataFrame(plain + copies, docs.schema))
    index = fit(every, labels.union(spark.createDataFrame([(i, 1) for i, _ in plain], labels.schema)))
    rows = score(every.filter("doc_id >= 2000"), index).collect()
    assert len(rows) == 5
    for r in rows:
        first = r["evidence"][0]
        assert (first["doc_id"], first["toxic"]) == (r["doc_id"] - 1000, 1)
        assert first["similarity"] > 0.999 and r["toxic"]


def test_weights_take_frequencies_from_all_documents_and_all_words(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a c"), (3, "a a z"), (4, "b z y")], "doc_id long, text string")
    index = fit(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int"))
    hashes = dict(zip("abc", (w[0] for w in ([x for _, _, _, word, _ in toxicity.bags(pa.array([t])) for x in word] for t in "abc")), strict=True))
    feature = {t: int(np.searchsorted(index.words, h)) for t, h in hashes.items()}
    assert sorted(hashes.values()) == index.words.tolist()
    idf = {t: float(np.log(5 / (1 + n)) + 1) for t, n in {"a": 3, "b": 2, "c": 1}.items()}
    assert {t: index.idf[i] for t, i in feature.items()} == pytest.approx(idf)
    f, w = vector(index, "a b q")
    size = np.sqrt(idf["a"] ** 2 + idf["b"] ** 2 + (np.log(5 / 2) + 1) ** 2)
    assert dict(zip(f.tolist(), w.tolist(), strict=True)) == pytest.approx({feature["a"]: idf["a"] / size, feature["b"]: idf["b"] / size})


def test_marks_beyond_ascii_end_words():
    def words(text):
        return sorted(w for _, _, _, word, _ in toxicity.bags(pa.array([text])) for w in word.tolist())

    for text in ("a\u00a0b", "\u00aba\u00bb b", "a\u2014b", "a\u3002b", "a\uff0cb", "a\u2019b\u2026"):
        assert words(text) == words("a b"), text
    assert words("\u00aa\u00b5") != words("") and words("\u00e9") != words("e") and words("") == []
