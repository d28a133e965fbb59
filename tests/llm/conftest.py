import pytest

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, sig string, band long, a int, b int, node long, root long, g int, fp long, rk string, "
    "epoch int, target string, total double, block int, count int, toxic string, quality string, score double, ids string, group_id string, keep string, "
    "__key string, __n int, __copy int, __doc long, __source string, tokens string, id string, piece string"
)
CLASH = ("x", 1, 2, 3, 4, 5, 6, 7, "y", 8, "t", 1.5, 9, 10, "z", "q", 0.1, "i", "gid", "k", "kk", 11, 12, 13, "s", "tt", "id", "pp")
SECRET = 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"'


@pytest.fixture(scope="session")
def weird(spark):
    """Nulls in every column, empty and blank texts, a very long one, ties, repeated rows, and extra columns of clashing names."""
    long = "long words of a text that never ends " * 20_000
    rows = [
        (1, "the same words in the same order for both", "en", "s0"),
        (2, "the same words in the same order for both", "en", "s0"),
        (2, "the same words in the same order for both", "en", "s0"),
        (3, None, None, None),
        (4, "", "en", "s1"),
        (5, " \t\n ", "fr", ""),
        (None, "a text without an id, " + SECRET, "en", "s1"),
        (None, None, None, None),
        (6, long, "en", "s2"),
        (7, "é" * 50 + " ß ü 漢字 \x00 ퟿ end", "de", "s2"),
        (8, SECRET + " is licensed under the MIT License.", None, "s3"),
        (9, "word", "en", "s3"),
    ]
    made = [(i, t, lang, s, len(t) if t is not None else None, *CLASH) for i, t, lang, s in rows]
    return spark.createDataFrame(made, SCHEMA)


@pytest.fixture(scope="session")
def nothing(weird):
    return weird.filter("false")


@pytest.fixture(scope="session")
def weird_labels(spark):
    rows = [(1, 1, 0), (2, 0, 1), (2, 1, 0), (3, None, None), (None, 1, 1), (99, 0, 1), (6, 1, 0)]
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, quality int, toxic int, text string, score string")


@pytest.fixture(scope="session")
def duck():
    import duckdb

    def run(sf, sql):
        con = duckdb.connect()
        for t in ("documents", "labels", "conversations", "embeddings"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
        return con.sql(sql).df()

    return run


@pytest.fixture(scope="session")
def same():
    def check(a, b):
        assert sorted(a.columns) == sorted(b.columns)

        def norm(df):
            df = df[sorted(df.columns)].copy()
            for c in df.columns:
                if df[c].dtype.kind == "f":
                    df[c] = df[c].round(9)
                elif df[c].dtype.kind in "iu":
                    df[c] = df[c].astype("int64")
            df = df.astype(str)
            return df.sort_values(list(df.columns)).reset_index(drop=True)

        x, y = norm(a), norm(b)
        assert len(x) == len(y)
        assert (x == y).all().all()

    return check
