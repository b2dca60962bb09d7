import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, keep_id long, h string, row string, score string, _keep_id string, _Digest string, _kept_id long, _toxicity string, _ID string, _hash long, _extra string"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents with extra columns whose names clash with those that operators use inside."""
    def make(rows):
        return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), 7, "x", "y", "z", "p", "q", 3, "r", "s", 5, "t") for i, t, s in rows], DOCS)

    return make


@pytest.fixture(scope="session")
def hard_docs(make_docs):
    """Nulls in any column, empty, very long, tied and repeated rows."""
    long_text = " ".join(f"wort{i % 5000}" for i in range(30_000))
    return make_docs([
        (1, "Some TEXT here now please", "a"), (2, "some text here now please", "a"), (3, None, "a"), (4, "", None), (5, " \t\n", "b"), (6, long_text, "b"),
        (6, long_text, "b"), (None, None, None), (None, "x y z", "a"), (7, "ÄÖ äö é", "c"), (8, "äö äö é", "c"), (9, "x Y z", "c"),
    ])
