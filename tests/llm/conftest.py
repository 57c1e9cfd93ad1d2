import pytest

from tests.conftest import DATA

#: Columns whose names clash with ones that operators use within.
CLASH = "id long, t string, key string, digest string, n long, row long, blob string, size long, host string, c0 string, node long, held boolean, kept boolean, start long, rule string, target double, carried string, w string, loc string, file string, _id long, _fp2 binary, toxic_score double, toxic_spans string, copies int, win long, label string, n_words long"


@pytest.fixture(scope="session")
def sf():
    return str(DATA / "sf0.001")


@pytest.fixture(scope="session")
def texts(small):
    return small.sql("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()


def frame(spark, rows, extra=CLASH):
    """documents of (doc_id, text, source) with null in every extra column."""
    n = extra.count(",") + 1
    return spark.createDataFrame([(d, t, None, s, None, *[None] * n) for d, t, s in rows], f"doc_id long, text string, lang string, source string, n_chars long, {extra}")


LONG = " ".join(f"word{i % 977} token{i}" for i in range(30_000))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and white texts, repeated rows and identifiers, a null identifier and source, a very long text."""
    rows = [
        (1, "Alpha beta gamma delta epsilon zeta", "b"), (1, "Alpha beta gamma delta epsilon zeta", "b"), (2, "ALPHA beta gamma delta epsilon zeta", "a"),
        (None, "alpha beta gamma delta epsilon zeta", None), (3, None, "a"), (4, "", "a"), (5, " \n\t ", None), (6, LONG, "c"), (6, "other text", "c"), (7, "é É\n\nx\U0001f600y", "a"),
    ]
    return frame(spark, rows)


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, [])
