import random

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make_docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang, source)."""

    def make(rows):
        full = [(r[0], r[1], *(r[2:] or ("en", "s")), len(r[1]) if r[1] is not None else None) for r in rows]
        return spark.createDataFrame(full, DOC)

    return make


@pytest.fixture(scope="session")
def awkward():
    """Nulls in any column, empty and blank texts, repeated rows, one long text, no letters, odd characters."""
    rng = random.Random(3)
    long = " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(999)) for _ in range(30_000))
    return [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, " \t\n", None, None), (4, "one two three four five six", "en", None), (4, "one two three four five six", "en", None),
        (None, "a row without an id", "en", "b"), (None, None, None, None), (5, "12345 !!! ???", "en", "b"), (6, long, "en", "b"), (7, "émigré 東京 ñandú   x\u0000y", "fr", "c"),
        (8, "word", "de", "c"),
    ]


@pytest.fixture
def with_extra(make_docs, awkward):
    """The awkward documents with extra columns under names that operators use inside."""
    from pyspark.sql import functions as F

    df = make_docs(awkward)
    for c in ("key", "size", "root", "cid", "component_id", "lang_pred", "th", "copy", "sequence_id", "row"):
        df = df.withColumn(c, F.lit("clash"))
    return df
