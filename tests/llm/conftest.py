import pytest
from pyspark.sql import types as T

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """documents from (doc_id, text[, lang[, source]]) rows, with extra columns
    whose names the operators use themselves."""
    from chatlens.llm.common import prepare

    prepare(spark)

    def build(rows, extra=True):
        full = [tuple(r) + (None,) * (4 - len(r)) + (len(r[1] or ""),) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        if extra:
            for name in ("shard", "slot", "_pin", "node", "_t", "words", "position", "found", "_text_key",
                         "N_WORDS", "label"):
                df = df.selectExpr("*", f"'x' AS `{name}`")
        return df
    return build


@pytest.fixture(scope="session")
def odd():
    """Null, empty, tiny, long, repeated and tied rows."""
    long = " ".join(f"w{k % 977}" for k in range(30000))
    return [(1, None), (2, ""), (3, " \t\n"), (4, "a"), (5, "one two three four five six"),
            (6, "one two three four five six"), (6, "one two three four five six"), (None, "x y z"),
            (None, None), (8, long), (9, long + " end"), (10, "é" * 70000), (11, "\x00\x1f\u2028 \x85a b"),
            (12, "ONE two THREE four FIVE six")]
