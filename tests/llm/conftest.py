import pytest
from pyspark.sql import types as T

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Turns (doc_id, text) or (doc_id, text, lang, source) rows into documents, with columns that clash with names operators add."""

    def make(rows, extra=False):
        full = [(*r, *(["en", "s1"][len(r) - 2 :] if len(r) < 4 else ()), len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, T.StructType.fromDDL(DOCS) if hasattr(T.StructType, "fromDDL") else DOCS)
        if extra:
            for name in ("ids", "score", "gone", "n", "token", "component", "size", "shard", "words", "item"):
                df = df.selectExpr("*", f"'x' AS {name}")
        return df

    return make


ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "two words"), (6, "a" * 40_000), (7, "the same text " * 900), (8, "the same text " * 900), (8, "the same text " * 900), (None, "no number here at all"), (9, "�äöü ▁ 日本 \x00 x"), (10, "12 34 --")]
