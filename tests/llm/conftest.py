from __future__ import annotations

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("n_words", T.StringType())])


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text[, lang, source]) rows, with an extra column whose name an operator also uses."""
    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "a", len(r[1] or ""), "extra") for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


#: Nulls in every column, empty and very long texts, ties and repeated rows.
ODD = [(1, "one two three four five"), (2, None), (3, ""), (None, "one two three four five"), (4, "one two three four five"),
       (4, "one two three four five"), (5, "  \n\t "), (6, "word " * 30_000, None, None), (7, "é ü 漢字 " * 50, "de", None), (None, None, None, "b")]
