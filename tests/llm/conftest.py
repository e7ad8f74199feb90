from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 997}" for i in range(60_000))


def doc(doc_id, text, source="a", lang="en"):
    return doc_id, text, lang, source, None if text is None else len(text)


#: Nulls in any column, empty and very long texts, ties and repeated rows.
ODD = [doc(1, None), doc(2, ""), doc(3, " \t\n "), doc(None, "a null id here with words"), doc(5, LONG), doc(5, LONG),
       doc(6, "Same text of six words here", None), doc(6, "Same text of six words here", None),
       doc(6, "another text under one id", "b"), doc(7, "same TEXT of six words here", "b", None),
       doc(9223372036854775807, "largest id"), doc(-4, "one"), doc(8, "Und " * 300), doc(None, None, None, None)]


@pytest.fixture(scope="session")
def odd_docs(spark):
    return spark.createDataFrame(ODD, DOCS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def clashing(odd_docs):
    """Extra columns with the names that operators use inside."""
    from pyspark.sql import functions as F
    extra = ["fp", "label", "row_key", "ident", "component_id", "name", "level", "i", "bin", "rank", "size", "target", "left", "whole",
             "cut", "cut_bin", "mix_source", "copy", "c0", "__keep_id", "__keep_key", "label_id", "quality", "toxic", "bucket", "lo", "hi"]
    return odd_docs.select("*", *[F.lit(k).alias(c) for k, c in enumerate(extra)])
