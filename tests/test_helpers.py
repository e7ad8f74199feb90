import json
import os

from pyspark.sql import functions as F

from docweave.functions import text as TX
from docweave.functions import vectors as V
from docweave.operators import layout as L
from docweave.operators import retrieval as R
from docweave.sources import files as FI


def test_full_unescape(spark):
    df = spark.createDataFrame([("&eacute;&#233;&#xE9;&hellip;&amp;amp;",)], "v string")
    assert df.select(TX.html_unescape_full(F.col("v")).alias("o")).first()["o"] == "ééé…&amp;"


def test_udf_embedder_batches(spark):
    calls = []

    def embed(texts):
        calls.append(len(texts))
        return [[float(len(t)), 1.0] for t in texts]

    df = spark.createDataFrame([("ab",), ("abcd",)], "text string")
    out = R.embed(df, "text", "e", embedder=V.udf_embedder(embed)).orderBy("text").collect()
    assert [r["e"] for r in out] == [[2.0, 1.0], [4.0, 1.0]]


def test_hash_embed_dims_and_counts(spark):
    df = spark.createDataFrame([("Word word other 12",), ("...",)], "t string")
    rows = df.select(V.hash_embed("t").alias("e"), V.hash_embed("t", 100).alias("g")).collect()
    assert len(rows[0]["e"]) == 64 and sum(rows[0]["e"]) == 4.0 and max(rows[0]["e"]) >= 2.0
    assert len(rows[0]["g"]) == 100 and sum(rows[0]["g"]) == 4.0      # general (non power of two) path
    assert sum(rows[1]["e"]) == 0.0


def test_question_lines(spark, tmp):
    p = os.path.join(tmp, "q.txt")
    with open(p, "w") as f:
        f.write("first question?\n\n  \nsecond one\n")
    got = sorted(r["question"] for r in FI.read_question_lines(spark, p).collect())
    assert got == ["first question?", "second one"]


def test_read_layout_json(spark, tmp):
    doc = {"sourcefile": "f.pdf", "content": "ab|cd", "pages": [{"page_num": 0, "offset": 0, "length": 5}],
           "tables": [{"row_count": 1, "page_number": 1, "spans": [{"offset": 2, "length": 1}],
                       "cells": [{"row_index": 0, "column_index": 0, "kind": "content", "row_span": 1,
                                  "column_span": 1, "content": "x"}]}]}
    p = os.path.join(tmp, "layout.json")
    with open(p, "w") as f:
        f.write(json.dumps(doc) + "\n")
    pages = L.overlay_pages(FI.read_layout(spark, p)).collect()
    assert [(r["page_num"], r["text"]) for r in pages] == [(0, "ab<table><tr><td>x</td></tr></table>cd ")]
