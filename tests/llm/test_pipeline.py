import zlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from docweave.llm import quality
from docweave.llm.oracle import ORACLE
from docweave.llm.queries import QUERIES, BYTE_BPE, tokenizer

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "benchmark", "conversations", "embeddings", "labels", "pages")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql_gives_the_same_rows(spark, con, name):
    got = QUERIES[name](spark, SF)
    want = con.sql(ORACLE[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = lambda it: sorted(repr(tuple(round(x, 9) if isinstance(x, float) else x for x in r)) for r in it)
    assert rows(got.select(*cols).collect()) == rows(want.select(*cols).fetchall())


def test_stages_on_odd_rows(spark, odd_docs, clashing, no_docs):
    for docs in (odd_docs, clashing, no_docs):
        for name, step in corpus_pipeline.STAGES[:-1]:
            out = step(spark, docs, SF)
            assert out.columns == docs.columns, name
            out.collect()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()


def test_run_equals_its_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = {r.doc_id for r in quality.classify(docs, spark.read.parquet(f"{SF}/labels.parquet")).filter("keep").collect()}
    steps = corpus_pipeline.STAGES
    one = steps[0][1](spark, docs, SF)
    assert {r.doc_id for r in one.select("doc_id").collect()} == good
    two = steps[1][1](spark, one, SF)
    three = steps[2][1](spark, two, SF)
    four = steps[3][1](spark, three, SF)
    texts = sorted((r.doc_id, r.text) for r in four.collect())
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(tokenizer(BYTE_BPE))
    got = sorted(corpus_pipeline.run(spark, SF).collect(), key=lambda r: r.start)
    at = 0
    assert len(got) == len(texts)
    for r, (doc_id, text) in zip(got, texts):
        ids = [*tok.encode(text, add_special_tokens=False).ids, 0]
        assert (r.doc_id, r.start, r.n_tokens) == (doc_id, at, len(ids))
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
