import json
import os

import pytest

from pyspark.sql import functions as F

from docweave.operators import retrieval as R
from docweave.operators import web as W
from docweave.operators import sections as SE
from docweave.sinks import index_store as ST
from docweave.streaming import jobs as J

PAGES = [(1, "https://s.com/a", "<title>A</title><body><p>one</p><a href='/b'>b</a></body>"),
         (2, "https://s.com/b.html", "<body><p>two</p></body>"),
         (3, "https://t.org/", "<body>three &amp; more</body>")]


def test_page_text_stream_equals_batch(spark, tmp):
    src, sink, ck = (os.path.join(tmp, x) for x in ("src", "sink", "ck"))
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    pages.repartition(2).write.parquet(src)
    q = J.page_text_stream(spark, src, sink, ck, trigger_once=True)
    q.awaitTermination(120)
    got = sorted((r["page_key"], r["text"]) for r in spark.read.parquet(sink).collect())
    want = sorted((r["page_key"], r["text"]) for r in W.page_texts(pages).collect())
    assert got == want


def test_answer_stream_equals_batch(spark, tmp):
    src, sink, ck = (os.path.join(tmp, x) for x in ("q", "out", "ck"))
    os.makedirs(src)
    qs = ["alpha beta", "gamma delta alpha", "alpha beta"]
    with open(os.path.join(src, "b1.json"), "w") as f:
        for q in qs:
            f.write(json.dumps({"query": q}) + "\n")
    chunks = spark.createDataFrame([(1, "alpha beta gamma", 3), (2, "delta", 1), (3, "beta beta", 2)],
                                   "chunk_id long, text string, n_tokens int")
    chunks = R.embed(chunks, "text", "embedding")
    h = J.answer_stream(spark, src, chunks, sink, ck, trigger_once=True)
    h.awaitTermination(120)
    got = sorted((r["question"], r["context"]) for r in spark.read.parquet(sink).collect())
    qdf = spark.createDataFrame([(i, q) for i, q in enumerate(qs)], "question_id long, question string")
    want = sorted((r["question"], r["context"]) for r in J.answer_batch(qdf, chunks).collect())
    assert got == want and len(got) == 3


def test_section_index_stream_equals_batch(spark, tmp):
    src, idx, ck = (os.path.join(tmp, x) for x in ("docs", "idx", "ck"))
    text = "First sentence here. " * 120
    docs = spark.createDataFrame([("a.txt", text, "c1"), ("b.txt", text[:500], None)],
                                 "sourcefile string, text string, category string")
    docs.write.parquet(src)
    h = J.section_index_stream(spark, src, idx, ck, trigger_once=True)
    h.awaitTermination(180)
    got = sorted(tuple(r) for r in ST.read(spark, idx, buckets=256).collect())
    want = sorted(tuple(r) for r in SE.sections(docs, category="category")
                  .select("id", "content", "category", "sourcepage", "sourcefile").collect())
    assert got == want and len(got) > 2


def test_page_text_stream_with_watermark(spark, tmp):
    import datetime as dt
    src, sink, ck = (os.path.join(tmp, x) for x in ("src", "sink", "ck"))
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, u, h, t0 + dt.timedelta(minutes=i)) for i, u, h in PAGES] + \
           [(9, "https://s.com/a/", "<body>again</body>", t0 + dt.timedelta(minutes=9))]
    schema = "page_id long, url string, html string, fetched_at timestamp"
    spark.createDataFrame(rows, schema).write.parquet(src)
    q = J.page_text_stream(spark, src, sink, ck, trigger_once=True, event_time="fetched_at",
                           watermark="1 hour", schema=schema)
    q.awaitTermination(120)
    got = spark.read.parquet(sink).collect()
    assert sorted(r["page_key"] for r in got) == ["a", "b", "home"]


VERSIONS = "page_id long, url string, html string"


def page_version(k, key, note):
    return k, f"https://s.com/{key}", f"<title>{key}</title><body>{note} {k}</body>"


def test_newest_page_wins_across_batches(spark, tmp):
    """Versions of pages in several micro-batches, newer before older and after: the store equals the batch dedup."""
    src, store, ck = (os.path.join(tmp, x) for x in ("src", "store", "ck"))
    batches = [[page_version(5, "a", "x"), page_version(2, "b", "x"), page_version(9, "c", "x"), (1, "https://s.com", "<body>home</body>")],
               [page_version(3, "a", "old"), page_version(4, "b", "new"), page_version(4, "b", "new"), (None, "https://s.com/a", "<body>no id</body>")],
               [page_version(8, "a", "new"), page_version(7, "c", "old"), page_version(6, "d", "x"), page_version(1, "d", "x")]]
    everything = []
    for k, rows in enumerate(batches):
        everything += rows
        spark.createDataFrame(rows, VERSIONS).repartition(2).write.mode("append").parquet(src)
        J.page_version_stream(spark, src, store, ck, trigger_once=True, buckets=4).awaitTermination(180)
        df = spark.createDataFrame([r for r in everything if r[0] is not None], VERSIONS)
        want = sorted((r["page_key"], r["page_id"]) for r in W.dedup_pages(df).collect())
        got = J.page_text_store(spark, store).read()
        assert sorted((r["page_key"], r["page_id"]) for r in got.collect()) == want, k
    texts = {r["page_key"]: r["text"] for r in got.collect()}
    assert texts["a"] == "a\n\nnew 8" and texts["b"] == "b\n\nnew 4" and texts["c"] == "c\n\nx 9"
    assert not (spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") or "").endswith("RocksDBStateStoreProvider")


def test_versions_are_forgotten_by_a_timer(spark, tmp):
    import time
    src, store, ck = (os.path.join(tmp, x) for x in ("src", "store", "ck"))

    def arrive(*rows):
        spark.createDataFrame(rows, VERSIONS).coalesce(1).write.mode("append").parquet(src)

    def stored_until(want, seconds=40):
        end = time.time() + seconds
        while time.time() < end:
            got = {r["page_key"]: r["page_id"] for r in J.page_text_store(spark, store).read().collect()}
            if got == want:
                return True
            time.sleep(1)
        return False
    arrive(page_version(5, "a", "x"))
    with pytest.raises(ValueError):
        J.page_version_stream(spark, src, store, ck, trigger_once=True, forget_ms=1)
    q = J.page_version_stream(spark, src, store, ck, forget_ms=3000, buckets=2)
    try:
        assert stored_until({"a": 5})
        time.sleep(8)                                  # the key is forgotten
        arrive(page_version(4, "a", "late"), page_version(9, "z", "x"))
        assert stored_until({"a": 4, "z": 9})
    finally:
        q.stop()


def test_failed_answers_are_told_from_empty_ones(spark):
    def boom(prompts):
        raise RuntimeError("down")
    chunks = R.embed(spark.createDataFrame([(1, "alpha beta", 2)], "chunk_id long, text string, n_tokens int"), "text", "embedding")
    qs = spark.createDataFrame([("q", "alpha")], "question_id string, question string")
    r = J.answer_batch(qs, chunks, complete_fn=boom).first()
    assert r["answer"] == "" and r["answer_error"] == "RuntimeError: down"
    assert J.answer_batch(qs, chunks).first()["answer_error"] is None
