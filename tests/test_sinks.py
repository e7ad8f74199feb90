import os

import pytest

from docweave.sinks import index_store as ST
from docweave.sinks import prepare as P
from docweave.sinks import site_store as SS

TEXT = "A first sentence. " * 80


def pages(spark):
    return spark.createDataFrame([("r.pdf", 0, TEXT), ("r.pdf", 1, TEXT), ("n.txt", 0, TEXT)],
                                 "sourcefile string, page_num int, text string")



@pytest.mark.parametrize("buckets", [None, 3])
def test_prepare_add_remove_removeall(spark, tmp, buckets):
    idx, blobs = os.path.join(tmp, "idx"), os.path.join(tmp, "blobs")
    rep = P.prepare_documents(spark, "add", idx, blobs, pages=pages(spark), category="docs", buckets=buckets)
    assert {r["sourcefile"] for r in rep.collect()} == {"r.pdf", "n.txt"}
    rows = ST.read(spark, idx, buckets).collect()
    assert {r["category"] for r in rows} == {"docs"} and {r["sourcefile"] for r in rows} == {"r.pdf", "n.txt"}
    assert {r["sourcepage"] for r in rows if r["sourcefile"] == "r.pdf"} <= {"r-0.pdf", "r-1.pdf"}
    assert sorted(r["blob_name"] for r in SS.read_blobs(spark, blobs).collect()) == ["n.txt", "r-0.pdf", "r-1.pdf"]
    gone = spark.createDataFrame([("r.pdf",), ("n.txt",)], "sourcefile string")
    P.prepare_documents(spark, "remove", idx, blobs, files=gone, buckets=buckets)
    assert ST.read(spark, idx, buckets).count() == 0
    assert [r["blob_name"] for r in SS.read_blobs(spark, blobs).collect()] == ["n.txt"]   # text blob stays
    P.prepare_documents(spark, "removeall", idx, blobs, buckets=buckets)
    assert SS.read_blobs(spark, blobs).count() == 0


def test_site_files_last_writer(spark, tmp):
    df = spark.createDataFrame([(1, "https://s.com/a.html", "<title>old</title><body>x</body>"),
                                (2, "https://s.com/a/", "<title>new</title><body>y <a href='/b'>b</a></body>"),
                                (3, "https://t.org/", "<body>home</body>")], "page_id long, url string, html string")
    out = os.path.join(tmp, "site")
    SS.write_site_files(df, out)
    got = {(r["netloc"], r["page_key"]): (r["title"], r["text"]) for r in spark.read.parquet(out).collect()}
    assert got == {("s.com", "a"): ("new", "new\n\ny b https://s.com/b"), ("t.org", "home"): (None, "home")}


def test_write_answers(spark, tmp):
    from docweave.operators import prompts as PR
    df = spark.createDataFrame([(1, "Q?", "C")], "question_id long, question string, context string")
    a = PR.answer(PR.completion_prompt(df), lambda ps: ["ok" for _ in ps])
    out = os.path.join(tmp, "answers")
    SS.write_answers(a, out)
    r = spark.read.parquet(out).first()
    assert (r["question_id"], r["answer"]) == (1, "ok") and r["prompt"].endswith("Answer:")


def blob_rows(spark, path):
    return sorted(tuple(r) for r in SS.read_blobs(spark, path).select("blob_name", "sourcefile", "page_num", "text").collect())


def files(spark, *names, pages=2, text="t"):
    return spark.createDataFrame([(f, k, f"{text}{k}") for f in names for k in range(pages)], "sourcefile string, page_num int, text string")


def test_blob_store_replaces_what_it_touches(spark, tmp):
    path = os.path.join(tmp, "blobs")
    SS.upload_blobs(files(spark, *[f"f{i}.pdf" for i in range(30)]), path, buckets=4)
    SS.upload_blobs(files(spark, "f3.pdf", "new.txt", pages=1, text="again"), path, buckets=99)      # 4 stays
    want = sorted([(f"f{i}-{k}.pdf", f"f{i}.pdf", k, f"t{k}") for i in range(30) if i != 3 for k in range(2)]
                  + [("f3-0.pdf", "f3.pdf", 0, "again0"), ("new.txt", "new.txt", 0, "again0")])
    assert blob_rows(spark, path) == want
    folders = [d for d in os.listdir(os.path.join(path, "rows")) if "=" in d]
    assert len(folders) <= 4
    SS.remove_blobs(spark, path, spark.createDataFrame([(f"f{i}.pdf",) for i in range(30)] + [("new.txt",), ("unknown.pdf",)], "sourcefile string"))
    assert blob_rows(spark, path) == [("new.txt", "new.txt", 0, "again0")]
    SS.remove_blobs(spark, path)
    assert blob_rows(spark, path) == []
    SS.upload_blobs(files(spark, "z.pdf"), path)
    assert len(blob_rows(spark, path)) == 2


def test_untouched_buckets_are_not_written(spark, tmp):
    path = os.path.join(tmp, "blobs")
    SS.upload_blobs(files(spark, *[f"f{i}.pdf" for i in range(40)]), path, buckets=8)
    rows = os.path.join(path, "rows")
    before = {d: sorted(os.listdir(os.path.join(rows, d))) for d in os.listdir(rows) if "=" in d}
    SS.upload_blobs(files(spark, "f7.pdf", pages=1), path)
    after = {d: sorted(os.listdir(os.path.join(rows, d))) for d in os.listdir(rows) if "=" in d}
    assert sum(before[d] != after[d] for d in before) == 1


def test_a_failed_change_leaves_the_store_as_it_was(spark, tmp):
    from pyspark.sql import functions as F
    path = os.path.join(tmp, "blobs")
    SS.upload_blobs(files(spark, *[f"f{i}.pdf" for i in range(20)]), path, buckets=4)
    want = blob_rows(spark, path)

    @F.udf("string")
    def broken(name, text):
        if name == "f11.pdf":
            raise RuntimeError("lost")
        return text + "!"
    bad = files(spark, *[f"f{i}.pdf" for i in range(20)]).repartition(6).withColumn("text", broken("sourcefile", "text"))
    with pytest.raises(Exception, match="lost"):
        SS.upload_blobs(bad, path)
    assert blob_rows(spark, path) == want
    # in the write itself: the staged rows are there, the job that overwrites the buckets fails
    from docweave.sinks import bucket_store as BS
    real = BS.stage_table
    BS.stage_table = lambda df: bad_rows(real(df)) if "store_bucket" in df.columns and df.count() > 20 else real(df)

    def bad_rows(df):
        out = df.withColumn("text", broken("sourcefile", F.coalesce("text", F.lit(""))))
        out._staged_at = df._staged_at
        return out
    try:
        with pytest.raises(Exception, match="lost"):
            SS.upload_blobs(files(spark, *[f"f{i}.pdf" for i in range(20)], text="new"), path)
    finally:
        BS.stage_table = real
    assert blob_rows(spark, path) == want
    SS.upload_blobs(files(spark, *[f"f{i}.pdf" for i in range(20)], text="new"), path)
    assert {r[3] for r in blob_rows(spark, path)} == {"new0", "new1"}
