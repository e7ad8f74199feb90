import os

from pyspark.sql import functions as F

from docweave import schemas
from docweave.operators import index as IX
from docweave.sinks import index_store as ST
from docweave.sources import files as FI

ROWS = [("a_txt-0", "alpha beta", None, "a.txt", "a.txt"), ("a_txt-1", "beta", None, "a.txt", "a.txt"),
        ("b_pdf-0", "gamma 12", "x", "b-0.pdf", "b.pdf")]


def idx(spark, rows=ROWS):
    return spark.createDataFrame(rows, schemas.SECTION)


def as_set(df):
    return sorted(tuple(r) for r in df.select(*IX.INDEX_FIELDS).collect())


def test_upsert_replaces_by_id_and_is_idempotent(spark):
    inc = idx(spark, [("a_txt-1", "beta v2", "new", "a.txt", "a.txt"), ("c_txt-0", "c", None, "c.txt", "c.txt")])
    once = IX.upsert(idx(spark), inc)
    twice = IX.upsert(once, inc)
    assert as_set(once) == as_set(twice)
    got = {r["id"]: r["content"] for r in once.collect()}
    assert got == {"a_txt-0": "alpha beta", "a_txt-1": "beta v2", "b_pdf-0": "gamma 12", "c_txt-0": "c"}


def test_delete_lookup_facets_postings(spark):
    files = spark.createDataFrame([("dir/a.txt",)], "sourcefile string")
    assert [r["id"] for r in IX.delete(idx(spark), files).collect()] == ["b_pdf-0"]
    assert IX.delete(idx(spark)).count() == 0
    lk = IX.lookup(idx(spark), top=2).collect()
    assert [r["id"] for r in lk] == ["a_txt-0", "a_txt-1"] and lk[0]["total_count"] == 3
    assert IX.lookup(idx(spark), sourcefile="b.pdf").first()["total_count"] == 1
    f = {(r["facet"], r["value"]): r["count"] for r in IX.facets(idx(spark)).collect()}
    assert f[("sourcefile", "a.txt")] == 2 and f[("category", "x")] == 1 and f[("sourcepage", "b-0.pdf")] == 1
    assert ("category", None) not in f                   # a missing value is in no bucket
    p = {(r["term"], r["id"]): r["tf"] for r in IX.postings(idx(spark)).collect()}
    assert p[("beta", "a_txt-0")] == 1 and p[("12", "b_pdf-0")] == 1


def test_page_blobs_and_removal(spark):
    pm = spark.createDataFrame([("d/r.pdf", 0, "p0"), ("d/r.pdf", 1, "p1"), ("n.txt", 0, "all"),
                                ("r.x.pdf", 0, "z")], "sourcefile string, page_num int, text string")
    blobs = IX.page_blobs(pm)
    assert sorted(r["blob_name"] for r in blobs.collect()) == ["n.txt", "r-0.pdf", "r-1.pdf", "r.x-0.pdf"]
    gone = spark.createDataFrame([("r.pdf",), ("n.txt",)], "sourcefile string")
    left = sorted(r["blob_name"] for r in IX.remove_blobs(blobs, gone).collect())
    assert left == ["n.txt", "r.x-0.pdf"]         # text blobs are not page blobs; stem must match exactly
    assert IX.remove_blobs(blobs).count() == 0


def test_index_store_upsert_and_delete(spark, tmp):
    path = os.path.join(tmp, "index")
    ST.upsert_into(spark, path, idx(spark), buckets=None)
    rep = ST.upsert_into(spark, path, idx(spark, [("a_txt-1", "beta v2", "new", "a.txt", "a.txt")]), buckets=None)
    assert {r["sourcefile"]: r["succeeded"] for r in rep.collect()} == {"a.txt": 1}
    got = {r["id"]: r["content"] for r in ST.read(spark, path, buckets=None).collect()}
    assert got == {"a_txt-0": "alpha beta", "a_txt-1": "beta v2", "b_pdf-0": "gamma 12"}
    n = ST.delete_from(spark, path, spark.createDataFrame([("b.pdf",)], "sourcefile string"), buckets=None)
    assert n >= 1
    assert sorted(r["id"] for r in ST.read(spark, path, buckets=None).collect()) == ["a_txt-0", "a_txt-1"]
    ST.delete_from(spark, path, buckets=None)
    assert ST.read(spark, path, buckets=None).count() == 0


def test_text_folder_and_csv_roundtrip(spark, tmp):
    d = os.path.join(tmp, "txt")
    os.makedirs(d)
    for name, body in [("a.txt", "Title A\n\nline 1\nline 2"), ("b.txt", "B"), ("c.md", "skip")]:
        with open(os.path.join(d, name), "w", encoding="utf-8") as f:
            f.write(body)
    got = {os.path.basename(r["fname"]): r["text"] for r in FI.read_text_folder(spark, d).collect()}
    assert got == {"a.txt": "Title A\n\nline 1\nline 2", "b.txt": "B"}
    rows = [("f1", 'say "hi", then\nnew line'), ("f2", "plain"), ("f3", "  padded  "), ("f4", "")]
    out = os.path.join(tmp, "csv")
    FI.write_corpus_csv(spark.createDataFrame(rows, "fname string, text string"), out)
    back = FI.read_corpus_csv(spark, out)
    assert back.columns == ["title", "text"]
    # an empty field comes back as NULL (as a pandas CSV read gives NaN);
    # quotes, commas, newlines and edge blanks round-trip
    want = [(f, t if t != "" else None) for f, t in rows]
    assert sorted(tuple(r) for r in back.collect()) == sorted(want)


def test_vectors_and_question_bodies(spark):
    df = spark.createDataFrame([(1, [0.5, 2.0])], "id long, embedding array<float>")
    t = FI.vectors_to_text(df)
    assert t.first()["embeddings"] == "[0.5,2.0]"
    assert FI.parse_vectors(t, "embeddings", "v").first()["v"] == [0.5, 2.0]
    b = spark.createDataFrame([('{"query": "what?"}',), ('{"other": 1}',)], "body string")
    assert [r["question"] for r in FI.parse_question_bodies(b).collect()] == ["what?", None]


def test_bucketed_index_store(spark, tmp):
    path = os.path.join(tmp, "bidx")
    ST.upsert_into(spark, path, idx(spark), buckets=4)
    ST.upsert_into(spark, path, idx(spark, [("a_txt-1", "beta v2", "new", "a.txt", "a.txt")]), buckets=4)
    got = {r["id"]: r["content"] for r in ST.read(spark, path, buckets=4).collect()}
    assert got == {"a_txt-0": "alpha beta", "a_txt-1": "beta v2", "b_pdf-0": "gamma 12"}
    ST.delete_from(spark, path, spark.createDataFrame([("b.pdf",)], "sourcefile string"), buckets=4)
    assert sorted(r["id"] for r in ST.read(spark, path, buckets=4).collect()) == ["a_txt-0", "a_txt-1"]
    ST.delete_from(spark, path, spark.createDataFrame([("a.txt",)], "sourcefile string"), buckets=4)
    assert ST.read(spark, path, buckets=4).count() == 0
    ST.upsert_into(spark, path, idx(spark), buckets=4)
    ST.delete_from(spark, path, buckets=4)
    assert ST.read(spark, path, buckets=4).count() == 0


def test_sanitised_id_collision_last_upload_wins(spark):
    from docweave.operators import sections as SE
    text = "One sentence here. " * 10
    docs = spark.createDataFrame([("a b.txt", text), ("a_b.txt", text + "More.")], "sourcefile string, text string")
    secs = SE.sections(docs)
    assert secs.select("id").distinct().count() == 1          # both are a_b_txt-0
    merged = IX.upsert(idx(spark, []), secs).collect()
    assert [(r["id"], r["sourcefile"]) for r in merged] == [("a_b_txt-0", "a_b.txt")]


def test_lookup_pages_reach_every_row(spark):
    rows = [(f"id{i:02d}", "c", None, "p", "f") for i in range(7)]
    index = spark.createDataFrame(rows, "id string, content string, category string, sourcepage string, sourcefile string")
    assert IX.lookup(index).count() == 7
    seen, after = [], None
    while page := [r["id"] for r in IX.lookup(index, top=3, after=after).collect()]:
        seen, after = seen + page, page[-1]
    assert seen == [r[0] for r in rows]


def test_postings_count_in_the_row(spark):
    """No exchange by term while ids do not repeat; repeated and null ids are added up."""
    rows = [("a", "x y x 12"), ("b", "y"), ("c", ""), ("d", None)]
    one = IX.postings(spark.createDataFrame(rows, "id string, content string"))
    assert "Exchange" not in one._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in one.collect()) == [("12", "a", 1), ("x", "a", 2), ("y", "a", 1), ("y", "b", 1)]
    more = IX.postings(spark.createDataFrame([*rows, ("a", "x"), (None, "z z"), (None, "z")], "id string, content string"))
    assert {(r["term"], r["id"]): r["tf"] for r in more.collect()} == {("12", "a"): 1, ("x", "a"): 3, ("y", "a"): 1, ("y", "b"): 1, ("z", None): 3}
