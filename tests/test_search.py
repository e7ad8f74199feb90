import math
import os
import random
import re

from pyspark.sql import functions as F

from docweave.operators import index as IX
from docweave.operators import search as SR
from docweave.plans import queries as Q
from docweave.session import SHUFFLE_CLEANUP_CONF, ensure_checkpoint_dir, stage_table

TERM = re.compile(r"[^\W\d_]+|\d+")


def terms(t):
    return TERM.findall((t or "").lower())


def brute(docs, queries, k):
    docs = [(i, terms(t)) for i, t in docs if t is not None]
    n, avg = len(docs), sum(len(t) for _, t in docs) / max(1, len(docs)) or 1.0
    df = {}
    for _, t in docs:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    out = []
    for q, text in queries:
        scores = []
        for i, t in docs:
            s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * t.count(w) * 2.2 / (t.count(w) + 1.2 * (0.25 + 0.75 * len(t) / avg))
                    for w in terms(text) if w in t)
            if set(terms(text)) & set(t):
                scores.append((-round(s, 9), i))
        out += [(q, r + 1, i, round(-s, 6)) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def name(i):
    return "w" + "".join(chr(97 + int(c)) for c in str(i))


def corpus(seed=1, n=400):
    r = random.Random(seed)
    words = [name(i) for i in range(300)]
    weight = [1 / (i + 1) for i in range(300)]
    docs = [(f"d{i:04}", " ".join(r.choices(words, weight, k=r.randrange(1, 60)))) for i in range(n)]
    docs += [("dup1", docs[5][1]), ("dup0", docs[5][1]), ("none", None), ("blank", ""), ("other", "Ärger 2024, ÄRGER!")]
    queries = [(i, " ".join(r.choices(words, k=r.randrange(1, 9)) + [name(0)])) for i in range(20)]
    queries += [(90, f"{name(0)} {name(1)}"), (91, docs[5][1]), (92, "unknown words"), (93, ""), (94, None), (95, "ärger"), (96, " ".join(map(name, (7, 7, 7, 0, 1, 2))))]
    return docs, queries


def run(spark, index, queries, k):
    q = spark.createDataFrame(queries, "query_id long, query string")
    return sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 6)) for r in SR.search(index, q, k).collect())


def test_search_equals_brute_force(spark):
    docs, queries = corpus()
    df = spark.createDataFrame(docs, "id string, content string").repartition(4)
    index = SR.build(df)
    for k in (1, 5, 1000):
        assert run(spark, index, queries, k) == brute(docs, queries, k)


def test_stored_and_salted_index(spark, tmp):
    docs, queries = corpus(2, 200)
    df = spark.createDataFrame(docs, "id string, content string")
    SR.write(SR.build(df, hot=20), tmp, buckets=5)
    index = SR.read(spark, tmp)
    assert index.postings.filter("term = 'wa'").select("salt").distinct().count() > 3
    assert index.postings.select("bucket").distinct().count() == 5
    assert run(spark, index, queries, 7) == brute(docs, queries, 7)


def test_frequent_terms_are_only_looked_up(spark):
    docs, _ = corpus(3, 600)
    docs = [(i, (t or "") + " the of and") for i, t in docs]              # in every text
    queries = [(1, f"{name(150)} {name(200)} the of and"), (2, "the of")]
    index = SR.build(spark.createDataFrame(docs, "id string, content string"))
    q = spark.createDataFrame(queries, "query_id long, query string")
    wanted = SR.query_terms(index, q)
    split = {(r["query_id"], r["term"]): r["only_look_up"] for r in SR.split_terms(wanted, SR.thresholds(index, wanted, 3)).collect()}
    assert split[1, "the"] and split[1, "of"] and split[1, "and"] and not split[1, name(150)]
    assert not (split[2, "the"] and split[2, "of"])
    assert run(spark, index, queries, 3) == brute(docs, queries, 3)


def test_no_documents_or_queries(spark):
    none = spark.createDataFrame([], "id string, content string")
    q = spark.createDataFrame([(1, "a")], "query_id long, query string")
    assert SR.search(SR.build(none), q).collect() == []
    one = SR.build(spark.createDataFrame([("x", "a")], "id string, content string"))
    assert SR.search(one, q.limit(0)).collect() == []
    assert [(r["id"], r["rank"]) for r in SR.search(one, q).collect()] == [("x", 1)]


def test_extra_columns_are_not_read(spark):
    docs, queries = corpus(4, 50)
    df = spark.createDataFrame(docs, "id string, content string").select("*", *[F.lit(1).alias(c) for c in ("t", "term", "len", "tf", "weight", "df", "salt")])
    assert run(spark, SR.build(df), queries, 3) == brute(docs, queries, 3)


def test_what_moves_does_not_grow_with_queries_times_texts(spark):
    """Each posting of a wanted term is dealt once, and a task sends only what may be among the best."""
    docs, _ = corpus(5, 300)
    index = SR.build(spark.createDataFrame(docs, "id string, content string").repartition(3))
    queries = [(i, f"{name(0)} {name(1)} {name(2 + i % 50)}") for i in range(200)]
    q = spark.createDataFrame(queries, "query_id long, query string")
    split = SR.split_terms(SR.query_terms(index, q), SR.thresholds(index, SR.query_terms(index, q), 2))
    n = SR._best(index, split, 2).count()
    assert 400 <= n < 200 * len(docs) / 4
    assert run(spark, index, queries, 2) == brute(docs, queries, 2)


def test_blocks_of_queries_and_of_texts(spark, monkeypatch):
    docs, queries = corpus(6, 120)
    index = SR.build(spark.createDataFrame(docs, "id string, content string"))
    monkeypatch.setattr(SR, "QUERIES", 6)
    monkeypatch.setattr(SR, "CELLS", 50)
    assert run(spark, index, queries, 4) == brute(docs, queries, 4)


def test_a_text_may_span_batches():
    import pyarrow as pa
    schema = pa.schema([("id", pa.string()), ("term_no", pa.int32()), ("weight", pa.float64())])
    rows = [(None, 0, 1.0), (None, 0, 2.0), ("a", 0, 1.0), ("a", 1, 2.0), ("a", 1, 4.0), ("b", 0, 8.0)]
    for size in (1, 2, 3, 6):
        batches = [pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[i:i + size]), schema)], schema=schema)
                   for i in range(0, 6, size)]
        got = {}
        for ids, doc, term, weight in SR._whole_texts(iter(batches)):
            for d, t, w in zip(doc, term, weight):
                key = ids[int(d)].as_py(), int(t)
                got[key] = got.get(key, 0) + w
            assert ids.null_count + len(set(ids.to_pylist()) - {None}) == len(ids)
        assert got == {(None, 0): 3.0, ("a", 0): 1.0, ("a", 1): 6.0, ("b", 0): 8.0}


def staged_bytes(spark):
    top = ensure_checkpoint_dir(spark).removeprefix("file:")
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(top) for f in names)


def test_a_built_index_is_smaller_than_its_texts(spark):
    """Postings lie by text: staged, they take a quarter of the texts (22 %; 28 and 37 % as rows of term, id and weight), also with terms in many parts."""
    r = random.Random(7)
    words = ["".join(r.choices("abcdefghij", k=6)) for _ in range(3000)]
    docs = [(f"some-document-{i}-txt-{i % 7}", " ".join(r.choices(words, [1 / (i + 1) for i in range(3000)], k=r.randrange(40, 200)))) for i in range(3000)]
    df = spark.createDataFrame(docs, "id string, content string").repartition(2)
    for hot in (SR.HOT, 20):
        before = staged_bytes(spark)
        index = SR.build(df, hot=hot)
        assert staged_bytes(spark) - before < 0.25 * sum(len(t) for _, t in docs)
        assert index.postings.count() == sum(len(set(t.split())) for _, t in docs)
    assert index.postings.agg(F.max("salt")).first()[0] > 2


def test_no_posting_moves_where_texts_are_scored(spark, capsys):
    docs, queries = corpus(8, 60)
    index = SR.build(spark.createDataFrame(docs, "id string, content string"))
    q = spark.createDataFrame(queries, "query_id long, query string")
    wanted = SR.query_terms(index, q)
    SR._best(index, SR.split_terms(wanted, SR.thresholds(index, wanted, 3)), 3).explain()
    plan = capsys.readouterr().out
    assert "MapInArrow" in plan and "hashpartitioning" not in plan and "Sort" not in plan


def test_texts_that_share_an_id(spark):
    """Of one id and length the counts add up, of one id the scores; all rows count for the average length."""
    docs, queries = corpus(9, 150)
    docs += [("d0003", docs[3][1]), ("d0003", "wa wb wb wcc"), ("d0004", "wcc wd"), ("d0004", ""), (None, "wa wd wd"), (None, "wd we wa"), (None, "")]
    said = [(i, terms(t)) for i, t in docs if t is not None]
    n, avg = len(said), sum(len(t) for _, t in said) / len(said)
    tf, df, scores = {}, {}, {}
    for i, t in said:
        for w in t:
            tf[i, len(t), w] = tf.get((i, len(t), w), 0) + 1
    for _, _, w in tf:
        df[w] = df.get(w, 0) + 1
    for q, text in queries:
        for w in terms(text):
            for (i, length, x), c in tf.items():
                if x == w:
                    scores.setdefault(q, {}).setdefault(i, []).append(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * length / avg)))
    want = {(q, i): round(sum(x), 6) for q, of in scores.items() for i, x in of.items()}
    index = SR.build(spark.createDataFrame(docs, "id string, content string").repartition(3))
    assert index.loose.select("id").distinct().count() == 3 and index.texts.filter("id is null or id in ('d0003', 'd0004')").isEmpty()
    q = spark.createDataFrame(queries, "query_id long, query string")
    got = {(r["query_id"], r["id"]): round(r["score"], 6) for r in SR.search(index, q, 1000).collect()}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 2e-6 for x in want)


def test_blocks_of_parts(spark, monkeypatch):
    docs, queries = corpus(10, 120)
    index = SR.build(spark.createDataFrame(docs, "id string, content string"))
    monkeypatch.setattr(SR, "PARTS", 30)
    assert run(spark, index, queries, 4) == brute(docs, queries, 4)


def test_batches_of_texts_are_read_by_row():
    import numpy as np
    import pyarrow as pa
    batch = pa.RecordBatch.from_arrays([pa.array(["x", "y", "z"]), pa.array([4, 1, 2], pa.int32()), pa.array(["a b c", "d", "c e"]),
                                        pa.array([[1, 2, 1], [1], [1, 1]], pa.list_(pa.int32()))], ["id", "len", "terms", "tfs"])
    (ids, doc, term, weight), = SR._texts_of(["b", "c"], (1.2, 0.75, 2.0))(iter([batch, batch.slice(0, 0)]))
    assert ids.to_pylist() == ["x", "y", "z"] and doc.tolist() == [0, 0, 2] and term.tolist() == [0, 1, 1]
    assert np.allclose(weight, [tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / 2)) for tf, length in ((2, 4), (1, 4), (1, 2))])
    (ids, doc, term, weight), = SR._texts_of(["b", "c"], (1.2, 0.75, 2.0))(iter([batch.slice(2, 1)]))
    assert ids.to_pylist() == ["z"] and doc.tolist() == [0] and term.tolist() == [1] and len(weight) == 1
    assert list(SR._blocks(np.array([0, 0, 2, 3]), np.array([5, SR.PARTS, 1, SR.PARTS]), 5, 2)) == [(0, 1), (1, 3), (3, 5)]


def test_contents_stay_where_no_id_repeats(spark):
    """Rows sent for an index move only when ids repeat among them; of those the last row wins."""
    rows = spark.createDataFrame([("a", "x", 0), ("b", "y", 1), (None, "z", 2)], "id string, content string, section_no int").withColumn("sourcefile", F.lit("f"))
    assert IX.dedup_incoming(rows) is rows
    more = rows.unionByName(rows.withColumn("content", F.lit("new")).withColumn("section_no", F.lit(9)).filter("id = 'a' or id is null"))
    assert sorted(map(str, IX.dedup_incoming(more).select("id", "content").collect())) == sorted(
        f"Row(id={i!r}, content={c!r})" for i, c in (("a", "new"), ("b", "y"), (None, "z"), (None, "new")))


def test_texts_stay_where_labels_are_few(spark, tmp, monkeypatch, capsys):
    """Texts are not dealt out for a few labels; with more, the rows are the same."""
    docs = [(i, f"text {i} " * 40, "s") for i in range(30)] + [(None, "no number", "s"), (3, "again", "s"), (7, None, "s")]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp}/documents.parquet")
    labels = [(i, i % 2, 0) for i in range(0, 30, 3)] + [(3, 1, 1), (None, 1, 0), (6, None, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp}/labels.parquet")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few = Q.doc_section_input(spark, tmp)
        few.explain()
        assert "BroadcastHashJoin" in capsys.readouterr().out
        monkeypatch.setattr(Q, "FEW_LABELS", 3)
        more = Q.doc_section_input(spark, tmp)
        more.explain()
        assert "BroadcastHashJoin" not in capsys.readouterr().out
        assert sorted(map(str, few.collect())) == sorted(map(str, more.collect()))
        assert few.count() == 35
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_small_staged_table(spark):
    rows = spark.range(100).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n"))
    before = spark.conf.get(SHUFFLE_CLEANUP_CONF, None)
    staged = stage_table(rows, small=True)
    assert spark.conf.get(SHUFFLE_CLEANUP_CONF, None) == before
    assert sorted(staged.collect()) == sorted(rows.collect())
    assert all(".zstd." in f for f in os.listdir(staged._staged_at.removeprefix("file:")) if f.endswith(".parquet"))
