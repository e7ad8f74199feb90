from pyspark.sql import functions as F

from docweave.operators import chunking as CH


def pack(spark, text, max_tokens, lossless=False, keep_tail=False):
    df = spark.createDataFrame([(text,)], "t string")
    return df.select(CH.pack_sentences(F.col("t"), max_tokens, lossless, keep_tail=keep_tail).alias("c")).first()["c"]


def test_no_text_is_lost_by_default(spark):
    import re
    texts = ["a b c d e f. g. h i", ". ".join(["w"] * 10), "x " * 700 + ". y", "12345678 " * 40, "", ". . ", "no end " * 9,
             "  lead. " + "long\t\nword " * 90 + " . tail "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, t string")
    for r in df.select("t", CH.pack_sentences(F.col("t"), 20).alias("c")).collect():
        assert re.sub(r"[\s.]", "", "".join(r["c"])) == re.sub(r"[\s.]", "", r["t"])
        assert "." not in r["c"] or not r["t"].strip(". ")
    whole = CH.chunks(df.withColumnRenamed("t", "text"), max_tokens=20)
    assert whole.agg(F.max("n_tokens")).first()[0] <= 21
    assert whole.select("doc_id").distinct().count() == len(texts)


def test_oversize_sentence_is_cut_by_tokens(spark):
    assert pack(spark, "a. b c d e f g. h", 4, lossless=True) == ["a.", "b c d", " e f g", "h."]


def test_oversize_first_sentence_exact_limit_and_tail(spark):
    text = "a b c d e f. g. h i"          # costs: 6, 1, 2 (tokens of " " + sentence)
    assert pack(spark, text, 4) == ["."]                     # flush of an empty chunk; tail lost
    assert pack(spark, text, 4, keep_tail=True) == [".", "g. h i."]   # 0+1, then 2+2 == 4 fits


def test_long_text_tail_lost_if_asked_for(spark):
    text = ". ".join(["w"] * 10)          # ten sentences of cost 1, each takes 2
    assert pack(spark, text, 5) == ["w. w. w.", "w. w. w.", "w. w. w."]
    assert pack(spark, text, 5, keep_tail=True) == ["w. w. w.", "w. w. w.", "w. w. w.", "w."]


def test_chunks_threshold_and_nulls(spark):
    docs = spark.createDataFrame([(1, "short text"), (2, ". ".join(["word"] * 12)), (3, None)],
                                 "doc_id long, text string")
    out = CH.chunks(docs, max_tokens=6, lossless=False).orderBy("doc_id", "chunk_no").collect()
    got = [(r["doc_id"], r["chunk_no"], r["text"]) for r in out]
    assert got[0] == (1, 0, "short text")
    # each kept sentence costs 1 + 1: three per chunk, the open tail is lost
    assert [g[2] for g in got[1:]] == ["word. word. word."] * 3
    assert all(r["n_tokens"] is not None for r in out)


def test_packing_properties(spark):
    import random
    rnd = random.Random(7)
    words = ["alpha", "be", "c", "delta", "12345", "x-y"]
    texts = [". ".join(" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 9)))
                       for _ in range(rnd.randint(1, 40))) for _ in range(30)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, t string")
    res = df.select("doc_id", "t", CH.pack_sentences(F.col("t"), 20, True).alias("c")).collect()
    for r in res:
        for chunk in r["c"]:
            if chunk == ".":
                continue
            sents = chunk[:-1].split(". ")
            assert all(s in r["t"] for s in sents)


def test_histogram_bins(spark):
    df = spark.createDataFrame([(v,) for v in [0, 1, 5, 9, 10, 10]], "n long")
    got = {r["bin"]: r["count"] for r in CH.token_histogram(df, "n", 10).collect()}
    assert got == {1: 1, 2: 1, 3: 0, 4: 0, 5: 0, 6: 1, 7: 0, 8: 0, 9: 0, 10: 3}
    one = spark.createDataFrame([(4,), (4,)], "n long")
    assert {r["bin"]: r["count"] for r in CH.token_histogram(one, "n", 10).collect()}[6] == 2


def test_chunks_with_pluggable_counter(spark):
    from docweave.functions import text as TX
    c = TX.PandasTokenCounter(lambda s: s.split())       # stands in for a tokenizer vocabulary
    docs = spark.createDataFrame([(1, ". ".join(["a b c"] * 30)), (2, "short")], "doc_id long, text string")
    rows = CH.chunks(docs, max_tokens=10, counter=c).orderBy("doc_id", "chunk_no").collect()
    assert rows[0]["text"] == "a b c. a b c." and rows[0]["n_tokens"] == 6
    assert (rows[-1]["doc_id"], rows[-1]["text"], rows[-1]["n_tokens"]) == (2, "short", 1)


def packed_by_hand(text, limit, lossless, keep_tail):
    import re
    count = lambda t: len(re.findall(r"[^\W\d_]+|\d{1,3}|[^\t\n\x0b\f\r \w]+", t))
    done, cur, n = [], [], 0
    for s in text.split(". "):
        c = count(" " + s)
        if n + c > limit:
            if cur or not lossless:
                done.append(". ".join(cur) + ".")
            cur, n = [], 0
        if c > limit:
            if lossless:
                units = re.findall(r"[\t\n\x0b\f\r ]*(?:[^\W\d_]+|\d{1,3}|[^\t\n\x0b\f\r \w]+)|[\t\n\x0b\f\r ]+$", s)
                done += ["".join(units[i:i + limit - 1]) for i in range(0, len(units), limit - 1)]
            n = 0
            continue
        cur.append(s)
        n += c + 1
    if cur and (lossless or keep_tail):
        done.append(". ".join(cur) + ".")
    return done


def test_packing_follows_the_rules(spark):
    import random
    from pyspark.sql import functions as F
    from docweave.operators import chunking as CH
    r = random.Random(9)
    texts = [". ".join(" ".join(r.choice(["ab", "c", "12345", "x!"]) for _ in range(r.choice([0, 1, 3, 9, 25]))) for _ in range(r.randrange(1, 30)))
             for _ in range(60)] + ["", ". ", ". . ", "one"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for lossless, tail in ((True, False), (False, False), (False, True)):
        got = {x["i"]: x["p"] for x in df.select("i", CH.pack_sentences(F.col("t"), 12, lossless, keep_tail=tail).alias("p")).collect()}
        for i, t in enumerate(texts):
            assert got[i] == packed_by_hand(t, 12, lossless, tail), (lossless, tail, t)


def test_packing_time_grows_with_the_text(spark):
    """Twice the sentences take about twice the time (2 and 4 MB)."""
    import time
    from pyspark.sql import functions as F
    from docweave.operators import chunking as CH
    took = []
    for n in (4000, 50_000, 100_000):
        text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit("some words of sentence "), i.cast("string"), F.lit(" and so on"))), ". ")
        df = spark.range(1).select(text.alias("t"))
        began = time.perf_counter()
        out = df.select(F.size(CH.pack_sentences(F.col("t"), 500)).alias("n")).first()["n"]
        took.append(time.perf_counter() - began)
        assert out > n // 60
    assert took[2] < 2.6 * took[1] + 1


def test_one_long_sentence_is_cut_in_linear_time(spark):
    import time
    from pyspark.sql import functions as F
    from docweave.operators import chunking as CH
    took = []
    for n in (1000, 200_000, 400_000):
        df = spark.range(1).select(F.repeat(F.lit("word "), n).alias("t"))
        began = time.perf_counter()
        got = df.select(CH.pack_sentences(F.col("t"), 500).alias("p")).first()["p"]
        took.append(time.perf_counter() - began)
        assert "".join(got) == "word " * n
    assert took[2] < 2.6 * took[1] + 1
