from pyspark.sql import functions as F

from docweave.functions import text as TX
from docweave.functions import urls as U


def one(spark, col, value, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(col.alias("o")).first()["o"]


def test_clean_text_rules(spark):
    c = TX.clean_text(F.col("v"))
    assert one(spark, c, "   a\r\n\n\nb\t\tc   d \n \n e 　") == "a\nb c d \n \n e"
    # idempotent
    once = one(spark, c, "x \n\n  y\t z ")
    assert one(spark, c, once) == once


def test_flatten_newlines_two_passes(spark):
    f = TX.flatten_newlines(F.col("v"))
    assert one(spark, f, "a" + " " * 5 + "b") == "a" + " " * 2 + "b"   # 5 -> 3 -> 2
    assert one(spark, f, "a\n\nb") == "a b"
    assert one(spark, f, "a\\nb") == "a\\nb"                           # literal kept by default
    assert one(spark, TX.flatten_newlines(F.col("v"), literal_newlines=True), "a\\nb") == "a b"


def test_token_count_and_split(spark):
    assert one(spark, TX.token_count(F.col("v")), "Hello, world 12345!") == 6  # Hello , world 123 45 !
    assert one(spark, TX.split_sentences(F.col("v")), "a. b. ") == ["a", "b", ""]


def test_escape_unescape_rfind(spark):
    assert one(spark, TX.html_escape(F.col("v")), "<a href=\"x\">'&'</a>") == \
        "&lt;a href=&quot;x&quot;&gt;&#x27;&amp;&#x27;&lt;/a&gt;"
    assert one(spark, TX.html_unescape(F.col("v")), "&amp;lt; &copy; &middot; &quot;") == "&lt; © · \""
    assert one(spark, TX.rfind(F.col("v"), "<table"), "x<table a<table b") == 9
    assert one(spark, TX.rfind(F.col("v"), "<table"), "none") == -1


HREFS = [
    ("#", "#"), ("#x", "#x"), ("", "https://h.com"), ("mailto:a@b", "mailto:a@b"), ("tel:1", "tel:1"),
    ("/a", "https://h.com/a"), ("//cdn/x", "https://h.com//cdn/x"), ("../x", "https://h.com/../x"),
    ("?q=1", "https://h.com/?q=1"), ("https://other/x", ""), ("https://h.com:8080/x", ""),
    ("https://h.com/x/", "https://h.com/x"), ("http://h.com/y", "http://h.com/y"), ("a/b/", "https://h.com/a/b"),
]


def test_clean_link_limited(spark):
    df = spark.createDataFrame(HREFS, "h string, want string")
    got = df.select("want", U.clean_link("h", F.lit("https"), F.lit("h.com"), True).alias("got")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


def test_clean_link_not_limited_keeps_other_sites(spark):
    df = spark.createDataFrame([("https://other/x/",)], "h string")
    r = df.select(U.clean_link("h", F.lit("https"), F.lit("h.com"), False).alias("o")).first()
    assert r["o"] == "https://other/x"


def test_clean_link_legacy(spark):
    cases = [("tel:1", "https://h.com/tel:1"), ("#x", None), ("mailto:a", None), ("", "https://h.com"),
             ("/a/", "https://h.com/a"), ("https://x.org/a", None)]
    df = spark.createDataFrame(cases, "h string, want string")
    got = df.select("want", U.clean_link_legacy("h", F.lit("h.com")).alias("got")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


def test_page_key(spark):
    cases = [("https://x.com/", "home"), ("https://x.com", "home"), ("https://x.com/a/b.html", "a_b"),
             ("https://x.com/?q=1", ""), ("https://x.com/a.b/c", "a.b_c"), ("https://x.com/a/.hidden", "a_.hidden"),
             ("https://x.com/x/a..b", "x_a."), ("https://x.com/en/5/", "en_5"), ("https://x.com/p#top", "p"),
             ("https://x.com/a/?q=1", "a_"), ("https://x.com/a/b.jsp;jsessionid=1?x", "a_b"),
             ("https://x.com/a;p/b", "a;p_b")]
    df = spark.createDataFrame(cases, "u string, want string")
    got = df.select("want", U.page_key("u").alias("got")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


def test_blob_names_and_ids(spark):
    df = spark.createDataFrame([("a.pdf", 3), ("dir/B.PDF", 0), ("x.txt", 2), ("noext", 1)], "f string, p int")
    got = [r["o"] for r in df.select(U.blob_name("f", "p").alias("o")).collect()]
    assert got == ["a-3.pdf", "B-0.pdf", "x.txt", "noext"]
    r = spark.createDataFrame([("my file.pdf-3",)], "v string").select(U.sanitize_id("v").alias("o")).first()
    assert r["o"] == "my_file_pdf-3"


def test_pluggable_token_counter(spark):
    # a Python encoder wrapped as Arrow-batched UDFs (stands in for a tokenizer vocabulary)
    c = TX.PandasTokenCounter(lambda s: s.split())
    df = spark.createDataFrame([("a b  c",)], "v string")
    r = df.select(c.count(F.col("v")).alias("n"), c.count_each(F.split(F.col("v"), ",")).alias("e")).first()
    assert r["n"] == 3 and r["e"] == [3]
    tk = TX.tiktoken_counter()
    assert tk is None or isinstance(tk, TX.PandasTokenCounter)


def test_unescape_single_pass_and_legacy_names(spark):
    import html
    cases = ["&amp;amp;", "&amp", "x&ampy", "&amplt;", "&am", "&", "a&&b", "&copyright", "&nbsp;x&nbspy",
             "&lt&gt&quot&#39;", "&hellip", "&hellip;", "& amp;", "&ampcopy", "&middot; end"]
    df = spark.createDataFrame([(c,) for c in cases], "v string")
    got = [r["o"] for r in df.select(TX.html_unescape(F.col("v")).alias("o")).collect()]
    assert got == [html.unescape(c) for c in cases]
