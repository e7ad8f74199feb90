from pyspark.sql import functions as F

from docweave.operators import frontier as FR
from docweave.operators import layout as L

EDGES = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "a"), ("d", "e"), ("e", "f"), ("b", "x")]


def run(spark, depth):
    e = spark.createDataFrame(EDGES, "src string, dst string")
    s = spark.createDataFrame([("a",)], "url string")
    return {r["url"]: r["depth"] for r in FR.expand(s, e, depth).collect()}


def test_cycle_diamond_depth_cut(spark):
    assert run(spark, 1) == {"a": 1}
    assert run(spark, 3) == {"a": 1, "b": 2, "c": 2, "d": 3, "x": 3}
    assert run(spark, 4) == {"a": 1, "b": 2, "c": 2, "d": 3, "x": 3, "e": 4}
    assert run(spark, 99) == {"a": 1, "b": 2, "c": 2, "d": 3, "x": 3, "e": 4, "f": 5}


def test_crawl_frontier_from_pages(spark):
    from docweave.operators import web as W
    pages = spark.createDataFrame([
        (1, "https://s.com/", '<body><a href="/p1">1</a><a href="https://o.org/q">o</a></body>'),
        (2, "https://s.com/p1", '<body><a href="/p2/">2</a><a href="/">home</a></body>'),
        (3, "https://s.com/p2", '<body><a href="/p3">3</a></body>')], "page_id long, url string, html string")
    links = W.page_links(pages)
    seeds = spark.createDataFrame([("https://s.com",)], "url string")
    got = {r["url"]: r["depth"] for r in FR.crawl_frontier(pages, links, 3, seeds).collect()}
    assert got == {"https://s.com": 1, "https://s.com/p1": 2, "https://s.com/p2": 3}


def test_stored_crawl_goes_on(spark, tmp):
    e = spark.createDataFrame(EDGES, "src string, dst string")
    s = spark.createDataFrame([("a",), ("a",)], "url string")
    for depth in (1, 2, 2, 4, 9):
        got = {r["url"]: r["depth"] for r in FR.expand(s, e, depth, state=tmp + "/crawl").collect()}
        assert got == run(spark, depth)
    assert {r["url"]: r["depth"] for r in FR.expand(s, e, 3, state=tmp + "/crawl").collect()} == run(spark, 3)


def test_depths_that_are_stored_are_not_computed_again(spark, tmp):
    e = spark.createDataFrame(EDGES, "src string, dst string")
    s = spark.createDataFrame([("a",)], "url string")
    FR.expand(s, e, 3, state=tmp + "/crawl")
    # only links from depth 3 on matter now
    late = e.filter("src in ('d', 'x', 'e')")
    got = {r["url"]: r["depth"] for r in FR.expand(s.limit(0), late, 9, state=tmp + "/crawl").collect()}
    assert got == run(spark, 9)


def test_a_round_moves_only_its_candidates(spark, tmp):
    """Links and visited set are read in their buckets: the one exchange is that of the candidates."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        from docweave.session import bucketed_table
        for n in (8, 4):                       # as many buckets as shuffle partitions, and another number
            v = FR.Visited(spark, f"{tmp}/crawl{n}", n)
            v.add(spark.createDataFrame([("a",)], "url string"), 1)
            df = v.beyond(1, bucketed_table(spark.createDataFrame(EDGES, "src string, dst string"), "src", n))
            assert {r["url"] for r in df.collect()} == {"b", "c"}
            plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
            assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Bucketed: true") == 3
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_no_seeds_or_links(spark):
    e = spark.createDataFrame([], "src string, dst string")
    s = spark.createDataFrame([("a",)], "url string")
    assert FR.expand(s.limit(0), e, 3).collect() == []
    assert [tuple(r) for r in FR.expand(s, e, 3).collect()] == [("a", 1)]


CELL = "row_index int, column_index int, kind string, row_span int, column_span int, content string"


def test_table_html(spark):
    cells = [(0, 1, "columnHeader", 1, 1, "B"), (0, 0, "columnHeader", 1, 1, "A&B"),
             (2, 0, "content", 2, 2, "x<y"), (5, 0, "content", 1, 1, "dropped")]
    df = spark.createDataFrame([(3, cells)], f"row_count int, cells array<struct<{CELL}>>")
    got = df.select(L.table_html("row_count", "cells").alias("h")).first()["h"]
    assert got == ("<table><tr><th>A&amp;B</th><th>B</th></tr><tr></tr>"
                   "<tr><td colSpan=2 rowSpan=2>x&lt;y</td></tr></table>")
    empty = spark.createDataFrame([(0, [])], f"row_count int, cells array<struct<{CELL}>>")
    assert empty.select(L.table_html("row_count", "cells").alias("h")).first()["h"] == "<table></table>"


LAYOUT = ("sourcefile string, content string, pages array<struct<page_num int, offset int, length int>>, "
          f"tables array<struct<row_count int, page_number int, spans array<struct<offset int, length int>>, "
          f"cells array<struct<{CELL}>>>>")


def _layout(spark, tables):
    content = "abcXYZdef" + "ghQRij"
    pages = [(0, 0, 9), (1, 9, 6)]
    return spark.createDataFrame([("f.pdf", content, pages, tables)], LAYOUT)


def test_overlay_tables_across_pages(spark):
    t0 = (1, 1, [(3, 3)], [(0, 0, "content", 1, 1, "T0")])
    t1 = (1, 1, [(7, 4)], [(0, 0, "content", 1, 1, "T1")])      # starts on page 1, runs into page 2
    t2 = (1, 2, [(11, 2)], [(0, 0, "content", 1, 1, "T2")])
    got = {r["page_num"]: r["text"] for r in L.overlay_pages(_layout(spark, [t0, t1, t2])).collect()}
    h = lambda s: f"<table><tr><td>{s}</td></tr></table>"
    assert got[0] == "abc" + h("T0") + "d" + h("T1") + " "
    # page 2 keeps the characters of T1 (not its table) and replaces T2's
    assert got[1] == "gh" + h("T2") + "ij "


def test_overlay_later_table_wins(spark):
    t0 = (1, 1, [(3, 3)], [(0, 0, "content", 1, 1, "A")])
    t1 = (1, 1, [(5, 2)], [(0, 0, "content", 1, 1, "B")])
    got = {r["page_num"]: r["text"] for r in L.overlay_pages(_layout(spark, [t0, t1])).collect()}
    assert got[0] == "abc<table><tr><td>A</td></tr></table><table><tr><td>B</td></tr></table>ef "


def test_layout_cells(spark):
    t0 = (2, 1, [(0, 1)], [(0, 0, "content", 1, 1, "a"), (1, 0, "content", 1, 1, "b")])
    rows = L.layout_cells(_layout(spark, [t0])).orderBy("row_index").collect()
    assert [(r["table_id"], r["page_number"], r["row_index"], r["content"]) for r in rows] == \
        [(0, 1, 0, "a"), (0, 1, 1, "b")]


def painted_by_characters(text, spans, html):
    out, written = [], set()
    for k, c in enumerate(text):
        owner = max((i for a, b, i in spans if a <= k < b), default=None)
        if owner is None:
            out.append(c)
        elif owner not in written:
            written.add(owner)
            out.append(html[owner])
    return "".join(out)


def test_paint_equals_a_look_at_every_character():
    import random
    r = random.Random(2)
    for _ in range(300):
        text = "".join(r.choice("abc\u00e9") for _ in range(r.randrange(40)))
        tables = r.randrange(5)
        spans = [(a := r.randrange(-5, 45), a + r.randrange(0, 20), r.randrange(tables)) for _ in range(r.randrange(12))] if tables else []
        html = [f"<{i}>" for i in range(tables)]
        assert L.paint(text, spans, html) == painted_by_characters(text, spans, html)


def test_many_spans_on_a_page(spark):
    """10,000 spans: twice as many take about twice as long, not four times."""
    import time
    took = []
    for n in (20_000, 40_000):
        text = "ab" * n
        spans = [(2 * k, 2 * k + 1, k % 7) for k in range(n)]
        began = time.perf_counter()
        out = L.paint(text, spans, [f"<{i}>" for i in range(7)])
        took.append(time.perf_counter() - began)
        assert out.count("b") == n and out.count("a") == 0 and len(out) == n + 21
    assert took[1] < 3.5 * took[0] + 0.05
    tables = [(1, 1, [(2 * k, 1) for k in range(i, 10_000, 7)], [(0, 0, "content", 1, 1, str(i))]) for i in range(7)]
    df = spark.createDataFrame([("f.pdf", "ab" * 10_000, [(0, 0, 20_000), (1, 20_000, 0)], tables)], LAYOUT)
    got = {x["page_num"]: x["text"] for x in L.overlay_pages(df).collect()}
    assert got[0].count("b") - got[0].count("tab") == 10_000 and got[0].count("<table>") == 7 and got[1] == " "
