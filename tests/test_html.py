from pyspark.sql import functions as F

from docweave.operators import html_tree as HT
from docweave.operators import web as W

PAGE = ("<html><head><title>T &amp; co</title><style>p{x}</style><script>var t=\"</p>\";</script></head>"
        "<body><nav class=\"n\"><a href=\"/a/\">A</a> <a href=\"#\">Top</a></nav><!-- c -->"
        "<h1>Heading</h1><p>Para 1.<p>Para&nbsp;2 &copy;</p><form><a href=\"/f\">F</a></form>"
        "<a href=\"https://other.org/z\">Z</a><a href=\"mailto:m@h.com\">M</a><a>none</a>"
        "<footer>&middot; end</footer></body></html>")


def pages(spark, html=PAGE, url="https://h.com/dir/p.html"):
    return spark.createDataFrame([(1, url, html)], "page_id long, url string, html string")


def test_page_text(spark):
    r = W.page_texts(pages(spark)).first()
    assert r["page_key"] == "dir_p"
    assert r["text"] == ("T & co\n\nA https://h.com/a Heading"
                         "Para 1.Para\u00a02 \u00a9Z https://other.org/z M mailto:m@h.com none \u00b7 end")


def test_links_skip_dropped_elements_and_other_sites(spark):
    got = sorted(r["link"] for r in W.page_links(pages(spark)).collect())
    assert got == ["https://h.com/a"]


def test_simplify_removes_and_rewrites(spark):
    h = W.simplify_pages(pages(spark)).first()["html"]
    assert "<script" not in h and "<style" not in h and "<form" not in h and "<!--" not in h
    assert 'class=' not in h
    assert '<a href="https://h.com/a">' in h and '<a href="#">' in h and 'href="mailto:m@h.com"' in h


def test_no_title_and_no_closing_body(spark):
    html = "<html><body><p>x</p><a href='/q'>q</a>"
    r = W.page_texts(pages(spark, html)).first()
    assert r["text"] == "xq https://h.com/q"


def test_dedup_last_writer_wins(spark):
    df = spark.createDataFrame([(1, "https://h.com/a.html", "<p>1"), (2, "https://h.com/a/", "<p>2"),
                                (3, "https://h.com/b", "<p>3"), (4, "https://h.com/?q", "<p>4")],
                               "page_id long, url string, html string")
    got = {r["page_key"]: (r["page_id"], r["n_versions"]) for r in W.dedup_pages(df).collect()}
    assert got == {"a": (2, 2), "b": (3, 1)}


def test_route_pages(spark):
    df = spark.createDataFrame([("u1", "text/html; charset=utf-8"), ("u2", "application/pdf"),
                                ("u3", "image/png"), ("u4", "Application/PDF")], "url string, content_type string")
    got = {r["url"]: r["route"] for r in W.route_pages(df).collect()}
    assert got == {"u1": "html", "u2": "pdf"}


def test_tag_audit(spark):
    html = "<body><div><p>a</p><blockquote>q</blockquote><custom-x>y</custom-x></div></body>"
    r = W.tag_audit(pages(spark, html)).first()
    assert r["tags"] == "blockquote,custom,div,p" and r["unhandled"] == "blockquote,custom"
    assert r["convertible"] is False


def test_tree_lines_and_nested_anchor_text():
    html = "<h1>H</h1><ul><li>one <a href='x'>L</a></li><li>two</li></ul><a>nohref</a><p><span>s</span> t</p>"
    assert HT.element_lines(html) == ["H", "one L", "L x", "two", "s t", "s"]
    assert HT.anchor_text("<p>a<a href='x'><b>B</b>tail</a>c<a href='#'>top</a></p>") == "aBtail x Bc"


def test_parts_missing_blocks(spark):
    r = W.page_parts(pages(spark, "<body><header>h</header><p>x</p></body>")).first()
    assert r["header_len"] == len("<header>h</header>") and r["footer"] is None and r["footer_len"] is None


def test_link_modes(spark):
    from docweave.functions import html as H
    html = "<p>see <a href='/x'>X</a> and <a href='#'>top</a></p>"
    df = spark.createDataFrame([(html,)], "h string")

    def render(mode):
        return df.select(H.inline_links("h", F.lit("https"), F.lit("h.com"), mode).alias("o")).first()["o"]

    assert render("text_href") == "see X https://h.com/x  and "
    assert render("text_colon") == "see X: https://h.com/x  and "
    assert render("plain") == "see X and top"
    assert render("tag") == "see <a href='/x'>X</a> and <a href='#'>top</a>"


def test_legacy_plain_text_keeps_literal_backslash_n_rule(spark):
    html = "<body><p>a\\nb</p>\n<p>c  d</p></body>"
    r = W.page_texts_plain(pages(spark, html, "https://s.com/x/y")).first()
    assert r["text"] == "a b c d" and r["page_key"] == "s.com_x_y.txt"


def test_tree_link_mode_repeats_nested_anchor_text(spark):
    html = "<title>T</title><body><p>a<a href='/x'><b>B</b>tail</a>c</p><a href='#'>top</a></body>"
    r = W.page_texts(pages(spark, html), link_mode="tree").first()
    assert r["text"] == "T\n\naBtail https://h.com/x Bc"
    assert W.page_texts(pages(spark, html)).first()["text"] == "T\n\naBtail https://h.com/x c"


def test_raw_page_files(spark, tmp):
    import os
    from docweave.sources import files as FI
    os.makedirs(os.path.join(tmp, "site", "a"))
    with open(os.path.join(tmp, "site", "a", "p.html"), "w", encoding="utf-8") as f:
        f.write("<body>é</body>")
    rows = FI.read_raw_pages(spark, os.path.join(tmp, "site")).collect()
    assert len(rows) == 1 and rows[0]["html"] == "<body>é</body>" and rows[0]["path"].endswith("a/p.html")


def test_href_attribute_name_is_exact(spark):
    html = '<body><a data-href="/no" href="/yes">y</a><a\nhref=/bare>b</a></body>'
    got = sorted(r["link"] for r in W.page_links(pages(spark, html)).collect())
    assert got == ["https://h.com/bare", "https://h.com/yes"]
    simp = W.simplify_pages(pages(spark, html)).first()["html"]
    assert 'data-href="/no" href="https://h.com/yes"' in simp and 'href="https://h.com/bare"' in simp


def test_quoted_attributes_and_nested_elements(spark):
    from docweave.functions import html as H
    from docweave.operators import web as W
    body = ('<body><a title="a > b" href="/real">x</a> Set the class = 5 apples <p class="k">p</p>'
            '<svg><svg><text>in</text></svg><text>LEAK</text></svg>tail<form><button>b</button>GONE</form>end<svg>open</body>')
    html = f"<html><title>t</title>{body}</html>"
    df = spark.createDataFrame([(1, "https://s.com/a", html)], "page_id long, url string, html string")
    assert [r["link"] for r in W.page_links(df).collect()] == ["https://s.com/real"]
    text = W.page_texts(df).first()["text"]
    assert "LEAK" not in text and "GONE" not in text and 'b" href' not in text
    assert "class = 5 apples" in text and "tail" in text and text.endswith("endopen")
    simple = W.simplify_pages(df).first()["html"]
    assert "class = 5 apples" in simple and "<p>p</p>" in simple and 'class="k"' not in simple
    assert df.select(H.hrefs("html").alias("h")).first()["h"] == ["/real"]


def test_legacy_links_skip_scripts_and_comments(spark):
    from docweave.operators import web as W
    html = "<a href='/one'>1</a><script>x='<a href=/inscript>'</script><!-- <a href='/incomment'> -->"
    df = spark.createDataFrame([(1, "https://s.com/a", html)], "page_id long, url string, html string")
    assert [r["link"] for r in W.page_links_legacy(df).collect()] == ["https://s.com/one"]


def test_every_kind_of_reference(spark):
    import html
    from docweave.functions import text as TX
    texts = ["caf&eacute; it&#8217;s &rarr; &#x2019;", "&amp;amp; &amp &#39; &#x27;", "&#128; &#0; &#xD800; &#99999999999; &#x110000;",
             "&nosuch; & &; &#; &#x;", "&notin; &NotEqualTilde; &#128512;", "plain"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    for r in df.select("t", TX.html_unescape("t").alias("u")).collect():
        assert r["u"] == html.unescape(r["t"])


def test_lines_of_pages_without_lines(spark):
    from docweave.operators import html_tree as HT
    df = spark.createDataFrame([(1, ""), (2, "<div>x</div>"), (3, None)], "page_id long, html string").repartition(3)
    assert HT.tag_lines(df).collect() == []
    assert HT.element_lines("<p>a<b></p>c</b></div><p>d") == ["a", "d"]


def test_many_dropped_elements(spark):
    """A page of 4 MB with 16,000 buttons."""
    import time
    from pyspark.sql import functions as F
    from docweave.functions import html as H
    unit = "<p>" + "some text " * 24 + "</p><button class=x>go <b>on</b></button>"
    took = []
    for n in (8000, 16_000):
        df = spark.range(1).select(F.repeat(F.lit(unit), (F.col("id") + n).cast("int")).alias("html"))
        began = time.perf_counter()
        got = df.select(H.remove_elements("html").alias("h")).first()["h"]
        took.append(time.perf_counter() - began)
        assert got == ("<p>" + "some text " * 24 + "</p>") * n
    assert took[1] < 3 * took[0] + 2 and took[1] < 15
