"""Captured-page operators: simplify, text, links, keys, dedup, audit.

All of them are narrow (row-local) column expressions except
``dedup_pages``, which shuffles once on (netloc, page_key) with a partial
aggregate on the map side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import text as TX
from ..functions import urls as U

# Tags whose text becomes one output line each, and tags
# that are only containers (both used by the tag audit and line export).
PRINT_TAGS = ["h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "a", "span",
              "em", "strong", "u", "sub", "small", "address"]
CONTAINER_TAGS = ["main", "label", "div", "header", "section", "noscript", "ul",
                  "iframe", "body", "nav", "input", "article", "br", "img", "hr",
                  "aside", "content", "table", "tr", "th", "time", "sup", "ol",
                  "tbody", "td"]


def with_site(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """Add ``scheme``, ``netloc`` and ``page_key`` of each page URL."""
    u = F.col(url_col)
    return (pages.withColumn("scheme", U.scheme(u))
                 .withColumn("netloc", U.netloc(u))
                 .withColumn("page_key", U.page_key(u)))


def simplify_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, netloc, page_key, title, html): simplified body."""
    p = with_site(pages)
    return p.select("page_id", "url", "netloc", "page_key",
                    H.title("html").alias("title"),
                    H.simplify("html", "scheme", "netloc").alias("html"))


def page_texts(pages: DataFrame, link_mode: str = "text_href", keep: tuple = ()) -> DataFrame:
    """(page_id, url, netloc, page_key, text): the page's text file.
    ``saved`` is false for a page whose key is '' (not written).

    ``link_mode="tree"`` renders anchors on a parsed tree (text nested
    deeper inside an anchor is repeated after it, as a tree walk does);
    the other modes are regex based and JVM-side. ``keep`` columns are
    carried through."""
    p = with_site(pages)
    keep = tuple(keep)
    if link_mode == "tree":
        from .html_tree import anchor_texts
        b = p.select("page_id", "url", "netloc", "page_key", *keep, H.title("html").alias("title"),
                     H.rewrite_hrefs(H.body(H.remove_elements("html")), F.col("scheme"), F.col("netloc"))
                     .alias("body"))
        r = anchor_texts(b, "body", "body_text")
        txt = TX.clean_text("body_text")
        text = F.when(F.col("title").isNull(), txt).otherwise(F.concat("title", F.lit("\n\n"), txt))
        return r.select("page_id", "url", "netloc", "page_key", *keep, text.alias("text"),
                        (F.col("page_key") != "").alias("saved"))
    return p.select("page_id", "url", "netloc", "page_key", *keep,
                    H.page_text("html", "scheme", "netloc", link_mode).alias("text"),
                    (F.col("page_key") != "").alias("saved"))


def page_texts_plain(pages: DataFrame) -> DataFrame:
    """Older text export: body text without any element removal or link
    rendering (comments, script and style text are not text), then
    newline flattening with literal backslash-n replaced too; key is
    the URL without its first 8 characters."""
    b = H.body(H.remove_elements("html", H.RAW_TEXT_TAGS))
    text = TX.flatten_newlines(H.tag_text(b), literal_newlines=True)
    return pages.select("page_id", "url", U.page_key_legacy("url").alias("page_key"),
                        text.alias("text"))


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, url, link): distinct same-site links of each page.

    hrefs are read from the simplified body (so links inside dropped
    elements are not followed), cleaned against the site root as the
    simplifier does, then cleaned again limited to the page's site.
    Empty, '#...', 'mailto:' and 'tel:' hrefs are skipped. Distinct per
    page via ``array_distinct``: no shuffle."""
    p = with_site(pages)
    raw = H.hrefs(H.body(H.remove_elements("html")))
    skip = ("#", "mailto:", "tel:")

    def once(h):
        return F.when(h == "", h).otherwise(U.clean_link(h, F.col("scheme"), F.col("netloc"), False))

    first = F.transform(raw, once)
    kept = F.filter(first, lambda h: (h != "") & ~U.starts_with_any(h, skip))
    limited = F.transform(kept, lambda h: U.clean_link(h, F.col("scheme"), F.col("netloc"), True))
    links = F.array_distinct(F.filter(limited, lambda h: h != ""))
    return (p.select("page_id", "url", F.explode(links).alias("link")))


def page_links_legacy(pages: DataFrame) -> DataFrame:
    """(page_id, url, link) with the older cleaner: https always, tel:
    treated as a path, '' -> site root; hrefs from the whole page."""
    p = pages.withColumn("netloc", U.netloc("url"))
    raw = F.array_distinct(H.hrefs(H.remove_elements("html", H.RAW_TEXT_TAGS)))
    cleaned = F.transform(raw, lambda h: U.clean_link_legacy(h, F.col("netloc")))
    links = F.array_distinct(F.filter(cleaned, lambda h: h.isNotNull()))
    return p.select("page_id", "url", F.explode(links).alias("link"))


def dedup_pages(pages: DataFrame, cols=("page_id", "url", "html")) -> DataFrame:
    """Last writer wins per output file (netloc, page_key): the row with
    the largest page_id survives. Pages whose key is '' are not written.

    groupBy + max_by aggregates partially on the map side, so a host
    holding a large share of all pages does not land whole in one task."""
    p = with_site(pages).filter(F.col("page_key") != "")
    packed = F.struct(*[F.col(c) for c in cols])
    win = (p.groupBy("netloc", "page_key")
            .agg(F.max_by(packed, F.col("page_id")).alias("w"), F.count("*").alias("n_versions")))
    return win.select("netloc", "page_key", "n_versions", *[F.col(f"w.{c}").alias(c) for c in cols])


def page_parts(pages: DataFrame) -> DataFrame:
    """Header / body / footer blocks of each page with their lengths;
    NULL (not an error) when a block is missing."""
    def block(tag):
        return F.regexp_extract("html", r"(?is)(<" + tag + r"(?:" + H.WS + r"[^>]*)?>.*?</" + tag + H.WS + r"*>)", 1)

    def nz(c):
        return F.when(c != "", c)

    header, footer = nz(block("header")), nz(block("footer"))
    bod = nz(F.regexp_extract("html", r"(?is)(<body(?:" + H.WS + r"[^>]*)?>.*?(?:</body" + H.WS + r"*>|\z))", 1))
    return pages.select("page_id", "url",
                        header.alias("header"), bod.alias("body"), footer.alias("footer"),
                        F.length(header).cast("long").alias("header_len"),
                        F.length(bod).cast("long").alias("body_len"),
                        F.length(footer).cast("long").alias("footer_len"))


def tag_audit(pages: DataFrame) -> DataFrame:
    """Distinct tag names of each simplified page and the ones neither
    printed nor known containers; ``convertible`` when none is left."""
    # tag names of the simplified page: href rewriting never changes them
    known = F.array(*[F.lit(t) for t in PRINT_TAGS + CONTAINER_TAGS])
    names = H.tag_names(H.drop_class_attrs(H.body(H.remove_elements("html"))))
    unhandled = F.array_sort(F.array_except(names, known))
    return pages.select("page_id", "url",
                       F.array_join(names, ",").alias("tags"),
                       F.array_join(unhandled, ",").alias("unhandled"),
                       (F.size(unhandled) == 0).alias("convertible"))


def route_pages(captured: DataFrame, type_col: str = "content_type") -> DataFrame:
    """Route captured responses by content type: containing 'pdf' ->
    'pdf' (paged document), else containing 'html' -> 'html'; anything
    else is dropped (case-sensitive, as received)."""
    t = F.col(type_col)
    route = F.when(t.contains("pdf"), F.lit("pdf")).when(t.contains("html"), F.lit("html"))
    return captured.withColumn("route", route).filter(F.col("route").isNotNull())
