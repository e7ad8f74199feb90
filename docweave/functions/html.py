"""Column -> Column HTML functions (regex based, JVM-side).

Tags are matched with their quoted attribute values, dropped elements with
those of their kind inside them. Renderings that follow all nesting live in
``docweave.operators.html_tree``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _c, clean_text, html_unescape
from .urls import clean_link

WS = r"[ \t\n\r\f]"
FOLD = 128
# Elements dropped when a page is simplified.
RAW_TEXT_TAGS = ["script", "style"]
DROPPED_TAGS = ["script", "style", "link", "meta", "symbol", "svg", "form", "button"]
VOID_TAGS = {"link", "meta"}

COMMENT_RE = r"(?s)<!--.*?-->"
# what may stand in a tag after its name: a quoted value is stepped over whole
# (a quote without a partner is an ordinary character)
IN_TAG = r"""(?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+"""
TAG_RE = r"(?s)</?[a-zA-Z]" + IN_TAG + r">|<![^>]*>"
OPEN_TAG_RE = r"(?s)<[a-zA-Z]" + IN_TAG + r">"
ANCHOR_RE = r"(?is)<a(?:" + WS + IN_TAG + r")?>.*?</a" + WS + r"*>"
ANCHOR_OPEN_RE = r"(?is)<a(?:" + WS + IN_TAG + r")?>"
# the attributes of an anchor before its href, each with its value; the name
# must follow a blank (so "data-href" is not "href")
BEFORE_HREF = (r"(?:" + WS + r"++(?!href" + WS + r"*=)[^ \t\n\r\f=>]*+(?:" + WS + r"*+=" + WS +
               r"""*+(?:"[^"]*+"|'[^']*+'|[^ \t\n\r\f>]*+))?)*+""" + WS + r"++href" + WS + r"*+=" + WS + r"*+")
HREF_PRE_RE = r"(?is)^(<a" + BEFORE_HREF + r")"
HREF_VALUE_RE = r"(?is)^<a" + BEFORE_HREF + r"""("[^"]*"|'[^']*'|[^ \t\n\r\f>]+)"""
HAS_HREF_RE = r"(?is)^<a" + BEFORE_HREF
TITLE_RE = r"(?is)<title[^>]*>(.*?)</title" + WS + r"*>"
BODY_RE = r"(?is)<body(?:" + WS + r"[^>]*)?>(.*?)(?:</body" + WS + r"*>|\z)"
CLASS_ATTR_RE = r"""(?i)""" + WS + r"""+class""" + WS + r"""*=""" + WS + \
    r"""*(?:"[^"]*"|'[^']*'|[^ \t\n\r\f>]+)"""


def _let(value: Column, fn) -> Column:
    """Evaluate ``value`` once and pass it to ``fn``: expressions inside
    higher-order lambdas get no common-subexpression elimination."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def _in_one_pass(tags) -> str:
    """One alternation matching, at each position, a raw-text element
    (script, style), a comment, or a void element, in that priority: a
    single left-to-right pass in document order, so code in a script that
    looks like markup (``"</p>"``, ``"<!--"``) is skipped with the script,
    and markup inside a comment goes with the comment."""
    def opening(tag):
        return r"<" + tag + r"(?:" + WS + IN_TAG + r")?/?"
    parts = []
    for tag in (t for t in tags if t in RAW_TEXT_TAGS):
        parts += [opening(tag) + r"(?<=/)>", opening(tag) + r">.*?</" + tag + WS + r"*>"]
    parts.append(COMMENT_RE[len("(?s)"):])
    parts += [opening(t) + r">" for t in tags if t in VOID_TAGS]
    return "(?is)" + "|".join(parts)


def _drop_nested(html: Column, tags) -> Column:
    """Drop whole elements of ``tags``, however they nest in their own kind:
    the text between their tags goes while the outermost one is open. One
    that is never closed only loses its tag. The fold finds which pieces stay;
    each run of them is joined once."""
    tag_re = r"(?is)</?(?:" + "|".join(tags) + r")(?:" + WS + IN_TAG + r")?/?>"

    def cut(x):
        all_marks = x["marks"]
        none = F.array().cast("array<struct<a:int,b:int>>")
        first = F.struct(F.lit(0).alias("i"), F.lit(0).alias("depth"), F.lit("").alias("name"), F.lit(0).alias("open"),
                         F.lit(0).alias("start"), none.alias("kept"))

        def step(acc, m):
            """Pieces ``start`` up to ``open`` are kept when the element that opened there is closed."""
            i, inside = acc["i"] + 1, acc["depth"] > 0
            own = inside & (m["name"] == acc["name"]) & ~m["alone"]
            opens = ~inside & ~m["ends"] & ~m["alone"]
            depth = acc["depth"] + F.when(opens | (own & ~m["ends"]), 1).when(own, -1).otherwise(0)
            closes = inside & (depth == 0)
            span = F.struct(acc["start"].alias("a"), acc["open"].alias("b"))
            return F.struct(i.alias("i"), depth.alias("depth"), F.when(opens, m["name"]).otherwise(acc["name"]).alias("name"),
                            F.when(opens, i).otherwise(acc["open"]).alias("open"), F.when(closes, i).otherwise(acc["start"]).alias("start"),
                            F.when(closes, F.array_append(acc["kept"], span)).otherwise(acc["kept"]).alias("kept"))
        names = ("i", "depth", "name", "open", "start")

        def block(acc, b):
            """``FOLD`` marks; what they keep is added at once, since each step copies the list that it adds to."""
            begin = F.struct(*[acc[c].alias(c) for c in names], none.alias("kept"))
            return _let(F.aggregate(F.slice(all_marks, b * FOLD + 1, FOLD), begin, step), lambda r: F.struct(
                *[r[c].alias(c) for c in names], F.concat(acc["kept"], r["kept"]).alias("kept")))
        blocks = F.sequence(F.lit(0), F.floor((F.size(all_marks) - 1) / FOLD).cast("int"))
        kept = F.aggregate(blocks, first, block, lambda acc: F.array_append(
            acc["kept"], F.struct(acc["start"].alias("a"), (acc["i"] + 1).alias("b"))))
        return F.array_join(F.transform(kept, lambda k: F.array_join(F.slice(x["pieces"], k["a"] + 1, k["b"] - k["a"]), "")), "")

    marks = F.transform(F.regexp_extract_all(html, F.lit(tag_re), 0), lambda m: F.struct(
        F.lower(F.regexp_extract(m, r"^</?([a-zA-Z]+)", 1)).alias("name"), m.startswith("</").alias("ends"), m.endswith("/>").alias("alone")))
    parts = F.struct(F.split(html, tag_re, -1).alias("pieces"), marks.alias("marks"))
    return F.when(html.rlike(tag_re), _let(parts, cut)).otherwise(html)


def remove_elements(html, tags=DROPPED_TAGS) -> Column:
    """Drop comments and the given elements with their content."""
    plain = F.regexp_replace(_c(html), _in_one_pass(tags), "")
    nested = [t for t in tags if t not in RAW_TEXT_TAGS and t not in VOID_TAGS]
    return _let(plain, lambda h: _drop_nested(h, nested)) if nested else plain


def title(html) -> Column:
    """Text of the first ``<title>`` (references decoded); NULL if none or empty."""
    t = html_unescape(F.regexp_extract(_c(html), TITLE_RE, 1))
    return F.when(t != "", t)


def body(html) -> Column:
    """Inner markup of ``<body>``, up to ``</body>`` or the end of the page."""
    return F.regexp_extract(_c(html), BODY_RE, 1)


def strip_tags(html) -> Column:
    return F.regexp_replace(_c(html), TAG_RE, "")


def tag_text(html) -> Column:
    """All text of a fragment: tags dropped, references decoded."""
    return html_unescape(strip_tags(html))


def href_value(tag) -> Column:
    """The href attribute of an ``<a ...>`` string, quotes removed and
    references decoded; '' when absent."""
    raw = F.regexp_extract(_c(tag), HREF_VALUE_RE, 1)
    unq = F.when(raw.startswith('"') | raw.startswith("'"),
                 raw.substr(F.lit(2), F.length(raw) - 2)).otherwise(raw)
    return html_unescape(unq)


def _interleave(html: Column, pattern: str, fn) -> Column:
    """Rewrite every match of ``pattern`` with ``fn(match) -> Column``,
    keeping the text between matches (split + zip, no Python). Markup, pieces
    and matches are each computed, and stand in the plan, once."""
    def woven(x):
        return F.array_join(F.zip_with(x["pieces"], F.transform(x["matches"], fn), lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), "")

    return _let(html, lambda h: _let(F.struct(F.split(h, pattern, -1).alias("pieces"),
                                              F.regexp_extract_all(h, F.lit(pattern), 0).alias("matches")), woven))


def rewrite_hrefs(html, base_scheme, base_netloc) -> Column:
    """Point every anchor href at its cleaned site-root form (not
    limited to the site); tel:/mailto: and empty hrefs are left alone."""
    bs, bn = _c(base_scheme), _c(base_netloc)

    def fix(tag):
        def with_h(h):          # the decoded href, bound once per anchor
            def with_new(new):
                raw = F.regexp_extract(tag, HREF_VALUE_RE, 1)
                skip = (h == "") | h.startswith("tel:") | h.startswith("mailto:") | (new == h)
                # split the tag around the raw value; the new value is written quoted
                pre = F.regexp_extract(tag, HREF_PRE_RE, 1)
                post = F.substring(tag, F.length(pre) + F.length(raw) + 1, 1 << 30)
                return F.when(skip, tag).otherwise(
                    F.concat(pre, F.lit('"'), F.replace(new, F.lit('"'), F.lit("&quot;")), F.lit('"'), post))
            return _let(clean_link(h, bs, bn, False), with_new)
        return _let(href_value(tag), with_h)

    return _interleave(_c(html), ANCHOR_OPEN_RE, fix)


def drop_class_attrs(html) -> Column:
    """Delete class attributes; prose that looks like one stays."""
    return _let(_c(html), lambda h: _interleave(h, OPEN_TAG_RE, lambda tag: F.regexp_replace(tag, CLASS_ATTR_RE, "")))


def simplify(html, base_scheme, base_netloc) -> Column:
    """Simplified body markup: elements of ``DROPPED_TAGS`` and comments
    removed, class attributes deleted, hrefs cleaned. nav/header/footer
    stay."""
    b = body(remove_elements(html))
    b = drop_class_attrs(b)
    return rewrite_hrefs(b, base_scheme, base_netloc)


def inline_links(html, base_scheme, base_netloc, link_mode: str = "text_href") -> Column:
    """Body markup -> text with anchors rendered inline.

    ``text_href``: ``"<text> <href> "`` per anchor, with the cleaned href;
    anchors whose href is exactly '#' vanish with their text.
    ``text_colon``: ``"<text>: <href> "``.
    ``tag``: the anchor markup itself is kept as text.
    ``plain``: anchors are ordinary text."""
    bs, bn = _c(base_scheme), _c(base_netloc)
    h = _c(html)
    if link_mode == "plain":
        return tag_text(h)

    def render(a):
        if link_mode == "tag":
            return a

        def with_href(href):    # the decoded href, bound once per anchor
            inner = F.regexp_extract(a, r"(?is)^<a" + IN_TAG + r">(.*)</a" + WS + r"*>$", 1)
            text = tag_text(inner)
            shown = F.when(href == "", href).otherwise(clean_link(href, bs, bn, False))
            sep = F.lit(": ") if link_mode == "text_colon" else F.lit(" ")
            return F.when(href == "#", F.lit("")).otherwise(F.concat(text, sep, shown, F.lit(" ")))
        return _let(href_value(a), with_href)

    # every fragment between the anchors and inside them loses its markup in one place
    def split_up(h):
        return F.struct(F.split(h, ANCHOR_RE, -1).alias("pieces"), F.regexp_extract_all(h, F.lit(ANCHOR_RE), 0).alias("anchors"))

    def woven(x):
        between = F.transform(x["pieces"], tag_text)
        return F.array_join(F.zip_with(between, F.transform(x["anchors"], render), lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), "")

    return _let(h, lambda b: _let(split_up(b), woven))


def page_text(html, base_scheme, base_netloc, link_mode: str = "text_href") -> Column:
    """Text file content of a page: ``title + "\\n\\n" + body text`` (no
    title line when the page has none); body text = simplified body with
    links inlined, references decoded, blanks cleaned."""
    b = body(remove_elements(html))
    txt = clean_text(inline_links(b, base_scheme, base_netloc, link_mode))
    t = title(html)
    return F.when(t.isNull(), txt).otherwise(F.concat(t, F.lit("\n\n"), txt))


def hrefs(html) -> Column:
    """ARRAY of href values of the anchors that have one, in document order."""
    tags = F.regexp_extract_all(_c(html), F.lit(ANCHOR_OPEN_RE), 0)
    return F.transform(F.filter(tags, lambda t: t.rlike(HAS_HREF_RE)), href_value)


def tag_names(html) -> Column:
    """Distinct lower-cased tag names, sorted."""
    names = F.regexp_extract_all(_c(html), F.lit(r"<([a-zA-Z][a-zA-Z0-9]*)"), 1)
    return F.array_sort(F.array_distinct(F.transform(names, lambda x: F.lower(x))))
