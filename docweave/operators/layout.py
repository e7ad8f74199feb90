"""Layout-analysis results: table cells to HTML, and page text with
each table's characters replaced by its HTML. All row-local: a document's
layout result is one row."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import html_escape

HEADER_KINDS = ("columnHeader", "rowHeader")


def _cell_html(c) -> Column:
    tag = F.when(c["kind"].isin(*HEADER_KINDS), F.lit("th")).otherwise(F.lit("td"))
    spans = F.concat(
        F.when(c["column_span"] > 1, F.concat(F.lit(" colSpan="), c["column_span"].cast("string"))).otherwise(F.lit("")),
        F.when(c["row_span"] > 1, F.concat(F.lit(" rowSpan="), c["row_span"].cast("string"))).otherwise(F.lit("")))
    return F.concat(F.lit("<"), tag, spans, F.lit(">"), html_escape(F.coalesce(c["content"], F.lit(""))),
                    F.lit("</"), tag, F.lit(">"))


def table_html(row_count, cells) -> Column:
    """``<table>`` of rows 0..row_count-1 (empty rows kept), cells of a
    row ordered by column (stable), ``th`` for header kinds, colSpan /
    rowSpan written when > 1, content HTML-escaped.

    The cells are sorted once; each one writes the row ends between it and
    the cell before it."""
    rc = F.col(row_count) if isinstance(row_count, str) else row_count
    cl = F.col(cells) if isinstance(cells, str) else cells
    placed = F.transform(cl, lambda c, i: F.struct(c["row_index"].alias("r"), c["column_index"].alias("c"), i.alias("i"),
                                                   _cell_html(c).alias("html")))
    placed = F.sort_array(F.filter(placed, lambda x: (x["r"] >= 0) & (x["r"] < rc)))
    turn = "</tr><tr>"

    def write(sorted_cells):
        def one(x, k):
            before = F.coalesce(F.get(sorted_cells, k - 1)["r"], F.lit(0))
            return F.concat(F.repeat(F.lit(turn), (x["r"] - before).cast("int")), x["html"])
        last = F.coalesce(F.get(sorted_cells, F.size(sorted_cells) - 1)["r"], F.lit(0))
        return F.concat(F.lit("<tr>"), F.array_join(F.transform(sorted_cells, one), ""),
                        F.repeat(F.lit(turn), (rc - 1 - last).cast("int")), F.lit("</tr>"))
    body = F.element_at(F.transform(F.array(placed), write), 1)
    return F.concat(F.lit("<table>"), F.when(rc > 0, body).otherwise(F.lit("")), F.lit("</table>"))


def layout_cells(layout: DataFrame) -> DataFrame:
    """(sourcefile, table_id, page_number, row_count, cell...) one row per cell."""
    t = layout.select("sourcefile", F.posexplode("tables").alias("table_id", "t"))
    c = t.select("sourcefile", "table_id", F.col("t.page_number").alias("page_number"),
                 F.col("t.row_count").alias("row_count"), F.explode("t.cells").alias("c"))
    return c.select("sourcefile", "table_id", "page_number", "row_count", "c.*")


def paint(text: str, spans: list[tuple[int, int, int]], html: list[str]) -> str:
    """``text`` without the characters inside ``spans`` (from, to, table),
    and each table's ``html`` where it first owns one: a sweep over the sorted
    borders, with the spans that are open in a heap by table, the latest on
    top. Borders of a span may lie outside the text."""
    spans = sorted((max(a, 0), min(b, len(text)), i) for a, b, i in spans if max(a, 0) < min(b, len(text)))
    if not spans:
        return text
    borders = sorted({0, len(text)}.union(*((a, b) for a, b, _ in spans)))
    out, open_, written, k = [], [], set(), 0
    for a, b in zip(borders, borders[1:]):
        while k < len(spans) and spans[k][0] <= a:
            heapq.heappush(open_, (-spans[k][2], spans[k][1]))
            k += 1
        while open_ and open_[0][1] <= a:
            heapq.heappop(open_)
        if not open_:
            out.append(text[a:b])
        elif (i := -open_[0][0]) not in written:
            written.add(i)
            out.append(html[i])
    return "".join(out)


def _painted(batches):
    for pdf in batches:
        # ``at``: from, to and table of every span, one after the other
        texts = [None if t is None else paint(t, [tuple(x) for x in np.reshape(a, (-1, 3)).tolist()], h) + " "
                 for t, a, h in zip(pdf["own"], pdf["at"], pdf["html"])]
        yield pd.DataFrame({"sourcefile": pdf["sourcefile"], "page_num": pdf["page_num"], "text": pd.Series(texts, dtype="object")})


def overlay_pages(layout: DataFrame) -> DataFrame:
    """(sourcefile, page_num, text): page text where every character
    inside a span of a table on that page is dropped and the table's
    HTML is written once, at its first covered character; a later table
    wins where spans overlap; one blank ends each page. A table belongs
    to the page of its first bounding region.

    Tables are written and pages cut JVM-side; a page's spans are swept once
    (``paint``), so a page costs its spans' sorting and its text."""
    p = layout.select("sourcefile", "content", "tables", F.explode("pages").alias("pg"))
    p = p.select("sourcefile", F.col("pg.page_num").cast("int").alias("page_num"), F.col("pg.offset").alias("off"),
                 F.substring("content", F.col("pg.offset") + 1, F.col("pg.length")).alias("own"),
                 F.filter("tables", lambda t: t["page_number"] == F.col("pg.page_num") + 1).alias("tp"))
    at = F.flatten(F.flatten(F.transform("tp", lambda t, i: F.transform(t["spans"], lambda s: F.array(
        (s["offset"] - F.col("off")).cast("long"), (s["offset"] + s["length"] - F.col("off")).cast("long"), i.cast("long"))))))
    html = F.transform("tp", lambda t: table_html(t["row_count"], t["cells"]))
    p = p.select("sourcefile", "page_num", "own", at.alias("at"), html.alias("html"))
    return p.mapInPandas(_painted, "sourcefile string, page_num int, text string")
