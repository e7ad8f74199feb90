"""Keyed section index and page-blob table: upsert, delete, lookup,
facets, postings. Pure DataFrame functions plus storage helpers in
``docweave.sinks.index_store``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U
from ..session import stage_table

INDEX_FIELDS = ["id", "content", "category", "sourcepage", "sourcefile"]
FACET_FIELDS = ["category", "sourcepage", "sourcefile"]
FEW_IDS = 100_000         # repeated ids that go to every task, so that no other row moves for them
LOOKUP_TOP = 1000         # page size of clients that page
TERM_PATTERN = r"\p{L}+|\p{N}+"


def dedup_incoming(incoming: DataFrame, order_cols=("sourcefile", "section_no")) -> DataFrame:
    """One row per id inside a batch: the one uploaded last wins
    (largest ``order_cols``)."""
    cols = [c for c in order_cols if c in incoming.columns]
    if not cols:
        return incoming.dropDuplicates(["id"])
    # only the contents of repeated ids go through the aggregate, and none moves when no id repeats
    again = incoming.groupBy("id").agg(F.count("*").alias("_n")).filter("_n > 1").select("id")
    many = again.limit(FEW_IDS + 1).count()
    if not many:
        return incoming
    if many <= FEW_IDS:
        again = F.broadcast(again)
    packed = F.struct(*[F.col(c) for c in incoming.columns])
    win = incoming.join(again, "id", "left_semi").groupBy("id").agg(F.max_by(packed, F.struct(*cols)).alias("w"))
    return (incoming.join(again, "id", "left_anti")
            .unionByName(win.select(*[F.col(f"w.{c}").alias(c) for c in incoming.columns])))


def upsert(index: DataFrame, incoming: DataFrame) -> DataFrame:
    """Merge by key ``id``: incoming rows replace existing rows with the
    same id, other existing rows stay."""
    inc = dedup_incoming(incoming).select(*INDEX_FIELDS)
    kept = index.select(*INDEX_FIELDS).join(inc.select("id"), "id", "left_anti")
    return inc.unionByName(kept)


def upsert_report(incoming: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Per source file: sections sent, and of them those that are in the
    index (``stored``) after the write, with the same content; without it,
    those with a non-empty id."""
    sent = incoming.select("sourcefile", "id", "content")
    if stored is None:
        ok = F.col("id").isNotNull() & (F.col("id") != "")
    else:
        there = stored.select("id", F.xxhash64("content").alias("_is"), F.lit(True).alias("_in"))
        sent = sent.join(there, "id", "left")
        ok = F.coalesce(F.col("_in") & (F.col("_is") == F.xxhash64("content")), F.lit(False))
    return sent.groupBy("sourcefile").agg(F.count("*").alias("sent"), F.count_if(ok).alias("succeeded"))


def delete(index: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Drop the rows of the given source files (by base name), or all."""
    if files is None:
        return index.limit(0)
    f = files.select(U.basename(F.col("sourcefile")).alias("sourcefile")).distinct()
    return index.join(f, "sourcefile", "left_anti")


def lookup(index: DataFrame, sourcefile: str | None = None, top: int | None = None, after: str | None = None) -> DataFrame:
    """Rows (optionally of one source file), each carrying the total count of
    matching rows. With ``top``, one page: the first ``top`` rows by id after
    the id ``after`` (pass the last id of a page to get the next)."""
    m = index if sourcefile is None else index.filter(F.col("sourcefile") == sourcefile)
    total = m.agg(F.count("*").alias("total_count"))       # one row by construction
    page = m if after is None else m.filter(F.col("id") > after)
    if top is not None:
        page = page.orderBy("id").limit(top)
    return page.crossJoin(F.broadcast(total))


def facets(index: DataFrame, fields=FACET_FIELDS) -> DataFrame:
    """(facet, value, count) for every facetable field, one scan and one
    partially aggregated shuffle. A missing value is in no bucket."""
    pairs = F.array(*[F.struct(F.lit(f).alias("facet"), F.col(f).cast("string").alias("value"))
                      for f in fields])
    return (index.select(F.explode(pairs).alias("p")).filter(F.col("p.value").isNotNull())
                 .groupBy(F.col("p.facet").alias("facet"), F.col("p.value").alias("value"))
                 .agg(F.count("*").alias("count")))


def terms_of(text) -> F.Column:
    """Lower-cased letter and digit runs of a text, repeats included."""
    return F.regexp_extract_all(F.lower(F.col(text)), F.lit(TERM_PATTERN), 0)


def term_runs(terms) -> F.Column:
    """``(term, tf)`` of each distinct term of an array, from its sorted terms
    (bound once, as the element of an array of one)."""
    def count(s):
        begin = F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == 1) | (F.get(s, i - 1) != F.get(s, i - 2)))
        return F.transform(F.array(begin), lambda b: F.zip_with(b, F.slice(F.concat(b, F.array(F.size(s) + 1)), F.lit(2), F.size(b)),
                           lambda i, j: F.struct(F.get(s, i - 1).alias("term"), (j - i).cast("long").alias("tf"))))[0]
    return F.transform(F.array(F.sort_array(terms)), count)[0]


def term_counts(rows: DataFrame, keys: list[str], terms: str = "t") -> DataFrame:
    """``term``, the keys and ``tf``: how often each term is in the arrays
    ``terms`` of each key. A row is counted where it is; only rows whose keys
    occur again are dealt out, to be added up."""
    def counted(r):
        r = r.filter(F.size(terms) > 0).select(*keys, F.explode(term_runs(F.col(terms))).alias("_c"))
        return r.select("_c.term", *keys, "_c.tf")

    rows = rows.select(*keys, terms)
    again = stage_table(rows.groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n > 1").select(*[F.col(k).alias(f"_{k}") for k in keys]))
    if again.isEmpty():
        return counted(rows)
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    more = counted(rows.join(again, same, "left_semi")).groupBy("term", *keys).agg(F.sum("tf").alias("tf"))
    return counted(rows.join(again, same, "left_anti")).unionByName(more)


def postings(index: DataFrame) -> DataFrame:
    """Inverted index of ``content``: (term, id, tf) over lower-cased
    letter and digit runs."""
    return term_counts(index.select("id", terms_of("content").alias("t")), ["id"]).select("term", "id", "tf")


def page_blobs(pmap: DataFrame) -> DataFrame:
    """(blob_name, sourcefile, page_num, text): one blob per page of a PDF
    (``name-<page>.pdf``), one per file otherwise (its base name). Only the
    texts of files with several pages move."""
    is_pdf = U.blob_name(F.col("sourcefile"), F.lit(0)) != U.basename(F.col("sourcefile"))
    pdf_pages = pmap.filter(is_pdf).select(
        U.blob_name("sourcefile", "page_num").alias("blob_name"), "sourcefile", "page_num", "text")
    other = pmap.filter(~is_pdf).select("sourcefile", "page_num", "text")
    many = other.groupBy("sourcefile").agg(F.count("*").alias("_n")).filter("_n > 1").select("sourcefile")
    single = other.join(many, "sourcefile", "left_anti")
    joined = (other.join(many, "sourcefile", "left_semi").groupBy("sourcefile")
              .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_num", "text"))),
                                            lambda x: x["text"]), "").alias("text")))
    whole = single.select("sourcefile", "text").unionByName(joined.select("sourcefile", "text"))
    return pdf_pages.unionByName(whole.select(U.basename("sourcefile").alias("blob_name"), "sourcefile",
                                              F.lit(0).alias("page_num"), "text"))


def remove_blobs(blobs: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Drop the page blobs ``<stem>-<digits>.pdf`` of the given files, or
    all blobs. The stem must match exactly (an equi-join on the parsed
    stem, not a prefix pattern)."""
    if files is None:
        return blobs.limit(0)
    stems = files.select(F.regexp_replace(U.basename(F.col("sourcefile")), U.EXT_RE, "$1")
                         .alias("_stem")).distinct()
    b = blobs.withColumn("_stem", F.regexp_extract("blob_name", r"^(.*)-[0-9]+\.pdf$", 1))
    return b.join(stems, "_stem", "left_anti").drop("_stem")
