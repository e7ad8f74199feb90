"""Exact dedup by deterministic block naming.

Each text is cut into blocks of a fixed number of bytes. Equal blocks get one
integer name: the distinct blocks are put in order (by a 64-bit hash, blocks
with the same hash by their bytes) and numbered. Then adjacent names of a
document are paired and the distinct pairs sorted and numbered in the same
way, until each document has one name. Documents of different numbers of
rounds differ in length; of equal ones, two have the same name exactly if
their texts are equal, whatever the hash does: it only says where to look.

Distribution. Distinct blocks are found with map-side combine, so a block
that a third of the documents share crosses the network once a task, and only
here does text move. Sorting happens in many buckets side by side, by a hash
of the block or pair; a name is the rank in its bucket and the bucket's
number. Names come back to the documents by joins on the hash (or pair),
whose hot keys adaptive execution can split.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docweave.llm.common import ascii_lower, partitions, stage
from docweave.llm.keep import row_key

BLOCK = 4096


def _numbered(distinct: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    """``distinct`` with ``name``: a different integer from 1 on for each row,
    in the order of ``keys`` within each of many buckets."""
    bucket = F.pmod(F.xxhash64(keys[0] if len(keys) == 1 else F.struct(*keys)), F.lit(buckets))
    w = Window.partitionBy("bucket").orderBy(*keys)
    return (distinct.withColumn("bucket", bucket)
            .withColumn("name", F.row_number().over(w).cast("long") * F.lit(buckets) + F.col("bucket")).drop("bucket"))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, ident`` (a null id as the largest long), ``row_key`` and the
    normalised ``text``. Rows that agree in ident and row_key are one document."""
    doc_id = F.col(id_col).cast("long")
    return docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit((1 << 63) - 1)).alias("ident"),
                       row_key(F.col(text_col)).alias("row_key"),
                       ascii_lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("text"))


def _blocks(keyed: DataFrame, size: int) -> DataFrame:
    """``ident, row_key, last, i, block``: all blocks 0..last of each text (an
    empty text is one empty block)."""
    def cut(data):
        last = F.greatest(F.lit(0), F.ceil(F.octet_length(data) / size).cast("int") - 1)
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(
            last.alias("last"), i.alias("i"), F.substring(data, i * size + 1, F.lit(size)).alias("block")))
    # a lambda's argument is evaluated once: the text is encoded once, not again for each block, and no block's row carries it
    parts = F.element_at(F.transform(F.array(F.encode("text", "UTF-8")), cut), 1)
    return keyed.select("ident", "row_key", F.inline(parts))


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = BLOCK,
               locate=F.xxhash64) -> DataFrame:
    """``ident, row_key, level, name`` of each distinct (ident, row_key):
    equal ``(level, name)`` exactly where the normalised texts are equal.
    ``locate`` is the hash that tells where to look for an equal block."""
    buckets = 16 * partitions(docs)
    blocks = _blocks(_keyed(docs, id_col, text_col), size).withColumn("place", locate("block"))
    cells = stage(blocks.groupBy("place", "block").agg(F.lit(1).alias("one"))
                  .groupBy("place").agg(F.count("*").alias("n")))
    alone = _numbered(cells.filter("n = 1").select("place"), ["place"], buckets)
    own = ["ident", "row_key", "last", "i"]
    rows = blocks.select(*own, "place").join(alone, "place").select(*own, (F.col("name") * 2).alias("name"))
    shared = cells.filter("n > 1").select("place")
    if not shared.isEmpty():                      # different blocks with one hash: named by their bytes
        twins = blocks.join(shared, "place")
        named = _numbered(twins.select("place", "block").distinct(), ["place", "block"], buckets)
        rows = rows.union(twins.join(named, ["place", "block"]).select(*own, (F.col("name") * 2 + 1).alias("name")))
    rows, level, done = stage(rows), 0, []
    while True:
        done.append(rows.filter("last = 0").groupBy("ident", "row_key").agg(F.max("name").alias("name"))
                    .select("ident", "row_key", F.lit(level).alias("level"), "name"))
        rest = rows.filter("last > 0")
        if rest.isEmpty():
            return reduce(DataFrame.union, done)
        first = F.col("i") % 2 == 0
        pairs = stage(rest.groupBy("ident", "row_key", F.shiftright("last", 1).alias("last"), F.shiftright("i", 1).alias("i"))
                      .agg(F.max(F.when(first, F.col("name"))).alias("a"),
                           F.coalesce(F.max(F.when(~first, F.col("name"))), F.lit(0).cast("long")).alias("b")))
        named = _numbered(pairs.select("a", "b").distinct(), ["a", "b"], buckets)
        rows = stage(pairs.join(named, ["a", "b"]).select(*own, "name"))
        level += 1


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = BLOCK) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept,
    text_sha256``. Texts are equal if identical after lower-casing A-Z only;
    of equal ones the row with the largest id stays.

    Null text counts as empty; a null id is smaller than any other; of rows
    that repeat the largest id one has ``kept``; an empty table gives no rows;
    other columns are not read."""
    rows = (_keyed(docs, id_col, text_col).select("doc_id", "ident", "row_key", F.sha2("text", 256).alias("text_sha256"))
            .groupBy("ident", "row_key", "doc_id", "text_sha256").agg(F.count("*").alias("copies")))
    rows = stage(rows.join(identities(docs, id_col, text_col, size), ["ident", "row_key"]))
    # staged, so that the join below has plain shuffles on both sides, whose hot keys Spark can split
    groups = stage(rows.groupBy("level", "name").agg(
        F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"),
        F.max(F.struct("doc_id", "row_key")).alias("top")))
    copy = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")
    top = F.col("doc_id").eqNullSafe(F.col("top.doc_id")) & (F.col("row_key") == F.col("top.row_key"))
    return (rows.join(groups, ["level", "name"])
            .select("doc_id", "keep_id", "group_size", top.alias("top_row"), "text_sha256", copy)
            .select("doc_id", "keep_id", "group_size", (F.col("top_row") & (F.col("copy") == 1)).alias("kept"), "text_sha256"))
