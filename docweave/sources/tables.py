"""Readers for the parquet tables and the derived inputs the queries use.

Only the needed columns are selected, so the parquet scan reads just
those (see ``ReadSchema`` in the plan)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


SPREAD_BYTES = 256 << 20     # larger inputs have splits enough


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin repartition only when the scan yields fewer partitions
    than the cluster can run at once (e.g. one large row group), and the
    input is at most ``SPREAD_BYTES``: larger texts are never moved for it."""
    try:
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        if size > SPREAD_BYTES:
            return df
        target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
        have = df.rdd.getNumPartitions()
    except Exception:  # no RDD view (e.g. a remote session): leave the scan as it is
        return df
    if have < target:
        # round-robin: rows are sorted before the split, so a retried
        # task rebuilds the same partitions
        return df.repartition(target)
    return df


def pages(spark, sf_dir) -> DataFrame:
    return spread(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def documents(spark, sf_dir) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def doc_corpus_input(spark, sf_dir) -> DataFrame:
    """(doc_id, fname, text): each document as a text file
    ``<source>/<doc_id>.txt``."""
    d = documents(spark, sf_dir)
    return d.select("doc_id",
                    F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"),
                             F.lit(".txt")).alias("fname"),
                    "text")


def doc_files(spark, sf_dir) -> DataFrame:
    """(doc_id, sourcefile, text): each document as a one-page text file."""
    d = documents(spark, sf_dir)
    return d.select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("sourcefile"),
                    "text")


def conversation_pages(spark, sf_dir) -> DataFrame:
    """(sourcefile, page_num, text): a conversation as a paged document,
    one page per turn (``<conv_id>.pdf``)."""
    c = spread(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"))
    return c.select(F.concat(F.col("conv_id").cast("string"), F.lit(".pdf")).alias("sourcefile"),
                    F.col("turn").cast("int").alias("page_num"), "text")


def questions(spark, sf_dir) -> DataFrame:
    """(question_id, question) from the benchmark items."""
    b = table(spark, sf_dir, "benchmark").select("item_id", "text")
    return b.select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))


def vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")


def labels(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
