"""Crawl frontier expansion over captured pages (breadth first).

Round d joins the pages first reached at depth d with their links and
keeps the URLs not yet visited (left anti join) at depth d + 1. Pages at
``max_depth`` are not expanded, and a URL gets its shortest depth.

The visited set is a table with a partition for each depth, bucketed by URL,
and the links are bucketed by source URL in as many buckets. So a round reads
the newest depth and joins it with the links where both lie, and only its new
candidates move, to be joined with the visited set in place. Each round is
written before the next begins. A stored visited set can be opened again in
another application and expanded further (``expand(..., state=path)``): the
depths that it has are not computed again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import strip_one_trailing_slash
from ..session import bucketed_table, ensure_checkpoint_dir


def fetch_key(url_col) -> F.Column:
    """A captured page answers the link equal to its URL with one trailing
    '/' removed (links are stored that way)."""
    c = F.col(url_col) if isinstance(url_col, str) else url_col
    return strip_one_trailing_slash(c)


class Visited:
    """The visited set at ``root``: ``(url, depth)``, bucketed by URL."""

    def __init__(self, spark: SparkSession, root: str, buckets: int):
        self.spark, self.root = spark, root.rstrip("/")
        self.name = f"docweave_visited_{uuid.uuid4().hex}"
        about = f"{self.root}/_about"                          # not listed as data
        path = spark._jvm.org.apache.hadoop.fs.Path(about)
        self.stored = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
        if self.stored:
            buckets = spark.read.parquet(about).first()["buckets"]
        self.buckets = buckets
        spark.sql(f"CREATE TABLE {self.name} (url STRING, depth INT) USING parquet PARTITIONED BY (depth) "
                  f"CLUSTERED BY (url) SORTED BY (url) INTO {buckets} BUCKETS LOCATION '{self.root}/urls'")
        if self.stored:
            spark.sql(f"ALTER TABLE {self.name} RECOVER PARTITIONS")
        else:
            spark.range(1).select(F.lit(buckets).alias("buckets")).write.parquet(about)

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def at(self, depth: int) -> DataFrame:
        return self.table().filter(F.col("depth") == depth).select("url")

    def add(self, urls: DataFrame, depth: int) -> None:
        """A round's URLs, written whole or not at all: a round that failed half-way is written anew."""
        (urls.select("url", F.lit(depth).alias("depth")).repartition(self.buckets, "url").write.format("parquet").mode("append")
         .partitionBy("depth").bucketBy(self.buckets, "url").sortBy("url").saveAsTable(self.name))

    def beyond(self, depth: int, links: DataFrame) -> DataFrame:
        """URLs that ``links`` (bucketed by ``src``) reach from ``depth`` and that
        are not visited. Duplicates go in the partial aggregate, before the
        candidates are dealt into the visited set's buckets."""
        found = self.at(depth).withColumnRenamed("url", "src").join(links, "src").select(F.col("dst").alias("url"))
        if int(self.spark.conf.get("spark.sql.shuffle.partitions")) != self.buckets:
            found = found.repartition(self.buckets, "url")      # a stored set with another number of buckets: still only the candidates move
        return found.distinct().join(self.table().select("url"), "url", "left_anti")

    def last_depth(self) -> int:
        return self.table().agg(F.max("depth").alias("d")).first()["d"] or 0


def expand(seeds: DataFrame, edges: DataFrame, max_depth: int = 2,
           partitions: int | None = None, state: str | None = None) -> DataFrame:
    """seeds(url) at depth 1, edges(src, dst) -> (url, depth), depth <= max_depth.

    ``state``: a folder that keeps the visited set. If an earlier call filled
    it, the crawl goes on from there: the result is that of one crawl to
    ``max_depth``, given the same links, and ``seeds`` that the set lacks are
    not added."""
    spark = seeds.sparkSession
    scratch = f"{ensure_checkpoint_dir(spark).rstrip('/')}/visited-{uuid.uuid4().hex}"
    visited = Visited(spark, state or scratch, partitions or int(spark.conf.get("spark.sql.shuffle.partitions")))
    depth = visited.last_depth() if visited.stored else 0
    if not depth:
        visited.add(seeds.select("url").distinct(), 1)
        depth = 1
    if depth < max_depth:
        links = bucketed_table(edges.select("src", "dst"), "src", visited.buckets)
        while depth < max_depth:
            visited.add(visited.beyond(depth, links), depth + 1)
            depth += 1
            if visited.at(depth).isEmpty():
                break
    return visited.table().filter(F.col("depth") <= max_depth)


def crawl_frontier(pages: DataFrame, links: DataFrame, max_depth: int = 2,
                   seeds: DataFrame | None = None, state: str | None = None) -> DataFrame:
    """Frontier from captured pages: ``links(url, link)`` as produced by
    ``page_links``; seeds default to every captured page."""
    edges = links.select(fetch_key("url").alias("src"), F.col("link").alias("dst"))
    if seeds is None:
        seeds = pages.select(fetch_key("url").alias("url"))
    return expand(seeds, edges, max_depth, state=state)
