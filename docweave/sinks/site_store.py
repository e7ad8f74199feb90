"""Sinks for captured sites and page blobs.

* ``write_site_files``: per site (``netloc`` partition) one row per output
  file name (``page_key``) with the simplified markup and the text file
  content; the last page written to a name wins, pages whose name is ''
  are not written.
* page-blob store: ``(blob_name, sourcefile, page_num, text)`` in buckets by
  ``sourcefile`` (``bucket_store``); uploads replace only the files they
  bring, removal takes the page blobs of PDF files (``<stem>-<n>.pdf``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import html as H
from ..functions import urls as U
from ..operators import index as IX
from ..operators import web as W
from .bucket_store import BUCKETS, BucketStore


def site_files(pages: DataFrame, link_mode: str = "text_href") -> DataFrame:
    """(netloc, page_key, page_id, url, title, html, text) of the winning
    page of every output file."""
    win = W.dedup_pages(pages, cols=("page_id", "url", "html"))
    base = win.withColumn("scheme", U.scheme("url"))
    return base.select("netloc", "page_key", "page_id", "url",
                       H.title("html").alias("title"),
                       H.simplify("html", "scheme", "netloc").alias("simplified"),
                       H.page_text("html", "scheme", "netloc", link_mode).alias("text"))


def write_site_files(pages: DataFrame, path: str, mode: str = "overwrite") -> None:
    (site_files(pages).write.mode(mode).option("partitionOverwriteMode", "dynamic")
        .partitionBy("netloc").parquet(path))


def blob_store(spark: SparkSession, path: str, buckets: int = BUCKETS) -> BucketStore:
    return BucketStore(spark, path, schemas.PAGE_BLOB, ["sourcefile"], buckets)


def upload_blobs(page_map: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Write the page blobs of the given files, replacing earlier uploads
    of the same files only."""
    blob_store(page_map.sparkSession, path, buckets).change(IX.page_blobs(page_map).withColumn("page_num", F.col("page_num").cast("int")))


def read_blobs(spark: SparkSession, path: str) -> DataFrame:
    return blob_store(spark, path).read()


def remove_blobs(spark: SparkSession, path: str, files: DataFrame | None = None) -> None:
    """Remove the page blobs ``<stem>-<n>.pdf`` of the given files (all blobs
    when ``files`` is None). Text files keep their blob, as the name
    pattern never matches them."""
    store = blob_store(spark, path)
    if files is None:
        store.change(everything=True)
        return
    pdf = files.select("sourcefile").filter(U.blob_name(F.col("sourcefile"), F.lit(0)) != U.basename(F.col("sourcefile")))
    store.change(keys=pdf, only=F.col("blob_name").rlike(r"-[0-9]+\.pdf$"))


def write_answers(answers: DataFrame, path: str, mode: str = "append") -> None:
    """Answer sink: (question_id, question, prompt, answer) rows."""
    cols = [c for c in ("question_id", "question", "context", "prompt", "answer", "answer_error") if c in answers.columns]
    answers.select(*cols).write.mode(mode).parquet(path)
