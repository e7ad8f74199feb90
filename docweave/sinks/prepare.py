"""Document preparation job with the three run modes: ``add`` (upload
page blobs unless skipped, cut sections, upsert them with an optional
category), ``remove`` (the given files' page blobs and index rows) and
``removeall`` (everything)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import sections as SE
from . import index_store, site_store


def prepare_documents(spark: SparkSession, mode: str, index_path: str, blobs_path: str | None = None,
                      pages: DataFrame | None = None, files: DataFrame | None = None,
                      category: str | None = None, skip_blobs: bool = False,
                      buckets: int | None = index_store.BUCKETS) -> DataFrame | None:
    """``pages``: (sourcefile, page_num, text) of the files to add;
    ``files``: (sourcefile) of the files to remove. Returns the upload
    report for ``add``."""
    if mode == "removeall":
        if blobs_path:
            site_store.remove_blobs(spark, blobs_path, None)
        index_store.delete_from(spark, index_path, None, buckets=buckets)
        return None
    if mode == "remove":
        if blobs_path:
            site_store.remove_blobs(spark, blobs_path, files)
        index_store.delete_from(spark, index_path, files, buckets=buckets)
        return None
    if mode != "add":
        raise ValueError(f"unknown mode {mode!r}")
    index_store.create(spark, index_path, buckets)
    pm = SE.page_map(pages)
    if blobs_path and not skip_blobs:
        site_store.upload_blobs(pm.select("sourcefile", "page_num", "text"), blobs_path)
    secs = SE.sections_of_pages(pages, category)
    return index_store.upsert_into(spark, index_path, secs, buckets=buckets)
