"""Section index on storage: a parquet table partitioned by
``file_bucket = pmod(xxhash64(sourcefile), buckets)``, so that millions of
source files do not become millions of partition folders, or, with
``buckets=None``, by ``sourcefile`` (a folder each, for small sites). Pass the
same ``buckets`` value for a table on every call.

* ``create``: make the table if absent, with the fixed schema.
* ``upsert_into``: merge by id, rewriting only the touched partitions
  (dynamic partition overwrite). The merged rows are checkpointed to the
  cluster's shared checkpoint folder first, so the table is never
  overwritten while it is being read.
* ``delete_from``: drop the rows of whole source files, or all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..operators import index as IX
from ..session import ensure_checkpoint_dir, stage_table

BUCKET_COL = "file_bucket"
BUCKETS = 256


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def exists(spark: SparkSession, path: str) -> bool:
    fs, p, _ = _fs(spark, path)
    return fs.exists(p)


def _part(buckets):
    return BUCKET_COL if buckets else "sourcefile"


def _schema(buckets):
    if not buckets:
        return schemas.SECTION
    return T.StructType(list(schemas.SECTION.fields) + [T.StructField(BUCKET_COL, T.IntegerType())])


def bucket_of(col, buckets: int):
    return F.pmod(F.xxhash64(col), F.lit(buckets)).cast("int")


def _with_bucket(df: DataFrame, buckets):
    return df.withColumn(BUCKET_COL, bucket_of(F.col("sourcefile"), buckets)) if buckets else df


def create(spark: SparkSession, path: str, buckets: int | None = BUCKETS) -> None:
    if not exists(spark, path):
        (spark.createDataFrame([], _schema(buckets)).write.mode("errorifexists")
              .partitionBy(_part(buckets)).parquet(path))


def _raw(spark, path, buckets):
    return spark.read.schema(_schema(buckets)).parquet(path)


def read(spark: SparkSession, path: str, buckets: int | None = BUCKETS) -> DataFrame:
    return _raw(spark, path, buckets).select(*IX.INDEX_FIELDS)


def _drop_partitions(spark, path, buckets, parts: DataFrame) -> int:
    """Delete the storage files of the given partition values."""
    col = _part(buckets)
    t = _raw(spark, path, buckets).select(col, F.col("_metadata.file_path").alias("fp"))
    t = t.join(parts.select(col).distinct(), col, "left_semi")
    paths = [r["fp"] for r in t.select("fp").distinct().collect()]   # metadata-sized list
    fs, _, jvm = _fs(spark, path)
    return sum(1 for p in paths if fs.delete(jvm.org.apache.hadoop.fs.Path(p), False))


def _rewrite(spark, path, buckets, rows: DataFrame, touched: DataFrame) -> None:
    """Replace the touched partitions by ``rows`` (which hold every row
    those partitions keep). Partitions left empty are deleted."""
    col = _part(buckets)
    staged = _with_bucket(rows, buckets).checkpoint()       # both materialised away from the table
    touched = touched.select(col).distinct().checkpoint()
    (staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
           .partitionBy(col).parquet(path))
    # only after the write: a failure in between leaves rows twice at most, never none
    emptied = touched.join(staged.select(col).distinct(), col, "left_anti")
    _drop_partitions(spark, path, buckets, emptied)


def upsert_into(spark: SparkSession, path: str, incoming: DataFrame, buckets: int | None = BUCKETS) -> DataFrame:
    """Upsert ``incoming`` sections; returns the per-file report
    (sent, succeeded) of this batch."""
    create(spark, path, buckets)
    incoming = stage_table(incoming)              # read several times below: the sections are cut once
    col = _part(buckets)
    raw = _raw(spark, path, buckets)
    inc = IX.dedup_incoming(incoming).select(*IX.INDEX_FIELDS)
    moved = raw.join(inc.select("id"), "id", "left_semi").select("sourcefile")
    touched = _with_bucket(inc.select("sourcefile").union(moved).distinct(), buckets).select(col).distinct()
    existing = raw.join(touched, col, "left_semi").select(*IX.INDEX_FIELDS)
    _rewrite(spark, path, buckets, IX.upsert(existing, inc), touched)
    return IX.upsert_report(incoming, read(spark, path, buckets))


def delete_from(spark: SparkSession, path: str, files: DataFrame | None = None,
                buckets: int | None = BUCKETS) -> int:
    """Delete the rows of the given source files (matched by base name),
    or all rows. Returns the number of storage files removed or rewritten."""
    if not exists(spark, path):
        return 0
    col = _part(buckets)
    raw = _raw(spark, path, buckets)
    if files is None:
        return _drop_partitions(spark, path, buckets, raw.select(col))
    names = files.select(F.regexp_extract("sourcefile", r"([^/]*)$", 1).alias("sourcefile")).distinct()
    if not buckets:
        return _drop_partitions(spark, path, buckets, names)
    ensure_checkpoint_dir(spark)
    touched = _with_bucket(names, buckets).select(col).distinct()
    keep = raw.join(touched, col, "left_semi").join(names, "sourcefile", "left_anti").select(*IX.INDEX_FIELDS)
    n = touched.count()
    _rewrite(spark, path, buckets, keep, touched)
    return n
