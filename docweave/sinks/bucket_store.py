"""A keyed table on storage, in buckets, changed by copy-on-write.

Rows lie in ``store_bucket = pmod(xxhash64(key), buckets)``, a folder each, so
millions of keys are no millions of folders. A change reads the buckets that
it touches, stages their new rows in the shared checkpoint folder, and
overwrites those buckets in one commit (dynamic partition overwrite): until
the commit the old files stay, so a failed change leaves the table as it was,
and can be run again. Every touched bucket also gets a row without a key, so
that a bucket that lost all its rows is overwritten too; no file is listed or
deleted by the driver. Reads leave these rows out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import drop_staged, stage_table

BUCKET = "store_bucket"
BUCKETS = 256


class BucketStore:
    """``schema`` without the bucket; ``key`` columns are never all null in a
    row. The number of buckets is kept with the table: that of its first
    change holds."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: list[str], buckets: int = BUCKETS):
        self.spark, self.path, self.schema, self.key = spark, path.rstrip("/"), schema, list(key)
        jpath = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_about")
        self.made = jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)
        self.buckets = spark.read.parquet(f"{self.path}/_about").first()["buckets"] if self.made else buckets

    def _raw(self) -> DataFrame:
        schema = T.StructType([*self.schema.fields, T.StructField(BUCKET, T.IntegerType())])
        if not self.made:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/rows")

    def _with_bucket(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(BUCKET, F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int"))

    def _keyed(self):
        out = F.lit(False)
        for c in self.key:
            out = out | F.col(c).isNotNull()
        return out

    def read(self) -> DataFrame:
        return self._raw().filter(self._keyed()).drop(BUCKET)

    def change(self, rows: DataFrame | None = None, keys: DataFrame | None = None, only=None, everything: bool = False) -> None:
        """Remove the rows of ``keys`` (those of ``rows``, where None) for
        which ``only`` (a column; None: all) holds, and add ``rows``.
        ``everything``: remove all rows."""
        if rows is not None:
            rows = stage_table(self._with_bucket(rows.select(*self.schema.names)))
        if everything:
            touched = self._raw().select(BUCKET)
        else:
            keys = (rows if keys is None else keys).select(*self.key).distinct()
            touched = self._with_bucket(keys).select(BUCKET)
            if rows is not None:
                touched = touched.union(rows.select(BUCKET))
        numbers = sorted(r[0] for r in touched.distinct().collect())           # at most the number of buckets
        if not numbers:
            return
        new = self.spark.createDataFrame([(b,) for b in numbers], f"{BUCKET} int").select(
            *[F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields], BUCKET)
        if not everything:
            lying = self._raw().filter(F.col(BUCKET).isin(numbers) & self._keyed())     # other folders are not read
            gone = lying if only is None else lying.filter(only)
            kept = gone.join(keys, self.key, "left_anti")
            new = new.unionByName(kept if only is None else kept.unionByName(lying.filter(~F.coalesce(only, F.lit(False)))))
        if rows is not None:
            new = new.unionByName(rows)
        staged = stage_table(new)
        if not self.made:
            self.spark.range(1).select(F.lit(self.buckets).alias("buckets")).write.mode("overwrite").parquet(f"{self.path}/_about")
            self.made = True
        (staged.hint("rebalance", BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(BUCKET).parquet(f"{self.path}/rows"))
        drop_staged(staged, *([rows] if rows is not None else []))
