"""Session helpers: a local session for tests / bench, and the shared
checkpoint folder used to cut lineage in iterative jobs."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``docweave`` importable in the Python workers: zip the package
    once per SparkContext and add it with ``addPyFile`` (the zip goes to
    every executor with the tasks). On a cluster ``--py-files`` does the
    same at submit time."""
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    import zipfile
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    out_dir = tempfile.mkdtemp(prefix="docweave-pkg-")
    zpath = os.path.join(out_dir, "docweave.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(pkg_dir):
            if "__pycache__" in dirpath:
                continue
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(zpath)
    _SHIPPED.add(key)


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "docweave") -> SparkSession:
    """A local session configured the way tests and ``bench.py`` run."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder.

    The folder named by ``spark.checkpoint.dir`` is used as is. Only a local
    session without one (tests) gets a fresh scratch folder; on a cluster
    the setting is required.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get(CHECKPOINT_CONF, None) or sc.getConf().get(CHECKPOINT_CONF, None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="docweave-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


#: With it, shuffle files of a query go when it ends, not when the driver happens to collect garbage.
SHUFFLE_CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage_table(df, small: bool = False):
    """Write ``df`` as a Parquet table in the shared checkpoint folder and
    return a read of it: lineage is cut, columns are pruned, and a lost
    executor costs nothing that was written. The table goes with
    ``drop_staged`` or when the application ends. ``small``: for tables that
    are as large as the input, packed more tightly (zstd), and the shuffle
    files of the write are deleted with its end."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stage-{uuid.uuid4().hex}"
    if small:
        before = spark.conf.get(SHUFFLE_CLEANUP_CONF, None)
        spark.conf.set(SHUFFLE_CLEANUP_CONF, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            spark.conf.unset(SHUFFLE_CLEANUP_CONF) if before is None else spark.conf.set(SHUFFLE_CLEANUP_CONF, before)
    else:
        df.write.parquet(path)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def drop_staged(*tables) -> None:
    """Delete tables of ``stage_table`` that nothing reads any more."""
    for df in tables:
        jpath = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._staged_at)
        jpath.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(jpath, True)


def bucketed_table(df, key: str, buckets: int):
    """``df`` written to the shared checkpoint folder in ``buckets`` buckets by
    a hash of ``key``, and read back: joins and aggregates on ``key`` use the
    rows where they lie."""
    spark = df.sparkSession
    name = f"docweave_{uuid.uuid4().hex}"
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}"
    (df.repartition(buckets, key).write.format("parquet").option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(name))
    return spark.table(name)
