"""Session helpers: a local session for tests/bench, and cluster-safe settings.

Library code never creates a session; it takes the caller's.  ``local_session``
is for tests and ``bench.py`` only.  ``checkpoint_dir`` reads the cluster's
``spark.checkpoint.dir`` and only falls back to a scratch folder when the
setting is absent (tests).
"""
from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings the library relies on.  AQE re-plans joins and coalesces shuffle
# partitions at runtime; UTC keeps timestamp arithmetic identical to the oracle.
LIBRARY_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Big documents: keep Arrow batches small so one batch never holds
    # thousands of multi-megabyte texts.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "quire") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "8g")
        .config(
            "spark.sql.streaming.stateStore.providerClass",
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        )
    )
    for k, v in LIBRARY_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    ship_package(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster; a scratch one only if unset."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="quire-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint dir (never machine-local on a cluster)."""
    import uuid

    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def spread(df, min_partitions: int | None = None):
    """Round-robin repartition when a scan yields fewer partitions than the
    cluster has cores (e.g. one big file with a single row group), so per-row
    work such as regex and parsing runs on every core.  Large inputs made of
    many files already have enough partitions and are left alone."""
    try:
        target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
        parts = df._jdf.rdd().getNumPartitions()  # plans the scan's file splits; runs no job
    except Exception:  # noqa: BLE001 - no JVM handle (e.g. a remote session): leave as is
        return df
    return df.repartition(target) if parts < target else df


def read_table(spark: SparkSession, sf_dir: str, name: str, balance: bool = True):
    df = spark.read.parquet(table_path(sf_dir, name))
    return spread(df) if balance else df


def materialize(df, name: str = "stage"):
    """Cut lineage by writing a Parquet table in the cluster's checkpoint folder
    and reading it back.

    Used where a multi-pass operator reads the same intermediate several times:
    the passes read the written data instead of recomputing the upstream, and a
    lost executor cannot force a recomputation of the whole lineage.  One job
    writes it (an eager RDD checkpoint would compute the plan twice: once for
    its count and again to write the files)."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Make ``quire`` importable on the executors' Python workers.

    Python functions of this library (HTML parser, throttle chains, naming,
    stream state functions) are pickled by reference, so workers import the
    package.  It is zipped in memory once per SparkContext, written through
    the Hadoop file system into the checkpoint folder (shared storage, never a
    machine-local temp folder) and added with ``addPyFile`` - the programmatic
    form of ``--py-files``."""
    import io
    import zipfile

    import quire

    sc = spark.sparkContext
    if getattr(sc, "_quire_shipped", False):
        return
    pkg = os.path.dirname(os.path.abspath(quire.__file__))
    parent = os.path.dirname(pkg)
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(pkg):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, parent))
    target = scratch_path(spark, "pkg") + "/quire.zip"
    jvm = sc._jvm
    path = jvm.org.apache.hadoop.fs.Path(target)
    out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path, True)
    try:
        out.write(bytearray(buf.getvalue()))
    finally:
        out.close()
    sc.addPyFile(target)
    sc._quire_shipped = True
