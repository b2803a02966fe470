"""The folder that driver and executors share, and tables that are stored there."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """URI of the folder that driver and executors share: spark.checkpoint.dir of the session.

    Only on a single machine, as in tests, may it be unset; then a folder of this machine is made and set in its place.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = kept.get() if kept.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lexloom-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below shared_root() that nothing else uses; it goes when the driver's Python ends, or by discard()."""
    path = f"{shared_root(spark)}/lexloom-{uuid.uuid4().hex[:16]}-{name}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None:
        return
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the JVM may have gone first
        pass


#: Whether Spark removes a query's shuffle files as soon as the query ends, and not when the driver collects its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str, small: bool = False) -> DataFrame:
    """df as written to, and read again from, the shared folder: it cuts lineage, and survives the loss of any executor.

    `small`: what was shuffled for it goes at once, and the table is compressed more.
    """
    path = fresh_path(df.sparkSession, name)
    if small:
        conf = df.sparkSession.conf
        before = conf.get(_CLEANUP)
        conf.set(_CLEANUP, "true")
        try:
            df.select("*").write.option("compression", "zstd").parquet(path)
        finally:
            conf.set(_CLEANUP, before)
    else:
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._lexloom_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes stored() tables that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_lexloom_path", None):
            _remove(df.sparkSession, path)
