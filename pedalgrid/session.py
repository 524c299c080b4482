"""Session defaults and lineage control."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
# folders of local sessions that name none, by application
_OWN: dict[str, str] = {}


def local_session(cores: str = "*", partitions: int = 8) -> SparkSession:
    """Session for tests and the local bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("pedalgrid")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """Folder for materialised intermediates, as the cluster names it.

    Only a session within one process may fall back to a temporary folder: on a
    cluster a machine-local path would be lost with its executor.
    """
    named = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(
        CHECKPOINT_KEY, None
    )
    if named:
        return named
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder all executors share")
    # Spark does not let a running session set this key, so it is remembered here
    run = spark.sparkContext.applicationId
    if run not in _OWN:
        _OWN[run] = tempfile.mkdtemp(prefix="pedalgrid-")
    return _OWN[run]


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Over all shuffle partitions, whatever the size in bytes: a few megabytes
    of geometry can stand for minutes of distance tests."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)


def settle(df: DataFrame, wide: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts lineage, survives executor loss, and gives the optimizer real file
    sizes, so later joins broadcast only what was measured to be small.
    ``wide`` spreads the rows first, for tables that heavy work starts from.
    """
    spark = df.sparkSession
    if wide:
        df = spread(df)
    run = spark.sparkContext.applicationId
    path = f"{shared_folder(spark).rstrip('/')}/pedalgrid/{run}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession) -> None:
    """Delete what ``settle`` wrote in this application.

    For after its last result was read or written: frames that read settled tables
    cannot be run again.
    """
    path = f"{shared_folder(spark).rstrip('/')}/pedalgrid/{spark.sparkContext.applicationId}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
