"""Writers: tables, versions, GeoJSON, JSON documents."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# file that names the current version of a table; readers of the folder skip such names
CURRENT = "_CURRENT"


def write_table(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """Overwrite a Parquet table. Never pass a frame that reads ``path``."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_attributes(df: DataFrame, path: str, shapes: Sequence[str] = ("geometry", "geom")) -> None:
    """Attributes only."""
    write_table(df.drop(*shapes), path)


def write_clustered(df: DataFrame, path: str, keys: Sequence[str], files: int | None = None) -> None:
    """Overwrite a Parquet table whose files are ranges of ``keys``, sorted by them, so
    that their statistics let a scan with a filter on the keys skip files and row groups."""
    n = files or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)


def publish(spark: SparkSession, root: str, version: str) -> None:
    """Name the version that readers of ``root`` get from now on. The name is written
    beside the old one and moved over it, so a reader finds one or the other."""
    jvm = spark._jvm
    there = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{CURRENT}")
    new = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{CURRENT}.{uuid.uuid4().hex}")
    files = there.getFileSystem(spark._jsc.hadoopConfiguration())
    out = files.create(new, False)
    out.write(bytearray(version.encode()))
    out.close()
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration())
    context.rename(new, there, over)


def current_version(spark: SparkSession, root: str) -> str | None:
    """Path of the published version, or None."""
    there = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{CURRENT}")
    files = there.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(there):
        return None
    read = files.open(there)
    name = bytes(read.readAllBytes()).decode()
    read.close()
    return f"{root.rstrip('/')}/{name}"


def read_current(spark: SparkSession, root: str) -> DataFrame:
    path = current_version(spark, root)
    if path is None:
        raise FileNotFoundError(f"{root}: no version is published")
    return spark.read.parquet(path)


def enrich_table(df: DataFrame, root: str, derived: Sequence[str], add) -> str:
    """New version of a table with its derived columns recomputed.

    The old version is read, stripped of ``derived`` and passed to ``add``; the
    result goes to a path of its own, so nothing is read and overwritten at once, and
    becomes the current version once it is whole. Returns that path.
    """
    name = f"version={uuid.uuid4().hex}"
    path = f"{root.rstrip('/')}/{name}"
    add(df.drop(*derived)).write.parquet(path)
    publish(df.sparkSession, root, name)
    return path


def feature(properties: Mapping[str, Column], kind: str, coordinates: Column) -> Column:
    """One GeoJSON feature as text."""
    return F.to_json(
        F.struct(
            F.lit("Feature").alias("type"),
            F.struct(*[c.alias(n) for n, c in properties.items()]).alias("properties"),
            F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates")).alias("geometry"),
        )
    )


def line_coordinates(line: Column) -> Column:
    return F.transform(line, lambda part: F.transform(part, lambda p: F.array(p["x"], p["y"])))


def polygon_coordinates(poly: Column) -> Column:
    def ring(r):
        return F.transform(r, lambda p: F.array(p["x"], p["y"]))

    return F.transform(poly, lambda g: F.concat(F.array(ring(g["shell"])), F.transform(g["holes"], ring)))


def write_geojson(df: DataFrame, path: str, properties: Mapping[str, Column], kind: str, coordinates: Column) -> None:
    """GeoJSON, one feature per line, written by all tasks in parallel."""
    df.select(feature(properties, kind, coordinates).alias("value")).write.mode("overwrite").text(path)


def write_document(tables: Mapping[str, DataFrame], root: str) -> None:
    """Serving document: one JSON-lines table per key."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{root.rstrip('/')}/{name}")


def read_document(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.json(f"{root.rstrip('/')}/{name}")
