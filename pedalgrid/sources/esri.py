"""Landed feature pages: attributes, rings and dates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.geo import point, point_in_pieces, ring_pieces, signed_area
from ..functions.time import from_epoch_ms

# Fixed value: ids asked for in one request.
ID_BLOCK = 400

GEOMETRY = (
    "struct<x:double,y:double,paths:array<array<array<double>>>,rings:array<array<array<double>>>>"
)


def pages(spark: SparkSession, path: str, attributes: str, geometry: str = "geometry") -> DataFrame:
    """Feature pages as a table: the declared attributes plus raw geometry."""
    schema = f"features array<struct<attributes:struct<{attributes}>,geometry:{GEOMETRY}>>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    return raw.select(F.explode("features").alias("_f")).select(
        "_f.attributes.*", F.col("_f.geometry").alias(geometry)
    )


def id_blocks(ids: DataFrame, oid: str, size: int = ID_BLOCK, span: int | None = None) -> DataFrame:
    """``(block, ids)``: distinct ids in ascending order, ``size`` per block.

    Ids are numbered by range slice: counts per slice give each slice's first
    number, and only one slice is sorted at a time.
    """
    from .numbering import numbered

    rows = numbered(ids.select(oid).where(F.col(oid).isNotNull()).distinct(), oid, span)
    return (
        rows.groupBy(F.floor((F.col("_n") - 1) / size).cast("bigint").alias("block"))
        .agg(F.array_sort(F.collect_list(oid)).alias("ids"))
    )


def esri_point(g: Column) -> Column:
    return F.when(g["x"].isNotNull(), point(g["x"], g["y"]))


def _vertices(raw: Column) -> Column:
    return F.transform(raw, lambda p: point(p[0], p[1]))


def esri_line(g: Column) -> Column:
    """Paths with at least two vertices; none left is no geometry."""
    paths = F.filter(g["paths"], lambda p: F.size(p) >= 2)
    return F.when(F.size(paths) > 0, F.transform(paths, _vertices))


def inner_point(ring: Column) -> Column:
    """A point inside a ring: halfway between the first two walls that a level
    between its two lowest vertex heights meets. NULL for a flat ring."""
    ys = F.array_sort(F.array_distinct(F.transform(ring, lambda p: p["y"])))
    y = (F.get(ys, F.lit(0)) + F.get(ys, F.lit(1))) / 2
    met = F.filter(ring_pieces(ring), lambda e: (e["y1"] > y) != (e["y2"] > y))
    xs = F.array_sort(
        F.transform(met, lambda e: e["x1"] + (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]))
    )
    return point((F.get(xs, F.lit(0)) + F.get(xs, F.lit(1))) / 2, y)


def esri_polygon(g: Column) -> Column:
    """Rings to polygons: clockwise rings are shells, the others holes of the
    shell around them; rings all of one sign are all shells.

    A hole is placed by a point inside it; one that no shell holds is dropped.
    """
    rings = F.transform(F.filter(g["rings"], lambda r: F.size(r) >= 4), _vertices)
    clockwise = F.filter(rings, lambda r: signed_area(r) < 0)
    mixed = F.size(clockwise) > 0
    shells = F.when(mixed, clockwise).otherwise(rings)
    holes = F.when(mixed, F.filter(rings, lambda r: signed_area(r) >= 0)).otherwise(F.filter(rings, lambda r: F.lit(False)))
    return F.when(
        F.size(rings) > 0,
        F.transform(
            shells,
            lambda s: F.struct(
                s.alias("shell"),
                F.transform(
                    F.filter(
                        F.transform(holes, lambda h: F.struct(h.alias("h"), inner_point(h).alias("p"))),
                        lambda x: point_in_pieces(x["p"]["x"], x["p"]["y"], ring_pieces(s)),
                    ),
                    lambda x: x["h"],
                ).alias("holes"),
            ),
        ),
    )


def add_iso_dates(df: DataFrame, dates: Sequence[str]) -> DataFrame:
    """``<column>_iso`` beside each epoch-millisecond column that exists."""
    return df.withColumns({f"{c}_iso": from_epoch_ms(F.col(c)) for c in dates if c in df.columns})
