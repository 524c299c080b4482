"""The published panel: snapshots stacked, keys repaired, geometry checked against them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.geo import line_length, line_pieces, representative_vertex
from ..session import settle
from .panel import conflict_flag, region_flags, resolve_key, stage_flags, union_snapshots
from .polygons import first_polygon, own_polygon_distance


def build_panel(
    snapshots: Sequence[DataFrame],
    master: DataFrame,
    shapes: DataFrame,
    line: str = "line",
    code: str = "cut",
    name: str = "comuna",
    geom: str = "geom",
) -> DataFrame:
    """All snapshots on one schema with resolved keys, flags and measured geometry.

    ``snapshots`` come from ``panel.snapshot`` and keep their metric ``line``;
    ``shapes`` are the communes' metric polygons under ``cut_com``. Added to the
    homogenised columns: ``cut_com, cut_com_origen, cut_reg, cut_reg_declarado_discrepa,
    existente, km_geom``; ``cut_com_geo``, the commune around a vertex amid the line;
    ``dist_comuna_llave_m``, the distance to the commune of the key (0 inside, NULL
    without one); ``cut_com_discrepa_geo``, if that is too far for a border case.
    """
    keyed = stage_flags(
        region_flags(resolve_key(union_snapshots(snapshots), master, "cut_com_crudo", "comuna_txt", code, name))
    )
    # numbered in the files, so that every later reading sees the same numbers
    rows = settle(keyed.withColumn("_row", F.monotonically_increasing_id()))
    shaped = rows.where(F.size(line) > 0)
    amid = shaped.select("_row", representative_vertex(F.col(line)).alias("_v")).select("_row", "_v.x", "_v.y")
    around = first_polygon(amid, shapes.select("cut_com", geom), "_row", "cut_com", geom).select(
        "_row", F.col("cut_com").alias("cut_com_geo")
    )
    pieces = shaped.select("_row", "cut_com", F.explode(line_pieces(F.col(line))).alias("_p")).select(
        "_row", "cut_com", "_p.*"
    )
    away = own_polygon_distance(pieces, shapes, "_row", "cut_com", geom, "dist_comuna_llave_m")
    return (
        rows.withColumn("km_geom", line_length(F.col(line)) / 1000)
        .join(around, "_row", "left")
        .join(away, "_row", "left")
        .withColumn("cut_com_discrepa_geo", conflict_flag(F.col("dist_comuna_llave_m")))
        .drop("_row")
    )
