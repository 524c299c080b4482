"""Coverage cells and point density on a square grid."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.geo import point_piece_d2
from .nearest import PIECE
from .proximity import cell_of, raster


def coverage_cells(pieces: DataFrame, side: float, radius: float) -> DataFrame:
    """``(cx, cy, dist)``: grid cells whose centre is within ``radius`` of the
    network, each piece offering only the cells around itself."""
    cx, cy = (F.col("_cx") + 0.5) * float(side), (F.col("_cy") + 0.5) * float(side)
    # the smallest distance does not mind a cell listed twice
    rows = raster(pieces.select(*PIECE).distinct(), side, radius, [], once=False)
    return (
        rows.groupBy(F.col("_cx").alias("cx"), F.col("_cy").alias("cy"))
        .agg(F.sqrt(F.min(point_piece_d2(cx, cy, *[F.col(c) for c in PIECE]))).alias("dist"))
        .where(F.col("dist") <= float(radius))
    )


def density(
    points: DataFrame, x: str, y: str, side: float, neighbour: float = 0.0, by: Sequence[str] = ()
) -> DataFrame:
    """Points per cell, plus ``neighbour`` times the eight cells around it.

    Counted first, spread afterwards: the blur only ever sees one row per cell.
    """
    counted = (
        points.where(F.col(x).isNotNull() & F.col(y).isNotNull())
        .groupBy(*by, cell_of(F.col(x), side).alias("cx"), cell_of(F.col(y), side).alias("cy"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    step = F.array(F.lit(-1), F.lit(0), F.lit(1))
    spread = (
        counted.withColumn("_dx", F.explode(step))
        .withColumn("_dy", F.explode(step))
        .withColumn("_home", (F.col("_dx") == 0) & (F.col("_dy") == 0))
    )
    return (
        spread.groupBy(*by, (F.col("cx") + F.col("_dx")).alias("cx"), (F.col("cy") + F.col("_dy")).alias("cy"))
        .agg(
            F.sum(F.when(F.col("_home"), F.col("n")).otherwise(0)).alias("n"),
            F.sum(F.when(F.col("_home"), F.col("n").cast("double")).otherwise(F.col("n") * neighbour)).alias("heat"),
        )
        .where(F.col("n") > 0)
    )


def kernel(side: float, radius: float) -> list[float]:
    """Weights of the cells along one axis, from the middle one out to ``radius`` on
    either side: a bell whose third deviation is at the radius."""
    reach = math.floor(radius / side)
    return [math.exp(-0.5 * (3 * k * side / radius) ** 2) for k in range(-reach, reach + 1)]


def concentration(
    points: DataFrame, x: str, y: str, side: float, radius: float, by: Sequence[str] = ()
) -> DataFrame:
    """``(cx, cy, n, heat)``: points per cell, and points around it by a bell of ``radius``.

    The bell is a product of one along either axis, so cells are spread along one and the
    sums along the other: twice the kernel's length in rows per occupied cell, not its square.
    Cells without a point but within reach are listed with ``n`` 0.
    """
    if not 0 < side <= radius:
        raise ValueError("wants a radius of a cell's side at least")
    weights = kernel(side, radius)
    reach = len(weights) // 2
    steps = F.array(*[F.struct(F.lit(k - reach).alias("d"), F.lit(w).alias("w")) for k, w in enumerate(weights)])
    rows = (
        points.where(F.col(x).isNotNull() & F.col(y).isNotNull())
        .groupBy(*by, cell_of(F.col(x), side).alias("cx"), cell_of(F.col(y), side).alias("cy"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("heat", F.col("n").cast("double"))
    )
    for axis in ("cx", "cy"):
        other = "cy" if axis == "cx" else "cx"
        rows = (
            rows.withColumn("_s", F.explode(steps))
            .groupBy(*by, (F.col(axis) + F.col("_s.d")).alias(axis), other)
            .agg(
                F.sum(F.when(F.col("_s.d") == 0, F.col("n")).otherwise(F.lit(0))).alias("n"),
                F.sum(F.col("heat") * F.col("_s.w")).alias("heat"),
            )
        )
    return rows.select(*by, "cx", "cy", "n", "heat")


def total_bounds(pieces: DataFrame) -> DataFrame:
    return pieces.agg(
        F.min(F.least("x1", "x2")).alias("min_x"),
        F.min(F.least("y1", "y2")).alias("min_y"),
        F.max(F.greatest("x1", "x2")).alias("max_x"),
        F.max(F.greatest("y1", "y2")).alias("max_y"),
    )
