"""Reconciliation, domain gates, support and layer catalogue."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numbers import LEAST_SURVEYED, count_if, ratio
from ..session import settle

# A layer whose box leaves these longitudes/latitudes is suspect.
LAYER_LON = (-110.0, -60.0)
LAYER_LAT = (-60.0, -15.0)


class DomainError(ValueError):
    """A control that must stop the run before anything is written."""


def outside_domain(df: DataFrame, master: DataFrame, key: str) -> DataFrame:
    """Non-null keys the master does not know."""
    return df.where(F.col(key).isNotNull()).join(master.select(key).distinct(), key, "left_anti")


def require_domain(df: DataFrame, master: DataFrame, key: str) -> DataFrame:
    """Pass ``df`` on, or stop with the most frequent offending keys.

    It is written out first, so that checking it and using it are one computation."""
    df = settle(df)
    worst = outside_domain(df, master, key).groupBy(key).count().orderBy(F.desc("count"), key).limit(10)
    rows = worst.collect()
    if rows:
        raise DomainError("keys outside the master: " + ", ".join(f"{r[0]} ({r[1]})" for r in rows))
    return df


def require_master(master: DataFrame, key: str, name: str, expected: int | None = None) -> DataFrame:
    """Code and name must both be unique, and complete if a size is expected."""
    r = master.agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct(key).alias("codes"),
        F.countDistinct(name).alias("names"),
    ).first()
    if r.codes != r.n or r.names != r.n or (expected is not None and r.n != expected):
        raise DomainError(f"master not unique or incomplete: {r.n} rows, {r.codes} codes, {r.names} names")
    return master


def unmatched(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows a join would lose, reported instead of vanishing."""
    return df.join(other.select(*keys).distinct(), list(keys), "left_anti")


def layer_problems(rows: Column, declared: Column, bare: Column, box: Sequence[Column]) -> Column:
    """What is wrong with a landed layer, as codes with their figures after a colon:
    fewer or more rows than declared, rows without a shape, a box out of place."""
    west, south, east, north = box
    inside = (
        (west > LAYER_LON[0]) & (east < LAYER_LON[1]) & (south > LAYER_LAT[0]) & (north < LAYER_LAT[1])
    )
    figures = lambda *c: F.concat_ws("/", *[x.cast("string") for x in c])
    messages = F.array(
        F.when(rows != declared, F.concat(F.lit("row_count:"), figures(rows, declared))),
        F.when(bare > 0, F.concat(F.lit("no_shape:"), figures(bare))),
        F.when(~inside, F.concat(F.lit("box:"), figures(*[F.round(c, 3) for c in box]))),
    )
    return F.array_compact(messages)


def catalogue(manifest: DataFrame) -> DataFrame:
    """Layers, rows and megabytes by theme."""
    return manifest.groupBy("grupo").agg(
        F.count(F.lit(1)).alias("capas"),
        F.sum("n_registros").alias("registros"),
        F.sum("parquet_mb").alias("parquet_mb"),
        count_if(F.col("vigente")).alias("vigentes"),
        F.sum(F.size("problemas")).alias("problemas"),
    )


def catalogue_rows(manifest: DataFrame) -> DataFrame:
    """Layer list: current first, then snapshot, then slug."""
    return manifest.orderBy("grupo", F.desc("vigente"), "corte", "slug")


def problem_list(manifest: DataFrame) -> DataFrame:
    return manifest.select("slug", F.explode_outer("problemas").alias("problema"))


def support_coverage(zones: DataFrame, by: Sequence[str], n: str, least: float = LEAST_SURVEYED) -> DataFrame:
    """Zones with enough surveyed trips, per city."""
    known = zones.where(F.col(n).isNotNull())
    return known.groupBy(*by).agg(
        F.count(F.lit(1)).alias("zonas"),
        count_if(F.col(n) >= least).alias("con_muestra"),
        ratio(count_if(F.col(n) >= least), F.count(F.lit(1))).alias("pct"),
    )


def difference_report(df: DataFrame, own: str, official: str, over: float = 0.5) -> DataFrame:
    """Rows where two sources differ by more than ``over`` points."""
    return df.withColumn("dif_pp", F.col(own) - F.col(official)).where(F.abs("dif_pp") > over)


def difference_summary(df: DataFrame, diff: str) -> DataFrame:
    return df.agg(
        F.count(diff).alias("n"), F.avg(F.abs(diff)).alias("mean_abs"), F.max(F.abs(diff)).alias("max_abs")
    )
