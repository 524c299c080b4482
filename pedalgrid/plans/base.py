"""Query registry and the stand-ins that map test tables to the data model.

The test tables carry no geometry, so coordinates come from embedding
components: every vector gives one straight segment and one point.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# thresholds and tolerances scaled to the stand-in geometry
LIMITS = (2, 5, 10, 20, 50)
TOLERANCES = (0.5, 1.0, 2.0, 5.0, 10.0, 20.0)


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def component(i: int) -> Column:
    return F.col("embedding")[i].cast("double")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segment per vector: ``vec_id, label, x1, y1, x2, y2``."""
    x, y = component(0) * 1000, component(1) * 1000
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        "label",
        x.alias("x1"),
        y.alias("y1"),
        (x + component(2) * 200).alias("x2"),
        (y + component(3) * 200).alias("y2"),
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point per vector with a population, riders and a score."""
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        "label",
        (component(4) * 1000).alias("x"),
        (component(5) * 1000).alias("y"),
        F.floor(F.abs(component(6)) * 10000).alias("people"),
        F.floor(F.abs(component(7)) * 1000).alias("riders"),
        component(8).alias("score"),
    )


def r4(c: Column, digits: int = 4) -> Column:
    """Rounded for comparison; the added zero turns -0.0 into 0.0."""
    return F.round(c, digits) + F.lit(0.0)


SEG = """seg AS (
  SELECT vec_id, label, 1000*e[1] AS x1, 1000*e[2] AS y1, 1000*e[1] + 200*e[3] AS x2, 1000*e[2] + 200*e[4] AS y2
  FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings))"""

PT = """pt AS (
  SELECT vec_id, label, 1000*e[5] AS x, 1000*e[6] AS y, CAST(floor(abs(e[7])*10000) AS BIGINT) AS people,
         CAST(floor(abs(e[8])*1000) AS BIGINT) AS riders, e[9] AS score
  FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings))"""


def sql_point_segment(px: str, py: str, s: str) -> str:
    """Squared distance from a point to segment ``s`` in SQL."""
    dx, dy = f"({s}.x2-{s}.x1)", f"({s}.y2-{s}.y1)"
    t = (
        f"CASE WHEN {dx}*{dx}+{dy}*{dy} > 0 THEN least(1.0, greatest(0.0, "
        f"(({px}-{s}.x1)*{dx}+({py}-{s}.y1)*{dy})/({dx}*{dx}+{dy}*{dy}))) ELSE 0.0 END"
    )
    return f"(pow({px}-({s}.x1+({t})*{dx}),2)+pow({py}-({s}.y1+({t})*{dy}),2))"


def sql_segment_segment(a: str, b: str) -> str:
    """Squared distance between segments ``a`` and ``b`` in SQL."""

    def side(s, px, py):
        return f"sign(({s}.x2-{s}.x1)*({py}-{s}.y1)-({s}.y2-{s}.y1)*({px}-{s}.x1))"

    cross = (
        f"{side(a, b + '.x1', b + '.y1')}*{side(a, b + '.x2', b + '.y2')} < 0 AND "
        f"{side(b, a + '.x1', a + '.y1')}*{side(b, a + '.x2', a + '.y2')} < 0"
    )
    ends = ", ".join(
        [
            sql_point_segment(f"{a}.x1", f"{a}.y1", b),
            sql_point_segment(f"{a}.x2", f"{a}.y2", b),
            sql_point_segment(f"{b}.x1", f"{b}.y1", a),
            sql_point_segment(f"{b}.x2", f"{b}.y2", a),
        ]
    )
    return f"CASE WHEN {cross} THEN 0.0 ELSE least({ends}) END"


NEAR = f"""near AS (
  SELECT p.vec_id, sqrt(min({sql_point_segment('p.x', 'p.y', 's')})) AS dist
  FROM pt p CROSS JOIN seg s GROUP BY p.vec_id)"""
