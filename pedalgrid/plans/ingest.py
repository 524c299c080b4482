"""Ingest queries: geometry is encoded from the tables, then read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import geo as G, time as T
from ..sources import esri as E, readers, sinks, wkb
from .base import SEG, component, query, r4, segments, table
from .geometry import STARS, _radii, star, stars


@query(
    "wkb_ingest",
    f"""
WITH {SEG}, {STARS}, a AS (SELECT zona, abs(sum(x1 * y2 - x2 * y1)) / 2 AS area, count(*) AS n FROM ed GROUP BY 1)
SELECT seg.vec_id, round(sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)), 4) AS length, round(area, 3) AS area, CAST(n + 1 AS INTEGER) AS vertices
FROM seg JOIN a ON a.zona = seg.vec_id
""",
)
def wkb_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = segments(spark, sf_dir).select(
        "vec_id", F.array(F.array(G.point(F.col("x1"), F.col("y1")), G.point(F.col("x2"), F.col("y2")))).alias("line")
    )
    read_lines = wkb.read_wkb(wkb.write_wkb(lines, "line", "line"), "geometry")
    shapes = stars(spark, sf_dir).select(F.col("zona").alias("vec_id"), "geom")
    read_shapes = wkb.read_wkb(wkb.write_wkb(shapes, "geom", "polygon"), "geometry")
    measured = read_shapes.select(
        "vec_id",
        F.round(G.polygon_area(F.col("polygon")), 3).alias("area"),
        F.size(F.col("polygon")[0]["shell"]).alias("vertices"),
    )
    return read_lines.select("vec_id", r4(G.line_length(F.col("line"))).alias("length")).join(measured, "vec_id")


def _pairs(ring: Column) -> Column:
    return F.transform(ring, lambda p: F.array(p["x"], p["y"]))


@query(
    "esri_rings",
    f"""
WITH {STARS}, a AS (SELECT zona, label, abs(sum(x1 * y2 - x2 * y1)) / 2 AS area, min(x1) AS min_x, max(y1) AS max_y FROM ed JOIN st USING (zona, label) GROUP BY 1, 2)
SELECT zona AS vec_id, CAST(CASE WHEN label < 5 THEN 1 ELSE 2 END AS INTEGER) AS shells, CAST(CASE WHEN label < 5 THEN 1 ELSE 0 END AS INTEGER) AS holes,
       round(CASE WHEN label < 5 THEN area * (1 - 0.25) ELSE area * (1 + 0.25) END, 3) AS area, round(min_x, 4) AS min_x, round(max_y, 4) AS max_y FROM a
""".replace("ed JOIN st USING (zona, label)", "(SELECT ed.*, st.label FROM ed JOIN st USING (zona)) q"),
)
def esri_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    cx, cy = component(8) * 1000, component(9) * 1000
    outer = star(cx, cy, _radii(), turn=-1)
    # a counter-clockwise ring is a hole; two clockwise ones are two shells
    inner = F.when(F.col("label") < 5, star(cx, cy, _radii(), 0.5, 1)).otherwise(star(cx, cy, _radii(), 0.5, -1))
    page = F.to_json(F.struct(F.array(_pairs(outer), _pairs(inner)).alias("rings")))
    landed = table(spark, sf_dir, "embeddings").select("vec_id", page.alias("geometry"))
    parsed = landed.select("vec_id", E.esri_polygon(F.from_json("geometry", E.GEOMETRY)).alias("poly"))
    shell = F.col("poly")[0]["shell"]
    return parsed.select(
        "vec_id",
        F.size("poly").alias("shells"),
        F.size(F.flatten(F.transform("poly", lambda g: g["holes"]))).alias("holes"),
        F.round(G.polygon_area(F.col("poly")), 3).alias("area"),
        r4(F.array_min(F.transform(shell, lambda p: p["x"]))).alias("min_x"),
        r4(F.array_max(F.transform(shell, lambda p: p["y"]))).alias("max_y"),
    )


@query(
    "esri_lines",
    f"WITH {SEG} SELECT vec_id, CAST(CASE WHEN label = 0 THEN NULL ELSE 1 END AS INTEGER) AS parts, CASE WHEN label <> 0 THEN round(sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)), 4) END AS length, CASE WHEN label <> 3 THEN round(x1, 4) END AS x FROM seg",
)
def esri_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    segs = segments(spark, sf_dir)
    start, end = F.array("x1", "y1"), F.array("x2", "y2")
    # one-vertex paths carry no line
    paths = F.when(F.col("label") == 0, F.array(F.array(start))).otherwise(F.array(F.array(start, end), F.array(start)))
    page = F.to_json(F.struct(paths.alias("paths")))
    spot = F.to_json(F.struct(F.when(F.col("label") != 3, F.col("x1")).alias("x"), F.col("y1").alias("y")))
    rows = segs.select("vec_id", F.from_json(page, E.GEOMETRY).alias("g"), F.from_json(spot, E.GEOMETRY).alias("p"))
    line = E.esri_line(F.col("g"))
    return rows.select(
        "vec_id",
        F.when(line.isNotNull(), F.size(line)).alias("parts"),
        F.when(line.isNotNull(), r4(G.line_length(line))).alias("length"),
        r4(E.esri_point(F.col("p"))["x"]).alias("x"),
    )


@query(
    "geojson_features",
    f"WITH {STARS} SELECT 'Ciudad ' || label AS ciudad, zona AS zona, round(abs(sum(x1 * y2 - x2 * y1)) / 2, 3) AS area FROM (SELECT ed.*, st.label FROM ed JOIN st USING (zona)) GROUP BY 1, 2",
)
def geojson_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("Ciudad "), F.col("label").cast("string"))
    text = sinks.feature(
        {"zona": F.col("zona"), "ciudad": name}, "MultiPolygon", sinks.polygon_coordinates(F.col("geom"))
    )
    written = stars(spark, sf_dir).select(text.alias("value"))
    schema = "struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>"
    back = written.select(F.from_json("value", schema).alias("f"))
    poly = readers.polygon_from_geojson(F.col("f.geometry.type"), F.col("f.geometry.coordinates"))
    return back.select(
        F.col("f.properties")["ciudad"].alias("ciudad"),
        F.col("f.properties")["zona"].cast("bigint").alias("zona"),
        F.round(G.polygon_area(poly), 3).alias("area"),
    )


@query(
    "id_blocks",
    """
WITH i AS (SELECT id, CAST(floor((row_number() OVER (ORDER BY id) - 1) / 400) AS BIGINT) AS block FROM (SELECT DISTINCT o_custkey AS id FROM orders))
SELECT block, count(*) AS n, min(id) AS first, max(id) AS last, CAST(sum(id) AS BIGINT) AS total FROM i GROUP BY 1
""",
)
def id_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = E.id_blocks(table(spark, sf_dir, "orders"), "o_custkey")
    ids = F.col("ids")
    return blocks.select(
        "block",
        F.size(ids).cast("bigint").alias("n"),
        F.array_min(ids).alias("first"),
        F.array_max(ids).alias("last"),
        F.aggregate(ids, F.lit(0).cast("bigint"), lambda a, v: a + v).alias("total"),
    )


@query(
    "id_blocks_large",
    """
WITH i AS (SELECT id, CAST(floor((row_number() OVER (ORDER BY id) - 1) / 400) AS BIGINT) AS block FROM (SELECT DISTINCT o_orderkey + 1152921504606846976 AS id FROM orders))
SELECT block, count(*) AS n, min(id) AS first, max(id) AS last FROM i GROUP BY 1
""",
)
def id_blocks_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids beyond what a double holds apart."""
    ids = table(spark, sf_dir, "orders").select((F.col("o_orderkey").cast("bigint") + F.lit(2**60)).alias("id"))
    return E.id_blocks(ids, "id").select(
        "block", F.size("ids").cast("bigint").alias("n"), F.array_min("ids").alias("first"), F.array_max("ids").alias("last")
    )


@query(
    "epoch_dates",
    """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS fecha,
       CASE WHEN o_orderstatus = 'P' THEN 'sin fecha' ELSE CAST(epoch_ms(o_orderdate) AS VARCHAR) END AS crudo FROM orders
""",
)
def epoch_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    raw = F.when(F.col("o_orderstatus") == "P", "sin fecha").otherwise(F.unix_millis(F.col("o_orderdate").cast("timestamp")).cast("string"))
    dated = E.add_iso_dates(o.select("o_orderkey", raw.alias("crudo")), ["crudo", "Primera_fecha"])
    return dated.select("o_orderkey", "crudo", T.iso_day(F.col("crudo_iso")).alias("fecha"))
