"""Geometry queries on segments, points and polygons made from embeddings."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import geo as G
from ..operators import grids, nearest, panel, polygons, proximity as P
from ..operators.panel_build import build_panel
from .base import (
    NEAR,
    PT,
    SEG,
    TOLERANCES,
    component,
    points,
    query,
    r4,
    segments,
    sql_point_segment,
    sql_segment_segment,
    table,
)

CHOSEN = 5.0
CORNERS = 8


@query("nearest_distance", f"WITH {SEG}, {PT}, {NEAR} SELECT vec_id, round(dist, 4) AS dist FROM near")
def nearest_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = nearest.point_pieces(points(spark, sf_dir), "x", "y", ["vec_id"])
    out = nearest.nearest_distance(asked, segments(spark, sf_dir), "vec_id")
    return out.withColumn("dist", r4(F.col("dist")))


_PAIRS = f"""
WITH {SEG}, u AS (SELECT min(vec_id) AS vec_id, x1, y1, x2, y2 FROM seg GROUP BY x1, y1, x2, y2),
pr AS (SELECT a.vec_id AS src, b.vec_id AS dst, sqrt({sql_segment_segment('a', 'b')}) AS dist FROM u a JOIN u b ON a.vec_id < b.vec_id)
"""


@query(
    "threshold_pairs",
    _PAIRS + f"SELECT src, dst, round(dist, 4) AS dist FROM pr WHERE dist <= {CHOSEN}",
)
def threshold_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = P.threshold_pairs(segments(spark, sf_dir), "vec_id", CHOSEN)
    return out.withColumn("dist", r4(F.col("dist")))


def _components_sql(tol: str) -> str:
    return f"""
{_PAIRS.replace('WITH', 'WITH RECURSIVE', 1)}, tols AS (SELECT unnest([{tol}]) AS tol),
ed AS (SELECT tol, src, dst FROM pr, tols WHERE dist <= tol UNION ALL SELECT tol, dst, src FROM pr, tols WHERE dist <= tol),
rc AS (SELECT tol, vec_id, vec_id AS lab FROM u, tols
       UNION SELECT ed.tol, ed.dst, rc.lab FROM rc JOIN ed ON ed.src = rc.vec_id AND ed.tol = rc.tol),
cc AS (SELECT tol, vec_id, min(lab) AS component FROM rc GROUP BY 1, 2),
lab AS (SELECT cc.tol, s.vec_id, s.label, cc.component, sqrt(pow(s.x2 - s.x1, 2) + pow(s.y2 - s.y1, 2)) / 1000 AS km
        FROM seg s JOIN u ON u.x1 = s.x1 AND u.y1 = s.y1 AND u.x2 = s.x2 AND u.y2 = s.y2 JOIN cc ON cc.vec_id = u.vec_id)
"""


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    segs = segments(spark, sf_dir)
    km = (F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) / 1000).alias("km")
    return P.network_components(segs, "vec_id", CHOSEN).join(segs.select("vec_id", "label", km), "vec_id")


@query("components", _components_sql(str(CHOSEN)) + "SELECT vec_id, component FROM lab")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.network_components(segments(spark, sf_dir), "vec_id", CHOSEN)


@query(
    "component_summary",
    _components_sql(str(CHOSEN))
    + """, n AS (SELECT component, label, sum(km) AS km, count(*) AS n FROM lab GROUP BY 1, 2)
SELECT component, round(sum(km), 4) AS km, CAST(sum(n) AS BIGINT) AS n_segments, count(*) AS n_communes,
       arg_min(label, (-n, label)) AS main_commune, string_agg(CAST(label AS VARCHAR), ',' ORDER BY label) AS communes FROM n GROUP BY 1""",
)
def component_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labelled(spark, sf_dir)
    lists = P.component_communes(rows, "label").select(
        "component", F.array_join(F.col("communes").cast("array<string>"), ",").alias("communes")
    )
    out = P.component_summary(rows, "label").join(lists, "component")
    return out.withColumn("km", r4(F.col("km")))


@query(
    "fragmentation",
    _components_sql(str(CHOSEN))
    + """, n AS (SELECT label, component, sum(km) AS km, count(*) AS n FROM lab GROUP BY 1, 2)
SELECT label, round(sum(km), 4) AS km, CAST(sum(n) AS BIGINT) AS n_segments, count(*) AS n_components, round(max(km), 4) AS km_largest,
       round(100 * max(km) / sum(km), 4) AS pct_km_largest, round(sum(km) / count(*), 4) AS km_per_component FROM n GROUP BY 1""",
)
def fragmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = P.commune_fragmentation(_labelled(spark, sf_dir), "label")
    return out.withColumns(
        {c: r4(F.col(c)) for c in ("km", "km_largest", "pct_km_largest", "km_per_component")}
    )


@query(
    "scope_fragments",
    _components_sql(str(CHOSEN))
    + "SELECT count(DISTINCT component) AS n_components FROM lab WHERE label IN (1, 3, 5)",
)
def scope_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labelled(spark, sf_dir)
    return P.components_touching(rows, rows.where(F.col("label").isin(1, 3, 5)), "label")


@query(
    "tolerance_sweep",
    _components_sql(", ".join(map(str, TOLERANCES)))
    + """, n AS (SELECT tol, component, sum(km) AS km, count(*) AS n FROM lab GROUP BY 1, 2)
SELECT CAST(tol AS DOUBLE) AS tol, count(*) AS n_components, round(max(km), 4) AS km_largest, round(100 * max(km) / sum(km), 4) AS pct_km_largest,
       round(median(km), 4) AS km_median, round(100.0 * count(*) FILTER (n = 1) / count(*), 4) AS pct_single FROM n GROUP BY 1""",
)
def tolerance_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    segs = segments(spark, sf_dir)
    km = (F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) / 1000).alias("km")
    found = P.components_by_tolerance(segs, "vec_id", TOLERANCES).join(segs.select("vec_id", km), "vec_id")
    out = P.tolerance_sweep(found)
    return out.withColumns(
        {c: r4(F.col(c)) for c in ("km_largest", "pct_km_largest", "km_median", "pct_single")}
    )


NEAREST = 3


@query(
    "nearest_segments",
    f"""
WITH {SEG}, {PT}, al AS (SELECT p.vec_id, s.vec_id AS segment, sqrt({sql_point_segment('p.x', 'p.y', 's')}) AS dist FROM pt p CROSS JOIN seg s),
rk AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, segment) AS n FROM al)
SELECT vec_id, CAST(n AS INT) AS rank, segment, round(dist, 4) AS dist FROM rk WHERE n <= {NEAREST}
""",
)
def nearest_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = nearest.point_pieces(points(spark, sf_dir), "x", "y", ["vec_id"])
    net = segments(spark, sf_dir).withColumnRenamed("vec_id", "segment")
    out = nearest.nearest_rows(asked, net, "vec_id", "segment", NEAREST)
    return out.select("vec_id", "rank", "segment", r4(F.col("dist")).alias("dist"))


@query(
    "site_components",
    _components_sql(str(CHOSEN))
    + f""", {PT}, cs AS (SELECT component, sum(km) AS km FROM lab GROUP BY 1),
big AS (SELECT component FROM cs ORDER BY round(km, 6) DESC, component LIMIT 1),
al AS (SELECT p.vec_id, l.component, sqrt({sql_point_segment('p.x', 'p.y', 's')}) AS dist, s.vec_id AS segment
       FROM pt p CROSS JOIN seg s JOIN lab l ON l.vec_id = s.vec_id),
own AS (SELECT vec_id, arg_min(component, (dist, segment)) AS component, min(dist) AS dist FROM al GROUP BY 1),
far AS (SELECT vec_id, min(dist) AS dist_largest FROM al WHERE component = (SELECT component FROM big) GROUP BY 1)
SELECT own.vec_id, own.component, round(own.dist, 4) AS dist, own.component = (SELECT component FROM big) AS on_largest,
       round(far.dist_largest, 4) AS dist_largest FROM own JOIN far ON far.vec_id = own.vec_id
""",
)
def site_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    segs = segments(spark, sf_dir)
    parts = P.network_components(segs, "vec_id", CHOSEN)
    asked = nearest.point_pieces(points(spark, sf_dir), "x", "y", ["vec_id"])
    out = P.site_components(asked, segs, parts, "vec_id", "vec_id")
    return out.withColumns({c: r4(F.col(c)) for c in ("dist", "dist_largest")})


_ENDS = f"""
WITH {SEG}, en AS (SELECT vec_id, x1 AS x, y1 AS y FROM seg UNION ALL SELECT vec_id, x2, y2 FROM seg),
cl AS (SELECT en.vec_id, en.x, en.y, CASE WHEN bool_or(least(pow(en.x - s.x1, 2) + pow(en.y - s.y1, 2), pow(en.x - s.x2, 2) + pow(en.y - s.y2, 2)) <= 25) THEN 'endpoint'
              WHEN bool_or({sql_point_segment('en.x', 'en.y', 's')} <= 25) THEN 'interior' ELSE 'none' END AS class
       FROM en JOIN seg s ON s.vec_id <> en.vec_id GROUP BY 1, 2, 3)
"""


@query(
    "endpoint_diagnosis",
    _ENDS + "SELECT class, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS pct FROM cl GROUP BY 1",
)
def endpoint_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = P.endpoint_classes(segments(spark, sf_dir), "vec_id", CHOSEN)
    per = ends.groupBy("class").agg(F.count(F.lit(1)).alias("n")).withColumn("_one", F.lit(0))
    all_ = per.agg(F.sum("n").alias("_t")).withColumn("_one", F.lit(0))
    return per.join(F.broadcast(all_), "_one").select("class", "n", r4(100 * F.col("n") / F.col("_t")).alias("pct"))


@query(
    "endpoint_components",
    f"""
WITH RECURSIVE {SEG}, pr AS (
  SELECT a.vec_id AS src, b.vec_id AS dst FROM seg a JOIN seg b ON a.vec_id <> b.vec_id AND least(
    pow(a.x1 - b.x1, 2) + pow(a.y1 - b.y1, 2), pow(a.x1 - b.x2, 2) + pow(a.y1 - b.y2, 2),
    pow(a.x2 - b.x1, 2) + pow(a.y2 - b.y1, 2), pow(a.x2 - b.x2, 2) + pow(a.y2 - b.y2, 2)) <= 25),
rc AS (SELECT vec_id, vec_id AS lab FROM seg UNION SELECT pr.dst, rc.lab FROM rc JOIN pr ON pr.src = rc.vec_id)
SELECT vec_id, min(lab) AS component FROM rc GROUP BY 1
""",
)
def endpoint_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = P.endpoint_pieces(segments(spark, sf_dir), "vec_id")
    return P.network_components(ends, "vec_id", CHOSEN)


def star(cx: Column, cy: Column, radii: list[Column], scale: float = 1.0, turn: int = 1) -> Column:
    """Closed star-shaped ring, counter-clockwise for ``turn`` 1."""
    corners = []
    for j in range(CORNERS):
        a = 2 * math.pi * j / CORNERS
        corners.append(G.point(cx + radii[j] * scale * math.cos(a), cy + radii[j] * scale * math.sin(a)))
    order = corners if turn == 1 else corners[::-1]
    return F.array(*order, order[0])


def _radii() -> list[Column]:
    return [F.abs(component(10 + j)) * 300 + 20 for j in range(CORNERS)]


def stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One concave eight-cornered polygon per vector."""
    ring = star(component(8) * 1000, component(9) * 1000, _radii())
    shell = F.struct(ring.alias("shell"), F.array().cast(f"array<array<{G.POINT_DDL}>>").alias("holes"))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("zona"), "label", F.array(shell).alias("geom"))


def _corner_sql() -> str:
    xs = ", ".join(f"cx + r[{j + 1}] * {math.cos(2 * math.pi * j / CORNERS)!r}" for j in range(CORNERS))
    ys = ", ".join(f"cy + r[{j + 1}] * {math.sin(2 * math.pi * j / CORNERS)!r}" for j in range(CORNERS))
    return f"[{xs}] AS xs, [{ys}] AS ys"


STARS = f"""st AS (SELECT zona, label, {_corner_sql()} FROM (
  SELECT vec_id AS zona, label, 1000 * e[9] AS cx, 1000 * e[10] AS cy, list_transform(e[11:18], lambda v: abs(v) * 300 + 20) AS r
  FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings))),
ed AS (SELECT zona, xs[j + 1] AS x1, ys[j + 1] AS y1, xs[(j + 1) % 8 + 1] AS x2, ys[(j + 1) % 8 + 1] AS y2 FROM st, (SELECT unnest(range(8)) AS j))"""

RAY = "((ed.y1 > p.y) <> (ed.y2 > p.y)) AND p.x < (ed.x2 - ed.x1) * (p.y - ed.y1) / (ed.y2 - ed.y1) + ed.x1"


@query(
    "point_in_polygon",
    f"""
WITH {PT}, {STARS}, hit AS (SELECT p.vec_id, ed.zona FROM pt p JOIN ed ON {RAY} GROUP BY 1, 2 HAVING count(*) % 2 = 1)
SELECT pt.vec_id, min(hit.zona) AS zona FROM pt LEFT JOIN hit USING (vec_id) GROUP BY 1
""",
)
def point_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = polygons.first_polygon(
        points(spark, sf_dir).select("vec_id", "x", "y"), stars(spark, sf_dir), "vec_id", "zona", "geom"
    )
    return out.select("vec_id", "zona")


@query(
    "points_per_zone",
    f"""
WITH {PT}, {STARS}, hit AS (SELECT p.vec_id, p.people, ed.zona FROM pt p JOIN ed ON {RAY} GROUP BY 1, 2, 3 HAVING count(*) % 2 = 1)
SELECT st.zona, count(hit.vec_id) AS n, CAST(coalesce(sum(hit.people), 0) AS BIGINT) AS people FROM st LEFT JOIN hit USING (zona) GROUP BY 1
""",
)
def points_per_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    zones = stars(spark, sf_dir)
    # summed per spot before the join, so crowded spots travel as one row
    spots = points(spark, sf_dir).groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"), F.sum("people").alias("people"))
    counts = polygons.sums_in_polygons(spots, zones, "zona", "geom", ["n", "people"])
    return zones.select("zona").join(counts, "zona", "left").na.fill(0)


def _boxes(spark: SparkSession, sf_dir: str, at: int, keep: list[Column]) -> DataFrame:
    """Axis-parallel rectangles from four components."""
    cx, cy = component(at) * 1000, component(at + 1) * 1000
    w, h = F.abs(component(at + 2)) * 200 + 20, F.abs(component(at + 3)) * 200 + 20
    ring = F.array(
        G.point(cx - w, cy - h), G.point(cx + w, cy - h), G.point(cx + w, cy + h), G.point(cx - w, cy + h), G.point(cx - w, cy - h)
    )
    shell = F.struct(ring.alias("shell"), F.array().cast(f"array<array<{G.POINT_DDL}>>").alias("holes"))
    return table(spark, sf_dir, "embeddings").select(*keep, F.array(shell).alias("geom"))


def _box_sql(name: str, at: int, keep: str) -> str:
    return f"""{name} AS (SELECT {keep}, cx - w AS x0, cx + w AS x1, cy - h AS y0, cy + h AS y1 FROM (
  SELECT *, 1000 * e[{at + 1}] AS cx, 1000 * e[{at + 2}] AS cy, abs(e[{at + 3}]) * 200 + 20 AS w, abs(e[{at + 4}]) * 200 + 20 AS h
  FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)))"""


_OVERLAP = f"""
WITH {_box_sql('z', 20, 'vec_id AS zona, floor(abs(e[25]) * 10000) AS pob')}, {_box_sql('s', 26, 'vec_id AS fuente, label, floor(abs(e[31]) * 1000) AS gen, floor(abs(e[32]) * 100) AS n')},
o AS (SELECT z.zona, s.fuente, z.pob, s.label, s.gen, s.n, greatest(0, least(z.x1, s.x1) - greatest(z.x0, s.x0)) * greatest(0, least(z.y1, s.y1) - greatest(z.y0, s.y0)) AS area,
        (z.x1 - z.x0) * (z.y1 - z.y0) AS zarea FROM z CROSS JOIN s),
q AS (SELECT *, pob * area / zarea AS peso FROM o WHERE area > 0),
w AS (SELECT *, peso / nullif(sum(peso) OVER (PARTITION BY fuente), 0) AS w FROM q)
"""


def _allocation(spark: SparkSession, sf_dir: str):
    zones = _boxes(spark, sf_dir, 20, [F.col("vec_id").alias("zona"), F.floor(F.abs(component(24)) * 10000).alias("pob")])
    sources = _boxes(
        spark,
        sf_dir,
        26,
        [
            F.col("vec_id").alias("fuente"),
            F.col("label").cast("string").alias("ciudad"),
            F.floor(F.abs(component(30)) * 1000).alias("gen"),
            F.floor(F.abs(component(31)) * 100).alias("n"),
        ],
    )
    return sources, polygons.interpolate(zones, sources, "zona", "fuente", "pob", ["gen", "n"], label=["ciudad"])


@query(
    "overlay_area",
    _OVERLAP + "SELECT zona, fuente, round(area, 4) AS area FROM o WHERE area > 1e-9",
)
def overlay_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    zones = _boxes(spark, sf_dir, 20, [F.col("vec_id").alias("zona")])
    sources = _boxes(spark, sf_dir, 26, [F.col("vec_id").alias("fuente")]).withColumnRenamed("geom", "sgeom")
    out = polygons.overlay_area(zones, sources, "zona", "fuente", "geom", "sgeom")
    return out.withColumn("area", r4(F.col("area")))


@query(
    "areal_interpolation",
    _OVERLAP
    + "SELECT zona, round(sum(gen * coalesce(w, 0)), 4) AS gen, round(sum(n * coalesce(w, 0)), 4) AS n, min(CAST(label AS VARCHAR)) AS ciudad FROM w GROUP BY 1",
)
def areal_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.marts import merge_city_pieces

    _, pieces = _allocation(spark, sf_dir)
    out = merge_city_pieces(pieces, "zona", ["gen", "n"], "ciudad")
    return out.withColumns({"gen": r4(F.col("gen")), "n": r4(F.col("n"))})


@query(
    "conservation",
    _OVERLAP
    + """SELECT 'gen' AS measure, round((SELECT sum(gen) FROM s), 4) AS reported, round(sum(gen * coalesce(w, 0)), 4) AS allocated,
       round(100 * sum(gen * coalesce(w, 0)) / (SELECT sum(gen) FROM s), 4) AS pct_kept FROM w
UNION ALL SELECT 'n', round((SELECT sum(n) FROM s), 4), round(sum(n * coalesce(w, 0)), 4), round(100 * sum(n * coalesce(w, 0)) / (SELECT sum(n) FROM s), 4) FROM w""",
)
def conservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources, pieces = _allocation(spark, sf_dir)
    real = sources.select(F.col("gen").cast("double"), F.col("n").cast("double"))
    out = polygons.conservation(real, pieces, ["gen", "n"])
    return out.withColumns({c: r4(F.col(c)) for c in ("reported", "allocated", "pct_kept")})


_SIDES = f"""
WITH {_box_sql('z', 20, 'vec_id AS zona, floor(abs(e[25]) * 10000) AS pob')},
{_box_sql('s', 26, "vec_id AS fuente, CASE WHEN vec_id % 2 = 0 THEN 'c0' ELSE 'c1' END AS ciudad, CASE WHEN vec_id % 3 = 0 THEN 0 ELSE floor(abs(e[31]) * 1000) END AS gen, CASE WHEN vec_id % 3 = 0 THEN 0 ELSE floor(abs(e[32]) * 100) END AS n_gen, CASE WHEN vec_id % 5 = 0 THEN 0 ELSE floor(abs(e[33]) * 1000) END AS atr, CASE WHEN vec_id % 5 = 0 THEN 0 ELSE floor(abs(e[34]) * 100) END AS n_atr")},
o AS (SELECT z.zona, z.pob, s.* EXCLUDE (x0, x1, y0, y1), greatest(0, least(z.x1, s.x1) - greatest(z.x0, s.x0)) * greatest(0, least(z.y1, s.y1) - greatest(z.y0, s.y0)) AS area,
        (z.x1 - z.x0) * (z.y1 - z.y0) AS zarea FROM z CROSS JOIN s),
q AS (SELECT *, pob * area / zarea AS peso FROM o WHERE area > 0),
w AS (SELECT *, coalesce(peso / nullif(sum(peso) OVER (PARTITION BY fuente), 0), 0) AS w FROM q),
m AS (SELECT zona, any_value(pob) AS pob, sum(gen * w) AS gen, sum(atr * w) AS atr, sum(n_gen * w) AS n_gen, sum(n_atr * w) AS n_atr, min(ciudad) AS ciudad FROM w GROUP BY 1)
"""


@query(
    "survey_zone_mart",
    _SIDES
    + """SELECT zona, round(gen, 4) AS eod_bici_gen, round(atr, 4) AS eod_bici_atr, round(n_gen, 4) AS eod_n_gen, round(n_atr, 4) AS eod_n_atr, ciudad AS eod_ciudad,
  round(1000 * gen / nullif(pob, 0), 4) AS egen_pc, round(gen - atr, 4) AS esaldo, round(n_gen, 4) AS en, round(least(n_gen, n_atr), 4) AS en_sal FROM m""",
)
def survey_zone_mart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trip sides put onto survey zones of two cities that share zone ids, reallocated to
    census zones, merged where both cities reach, and measured."""
    from ..operators.marts import merge_city_pieces, zone_measures

    vid = F.col("vec_id")
    zones = _boxes(spark, sf_dir, 20, [vid.alias("zona"), F.floor(F.abs(component(24)) * 10000).alias("pob")])
    city = F.when(vid % 2 == 0, "c0").otherwise("c1").alias("ciudad")
    shared = F.floor(vid / 2).cast("string").alias("zona")
    shapes = _boxes(spark, sf_dir, 26, [city, shared])
    e = table(spark, sf_dir, "embeddings")

    def side(name: str, skip: int, at: int) -> DataFrame:
        trips = [F.floor(F.abs(component(at)) * 1000).alias("viajes"), F.floor(F.abs(component(at + 1)) * 100).alias("n")]
        return e.where(vid % skip != 0).select(city, F.lit(name).alias("lado"), shared, *trips)

    sums = polygons.side_sums(shapes, side("origen", 3, 30).union(side("destino", 5, 32)))
    values = ["gen", "atr", "n_gen", "n_atr"]
    pieces = polygons.interpolate(zones, sums, "zona", ["ciudad", "zona"], "pob", values, label=["ciudad"])
    merged = merge_city_pieces(pieces, "zona", values, "ciudad").join(zones.select("zona", "pob"), "zona")
    names = {"gen": "eod_bici_gen", "atr": "eod_bici_atr", "n_gen": "eod_n_gen", "n_atr": "eod_n_atr", "ciudad": "eod_ciudad"}
    out = zone_measures(merged.withColumnsRenamed(names), "eod_bici_gen", "eod_bici_atr", "eod_n_gen", "eod_n_atr", "pob")
    rounded = [*list(names.values())[:4], "egen_pc", "esaldo", "en", "en_sal"]
    return out.withColumns({c: r4(F.col(c)) for c in rounded}).drop("pob")


def _metric_sql(lon: str, lat: str) -> tuple[str, str]:
    """UTM easting and northing in SQL, from the same series."""
    c = repr(G._CONFORMAL)
    t = f"sinh(atanh(sin(radians({lat}))) - {c} * atanh({c} * sin(radians({lat}))))"
    dl = f"radians({lon} - ({G.CENTRAL_MERIDIAN}))"
    xi, eta = f"atan2({t}, cos({dl}))", f"atanh(sin({dl}) / sqrt(1 + pow({t}, 2)))"
    east = " + ".join([eta] + [f"({a!r}) * cos({2 * j} * {xi}) * sinh({2 * j} * {eta})" for j, a in enumerate(G._ALPHA, 1)])
    north = " + ".join([xi] + [f"({a!r}) * sin({2 * j} * {xi}) * cosh({2 * j} * {eta})" for j, a in enumerate(G._ALPHA, 1)])
    k = repr(G.SCALE * G._RECTIFYING)
    return f"({east}) * {k} + {G.FALSE_EAST}", f"({north}) * {k} + {G.FALSE_NORTH}"


def _projection_sql() -> str:
    cols = []
    for i in range(3):
        e, n = _metric_sql(f"lon{i}", f"lat{i}")
        cols += [f"{e} AS x{i}", f"{n} AS y{i}"]
    return f"""
WITH g AS (SELECT vec_id, -70.6 + e[1] AS lon0, -33.4 + e[2] AS lat0, -70.6 + e[3] AS lon1, -33.4 + e[4] AS lat1, -70.6 + e[5] AS lon2, -33.4 + e[6] AS lat2
           FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)),
m AS (SELECT vec_id, lon1, lat1, {', '.join(cols)} FROM g)
SELECT vec_id, round(x0, 3) AS east, round(y0, 3) AS north, round(sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)) + sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)), 3) AS length,
       round(abs((x1 - x0) * (y2 - y0) - (x2 - x0) * (y1 - y0)) / 2 / 1e6, 4) AS area_km2,
       round((x0 + x1 + x2) / 3, 2) AS cx, round((y0 + y1 + y2) / 3, 2) AS cy, round(lon1, 6) AS rep_lon, round(lat1, 6) AS rep_lat
FROM m"""


@query("projection_length", _projection_sql())
def projection_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    corners = [G.point(component(2 * i) - 70.6, component(2 * i + 1) - 33.4) for i in range(3)]
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.array(F.array(*corners)).alias("line"))
    rows = rows.withColumn("met", G.map_line(F.col("line"), G.to_metric))
    part = F.col("met")[0]
    rows = rows.withColumn(
        "poly",
        F.array(
            F.struct(
                F.concat(part, F.array(part[0])).alias("shell"),
                F.array().cast(f"array<array<{G.POINT_DDL}>>").alias("holes"),
            )
        ),
    )
    centroid = G.polygon_centroid(F.col("poly"))
    rep = G.representative_vertex(F.col("met"))
    rows = rows.select(
        "vec_id",
        part[0].alias("first"),
        G.line_length(F.col("met")).alias("length"),
        G.polygon_area(F.col("poly")).alias("area"),
        centroid.alias("c"),
        G.to_lonlat(rep["x"], rep["y"]).alias("rep"),
    )
    return rows.select(
        "vec_id",
        F.round("first.x", 3).alias("east"),
        F.round("first.y", 3).alias("north"),
        F.round("length", 3).alias("length"),
        F.round(F.col("area") / 1e6, 4).alias("area_km2"),
        F.round("c.x", 2).alias("cx"),
        F.round("c.y", 2).alias("cy"),
        F.round("rep.x", 6).alias("rep_lon"),
        F.round("rep.y", 6).alias("rep_lat"),
    )


@query(
    "key_polygon_distance",
    f"""
WITH {SEG}, c AS (SELECT label, avg(1000 * e[9]) AS cx, avg(1000 * e[10]) AS cy, [{', '.join(f'50 + 1000 * avg(abs(e[{11 + j}]))' for j in range(CORNERS))}] AS r
  FROM (SELECT label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) GROUP BY 1),
st AS (SELECT label, {_corner_sql()} FROM c),
ed AS (SELECT label, xs[j + 1] AS x1, ys[j + 1] AS y1, xs[(j + 1) % 8 + 1] AS x2, ys[(j + 1) % 8 + 1] AS y2 FROM st, (SELECT unnest(range(8)) AS j)),
d AS (SELECT p.vec_id, sqrt(min({sql_segment_segment('p', 'ed')})) AS wall, count(*) FILTER ({RAY.replace('p.x', 'p.x1').replace('p.y', 'p.y1')}) % 2 = 1 AS ins
  FROM seg p JOIN ed USING (label) GROUP BY 1)
SELECT vec_id, round(CASE WHEN ins THEN 0 ELSE wall END, 4) AS dist, CASE WHEN ins THEN FALSE ELSE wall > 500 END AS discrepa FROM d
""",
)
def key_polygon_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    shapes = _communes(spark, sf_dir)
    out = polygons.own_polygon_distance(segments(spark, sf_dir), shapes, "vec_id", "label", "geom")
    return out.select("vec_id", r4(F.col("dist")).alias("dist"), panel.conflict_flag(F.col("dist")).alias("discrepa"))


def _communes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A star around the mean place of every label."""
    own = table(spark, sf_dir, "embeddings").groupBy("label").agg(
        F.avg(component(8) * 1000).alias("cx"),
        F.avg(component(9) * 1000).alias("cy"),
        *[(F.avg(F.abs(component(10 + j))) * 1000 + 50).alias(f"r{j}") for j in range(CORNERS)],
    )
    ring = star(F.col("cx"), F.col("cy"), [F.col(f"r{j}") for j in range(CORNERS)])
    shell = F.struct(ring.alias("shell"), F.array().cast(f"array<array<{G.POINT_DDL}>>").alias("holes"))
    return own.select("label", F.array(shell).alias("geom"))


@query(
    "panel_build",
    f"""
WITH {SEG}, c AS (SELECT label, avg(1000 * e[9]) AS cx, avg(1000 * e[10]) AS cy, [{', '.join(f'50 + 1000 * avg(abs(e[{11 + j}]))' for j in range(CORNERS))}] AS r
  FROM (SELECT label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) GROUP BY 1),
st AS (SELECT label, {_corner_sql()} FROM c),
ed AS (SELECT label, xs[j + 1] AS x1, ys[j + 1] AS y1, xs[(j + 1) % 8 + 1] AS x2, ys[(j + 1) % 8 + 1] AS y2 FROM st, (SELECT unnest(range(8)) AS j)),
k AS (SELECT *, vec_id % 7 = 0 AS lost, (x1 + x2) / 2 AS x, (y1 + y2) / 2 AS y FROM seg),
d AS (SELECT p.vec_id, sqrt(min({sql_segment_segment('p', 'ed')})) AS wall, count(*) FILTER ({RAY.replace('p.x', 'p.x1').replace('p.y', 'p.y1')}) % 2 = 1 AS ins
  FROM k p JOIN ed ON ed.label = p.label AND NOT p.lost GROUP BY 1),
hit AS (SELECT vec_id, min(label) AS label FROM (SELECT p.vec_id, ed.label FROM k p JOIN ed ON {RAY} GROUP BY 1, 2 HAVING count(*) % 2 = 1) GROUP BY 1)
SELECT CASE WHEN k.vec_id % 2 = 0 THEN 'a' ELSE 'b' END AS corte, CAST(k.vec_id AS VARCHAR) AS identifica, CASE WHEN k.vec_id % 2 = 0 THEN 'diseño' END AS etapa_det,
  CASE WHEN x1 > 0 THEN 'existentes' ELSE 'diseño' END AS etapa, x1 > 0 AS existente, round(sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)), 3) AS km,
  round(sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)) / 1000, 6) AS km_geom, CASE WHEN NOT lost THEN lpad(CAST(k.label AS VARCHAR), 5, '0') END AS cut_com,
  CASE WHEN lost THEN 'sin_resolver' WHEN k.vec_id % 3 = 0 THEN 'nombre' ELSE 'declarado' END AS cut_com_origen, CASE WHEN NOT lost THEN '00' END AS cut_reg, lost AS cut_reg_declarado_discrepa,
  lpad(CAST(hit.label AS VARCHAR), 5, '0') AS cut_com_geo, round(CASE WHEN ins THEN 0 ELSE wall END, 3) AS dist_comuna_llave_m,
  coalesce(CASE WHEN ins THEN FALSE ELSE wall > 500 END, FALSE) AS cut_com_discrepa_geo
FROM k LEFT JOIN d USING (vec_id) LEFT JOIN hit USING (vec_id)
""",
)
def panel_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two snapshots that type and name their columns differently, made one panel."""
    segs = segments(spark, sf_dir).withColumn("lost", F.col("vec_id") % 7 == 0)
    mid = G.point((F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2)
    line = F.array(F.array(G.point(F.col("x1"), F.col("y1")), mid, G.point(F.col("x2"), F.col("y2"))))
    label = F.col("label").cast("string")
    known = F.when(~F.col("lost") & (F.col("vec_id") % 3 != 0), F.concat(label, F.lit(".0"))).otherwise("99")
    km = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    raw = segs.select(
        F.col("vec_id"),
        F.col("vec_id").cast("string").alias("IDENTIFICA"),
        F.when(F.col("lost"), "nowhere").otherwise(F.concat(F.lit(" Común "), label)).alias("COMUNA"),
        known.alias("CUT_COM"),
        F.lit("0").alias("CUT_REG"),
        km.alias("KM"),
        F.when(F.col("x1") > 0, " Existentes").otherwise("Diseño").alias("ETAPA"),
        line.alias("line"),
    )
    even, odd = raw.where(F.col("vec_id") % 2 == 0), raw.where(F.col("vec_id") % 2 == 1)
    first = even.withColumns({"KM": F.col("KM").cast("string"), "ETAPA_DET": F.lit("diseño")})
    second = odd.withColumn("CUT_COM", F.col("CUT_COM").cast("double"))
    communes = _communes(spark, sf_dir)
    master = communes.select(F.lpad(F.col("label").cast("string"), 5, "0").alias("cut"), F.concat(F.lit("comun "), F.col("label").cast("string")).alias("comuna"))
    shapes = communes.select(F.lpad(F.col("label").cast("string"), 5, "0").alias("cut_com"), "geom")
    parts = [panel.snapshot(first, "a", keep=["line"]), panel.snapshot(second, "b", keep=["line"])]
    out = build_panel(parts, master, shapes)
    rounded = {"km": F.round("km", 3), "km_geom": F.round("km_geom", 6), "dist_comuna_llave_m": r4(F.col("dist_comuna_llave_m"), 3)}
    return out.withColumns(rounded).select(
        "corte", "identifica", "etapa_det", "etapa", "existente", "km", "km_geom", "cut_com", "cut_com_origen", "cut_reg",
        "cut_reg_declarado_discrepa", "cut_com_geo", "dist_comuna_llave_m", "cut_com_discrepa_geo",
    )


@query(
    "density_grid",
    f"""
WITH {PT}, c AS (SELECT CAST(floor(x / 50) AS BIGINT) AS cx, CAST(floor(y / 50) AS BIGINT) AS cy, count(*) AS n FROM pt GROUP BY 1, 2)
SELECT a.cx, a.cy, any_value(a.n) AS n, CAST(any_value(a.n) + 0.5 * coalesce(sum(b.n), 0) AS DOUBLE) AS heat
FROM c a LEFT JOIN c b ON abs(a.cx - b.cx) <= 1 AND abs(a.cy - b.cy) <= 1 AND (a.cx <> b.cx OR a.cy <> b.cy) GROUP BY 1, 2
""",
)
def density_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.density(points(spark, sf_dir), "x", "y", 50, 0.5)


BELL_SIDE, BELL_RADIUS = 50, 200
_BELL = ", ".join(f"{{'d': {k - BELL_RADIUS // BELL_SIDE}, 'w': CAST({w!r} AS DOUBLE)}}" for k, w in enumerate(grids.kernel(BELL_SIDE, BELL_RADIUS)))


@query(
    "concentration_grid",
    f"""
WITH {PT}, c AS (SELECT CAST(floor(x / {BELL_SIDE}) AS BIGINT) AS cx, CAST(floor(y / {BELL_SIDE}) AS BIGINT) AS cy, count(*) AS n FROM pt GROUP BY 1, 2),
k AS (SELECT unnest([{_BELL}], recursive := true))
SELECT c.cx + a.d AS cx, c.cy + b.d AS cy, CAST(sum(CASE WHEN a.d = 0 AND b.d = 0 THEN n ELSE 0 END) AS BIGINT) AS n,
       round(sum(n * a.w * b.w), 4) AS heat FROM c CROSS JOIN k a CROSS JOIN k b GROUP BY 1, 2
""",
)
def concentration_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = grids.concentration(points(spark, sf_dir), "x", "y", BELL_SIDE, BELL_RADIUS)
    return out.withColumn("heat", r4(F.col("heat")))


@query(
    "coverage_cells",
    f"""
WITH {SEG}, b AS (SELECT CAST(floor((least(min(x1), min(x2)) - 30) / 20) AS BIGINT) AS a0, CAST(floor((greatest(max(x1), max(x2)) + 30) / 20) AS BIGINT) AS a1,
   CAST(floor((least(min(y1), min(y2)) - 30) / 20) AS BIGINT) AS b0, CAST(floor((greatest(max(y1), max(y2)) + 30) / 20) AS BIGINT) AS b1 FROM seg),
g AS (SELECT cx, unnest(range(b0, b1 + 1)) AS cy FROM (SELECT unnest(range(a0, a1 + 1)) AS cx, b0, b1 FROM b)),
d AS (SELECT cx, cy, sqrt(min({sql_point_segment('((cx + 0.5) * 20)', '((cy + 0.5) * 20)', 's')})) AS dist FROM g CROSS JOIN seg s GROUP BY 1, 2)
SELECT cx, cy, round(dist, 4) AS dist FROM d WHERE dist <= 30
""",
)
def coverage_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = grids.coverage_cells(segments(spark, sf_dir), 20, 30)
    return out.withColumn("dist", r4(F.col("dist")))


def _cross_sql(a: str, b: str, c: str, d: str) -> str:
    def side(p, q, r):
        return f"sign((x{q}-x{p})*(y{r}-y{p})-(y{q}-y{p})*(x{r}-x{p}))"

    return f"({side(a, b, c)}*{side(a, b, d)} < 0 AND {side(c, d, a)}*{side(c, d, b)} < 0)"


@query(
    "ring_validity",
    f"""
WITH q AS (SELECT vec_id, {', '.join(f'e[{24 + 2 * i + 1}] AS x{i}, e[{24 + 2 * i + 2}] AS y{i}' for i in range(4))}
  FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings))
SELECT vec_id, CAST({_cross_sql('0', '1', '2', '3')}::INT + {_cross_sql('1', '2', '3', '0')}::INT AS INTEGER) AS crossings,
       ({_cross_sql('0', '1', '2', '3')} OR {_cross_sql('1', '2', '3', '0')}) AS invalid FROM q
""",
)
def ring_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    corners = [G.point(component(24 + 2 * i), component(25 + 2 * i)) for i in range(4)]
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.array(*corners, corners[0]).alias("ring"))
    return rows.select(
        "vec_id",
        polygons.self_crossings(F.col("ring")).alias("crossings"),
        polygons.is_invalid_ring(F.col("ring")).alias("invalid"),
    )
