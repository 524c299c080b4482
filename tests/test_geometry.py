"""Distributed geometry against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pedalgrid.functions import geo as G
from pedalgrid.operators import components as C, grids, nearest as N, polygons as P, proximity as X, skew

PIECE = ["x1", "y1", "x2", "y2"]


def pieces(spark, rows, lid="id"):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in rows], f"{lid} bigint, x1 double, y1 double, x2 double, y2 double")


def point_to(px, py, s):
    dx, dy = s[2] - s[0], s[3] - s[1]
    l2 = dx * dx + dy * dy
    t = 0 if l2 == 0 else min(1, max(0, ((px - s[0]) * dx + (py - s[1]) * dy) / l2))
    return math.hypot(px - s[0] - t * dx, py - s[1] - t * dy)


def seg_to(a, b):
    def side(s, x, y):
        return np.sign((s[2] - s[0]) * (y - s[1]) - (s[3] - s[1]) * (x - s[0]))

    if side(a, b[0], b[1]) * side(a, b[2], b[3]) < 0 and side(b, a[0], a[1]) * side(b, a[2], a[3]) < 0:
        return 0.0
    return min(point_to(a[0], a[1], b), point_to(a[2], a[3], b), point_to(b[0], b[1], a), point_to(b[2], b[3], a))


def network(seed, n, hot=0.4):
    """Segments of very different length; a part of them in one tiny spot."""
    rng = np.random.default_rng(seed)
    start = rng.uniform(0, 10000, (n, 2))
    k = int(n * hot)
    start[:k] = 5000 + rng.normal(0, 3, (k, 2))
    step = rng.normal(0, 1, (n, 2)) * rng.choice([0.5, 20, 3000], (n, 1), p=[0.6, 0.35, 0.05])
    return np.hstack([start, start + step])


def test_nearest_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(N, "LEAF", 4)
    net = network(1, 300)
    rng = np.random.default_rng(2)
    asked = np.vstack([rng.uniform(-20000, 30000, (60, 2)), 5000 + rng.normal(0, 5, (60, 2)), net[:10, :2]])
    q = pieces(spark, [(i, (x, y, x, y)) for i, (x, y) in enumerate(asked)], "q")
    got = {r.q: r.dist for r in N.nearest_distance(q, pieces(spark, enumerate(net.tolist())), "q").collect()}
    assert len(got) == len(asked)
    for i, (x, y) in enumerate(asked):
        assert got[i] == pytest.approx(min(point_to(x, y, s) for s in net), abs=1e-7)


def test_nearest_line_to_line_by_key(spark, monkeypatch):
    monkeypatch.setattr(N, "LEAF", 4)
    net, asked = network(3, 120), network(4, 40)
    a = pieces(spark, enumerate(net.tolist())).withColumn("k", F.col("id") % 3)
    b = pieces(spark, enumerate(asked.tolist()), "q").withColumn("k", F.col("q") % 4)
    got = {r.q: r.dist for r in N.nearest_distance(b, a, "q", by=["k"]).collect()}
    assert set(got) == {i for i in range(40) if i % 4 != 3}
    for i, d in got.items():
        assert d == pytest.approx(min(seg_to(asked[i], net[j]) for j in range(120) if j % 3 == i % 4), abs=1e-7)


def test_nearest_edge_cases(spark):
    q = pieces(spark, [(1, (0, 0, 0, 0)), (2, (100, 0, 100, 0))], "q")
    empty = pieces(spark, [(1, (0, 0, 0, 0))]).where("id > 5")
    assert N.nearest_distance(q, empty, "q").count() == 0
    same = pieces(spark, [(i, (3, 4, 3, 4)) for i in range(50)])
    assert {r.q: r.dist for r in N.nearest_distance(q, same, "q", within=50).collect()} == {1: 5.0}


def components_of(rows, tol):
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if seg_to(rows[i], rows[j]) <= tol:
                a, b = sorted((find(i), find(j)))
                label[b] = a
    return {i: find(i) for i in range(len(rows))}


def test_components_with_crowded_cells(spark):
    net = network(7, 150).tolist()
    net += net[:20] + [r[2:] + r[:2] for r in net[20:30]]  # copies, some reversed
    segs = pieces(spark, enumerate(net))
    want = components_of(net, 6)
    plain = {r.id: r.component for r in X.network_components(segs, "id", 6).collect()}
    assert plain == want
    links = X.proximity_links(segs, "id", 6, crowded=3)
    crowded = C.connected_components(segs.select("id"), links, "id", "src", "dst")
    assert {r.id: r.component for r in crowded.collect()} == want


def test_threshold_pairs(spark):
    net = network(8, 120).tolist()
    segs = pieces(spark, enumerate(net))
    got = {(r.src, r.dst): r.dist for r in X.threshold_pairs(segs, "id", 15).collect()}
    split = {(r.src, r.dst): r.dist for r in X.threshold_pairs(segs, "id", 15, crowded=3).collect()}
    assert split == pytest.approx(got)
    want = {(i, j): seg_to(net[i], net[j]) for i in range(120) for j in range(i + 1, 120)}
    want = {k: d for k, d in want.items() if d <= 15}
    assert set(got) == set(want) and all(abs(got[k] - d) < 1e-7 for k, d in want.items())


def test_long_chain(spark):
    n = 300
    order = np.random.default_rng(0).permutation(n)
    v = spark.range(n)
    e = spark.createDataFrame([(int(order[i]), int(order[i + 1])) for i in range(n - 1)], "a bigint, b bigint")
    out = C.connected_components(v, e, "id", "a", "b").select("component").distinct().collect()
    assert [r[0] for r in out] == [0]


def test_hub_links_are_kept(spark, monkeypatch):
    monkeypatch.setattr(skew, "HEAVY", 5)
    monkeypatch.setattr(skew, "MOST_HEAVY", 1000)
    e = spark.createDataFrame([(1000, i) for i in range(40)] + [(50, 51)], "a bigint, b bigint")
    v = e.select(F.col("a").alias("id")).union(e.select("b")).distinct()
    got = {r.id: r.component for r in C.connected_components(v, e, "id", "a", "b").collect()}
    assert got.pop(50) == 50 and got.pop(51) == 50 and set(got.values()) == {0}


def test_t_junction(spark):
    segs = pieces(spark, [(1, (0, 0, 100, 0)), (2, (50, 3, 50, 60)), (3, (500, 0, 600, 0))])
    groups = lambda df: df.select("component").distinct().count()
    assert groups(X.network_components(segs, "id", 5)) == 2
    assert groups(X.network_components(segs, "id", 2)) == 3
    assert groups(X.network_components(X.endpoint_pieces(segs, "id"), "id", 5)) == 3
    kinds = {(r.id, r.y): r["class"] for r in X.endpoint_classes(segs, "id", 5).collect()}
    assert kinds[(2, 3.0)] == "interior" and kinds[(2, 60.0)] == "none"


def test_sweep_is_monotone(spark, monkeypatch):
    net = network(11, 90).tolist()
    segs = pieces(spark, enumerate(net))
    tols = (1, 5, 20)
    plain = X.components_by_tolerance(segs, "id", tols)
    counts = [r.n for r in plain.groupBy("tol").agg(F.countDistinct("component").alias("n")).orderBy("tol").collect()]
    assert counts == sorted(counts, reverse=True)
    assert counts == [len(set(components_of(net, t).values())) for t in tols]
    monkeypatch.setattr(X, "CROWDED", 2)
    own = X.components_by_tolerance(segs, "id", tols)
    assert sorted(map(tuple, own.collect())) == sorted(map(tuple, plain.collect()))


def test_sweep_equals_separate_runs(spark, monkeypatch):
    """One set of links for all tolerances, from calm cells or from crowded ones, with tasks
    that pass their links on early."""
    rng = np.random.default_rng(12)
    far = network(12, 60).tolist()
    spot = (rng.uniform(0, 30, (60, 2)) @ np.array([[1, 0, 1, 0], [0, 1, 0, 1]]) + rng.uniform(-2, 2, (60, 4))).tolist()
    net = far + spot + spot[:15]
    segs = pieces(spark, enumerate(net))
    tols = (0.5, 2.5, 15)
    want = {(t, i): c for t in tols for i, c in components_of(net, t).items()}
    for crowded, held in ((256, 50_000), (5, 3)):
        monkeypatch.setattr(X, "LEAST_HELD", held)
        monkeypatch.setattr(X, "MOST_HELD", 4 * held)
        links = X.links_by_tolerance(segs, "id", tols, crowded)
        nodes = segs.select(F.explode(F.sequence(F.lit(0), F.lit(2))).alias("_k"), "id")
        got = X.components_at(nodes, links, "id", range(3), "component").collect()
        assert {(tols[r["_k"]], r["id"]): r["component"] for r in got} == want


def test_spanning_links(spark):
    rng = np.random.default_rng(4)
    rows = [(int(a), int(b), int(k)) for a, b, k in zip(*rng.integers(0, 40, (2, 400)), rng.integers(0, 4, 400))]
    links = spark.createDataFrame(rows, "src bigint, dst bigint, _k int")
    few = X.spanning_links(links.coalesce(1)).collect()
    assert len(few) < 40
    nodes = spark.range(40).select(F.explode(F.sequence(F.lit(0), F.lit(3))).alias("_k"), "id")
    less = X.spanning_links(links.repartition(5))
    a, b = (X.components_at(nodes, x, "id", range(4), "c").collect() for x in (links, less))
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def slow_nearest(asked, net, k):
    """``(qid, nid, dist)`` by comparing all, objects by their nearest pieces."""
    out = {}
    for q, a in asked:
        for n, b in net:
            out[q, n] = min(out.get((q, n), np.inf), seg_to(a, b))
    rows = []
    for q in sorted({q for q, _ in asked}):
        rows += [(q, n, d) for d, n in sorted((d, n) for (p, n), d in out.items() if p == q)[:k]]
    return rows


def test_nearest_rows(spark, monkeypatch):
    monkeypatch.setattr(N, "LEAF", 8)
    rng = np.random.default_rng(21)
    net = [(int(rng.integers(0, 90)), r) for r in network(21, 260).tolist()]
    net += [(500 + i, net[0][1]) for i in range(6)] + [(700 + i, net[3][1][2:] + net[3][1][:2]) for i in range(3)]
    points = rng.uniform(-100, 1100, (40, 2))
    asked = [(i, [x, y, x, y]) for i, (x, y) in enumerate(points.tolist())]
    asked += [(100 + i, asked[0][1]) for i in range(30)] + [(i % 4 + 200, r) for i, r in enumerate(network(22, 12).tolist())]
    mid = net[0][1]
    asked.append((300, [(mid[0] + mid[2]) / 2, (mid[1] + mid[3]) / 2 + 1e-3] * 2))
    q, n = pieces(spark, asked).withColumnRenamed("id", "q"), pieces(spark, net)
    for k in (1, 3):
        got = sorted(N.nearest_rows(q, n, "q", "id", k).collect(), key=lambda r: (r["q"], r["rank"]))
        want = slow_nearest(asked, net, k)
        assert [r["q"] for r in got] == [w[0] for w in want]
        assert np.allclose([r["dist"] for r in got], [w[2] for w in want], atol=1e-7)
        # ids may only differ between objects that are equally far but for rounding
        dist = {(a, b): d for a, b, d in slow_nearest(asked, net, len(net))}
        assert all(abs(dist[r["q"], r["id"]] - w[2]) < 1e-7 for r, w in zip(got, want))
        assert [r["id"] for r in got if r["q"] < 130] == [w[1] for w in want if w[0] < 130]
    keyed = N.nearest_rows(q.withColumn("g", F.col("q") % 3), n.withColumn("g", F.col("id") % 3), "q", "id", 2, by=["g"], within=200.0)
    want = [r for g in range(3) for r in slow_nearest([a for a in asked if a[0] % 3 == g], [b for b in net if b[0] % 3 == g], 2)]
    want = sorted((a, round(d, 6)) for a, _, d in want if d <= 200)
    assert sorted((r["q"], round(r["dist"], 6)) for r in keyed.collect()) == want
    assert N.nearest_rows(q, n.limit(0), "q", "id", 2).count() == 0


def test_component_across_communes(spark):
    rows = [("a", 1), ("b", 1), ("c", 1), ("a", 2)]
    segs = spark.createDataFrame([(c, k, 1.0) for c, k in rows], "cut_com string, component int, km double")
    assert X.components_touching(segs, segs.select("cut_com")).first()[0] == 2
    assert X.commune_fragmentation(segs).agg(F.sum("n_components")).first()[0] == 4
    s = {r.component: r for r in X.component_summary(segs).collect()}
    assert s[1].n_communes == 3 and s[1].main_commune == "a"


def ring(points):
    pts = [*points, points[0]]
    return "array(" + ",".join(f"named_struct('x',{x!r}D,'y',{y!r}D)" for x, y in pts) + ")"


def polygon_table(spark, shapes, gid="gid"):
    """``shapes``: id -> list of (shell, [holes])."""
    rows = []
    for i, parts in shapes.items():
        structs = [
            f"named_struct('shell', {ring(s)}, 'holes', "
            + (f"array({','.join(map(ring, h))})" if h else f"cast(array() as array<array<{G.POINT_DDL}>>)")
            + ")"
            for s, h in parts
        ]
        rows.append(f"SELECT {i}L AS {gid}, array({','.join(structs)}) AS geom")
    return spark.sql(" UNION ALL ".join(rows))


def inside(x, y, parts):
    hit = False
    for s, holes in parts:
        for r in [s, *holes]:
            for (ax, ay), (bx, by) in zip(r, r[1:] + r[:1]):
                if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                    hit = not hit
    return hit


def blob(rng, cx, cy, size, n):
    a = np.sort(rng.uniform(0, 2 * math.pi, n))
    r = size * rng.uniform(0.2, 1, n)
    return [(float(cx + q * math.cos(t)), float(cy + q * math.sin(t))) for q, t in zip(r, a)]


def test_points_in_polygons(spark):
    rng = np.random.default_rng(21)
    shapes = {i: [(blob(rng, *rng.uniform(0, 100, 2), float(rng.choice([2, 15, 120])), 14), [])] for i in range(12)}
    shapes[99] = [([(0, 0), (40, 0), (40, 40), (0, 40)], [[(10, 10), (10, 30), (30, 30), (30, 10)]])]
    shapes = {k: [([(float(x), float(y)) for x, y in s], [[(float(x), float(y)) for x, y in h] for h in hs]) for s, hs in v] for k, v in shapes.items()}
    xy = rng.uniform(-20, 130, (400, 2))
    pts = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "id int, x double, y double")
    polys = polygon_table(spark, shapes)
    got = {(r.id, r.gid) for r in P.points_in_polygons(pts, polys, "gid", "geom").collect()}
    assert got == {(i, g) for i, (x, y) in enumerate(xy) for g, parts in shapes.items() if inside(x, y, parts)}
    first = {r.id: r.gid for r in P.first_polygon(pts, polys, "id", "gid", "geom").collect()}
    assert len(first) == 400
    assert all(first[i] == min((g for j, g in got if j == i), default=None) for i in range(400))


@pytest.mark.parametrize("leaf_rows,most", [(1, 10_000), (1, 20)])
def test_points_meet_polygons_of_all_sizes_in_one_leaf(spark, monkeypatch, leaf_rows, most):
    """Sizes over many powers of two, crowded, nested, on both sides of zero."""
    monkeypatch.setattr(P, "LEAF_ROWS", leaf_rows)
    rng = np.random.default_rng(22)
    sizes = [0.05, 0.3, 2, 15, 120, 900]
    shapes = {i: [(blob(rng, *rng.normal(0, 30, 2), float(rng.choice(sizes)), 9), [])] for i in range(40)}
    shapes |= {100 + i: [(blob(rng, *rng.uniform(4, 5, 2), 0.2, 6), [])] for i in range(25)}
    shapes[999] = [([(-400.0, -400.0), (400.0, -400.0), (400.0, 400.0), (-400.0, 400.0)], [[(4.0, 4.0), (4.0, 4.5), (4.5, 4.5), (4.5, 4.0)]])]
    xy = np.concatenate([rng.normal(0, 60, (150, 2)), rng.uniform(4, 5, (150, 2)), [[5000.0, 5000.0]]])
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(xy)] + [(900, None, 1.0), (901, 1.0, None)]
    pts = spark.createDataFrame(rows, "id int, x double, y double")
    polys = polygon_table(spark, shapes)
    got = [(r.id, r.gid) for r in P.points_in_polygons(pts, polys, "gid", "geom", most_leaves=most).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(i, g) for i, (x, y) in enumerate(xy) for g, parts in shapes.items() if inside(x, y, parts)}
    leaves, _ = P._leaves(P.settle(P._index(polys, "gid", "geom", [])), most)
    assert leaves.count() <= most
    levels = sorted(r[0] for r in leaves.select("_l").distinct().collect())
    assert leaf_rows > 1 or most < 10_000 or len(levels) > 4
    placed = P._in_leaves(pts, leaves, levels, P._cell(F.col("x"), F.col("_l")), P._cell(F.col("y"), F.col("_l")))
    assert placed.groupBy("id").count().where("count > 1").isEmpty()
    assert P.points_in_polygons(pts, polys.limit(0), "gid", "geom").isEmpty()


def test_overlay_of_concave_shapes(spark):
    """Common area against a fine grid of sample points."""
    rng = np.random.default_rng(5)
    a = {1: [(blob(rng, 50, 50, 60, 11), [])], 2: [(blob(rng, 20, 80, 30, 9), [])]}
    hole = [(40.0, 40.0), (60.0, 40.0), (60.0, 60.0), (40.0, 60.0)]
    b = {7: [([(10.0, 10.0), (90.0, 10.0), (90.0, 90.0), (10.0, 90.0)], [hole])], 8: [(blob(rng, 60, 40, 50, 13), [])]}
    left, right = polygon_table(spark, a, "l"), polygon_table(spark, b, "r").withColumnRenamed("geom", "rgeom")
    got = {(x.l, x.r): x.area for x in P.overlay_area(left, right, "l", "r", "geom", "rgeom").collect()}
    step = 1.0
    grid = [(x, y) for x in np.arange(-20.03, 130, step) for y in np.arange(-20.07, 130, step)]
    ins = {("l", k): np.array([inside(x, y, v) for x, y in grid]) for k, v in a.items()}
    ins |= {("r", k): np.array([inside(x, y, v) for x, y in grid]) for k, v in b.items()}
    for i in a:
        for j in b:
            want = (ins[("l", i)] & ins[("r", j)]).sum() * step * step
            assert got.get((i, j), 0.0) == pytest.approx(want, abs=max(25.0, want * 0.03))
    # a shape with itself is its own area
    own = P.overlay_area(left, left.select(F.col("l").alias("r"), F.col("geom").alias("rgeom")), "l", "r", "geom", "rgeom").where("l = r")
    areas = {r.l: r.a for r in left.select("l", G.polygon_area(F.col("geom")).alias("a")).collect()}
    for r in own.collect():
        assert r.area == pytest.approx(areas[r.l], rel=1e-9)


def square(x, y, s=1.0):
    return [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]


def test_two_grids_interpolation(spark):
    zones = polygon_table(spark, {1: [(square(0.0, 0.0, 0.5), [])], 2: [(square(0.5, 0.5, 0.5), [])], 3: [(square(5.0, 5.0), [])]}, "zona").withColumn(
        "pob", F.expr("CASE zona WHEN 1 THEN 300 WHEN 2 THEN 100 ELSE 50 END")
    )
    sources = polygon_table(spark, {9: [(square(0.0, 0.0), [])]}, "fuente").withColumns({"gen": F.lit(80.0), "ciudad": F.lit("A 2010")})
    out = {r.zona: r.gen for r in P.interpolate(zones, sources, "zona", "fuente", "pob", ["gen"], label=["ciudad"]).collect()}
    assert out == {1: pytest.approx(60.0), 2: pytest.approx(20.0)}
    row = P.conservation(sources.select("gen"), spark.createDataFrame([(60.0,), (20.0,)], "gen double"), ["gen"]).first()
    assert row.pct_kept == pytest.approx(100.0)


def test_own_polygon_distance(spark):
    polys = polygon_table(spark, {1: [(square(0.0, 0.0, 10.0), [])], 2: [(square(100.0, 0.0, 10.0), [])]}, "k")
    objs = pieces(spark, [(1, (5, 5, 6, 6)), (2, (5, 5, 6, 6)), (3, (20, 5, 30, 5)), (4, (-5, 5, 15, 5)), (5, (0, 0, 1, 1))])
    objs = objs.withColumn("k", F.expr("CASE id WHEN 2 THEN 2 WHEN 5 THEN 9 ELSE 1 END").cast("bigint"))
    got = {r.id: r.dist for r in P.own_polygon_distance(objs, polys, "id", "k", "geom").collect()}
    assert got == {1: 0.0, 2: 94.0, 3: 10.0, 4: 0.0, 5: None}


def test_ring_validity(spark):
    bow = ring([(0.0, 0.0), (1.0, 1.0), (1.0, 0.0), (0.0, 1.0)])
    ok = ring(square(0.0, 0.0))
    r = spark.sql(f"SELECT {bow} AS a, {ok} AS b, slice({ok}, 1, 4) AS c").select(
        *[P.is_invalid_ring(F.col(c)) for c in "abc"]
    ).first()
    assert list(r) == [True, False, True]


def test_grids(spark):
    segs = pieces(spark, [(1, (0, 0, 100, 0)), (2, (0, 0, 100, 0))])
    cells = grids.coverage_cells(segs, 10, 12).collect()
    want = {(i, j) for i in range(-5, 16) for j in range(-5, 5) if point_to(i * 10 + 5, j * 10 + 5, (0, 0, 100, 0)) <= 12}
    assert {(r.cx, r.cy) for r in cells} == want
    pts = spark.createDataFrame([(1.0, 1.0)] * 4 + [(11.0, 1.0), (95.0, 95.0)], "x double, y double")
    heat = {(r.cx, r.cy): (r.n, r.heat) for r in grids.density(pts, "x", "y", 10, 0.5).collect()}
    assert heat == {(0, 0): (4, 4.5), (1, 0): (1, 3.0), (9, 9): (1, 1.0)}
    assert grids.total_bounds(segs).first().max_x == 100.0


def _box(x0, y0, x1, y1):
    at = ", ".join(f"named_struct('x',{x!r}D,'y',{y!r}D)" for x, y in [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)])
    return f"array(named_struct('shell', array({at}), 'holes', cast(array() as array<array<{G.POINT_DDL}>>)))"


def test_neighbours_share_no_area_in_any_unit(spark):
    for k in (1e-5, 1.0, 1e6):
        a = spark.sql(f"SELECT 1 AS l, {_box(0.1 * k, 0.3 * k, 1.7 * k, 1.1 * k)} AS geom")
        b = spark.sql(f"SELECT 1 AS r, {_box(1.7 * k, 0.2 * k, 2.9 * k, 1.3 * k)} AS rgeom UNION ALL SELECT 2, {_box(1.6 * k, 0.2 * k, 2.9 * k, 1.3 * k)}")
        got = {x.r: x.area for x in P.overlay_area(a, b, "l", "r", "geom", "rgeom").collect()}
        assert set(got) == {2} and abs(got[2] / (0.08 * k * k) - 1) < 1e-9


def test_small_polygons_do_not_meet_in_a_large_one(spark):
    cells = " UNION ALL ".join(f"SELECT {10 * i + j} AS l, {_box(i, j, i + 1, j + 1)} AS geom" for i in range(10) for j in range(10))
    small = spark.sql(cells)
    large = spark.sql(f"SELECT -1 AS r, {_box(-50, -50, 60, 60)} AS rgeom").union(small)
    out = {(x.l, x.r): x.area for x in P.overlay_area(small, large, "l", "r", "geom", "rgeom").collect()}
    assert set(out) == {(i, -1) for i in range(100)} | {(i, i) for i in range(100)}
    assert all(abs(v - 1) < 1e-9 for v in out.values())


def test_cities_may_share_zone_ids(spark):
    zones = spark.sql(f"SELECT 'c1' AS z, 100 AS pob, {_box(0, 0, 1, 1)} AS geom UNION ALL SELECT 'c2', 100, {_box(1, 0, 2, 1)} UNION ALL SELECT 'c3', 50, {_box(2, 0, 3, 1)}")
    shapes = spark.sql(f"SELECT 'A' AS ciudad, '1' AS zona, {_box(0, 0, 1, 1)} AS geom UNION ALL SELECT 'B', '1', {_box(1, 0, 3, 1)} UNION ALL SELECT 'C', '9', {_box(0, 0, 9, 9)}")
    sides = spark.createDataFrame(
        [("A", 2010, "origen", "1", 10.0, 2), ("B", 2010, "origen", "1", 30.0, 3), ("B", 2010, "destino", "1", 60.0, 6), ("C", 2010, "origen", "7", 5.0, 1)],
        "ciudad string, anio int, lado string, zona string, viajes double, n int",
    )
    sums = P.side_sums(shapes, sides)
    assert {(r.ciudad, r.gen, r.atr, r.n_gen, r.n_atr) for r in sums.collect()} == {("A", 10.0, 0.0, 2.0, 0.0), ("B", 30.0, 60.0, 3.0, 6.0)}
    out = P.interpolate(zones, sums, "z", ["ciudad", "zona"], "pob", ["gen", "atr", "n_gen"], label=["ciudad"]).collect()
    got = {(r.z, r.ciudad): (round(r.gen, 9), round(r.atr, 9), round(r.n_gen, 9)) for r in out}
    assert got == {("c1", "A"): (10, 0, 2), ("c2", "B"): (20, 40, 2), ("c3", "B"): (10, 20, 1)}


def test_ends_of_lines_of_several_pieces(spark):
    # line 1 bends at (10, 0); line 2 ends at that bend, line 3 ends where line 1 ends
    lines = spark.sql(
        "SELECT id, array(transform(v, p -> named_struct('x', cast(p[0] AS double), 'y', cast(p[1] AS double)))) AS line FROM VALUES"
        " (1, array(array(0,0),array(10,0),array(20,0))), (2, array(array(10,0.5),array(10,50))), (3, array(array(20,0.5),array(60,80))) AS t(id, v)"
    )
    ends = X.line_ends(lines, "id", "line")
    assert ends.count() == 6
    pieces = lines.select("id", F.explode(G.line_pieces(F.col("line"))).alias("_p")).select("id", "_p.*")
    got = {(r.id, r.x, r.y): r["class"] for r in X.endpoint_classes(pieces, "id", 1.0, ends).collect()}
    assert got == {(1, 0.0, 0.0): "none", (1, 20.0, 0.0): "endpoint", (2, 10.0, 0.5): "interior", (2, 10.0, 50.0): "none", (3, 20.0, 0.5): "endpoint", (3, 60.0, 80.0): "none"}
    assert X.endpoint_pieces(pieces, "id", ends).count() == 6


def test_long_rings_and_pairs_grow_with_their_walls(spark):
    n = 1200
    ring = [(math.cos(2 * math.pi * i / n) * (1 + 0.1 * (i % 2)), math.sin(2 * math.pi * i / n) * (1 + 0.1 * (i % 2))) for i in range(n)]
    twisted = list(ring)
    twisted[700], twisted[702] = twisted[702], twisted[700]
    rows = [(1, [*ring, ring[0]]), (2, [*twisted, twisted[0]])]
    rings = spark.createDataFrame(rows, "id int, ring array<struct<x:double,y:double>>")
    assert [r.id for r in P.crossed_rings(rings, "id", "ring").collect()] == [2]

    shape = rings.where("id = 1").selectExpr(f"id AS l", f"array(named_struct('shell', ring, 'holes', cast(array() as array<array<{G.POINT_DDL}>>))) AS geom")
    own = shape.selectExpr("l AS r", "geom AS rgeom")
    area = abs(sum(a[0] * b[1] - a[1] * b[0] for a, b in zip(ring, ring[1:] + ring[:1]))) / 2
    got = P.overlay_area(shape, own, "l", "r", "geom", "rgeom").first()
    assert got.area == pytest.approx(area, rel=1e-9)


def test_sites_and_components(spark):
    segs = pieces(spark, [(1, (0, 0, 100, 0)), (2, (100, 1, 130, 1)), (7, (500, 0, 600, 0)), (8, (0, 50, 20, 50))])
    named = segs.withColumn("id", F.concat(F.lit("l"), "id"))
    parts = X.network_components(named, "id", 5)
    sites = pieces(spark, [(1, (50, 20, 50, 20)), (2, (540, 9, 540, 9)), (3, (9, 41, 9, 41)), (4, (115, 1, 115, 1))], "site")
    got = {r["site"]: tuple(r)[1:] for r in X.site_components(sites, named, parts, "site", "id").collect()}
    assert got[1] == ("l1", 20.0, True, 20.0) and got[4] == ("l1", 0.0, True, 0.0) and got[3] == ("l8", 9.0, False, 41.0)
    assert got[2][:3] == ("l7", 9.0, False) and got[2][3] == pytest.approx(math.hypot(410, 8))
    none = X.site_components(sites, named.limit(0), parts, "site", "id")
    assert none.count() == 0 and none.columns == ["site", "component", "dist", "on_largest", "dist_largest"]


def test_every_id_is_at_home_in_one_cell(spark, monkeypatch):
    """Whatever is cut or shared, the cells of every level count each id once."""
    monkeypatch.setattr(N, "LEAF", 4)
    net = network(9, 60).tolist()
    rows = [(i % 50, r) for i, r in enumerate(net)] + [(100, net[0]), (101, net[0])]
    _, tables, _ = N._build(pieces(spark, rows), [], "id", 3)
    assert len(tables) > 2
    assert {t.agg(F.sum("_home")).first()[0] for t in tables} == {52}


def test_overlay_writes_no_pairs(spark, monkeypatch):
    """100 boxes over 100 others: what is written grows with the boxes, in blocks of 40."""
    written, settle = [], P.settle

    def counted(df, wide=False):
        out = settle(df, wide)
        written.append(out.count())
        return out

    monkeypatch.setattr(P, "settle", counted)
    monkeypatch.setattr(P, "BLOCK", 40, raising=False)
    rnd = random.Random(5)
    boxes = {side: {k: (rnd.uniform(0, 9), rnd.uniform(0, 9), rnd.uniform(9, 15)) for k in range(100)} for side in "zs"}
    rows = {side: [(k, [([(x, y), (x + w, y), (x + w, y + w), (x, y + w), (x, y)], [])]) for k, (x, y, w) in at.items()] for side, at in boxes.items()}
    zones = spark.createDataFrame(rows["z"], f"zona bigint, geom {G.POLYGON_DDL}").withColumn("pob", F.col("zona") % 7)
    sources = spark.createDataFrame(rows["s"], f"fuente bigint, geom {G.POLYGON_DDL}").withColumns({"gen": F.col("fuente") % 5, "ciudad": F.col("fuente") % 2})

    def common(a, b):
        (x, y, w), (u, v, s) = a, b
        return max(0, min(x + w, u + s) - max(x, u)) * max(0, min(y + w, v + s) - max(y, v))

    want = {(z, s): common(a, b) for z, a in boxes["z"].items() for s, b in boxes["s"].items() if common(a, b) > 0}
    out = P.overlay_area(zones.select("zona", "geom"), sources.select("fuente", F.col("geom").alias("sgeom")), "zona", "fuente", "geom", "sgeom")
    assert {(r.zona, r.fuente): r.area for r in out.collect()} == pytest.approx(want)
    share = {(z, s): z % 7 * area / boxes["z"][z][2] ** 2 for (z, s), area in want.items()}
    whole = {s: sum(v for (_, o), v in share.items() if o == s) for s in boxes["s"]}
    given = {}
    for (z, s), v in share.items():
        given[z, s % 2] = given.get((z, s % 2), 0) + s % 5 * v / whole[s]
    got = P.interpolate(zones, sources, "zona", "fuente", "pob", ["gen"], label=["ciudad"])
    assert {(r.zona, r.ciudad): r.gen for r in got.collect()} == pytest.approx(given)
    assert max(written) < 10 * 200 < len(want)


def test_cells_of_few_bytes_are_dealt_out(spark):
    """Pairs of many small cells are looked for in more than one task."""
    rows = spark.createDataFrame([(i, i // 4, 0, float(i), 0.0, i + 1.0, 0.0) for i in range(160)], "_rep long, _cx long, _cy long, x1 double, y1 double, x2 double, y2 double")
    tasks = X._pairs_in_cells(rows, 5.0, ["_cx", "_cy"]).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(tasks) > 1 and sum(r["count"] for r in tasks) == 40 * 6
    points = spark.createDataFrame([(i, i + 0.5, 0.5) for i in range(160)], "q long, x double, y double")
    shapes = [(i, [([(i, 0.0), (i + 1.0, 0.0), (i + 1.0, 1.0), (i + 0.0, 1.0), (i + 0.0, 0.0)], [])]) for i in map(float, range(160))]
    zones = spark.createDataFrame(shapes, f"zona double, geom {G.POLYGON_DDL}")
    met = P.points_in_polygons(points, zones, "zona", "geom").groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(met) > 1 and sum(r["count"] for r in met) == 160
