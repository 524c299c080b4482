"""What queries on many rows keep, shuffle and measure."""

import numpy as np
import pyarrow as pa
import pytest

from pedalgrid.functions import geo as G
from pedalgrid.operators import nearest as N
from pedalgrid.operators import polygons as P
from pedalgrid.operators import proximity as X
from pedalgrid.operators import stacks
from pedalgrid.operators.strips import _under

from test_geometry import pieces, point_to, seg_to
from test_reach import EVERYTHING, crowd, plan, watched


def test_kth_nearest_is_bounded_by_a_leaf(spark, monkeypatch):
    monkeypatch.setattr(N, "LEAF", 16)
    kept = watched(monkeypatch)
    net, asked = crowd()
    q = pieces(spark, [(i, (x, y, x, y)) for i, (x, y) in enumerate(asked)], "q")
    # two lines an object, and one object with two lines at one place
    lines = pieces(spark, [(i // 2, s) for i, s in enumerate(net.tolist())])
    out = N.nearest_rows(q, lines, "q", "id", 3)
    # cells are not counted through a window over all that a query looks at
    assert EVERYTHING not in plan(out)
    got = {(r.q, r.rank): (r.id, r.dist) for r in out.collect()}
    for i, (x, y) in enumerate(asked):
        away = np.array([point_to(x, y, s) for s in net]).reshape(-1, 2).min(1)
        for rank, k in enumerate(np.argsort(away, kind="stable")[:3], 1):
            assert got[i, rank] == (k, pytest.approx(away[k], abs=1e-7))
    assert kept and max(kept) <= 12 * len(asked)


def test_fewer_objects_than_asked_for_are_counted(spark, monkeypatch):
    monkeypatch.setattr(N, "LEAF", 4)
    net, asked = crowd(60, 10)
    q = pieces(spark, [(i, (x, y, x, y)) for i, (x, y) in enumerate(asked)], "q")
    lines = pieces(spark, [(i % 2, s) for i, s in enumerate(net.tolist())])
    got = {(r.q, r.rank): r.dist for r in N.nearest_rows(q, lines, "q", "id", 3).collect()}
    assert len(got) == 2 * len(asked)
    for i, (x, y) in enumerate(asked):
        away = sorted(min(point_to(x, y, s) for s in net[k::2]) for k in (0, 1))
        assert [got[i, 1], got[i, 2]] == pytest.approx(away, abs=1e-7)


@pytest.mark.parametrize("parts", [1, 3])
def test_pairs_are_given_once(spark, monkeypatch, parts):
    monkeypatch.setattr(X, "PART", 6, raising=False)
    net, _ = crowd(150)
    # at one spot, crossing, touching, lying over each other, points, copies either way round
    net[:60] = net[:60] * 0.05
    net[60:70, 2:] = net[60:70, :2]
    net[70:80] = np.repeat([[0.0, 0.0, 10.0, 0.0]], 10, 0) + np.arange(10)[:, None] * [[2.5, 0, 2.5, 0]]
    net = np.vstack([net, net[:5], net[5:10][:, [2, 3, 0, 1]]])
    rows = [(i // parts, tuple(map(float, s))) for i, s in enumerate(net)]
    out = X.threshold_pairs(pieces(spark, rows), "id", 5.0, crowded=8)
    if parts == 1:
        assert "Aggregate [src" not in plan(out)
    owners = {}
    for i, s in rows:
        flat = min(s, s[2:] + s[:2])
        owners[flat] = min(i, owners.get(flat, i))
    want, shapes = {}, list(owners.items())
    for k, (a, i) in enumerate(shapes):
        for b, j in shapes[:k]:
            d = seg_to(a, b)
            if i != j and d <= 5.0:
                key = (min(i, j), max(i, j))
                want[key] = min(d, want.get(key, d))
    got = [((r.src, r.dst), r.dist) for r in out.collect()]
    assert len(got) == len(want) and dict(got) == pytest.approx(want, abs=1e-9)


def overlapping(n, seed=5):
    """Polygons over each other: concave ones, some with a hole, large and small; ids come twice."""
    rng = np.random.default_rng(seed)
    out = []
    for k in range(n):
        size = 2.0 if k % 5 == 0 else 60.0
        cx, cy = rng.normal(0, 40, 2)
        turn = np.arange(9) % 8 * np.pi / 4

        def ring(radii):
            r = np.append(radii, radii[0])
            return [(float(a), float(b)) for a, b in zip(cx + r * np.cos(turn), cy + r * np.sin(turn))]

        holes = [ring(np.full(8, size * 0.1))] if k % 3 == 0 else []
        out.append((k // 2, [(ring(rng.uniform(0.3, 1.0, 8) * size), holes)]))
    return out


def around(x, y, shape):
    odd = False
    for shell, holes in shape:
        for ring in (shell, *holes):
            for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
                if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                    odd = not odd
    return odd


@pytest.mark.parametrize("few", [1, 100_000])
def test_points_and_overlapping_polygons(spark, monkeypatch, few):
    monkeypatch.setattr(P.inside, "FEW", few)
    shapes = overlapping(60)
    xy = np.random.default_rng(6).normal(0, 40, (200, 2)).round(1)
    xy[:8] = [p for p in shapes[1][1][0][0][:8]]
    rows = [(i, float(x), float(y), None if i % 9 == 0 else i) for i, (x, y) in enumerate(xy)]
    points = spark.createDataFrame([*rows, (500, None, 1.0, 1)], "q long, x double, y double, people long")
    zones = spark.createDataFrame(shapes, f"zona long, geom {G.POLYGON_DDL}")
    want, least = {}, {}
    for i, x, y, people in rows:
        for g, shape in shapes:
            if around(x, y, shape):
                n, all_ = want.get(g, (0, 0))
                want[g] = n + 1, all_ + (people or 0)
                least[i] = min(g, least.get(i, g))
    added = P.sums_in_polygons(points.selectExpr("*", "1 AS n"), zones, "zona", "geom", ["n", "people"])
    assert {r.zona: (r.n, r.people) for r in added.collect()} == want
    nameless = zones.unionByName(zones.selectExpr("CAST(NULL AS BIGINT) AS zona", "geom"))
    got = {r.q: r.zona for r in P.first_polygon(points, nameless, "q", "zona", "geom").collect()}
    assert got == {i: least.get(i) for i in [*range(len(rows)), 500]}
    none = P.first_polygon(points, zones.where("zona < 0"), "q", "zona", "geom").collect()
    assert len(none) == len(rows) + 1 and not any(r.zona for r in none)


def test_squares_within_polygons_are_not_tested_point_by_point(monkeypatch):
    shapes = overlapping(400)
    walls = [[(*a, *b) for ring in (shell, *holes) for a, b in zip(ring, ring[1:])] for _, [(shell, holes)] in shapes]
    rows = pa.table(
        {
            "_e": pa.array([[dict(zip(("x1", "y1", "x2", "y2"), w)) for w in ws] for ws in walls]),
            **{c: pa.array([v] * len(walls)) for c, v in (("_level", 9), ("_cx", 0), ("_cy", 0))},
        }
    )
    x, y = np.random.default_rng(7).normal(0, 40, (2, 3000))
    pairs, hold = [], P.inside.Shapes.hold

    def seen(self, r, x, y):
        pairs.append(len(r) * len(x))
        return hold(self, r, x, y)

    every = P.inside.Shapes(rows, 9)
    held = every.hold(np.arange(len(walls)), x, y)
    monkeypatch.setattr(P.inside.Shapes, "hold", seen)
    monkeypatch.setattr(P.inside, "FEW", 2000)
    square = (-256.0, -256.0, 512.0)
    assert (P.inside.sums(every, x, y, square, np.ones((3000, 1), np.int64))[:, 0] == held.sum(1)).all()
    assert sum(pairs) < 0.5 * held.size
    pairs.clear()
    first = P.inside.first(every, x, y, square, np.arange(len(walls)))
    assert (first == np.where(held.any(0), held.argmax(0), np.iinfo(np.int64).max)).all()
    assert sum(pairs) < 0.2 * held.size


def test_strips_are_summed_as_pairs_are():
    rng = np.random.default_rng(8)

    def walls(n):
        x, y = rng.normal(0, 50, (2, n, 2)).round(1)
        x, y = np.concatenate([x, [[3.0, 3.0 + 1e-9]] * 3]), np.concatenate([y, [[-40.0, 40.0]] * 3])
        y[: n // 3, 1] = y[: n // 3, 0]
        lx, rx = np.minimum(x[:, 0], x[:, 1]), np.maximum(x[:, 0], x[:, 1])
        some = lx < rx
        return {"lx": lx[some], "rx": rx[some], "ly": y[some, 0], "ry": y[some, 1], "s": rng.choice([-1.0, 1.0], some.sum())}

    e, f = walls(250), walls(200)
    # a polygon's walls add up to nothing at every x, so it does not matter from where strips are measured
    e = {c: np.concatenate([v, v + (10.0 if c in ("ly", "ry") else 0.0)]) if c != "s" else np.concatenate([v, -v]) for c, v in e.items()}
    weights = np.tile(rng.uniform(0, 3, (len(e["s"]) // 2, 2)), (2, 1))
    lo, hi = -30.0, 60.0
    got = stacks.strips_under(e, f, weights, lo, hi)
    want = np.zeros(got.shape)
    for j in range(len(f["s"])):
        lx, rx = np.maximum(np.maximum(e["lx"], f["lx"][j]), lo), np.minimum(np.minimum(e["rx"], f["rx"][j]), hi)
        k = np.flatnonzero(lx < rx)
        one, other = {c: v[k] for c, v in e.items()}, {c: np.full(len(k), v[j]) for c, v in f.items()}
        want[j] = (weights[k] * _under(lx[k], rx[k], one, other, -1000.0)[0][:, None]).sum(0)
    assert got == pytest.approx(want, abs=1e-5)


def test_reallocation_does_not_measure_pairs(spark, monkeypatch):
    zones = [(i, float(i % 7), g) for i, (_, g) in enumerate(overlapping(60))]
    sources = [(i, i % 2, float(i), None if i % 5 == 0 else 1.0, g) for i, (_, g) in enumerate(overlapping(80, 9))]
    zones = spark.createDataFrame(zones, f"zone long, people double, geom {G.POLYGON_DDL}")
    sources = spark.createDataFrame(sources, f"source long, city long, trips double, n double, geom {G.POLYGON_DDL}")
    given, dealt = [], P._dealt

    def seen(a, b, *rest):
        given.append((a.count(), b.count()))
        return dealt(a, b, *rest)

    def shares(sure):
        monkeypatch.setattr(P, "SURE", sure)
        out = P.interpolate(zones, sources, "zone", "source", "people", ["trips", "n"], label=["city"])
        return {(r.zone, r.city): (r.trips, r.n) for r in out.collect()}

    monkeypatch.setattr(P, "STACK", 25)
    monkeypatch.setattr(P, "_dealt", seen)
    every = shares(1e9)
    assert given.pop(0)[1] == 80 and given.pop(0)[0] == 60
    most = shares(1.0)
    # of the sources and zones in the crowd no pair is measured
    assert given[0][1] < 40 and given[1][0] < 40
    assert most.keys() == every.keys()
    for k, v in every.items():
        assert most[k] == pytest.approx(v, rel=1e-9, abs=1e-9)
