"""What the descents of nearest distance and the links of cells keep and shuffle."""

import re

import numpy as np
import pytest

from pedalgrid.operators import nearest as N
from pedalgrid.operators import proximity as X

from test_geometry import pieces, point_to

# the frame of a window over all cells that a query looks at
EVERYTHING = "unboundedpreceding$(), unboundedfollowing$()"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def crowd(n=800, queries=100):
    """Long segments all over each other, as dense networks are, and points among them."""
    rng = np.random.default_rng(11)
    start = rng.normal(0, 120, (n, 2))
    return np.hstack([start, start + rng.normal(0, 25, (n, 2))]), rng.normal(0, 120, (queries, 2))


def watched(monkeypatch):
    """Rows of queries that the descents write, as they write them."""
    kept, settle = [], N.settle

    def seen(df, wide=False):
        out = settle(df, wide)
        if "_best" in df.columns:
            kept.append(out.count())
        return out

    monkeypatch.setattr(N, "settle", seen)
    return kept


def test_queries_keep_few_cells(spark, monkeypatch):
    monkeypatch.setattr(N, "LEAF", 16)
    kept = watched(monkeypatch)
    net, asked = crowd()
    q = pieces(spark, [(i, (x, y, x, y)) for i, (x, y) in enumerate(asked)], "q")
    out = N.nearest_distance(q, pieces(spark, enumerate(net.tolist())), "q")
    got = {r.q: r.dist for r in out.collect()}
    for i, (x, y) in enumerate(asked):
        assert got[i] == pytest.approx(min(point_to(x, y, s) for s in net), abs=1e-7)
    assert kept and max(kept) <= 12 * len(asked)
    # cells out of reach go where the join made them, not after a shuffle for a window
    assert EVERYTHING not in plan(out)


def test_bound_holds_far_away_and_for_objects(spark, monkeypatch):
    monkeypatch.setattr(N, "LEAF", 16)
    net, _ = crowd(400)
    net += 6_300_000
    rows = [(i % 40, (x, y, x, y)) for i, (x, y) in enumerate(net[::2, :2] + 0.5)] + [(99, (0.0, 0.0, 0.0, 0.0))]
    want = {}
    for q, (x, y, _, _) in rows:
        want[q] = min(want.get(q, np.inf), min(point_to(x, y, s) for s in net))
    q = pieces(spark, rows, "q")
    found = {r.q: r.dist for r in N.nearest_distance(q, pieces(spark, enumerate(net.tolist())), "q").collect()}
    rows = N.nearest_rows(q, pieces(spark, enumerate(net.tolist())), "q", "id").collect()
    assert set(found) == set(want) == {r.q for r in rows}
    for q, d in want.items():
        assert found[q] == pytest.approx(d, abs=1e-6)
    assert {r.q: r.dist for r in rows} == pytest.approx(want, abs=1e-6)


def test_nearest_row_keeps_few_cells(spark, monkeypatch):
    monkeypatch.setattr(N, "LEAF", 16)
    kept = watched(monkeypatch)
    net, asked = crowd()
    q = pieces(spark, [(i, (x, y, x, y)) for i, (x, y) in enumerate(asked)], "q")
    out = N.nearest_rows(q, pieces(spark, enumerate(net.tolist())), "q", "id")
    got = {r.q: r.id for r in out.collect()}
    for i, (x, y) in enumerate(asked):
        assert got[i] == min(range(len(net)), key=lambda j: (point_to(x, y, net[j]), j))
    assert kept and max(kept) <= 12 * len(asked)
    assert EVERYTHING not in plan(out)


@pytest.mark.parametrize("k", [1, 3])
def test_distances_are_compiled_short(spark, capsys, k):
    """The JVM does not translate methods of over 8,000 bytes: distances took 40 times as long."""
    net, asked = crowd(100, 10)
    q = pieces(spark, [(i, (x, y, x, y)) for i, (x, y) in enumerate(asked)], "q")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        N.nearest_rows(q, pieces(spark, enumerate(net.tolist())), "q", "id", k).explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < 8000


def test_cells_give_fewer_links_than_pieces(spark, monkeypatch):
    """A cell's pairs are measured within it; batches that end within a cell change nothing."""
    net = crowd(250)[0] / 8
    segs = pieces(spark, enumerate(net.tolist()))
    tols = [0.5, 2.0, 5.0]
    pairs = X.threshold_pairs(segs, "id", tols[-1]).collect()
    given, spanning = [], X.spanning_links

    def counted(links):
        given.append(links.count())
        return spanning(links)

    monkeypatch.setattr(X, "spanning_links", counted)
    # at the widest tolerance all cells are calm, so nothing else gives links
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {(r.tol, r.id): r.component for r in X.components_by_tolerance(segs, "id", tols).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for tol in tols:
        root = list(range(len(net)))

        def top(v):
            while root[v] != v:
                v = root[v]
            return v

        for r in pairs:
            if r.dist <= tol:
                a, b = sorted((top(r.src), top(r.dst)))
                root[b] = a
        assert [got[tol, v] for v in range(len(net))] == [top(v) for v in range(len(net))]
    # the pairs of a cell came out once for every cell that two pieces share: 7,073 links
    assert len(given) == 1 and given[0] < len(pairs)


def test_near_pieces_measure_as_columns_do(spark):
    rng = np.random.default_rng(5)
    p = rng.uniform(0, 12, (70, 4))
    p[:20] = p[:20].round()
    p[20:30, 2:] = p[20:30, :2]
    p[30:40] = p[:10, [2, 3, 0, 1]]
    both = pieces(spark, enumerate(p.tolist())).join(
        pieces(spark, enumerate(p.tolist()), "other").selectExpr("other", *[f"{c} AS n{c}" for c in N.PIECE])
    ).where("id < other")
    want = {(r.id, r.other): r.d2 for r in both.select("id", "other", N._d2().alias("d2")).collect() if r.d2 <= 4.0}
    i, j, d2 = X.near_pieces(p, 2.0)
    assert dict(zip(zip(i.tolist(), j.tolist()), d2.tolist())) == want and 0.0 in want.values()
    assert [len(c) for c in X.near_pieces(p[:1], 2.0)] == [0, 0, 0]


def test_crowded_pieces_fill_few_cells(spark, monkeypatch):
    listed, settle = [], X.settle

    def seen(df, wide=False):
        out = settle(df, wide)
        if wide and "_cx" in df.columns:
            listed.append(out.count())
        return out

    monkeypatch.setattr(X, "settle", seen)
    net, _ = crowd(600)
    # most in a quarter of the width, some alone far out
    net += np.tile(net[:, :2] * np.where(np.arange(len(net)) % 20, -0.75, 3)[:, None], 2)
    links = X.proximity_links(pieces(spark, enumerate(net.tolist())), "id", 5.0, crowded=8).collect()
    top = np.arange(len(net))
    want = X._hung(top, *X.near_pieces(net, 5.0)[:2])
    assert len(set(want)) > 1
    assert (X._hung(top, *np.array(links, int).T) == want).all()
    print(listed)
    assert len(listed) > 1 and max(listed) <= 20 * len(net)
