"""Nearest-network distance, and the nearest objects, as a descent through grid levels.

The network's straight pieces are put, by midpoint, into grid cells; a cell that
holds too many is split in sixteen, its pieces cut to the size of the new cells,
so dense cities get small cells and open country large ones. Every cell knows
the box of what it holds. A query first goes straight down, always to the child that
promises most, and measures the leaf it comes to: what it finds there bounds its
distance. Then it starts at the top again and in each round is joined, by cell, to the
children of the cells it still has to look at; a cell beyond the bound is dropped where
the join made it, so that only cells in reach are shuffled. Each round is an equi-join
with a few dozen rows per cell at most, and leaves hold at most ``LEAF`` pieces,
so neither dense cities nor far points blow up. The one exception are different lines
that lie over each other for much of their length: no cut tells them apart, so a leaf
there grows with their number (16,000 of them made leaves of about 1,000 pieces).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.geo import piece_piece_d2
from ..session import settle, spread
from .skew import attach

LEAF = 128
DEEPEST = 16
# lines lying over each other cannot be told apart by cutting: stop when cells
# are this many times shorter than the lines in them
FINEST = 16
# up to this level a table of whole levels has at most 16**4 rows
BROADCAST_LEVEL = 4
# pairs of a leaf measured at a time
STEP = 200_000

PIECE = ["x1", "y1", "x2", "y2"]
BOX = ["_lox", "_hix", "_loy", "_hiy"]


def point_pieces(df: DataFrame, x: str, y: str, keep: Sequence[str]) -> DataFrame:
    """Points as zero-length pieces."""
    return df.select(
        *keep,
        F.col(x).cast("double").alias("x1"),
        F.col(y).cast("double").alias("y1"),
        F.col(x).cast("double").alias("x2"),
        F.col(y).cast("double").alias("y2"),
    )


def _gap2(lo_a, hi_a, lo_b, hi_b) -> Column:
    gap = F.greatest(F.lit(0.0), lo_a - hi_b, lo_b - hi_a)
    return gap * gap


def _reach2(px, py, lox, hix, loy, hiy) -> Column:
    """Some piece in the box is at most this far (squared) from the point:
    every side of a tight box touches a piece."""
    midx, midy = (lox + hix) / 2, (loy + hiy) / 2
    near_x = px - F.when(px <= midx, lox).otherwise(hix)
    near_y = py - F.when(py <= midy, loy).otherwise(hiy)
    far_x = px - F.when(px >= midx, lox).otherwise(hix)
    far_y = py - F.when(py >= midy, loy).otherwise(hiy)
    return F.least(near_x * near_x + far_y * far_y, near_y * near_y + far_x * far_x)


def _wider(d2: Column, scale: Column) -> Column:
    """A squared bound with room for the rounding of coordinates of that size."""
    reach = F.sqrt(d2) * (1 + 1e-9) + scale * 1e-12
    return reach * reach


def _scale() -> Column:
    return F.greatest(*[F.abs(c) for c in (*PIECE, *[f"n{c}" for c in PIECE])])


def _d2() -> Column:
    return piece_piece_d2([F.col(c) for c in PIECE], [F.col(f"n{c}") for c in PIECE])


def _end_d2(px, py, x1, y1, x2, y2) -> np.ndarray:
    dx, dy, ax, ay = x2 - x1, y2 - y1, px - x1, py - y1
    along, len2 = ax * dx + ay * dy, dx * dx + dy * dy
    off = ax * dy - ay * dx
    beyond = (px - x2) * (px - x2) + (py - y2) * (py - y2)
    with np.errstate(divide="ignore", invalid="ignore"):
        beside = off * off / len2
    return np.where(along <= 0, ax * ax + ay * ay, np.where(along >= len2, beyond, beside))


def _side(ax, ay, bx, by, px, py) -> np.ndarray:
    return np.sign((bx - ax) * (py - ay) - (by - ay) * (px - ax))


def crossing(a: Sequence[np.ndarray], b: Sequence[np.ndarray]) -> np.ndarray:
    """Whether pieces ``a`` and ``b`` cross each other inside."""
    return (_side(*a, b[0], b[1]) * _side(*a, b[2], b[3]) < 0) & (_side(*b, a[0], a[1]) * _side(*b, a[2], a[3]) < 0)


def measured_d2(a: Sequence[np.ndarray], b: Sequence[np.ndarray]) -> np.ndarray:
    """Squared distances of pieces ``a`` and ``b`` (``x1, y1, x2, y2`` each), measured as
    ``piece_piece_d2`` does."""
    cross = crossing(a, b)
    d2 = np.zeros(cross.shape)
    a, b = ([np.broadcast_to(c, cross.shape)[~cross] for c in side] for side in (a, b))
    d2[~cross] = np.minimum(
        np.minimum(_end_d2(a[0], a[1], *b), _end_d2(a[2], a[3], *b)),
        np.minimum(_end_d2(b[0], b[1], *a), _end_d2(b[2], b[3], *a)),
    )
    return d2


def whole(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df``, of which Spark knows that these columns, which hold no nulls, cannot: with a
    branch for every null a compiled distance is longer than the JVM translates (8,000 bytes)."""
    return df.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in columns})


def _piece_gap2() -> Column:
    """Squared distance of the boxes of the two pieces, cheaper than that of the pieces."""
    gaps = [
        _gap2(F.least(f"{a}1", f"{a}2"), F.greatest(f"{a}1", f"{a}2"), F.least(f"n{a}1", f"n{a}2"), F.greatest(f"n{a}1", f"n{a}2"))
        for a in "xy"
    ]
    return gaps[0] + gaps[1]


def _cut(df: DataFrame, longest: float) -> DataFrame:
    """Pieces cut into equal parts no longer than ``longest``."""
    length = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    parts = F.greatest(F.lit(1), F.ceil(length / F.lit(float(longest))).cast("int"))
    walked = df.withColumn("_k", parts).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))

    def at(a: str, b: str, i: Column) -> Column:
        inner = F.col(a) + (F.col(b) - F.col(a)) * i / F.col("_k")
        return F.when(i == F.col("_k"), F.col(b)).otherwise(inner)

    here, there = F.col("_i"), F.col("_i") + 1
    return walked.select(
        *[c for c in df.columns if c not in (*PIECE, "_home")],
        *[F.when(here == 0, F.col(c)).otherwise(0).alias(c) for c in df.columns if c == "_home"],
        at("x1", "x2", here).alias("x1"),
        at("y1", "y2", here).alias("y1"),
        at("x1", "x2", there).alias("x2"),
        at("y1", "y2", there).alias("y2"),
    )


def _box() -> list[Column]:
    return [
        F.min(F.least("x1", "x2")).alias("_lox"),
        F.max(F.greatest("x1", "x2")).alias("_hix"),
        F.min(F.least("y1", "y2")).alias("_loy"),
        F.max(F.greatest("y1", "y2")).alias("_hiy"),
    ]


def _named_pieces(network: DataFrame, by: list[str], nid: str, k: int) -> DataFrame:
    """Distinct pieces, each with the ``k`` smallest ids that have it."""
    rows = network.select(*by, *PIECE, nid).na.drop(subset=[*PIECE, nid]).distinct()
    order = Window.partitionBy(*by, *PIECE).orderBy(nid)
    least = rows.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")
    named = least.groupBy(*by, *PIECE).agg(F.sort_array(F.collect_list(nid)).alias("_ids"))
    if k == 1:
        return named
    # every id is at home in one of its pieces, so that ids can be counted by adding
    first = least.groupBy(*by, nid).agg(F.min(F.struct(*PIECE)).alias("_p"))
    homes = first.groupBy(*by, *[F.col(f"_p.{c}").alias(c) for c in PIECE]).agg(F.count("*").alias("_home"))
    return named.join(homes, [*by, *PIECE], "left").na.fill(0, ["_home"])


def _build(network: DataFrame, by: list[str], nid: str | None = None, k: int = 1):
    """Cell tables from the top down, and the pieces of all leaf cells.

    A cell is named by a hash of its parent's name and its own place. Two cells
    sharing a name would only be looked at together, never lost. With ``nid`` pieces
    carry the ids that have them, and for ``k`` above 1 cells know how many ids are at
    home in them (``_home``).
    """
    middle = {a: (F.col(f"{a}1") + F.col(f"{a}2")) / 2 for a in "xy"}
    length = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    if nid is None:
        clean = settle(network.select(*by, *PIECE).na.drop(subset=PIECE).distinct())
    else:
        clean = settle(_named_pieces(network, by, nid, k))
    named = [] if nid is None else ["_ids"]
    homes = [] if nid is None or k == 1 else ["_home"]
    added = [F.sum(c).alias(c) for c in homes]
    box = clean.agg(
        F.min(middle["x"]).alias("x"),
        F.min(middle["y"]).alias("y"),
        F.greatest(F.max(middle["x"]) - F.min(middle["x"]), F.max(middle["y"]) - F.min(middle["y"])).alias("side"),
        F.avg(length).alias("length"),
        F.count(F.lit(1)).alias("n"),
    ).first()
    if not box.n:
        return None
    side = (box.side or 1.0) * (1 + 1e-9)
    # no level above this one can hold so many pieces in cells of LEAF
    top = min(DEEPEST, max(0, math.ceil(math.log(box.n / LEAF, 16)))) if not by else 0

    def place(axis: str, level: int) -> Column:
        return F.floor((middle[axis] - F.lit(box[axis])) / F.lit(side / 4**level)).cast("bigint")

    def child(parent: Column, x: Column, y: Column) -> Column:
        return F.xxhash64(parent, x, y)

    def lifted(axis: str, up: int) -> Column:
        return F.floor(F.col(f"_i{axis}") / F.lit(4**up)).cast("bigint")

    root = F.xxhash64(F.lit(0), *by)
    level, tables, leaves, going = top, [], [], None
    pieces = _cut(clean.withColumn("_len", length), max(side / 4**top, box.length or 0.0, 1e-12))
    pieces = pieces.withColumn("_ix", place("x", top)).withColumn("_iy", place("y", top))
    name, parent = root, root
    for up in range(top, -1, -1):
        parent, name = name, child(name, lifted("x", up), lifted("y", up))
    pieces = pieces.withColumn("_parent", parent).withColumn("_cell", name)
    while True:
        current = settle(pieces, wide=True)
        cells = settle(
            current.groupBy(*by, "_parent", "_cell")
            .agg(F.count(F.lit(1)).alias("_n"), F.avg("_len").alias("_mean"), *_box(), F.min("_ix").alias("_ix"), F.min("_iy").alias("_iy"), *added)
            .withColumn(
                "_leaf",
                (F.col("_n") <= LEAF) | F.lit(level >= DEEPEST) | (F.col("_mean") > FINEST * side / 4**level),
            )
        )
        if level == top:
            # the levels above, from the boxes of this one
            for at in range(top):
                name, parent = root, root
                for up in range(top, top - at - 1, -1):
                    parent, name = name, child(name, lifted("x", up), lifted("y", up))
                boxes = [F.min("_lox"), F.max("_hix"), F.min("_loy"), F.max("_hiy")]
                whole = cells.groupBy(*by, parent.alias("_parent"), name.alias("_cell")).agg(
                    *[b.alias(c) for b, c in zip(boxes, BOX)], F.lit(False).alias("_leaf"), *added
                )
                tables.append(F.broadcast(whole) if at <= BROADCAST_LEVEL and not by else whole)
        # a leaf goes on as its own only child, so that all rounds look alike
        here = cells.select(*by, "_parent", "_cell", "_leaf", *BOX, *homes)
        tables.append(here if going is None else here.unionByName(going))
        going = tables[-1].where("_leaf").withColumn("_parent", F.col("_cell"))
        key = [*by, "_parent", "_cell"]
        crowded = cells.where(~F.col("_leaf")).select(*key)
        if crowded.isEmpty():
            leaves.append(current)
            break
        leaves.append(current.join(cells.where("_leaf").select(*key), key, "left_semi"))
        level += 1
        pieces = _cut(current.join(crowded, key, "left_semi").drop("_parent", "_ix", "_iy"), side / 4**level)
        pieces = (
            pieces.withColumn("_ix", place("x", level))
            .withColumn("_iy", place("y", level))
            .withColumnRenamed("_cell", "_parent")
            .withColumn("_cell", child(F.col("_parent"), F.col("_ix"), F.col("_iy")))
        )
    out = None
    for part in leaves:
        part = part.select(*by, "_cell", *named, *homes, *[F.col(c).alias(f"n{c}") for c in PIECE])
        out = part if out is None else out.union(part)
    return root, tables, out


def _least2() -> Column:
    """Squared distance of the query's box and the cell's."""
    lox, hix, loy, hiy = (F.col(c) for c in BOX)
    return _gap2(F.least("x1", "x2"), F.greatest("x1", "x2"), lox, hix) + _gap2(
        F.least("y1", "y2"), F.greatest("y1", "y2"), loy, hiy
    )


def _kth_d2(at: DataFrame, leaves: DataFrame, by: list[str], row: list[str], k: int) -> DataFrame:
    """Rows of ``at`` with ``_d2``, within which ``k`` ids lie that are at home in the row's
    leaf (infinite if it has fewer), and the size ``_size`` of the coordinates met.

    Queries and pieces of a leaf are measured in arrays, so no pair is given out.
    """
    keys = [*by, "_parent"]
    schema = StructType([f for f in at.select(*row).schema] + [StructField(c, DoubleType()) for c in ("_d2", "_size")])

    def of(asked: pa.Table, pieces: pa.Table) -> pa.Table:
        q = [asked.column(c).to_numpy() for c in PIECE]
        p = [pieces.column(f"n{c}").to_numpy() for c in PIECE]
        home = pieces.column("_home").to_numpy()
        best = np.full(len(asked), np.inf)
        rows = max(1, STEP // max(1, len(home)))
        for start in range(0, len(asked) if home.sum() >= k else 0, rows):
            some = slice(start, start + rows)
            d2 = measured_d2([c[some, None] for c in q], p)
            order = np.argsort(d2, axis=1)
            held = np.cumsum(home[order], axis=1)
            kth = np.argmax(held >= k, axis=1)[:, None]
            best[some] = np.take_along_axis(d2, np.take_along_axis(order, kth, 1), 1)[:, 0]
        size = np.max(np.abs(q), axis=0)
        if len(home):
            size = np.maximum(size, np.max(np.abs(p)))
        return pa.table([*(asked.column(c) for c in row), pa.array(best), pa.array(size)], names=[*row, "_d2", "_size"])

    sides = [at.select(*row, "_parent"), leaves.where("_home > 0").withColumnRenamed("_cell", "_parent").drop("_ids")]
    dealt = [spread(df, *keys).groupBy(*keys) for df in sides]
    return dealt[0].cogroup(dealt[1]).applyInArrow(of, schema)


def _farthest2() -> Column:
    """Squared distance of the query's first end and the farthest corner of the cell's box,
    with room for rounding."""
    lox, hix, loy, hiy = (F.col(c) for c in BOX)

    def far(c: str, lo: Column, hi: Column) -> Column:
        return F.greatest(F.abs(F.col(c) - lo), F.abs(F.col(c) - hi))

    scale = F.greatest(*[F.abs(c) for c in (*PIECE, *BOX)])
    return _wider(far("x1", lox, hix) ** 2 + far("y1", loy, hiy) ** 2, scale)


def _bounded(
    front: DataFrame, tables: list, leaves: DataFrame, by: list[str], qid: str, cap: float, k: int = 1
) -> DataFrame:
    """The pieces asked for, each with a bound ``_best`` on its query's squared distance
    to the ``k``-th nearest id (``cap`` where none was found).

    Every piece goes down to one leaf and measures what lies there. In each round the
    children of its cell are reduced to one where the join made them. For ``k`` above 1
    those with ``k`` ids at home are preferred, which bound it by their farthest corner.
    """
    row = [qid, *by, *PIECE]
    lox, hix, loy, hiy = (F.col(c) for c in BOX)
    px, py = F.col("x1"), F.col("y1")
    # the nearest box; of those the query lies in the one with the nearest middle
    middle2 = (px - (lox + hix) / 2) ** 2 + (py - (loy + hiy) / 2) ** 2
    promise = _least2() + middle2 * 1e-3
    if k == 1:
        reach = _reach2(px, py, lox, hix, loy, hiy)
    else:
        enough = F.col("_home") >= k
        reach = F.when(enough, _farthest2())
        promise = promise + F.when(enough, 0.0).otherwise(1e300)
    best = F.min(F.least("_best", reach)).alias("_best")
    nearest = F.min_by("_cell", promise).alias("_parent")
    # partitioned by query once, which holds until a level is too large to broadcast
    at = spread(front.withColumn("_best", F.lit(cap)), qid)
    for round_, nodes in enumerate(tables):
        at = at.join(nodes, [*by, "_parent"]).groupBy(*row).agg(best, nearest)
        if round_ % 4 == 3 and round_ < len(tables) - 1:
            at = settle(at)
    root = F.xxhash64(F.lit(0), *by)
    if k > 1:
        at = settle(at)
        found = _kth_d2(at, leaves, by, row, k).unionByName(
            at.select(*row, F.col("_best").alias("_d2"), F.greatest(*[F.abs(c) for c in PIECE]).alias("_size"))
        )
        found = found.groupBy(*row).agg(F.min(_wider(F.col("_d2"), F.col("_size"))).alias("_d2"))
        best = F.min("_d2").over(Window.partitionBy(qid))
        return settle(found.select(*row, root.alias("_parent"), best.alias("_best")), wide=True)
    found = (
        at.join(leaves.withColumnRenamed("_cell", "_parent"), [*by, "_parent"])
        .groupBy(*row)
        .agg(F.min(F.least("_best", _d2())).alias("_d2"), F.max(_scale()).alias("_size"))
    )
    best = F.min(_wider(F.col("_d2"), F.col("_size"))).over(Window.partitionBy(qid))
    return settle(found.select(*row, root.alias("_parent"), best.alias("_best")), wide=True)


def nearest_distance(
    queries: DataFrame,
    network: DataFrame,
    qid: str,
    by: Sequence[str] = (),
    within: float | None = None,
    name: str = "dist",
) -> DataFrame:
    """``(qid, dist)``: least distance from each query to the network.

    Both sides carry pieces ``x1, y1, x2, y2``; rows sharing a ``qid`` form one
    object. With ``by`` a query only sees network rows of its own key. Queries
    with nothing in reach (empty network or key, or beyond ``within``) get no row.
    """
    by = list(by)
    built = _build(network, by)
    if built is None:
        return queries.select(qid, F.lit(None).cast("double").alias(name)).where(F.lit(False))
    root, tables, leaves = built
    cap = float("inf") if within is None else float(within) ** 2
    asked = queries.select(qid, *by, *PIECE).na.drop(subset=PIECE)
    front = _bounded(asked.withColumn("_parent", root), tables, leaves, by, qid, cap)
    for round_, nodes in enumerate(tables):
        front = front.join(nodes, [*by, "_parent"]).where(_least2() <= F.col("_best"))
        front = front.select(qid, *by, *PIECE, "_best", F.col("_cell").alias("_parent"))
        if round_ % 4 == 3 and round_ < len(tables) - 1:
            front = settle(front)

    out = (
        front.join(leaves.withColumnRenamed("_cell", "_parent"), [*by, "_parent"])
        .where(_piece_gap2() <= F.col("_best"))
        .groupBy(qid)
        .agg(F.sqrt(F.min(_d2())).alias(name))
    )
    return out if within is None else out.where(F.col(name) <= within)


def _asked_once(queries: DataFrame, qid: str, by: list[str]):
    """Queries of one piece at the same place are asked as one: the pieces to ask for,
    by ``_asked``, and the queries each of these stands for."""
    pieces = queries.select(qid, *by, *PIECE).na.drop(subset=PIECE).distinct()
    sizes = pieces.groupBy(qid).agg(F.count(F.lit(1)).alias("_n"), *[F.min(c).alias(c) for c in [*by, *PIECE]])
    sizes = settle(sizes)
    alone = sizes.where("_n = 1").drop("_n")
    places = settle(alone.groupBy(*by, *PIECE).agg(F.min(qid).alias("_asked"), F.count(F.lit(1)).alias("_n")))
    many = sizes.where("_n > 1").select(qid)
    stands = attach(alone, places, [*by, *PIECE], "_n", alone.count()).select("_asked", qid)
    stands = stands.union(many.select(F.col(qid).alias("_asked"), qid))
    objects = pieces.join(many, qid, "left_semi").withColumnRenamed(qid, "_asked")
    return places.select("_asked", *by, *PIECE).unionByName(objects), settle(stands)


def nearest_rows(
    queries: DataFrame,
    network: DataFrame,
    qid: str,
    nid: str,
    k: int = 1,
    by: Sequence[str] = (),
    within: float | None = None,
    name: str = "dist",
) -> DataFrame:
    """``(qid, nid, dist, rank)``: the ``k`` nearest objects of the network for each
    query, from rank 1; of equally far ones those with the smaller ids come first.

    As ``nearest_distance``, and rows of the network that share a ``nid`` are one object
    as well. A cell counts the objects at home in it, each of which is at home once. A query
    first goes down to one leaf and is bounded by the ``k`` objects at home there that it
    measures; where no such leaf is on its way, the ``k``-th can be no farther than the cells
    that come to ``k``, nearest first, by their farthest corners. Of objects with the same piece the ``k``
    with the smallest ids are looked at, which is all an answer can hold. Rows without
    an id are left out.
    """
    by = list(by)
    kind = network.schema[nid].dataType
    built = _build(network, by, nid, k)
    if built is None:
        none = F.lit(None)
        return queries.select(
            qid, none.cast(kind).alias(nid), none.cast("double").alias(name), none.cast("int").alias("rank")
        ).where(F.lit(False))
    root, tables, leaves = built
    cap = float("inf") if within is None else float(within) ** 2
    asked, stands = _asked_once(queries, qid, by)
    front = asked.withColumn("_parent", root)
    front = _bounded(front, tables, leaves, by, "_asked", cap, k)
    # queries that a leaf with k ids bounds need no counting on their way down again
    loose = front.where(F.col("_best") >= cap)
    counting = k > 1 and not loose.isEmpty()
    per_query = Window.partitionBy("_asked")
    same_cell = Window.partitionBy("_asked", "_cell").orderBy("_far")
    nearer = per_query.orderBy("_far").rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def reached(front: DataFrame, counted: bool) -> DataFrame:
        """The leaves in reach, by ``_parent``."""
        for round_, nodes in enumerate(tables):
            least = _least2().alias("_least")
            # what is beyond the bound is dropped before the window shuffles it
            seen = (
                front.join(nodes, [*by, "_parent"])
                .select("_asked", *by, *PIECE, "_cell", "_best", least, *([_farthest2().alias("_far"), "_home"] if counted else []))
                .where(F.col("_least") <= F.col("_best") * (1 + 1e-9))
            )
            if counted:
                # pieces of one query object count the same cell again: only the nearest counts
                seen = seen.withColumn("_own", F.when(F.row_number().over(same_cell) == 1, F.col("_home")).otherwise(0))
                seen = seen.withColumn("_held", F.sum("_own").over(nearer))
                known = F.min(F.when(F.col("_held") >= k, F.col("_far"))).over(per_query)
                seen = seen.withColumn("_best", F.least("_best", known)).where(F.col("_least") <= F.col("_best") * (1 + 1e-9))
            front = seen.select("_asked", *by, *PIECE, "_best", F.col("_cell").alias("_parent"))
            if round_ % 4 == 3 and round_ < len(tables) - 1:
                front = settle(front)
        return front

    if counting:
        front = reached(front.where(F.col("_best") < cap), False).unionByName(reached(loose, True))
    else:
        front = reached(front, False)

    ends = [f"n{c}" for c in PIECE]
    # a filter on the distance would be compiled into the join, and the distance with it
    # several times over: it is measured once, in a step of its own behind the join
    met = (
        whole(front, [*PIECE, "_best"])
        .join(whole(leaves, ends).withColumnRenamed("_cell", "_parent"), [*by, "_parent"])
        .where(_piece_gap2() <= F.col("_best"))
        .select("_asked", "_ids", "_best", _d2().alias("_d2"))
        .select("_asked", F.explode_outer(F.when(F.col("_d2") <= F.col("_best"), F.col("_ids"))).alias("_id"), "_d2")
        .where(F.col("_id").isNotNull())
        .groupBy("_asked", "_id")
        .agg(F.min("_d2").alias("_d2"))
    )
    if within is not None:
        met = met.where(F.sqrt("_d2") <= within)
    nearest = (
        met.withColumn("_r", F.row_number().over(Window.partitionBy("_asked").orderBy("_d2", "_id")))
        .where(F.col("_r") <= k)
        .groupBy("_asked")
        .agg(F.sort_array(F.collect_list(F.struct("_d2", "_id"))).alias("_near"))
    )
    sizes = stands.groupBy("_asked").agg(F.count(F.lit(1)).alias("_n"))
    return (
        attach(stands, nearest.join(sizes, "_asked"), ["_asked"], "_n", stands.count())
        .select(qid, F.posexplode("_near").alias("_r", "_o"))
        .select(qid, F.col("_o._id").alias(nid), F.sqrt("_o._d2").alias(name), (F.col("_r") + 1).alias("rank"))
    )
