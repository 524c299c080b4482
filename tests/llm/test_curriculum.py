from hashlib import md5
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from pedalgrid.llm import curriculum as C


def slow_targets(sizes):
    """Targets by sharing again and again; sources in order."""
    weights = [C.WEIGHTS[i % 3] for i in range(len(sizes))]
    total = Fraction(3, 2) * sum(sizes)
    full = set()
    while True:
        rest = total - sum(2 * sizes[i] for i in full)
        over = sum(w for i, w in enumerate(weights) if i not in full)
        new = {i for i, w in enumerate(weights) if i not in full and w * rest / over > 2 * sizes[i]}
        if not new:
            return [Fraction(2 * sizes[i]) if i in full else weights[i] * rest / over for i in range(len(sizes))]
        full |= new


def slow_mix(rows):
    """``(doc_id, source, taken)`` of ``(doc_id, source, text)`` rows."""
    size = {r: len((r[2] or "").encode().split()) for r in rows}
    names = sorted({r[1] for r in rows}, key=lambda s: (s is None, (s or "").encode()))
    totals = [sum(size[r] for r in rows if r[1] == s) for s in names]
    out = []
    for source, total, target in zip(names, totals, slow_targets(totals)):
        quota, at = int(target + Fraction(1, 2)), 0

        def key(r):
            return md5(":".join(str(x) for x in (r[0], r[2]) if x is not None).encode()).hexdigest()[:15], r[0] or -1, size[r]

        for r in sorted((r for r in rows if r[1] == source), key=key):
            taken = sum(max(0, min(size[r], quota - at - k * total)) for k in (0, 1))
            out.append((r[0], source, size[r], total, float(target), taken))
            at += size[r]
    return sorted(out, key=repr)


def corpus():
    rows = [(i, f"s{i * i % 11}", "w " * (i * 7919 % 50)) for i in range(400)]
    rows += [(1000 + i, "s1", "one two\tthree\n") for i in range(300)]
    rows += [(2000 + i, None, "x" * i + " y") for i in range(20)] + [(3000, "Z", None), (None, "é", "b c"), (None, "s2", "")]
    rows += [(5, "s3", "copy " * 9)] * 40 + [(None, "s3", "nobody " * 3)] * 70 + [(9000, "", "a b"), (9001, "empty", "  ")]
    return rows


NAMES = ["doc_id", "source", "size", "source_size", "target", "taken"]


@pytest.mark.parametrize("per_bin", [5, 100_000])
def test_mix_by_brute_force(spark, per_bin):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    # columns named like the results and the inner ones
    docs = docs.withColumns({c: F.lit("x") for c in ("size", "target", "copies", "_s", "_at", "_n")}).repartition(5)
    mix = C.curriculum(docs, per_bin=per_bin)
    got = sorted((tuple(r) for r in mix.select(*NAMES).collect()), key=repr)
    want = slow_mix(rows)
    assert [g[:4] + g[5:] for g in got] == [w[:4] + w[5:] for w in want]
    assert all(g[4] == pytest.approx(w[4], rel=1e-12) for g, w in zip(got, want))
    again = C.curriculum(docs.repartition(3), per_bin=7).select(*NAMES)
    assert sorted(map(tuple, again.collect()), key=repr) == got
    assert all(r["taken"] <= 2 * r["size"] for r in mix.collect())
    sums = mix.groupBy("source").agg(F.sum("taken").alias("n"), F.first("target").alias("t")).collect()
    assert all(abs(r["n"] - r["t"]) <= 0.5 for r in sums)


def test_positions_follow_the_schedule(spark):
    docs = spark.range(6000).selectExpr("id AS doc_id", "concat('s', id % 3) AS source", "repeat('w ', 1 + id % 5) AS text")
    copies = C.training_order(C.curriculum(docs)).collect()
    assert all(a["position"] <= b["position"] for a, b in zip(copies, copies[1:]))
    for k, schedule in enumerate(C.SCHEDULES):
        mine = [r for r in copies if r["source"] == f"s{k}"]
        whole = sum(r["words"] for r in mine)
        for t in (0.25, 0.5, 0.75):
            first, mid, last = schedule
            area = (first + mid) / 4 + (mid + last) / 4
            x = min(t, 0.5)
            want = first * x + (mid - first) * x * x
            if t > 0.5:
                y = t - 0.5
                want += mid * y + (last - mid) * y * y
            assert sum(r["words"] for r in mine if r["position"] < t) == pytest.approx(whole * want / area, abs=0.01 * whole)
        assert 0 <= mine[0]["position"] and mine[-1]["position"] <= 1


def test_position_ends(spark):
    parts = spark.createDataFrame([(0.0,), (0.5,), (1.0,)], "p double")
    for schedule in (*C.SCHEDULES, (0.0, 1.0), (1.0, 0.0), (0.0, 0.0, 1.0)):
        got = [r[0] for r in parts.select(C.position(F.col("p"), schedule)).collect()]
        assert got[0] == (0 if schedule[1] or schedule[0] else 0.5) and got[2] == pytest.approx(1)
        assert got[0] <= got[1] <= got[2]
    for bad in ((1.0,), (-1.0, 2.0), (0.0, 0.0)):
        with pytest.raises(ValueError):
            C.position(F.lit(0.5), bad)


def test_awkward(spark, awkward, nothing):
    assert C.curriculum(nothing).count() == 0
    assert C.training_order(C.curriculum(nothing)).count() == 0
    blank = awkward.withColumn("text", F.lit("  "))
    assert [(r["size"], r["target"], r["taken"]) for r in C.curriculum(blank).collect()] == [(0, 0.0, 0)] * blank.count()
    got = C.curriculum(awkward)
    assert got.count() == awkward.count()
    assert got.agg(F.sum("taken")).first()[0] == pytest.approx(1.5 * got.agg(F.sum("size")).first()[0], abs=1)
