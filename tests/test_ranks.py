"""Distributed order statistics against brute force, on both code paths."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pedalgrid.operators import ranks as R


@pytest.fixture(params=["one slice", "many slices"])
def path(request, monkeypatch):
    if request.param == "many slices":
        monkeypatch.setattr(R, "SHORT", 0)
        for fn in (R.running_totals, R.values_at):
            d = list(fn.__defaults__)
            d[-1], d[-2] = 0, 8
            monkeypatch.setattr(fn, "__defaults__", tuple(d))
    return request.param


def frame(spark, seed=1, n=3000):
    rng = np.random.default_rng(seed)
    # a third of the rows is one value of one group
    g = np.where(rng.random(n) < 0.5, "hot", rng.choice(list("abc"), n))
    v = np.round(rng.normal(0, 50, n), 1)
    v[: n // 3] = 7.0
    g[: n // 3] = "hot"
    pdf = pd.DataFrame({"g": g, "v": v, "w": rng.integers(1, 6, n).astype(float)})
    return pdf, spark.createDataFrame(pdf).repartition(7)


def lower(v, w):
    o = np.argsort(v, kind="stable")
    c = np.cumsum(w[o])
    return v[o][np.searchsorted(c, c[-1] / 2)]


def test_weighted_lower_median(spark, path):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 1.0), (3.0, 2.0), (None, 9.0), (5.0, 0.0)], "v double, w double")
    assert R.weighted_lower_median(df, [], "v", "w").first()["median"] == 2.0
    pdf, df = frame(spark)
    got = {r.g: r["median"] for r in R.weighted_lower_median(df, ["g"], "v", "w").collect()}
    for g, d in pdf.groupby("g"):
        assert got[g] == lower(d.v.values, d.w.values)
        # integer weights equal copies of the row
        copies = np.sort(np.repeat(d.v.values, d.w.astype(int)))
        assert got[g] == copies[(len(copies) - 1) // 2]


def test_slices_are_cut_again_until_they_are_small(spark, monkeypatch):
    monkeypatch.setattr(R, "MOST_SLICES", 4)
    monkeypatch.setattr(R, "PER_SLICE", 9)
    pdf, df = frame(spark, 4, 1500)
    by, values = R._values(df, ["g"], "v", "w")
    keyed, ends = R._sliced(values, by, 8, values.count())
    sizes = keyed.groupBy("g", "_slice").agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi")).toPandas()
    assert sizes.n.max() <= 9 and sizes.n.sum() == values.count() and sizes["_slice"].max() > 5**2
    for _, d in sizes.sort_values("_slice").groupby("g"):
        assert (d.lo.values[1:] > d.hi.values[:-1]).all()
    assert ends.count() == len(sizes)
    out = R.running_totals(df, ["g"], "v", "w", 8, 0).toPandas()
    for g, d in pdf.groupby("g"):
        want = d.groupby("v").w.sum().cumsum()
        got = out[out.g == g].sort_values("v")
        assert np.array_equal(got.v, want.index) and np.array_equal(got.cumulative, want.values)
    at = {r.g: r["at"] for r in R.values_at(df, ["g"], "v", lambda t: F.array(t / 2, t / 10), "w", 8, 0).collect()}
    for g, d in pdf.groupby("g"):
        assert at[g][0] == lower(d.v.values, d.w.values)


def test_quantile_edges(spark, path):
    pdf, df = frame(spark, 2)
    probs = [0, 0.1, 0.2, 0.5, 0.8, 1]
    got = {r.g: r.edges for r in R.quantile_edges(df, ["g"], "v", probs).collect()}
    for g, d in pdf.groupby("g"):
        assert np.allclose(got[g], np.quantile(d.v.values, probs), rtol=0, atol=1e-12)


def test_tied_bins_stay_dense(spark, path):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 1, 1, 2, 3, 4, 5)] + [("b", 1.0), ("b", 2.0)], "g string, v double")
    out = R.group_quantile_bins(df, ["g"], "v")
    assert [r.bin for r in out.where("g = 'a'").orderBy("v").collect()] == [0, 0, 0, 1, 2, 3, 3]
    assert [r.bin for r in out.where("g = 'b'").collect()] == [None, None]


def test_global_bins_match_qcut(spark, path):
    v = np.random.default_rng(5).normal(size=997)
    df = spark.createDataFrame([(int(i), float(x)) for i, x in enumerate(v)], "i int, v double")
    got = [r.bin for r in R.quantile_bins(df, "v").orderBy("i").collect()]
    assert got == list(pd.qcut(v, 5, labels=False))


def test_global_bins_refuse_equal_edges(spark):
    df = spark.createDataFrame([(1.0,)] * 9 + [(2.0,)], "v double")
    with pytest.raises(Exception, match="not unique"):
        R.quantile_bins(df, "v").collect()


def test_class_breaks(spark, path):
    v = sorted(np.random.default_rng(3).normal(size=101))
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    want = [v[int(np.floor((i + 1) / 7 * 100))] for i in range(6)]
    assert R.class_breaks(df, [], "v").first().breaks == pytest.approx(want)
    a = sorted(abs(x) for x in v)
    q = a[int(np.floor(0.9 * 100))]
    assert R.diverging_breaks(df, [], "v").first().breaks == pytest.approx([-q, -q / 2, -0.15 * q, 0.15 * q, q / 2, q])
    zero = spark.createDataFrame([(0.0,), (0.0,)], "v double")
    assert R.diverging_breaks(zero, [], "v").first().breaks[-1] == 1.0
    row = df.limit(1).select(R.class_of(F.lit(5.0), F.array(F.lit(1.0), F.lit(5.0))), R.class_of(F.lit(9.0), F.array(F.lit(1.0), F.lit(5.0)), True), R.class_of(F.lit(None).cast("double"), F.array(F.lit(1.0)))).first()
    assert list(row) == [1, 0, None]


def test_spearman_with_ties(spark, path):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"g": rng.choice(["a", "b"], 600), "x": rng.integers(0, 30, 600).astype(float)})
    pdf["y"] = np.round(pdf.x + rng.normal(0, 8, 600))
    got = {r.g: r.rho for r in R.spearman(spark.createDataFrame(pdf), ["g"], "x", "y").collect()}
    for g, d in pdf.groupby("g"):
        assert got[g] == pytest.approx(d.x.rank().corr(d.y.rank()))


def test_pearson_needs_three(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 4.0), ("b", 1.0, 1.0), ("b", 2.0, 2.0), ("b", 3.0, 3.1)], "g string, x double, y double")
    got = {r.g: r.r for r in R.pearson(df, ["g"], "x", "y").collect()}
    assert got["a"] is None and got["b"] > 0.99


def test_running_totals_are_exact(spark, path):
    pdf, df = frame(spark, 4)
    out = R.running_totals(df, ["g"], "v", "w").toPandas()
    for g, d in pdf.groupby("g"):
        want = d.groupby("v").w.sum().cumsum()
        got = out[out.g == g].set_index("v").cumulative.sort_index()
        assert np.allclose(want.values, got.values)


def test_share_and_first(spark):
    df = spark.createDataFrame([("a", 2, 3.0), ("a", 1, 1.0), (None, 5, 4.0)], "k string, o int, v double")
    assert sorted(r.share for r in R.share_of_group(df, ["k"], "v").collect()) == [0.25, 0.75, 1.0]
    assert {(r.k, r.o) for r in R.first_per_key(df, ["k"], [F.col("o")]).collect()} == {("a", 1), (None, 5)}


def test_exact_halves_on_both_paths(spark, path):
    # decimal weights whose half falls on a value, in rows of any order
    import random

    rnd = random.Random(6)
    rows, want = [], {}
    for g in range(60):
        w = [rnd.randint(1, 40) for _ in range(9)]
        half = rnd.randrange(2, 8)
        last = sum(w[:half]) - sum(w[half:])
        w.append(last if last > 0 else 0)
        pairs = [(g, float(v), x / 100) for v, x in enumerate(w) if x]
        cum, total = 0, sum(w)
        want[g] = next(float(v) for v in range(10) if (cum := cum + w[v]) * 2 >= total and w[v])
        rows += rnd.sample(pairs, len(pairs))
    df = spark.createDataFrame(rows, "g int, v double, w double").repartition(5)
    got = {r.g: r["median"] for r in R.weighted_lower_median(df, ["g"], "v", "w").collect()}
    assert got == want
