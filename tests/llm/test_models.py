import zlib

import numpy as np
import pytest

from pedalgrid.llm import license_scan as L, quality_model as M

from .conftest import as_docs

FOLDER = "/root/testdata/sf0.01"


def test_discriminant_equals_plain_densities():
    rng = np.random.default_rng(2)
    p = len(M.NAMES)
    a, b = rng.normal(0, 1, (300, p)), rng.normal(0.5, 2, (200, p))
    m = M.Discriminant([300.0, 200.0], [a.sum(0), b.sum(0)], [a.T @ a, b.T @ b])
    x = rng.normal(0, 1, (20, p))
    pooled = (300 * np.cov(a.T, bias=True) + 200 * np.cov(b.T, bias=True)) / 500
    d = 1 / np.sqrt(np.diag(pooled))
    logs = []
    for s in (a, b):
        c = (1 - M.POOLED) * np.cov(s.T, bias=True) * np.outer(d, d) + M.POOLED * pooled * np.outer(d, d)
        c = (1 - M.ROUND) * c + M.ROUND * np.trace(c) / p * np.eye(p)
        z = (x - s.mean(0)) * d
        logs.append(-0.5 * np.einsum("ij,jk,ik->i", z, np.linalg.inv(c), z) - 0.5 * np.linalg.slogdet(c)[1])
    odds = np.clip(logs[1] - logs[0], -M.FAR, M.FAR) + np.log(200 / 300)
    assert m.score(x) == pytest.approx(1 / (1 + np.exp(-odds)))


@pytest.mark.parametrize("n", [(1, 1), (1, 40), (3, 2), (17, 17), (18, 18), (40, 40)])
def test_few_rows_of_a_class_still_make_a_discriminant(n):
    rng = np.random.default_rng(6)
    p = len(M.NAMES)
    a, b = rng.normal(0, 1, (n[0], p)), rng.normal(3, 1, (n[1], p))
    a[:, 0] = b[:, 0] = 1  # a statistic that never differs
    m = M.Discriminant([float(n[0]), float(n[1])], [a.sum(0), b.sum(0)], [a.T @ a, b.T @ b])
    x, y = rng.normal(0, 1, (30, p)), rng.normal(3, 1, (30, p))
    x[:, 0] = y[:, 0] = 1
    assert (m.score(x) < 0.5).mean() > 0.9 and (m.score(y) > 0.5).mean() > 0.9


def test_one_row_of_each_class_that_are_equal_gives_the_prior():
    p = len(M.NAMES)
    a = np.ones(p)
    m = M.Discriminant([1.0, 1.0], [a, a], [np.outer(a, a)] * 2)
    assert m.score(np.ones((1, p))) == pytest.approx(0.5)


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    rows = {r["doc_id"]: r for r in M.scored(docs, labels).collect()}
    assert len(rows) == docs.count()
    for r in rows.values():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)
    held = [(x["quality"], rows[x["doc_id"]]["predicted"]) for x in labels.collect() if rows[x["doc_id"]]["held_out"]]
    assert np.mean([a == b for a, b in held]) > 0.95


def test_awkward_texts_and_labels(spark, awkward, nothing):
    labels = spark.createDataFrame([(0, 1), (0, 0), (None, 1), (3, None), (5, 0)], "doc_id long, quality int")
    assert M.scored(awkward, labels).count() == awkward.count()
    assert M.scored(nothing, labels.limit(0)).count() == 0
    one = M.scored(awkward, labels.limit(0)).first()
    assert one["score"] == 0.5


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("aeiou" "nstrl"), 5)) for _ in range(200)] + ["under", "the", "license", "work"]
    return L.train([" ".join(rng.choice(words, 8)) for _ in range(400)])


def test_templates_are_found_and_prose_is_not(spark, model, awkward, nothing):
    texts = {i: f"some words here\n{t}. \nmore of it" for i, t in enumerate(t for f in L.FAMILIES for t in L.TEMPLATES[f])}
    families = [f for f in L.FAMILIES for _ in L.TEMPLATES[f]]
    texts |= {100: "the work under the license of nobody", 101: "a free version of the general public", 102: "license", 103: None}
    rows = {r["doc_id"]: r for r in L.scan(as_docs(spark, texts), model).collect()}
    for i, f in enumerate(families):
        assert rows[i]["licence"] == f and rows[i]["n_paragraphs"] == 1 and rows[i]["probability"] >= 0.5, texts[i]
    assert all(rows[i]["licence"] is None and rows[i]["n_paragraphs"] == 0 for i in range(100, 104))
    assert L.scan(awkward, model).count() == awkward.count() and L.scan(nothing, model).count() == 0


def test_quick_look_loses_nothing(model):
    rng = np.random.default_rng(1)
    for f in L.FAMILIES:
        for t in L.TEMPLATES[f]:
            for _ in range(20):
                w = [x for x in L.words_of(t) if rng.random() > 0.1] + ["tail"]
                found = model.judge(" ".join(w))
                assert model.scan(" ".join(w)) == ([found] if found else [])


def test_sample_is_bounded(spark, awkward, nothing):
    assert len(L.sample_lines(awkward, 3)) == 3 and L.sample_lines(nothing) == []
    assert L.train([]).judge("Released under the MIT License")[0] == "mit"
