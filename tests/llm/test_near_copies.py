import random

import pytest

from pedalgrid.llm import near_copies as N
from pedalgrid.llm import simhash as S

from .conftest import as_docs


def grams(text, size=5):
    w = (text or "").lower().split()
    return {tuple(w)} if len(w) < size else {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def groups(texts):
    sets, root = [grams(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("seed", [2, 64])
def test_stage_equals_brute_force(spark, seed):
    rnd = random.Random(seed)
    texts = ["", "a b c", "A  b c"]
    for g in range(12):
        base = [f"g{g}w{rnd.randrange(400)}" for _ in range(120)]
        for _ in range(6):
            t = list(base)
            for _ in range(rnd.randint(0, 4)):
                t[rnd.randrange(120)] = f"x{rnd.randrange(10**6)}"
            texts.append(" ".join(t))
    kept = {r["doc_id"] for r in S.stage(spark, as_docs(spark, texts), "").collect()}
    assert kept == set(groups(texts))


def test_rows_are_told_apart_by_id_and_text(spark):
    docs = as_docs(spark, ["one two three four five six", "red green blue white black grey"])
    rows = docs.unionByName(docs.withColumn("doc_id", docs["doc_id"] * 0 + 1)).unionByName(docs.selectExpr("CAST(NULL AS long) AS doc_id", *docs.columns[1:]))
    other = as_docs(spark, {1: "a text of its own that shares an id", 2: "red green blue white black grey"})
    kept = S.stage(spark, rows.unionByName(other), "").collect()
    assert sorted(r["text"] for r in kept) == sorted(
        ["one two three four five six", "red green blue white black grey", "a text of its own that shares an id"]
    )


def family(rnd, n, shared, own, edits):
    """Texts with a passage in common, words of their own and a few edits."""
    base = [f"b{rnd.randrange(10**6)}" for _ in range(shared)]
    for i in range(n):
        t = base + [f"o{i}x{rnd.randrange(10**6)}" for _ in range(own)]
        for _ in range(rnd.randint(0, edits)):
            t[rnd.randrange(shared)] = f"e{rnd.randrange(10**6)}"
        yield " ".join(t)


def test_large_groups_equal_brute_force(spark):
    """Groups alike in most keys but not enough to be linked, chains of edits, and one
    large group."""
    rnd = random.Random(9)
    texts = [*family(rnd, 60, 100, 22, 2), *family(rnd, 40, 100, 12, 2), *family(rnd, 120, 60, 0, 3)]
    chain = [f"c{i}" for i in range(80)]
    for i in range(40):
        chain = list(chain)
        chain[rnd.randrange(80)] = f"n{i}"
        texts.append(" ".join(chain))
    rnd.shuffle(texts)
    found = {r["doc_id"]: r["root"] for r in N.components(as_docs(spark, texts), 5).collect()}
    want = groups(texts)
    same = {}
    for i, g in enumerate(want):
        assert same.setdefault(g, found[i]) == found[i]
    assert len(set(found.values())) == len(set(want))


def test_prefix_filter_finds_all_pairs(spark):
    """Without any band: every alike pair of different components meets early."""
    rnd = random.Random(3)
    texts = sorted({*family(rnd, 40, 60, 8, 2), *family(rnd, 30, 90, 3, 6), "one two", "one two three four five"})
    docs = spark.createDataFrame(list(enumerate(texts)), "c long, text string")
    members = docs.selectExpr("c", "c AS root")
    pairs = {tuple(r) for r in N.met_early(N.prefixes(docs, members, 5)).collect()}
    sets = [grams(t) for t in texts]
    alike = {(i, j) for j in range(len(texts)) for i in range(j) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    assert alike and alike <= pairs
    assert {tuple(r) for r in N.verified(N.met_early(N.prefixes(docs, members, 5)), docs, 5).collect()} == alike
    one = members.selectExpr("c", "0L AS root")
    assert N.met_early(N.prefixes(docs, one, 5)).count() == 0
