import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pedalgrid.llm import quality_rules as Q

from .conftest import as_docs


def counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(w, w[1:], w[2:]))
    covered = set()
    for i in range(len(w) - 2):
        if windows[(w[i], w[i + 1], w[i + 2])] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(w)
    return (n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered),
            n < 50 or 100 * len(covered) > 50 * n)


TEXTS = [
    "a b c a b c",
    "a a a a a a",
    "one two three one two three four one two",
    "x # | y\nx # | y\n\n \nx # | y",
    "the of and " * 40,
    "no repeats here at all",
    "a b",
    "a b c d a b c x y a b c",
    "\t\x0b lead and trail \r\n",
    "日本 語   z # $",
]


def test_counts_equal_brute_force(spark, awkward):
    docs = as_docs(spark, TEXTS).unionByName(awkward)
    counted, rules = Q.judge(docs, {})
    rows = counted.select("text", rules.alias("r")).select("text", "r.*").collect()
    assert len(rows) == len(TEXTS) + 12
    for r in rows:
        assert counts(r["text"]) == tuple(r[1:6]) + (r["base_failed"],), r["text"][:60] if r["text"] else r
        assert r["kept"] == (not r["base_failed"])  # no references: no further verdict


def test_distance(spark):
    ref = [0.5, 0.25, 0.25]
    got = spark.range(1).select(Q.distance(F.array(F.lit(3), F.lit(0), F.lit(1)), ref).alias("d")).first()["d"]
    p = [0.75, 0, 0.25]
    m = [(a + b) / 2 for a, b in zip(p, ref)]
    kl = lambda x: sum(a * math.log2(a / b) for a, b in zip(x, m) if a)
    assert got == pytest.approx(math.sqrt((kl(p) + kl(ref)) / 2))


def test_odd_distributions_go_and_clean_ones_stay(spark):
    import random

    rnd = random.Random(4)
    common = Q.COMMON_WORDS["en"].split()
    prose = lambda: " ".join(rnd.choice(common) if rnd.random() < 0.4 else "".join(rnd.choice("etaoinshrdlu") for _ in range(6)) for _ in range(200)).capitalize() + "."
    texts = {i: prose() for i in range(200)}
    texts[1000] = " | ".join(prose().replace(".", " ## %% $$ ||").split())
    texts[1001] = prose().upper().replace(" ", "!! ")
    docs = as_docs(spark, texts)
    kept = {r["doc_id"] for r in Q.stage(spark, docs, "").collect()}
    assert kept == set(range(200))


def test_stage_keeps_columns(spark, awkward, nothing):
    assert Q.stage(spark, nothing, "").columns == nothing.columns
    assert Q.stage(spark, nothing, "").count() == 0
    assert Q.stage(spark, awkward, "").columns == awkward.columns
