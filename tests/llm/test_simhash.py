import random

import pytest
import xxhash

from pedalgrid.llm import simhash as S

from .conftest import as_docs


def slow(text, size=4):
    import re

    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not w:
        return 0
    grams = [" ".join(w)] if len(w) < size else [" ".join(w[i : i + size]) for i in range(len(w) - size + 1)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(prints):
    root = {d: d for d in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


def test_fingerprint():
    for t in [None, "", "A b", "É É x Y z w", "a\tb\x0bc d  e f g", "one two three four"]:
        assert int.from_bytes(S.fingerprint(t), "big") == slow(t)


@pytest.mark.parametrize("crowded", [2, 64])
def test_components_equal_brute_force(spark, monkeypatch, crowded):
    monkeypatch.setattr(S, "CROWDED", crowded)
    rnd = random.Random(crowded)
    word = lambda: rnd.choice(["".join(rnd.choice("abc") for _ in range(3)) for _ in range(9)])
    texts = [" ".join(word() for _ in range(rnd.choice([3, 30, 60]))) for _ in range(60)]
    base = " ".join(f"w{i}" for i in range(120)).split()
    for _ in range(60):  # a dense group
        t = list(base)
        for _ in range(rnd.randint(0, 3)):
            t[rnd.randrange(120)] = word()
        texts.append(" ".join(t))
    texts += [texts[0], "", None, " "]
    rows = S.near_duplicates(as_docs(spark, texts)).collect()
    want = components({i: slow(t) for i, t in enumerate(texts)})
    assert {r["doc_id"]: r["component_id"] for r in rows} == want and len(rows) == len(texts)
    assert all(int(r["fingerprint"], 16) == slow(texts[r["doc_id"]]) for r in rows)


def test_block_choices_cover_all_links(spark):
    # whatever the number of fingerprints, four flipped bits leave a common key
    rnd = random.Random(1)
    for n in (10, 10**6, 10**9):
        a = rnd.getrandbits(63)
        b = a
        for k in rnd.sample(range(63), 4):
            b ^= 1 << k
        df = spark.createDataFrame([(a,), (b,)], "f long").selectExpr("f")
        keys = [set(map(tuple, r[0])) for r in df.select(S.block_keys(n)).collect()]
        assert keys[0] & keys[1]


def test_awkward(spark, awkward, nothing):
    rows = S.near_duplicates(awkward).collect()
    assert len(rows) == awkward.count()
    kept = S.stage(spark, awkward, "")
    assert kept.columns == awkward.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(None) == 1 and len(set(ids)) == len(ids) and 4 not in ids and 3 in ids
    assert S.stage(spark, nothing, "").count() == 0
