from collections import Counter

import pytest

from pedalgrid.llm import sharding as H


def slow_table(shards, size):
    orders = []
    for s in shards:
        start, step = H.preference(s, size)
        orders.append([(start + i * step) % size for i in range(size)])
    slots = {}
    while len(slots) < size:
        for s, order in zip(shards, orders):
            if len(slots) < size:
                slots[next(x for x in order if x not in slots)] = s
    return [slots[i] for i in range(size)]


def test_table():
    shards = tuple("abcdefg")
    assert H.lookup_table(shards, 101) == slow_table(shards, 101)
    n = Counter(H.lookup_table(H.SHARDS))
    assert len(n) == len(H.SHARDS) and max(n.values()) - min(n.values()) <= 1
    old, new = H.lookup_table(H.SHARDS, 8191), H.lookup_table(H.SHARDS[:-1], 8191)
    moved = sum(a != b for a, b in zip(old, new) if a != H.SHARDS[-1])
    assert moved < 0.1 * 8191
    for bad in ((("a", "a"), 7), (("a",), 8), ((), 7)):
        with pytest.raises(ValueError):
            H.lookup_table(*bad)


def test_placement(spark, awkward, nothing):
    rows = H.place(awkward.withColumnRenamed("host", "shard").withColumnRenamed("key", "slot"), "doc_id", "text").collect()
    assert len(rows) == awkward.count()
    table = H.lookup_table(H.SHARDS)
    assert all(table[r["slot"]] == r["shard"] for r in rows)
    assert len({(r["doc_id"], r["text"]) for r in rows}) == len({(r["doc_id"], r["text"], r["slot"]) for r in rows})
    assert H.place(nothing, "doc_id").count() == 0
