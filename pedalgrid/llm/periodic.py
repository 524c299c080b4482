"""Periodic stretches of words, by maximal pairs on a bottom-up LCP-interval tree.

A run is a stretch of consecutive words with smallest period ``q``, at least
``EXPONENT`` = 4 periods and ``LEAST`` = 6 words long, that no neighbouring word extends.
Its two readings, one a period apart, are a maximal pair: equal over ``length - q``
words, with different words before them and after them. So no pair is extended: the
depth of the node at which two suffixes meet is the length they share.

Suffixes are sorted by doubling the words compared, within their text only; suffixes
that share fewer than ``SHARED`` words cannot be such a pair and drop out after the first
comparison. The tree of LCP intervals is built from its leaves on a stack. A node keeps
its suffixes by place, each of the class of its left word, and takes the smaller of two
children into the larger. A suffix meets only its neighbours by place in the other child,
if they are no farther than a third of the depth and of another class: with three periods
shared, any suffix of the node between two places shows a smaller period, so pairs of
places that are not neighbours repeat a run under a multiple of its period (the least is
kept). A group of suffixes whose nearest places are farther apart than a third of its
deepest LCP has no such pair and builds no tree.

Defined cases: NULL and blank texts have no words and no runs; rows are judged each on its
own, so repeated rows give equal results and a NULL id is kept; texts of any length are read whole; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .registry import query, table

EXPONENT = 4
LEAST = 6
# what the two readings of a run share at least: LEAST words less a period of one
SHARED = LEAST - 1
# texts are sorted together up to this many words; a longer one alone
TOGETHER = 400_000

Run = tuple[int, int, int]


class Numbers(dict):
    """A number from 1 for each word, in order of first use."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) + 1
        return n


def ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the keys, their ranks from 0 without gaps, and where in the order a
    new key begins."""
    order = np.argsort(key)
    there = key[order]
    new = np.empty(len(key), bool)
    new[:1] = True
    np.not_equal(there[1:], there[:-1], out=new[1:])
    rank = np.empty(len(key), np.int64)
    rank[order] = np.cumsum(new) - 1
    return order, rank, new


def laid_out(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers one text after the other, a 0 before each and a few at the end;
    the text of each place (the first 0 at the end is one of its own), and the place of
    each text's first word."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    first = np.cumsum(sizes + 1) - sizes
    number = Numbers().__getitem__
    words = np.zeros(int(sizes.sum()) + len(texts) + SHARED, np.int64)
    for at, text in zip(first.tolist(), texts):
        words[at : at + len(text)] = np.fromiter(map(number, text), np.int64, len(text))
    return words, np.append(np.repeat(np.arange(len(texts)), sizes + 1), len(texts)), first


def sorted_suffixes(words: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
    """Places whose next ``SHARED`` words recur in their text, sorted by their suffixes;
    the number of the group that shares these words; ranks by compared length."""
    n = len(text)
    wide = np.int64(len(words) + 1)
    _, two, _ = ranked(words[:-1] * wide + words[1:])
    _, three, _ = ranked(two[:-1] * wide + words[2:])
    order, _, new = ranked((text * wide + three[:n]) * wide + three[2 : n + 2])
    starts = np.flatnonzero(new)
    size = np.diff(np.append(starts, n))
    head = np.repeat(starts, size)
    rank = np.empty(n, np.int64)
    rank[order] = head
    levels, compared = [(SHARED, rank)], SHARED
    slots = np.flatnonzero(np.repeat(size > 1, size))
    every, group = slots, head[slots]
    while len(slots):
        at = order[slots]
        inner, _, new = ranked(rank[at] * wide + rank[at + compared])
        order[slots] = at = at[inner]
        starts = np.flatnonzero(new)
        size = np.diff(np.append(starts, len(slots)))
        rank = rank.copy()
        rank[at] = np.repeat(slots[starts], size)
        compared *= 2
        levels.append((compared, rank))
        slots = slots[np.repeat(size > 1, size)]
    return order[every], group, levels


def shared_words(a: np.ndarray, b: np.ndarray, words: np.ndarray, levels: list) -> np.ndarray:
    """How many words the suffixes at ``a`` and ``b`` of one text share."""
    a, b = a.copy(), b.copy()
    shared = np.zeros(len(a), np.int64)
    for compared, rank in reversed(levels):
        # a suffix may have reached the end of the texts, where nothing is equal
        inside = np.maximum(a, b) < len(rank)
        same = np.flatnonzero(inside)[rank[a[inside]] == rank[b[inside]]]
        a[same] += compared
        b[same] += compared
        shared[same] += compared
    going = np.arange(len(a))
    for _ in range(SHARED - 1):
        going = going[words[a[going]] == words[b[going]]]
        a[going] += 1
        b[going] += 1
        shared[going] += 1
    return shared


class Tree:
    """Maximal pairs of one group of suffixes; ``found`` has the least distance for
    each stretch, by its first place and the place after its last."""

    def __init__(self, left: list[int]):
        self.left = left
        self.found: dict[tuple[int, int], int] = {}

    def joined(self, a: list[int], b: list[int], depth: int) -> list[int]:
        """Places of two children of a node, in order; their pairs are noted."""
        if len(a) < len(b):
            a, b = b, a
        left, reach = self.left, depth // (EXPONENT - 1)
        for p in b:
            k = bisect_left(a, p)
            if k and p - a[k - 1] <= reach and left[a[k - 1]] != left[p]:
                self.note(a[k - 1], p, depth)
            if k < len(a) and a[k] - p <= reach and left[a[k]] != left[p]:
                self.note(p, a[k], depth)
        if len(b) == 1:
            insort(a, b[0])
        else:
            a += b
            a.sort()
        return a

    def note(self, i: int, j: int, depth: int) -> None:
        at = i, j + depth
        self.found[at] = min(j - i, self.found.get(at, j - i))

    def climb(self, places: list[int], shared: list[int]) -> None:
        """All nodes over the sorted suffixes of a group; ``shared[k]`` words are common
        to the suffixes k - 1 and k."""
        open_: list[list] = []
        child = places[:1]
        for p, depth in zip(places[1:], shared[1:]):
            while open_ and open_[-1][0] > depth:
                at, others = open_.pop()
                child = self.joined(others, child, at)
            if open_ and open_[-1][0] == depth:
                open_[-1][1] = self.joined(open_[-1][1], child, depth)
            else:
                open_.append([depth, child])
            child = [p]
        while open_:
            at, others = open_.pop()
            child = self.joined(others, child, at)


def runs_of(texts: list[list[bytes]]) -> list[list[Run]]:
    """``(start, length, period)`` of the runs of each text, by start and period."""
    runs: list[list[Run]] = [[] for _ in texts]
    words, text, first = laid_out(texts)
    places, group, levels = sorted_suffixes(words, text)
    if not len(places):
        return runs
    shared = np.zeros(len(places), np.int64)
    inner = np.flatnonzero(group[1:] == group[:-1]) + 1
    shared[inner] = shared_words(places[inner - 1], places[inner], words, levels)
    starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    near = np.sort(group * np.int64(len(words)) + places)
    gap = np.full(len(places), len(words), np.int64)
    gap[inner] = np.diff(near)[inner - 1]
    wanted = np.minimum.reduceat(gap, starts) * (EXPONENT - 1) <= np.maximum.reduceat(shared, starts)
    ends = np.append(starts[1:], len(places))
    # the class of a place is the word before it; before a text's first word it is 0
    left = np.append(0, words[:-1]).tolist()
    places_, shared_ = places.tolist(), shared.tolist()
    for a, b in zip(starts[wanted].tolist(), ends[wanted].tolist()):
        tree = Tree(left)
        tree.climb(places_[a:b], shared_[a:b])
        if tree.found:
            k = int(text[places_[a]])
            base = int(first[k])
            runs[k] += [(i - base, end - i, q) for (i, end), q in tree.found.items()]
    for k, found in enumerate(runs):
        if len(found) > 1:
            least: dict[tuple[int, int], int] = {}
            for start, length, q in found:
                least[start, length] = min(q, least.get((start, length), q))
            found = [(*at, q) for at, q in least.items()]
        runs[k] = sorted(found, key=lambda r: (r[0], r[2]))
    return runs


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """Each run's first period is kept, the rest of it dropped."""
    if not runs:
        return words
    kept = np.ones(len(words), bool)
    for start, length, q in runs:
        kept[start + q : start + length] = False
    return [words[i] for i in np.flatnonzero(kept).tolist()]


def plain(doc_id: object, words: list[bytes]) -> list[bytes]:
    return words


def periodic_runs(docs: DataFrame, words_of: Callable[[object, list[bytes]], list[bytes]] = plain) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` per row of ``docs``: the runs as an array of
    ``start, length, period`` and the text with each run's repeats left out, words parted
    by one blank. ``words_of`` may change a document's words before they are searched."""

    def answer(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        runs = runs_of(texts)
        flat = [r for found in runs for r in found]
        parts = [pa.array([r[k] for r in flat], pa.int64()) for k in range(3)]
        ends = np.cumsum([0, *map(len, runs)])
        return pa.record_batch(
            {
                "doc_id": pa.array(ids, id_type[0]),
                "n_words": pa.array([len(t) for t in texts], pa.int64()),
                "runs": pa.ListArray.from_arrays(
                    pa.array(ends, pa.int32()), pa.StructArray.from_arrays(parts, ["start", "length", "period"])
                ),
                "collapsed": pa.array([b" ".join(collapsed(t, r)) for t, r in zip(texts, runs)], pa.binary()),
            }
        )

    id_type: list[pa.DataType] = []

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[list[bytes]] = []
        n = 0
        for batch in batches:
            id_type[:] = [batch["doc_id"].type]
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                words = words_of(doc_id, (text.as_py() or b"").split())
                if texts and n + len(words) > TOGETHER:
                    yield answer(ids, texts)
                    ids, texts, n = [], [], 0
                ids.append(doc_id)
                texts.append(words)
                n += len(words) + 1
        if texts:
            yield answer(ids, texts)

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(
        of, f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary"
    )
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))


def greatest(runs: Column) -> Column:
    """The run of greatest length / period, compared exactly; of equal ones the first."""

    def better(best: Column, r: Column) -> Column:
        more = r["length"] * best["period"] > best["length"] * r["period"]
        return F.when(best.isNull() | more, r).otherwise(best)

    return F.aggregate(runs, F.try_element_at(runs, F.lit(1)), better)


def repeated_tail(doc_id: object, words: list[bytes]) -> list[bytes]:
    """The words as the query wants them: in a tenth of the documents a tail repeats."""
    h = crc32(b"" if doc_id is None else str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * -(-(n - a) // p))[: n - a]


@query("op11_periodic_runs")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A NULL id counts as the empty text for the choice of documents with a tail."""
    found = periodic_runs(table(spark, sf_dir, "documents"), repeated_tail)
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = F.col("best")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        greatest(F.col("runs")).alias("best"),
        F.sha2(F.array_join(line, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    ).select(
        "doc_id",
        "n_runs",
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.floor(1000 * best["length"] / best["period"]).alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )
