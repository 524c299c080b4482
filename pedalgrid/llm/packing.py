"""Best-fit packing by a configuration linear program.

Documents become token ids; those longer than ``SIZE`` are cut into pieces of
``SIZE``, the first one the shorter rest. Only the histogram of lengths (at most
``SIZE`` numbers, whatever the input) reaches the driver. There the linear program
"fewest sequences, each filled by one configuration of lengths, so that every
length is covered as often as it occurs" is solved by multiplicative weights. The
weights are prices of the lengths: each round fills sequences with the configurations
of greatest worth, found by a knapsack dynamic program over the token positions, and
then raises the price of what is still uncovered when as many sequences as the bound
allows are full. Prices give that bound too: all pieces' price, divided by the worth of
the dearest configuration, is a number of sequences that no packing can go below. Rounds
end within ``GAP`` of it. The multiplicities are rounded down, what is left is packed
best fit (longest first, into the tightest room), and if best fit alone needs fewer
sequences, it is used instead. The number reached and the bound are logged.

A plan is a list of (configuration, times). Pieces of one length are numbered over
all partitions, from per-partition counts, and a piece's number says in which copy of
which configuration it stands; no group of pieces ever meets in one task.

Defined cases: NULL and empty texts are one piece, the end id alone; repeated rows are
pieces of their own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import logging
import math
import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import settle
from .registry import query, table
from .tokens import END, encoder, vocabulary_path

log = logging.getLogger(__name__)

SIZE = 1024
STEPS = 1000  # knapsacks solved before no further round begins
RATE = 0.4  # how strongly an uncovered share raises a length's price in the first round
GAP = 1e-4  # a fractional plan so near its bound is good enough
LARGE = 0.01  # how much more a token is worth in the longest piece: those are hard to place late

Plan = list[tuple[tuple[int, ...], int]]


def pieces(docs: DataFrame, path: str | None = None, size: int = SIZE) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` and ``part, seat``: the partition,
    and the number of the piece among those of its length there. Written out."""
    vocabulary = path or vocabulary_path()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        seats: Counter[int] = Counter()
        end = np.array([END], "<u4")
        for batch in batches:
            rows: list[tuple] = []
            places: list[int] = []
            for k, text in enumerate(batch["text"].to_pylist()):
                ids = np.concatenate([np.frombuffer(encode(text), np.uint16).astype("<u4"), end])
                first = len(ids) % size or size
                edges = [0, *range(first, len(ids) + 1, size)]
                for i, (a, b) in enumerate(zip(edges, edges[1:])):
                    rows.append((i, a, b - a, zlib.crc32(ids[a:b].data), seats[b - a]))
                    seats[b - a] += 1
                    places.append(k)
            piece, start, length, crc, seat = (pa.array(x, pa.int64()) for x in zip(*rows)) if rows else [pa.array([], pa.int64())] * 5
            yield pa.record_batch(
                {
                    "doc_id": batch["doc_id"].take(pa.array(places, pa.int64())),
                    "part": batch["part"].take(pa.array(places, pa.int64())),
                    "piece": piece.cast(pa.int32()),
                    "start": start,
                    "length": length,
                    "ids_crc32": crc,
                    "seat": seat,
                }
            )

    return settle(
        docs.select("doc_id", "text", F.spark_partition_id().alias("part")).mapInArrow(
            cut, f"doc_id {kind}, part int, piece int, start long, length long, ids_crc32 long, seat long"
        )
    )


def best_configuration(worth: np.ndarray, size: int) -> np.ndarray:
    """Lengths of the configuration of greatest worth; ``worth[n]`` is that of n."""
    total = np.zeros(size + 1)
    took = np.zeros(size + 1, np.int64)
    for room in range(1, size + 1):
        offers = total[room - 1 :: -1] + worth[1 : room + 1]  # take n, keep room - n
        n = int(np.argmax(offers))
        if offers[n] > total[room - 1]:
            total[room], took[room] = offers[n], n + 1
        else:
            total[room] = total[room - 1]
    chosen = []
    room = size
    while room > 0:
        if took[room]:
            chosen.append(took[room])
            room -= took[room]
        else:
            room -= 1
    return np.array(sorted(chosen, reverse=True))


def fill(counts: np.ndarray, price: np.ndarray, size: int, most: float) -> tuple[list, np.ndarray, float]:
    """Configurations of greatest worth, one after another, until every length is covered.

    Returns ``(configuration, times, worth)`` in that order, the share of each length that
    the first ``most`` sequences cover, and the worth of the first configuration, which
    no other exceeds. A length that is covered is out, so its cover never exceeds 1.
    """
    covered, early = np.zeros(size + 1), np.zeros(size + 1)
    open_ = counts > 0
    made, spent, greatest = [], 0.0, 0.0
    while open_.any():
        config = best_configuration(np.where(open_, price, 0.0), size)
        each = Counter(config.tolist())
        worth = float(price[config].sum())
        greatest = greatest or worth
        # as far as the first of its lengths is covered
        times = min((1 - covered[n]) * counts[n] / k for n, k in each.items())
        before = min(times, max(most - spent, 0.0))
        for n, k in each.items():
            covered[n] += times * k / counts[n]
            early[n] += before * k / counts[n]
            open_[n] = covered[n] < 1 - 1e-12
        spent += times
        made.append((tuple(config.tolist()), times, worth))
    return made, early, greatest


def fractional(counts: np.ndarray, size: int, steps: int = STEPS) -> tuple[list[dict], float]:
    """Fractional plans, the best one first, and a bound that no plan can go below.

    The weights are prices of the lengths. A round fills as many sequences as the bound
    allows by prices (no length beyond its count: that is the width), and every price
    grows with the share of its length that is still uncovered then. Prices are a dual
    solution once divided by the worth of the dearest configuration, so all pieces'
    price is a bound; so is the number of tokens over ``size``.
    """
    there = counts > 0
    lengths = np.arange(size + 1)
    bound = float((counts * lengths).sum()) / size
    price = np.where(there, lengths * (1 + LARGE * lengths / size), 0.0)
    plans: list[tuple[float, dict]] = []
    mean: dict[tuple[int, ...], float] = {}
    settled = np.zeros(size + 1)  # prices of all rounds, each in units of its dearest configuration
    while there.any() and steps > 0:
        made, early, greatest = fill(counts, price, size, bound)
        steps -= len(made) + 1
        settled += price / greatest
        dearest = float(settled[best_configuration(settled, size)].sum())
        bound = max(bound, float((counts * price).sum()) / greatest, float((counts * settled).sum()) / dearest)
        plan_: dict[tuple[int, ...], float] = {}
        for config, times, _ in made:
            plan_[config] = plan_.get(config, 0.0) + times
            mean[config] = mean.get(config, 0.0) + times
        plans.append((sum(plan_.values()), plan_))
        if min(p[0] for p in plans) <= bound * (1 + GAP):
            break
        # smaller steps later on, as the prices settle
        price = price * np.exp(RATE / math.sqrt(len(plans)) * (1 - np.minimum(early, 1)) * there)
    if len(plans) > 1:
        plans.append((sum(mean.values()) / len(plans), {c: t / len(plans) for c, t in mean.items()}))
    return [p for _, p in sorted(plans, key=lambda p: p[0])], bound


def best_fit(counts: np.ndarray, size: int) -> Plan:
    """Best fit, longest first, on counts: equal rooms are filled together."""
    rooms: dict[int, dict[tuple[int, ...], int]] = {}
    order: list[int] = []

    def put(config: tuple[int, ...], times: int) -> None:
        room = size - sum(config)
        if room not in rooms:
            rooms[room] = {}
            insort(order, room)
        rooms[room][config] = rooms[room].get(config, 0) + times

    for n in range(size, 0, -1):
        todo = int(counts[n])
        while todo:
            k = bisect_left(order, n)
            if k == len(order):
                fit = size // n
                if todo >= fit:
                    put((n,) * fit, todo // fit)
                if todo % fit:
                    put((n,) * (todo % fit), 1)
                break
            room = order[k]
            config, times = next(iter(rooms[room].items()))
            used = min(times, todo)
            if used == times:
                del rooms[room][config]
                if not rooms[room]:
                    del rooms[room]
                    order.pop(k)
            else:
                rooms[room][config] -= used
            put((*config, n), used)
            todo -= used
    return [(config, times) for room in order for config, times in rooms[room].items()]


def rounded(counts: np.ndarray, plan_: dict[tuple[int, ...], float], size: int) -> Plan:
    """Whole multiplicities: rounded down, what is left packed best fit."""
    left = counts.astype(np.int64).copy()
    whole: Plan = []
    for config, times in sorted(plan_.items(), key=lambda x: (-sum(x[0]), x[0])):
        each = Counter(config)
        times = min([int(times + 1e-9), *(int(left[n]) // k for n, k in each.items())])
        # smaller pieces would still fit into what a short configuration leaves free
        if times and size - sum(config) < min(np.flatnonzero(left), default=size):
            whole.append((config, times))
            for n, k in each.items():
                left[n] -= times * k
    return whole + best_fit(left, size)


def plan(counts: np.ndarray, size: int = SIZE) -> tuple[Plan, int]:
    """Configurations and how often each is used, so that every piece has one place, and
    a number of sequences that none can go below."""
    made, bound = fractional(counts.astype(np.int64), size)
    whole = [rounded(counts, p, size) for p in made]
    alone = best_fit(counts, size)
    return min([*whole, alone], key=lambda p: sum(t for _, t in p)), math.ceil(bound - 1e-6)


def seats_of(made: Plan, size: int) -> dict[int, list[np.ndarray]]:
    """Per length, ascending: first seat, sequence it is in, seats a sequence has,
    offset of the first one in its sequence."""
    table_: dict[int, list[tuple[int, int, int, int]]] = {}
    taken = np.zeros(size + 1, np.int64)
    sequence = 0
    for config, times in made:
        offset = 0
        for n, k in sorted(Counter(config).items(), reverse=True):
            table_.setdefault(n, []).append((int(taken[n]), sequence, k, offset))
            taken[n] += k * times
            offset += n * k
        sequence += times
    return {n: [np.array(c, np.int64) for c in zip(*rows)] for n, rows in table_.items()}


def pack(docs: DataFrame, path: str | None = None, size: int = SIZE) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` per piece."""
    spark = docs.sparkSession
    cut = pieces(docs, path, size)
    per_part = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = np.zeros(size + 1, np.int64)
    for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `size` rows
        counts[r["length"]] = r["n"]
    made, bound = plan(counts, size)
    log.info("%d sequences, no packing has under %d", sum(t for _, t in made), bound)
    seats = spark.sparkContext.broadcast(seats_of(made, size))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    numbered = cut.join(offsets, ["part", "length"]).withColumn("seat", F.col("seat") + F.col("_before"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, seat = (batch[c].to_numpy(zero_copy_only=False) for c in ("length", "seat"))
            sequence, offset = np.zeros(len(seat), np.int64), np.zeros(len(seat), np.int64)
            order = np.argsort(length, kind="stable")
            edges = np.flatnonzero(np.diff(length[order], prepend=-1))
            for a, b in zip(edges, [*edges[1:], len(order)]):
                rows = order[a:b]
                n = int(length[rows[0]])
                first, base, each, start = seats.value[n]
                k = np.searchsorted(first, seat[rows], "right") - 1
                nth = seat[rows] - first[k]
                sequence[rows] = base[k] + nth // each[k]
                offset[rows] = start[k] + nth % each[k] * n
            columns = [batch[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(sequence), pa.array(offset)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return numbered.select("doc_id", "piece", "start", "length", "ids_crc32", "seat").mapInArrow(
        place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )


@query("op5_packing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all documents' pieces in training sequences."""
    return pack(docs)
