"""Near-duplicates by SimHash: pigeonhole blocks, joined, verified by Hamming distance.

A fingerprint of 64 bits is cut into ``b`` blocks. Two fingerprints with at most
``MAX_BITS`` = 4 differing bits agree on ``b - 4`` whole blocks at least, so all
links are found by joining on each choice of ``b - 4`` blocks. ``b`` follows the
number of different fingerprints, so that a key is long enough for chance
agreement to stay rare; every ``b`` finds the same links. Equal fingerprints are
one from the start.

A key that more than ``CROWDED`` different fingerprints share is not paired up.
Two fingerprints with at most four differing bits have a word halfway, at most two
bits from either; so every fingerprint of a crowded key is listed at the words
within two bits of it (2,081), and those listed at one word (never more than
2,081) are linked in a chain: they are close enough to each other, and
connectedness is what the result needs. The cost is linear in the group's size.

Defined cases: NULL and empty texts have fingerprint zero and are linked like any
other; fewer than ``SHINGLE`` words are one shingle; repeated rows are members of
the same component; a NULL doc_id gets a row and never names a component unless
no other id does; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..operators.components import connected_components
from ..operators.skew import attach
from ..session import settle
from .near_copies import components
from .registry import query, table

MAX_BITS = 4
SHINGLE = 4
SEED = 42
CROWDED = 64
BITS_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: str | None, size: int = SHINGLE) -> bytes:
    """Big-endian SimHash of word shingles, repeats included; A-Z lower-cased,
    words parted by ASCII blanks."""
    words = (text or "").encode().lower().split()
    if not words:
        return bytes(8)
    joined = b" ".join(words)
    if len(words) < size:
        hashes = xxhash.xxh64_digest(joined, SEED)
    else:
        ends = list(accumulate(map(len, words), lambda a, n: a + n + 1))
        starts = [0, *(e + 1 for e in ends)]
        hashes = b"".join([xxhash.xxh64_digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :])])
    rows = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    counts = np.bincount((rows + np.arange(0, 2048, 256)).ravel(), minlength=2048).reshape(8, 256)
    return np.packbits(2 * (counts @ BITS_OF_BYTE).ravel() > len(rows)).tobytes()


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``doc_id, fingerprint`` (hex) and ``f``, the same as a signed long."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [fingerprint(t.as_py(), size) for t in batch["text"]]
            yield pa.record_batch(
                {
                    "doc_id": batch["doc_id"],
                    "fingerprint": pa.array([x.hex() for x in made], pa.string()),
                    "f": pa.array(np.frombuffer(b"".join(made), ">i8").astype(np.int64)),
                }
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(of, f"doc_id {kind}, fingerprint string, f long")


def block_keys(n: int, max_bits: int = MAX_BITS) -> Column:
    """Array of the keys of ``f``: for each choice of blocks its number and bits."""
    blocks = max_bits + 1
    while blocks < 16:
        choices = list(combinations(range(blocks), blocks - max_bits))
        if len(choices) * n <= 4 << ((64 * (blocks - max_bits)) // blocks):
            break
        blocks += 1
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    masks = []
    for choice in choices:
        m = sum((1 << cuts[b + 1]) - (1 << cuts[b]) for b in choice)
        masks.append(m - (1 << 64) if m >> 63 else m)
    return F.array(
        *[F.struct(F.lit(k).alias("choice"), F.col("f").bitwiseAND(F.lit(m).cast("long")).alias("key")) for k, m in enumerate(masks)]
    )


def close_links(prints: DataFrame, n: int, max_bits: int = MAX_BITS) -> DataFrame:
    """Links ``a < b`` between the different fingerprints ``f``, whose connected
    sets are those of all links of at most ``max_bits`` bits."""
    keyed = settle(prints.select("f", F.inline(block_keys(n, max_bits))))
    on = ["choice", "key"]
    crowd = settle(keyed.groupBy(*on).count().where(F.col("count").between(2, 2**62)))
    calm = keyed.join(crowd.where(F.col("count") <= CROWDED).select(*on), on)
    other = calm.select(*on, F.col("f").alias("g"))
    pairs = (
        calm.join(other, on)
        .where((F.col("f") < F.col("g")) & (F.bit_count(F.col("f").bitwiseXOR(F.col("g"))) <= max_bits))
        .select(F.col("f").alias("a"), F.col("g").alias("b"))
    )
    dense = keyed.join(crowd.where(F.col("count") > CROWDED).select(*on), on).select("f").distinct()
    return pairs.unionByName(halfway_links(dense, max_bits)).distinct()


def halfway_links(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links through shared words at most ``max_bits / 2`` bits away."""
    spread = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = prints.repartition(spread, "f").select("f", F.col("f").alias("word"), F.lit(-1).alias("bit"))
    listed = near
    for _ in range((max_bits + 1) // 2):
        # flip one more bit, higher than the one before
        near = near.select(
            "f", "word", F.explode(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: i > F.col("bit"))).alias("bit")
        ).select("f", F.col("word").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))).alias("word"), "bit")
        listed = listed.unionByName(near)
    before = F.lag("f").over(Window.partitionBy("word").orderBy("f"))
    return listed.select(before.alias("a"), F.col("f").alias("b")).where("a IS NOT NULL")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """``doc_id, fingerprint, component_id`` per row of ``docs``."""
    rows = settle(fingerprints(docs, size))
    classes = settle(rows.groupBy("f").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    links = settle(close_links(classes.select("f"), classes.count(), max_bits))
    roots = connected_components(classes, links, "f", "a", "b", "root")
    least = classes.join(roots, "f")
    least = least.join(least.groupBy("root").agg(F.min("least").alias("component_id")), "root")
    table_ = settle(least.select("f", "component_id", "n"))
    return attach(rows, table_, ["f"], "n", rows.count()).select("doc_id", "fingerprint", "component_id")


@query("op7_simhash")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: Jaccard similarity of 0.8 or more on
    shingles of five words, through whatever links. The 4 bits of ``op7`` would miss
    most of them, see ``near_copies``. Of rows with the same id and text one stays.
    Rows are told apart by id and text: the one with the smallest id stays, a NULL id
    before others, then by a hash of the text."""
    found = components(docs, 5)
    first = F.min(F.struct("doc_id", "t"))
    keep = found.groupBy("root").agg(first.alias("k")).select(F.col("k.doc_id").alias("_id"), F.col("k.t").alias("_text"))
    same = docs["doc_id"].eqNullSafe(keep["_id"]) & F.xxhash64(docs["text"]).eqNullSafe(keep["_text"])
    once = "_text" + "_" * max(map(len, docs.columns))
    kept = docs.join(keep, same, "left_semi").withColumn(once, F.xxhash64("text"))
    return kept.dropDuplicates(["doc_id", once]).drop(once)
