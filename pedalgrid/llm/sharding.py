"""Shard placement by a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a table of prime size:
start and step from two hashes of its name, so that each order visits all slots. The
shards take turns, each claiming its next free slot, until the table is full; shards
thus hold equal numbers of slots within one, and adding or losing a shard moves few
slots that need not move. A row's slot is its hashed key modulo the table size. The
table has ``SLOTS`` rows whatever the input's size, so it is broadcast, and a row is
placed with one lookup and no shuffle.

Defined cases: the key is doc_id and text together, so rows that share one doc_id or
have none still spread; a NULL part is a value of its own; equal rows go to one shard;
an empty table gives no rows; columns named like the results are replaced.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .registry import query, table

SLOTS = 65_537  # prime
SHARDS = tuple(f"shard-{i:03d}" for i in range(96))


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def preference(name: str, size: int) -> tuple[int, int]:
    """First slot and step of a shard's order of preference."""
    h = hashlib.sha256(name.encode()).digest()
    return int.from_bytes(h[:8], "big") % size, int.from_bytes(h[8:16], "big") % (size - 1) + 1


def lookup_table(shards: tuple[str, ...], size: int = SLOTS) -> list[str]:
    """The shard of each slot."""
    if not is_prime(size) or not 0 < len(set(shards)) == len(shards) <= size:
        raise ValueError("wants a prime number of slots and distinct shards, no more than slots")
    slots: list[str | None] = [None] * size
    orders = [preference(name, size) for name in shards]
    turn = [start for start, _ in orders]
    left = size
    while True:
        for k, name in enumerate(shards):
            at = turn[k]
            while slots[at] is not None:
                at = (at + orders[k][1]) % size
            slots[at] = name
            turn[k] = (at + orders[k][1]) % size
            left -= 1
            if not left:
                return slots


def slot_of(*keys: Column, size: int = SLOTS) -> Column:
    """Slot of a key: the top 60 bits of its SHA-256, modulo the table size."""
    parts = [F.coalesce(F.concat(F.length(k.cast("string")).cast("string"), F.lit(":"), k.cast("string")), F.lit("-")) for k in keys]
    return (F.conv(F.left(F.sha2(F.concat(*parts), 256), F.lit(15)), 16, 10).cast("long") % size).cast("int")


def place(rows: DataFrame, *keys: str, shards: tuple[str, ...] = SHARDS, size: int = SLOTS) -> DataFrame:
    """``rows`` with ``slot`` and ``shard``."""
    made = list(enumerate(lookup_table(shards, size)))
    slots = rows.sparkSession.createDataFrame(made, "slot int, shard string")
    placed = rows.drop("shard").withColumn("slot", slot_of(*[F.col(k) for k in keys], size=size))
    return placed.join(F.broadcast(slots), "slot")


@query("op8_shard_lookup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return place(docs, "doc_id", "text").select("doc_id", "slot", "shard")
