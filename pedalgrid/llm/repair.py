"""Token files compressed by Re-Pair, with random access to single documents.

Documents are put in ascending doc_id order, range by range, and encoded; each
range is written as blocks of about ``BLOCK_IDS`` ids. A block is a grammar and its
sequence. As in Re-Pair, frequent pairs of neighbouring symbols are replaced by a new
symbol, again and again, each round taking the most frequent pairs by exact counts and
giving out a part of the symbols that are left; a pair never spans two documents. A block
stops when no pair can be replaced twice or the symbols (16 bits) are used up.

File format, a Parquet row per block: ``shard, block`` (ranges in order, blocks in
order), ``doc_ids``, ``ends`` (where each document's symbols end), ``sizes`` (its
number of ids, the end id included), ``n_ids``, ``pairs`` (the rules, two 16-bit
symbols each, in the order they were made; symbols from ``BASE`` on), ``lengths``
(ids that each rule expands to) and ``symbols`` (16 bits each, little endian). The end
id is not stored. A document is read back from its own slice of the symbols.

Defined cases: NULL text is the empty text and gives just the end id; NULL doc_ids
come first; rows of equal doc_id follow in the order of their texts, and each keeps a
row; an empty table gives no rows; other columns are not read. A block always takes
whole documents, so a document longer than ``BLOCK_IDS`` makes a longer block.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import settle
from .registry import query, table
from .tokens import END, encoder, vocabulary_path

BLOCK_IDS = 2_000_000
BASE = 50_257
LAST = 65_535  # stands for a document's end while a block is compressed
SHARE = 0.5  # of the symbols left, given out in one round
SLOTS = 18  # chosen pairs are looked up in 2^SLOTS places
MIXER = np.uint32(0x9E3779B1)


def alternate(at: np.ndarray) -> np.ndarray:
    """Of places that follow each other without a gap the first, third, fifth and so on."""
    here = np.arange(len(at))
    start = np.maximum.accumulate(np.where(np.diff(at, prepend=-2) == 1, 0, here))
    return (here - start) & 1 == 0


def repeated(pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that can be replaced twice or more, and how often each. Pairs of a
    document's end do not count, nor does one of equal symbols that overlaps itself."""
    same = np.flatnonzero((pair >> 16) == (pair & 0xFFFF))
    ordered = np.sort(np.delete(pair, same[~alternate(same)]))
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])[: len(ordered)])
    count = np.diff(first, append=len(ordered))
    kinds = ordered[first]
    good = (count > 1) & (kinds >> 16 != LAST) & (kinds & 0xFFFF != LAST)
    return kinds[good], count[good]


def replaced(seq: np.ndarray, pair: np.ndarray, chosen: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """``seq`` with the ``chosen`` pairs replaced by symbols from ``first`` on, and those
    pairs; a pair that others leave fewer than two places gets no symbol."""
    place = (pair * MIXER) >> np.uint32(32 - SLOTS)
    at_place = (chosen * MIXER) >> np.uint32(32 - SLOTS)
    # of chosen pairs of one place the first is taken, the others wait for the next round
    _, taken = np.unique(at_place, return_index=True)
    chosen, at_place = chosen[taken], at_place[taken]
    wanted = np.full(1 << SLOTS, LAST << 16 | LAST, np.uint32)
    wanted[at_place] = chosen
    at = np.flatnonzero(wanted[place] == pair)
    at = at[alternate(at) & (seq[at] != LAST)]
    number = np.zeros(1 << SLOTS, np.int32)
    number[at_place] = np.arange(len(chosen))
    which = number[place[at]]
    used = np.bincount(which, minlength=len(chosen)) > 1
    at, which = at[used[which]], which[used[which]]
    symbol = first + np.cumsum(used) - 1
    seq = seq.copy()
    seq[at] = symbol[which]
    keep = np.ones(len(seq), bool)
    keep[at + 1] = False
    return seq[keep], chosen[used]


def compress(seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and rules of a block whose documents each end in ``LAST``."""
    pairs = np.empty(0, np.uint32)
    while (room := LAST - BASE - len(pairs)) > 0:
        pair = (seq[:-1].astype(np.uint32) << 16) | seq[1:]
        kinds, count = repeated(pair)
        if not len(kinds):
            break
        # part of the room a round: pairs of new symbols are worth more than rare old pairs
        most = max(min(room, 256), int(room * SHARE))
        best = kinds if len(kinds) <= most else kinds[np.argpartition(count, -most)[-most:]]
        shorter, new = replaced(seq, pair, best, LAST - room)
        if not len(new):
            # the best pair alone has two places at least
            shorter, new = replaced(seq, pair, kinds[[count.argmax()]], LAST - room)
        seq, pairs = shorter, np.concatenate([pairs, new])
    return seq, pairs


def rule_lengths(pairs: np.ndarray) -> np.ndarray:
    """Ids that each rule expands to."""
    made = [1] * BASE
    for a, b in zip((pairs >> 16).tolist(), (pairs & 0xFFFF).tolist()):
        made.append(made[a] + made[b])
    return np.array(made[BASE:], np.int32)


def expand(symbols: np.ndarray, pairs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The ids that ``symbols`` stand for, in one gather over all expansions."""
    spelled: list[bytes] = []
    a, b = (pairs >> 16).tolist(), (pairs & 0xFFFF).tolist()
    for x, y in zip(a, b):
        left = spelled[x - BASE] if x >= BASE else x.to_bytes(2, "little")
        right = spelled[y - BASE] if y >= BASE else y.to_bytes(2, "little")
        spelled.append(left + right)
    words = np.concatenate([np.arange(BASE, dtype=np.uint16), np.frombuffer(b"".join(spelled), np.uint16)])
    size = np.concatenate([np.ones(BASE, np.int32), lengths])
    start = np.concatenate([np.arange(BASE), BASE + np.cumsum(lengths) - lengths]).astype(np.int32)
    n = size[symbols]
    skip = start[symbols] - (np.cumsum(n) - n)
    return words[np.repeat(skip, n) + np.arange(n.sum())]


def decode(row: dict, k: int) -> np.ndarray:
    """The ids of the ``k``-th document of a block, without touching the others."""
    symbols = np.frombuffer(row["symbols"], np.uint16)
    piece = symbols[row["ends"][k - 1] if k else 0 : row["ends"][k]]
    pairs = np.frombuffer(row["pairs"], np.uint32)
    return np.append(expand(piece, pairs, np.array(row["lengths"], np.int32)), END).astype(np.uint32)


def encode_files(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Blocks of ``docs`` (``doc_id, text``), written to the shared folder and read back."""
    spark = docs.sparkSession
    vocabulary = path or vocabulary_path()
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = docs.schema["doc_id"].dataType
    schema = (
        f"shard int, block int, doc_ids array<{kind.simpleString()}>, ends array<long>, sizes array<long>, "
        "n_ids long, pairs binary, lengths array<int>, symbols binary"
    )

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        ids: list[bytes] = []
        doc_ids: list = []
        shard = block = held = 0

        def made() -> pa.RecordBatch:
            sizes = np.array([len(x) // 2 + 1 for x in ids], np.int64)
            end = np.array([LAST], np.uint16).tobytes()
            seq = np.frombuffer(b"".join(y for x in ids for y in (x, end)), np.uint16)
            if (seq >= BASE).sum() != len(ids):
                raise ValueError(f"the vocabulary has ids of {BASE} and more, where rules begin")
            symbols, pairs = compress(seq)
            at = np.flatnonzero(symbols == LAST)
            row = {
                "shard": [shard],
                "block": [block],
                "doc_ids": [doc_ids],
                "ends": [at - np.arange(len(at))],
                "sizes": [sizes],
                "n_ids": [int(sizes.sum())],
                "pairs": [pairs.tobytes()],
                "lengths": [rule_lengths(pairs)],
                "symbols": [symbols[symbols != LAST].tobytes()],
            }
            return pa.RecordBatch.from_pydict(row, schema=arrow)

        for batch in batches:
            for i, doc_id, text in zip(*(batch[c].to_pylist() for c in ("shard", "doc_id", "text"))):
                shard = i
                doc_ids.append(doc_id)
                ids.append(encode(text))
                held += len(ids[-1]) // 2 + 1
                if held >= BLOCK_IDS:
                    yield made()
                    ids, doc_ids, held, block = [], [], 0, block + 1
        if ids:
            yield made()

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    ordered = (
        docs.select("doc_id", "text")
        # rows of one doc_id, NULL too, are split by how their texts begin
        .repartitionByRange(n, F.col("doc_id").asc_nulls_first(), F.substring("text", 1, 64).asc_nulls_first())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
        .select(F.spark_partition_id().alias("shard"), "doc_id", "text")
    )
    return settle(ordered.mapInArrow(blocks, schema))


def read_files(files: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the blocks."""
    kind = files.schema["doc_ids"].dataType.elementType.simpleString()
    # a row per block, then per range: sums over ranges need one task, over blocks none
    head = files.select("shard", "block", "n_ids")
    ranges = head.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_range"))
    inside = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = head.withColumn("_inside", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)))
    offsets = offsets.join(ranges, "shard").select("shard", "block", (F.col("_range") + F.col("_inside")).alias("_before"))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sizes = np.array(row["sizes"], np.int64)
                ids = expand(
                    np.frombuffer(row["symbols"], np.uint16),
                    np.frombuffer(row["pairs"], np.uint32),
                    np.array(row["lengths"], np.int32),
                ).astype("<u4")
                stop = np.cumsum(sizes - 1)
                end = np.array([END], "<u4").tobytes()
                sums = [zlib.crc32(end, zlib.crc32(ids[a:b].data)) for a, b in zip(stop - sizes + 1, stop)]
                yield pa.RecordBatch.from_pydict(
                    {
                        "shard": pa.array([row["shard"]] * len(sizes), pa.int32()),
                        "block": pa.array([row["block"]] * len(sizes), pa.int32()),
                        "doc_id": pa.array(row["doc_ids"], batch.schema.field("doc_ids").type.value_type),
                        "start": pa.array(np.cumsum(sizes) - sizes),
                        "n_tokens": pa.array(sizes),
                        "ids_crc32": pa.array(sums, pa.int64()),
                    }
                )

    out = files.mapInArrow(
        documents, f"shard int, block int, doc_id {kind}, start long, n_tokens long, ids_crc32 long"
    )
    return out.join(offsets, ["shard", "block"]).select(
        "doc_id", (F.col("start") + F.col("_before")).alias("start"), "n_tokens", "ids_crc32"
    )


@query("op2_repair_tokens")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_files(encode_files(table(spark, sf_dir, "documents")))
