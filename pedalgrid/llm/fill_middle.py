"""Fill-in-the-middle: documents cut at line ends and put into another order.

A text is looked at in blocks of ``BLOCK`` bytes. A Fenwick tree over the blocks holds
how many lines end in each and how many code points it has. A cut after so many lines is
found by going down the tree in steps of halving powers of two (binary lifting), which
also adds up the code points before the block; the line end itself is then looked for in
that one block. Lines are ``[^\\n]*\\n`` or a last ``[^\\n]+``.

Two hashes of the id choose the cuts, a third whether the document is changed at all, a
fourth the order: prefix, suffix, middle (``psm``) or suffix, prefix, middle (``spm``),
each behind its mark. Texts that are empty or hold a mark stay as they are (``plain``), so
``restored`` gives every text back from output and form alone.

Defined cases: a NULL text is the empty text; a NULL id is the empty text in the hash; rows
are changed each on its own, so equal rows give equal results; texts of any length are read
whole; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .registry import query, table

BLOCK = 1024
# The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
# bytes of a code point after its first
INNER = bytes(range(0x80, 0xC0))
SEED = 7
RATE = 100
SPM = 50


class Fenwick:
    """Sums over prefixes of a row of blocks, for several counts at a time."""

    def __init__(self, counts: np.ndarray):
        """``counts`` has a row per block and a column per count."""
        n = len(counts)
        tree = np.zeros((n + 1, counts.shape[1]), np.int64)
        tree[1:] = counts
        step = 1
        # node k sums the lowest set bit of k blocks up to k; nodes of one bit at a time
        while step < n:
            upper = np.arange(2 * step, n + 1, 2 * step)
            tree[upper] += tree[upper - step]
            step *= 2
        self.tree, self.top = tree, 1 << (n.bit_length() - 1) if n else 0

    def descend(self, target: int) -> tuple[int, list[int]]:
        """The number of whole blocks whose first count stays below ``target``, and
        all counts over them."""
        tree, at, step = self.tree, 0, self.top
        sums = np.zeros(tree.shape[1], np.int64)
        while step:
            k = at + step
            if k < len(tree) and sums[0] + tree[k, 0] < target:
                at = k
                sums = sums + tree[k]
            step >>= 1
        return at, sums.tolist()


class Lines:
    """A text with its lines counted by block."""

    def __init__(self, text: bytes, block: int = BLOCK):
        raw = np.frombuffer(text, np.uint8)
        starts = np.arange(0, len(raw), block)
        self.text, self.block = text, block
        if len(raw):
            # a code point is counted by its first byte
            counts = np.column_stack(
                [np.add.reduceat(m, starts, dtype=np.int64) for m in (raw == 10, (raw & 0xC0) != 0x80)]
            )
        else:
            counts = np.zeros((0, 2), np.int64)
        self.feeds, self.points = counts.sum(0).tolist()
        self.tree = Fenwick(counts)
        self.n = self.feeds + bool(text and not text.endswith(b"\n"))

    def cut(self, lines: int) -> tuple[int, int]:
        """Bytes and code points of the first ``lines`` lines."""
        if lines <= 0:
            return 0, 0
        if lines > self.feeds:
            return len(self.text), self.points
        blocks, (before, points) = self.tree.descend(lines)
        begin = at = blocks * self.block
        for _ in range(lines - before):
            at = self.text.index(b"\n", at) + 1
        # a block may begin inside a code point, which the block before has counted
        return at, points + len(self.text[begin:at].translate(None, INNER))


def drawn(doc_id: object, seed: int) -> list[int]:
    """Four numbers of 32 bits from the id."""
    named = "" if doc_id is None else str(doc_id)
    h = sha256(f"{seed}:{named}".encode()).hexdigest()
    return [int(h[i : i + 8], 16) for i in range(0, 32, 8)]


def transformed(doc_id: object, text: bytes, seed: int = SEED, rate: int = RATE, spm: int = SPM):
    """``n, form, prefix_chars, middle_chars, output`` of one text."""
    lines = Lines(text)
    h1, h2, h3, h4 = drawn(doc_id, seed)
    p, s, m = (mark.encode() for mark in (PREFIX, SUFFIX, MIDDLE))
    if not text or p in text or s in text or m in text or h3 % 100 >= rate:
        return lines.n, "plain", None, None, text
    cuts = sorted((h1 % (lines.n + 1), h2 % (lines.n + 1)))
    (a, before), (b, upto) = map(lines.cut, cuts)
    head, middle, tail = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm:
        form, out = "spm", (s, tail, p, head, m, middle)
    else:
        form, out = "psm", (p, head, s, tail, m, middle)
    return lines.n, form, before, upto - before, b"".join(out)


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` per row of ``docs``.
    ``rate`` of a hundred documents are changed, ``spm`` of a hundred of these to
    suffix first."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [
                transformed(i, t.as_py() or b"", seed, rate, spm)
                for i, t in zip(batch["doc_id"].to_pylist(), batch["text"])
            ]
            kinds = pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()
            columns = [pa.array([r[k] for r in made], kind) for k, kind in enumerate(kinds)]
            names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
            yield pa.record_batch(dict(zip(names, chain([batch["doc_id"]], columns))))

    kind = docs.schema["doc_id"].dataType.simpleString()
    made = docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(
        of, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output binary"
    )
    return made.withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output of that form was made from. Each mark is there once, as
    texts that hold one stay plain."""

    def before(c: Column, mark: str) -> Column:
        return F.substring_index(c, mark, 1)

    def after(c: Column, mark: str) -> Column:
        return F.substring_index(c, mark, -1)

    psm = F.concat(
        after(before(output, SUFFIX), PREFIX), after(output, MIDDLE), before(after(output, SUFFIX), MIDDLE)
    )
    spm = F.concat(
        before(after(output, PREFIX), MIDDLE), after(output, MIDDLE), after(before(output, PREFIX), SUFFIX)
    )
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


@query("op12_fill_in_middle")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    again = restored(F.col("output"), F.col("form"))
    return made.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(again.cast("binary"), 256).alias("restored_sha256"),
    )
