"""GeoJSON of any layout, read by as many tasks as there are file blocks.

Files are scanned as text that ends records at ``}``, so a block may begin anywhere: inside
a string, a feature, a list of coordinates. A first scan gives for each block how it
changes the depth of brackets, whether it begins inside a string or not; put one after the
other they say where each block begins. The second scan cuts out the objects: those of the
file's own level (a collection's frame, or a feature on its own) and those in a list
right inside one (a collection's features). What lies in one block is whole; only pieces of
objects that cross a border are shuffled, and put together by file and block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import settle

_SIGN = re.compile(rb'\\.|["{}\[\]]', re.S)
_QUOTE, _ESCAPE = 34, 92
_OPEN, _SHUT = b"{[", b"]}"
FRAME, ELEMENT, INNER = "frame", "element", "inner"


def _records(spark: SparkSession, path: str) -> DataFrame:
    """Texts up to the next ``}``, in the order of their block."""
    at = [F.col(f"_metadata.{c}").alias(n) for c, n in (("file_path", "_path"), ("file_block_start", "_block"), ("file_size", "_size"))]
    raw = spark.read.option("lineSep", "}").text(path)
    return raw.select(*at, F.col("value").cast("binary").alias("value"))


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block its bytes, and the change of depth if it begins outside or inside a
    string. A quote turns either case into the other."""
    names = ["_path", "_block", "_size", "bytes", "outside", "inside", "turned"]
    seen, key = [0, 0, 0, False], None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(names, (*key, *seen)))], schema=schema)

    schema = pa.schema([(n, pa.string() if n == "_path" else pa.bool_() if n == "turned" else pa.int64()) for n in names])
    for batch in batches:
        keys = zip(*(batch[n].to_pylist() for n in names[:3]))
        for here, value in zip(keys, batch["value"]):
            if here != key:
                if key:
                    yield row()
                key, seen = here, [0, 0, 0, False]
            record = value.as_py() + b"}"
            seen[0] += len(record)
            for m in _SIGN.finditer(record):
                sign = record[m.start()]
                if sign == _QUOTE:
                    seen[3] = not seen[3]
                elif sign != _ESCAPE:
                    # a bracket counts in the case that is outside of strings here
                    seen[2 if seen[3] else 1] += 1 if sign in _OPEN else -1
    if key:
        yield row()


def _begins(effects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Depth and string state that each block begins with, and how each file ends.

    A file has a row per block of many megabytes, so its rows are folded in one array.
    """
    state = F.struct(F.lit(0).cast("long").alias("depth"), F.lit(False).alias("quoted"))

    def after(s, b):
        moved = F.when(s["quoted"], b["inside"]).otherwise(b["outside"])
        return F.struct((s["depth"] + moved).alias("depth"), (s["quoted"] != b["turned"]).alias("quoted"))

    block = F.struct("_block", "bytes", "outside", "inside", "turned")
    files = effects.groupBy("_path").agg(
        F.sort_array(F.collect_list(block)).alias("bs"), F.max("_size").alias("_size"), F.sum("bytes").alias("_bytes")
    )
    # the last record has no bracket of its own if the text goes on after the last one
    cut = (F.col("_bytes") > F.col("_size")).alias("cut")
    each = F.transform(
        "bs",
        lambda b, i: F.struct(
            b["_block"].alias("_block"),
            F.aggregate(F.slice("bs", F.lit(1), i), state, after).alias("s"),
            (i == F.size("bs") - 1).alias("last"),
        ),
    )
    begins = files.select("_path", F.explode(each).alias("b"), cut).select(
        "_path", "b._block", "b.s.depth", "b.s.quoted", (F.col("b.last") & F.col("cut")).alias("cut")
    )
    end = F.aggregate("bs", state, after)
    ends = files.select("_path", end.alias("e"), cut).select(
        "_path", ((F.col("e.depth") != F.col("cut").cast("int") * -1) | F.col("e.quoted")).alias("broken")
    )
    return begins, ends


class _Cutter:
    """Objects of one block, from the state that it begins with.

    ``rows`` gets ``(kind, no, whole, text)``: number 0 is what went on from the block before.
    """

    def __init__(self, depth: int, quoted: bool):
        self.depth, self.quoted = depth, quoted
        self.rows: list[tuple] = []
        self.frames = self.elements = 0
        self.element_end = -1
        # what is being collected: inside an element, or deep in what went on
        self.kind = INNER if depth > 2 else FRAME
        self.no, self.text = 0, []
        self.frame_open = depth > 0
        self.after_element = depth == 2

    def flush(self, whole: bool) -> None:
        text = b"".join(self.text)
        self.text = []
        if text:
            self.rows.append((self.kind, self.no, whole, text))

    def element(self, lead: bytes) -> None:
        """An element begins; a frame keeps one null for all of a list's elements."""
        if not (self.after_element and lead.strip() == b","):
            self.text.append(lead + b"null")
        self.flush(False)
        self.elements += 1
        self.kind, self.no = ELEMENT, self.elements

    def feed(self, record: bytes) -> None:
        at = 0
        for m in _SIGN.finditer(record):
            sign, place = record[m.start()], m.start()
            if sign == _QUOTE:
                self.quoted = not self.quoted
            elif self.quoted or sign == _ESCAPE:
                continue
            elif sign in _OPEN:
                self.depth += 1
                if self.depth == 1 and sign == _OPEN[0]:
                    self.frames += 1
                    self.kind, self.no, self.text, at = FRAME, self.frames, [], place
                    self.frame_open, self.after_element = True, False
                elif self.depth == 3:
                    listed = record[:place].rstrip()[-1:] in (b"[", b",")
                    if sign == _OPEN[0] and listed and self.frame_open:
                        self.element(record[at:place])
                        at = place
                        self.element_end = 1
                    else:
                        self.element_end = 0
            else:
                self.depth -= 1
                if self.depth == 2:
                    self.element_end = 0
                    if self.kind in (ELEMENT, INNER):
                        self.text.append(record[at : m.end()])
                        self.flush(self.kind == ELEMENT)
                        self.after_element = True
                        self.kind, self.no, at = FRAME, self.frames, m.end()
                elif self.depth == 0 and self.frame_open:
                    self.text.append(record[at : m.end()])
                    went_on = any(k == FRAME and n == self.no for k, n, _, _ in self.rows)
                    self.flush(self.no > 0 and not went_on)
                    self.frame_open, at = False, m.end()
        if self.frame_open or self.kind != FRAME:
            rest = record[at:]
            if rest:
                self.text.append(rest)
                if self.kind == FRAME and rest.strip() not in (b"", b","):
                    self.after_element = False

    def end(self) -> list[tuple]:
        if self.frame_open or self.kind != FRAME:
            self.flush(False)
        return self.rows


def _objects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the blocks' objects; and one of kind NULL per block with what it counted."""
    names = ["_path", "_block", "seq", "kind", "no", "whole", "text", "frames", "elements", "element_end"]
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.bool_(), pa.binary(), pa.int32(), pa.int32(), pa.int32()]
    schema = pa.schema(list(zip(names, kinds)))
    key, cutter, held, cut = None, None, None, False

    def answer() -> pa.RecordBatch:
        cutter.feed(held if cut else held + b"}")
        rows = [(*key, i, *r, None, None, None) for i, r in enumerate(cutter.end())]
        rows.append((*key, -1, None, None, None, None, cutter.frames, cutter.elements, cutter.element_end))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], schema=schema)

    for batch in batches:
        columns = [batch[n].to_pylist() for n in ("_path", "_block", "depth", "quoted", "cut")]
        for path, block, depth, quoted, is_cut, value in zip(*columns, batch["value"]):
            if (path, block) != key:
                if key:
                    yield answer()
                key, cutter, cut = (path, block), _Cutter(depth, quoted), is_cut
            else:
                cutter.feed(held + b"}")
            held = value.as_py()
    if key:
        yield answer()


def geojson_objects(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``_path, text`` of the objects, and ``_path, broken`` of the files: a broken one
    ends inside an object or a string."""
    records = _records(spark, path)
    effects = records.mapInArrow(
        _effects, "_path string, _block long, _size long, bytes long, outside long, inside long, turned boolean"
    )
    begins, ends = _begins(settle(effects))
    # a row per block; and the records must stay in their order
    placed = records.join(F.broadcast(begins), ["_path", "_block"])
    made = placed.select("_path", "_block", "depth", "quoted", "cut", "value").mapInArrow(
        _objects,
        "_path string, _block long, seq int, kind string, no int, whole boolean, text binary, "
        "frames int, elements int, element_end int",
    )
    made = settle(made)
    before = Window.partitionBy("_path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)

    def latest(n: str):
        """The block where the object that is open began, and its number."""
        return F.last(F.when(F.col(n) > 0, F.struct(F.col("_block").alias("b"), F.col(n).alias("n"))), True).over(before)

    blocks = made.where("kind IS NULL").select(
        "_path",
        "_block",
        latest("frames").alias("f"),
        latest("elements").alias("e"),
        F.coalesce(F.last(F.when(F.col("element_end") >= 0, F.col("element_end")), True).over(before), F.lit(0)).alias("in_element"),
    )
    pieces = made.where("kind IS NOT NULL AND NOT whole").join(blocks, ["_path", "_block"])
    of_element = (F.col("kind") == ELEMENT) | ((F.col("kind") == INNER) & (F.col("in_element") == 1))
    own = F.struct(F.col("_block").alias("b"), F.col("no").alias("n"))
    went_on = F.when(of_element, F.col("e")).otherwise(F.col("f"))
    whose = F.when(F.col("no") > 0, own).otherwise(went_on)
    joined = (
        pieces.select("_path", of_element.alias("el"), whose.alias("whose"), F.struct("_block", "seq", "text").alias("p"))
        .where("whose IS NOT NULL")
        .groupBy("_path", "el", "whose")
        .agg(F.sort_array(F.collect_list("p")).alias("ps"))
        .select("_path", F.array_join(F.transform("ps", lambda p: p["text"].cast("string")), "").alias("text"))
    )
    whole = made.where("whole").select("_path", F.col("text").cast("string").alias("text"))
    return whole.unionByName(joined), ends
