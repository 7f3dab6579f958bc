"""Delimited text with quoted line breaks, read by many tasks per file (SRC6).

A quoted field may hold line breaks, so where a record begins depends on all the
quotes before it.  A line maps the state before it (outside or inside a quoted field)
to the state after it, and so does a run of lines; such maps of two states are a
constant, the identity or a swap.  The first pass maps each file block from both
states; a window over a file's blocks (one row per block) composes the maps into the
state at which each block begins; the second pass cuts the blocks into records.  A
record that crosses blocks is put together from its pieces, two at most per block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_QUOTED = re.compile(r'(?:[^"]|"")*+')


def ends_inside(line: str, inside: bool, sep: str = "\t") -> bool:
    """Is a quoted field open after ``line``?  A field is quoted if it begins with a quote; a doubled quote is one of its
    characters; a single one ends it, and what follows up to the separator is taken as it is."""
    at, n = 0, len(line)
    while True:
        if not inside:
            if at < n and line[at] == '"':
                at += 1
            else:
                at = line.find(sep, at) + 1
                if at == 0:
                    return False
                continue
        at = _QUOTED.match(line, at).end()
        if at >= n:
            return True
        at, inside = line.find(sep, at) + 1, False
        if at == 0:
            return False


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, str]]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in ("file", "block", "value")), strict=True)


def _block_maps(sep: str):
    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, done = None, [False, True], []

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({
                "file": pa.array([d[0] for d in done], pa.string()), "block": pa.array([d[1] for d in done], pa.int64()),
                "from_out": pa.array([d[2] for d in done], pa.bool_()), "from_in": pa.array([d[3] for d in done], pa.bool_())})

        for file, block, line in _runs(batches):
            if (file, block) != key:
                if key:
                    done.append((*key, *state))
                key, state = (file, block), [False, True]
            if '"' in line:
                line = line.removesuffix("\r")
                state = [ends_inside(line, s, sep) for s in state] if state[0] != state[1] else [ends_inside(line, state[0], sep)] * 2
        if key:
            done.append((*key, *state))
        yield rows()

    return maps


def _starts(maps: DataFrame) -> DataFrame:
    """(file, block) of the blocks that begin inside a quoted field."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    upto = before.rowsBetween(Window.unboundedPreceding, 0)
    swap = (F.col("from_out") & ~F.col("from_in")).cast("int")
    fixed = F.col("from_out") == F.col("from_in")
    m = maps.withColumn("swaps", F.sum(swap).over(upto))
    m = m.withColumn("last", F.last(F.when(fixed, F.struct(F.col("from_out").cast("int").alias("state"), "swaps")), ignorenulls=True).over(before))
    m = m.withColumn("now", F.coalesce(F.lag("swaps").over(Window.partitionBy("file").orderBy("block")), F.lit(0)))
    inside = (F.coalesce(F.col("last.state"), F.lit(0)) + F.col("now") - F.coalesce(F.col("last.swaps"), F.lit(0))) % 2 == 1
    return m.filter(inside).select("file", "block")


_PIECES = "file string, block long, part int, opens boolean, whole boolean, record string"


def _records(inside_at: set[tuple[str, int]], sep: str):
    names = [c.split()[0] for c in _PIECES.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, inside, held, opens, part, out = None, False, [], True, 0, []

        def end(whole: bool) -> None:
            nonlocal held, opens, part
            if held or not opens:
                out.append((*key, part, opens, whole and opens, "\n".join(held)))
                part += 1
            held, opens = [], True

        def rows() -> pa.RecordBatch:
            nonlocal out
            columns, out = list(zip(*out, strict=True)) or [[]] * len(names), []
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        for file, block, line in _runs(batches):
            if (file, block) != key:
                if key:
                    end(not inside)
                key, part = (file, block), 0
                inside = key in inside_at
                opens = not inside
                if len(out) > 4096:
                    yield rows()
            text = line.removesuffix("\r")
            after = ends_inside(text, inside, sep) if inside or '"' in line else False
            held.append(line if after else text)
            inside = after
            if not inside:
                end(True)
        if key:
            end(not inside)
        yield rows()

    return cut


def read_records(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """Column ``record``: the text of every record that is not empty, line breaks inside quotes included."""
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"),
                                                                 F.col("_metadata.file_block_start").alias("block"))
    maps = lines.mapInArrow(_block_maps(sep), "file string, block long, from_out boolean, from_in boolean")
    inside_at = {(r["file"], r["block"]) for r in _starts(maps).collect()}  # one entry per file block at most
    cut = lines.mapInArrow(_records(inside_at, sep), _PIECES)
    whole = cut.filter("whole").select("record")
    # a piece that does not open a record goes on with the one before it in its file
    order = Window.partitionBy("file").orderBy("block", "part")
    pieces = cut.filter("not whole").withColumn("n", F.sum(F.col("opens").cast("int")).over(order))
    joined = pieces.groupBy("file", "n").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("block", "part", "record"))), lambda p: p["record"]), "\n").alias("record")).select("record")
    return whole.unionByName(joined).filter(F.col("record") != "")


def read_delimited(spark: SparkSession, path: str, schema: str, sep: str = "\t") -> DataFrame:
    """The records parsed by ``schema`` (DDL): as Spark's reader with ``multiLine``, but a file is read by as many tasks as it has blocks."""
    return read_records(spark, path, sep).select(F.from_csv("record", schema, {"sep": sep, "escape": '"'}).alias("r")).select("r.*")
