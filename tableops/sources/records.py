"""CSV records whose cells span lines, put together from the splits of a file.

Where a record begins depends on whether a line starts inside a quoted cell, which depends on all lines before
it. Two passes over the lines settle that without any file being one task's:

1. For each line with quotes, expressions tell where it ends if it starts outside or inside a cell; a task
   composes these for each split of a file. That leaves one row per split, and composing the rows of
   a file in order gives the state at each split's start, and whether a cell is open at the file's end.
2. Each split then knows its lines' states. It puts its records together; what it holds of a record that began
   in an earlier split, and the beginning of one that goes on, are joined afterwards, a row or two per split.

Records are text, cells are parsed by Spark. Lines end with a line feed; a carriage return before one is part of a
cell within quotes and of the line end elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tableops.plans.scratch import written

BOM = "﻿"


def ends_inside(line: Column, sep: str, inside: bool) -> Column:
    """Does a line end within a quoted cell, if it starts within one or not?

    A quote opens a cell only at the cell's start, so marks inside bare cells don't count. Within a quoted cell
    two quotes are one mark, and a single one closes it.
    """
    parts = F.split(line, '"', -1)
    last = F.size(parts) - 1
    # 0 outside, 1 inside, 2 inside before the second of two quotes
    start = F.lit(1 if inside else 0)

    def step(state: Column, i: Column) -> Column:
        before, after = F.get(parts, i - 1), F.get(parts, i)
        at_start = F.endswith(before, F.lit(sep))
        if not inside:
            at_start = at_start | ((i == 1) & (before == ""))
        doubled = (after == "") & (i < last)
        return F.when(state == 0, F.when(at_start, 1).otherwise(0)).when(state == 2, 1).otherwise(F.when(doubled, 2).otherwise(0))

    # An opening quote is followed by cell text, never by the second of two.
    return F.when(last > 0, F.aggregate(F.sequence(F.lit(1), last), start, step) > 0).otherwise(F.lit(inside))


def lines_of(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """All lines with the file and split they are in: value, file, start. Order within a split is the file's."""
    lines = spark.read.option("lineSep", "\n").text(path)
    file, start = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    value = F.when(start == 0, F.ltrim("value", F.lit(BOM))).otherwise(F.col("value"))
    return lines.select(value.alias("value"), file.alias("file"), start.alias("start"))


def quote_states(lines: DataFrame, sep: str) -> DataFrame:
    """One row per split with quotes: file, start, and where it ends if it starts outside (``out``) or inside (``inn``)."""

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[tuple[str, int], tuple[bool, bool]] = {}
        for batch in batches:
            for file, start, out, inn in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                was_out, was_inn = state.get((file, start), (False, True))
                state[file, start] = (inn if was_out else out), (inn if was_inn else out)
        made = [[f for f, _ in state], [s for _, s in state], [o for o, _ in state.values()], [i for _, i in state.values()]]
        kinds = (pa.string(), pa.int64(), pa.bool_(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(made, kinds, strict=True)], names=["file", "start", "out", "inn"])

    quoted = lines.where(F.contains("value", F.lit('"')))
    quoted = quoted.select("file", "start", ends_inside(F.col("value"), sep, False).alias("out"), ends_inside(F.col("value"), sep, True).alias("inn"))
    # Lines that leave both states as they are need no Python.
    return quoted.where(F.col("out") | ~F.col("inn")).mapInArrow(compose, "file string, start long, out boolean, inn boolean")


def split_starts(states: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the states: the splits that change them with what comes after (file, start, inside); and the files left open."""
    files = states.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("start", "out", "inn"))).alias("splits"))

    def follow(so_far: Column, x: Column) -> Column:
        inside = F.element_at(so_far, -1)["inside"]
        return F.concat(so_far, F.array(F.struct(x["start"].alias("start"), F.when(inside, x["inn"]).otherwise(x["out"]).alias("inside"))))

    first = F.array(F.struct(F.lit(-1).cast("long").alias("start"), F.lit(False).alias("inside")))
    followed = files.select("file", F.aggregate("splits", first, follow).alias("ends"))
    ends = followed.select("file", F.inline("ends"))
    return ends, followed.where(F.element_at("ends", -1)["inside"]).select("file")


def split_states(spark: SparkSession, path: str | Sequence[str], sep: str) -> DataFrame:
    """For files with cells open at the end of a split: file, ends (the states after its splits). A written table.

    Raises, naming the files, if a quoted cell does not close before the end of its file.
    """
    states = written(quote_states(lines_of(spark, path), sep), "quote-states")
    ends, unclosed = split_starts(states)
    if found := [r["file"] for r in unclosed.orderBy("file").limit(3).collect()]:
        raise ValueError(f"a quoted cell is not closed before the end of the file: {found}")
    lists = ends.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("start", "inside"))).alias("ends"))
    return written(lists.where(F.exists("ends", lambda x: x["inside"])), "split-states")


def records(spark: SparkSession, path: str | Sequence[str], sep: str, changes: DataFrame | None = None, first_split: bool = False) -> DataFrame:
    """All records of all files, blank lines left out: file, start (the split it begins in), n (its place there), record.

    ``changes`` are the ``split_states`` of the files. ``first_split`` reads no further than each file's first split.
    The first record of a file has ``start`` and ``n`` 0.
    """
    lines = lines_of(spark, path)
    if first_split:
        lines = lines.where(F.col("start") == 0)
    changes = split_states(spark, path, sep) if changes is None else changes
    out, inn = ends_inside(F.col("value"), sep, False), ends_inside(F.col("value"), sep, True)
    # Lines must stay in order, so the table is broadcast: a few bytes for each split of files that need it.
    known = lines.join(F.broadcast(changes), "file", "left")
    before = F.filter("ends", lambda x: x["start"] < F.col("start"))
    inside = F.coalesce(F.element_at(before, -1)["inside"], F.lit(False))
    known = known.select("file", "start", "value", out.alias("out"), inn.alias("inn"), inside.alias("inside"))

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file", "start", "n", "record", "head", "open"]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_()]
        done: list[tuple] = []
        at, parts, inside, n, head = None, [], False, 0, False

        def finish(still_open: bool) -> None:
            nonlocal parts, n, head
            if parts and (head or still_open or any(not p.isspace() and p for p in parts)):
                done.append((*at, n, "\n".join(parts), head, still_open))
                n += 1
            parts, head = [], False

        def made() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) or [()] * len(names)
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            for file, start, value, out, inn, begins_inside in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if at != (file, start):
                    if at:
                        finish(inside)
                    at, inside, n, head = (file, start), begins_inside, 0, begins_inside
                parts.append(value)
                inside = inn if inside else out
                if not inside:
                    finish(False)
            yield made()
        if at:
            finish(inside)
        yield made()

    made = known.mapInArrow(assemble, "file string, start long, n long, record string, head boolean, open boolean")
    whole = made.where(~F.col("head") & ~F.col("open")).select("file", "start", "n", "record")
    # A record that goes on: its beginning, then the heads of splits up to one that closes it.
    pieces = made.where(F.col("head") | F.col("open"))
    upto = Window.partitionBy("file").orderBy("start", "n")
    owner = F.last(F.when(~F.col("head"), F.struct("start", "n")), ignorenulls=True).over(upto)
    pieces = pieces.withColumn("owner", owner).groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("start", "n", "record"))).alias("parts"))
    joined = pieces.select("file", "owner.start", "owner.n", F.array_join(F.col("parts.record"), "\n").alias("record"))
    return whole.unionByName(joined).withColumn("record", F.rtrim("record", F.lit("\r")))

