r"""Records of delimited text whose quoted cells hold line breaks and doubled quotes, read in byte ranges.

Spark's multi-line mode gives a whole file to one task. Here a file is read in its usual ranges, line by line. A line
break belongs to a cell if the quotes before it in the file are odd in number, so

1. one scan counts the quotes of every range (parity only), and a running sum over the ranges of a file tells which of
   them start inside a quoted cell;
2. a second scan puts lines together to records, range by range, without any shuffle. It knows for each range whether it starts
   inside a cell;
3. only if some ranges start inside a cell, a third scan picks the records they cut: their pieces, at most two a range,
   meet in a small shuffle and are joined in the order of the ranges.

The driver holds one number per range that does not start a file (at most ``RANGES`` of them). A task that finds a range unknown
to the first scan fails, so ranges that change between the scans cannot give wrong records.

Defined cases: a carriage return before a line break ends a record as well and stays inside quotes; blank lines between records are
left out, those inside quotes stay; an empty file has no records; a file whose quotes do not close is an error, and so
is a file whose first line differs from the others'.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..session import cut_lineage

RANGES = 1_000_000

_SCHEMA = "record string, leads boolean, file bigint, start bigint, part int"


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    place = "_metadata.file_path"
    return spark.read.option("lineSep", "\n").text(path).select(
        "value", F.xxhash64(place).alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col(place).alias("path"))


def _count_ranges():
    """A row per range of the task: the parity of its quotes and, at the start of a file, its first line that is not blank."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, odd, opening = None, 0, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([place[0]], pa.int64()), pa.array([place[1]], pa.int64()), pa.array([odd], pa.int64()),
                                               pa.array([opening], pa.string())], names=["file", "start", "odd", "opening"])

        for batch in batches:
            files, starts = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            turns = np.flatnonzero((files[1:] != files[:-1]) | (starts[1:] != starts[:-1])) + 1
            bounds = [0, *turns.tolist(), len(files)] if len(files) else [0]
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                now = int(files[a]), int(starts[a])
                if now != place:
                    if place is not None:
                        yield row()
                    place, odd, opening = now, 0, None
                lines = batch.column(0).slice(a, b - a)
                odd = (odd + (pc.sum(pc.count_substring(lines, '"')).as_py() or 0)) % 2
                if opening is None and now[1] == 0:
                    opening = next((v for v in (x.as_py() for x in lines) if v not in ("", "\r")), None)
        if place is not None:
            yield row()

    return run


def range_parity(lines: DataFrame) -> DataFrame:
    """file, start, open, odd, opening: whether each range starts inside quotes, and the first line of a file that is not blank.

    A range is read by one task in order, so its lines are counted as they come; an aggregate with the first line would sort them all.
    """
    counted = lines.select("value", "file", "start").mapInArrow(_count_ranges(), "file bigint, start bigint, odd bigint, opening string")
    before = W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    return counted.withColumn("open", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2)


def _assemble(known: dict[tuple[int, int], int], pieces: bool):
    """Whole records of each range, or the pieces of records that go beyond one: 1 the end, 2 the begin, 3 neither."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, inside, held, own, at_top, top = None, 0, [], True, False, False
        out: list[tuple[str, bool, int, int, int]] = []

        def batch_of(rows) -> pa.RecordBatch:
            kinds = (pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.int32())
            columns = zip(*rows, strict=True) if rows else ((),) * 5
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["record", "leads", "file", "start", "part"])

        def close_range() -> None:
            if held and pieces:
                out.append(("\n".join(held), own and top, *place, 2 if own else 3))

        for batch in batches:
            files, starts = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            turns = np.flatnonzero((files[1:] != files[:-1]) | (starts[1:] != starts[:-1])) + 1
            bounds = [0, *turns.tolist(), len(files)] if len(files) else [0]
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                now = int(files[a]), int(starts[a])
                if now != place:
                    close_range()
                    if now[1] and now not in known:
                        raise ValueError("the byte ranges of a file changed between two scans; read again with fixed spark.sql.files settings")
                    place, inside, held = now, known.get(now, 0), []
                    own, at_top, top = not inside, now[1] == 0, False
                lines = batch.column(0).slice(a, b - a)
                buffers = lines.buffers()
                wide = np.int64 if pa.types.is_large_string(lines.type) else np.int32
                offsets = np.frombuffer(buffers[1], wide)[lines.offset:lines.offset + len(lines) + 1].astype(np.int64)
                data = np.frombuffer(buffers[2], np.uint8)[offsets[0]:offsets[-1]] if buffers[2] is not None else np.zeros(0, np.uint8)
                marks = np.append(0, np.cumsum(data == 34))[offsets - offsets[0]]
                after = (inside + marks[1:]) & 1
                before = np.append(inside, after[:-1])
                inside = int(after[-1])
                size = np.diff(offsets)
                blank = (before == 0) & ((size == 0) | ((size == 1) & (np.append(data, 0)[offsets[:-1] - offsets[0]] == 13)))
                alone = (before == 0) & (after == 0)
                leads = np.zeros(b - a, bool)
                if at_top and not blank.all():
                    leads[np.argmin(blank)] = True
                    at_top = False
                whole = np.flatnonzero(alone & ~blank)
                if len(whole) and not pieces:
                    text = pc.replace_substring_regex(lines.take(pa.array(whole)), r"\r\z", "").cast(pa.string())
                    yield pa.RecordBatch.from_arrays([text, pa.array(leads[whole]), pa.array(np.full(len(whole), now[0])), pa.array(np.full(len(whole), now[1])),
                                                      pa.array(np.zeros(len(whole), np.int32))], names=["record", "leads", "file", "start", "part"])
                for i in np.flatnonzero(~alone).tolist():
                    if before[i] == 0:
                        held, own, top = [], True, bool(leads[i])
                    held.append(lines[i].as_py())
                    if after[i] == 0:
                        text = "\n".join(held)
                        if own and not pieces:
                            out.append((text.removesuffix("\r"), top, *now, 0))
                        elif not own and pieces:
                            out.append((text, False, *now, 1))
                        held = []
            if out:
                yield batch_of(out)
                out = []
        close_range()
        if out:
            yield batch_of(out)

    return run


def read_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """record, leads: every record of the files as text; ``leads`` marks the first one of each file."""
    lines = _lines(spark, path)
    ranges = cut_lineage(range_parity(lines))
    broken = ranges.groupBy("file").agg((F.sum("odd") % 2).alias("odd")).where("odd = 1").first()
    if broken is not None:
        found = lines.where(F.col("file") == broken.file).select("path").first()
        raise ValueError(f"{found.path}: a quote is not closed")
    openings = ranges.where("start = 0").select("opening").distinct().limit(2).collect()
    if len(openings) > 1:
        raise ValueError(f"files start with different lines: {openings[0].opening!r} and {openings[1].opening!r}")
    later = ranges.where("start > 0")
    if later.limit(RANGES + 1).count() > RANGES:
        raise ValueError(f"over {RANGES} byte ranges: raise spark.sql.files.maxPartitionBytes")
    known = {(r.file, r.start): r.open for r in later.select("file", "start", "open").toLocalIterator()}
    narrow = lines.select("value", "file", "start")
    records = narrow.mapInArrow(_assemble(known, False), _SCHEMA).select("record", "leads")
    if not any(known.values()):
        return records
    # Ranges that start or end inside a cell; the scan reads the same files, as ranges depend on all of them.
    ends = F.lead("open").over(W.partitionBy("file").orderBy("start"))
    cut = F.broadcast(ranges.withColumn("next_open", ends).where("open = 1 OR next_open = 1").select("file", "start"))
    parts = cut_lineage(narrow.join(cut, ["file", "start"], "left_semi").select("value", "file", "start").mapInArrow(_assemble(known, True), _SCHEMA))
    order = W.partitionBy("file").orderBy("start", F.when(F.col("part") == 2, 1).otherwise(0))
    numbered = parts.withColumn("number", F.sum((F.col("part") == 2).cast("int")).over(order))
    joined = numbered.groupBy("file", "number").agg(F.array_sort(F.collect_list(F.struct("start", "part", "record"))).alias("p"), F.max("leads").alias("leads"))
    text = F.regexp_replace(F.array_join(F.transform("p", lambda x: x["record"]), "\n"), r"\r\z", "")
    return records.unionByName(joined.select(text.alias("record"), "leads"))


def header_names(record: str, sep: str) -> list[str]:
    """Column names of a header; a repeated name gets its position counted from 0, an empty one is ``_c`` and its position."""
    names = next(csv.reader([record], delimiter=sep))
    lower = [n.lower() for n in names]
    return [f"_c{i}" if not n else f"{n}{i}" if lower.count(n.lower()) > 1 else n for i, n in enumerate(names)]
