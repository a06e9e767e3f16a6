"""One column of CSV files whose quoted cells may hold line ends, read by as many tasks as there are file splits.

Whether a line begins inside a quoted cell depends on everything before it in its file.  A split does not know that, but it can say how it would leave a reader that
came to it outside or inside of quotes.  Those two answers, put together split by split in the order of the file, tell how each split begins; then every split
finds its own records.  Only a record that goes over the end of a split is put together from pieces.

A cell is quoted if its first character is a quote; quotes inside are doubled, and a single quote followed by anything but a separator or the line's end makes the
cell plain text up to the next separator, as in Spark's own reader.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize

# Splits whose states are broadcast together: a state is a path, a place and a few flags.
BROADCAST_SPLITS = 200_000
_BOM = "﻿"


def _after_quotes(line: str, at: int) -> int:
    """Inside quotes at ``at``: the place of the separator or the end behind the cell, -1 if the line ends inside."""
    while True:
        quote = line.find('"', at)
        if quote < 0:
            return -1
        behind = line[quote + 1 : quote + 2]
        if behind == '"':
            at = quote + 2
        elif behind in ("", ",") or line[quote + 1 :] == "\r":
            return quote + 1
        else:
            end = line.find(",", quote + 1)
            return len(line) if end < 0 else end


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a reader that begins ``line`` inside or outside of quotes is inside of them at its end."""
    if '"' not in line:
        return inside
    at = 0
    if inside:
        at = _after_quotes(line, 0)
        if at < 0:
            return True
        at += 1
    while at < len(line):
        if line[at] == '"':
            at = _after_quotes(line, at + 1)
            if at < 0:
                return True
        else:
            at = line.find(",", at)
            if at < 0:
                return False
        at += 1
    return False


def cell(record: str, index: int) -> str | None:
    """The cell of a whole record at ``index``, null if there is none or it is empty."""
    record = record.removesuffix("\r")
    at = 0
    while True:
        if record.startswith('"', at):
            end = _after_quotes(record, at + 1)
            end = len(record) if end < 0 else end
            value = record[at:end]
            if len(value) > 1 and value.endswith('"') and '"' not in value[1:-1].replace('""', ""):
                value = value[1:-1].replace('""', '"')
        else:
            end = record.find(",", at)
            end = len(record) if end < 0 else end
            value = record[at:end]
        if not index:
            return value or None
        if end >= len(record):
            return None
        index, at = index - 1, end + 1


def header_of(lines: Iterator[str]) -> list[str]:
    """The cells of a file's first record."""
    record, inside = [], False
    for line in lines:
        record.append(line)
        inside = ends_inside(line, inside)
        if not inside:
            break
    text = "\n".join(record).removeprefix(_BOM).removesuffix("\r")
    return next(csv.reader(io.StringIO(text, newline="")), [])


def _lines(spark: SparkSession, files: Sequence[str]) -> DataFrame:
    """(value, file, at): the lines of each split in their order; ``at`` is where the split begins in its file."""
    text = spark.read.text(list(files), lineSep="\n")
    return text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.RecordBatch, bool]]:
    """(split, its lines, whether they are its first) of runs of lines of one split; columns from the second on tell splits apart."""
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        run = pc.run_end_encode(b.column(2)).run_ends.to_pylist()
        files = pc.run_end_encode(b.column(1)).run_ends.to_pylist()
        start = 0
        for stop in sorted({*run, *files}):
            part = b.slice(start, stop - start)
            key = tuple(c[0].as_py() for c in part.columns[1:])
            yield key, part, key != last
            last, start = key, stop


def _states(lines: DataFrame, column: str) -> DataFrame:
    """(file, at, inside, leaves, width, index, header): how each split begins and ends, and where the column is in its file."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, out, into, first = None, False, True, []

        def row() -> pa.RecordBatch:
            header = header_of(iter(first)) if first else None
            return pa.RecordBatch.from_pydict({"file": [key[0]], "at": [key[1]], "outside": [out], "inside": [into], "header": [header]}, schema)

        schema = pa.schema([("file", pa.string()), ("at", pa.int64()), ("outside", pa.bool_()), ("inside", pa.bool_()), ("header", pa.list_(pa.string()))])
        reading = False
        for split, part, new in _by_split(batches):
            if new:
                if key is not None:
                    yield row()
                key, out, into, first, reading = split, False, True, [], split[1] == 0
            texts = part.column(0)
            if reading:
                for line in texts.to_pylist():
                    first.append(line)
                    reading = ends_inside("\n".join(first) if len(first) > 1 else line.removeprefix(_BOM), False)
                    if not reading:
                        break
            for line in texts.filter(pc.match_substring(texts, '"')).to_pylist():
                out, into = ends_inside(line, out), ends_inside(line, into)
        if key is not None:
            yield row()

    def chained(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("at")
        header = (rows["header"].to_pylist() or [None])[0] or []
        index = header.index(column) if column in header else -1
        begins, leaves, state = [], [], False
        for outside, inside in zip(rows["outside"].to_pylist(), rows["inside"].to_pylist(), strict=True):
            begins.append(state)
            state = inside if state else outside
            leaves.append(state)
        n = rows.num_rows
        return pa.table({"file": rows["file"], "at": rows["at"], "inside": begins, "leaves": leaves, "index": pa.array([index] * n, pa.int32()), "header": pa.array([", ".join(header)] * n, pa.string())})

    found = lines.mapInArrow(summed, "file string, at bigint, outside boolean, inside boolean, header array<string>")
    # The splits of one file are as few as its bytes divided by the size of a split.
    return materialize(found.groupBy("file").applyInArrow(chained, "file string, at bigint, inside boolean, leaves boolean, index int, header string"))


_STATE = ("inside", "index")


def _records(lines: DataFrame) -> DataFrame:
    """(file, value) of the records that lie within one split; lines have the columns of the states."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, head, header = [], False, False
        for (file, at, inside, index), part, new in _by_split(batches):
            if new:
                # What a split begins with inside of quotes belongs to a record of the one before it.
                open_, head, header = [], inside, at == 0
            out = []
            for line in part.column(0).to_pylist():
                if not open_ and not head and '"' not in line:
                    if header:
                        header = False
                    elif line and line != "\r":
                        out.append(cell(line, index))
                    continue
                state = ends_inside(line, bool(open_) or head)
                open_.append(line)
                if not state:
                    if head or header:
                        head = header = False
                    else:
                        out.append(cell("\n".join(open_), index))
                    open_ = []
                elif head:
                    open_ = []
            yield pa.RecordBatch.from_arrays([pa.array([file] * len(out), pa.string()), pa.array(out, pa.string())], names=["file", "value"])

    return lines.mapInArrow(run, "file string, value string")


def _crossing(lines: DataFrame, states: DataFrame) -> DataFrame:
    """(file, value) of the records that go over the end of a split, from the pieces that splits hold of them."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, head, open_, headed = None, [], [], False

        def row() -> pa.RecordBatch:
            whole = headed  # the split lies within one cell
            return pa.RecordBatch.from_pydict({"file": [key[0]], "at": [key[1]], "index": [key[3]], "head": ["\n".join(head)], "whole": [whole], "tail": ["\n".join(open_) if open_ else None], "began": [key[2]]}, schema)

        schema = pa.schema([("file", pa.string()), ("at", pa.int64()), ("index", pa.int32()), ("head", pa.string()), ("whole", pa.bool_()), ("tail", pa.string()), ("began", pa.bool_())])
        for split, part, new in _by_split(batches):
            if new:
                if key is not None:
                    yield row()
                key, head, open_, headed = split, [], [], split[2]
            for line in part.column(0).to_pylist():
                if headed:
                    head.append(line)
                    headed = ends_inside(line, True)
                elif open_ or '"' in line:
                    state = ends_inside(line, bool(open_))
                    open_.append(line)
                    if not state:
                        open_ = []
        if key is not None:
            yield row()

    def stitched(rows: pa.Table) -> pa.Table:
        out, record, index = [], None, -1
        for r in rows.sort_by("at").to_pylist():
            index = r["index"]
            if r["began"] and record is not None:
                record.append(r["head"])
                if not r["whole"]:
                    out.append(cell("\n".join(record), index))
                    record = None
            if r["tail"] is not None:
                record = [r["tail"]]
        if record is not None:  # the file ends inside of quotes
            out.append(cell("\n".join(record), index))
        return pa.table({"file": pa.array([rows["file"][0].as_py()] * len(out), pa.string()), "value": pa.array(out, pa.string())})

    cut = states.where("inside OR leaves").select("file", "at", *_STATE)
    found = lines.join(F.broadcast(cut), ["file", "at"]).select("value", "file", "at", *_STATE)
    parts = found.mapInArrow(pieces, "file string, at bigint, index int, head string, whole boolean, tail string, began boolean")
    return parts.groupBy("file").applyInArrow(stitched, "file string, value string")


def read_column(spark: SparkSession, paths: Sequence[str], column: str) -> DataFrame:
    """(file, value): the cells of ``column`` in all records of the CSV files in ``paths`` (files, folders, globs), by each file's own header.

    Blank lines are no records; a short record has a null, as has an empty cell.  A file without the column is an error; an empty file has no
    records.  Line ends are LF or CR LF.  A file may be read by many tasks, also within a quoted cell; a compressed one is one split.
    """
    states = _states(_lines(spark, paths), column)
    wrong = states.where("index < 0").select("file", "header").orderBy("file").first()
    if wrong is not None:
        raise KeyError(f"Column '{column}' not found in {wrong['file']}. Available columns: {wrong['header']}")
    total = states.count()
    groups = max(1, -(-total // BROADCAST_SPLITS))
    out = None
    for group in range(groups):
        own = states if groups == 1 else states.where(F.pmod(F.xxhash64("file"), F.lit(groups)) == group)
        files = list(paths) if groups == 1 else [r["file"] for r in own.select("file").distinct().collect()]
        if not files:
            continue
        lines = _lines(spark, files)
        begins = own.select("file", "at", *_STATE)
        part = _records(lines.join(F.broadcast(begins), ["file", "at"]).select("value", "file", "at", *_STATE))
        if not own.where("inside OR leaves").isEmpty():
            part = part.unionByName(_crossing(lines, own))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], "file string, value string")
