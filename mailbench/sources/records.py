"""CSV records whose quoted fields may hold line ends, of one file read by many tasks.

Whether a line end stands inside quotes depends on all text before it, so a file cannot simply be cut.  It is read
twice.  First, each byte range tells where it would end, inside or outside a quoted field, if it began outside and if it
began inside, and how many records would start in it.  One row per range is then enough to follow each file from its
beginning: the state and the record number that every range begins with.  Second, each range gives the records
that start in it, reading on behind its end for the last one.  Files of one range are read once.

A quote opens a field only where a field begins, so a stray quote within a plain field changes nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailbench.session import parallelism, stage
from mailbench.sources.files import Stores, attempted

RANGE_BYTES = 64 << 20
BLOCK_BYTES = 4 << 20
RECORDS_AT_ONCE = 5000
OUTSIDE, INSIDE = 0, 1
BOM = b"\xef\xbb\xbf"
# Files that only whole readers understand.
PACKED = (".gz", ".bz2", ".deflate", ".lz4", ".snappy", ".zst", ".xz")

# A field that begins with a quote, up to its closing quote or the end of the line.
_QUOTED = re.compile(rb'(?:^|,)"(?:[^"]++|"")*+("?)')
_CLOSING = re.compile(rb'(?:[^"]++|"")*+"')


def after_line(line: bytes, state: int) -> int:
    """Whether the end of a line that begins in ``state`` stands inside a quoted field."""
    start = 0
    if state == INSIDE:
        closed = _CLOSING.match(line)
        if closed is None:
            return INSIDE
        start = closed.end()
    for field in _QUOTED.finditer(line, start):
        if not field[1]:
            return INSIDE
    return OUTSIDE


def lines_of(file, start: int, end: int, block_bytes: int = BLOCK_BYTES) -> Iterator[bytes]:
    """The lines that begin at or after ``start`` and before ``end``, whole and without their line ends, then those after them.

    The file is read in blocks as far as lines are asked for; each line comes with whether it begins before ``end``.
    """
    at = start - 1 if start else 0  # the byte before tells whether a line begins here
    file.seek(at)
    skipping, rest = bool(start), b""
    while block := file.read(block_bytes):
        *whole, last = block.split(b"\n")
        if whole:
            whole[0], rest = rest + whole[0], last
        else:
            rest += last
        for line in whole:
            if skipping:
                skipping = False
            else:
                yield line, at < end
            at += len(line) + 1
    if rest and not skipping:
        yield rest, at < end


def _each_range(read):
    """Run ``read(store, row)`` over ranges; rows of results are handed on in frames."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stores = Stores()
        for batch in batches:
            for row in batch.itertuples(index=False):
                yield from read(stores, row)

    return run


def _survey(stores: Stores, row) -> Iterator[pd.DataFrame]:
    """Where a range would end, and how many records would start in it, for both states at its beginning."""
    state, found = [OUTSIDE, INSIDE], [0, 0]
    with attempted(lambda: stores.open(row.path)) as file:
        for line, own in lines_of(file, row.start, row.end):
            if not own:
                break
            filled = line not in (b"", b"\r")
            for begun in (OUTSIDE, INSIDE):
                found[begun] += filled and state[begun] == OUTSIDE
            if b'"' in line:
                state = [after_line(line, s) for s in state]
    yield pd.DataFrame([(row.path, row.start, row.end, *state, *found)], columns=[
        "path", "start", "end", "after_outside", "after_inside", "found_outside", "found_inside"])


def _follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """State and record number at the beginning of each range, of files in order: one row is held at a time."""
    path, state, number = None, OUTSIDE, 0
    for batch in batches:
        out = []
        for row in batch.itertuples(index=False):
            if row.path != path:
                path, state, number = row.path, OUTSIDE, 0
            out.append((row.path, row.start, row.end, state, number))
            number += row.found_inside if state == INSIDE else row.found_outside
            state = row.after_inside if state == INSIDE else row.after_outside
        yield pd.DataFrame(out, columns=["path", "start", "end", "state", "number"])


def _records(stores: Stores, row) -> Iterator[pd.DataFrame]:
    """Number and text of the records that start in a range whose beginning is known."""
    state, number, parts, rows = row.state, row.number, None, []
    with attempted(lambda: stores.open(row.path)) as file:
        returns = _ends_with_return(file)
        for line, own in lines_of(file, row.start, row.end):
            if parts is None and not own and state == OUTSIDE:
                break  # the next record is another range's
            after = after_line(line, state) if b'"' in line else state
            plain = line[:-1] if returns and line.endswith(b"\r") else line
            if state == OUTSIDE and plain:
                parts = [plain]
            elif parts is not None and state == INSIDE:
                parts.append(plain)
            state = after
            if parts is not None and state == OUTSIDE:
                rows.append((row.path, number, b"\n".join(parts)))
                parts, number = None, number + 1
            if len(rows) >= RECORDS_AT_ONCE:
                yield _decoded(rows)
                rows = []
            if not own and state == OUTSIDE:
                break
    if parts is not None:
        rows.append((row.path, number, b"\n".join(parts)))  # a field that is never closed
    if rows:
        yield _decoded(rows)


def _decoded(rows: list[tuple]) -> pd.DataFrame:
    out = [(path, number, (text.removeprefix(BOM) if number == 0 else text).decode("utf-8", errors="replace")) for path, number, text in rows]
    return pd.DataFrame(out, columns=["path", "number", "record"])


def _ends_with_return(file) -> bool:
    """Whether a file's lines end with a carriage return as well; its first line end tells."""
    file.seek(0)
    seen = b""
    while block := file.read(1 << 16):
        seen = seen[-1:] + block
        if (at := seen.find(b"\n")) >= 0:
            return seen[:at].endswith(b"\r")
    return False


def file_ranges(spark: SparkSession, path: str, range_bytes: int) -> DataFrame:
    """``path, start, end`` of all ranges of the files at ``path``, named as Spark's readers name them."""
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    starts = files.select("path", "length", F.explode(F.sequence(F.lit(0), F.col("length") - 1, F.lit(range_bytes))).alias("start"))
    return starts.select("path", "start", F.least("length", F.col("start") + range_bytes).alias("end"))


def _begun(ranges: DataFrame, whole: DataFrame, tasks: int) -> DataFrame:
    """Ranges with the state and record number they begin with; ``whole`` are those of files of one range."""
    schema = "path string, start long, end long"
    cut = ranges.where("start > 0").select(F.col("path").alias("_path")).distinct()
    several = F.col("path") == F.col("_path")
    surveyed = (ranges.join(cut, several, "left_semi").select("path", "start", "end").repartition(tasks)
                .mapInPandas(_each_range(_survey), f"{schema}, after_outside long, after_inside long, found_outside long, found_inside long"))
    known = (surveyed.repartition(tasks, "path").sortWithinPartitions("path", "start")
             .mapInPandas(_follow, f"{schema}, state long, number long"))
    return whole.join(cut, several, "left_anti").unionByName(known)


def csv_records(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``path, number, record``: text of every record, its place in its file, 0 for the header.

    Empty lines are no records.  Line ends within quotes are newlines where the file's lines end with a carriage return
    and a newline, and as they are where lines end with a newline; other line ends are not known.
    """
    ranges = stage(file_ranges(spark, path, range_bytes), "csv-ranges")
    tasks = parallelism(spark)
    begun = ranges.select("path", "start", "end", F.lit(OUTSIDE).cast("long").alias("state"), F.lit(0).cast("long").alias("number"))
    if not ranges.where("start > 0").isEmpty():
        begun = stage(_begun(ranges, begun, tasks), "csv-starts")
    return begun.repartition(tasks).mapInPandas(_each_range(_records), "path string, number long, record string")


def read_csv_ranges(spark: SparkSession, path: str, columns: list[str], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The records under the header as text columns, with ``_number`` from 0 in each file.

    Each record is parsed by Spark as one line of CSV; a wrong number of fields, or a header other than ``columns``, ends the job.
    """
    fields = ", ".join(f"`{c}` string" for c in columns)
    options = {"escape": '"', "mode": "FAILFAST", "maxCharsPerColumn": "-1"}
    # Parsed in a column of its own, and whole: a part of it would not tell a missing field.
    parsed = csv_records(spark, path, range_bytes).select("path", "number", F.from_csv("record", fields, options).alias("_fields"))
    return parsed.select("path", "number", "_fields").where(_is_row(columns)).select(
        (F.col("number") - 1).alias("_number"), *[F.col("_fields")[c].alias(c) for c in columns])


def _is_row(columns: list[str]) -> Column:
    """False for a header as expected, an error for another one."""
    same = F.lit(True)
    for c in columns:
        same = same & F.col("_fields")[c].eqNullSafe(F.lit(c))
    wrong = F.raise_error(F.concat(F.lit("CSV header of another form: "), F.col("path"))).cast("boolean")
    # All fields of every row are looked at, whatever columns are selected later.
    return F.when(F.col("number") > 0, F.col("_fields").isNotNull()).when(same, False).otherwise(wrong)
