"""Packing of token pieces by patterns whose repeats non-negative least squares finds."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mailbench.llm.common import arrow_schema, byte_encoder, text_blocks
from mailbench.session import stage

ROUNDS = 300  # multiplicative steps of the least-squares fit
_BITS = 40  # of a rank within its length


def patterns(present: np.ndarray, size: int) -> np.ndarray:
    """All ways to fill ``size`` exactly with one, two or three of the lengths; rows, zeros behind."""
    held = np.zeros(size + 1, bool)
    held[present] = True
    rows = [np.array([[size, 0, 0]])] if held[size] else []
    small = present[present < size]
    two = small[(2 * small <= size) & held[size - small]]
    rows.append(np.stack([size - two, two, 0 * two], axis=1))
    for c in small[3 * small <= size]:
        b = small[(small >= c) & (2 * small <= size - c)]
        b = b[held[size - c - b]]
        rows.append(np.stack([size - c - b, b, np.full(len(b), c)], axis=1))
    return np.concatenate(rows).astype(np.int64) if rows else np.zeros((0, 3), np.int64)


def fit(table: np.ndarray, histogram: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Repeats x >= 0 of each pattern that minimise |Ax - histogram|, by multiplicative steps."""
    size = len(histogram) - 1

    def spread(x):  # A x
        total = np.zeros(size + 1)
        for k in range(3):
            total += np.bincount(table[:, k], weights=x, minlength=size + 1)
        total[0] = 0
        return total

    def gather(y):  # A' y
        y = y.copy()
        y[0] = 0
        return y[table].sum(axis=1)

    goal = histogram.astype(float)
    up = gather(goal)
    x = up / max(1.0, len(table))
    for _ in range(rounds):
        x *= up / np.maximum(gather(spread(x)), 1e-300)
    return x


def plan_packs(histogram: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Packs as (lengths, repeats) that use up a histogram of piece lengths (index = length).

    The fitted repeats are rounded with the remainder carried on, cut to the pieces there
    are, and what is left is packed best-fit by decreasing length, always on counts: the
    work depends on the pack size alone, not on the number of pieces.  Where one length is so
    frequent that too few others fill up its packs, leaving all to the second step can need
    fewer packs; then that plan counts.
    """
    plans = [_plan(histogram, fitted) for fitted in (True, False)]
    return min(plans, key=lambda plan: sum(times for _, times in plan))


def _plan(histogram: np.ndarray, fitted: bool) -> list[tuple[tuple[int, ...], int]]:
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    size = len(left) - 1
    packs: Counter = Counter()
    table = patterns(np.flatnonzero(left), size) if fitted else ()
    if len(table):
        repeats = np.diff(np.floor(np.append(0, np.cumsum(fit(table, left))) + 0.5)).astype(np.int64)
        for row, times in zip(table[repeats > 0].tolist(), repeats[repeats > 0].tolist(), strict=True):
            need = Counter(n for n in row if n)
            times = min(times, *(left[n] // k for n, k in need.items()))
            if times:
                packs[tuple(n for n in row if n)] += int(times)
                for n, k in need.items():
                    left[n] -= k * times
    # Open packs by free room; the keys of `room` stand sorted in `free`.
    room: dict[int, list] = {}
    free: list[int] = []

    def put(gap, lengths, times):
        if gap not in room:
            room[gap] = []
            insort(free, gap)
        room[gap].append((lengths, times))

    for n in range(size, 0, -1):
        count = int(left[n])
        while count:
            at = bisect_left(free, n)
            if at == len(free):
                each = size // n
                full, rest = divmod(count, each)
                if full:
                    put(size - each * n, (n,) * each, full)
                if rest:
                    put(size - rest * n, (n,) * rest, 1)
                break
            gap = free[at]
            lengths, times = room[gap].pop()
            if not room[gap]:
                del room[gap]
                free.pop(at)
            used = min(times, count)
            if times > used:
                put(gap, lengths, times - used)
            put(gap - n, (*lengths, n), used)
            count -= used
    for groups in room.values():
        for lengths, times in groups:
            packs[lengths] += times
    return sorted(packs.items())


def slots(packs: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (first key, sequence, offset): the key is a length and a rank among pieces of it."""
    taken: Counter = Counter()
    rows, sequence = [], 0
    for lengths, times in packs:
        offset = 0
        for n in lengths:
            rows.append(((n << _BITS) + taken[n], sequence, offset))
            taken[n] += times
            offset += n
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 3)


PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, rank long"


def cut_pieces(df: DataFrame, key: str, text: str, path: str, size: int, end_id: int) -> DataFrame:
    """Pieces of at most ``size`` ids of every text, each text with its end id.

    Only longer texts are cut; their first piece takes what does not fill a whole one.
    ``rank`` numbers the pieces of equal length within the task ``part``.
    """
    schema = arrow_schema(PIECE)

    def run(batches):
        from pyspark import TaskContext

        part, encoder = TaskContext.get().partitionId(), byte_encoder(path)
        seen = [0] * (size + 1)
        for names, texts in text_blocks(batches, "_text"):
            columns: list[list] = [[] for _ in schema.names]
            for name, raw in zip(names.to_pylist(), encoder.encode(texts), strict=True):
                ids = np.append(np.frombuffer(raw, encoder.dtype), end_id).astype("<u4")
                bounds = [0, *range((len(ids) - 1) % size + 1, len(ids) + 1, size)]
                for piece, (a, b) in enumerate(zip(bounds, bounds[1:])):
                    row = (name, piece, a, b - a, zlib.crc32(ids[a:b]), part, seen[b - a])
                    seen[b - a] += 1
                    for column, value in zip(columns, row, strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    narrow = df.select(F.col(key).cast("long").alias("_key"), F.col(text).alias("_text"))
    return narrow.mapInArrow(run, PIECE)


def pack_documents(df: DataFrame, key: str, text: str, path: str, size: int = 2048, end_id: int = 0) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` for every piece.

    Null and empty texts are one piece of the end id; repeated rows are pieces of their own;
    null keys stay null.  The driver sees the histogram of lengths (``size`` numbers) and sends
    out the plan, which is bounded by the number of patterns for that size.  The pieces are
    written once; a piece's place is its rank among all pieces of its length, found from the
    ranks within tasks and the tasks' counts, so no length is gathered in one place.
    """
    spark = df.sparkSession
    pieces = stage(cut_pieces(df, key, text, path, size, end_id), "pieces")
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    histogram = np.zeros(size + 1, np.int64)
    for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `size` rows
        histogram[row["length"]] = row["n"]
    plan = spark.sparkContext.broadcast(slots(plan_packs(histogram)))
    ahead = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["length", "part"])
    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    schema = arrow_schema(kinds)

    def place(batches):
        table = plan.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("nth").to_numpy()
            wanted = (length << _BITS) + rank
            at = np.searchsorted(table[:, 0], wanted, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in schema.names[:5]),
                 pa.array(table[at, 1] + wanted - table[at, 0]), pa.array(table[at, 2])], schema=schema)

    return ranked.select(*schema.names[:5], (F.col("base") + F.col("rank")).alias("nth")).mapInArrow(place, kinds)
