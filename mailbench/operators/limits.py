"""Limits and samples, all in an explicit order.

Every operator here finds the last row wanted, in the order of one or two columns, and then filters on its
place.  How it is found reads the order columns at most twice, whatever n is:

* the first n + 1 places, kept per task and merged, where n is small;
* otherwise a sample of rows, one per random bucket, that gives two places surely around the one looked for; a second
  reading counts what is before them and at them, and writes what is between them, a few percent of the rows, order
  columns alone; a key that many rows share is not written.  The same is done with that table until it is small.  The
  sample only says where to look: counts are exact, and if the place should lie outside, the other side is read.

The steps run when the operator is called; what it returns is a plain comparison with a constant, which for a bare
key column reaches the file scan.  Where some but not all rows of the last place are wanted, those rows are written with
their number in their partition, and one constant tells how far they count: no task gathers them.  Put limits
on a source or on a staged table, not behind model calls, since the order columns are read several times.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import ceil, floor, sqrt
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from mailbench.session import stage

FEW = 4096  # places kept one by one
SMALL = 1 << 16  # rows whose places are counted one by one
BUCKETS = 1 << 14  # rows of a sample
SIGMAS = 6  # of the sample's error, on either side

Place = tuple[Any, ...]


class Cut(NamedTuple):
    """The last place wanted, and how many of its rows are; ``whole`` says that it is all of them."""

    place: Place
    rows: int
    whole: bool


def _names(width: int) -> list[str]:
    return [f"_o{i}" for i in range(width)]


def _sortable(place: Place) -> tuple:
    """Spark's order: nulls last, texts by their bytes."""
    return tuple((v is None, v.encode() if isinstance(v, str) else 0 if v is None else v) for v in place)


def _same(columns: Sequence[Column], place: Place) -> Column:
    return reduce(Column.__and__, (c.isNull() if v is None else c == F.lit(v) for c, v in zip(columns, place)))


def _before(columns: Sequence[Column], place: Place, or_same: bool = False) -> Column:
    """Rows that come before a place, or up to it.  A single column is compared plainly, so that files see it."""
    *head, column = columns
    last = place[-1]
    if last is None:
        here = F.lit(True) if or_same else column.isNotNull()
    else:
        here = (column <= F.lit(last)) if or_same else (column < F.lit(last))
    if not head:
        return here
    return _before(head, place[:-1]) | (_same(head, place[:-1]) & here)


def _counted(places: list[Place], n: int) -> Cut:
    """The cut after ``n`` of the first places, of which one more is known if there are more."""
    place = places[n - 1]
    rows = next(i for i in range(n + 1) if i == n or places[n - 1 - i] != place)
    return Cut(place, rows, len(places) == n or places[n] != place)


def _sampled(keys: DataFrame, names: list[str]) -> tuple[list[Place], int]:
    """One random row of each bucket of random rows, in order, and how many rows there are."""
    dealt = keys.select(*names, F.floor(F.rand() * BUCKETS).cast("int").alias("_bucket"), F.rand().alias("_draw"))
    rows = dealt.groupBy("_bucket").agg(F.count("*").alias("_n"), F.min_by(F.struct(*names), "_draw").alias("_row")).collect()
    return sorted((tuple(r["_row"]) for r in rows), key=_sortable), sum(r["_n"] for r in rows)


def _around(sample: list[Place], n: int, total: int) -> tuple[Place | None, Place | None]:
    """Two sampled places around rank ``n``; None where that may lie beyond the sample."""
    share = n / total
    at, error = share * len(sample), SIGMAS * sqrt(len(sample) * share * (1 - share)) + 2
    low, high = floor(at - error), ceil(at + error)
    return sample[low] if low >= 0 else None, sample[high] if high < len(sample) else None


class _Parts(NamedTuple):
    """Rows before the lower place, of it, between the two (written), and of the upper place."""

    before: int
    at_low: int
    between: int
    at_high: int
    written: DataFrame


def _parted(keys: DataFrame, names: list[str], low: Place | None, high: Place | None) -> _Parts:
    """Count the parts that two places make, and write the places strictly between them; one reading."""
    columns = [F.col(c) for c in names]

    def sure(condition: Column) -> Column:
        return F.coalesce(condition, F.lit(False))  # a comparison with a null key: that comes last

    nothing = F.lit(False)
    upto_low, below = (sure(_before(columns, low, same)) if low else nothing for same in (True, False))
    upto_high, under = (sure(_before(columns, high, same)) if high else F.lit(True) for same in (True, False))
    counts = [F.count_if(c).alias(name) for c, name in
              ((below, "before"), (upto_low, "upto_low"), (under, "under"), (upto_high, "upto_high"))]
    if low == (None,):  # nothing comes behind nulls, and Spark, which sees that, would count nothing on the way
        n, written = keys.agg(*counts).first(), keys.limit(0)
    else:
        seen = Observation()
        written = stage(keys.observe(seen, *counts).where(~upto_low & under), "places")
        n = seen.get
    return _Parts(n["before"], n["upto_low"] - n["before"], n["under"] - n["upto_low"], n["upto_high"] - n["under"], written)


def _nth(keys: DataFrame, n: int, from_end: bool = False) -> Cut | None:
    """The cut after the first ``n`` rows, or before the last ``n``; None if there are no more than that."""
    names = keys.columns
    if n < FEW:
        order = [F.col(c).desc_nulls_first() if from_end else F.col(c).asc_nulls_last() for c in names]
        places = list(map(tuple, keys.orderBy(*order).limit(n + 1).collect()))
        if len(places) < n + from_end:
            return None
        if not from_end:
            return _counted(places, n)
        # The row before the last n ends what is kept; of its place, those among the last n go.
        gone = sum(p == places[n] for p in places[:n])
        return Cut(places[n], -gone, not gone)
    sample, total = _sampled(keys, names)
    if from_end:
        n = total - n
        if n <= 0:
            return None
    elif total < n:
        return None
    while total > SMALL:
        low, high = _around(sample, n, total)
        parts = _parted(keys, names, low, high)
        if not parts.before < n <= parts.before + parts.at_low + parts.between + parts.at_high:
            # The sample misled.  Its ends are at least as far out as any place of it.
            beyond = (None, low) if n <= parts.before else (high, None)
            low, high = beyond
            parts = _parted(keys, names, low, high)
        n -= parts.before
        if n <= parts.at_low:
            return Cut(low, n, n == parts.at_low)
        n -= parts.at_low
        if n > parts.between:
            return Cut(high, n - parts.between, n == parts.between + parts.at_high)
        keys = parts.written
        sample, total = _sampled(keys, names)
    return _small(keys, n)


def _small(keys: DataFrame, n: int) -> Cut:
    """The cut among few rows, by counting every place."""
    upto = 0
    rows = keys.groupBy(*keys.columns).count().collect()
    for place, count in sorted(((tuple(r)[:-1], r["count"]) for r in rows), key=lambda x: _sortable(x[0])):
        if upto + count >= n:
            return Cut(place, n - upto, n == upto + count)
        upto += count
    raise ValueError("fewer rows than counted before: the source changed while it was read")


def _upto(df: DataFrame, order: Sequence[Column], cut: Cut) -> DataFrame:
    """The rows before a cut's place, and of its own as many as it says; minus some: all but those."""
    if cut.whole:
        return df.where(_before(order, cut.place, or_same=True))
    ties = stage(df.where(_same(order, cut.place)).withColumn("_place", F.monotonically_increasing_id()), "ties")
    part = F.shiftright("_place", 33)
    sizes = sorted(map(tuple, ties.groupBy(part.alias("part")).count().collect()))  # a row per partition that wrote some
    wanted = cut.rows if cut.rows > 0 else sum(n for _, n in sizes) + cut.rows
    edge = 0
    for number, size in sizes:
        edge = (number << 33) + min(wanted, size)
        wanted -= min(wanted, size)
        if not wanted:
            break
    taken = ties.where(F.col("_place") < edge).drop("_place")
    return df.where(_before(order, cut.place)).union(taken)


def _ordered(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    return df.select(*[c.alias(n) for c, n in zip(order, _names(len(order)))])


def _first(df: DataFrame, n: int, order: Sequence[Column]) -> DataFrame:
    cut = _nth(_ordered(df, order), n)
    return df if cut is None else _upto(df, order, cut)


def limit_rows(df: DataFrame, n: int | None, key: str = "email_id") -> DataFrame:
    """First ``n`` rows by ``key``; all rows for None and 0; all but the last ``-n`` if negative.

    Null keys come last.  Of rows with the last key wanted as many are taken as are wanted.
    """
    if not n:
        return df
    order = [F.col(key)]
    if n > 0:
        return _first(df, n, order)
    cut = _nth(_ordered(df, order), -n, from_end=True)
    return df.limit(0) if cut is None else _upto(df, order, cut)


def sample_rows(df: DataFrame, n: int | None, seed: int | str = 0, key: str = "email_id") -> DataFrame:
    """``n`` rows drawn without replacement, or all if there are fewer or ``n`` is None.

    Rows are ordered by a hash of seed and key: the same seed gives the same sample
    whatever the partitioning.
    """
    if n is None:
        return df
    if n < 0:
        raise ValueError("sample size must not be negative")
    if n == 0:
        return df.limit(0)
    drawn = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    return _first(df, n, [drawn, F.col(key)])


def head_by_class(
    df: DataFrame,
    n: int | None = 100,
    class_order: Sequence[int] = (1, 0),
    key: str = "path",
    label: str = "label",
) -> DataFrame:
    """First ``n`` rows (None: all), taking whole classes in ``class_order`` and keys in order within one.

    If the first class has ``n`` rows, the result holds that class only.
    """
    if n is not None and n <= 0:
        raise ValueError("n must be positive")
    known = df.where(F.col(label).isin(list(class_order)))
    if n is None:
        return known
    place = F.lit(None).cast("int")
    for i, value in reversed(list(enumerate(class_order))):
        place = F.when(F.col(label) == value, i).otherwise(place)
    return _first(known, n, [place, F.col(key)])
