"""SimHash near-duplicates by pigeonring filtering."""

from __future__ import annotations

from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailbench.llm.common import arrow_schema, connected_components, texts_of
from mailbench.session import stage

SEGMENTS = 16  # of four bits, on a ring
_SHINGLES_AT_ONCE = 1 << 16
_PAIRS_AT_ONCE = 1 << 20


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """64 bits, each 1 if set in over half the XXH64 values of the text's word shingles.

    A-Z are lowered; words are what stands between ASCII white space; repeated shingles
    count each time; fewer words than ``width`` are one shingle; no words give 0.
    """
    import xxhash

    words = (text or "").encode().lower().split()  # of bytes: ASCII letters, ASCII white space
    if not words:
        return 0
    rows = zip(*(words[i:] for i in range(width))) if len(words) >= width else [words]
    hashes = map(xxhash.xxh64_intdigest, map(b" ".join, rows), iter(lambda: seed, None))
    total, bits = 0, np.zeros(64, np.int64)
    while len(block := np.fromiter(islice(hashes, _SHINGLES_AT_ONCE), np.uint64)):
        total += len(block)
        bits += np.unpackbits(block.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        if len(block) < _SHINGLES_AT_ONCE:
            break
    return int(np.packbits(2 * bits > total, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, key: str, text: str, width: int = 3, seed: int = 42) -> DataFrame:
    """``doc_id, fp``: the fingerprint of each whole text, as a signed long.  Null texts have no words."""
    schema = arrow_schema("doc_id long, fp long")

    def run(batches):
        for batch in batches:
            found = np.array([fingerprint(x, width, seed) for x in texts_of(batch, "_text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], schema=schema)

    narrow = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("_text"))
    return narrow.mapInArrow(run, "doc_id long, fp long")


def chain_lengths(radius: int) -> tuple[int, int]:
    """Segments in a row that a chain within budget holds unchanged, and with at most one change.

    A chain of n segments may differ in at most floor(n * radius / SEGMENTS) bits.
    """
    budget = [n * radius // SEGMENTS for n in range(SEGMENTS + 1)]
    return budget.index(1) - 1 if radius else SEGMENTS, (budget.index(2) - 1) if radius > 1 else SEGMENTS


def ring_keys(fps: np.ndarray, radius: int) -> list[np.ndarray]:
    """Index keys so that two fingerprints within the radius share at least one.

    On a ring of segments with at most ``radius`` differing bits in all, some start has every
    prefix chain within its budget: first segments without a difference, then a stretch with
    at most one, so that one half of that stretch has none.  A key is the start, the half, the first
    segments and that half.
    """
    exact, once = chain_lengths(radius)
    first, stretch = 4 * exact, 4 * (once - exact)
    half = stretch // 2
    keys = []
    for start in range(SEGMENTS):
        turn = np.uint64(4 * start)
        ring = fps >> turn | fps << np.uint64((64 - 4 * start) % 64) if start else fps
        head = ring & np.uint64((1 << first) - 1)
        for which, (low, width) in enumerate(((first, half), (first + half, stretch - half))):
            part = ring >> np.uint64(low) & np.uint64((1 << width) - 1)
            tag = np.uint64(2 * start + which)
            keys.append(((head << np.uint64(width) | part) << np.uint64(5) | tag).view(np.int64))
    return keys


def within(left: np.ndarray, right: np.ndarray, start: int, radius: int) -> np.ndarray:
    """Pairs whose chains from ``start`` stay within their budgets; the last chain is the whole ring."""
    diff = left ^ right
    ok = np.ones(diff.shape, bool)
    done = np.zeros(diff.shape, np.uint8)
    for n in range(1, SEGMENTS + 1):
        at = np.uint64(4 * ((start + n - 1) % SEGMENTS))
        done += np.bitwise_count(diff >> at & np.uint64(15))
        ok &= done <= n * radius // SEGMENTS
        if not ok.any():
            break
    return ok


def spanning_links(fps: np.ndarray, start: int, radius: int) -> tuple[list, list]:
    """Links that keep connected what is connected within one bucket, one less than its members at most.

    Breadth first over those not reached yet, so that a bucket of near copies takes one pass.
    """
    left, right = [], []
    open_, front = fps[1:], fps[:1]
    while len(open_):
        if not len(front):
            front, open_ = open_[:1], open_[1:]
            continue
        some = front[:max(1, _PAIRS_AT_ONCE // max(len(open_), 1))]
        front = front[len(some):]
        near = within(some[:, None], open_[None, :], start, radius)
        reached = near.any(axis=0)
        left.append(some[near.argmax(axis=0)[reached]])
        right.append(open_[reached])
        front = np.concatenate([front, open_[reached]])
        open_ = open_[~reached]
    return left, right


def fingerprint_links(distinct: DataFrame, radius: int = 3) -> DataFrame:
    """``a, b``: links between distinct fingerprints ``fp`` that connect all within the radius.

    Each fingerprint is dealt to 32 buckets by its ring keys.  A task reads its buckets sorted,
    one at a time; a bucket holds distinct fingerprints with 30 equal bits, as numbers.
    """
    if not 1 <= radius <= 5:
        raise ValueError("the keys are meant for a radius from 1 to 5")
    keyed, linked = arrow_schema("key long, fp long"), arrow_schema("a long, b long")

    def deal(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            for keys in ring_keys(fps, radius):
                yield pa.RecordBatch.from_arrays([pa.array(keys), batch.column(0)], schema=keyed)

    def link(batches):
        held_keys, held = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def closed(keys, fps):
            cuts = np.flatnonzero(np.diff(keys)) + 1
            starts, stops = np.append(0, cuts), np.append(cuts, len(keys))
            left, right = [], []
            two = starts[stops - starts == 2]
            for start in range(SEGMENTS):  # most buckets with partners hold two: all at once
                at = two[(keys[two] & 31) >> 1 == start]
                a, b = fps[at].view(np.uint64), fps[at + 1].view(np.uint64)
                ok = within(a, b, start, radius)
                left.append(a[ok])
                right.append(b[ok])
            for i in np.flatnonzero(stops - starts > 2):
                more = spanning_links(fps[starts[i]:stops[i]].view(np.uint64), int(keys[starts[i]] & 31) >> 1, radius)
                left += more[0]
                right += more[1]
            a, b = np.concatenate(left).view(np.int64), np.concatenate(right).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=linked)

        for batch in batches:
            if not batch.num_rows:
                continue
            held_keys = np.append(held_keys, batch.column(0).to_numpy())
            held = np.append(held, batch.column(1).to_numpy())
            whole = np.searchsorted(held_keys, held_keys[-1])  # the last bucket may go on
            if whole:
                yield closed(held_keys[:whole], held[:whole])
                held_keys, held = held_keys[whole:], held[whole:]
        if len(held):
            yield closed(held_keys, held)

    dealt = distinct.select("fp").mapInArrow(deal, "key long, fp long")
    sorted_ = dealt.repartition("key").sortWithinPartitions("key", "fp")
    return sorted_.mapInArrow(link, "a long, b long").distinct()


def simhash_components(df: DataFrame, key: str, text: str, radius: int = 3) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``df``.

    Fingerprints of at most ``radius`` differing bits are linked; ``component_id`` is the smallest
    key reachable over links.  Equal fingerprints are one node, so copies are never paired.
    Null and empty texts have fingerprint zero, linked like any other; repeated rows repeat;
    null keys keep their row and never name a component, which is null if nothing else is in it.
    """
    rows = stage(fingerprints(df, key, text), "fingerprints")
    nodes = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-nodes")
    found = connected_components(fingerprint_links(nodes, radius), "simhash")
    placed = nodes.join(found, nodes.fp == found.node, "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component"))
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    named = placed.join(least, "component").select(F.col("fp").alias("_fp"), "component_id")
    return rows.join(named, F.col("fp") == F.col("_fp")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
