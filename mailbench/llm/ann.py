"""Approximate nearest neighbours by multi-index hashing of learned rotated binary codes."""

from __future__ import annotations

from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailbench.llm.common import arrow_schema

SAMPLE_ROWS = 4096  # for the rotations and the radius; every row is indexed
ROTATIONS = 6  # codes of as many times the dimension
SUBSTRING = 16  # bits
SHARD_ROWS = 1 << 17
LEAST_SHARD_ROWS = 1 << 12
SHARDS_MEANT = 64  # between these bounds
TARGET_RECALL = 0.98  # on the sample, where true neighbours are farther than among all rows
_QUERIES_AT_ONCE = 64


@dataclass
class Codes:
    """Learned rotations of centred vectors, and the Hamming radius that holds near neighbours."""

    mean: np.ndarray
    rotations: np.ndarray  # dimension x bits
    radius: int

    def encode(self, vectors: np.ndarray) -> np.ndarray:
        """Codes as rows of 16-bit substrings."""
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        bits = np.packbits((unit - self.mean) @ self.rotations > 0, axis=1)
        if bits.shape[1] % 2:
            bits = np.pad(bits, ((0, 0), (0, 1)))
        return np.ascontiguousarray(bits).view("<u2")


def distances(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision."""
    diff = vectors.astype(np.float64) - query.astype(np.float64)
    return np.sqrt(np.einsum("ij,ij->i", diff, diff))


def learn_codes(sample: np.ndarray, k: int = 10, rotations: int = ROTATIONS, recall: float = TARGET_RECALL, steps: int = 10) -> Codes:
    """Iterative quantisation from several random starts, and the radius that finds neighbours in the sample."""
    rng = np.random.default_rng(11)
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    mean = unit.mean(axis=0)
    centred, turns = unit - mean, []
    for _ in range(rotations):
        turn = np.linalg.qr(rng.standard_normal((sample.shape[1],) * 2))[0]
        for _ in range(steps):
            signs = np.where(centred @ turn > 0, 1.0, -1.0)
            u, _, v = np.linalg.svd(centred.T @ signs)
            turn = u @ v
        turns.append(turn)
    codes = Codes(mean, np.concatenate(turns, axis=1), 0)
    short, reach = codes.encode(sample), []
    for i in range(0, len(sample), max(1, len(sample) // 256)):
        near = distances(sample[i], sample)
        near[i] = np.inf
        best = np.argsort(near, kind="stable")[:k]
        reach.append(np.bitwise_count(short[best] ^ short[i]).sum(axis=1))
    reach = np.sort(np.concatenate(reach)) if reach else np.zeros(1, int)
    codes.radius = int(reach[min(len(reach) - 1, int(np.ceil(recall * len(reach))) - 1)])
    return codes


def flips(width: int, radius: int) -> np.ndarray:
    """All substrings with at most so many bits set."""
    values = np.arange(1 << width, dtype=np.uint32)
    return values[np.bitwise_count(values) <= radius].astype(np.uint16)


class MultiIndex:
    """One index per substring: the rows that hold each value, in order of the value."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, codes: Codes):
        self.ids, self.vectors, self.codes = ids, vectors, codes
        self.short = codes.encode(vectors)
        self.values, self.starts, self.rows = [], [], []
        for part in self.short.T:
            order = np.argsort(part, kind="stable").astype(np.int32)
            values, starts = np.unique(part[order], return_index=True)
            self.values.append(values)
            self.starts.append(np.append(starts, len(order)))
            self.rows.append(order)
        self._flips: dict[int, np.ndarray] = {}

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """All rows whose code differs in at most ``radius`` bits, and none else.

        If the bits differ in at most ``radius`` places, some substring differs in at most the
        radius divided by the number of substrings: those values are probed in each index.
        """
        each, found = radius // self.short.shape[1], np.zeros(len(self.ids), bool)
        if each >= SUBSTRING:
            found[:] = True
        else:
            few = sum(comb(SUBSTRING, i) for i in range(each + 1))
            for own, values, starts, rows in zip(code, self.values, self.starts, self.rows, strict=True):
                if few < len(values):  # probe value by value
                    if each not in self._flips:
                        self._flips[each] = flips(SUBSTRING, each)
                    probes = self._flips[each] ^ own
                    at = np.minimum(np.searchsorted(values, probes), len(values) - 1)
                    at = at[values[at] == probes]
                else:  # fewer values are there than probes: look at those
                    at = np.flatnonzero(np.bitwise_count(values ^ own) <= each)
                low, size = starts[at], starts[at + 1] - starts[at]
                found[rows[np.repeat(low - (np.cumsum(size) - size), size) + np.arange(size.sum())]] = True
        near = np.flatnonzero(found)
        return near[np.bitwise_count(self.short[near] ^ code).sum(axis=1) <= radius]

    def search(self, query_id: int, vector: np.ndarray, code: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of the k nearest found; the radius grows until k are found or all are."""
        radius, bits = self.codes.radius, 16 * self.short.shape[1]
        while True:
            near = self.within(code, radius)
            near = near[self.ids[near] != query_id]
            if len(near) >= k or radius >= bits:
                break
            radius += 16
        score = distances(vector, self.vectors[near])
        best = np.lexsort((self.ids[near], score))[:k]
        return self.ids[near][best], score[best]


def usable(vector: Column, dimension: int | None = None) -> Column:
    """Whether a vector takes part: all components there and finite, not all zero, of the dimension."""
    ok = F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    ok &= F.exists(vector, lambda x: x != 0)
    return ok if dimension is None else ok & (F.size(vector) == dimension)


def shard_count(n: int) -> int:
    """Shards for so many rows, whatever the cluster: a query's radius grows shard by shard, so other shards may find other neighbours."""
    return -(-n // min(SHARD_ROWS, max(LEAST_SHARD_ROWS, n // SHARDS_MEANT)))


def nearest(df: DataFrame, key: str, vector: str, is_query: Column, k: int = 10, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k nearest other rows, by Euclidean distance.

    Rows are dealt evenly to shards by a hash of the key, as many as their number alone says; each query visits every shard.  A task reads a
    shard's rows, builds its index, and then lets the shard's queries stream by: in memory
    are one shard of bounded size and one batch.  Rotations and radius are learned from
    ``sample_rows`` rows of the smallest hashes.  Rows are excluded from their own results by key; ties go to
    the smaller key.  Vectors that are null, zero, hold null or non-finite components, or differ in
    length from the most frequent one take no part, nor do null keys; rows of the same key are
    one candidate, the nearer one.  An empty table gives an empty result.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), is_query.alias("q"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("v")))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    kinds = "query_id long, vec_id long, score double"
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dimension, n = sizes["d"], sizes["count"]
    rows = rows.where(F.size("v") == dimension)
    sample = rows.select("v", F.xxhash64("id", F.lit(1)).alias("h")).orderBy("h").limit(sample_rows)
    codes = learn_codes(np.array([r["v"] for r in sample.collect()], np.float64), k)
    learned = spark.sparkContext.broadcast(codes)  # its size depends on the dimension alone
    shards = shard_count(n)
    data = rows.select(F.pmod(F.xxhash64("id"), F.lit(shards).cast("long")).alias("shard"), F.lit(False).alias("asks"), "id", "v")
    asking = rows.where("q").select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), F.lit(True).alias("asks"), "id", "v")
    schema = arrow_schema(kinds)

    def matrix(column) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension).astype(np.float64)

    def run(batches):
        codes, shard, index = learned.value, None, None
        ids: list[np.ndarray] = []
        vectors: list[np.ndarray] = []
        for batch in batches:
            of, asks = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((of[1:] != of[:-1]) | (asks[1:] != asks[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, len(of)]):
                if a == b:
                    continue
                own, vecs = batch.column(2).slice(a, b - a).to_numpy(), matrix(batch.column(3).slice(a, b - a))
                if of[a] != shard:
                    shard, index, ids, vectors = of[a], None, [], []
                if not asks[a]:
                    ids.append(own)
                    vectors.append(vecs.astype(np.float32) if np.array_equal(vecs.astype(np.float32), vecs) else vecs)
                    continue
                if index is None:
                    if not ids:  # no row fell to this shard
                        continue
                    index = MultiIndex(np.concatenate(ids), np.concatenate(vectors), codes)
                    ids, vectors = [], []
                for i in range(0, len(own), _QUERIES_AT_ONCE):
                    some, found = own[i:i + _QUERIES_AT_ONCE], []
                    for q, vec, code in zip(some, vecs[i:i + _QUERIES_AT_ONCE], codes.encode(vecs[i:i + _QUERIES_AT_ONCE]), strict=True):
                        found.append(index.search(q, vec, code, k))
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.repeat(some, [len(x) for x, _ in found])), pa.array(np.concatenate([x for x, _ in found])),
                        pa.array(np.concatenate([s for _, s in found]))], schema=schema)

    found = (data.unionByName(asking).repartition(shards, "shard").sortWithinPartitions("shard", "asks", "id").mapInArrow(run, kinds))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return (once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
