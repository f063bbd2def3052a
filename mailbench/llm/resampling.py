"""Target-distribution importance resampling over hashed word features, found in concatenated batches."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mailbench.llm.common import arrow_schema, slices, texts_of
from mailbench.session import parallelism, scratch_path, stage

BLOCK_BYTES = 1 << 22
WORDS_KEPT = 1 << 19
_LONGEST_KEPT = 32

# What the contract calls a word, on UTF-8 bytes with A-Z lowered; and a byte that is never in one.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_NO_WORD = re.compile(rb"[^0-9a-z\x80-\xff]")
SENTINEL = b"\0"


class BucketFinder:
    """Buckets of all runs of 1 to ``max_n`` words of a batch of texts, found in one buffer.

    The texts stand in one buffer with a sentinel between them.  One pass of the pattern over it finds
    all words, a binary search over the offsets of the texts tells whose they are, and runs whose first and last
    word belong to different texts are masked.  The buffer is worked on in blocks that end between words; the last
    words of a block are carried to the next, so that a text of any length takes bounded memory.
    """

    def __init__(self, max_n: int, buckets: int, block_bytes: int = BLOCK_BYTES):
        if max_n < 1 or buckets < 1:
            raise ValueError("max_n and buckets must be positive")
        self.max_n, self.buckets, self.block_bytes = max_n, buckets, block_bytes
        self.known: dict[bytes, int] = {}

    def _sums(self, words: list[bytes]) -> np.ndarray:
        """crc32 of each word; those of distinct words are remembered, up to a bound."""
        distinct = set(words)
        if len(self.known) > WORDS_KEPT:
            self.known.clear()
        new = distinct - self.known.keys()
        self.known.update(zip(new, map(zlib.crc32, new)))
        sums = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        for word in new:
            if len(word) > _LONGEST_KEPT:
                del self.known[word]
        return sums

    def blocks(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """Place of the text and bucket of each feature, and how many of them (the first ones) are single words."""
        encoded = [x.encode() for x in texts]
        offsets = np.cumsum([0, *(len(x) + len(SENTINEL) for x in encoded)])[:-1]
        data = SENTINEL.join(encoded).lower()  # of bytes: A-Z only
        start, carried, carried_owner = 0, [], np.zeros(0, np.int64)
        while start < len(data):
            edge = _NO_WORD.search(data, min(start + self.block_bytes, len(data)))
            stop = edge.start() if edge else len(data)
            found = list(WORD.finditer(data, start, stop))
            start = stop
            at = np.fromiter((m.start() for m in found), np.int64, len(found))
            words = carried + [m[0] for m in found]
            owner = np.append(carried_owner, np.searchsorted(offsets, at, side="right") - 1)
            before = len(carried)
            sums = self._sums(words)
            owners, buckets = [owner[before:]], [sums[before:] % self.buckets]
            for n in range(2, self.max_n + 1):
                # A run of n words: that of n - 1 words before, a space and the last word.
                tails = [b" " + w for w in words[n - 1:]]
                sums = np.fromiter(map(zlib.crc32, tails, sums[:len(tails)].tolist()), np.int64, len(tails))
                last = np.arange(n - 1, len(words))
                whole = (last >= before) & (owner[last] == owner[last - n + 1]) if len(last) else np.zeros(0, bool)
                owners.append(owner[last[whole]])
                buckets.append(sums[whole] % self.buckets)
            keep = min(self.max_n - 1, len(words))
            carried, carried_owner = words[len(words) - keep:], owner[len(owner) - keep:]
            yield np.concatenate(owners), np.concatenate(buckets), len(owner) - before


def bucket_counts(df: DataFrame, text: str, max_n: int, buckets: int) -> np.ndarray:
    """How many features of all texts fall in each bucket.  Tasks count for themselves; the driver gets a row per bucket."""
    schema = arrow_schema("bucket long, n long")

    def run(batches):
        finder, total = BucketFinder(max_n, buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            texts = texts_of(batch, "_text")
            for first, last in slices(texts):
                for _, bucket, _ in finder.blocks(texts[first:last]):
                    total += np.bincount(bucket, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], schema=schema)

    rows = df.select(F.col(text).alias("_text")).mapInArrow(run, "bucket long, n long")
    counts = np.zeros(buckets, np.int64)
    for bucket, n in rows.groupBy("bucket").agg(F.sum("n")).collect():
        counts[bucket] = n
    return counts


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A thousand times the log of how much likelier a bucket is in the target, rounded down."""
    size = len(raw)
    ratio = (target + 1.0) * (float(raw.sum()) + size) / ((raw + 1.0) * (float(target.sum()) + size))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def feature_weights(df: DataFrame, key: str, text: str, gains: np.ndarray, max_n: int) -> DataFrame:
    """``key, n_words, n_features, weight`` of every row: its features and the sum of their gains."""
    names = ("n_words", "n_features", "weight")

    def run(batches):
        finder = BucketFinder(max_n, len(gains))
        for batch in batches:
            texts = texts_of(batch, "_text")
            out = np.zeros((3, len(texts)), np.int64)
            for first, last in slices(texts):
                here = out[:, first:last]
                for owner, bucket, n_words in finder.blocks(texts[first:last]):
                    here[0] += np.bincount(owner[:n_words], minlength=last - first)
                    here[1] += np.bincount(owner, minlength=last - first)
                    np.add.at(here[2], owner, gains[bucket])
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out)], names=["_key", *names])

    kind = df.schema[key].dataType.simpleString()
    narrow = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    return narrow.mapInArrow(run, f"_key {kind}, " + ", ".join(f"{x} long" for x in names)).withColumnRenamed("_key", key)


def ranked(rows: DataFrame, order: list, name: str) -> DataFrame:
    """``rows`` with ``rank`` from 1 in the given order.

    Rows are dealt by ranges of the order and numbered within their range; what stands before a range is the sum of
    the earlier ranges' sizes, one row per range.  No task gets more than its range.
    """
    spark = rows.sparkSession
    dealt = rows.repartitionByRange(parallelism(spark), *order).sortWithinPartitions(*order)
    numbered = stage(dealt.withColumn("_place", F.monotonically_increasing_id()), name)
    range_, within = F.shiftright("_place", 33), F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = numbered.groupBy(range_.alias("_range")).agg(F.count("*").alias("_size"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    joined = numbered.withColumn("_range", range_).join(starts, "_range")
    return joined.withColumn("rank", F.col("_before") + within + 1).drop("_place", "_range", "_before")


def importance_resample(df: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text",
                        max_n: int = 1, buckets: int = 10_000, percent: int = 10, min_words: int = 20,
                        seed: int = 2024) -> DataFrame:
    """``key, n_features, weight, score, rank`` of every row of ``df``; the drawn rows have a rank.

    Features are runs of 1 to ``max_n`` words, hashed to ``buckets``.  A bucket's gain tells how much likelier it is
    among the features of ``target`` than among those of ``df``; ``weight`` is the sum over a row's features.  With a
    Gumbel number made of ``seed`` and key added, the rows of at least ``min_words`` words with the highest scores
    are a draw without replacement: ``percent`` of them, rounded down, ties to the smaller key.

    Every text is read whole, twice: to count and to weigh.  Null and empty texts have no features, weight 0
    and no rank; a null key is hashed as an empty one and ranks last among ties; repeated rows are drawn each for themselves
    (those equal in every column in any order); other columns are not read.  An empty table gives an empty result;
    an empty target counts as one in which all buckets are alike.
    """
    raw = bucket_counts(df, text, max_n, buckets)
    gains = bucket_gains(raw, bucket_counts(target, target_text, max_n, buckets))
    weighed = feature_weights(df.select(F.col(key).alias("_id"), F.col(text).alias("_text")), "_id", "_text", gains, max_n)
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_id").cast("string"), F.lit(""))), 256)
    uniform = (F.conv(F.substring(drawn, 1, 8), 16, 10).cast("long") + F.lit(0.5)) / F.lit(4294967296.0)
    gumbel = F.floor(F.lit(-1000.0) * F.log(-F.log(uniform)))
    # The row number keeps a row that is repeated often from being one range.
    scored = stage(weighed.select("*", (F.col("weight") + gumbel).alias("score"), F.monotonically_increasing_id().alias("_row")),
                   "resampling")
    eligible = F.col("n_words") >= min_words
    wanted = scored.where(eligible).count() * percent // 100
    order = [F.col("score").desc(), F.col("_id").asc_nulls_last(), F.col("_row").asc()]
    first = ranked(scored.where(eligible), order, "resampling-ranked")
    rank = F.when(F.col("rank") <= wanted, F.col("rank")).alias("rank")
    columns = [F.col("_id").alias(key), "n_features", "weight", "score"]
    rest = scored.where(~eligible).select(*columns, F.lit(None).cast("long").alias("rank"))
    return first.select(*columns, rank).union(rest)


def write_resampled(df: DataFrame, key: str, resampled: DataFrame) -> DataFrame:
    """The drawn rows of ``df`` in full, written to the shared folder and read back; a key drawn is taken with all its rows."""
    chosen = resampled.where("rank is not null").select(F.col(key).alias("_drawn")).distinct()
    rows = df.join(chosen, F.col(key).eqNullSafe(F.col("_drawn")), "left_semi")
    path = scratch_path(df.sparkSession, "resampled")
    rows.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def importance_resample_sql() -> str:
    """The query's rows for DuckDB: single words, 10 000 buckets, a tenth of the documents of 20 words."""
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    lowered = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH crc AS (SELECT list_transform(range(256), lambda x: list_reduce(range(8), lambda a, i:
    CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, x)) AS t),
raw AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({lowered}, '{word}') AS words FROM documents),
goal AS (SELECT unnest(regexp_extract_all({lowered}, '{word}')) AS word FROM benchmark),
one AS (SELECT r, unnest(words) AS word FROM raw),
hashed AS (SELECT word, xor(list_reduce(
      list_transform(range(length(hex(encode(word))) // 2), lambda i: ('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::BIGINT),
      lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) % 10000 AS bucket
    FROM (SELECT word FROM one UNION SELECT word FROM goal), crc),
s AS (SELECT bucket, count(*) AS n FROM one JOIN hashed USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM goal JOIN hashed USING (word) GROUP BY bucket),
gain AS (SELECT s.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT sum(n) FROM s) + 10000)::DOUBLE
      / ((s.n + 1)::DOUBLE * (coalesce((SELECT sum(n) FROM t), 0) + 10000)::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
weighed AS (SELECT r, sum(gain)::BIGINT AS weight FROM one JOIN hashed USING (word) JOIN gain USING (bucket) GROUP BY r),
scored AS (SELECT doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln(
      (('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
    FROM raw LEFT JOIN weighed USING (r)),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place FROM scored)
SELECT doc_id, n_features, weight, score,
  CASE WHEN n_features >= 20 AND place <= (SELECT count(*) FROM scored WHERE n_features >= 20) * 10 // 100 THEN place END AS rank
FROM placed"""
