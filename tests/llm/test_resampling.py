"""Importance resampling against plain loops over the texts."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from mailbench.llm.resampling import BucketFinder, bucket_counts, importance_resample, ranked, write_resampled

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ODD = ["", None, " \n", "One", "one_two", "É é ß #$ ñ1", "a b c " * 700, "x" * 5000, "it's A-Z 10,000\x00next", "word " * 30]


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute_features(text, max_n):
    words = WORD.findall(lowered(text))
    return [" ".join(words[i:i + n]) for n in range(1, max_n + 1) for i in range(len(words) - n + 1)]


def brute(docs, target, max_n=1, buckets=10_000, percent=10, min_words=20, seed=2024):
    def hashed(text):
        return [zlib.crc32(f.encode()) % buckets for f in brute_features(text, max_n)]

    s, t = (collections.Counter(b for text in texts for b in hashed(text)) for texts in ([x for _, x in docs], target))
    total_s, total_t = sum(s.values()), sum(t.values())
    out = []
    for key, text in docs:
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (total_s + buckets) / ((s[b] + 1) * (total_t + buckets)))) for b in hashed(text))
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([key, len(hashed(text)), weight, score, len(WORD.findall(lowered(text)))])
    order = sorted((x for x in out if x[4] >= min_words), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    ranks = {id(x): i + 1 for i, x in enumerate(order[:len(order) * percent // 100])}
    return sorted(((*x[:4], ranks.get(id(x))) for x in out), key=str)


def texts(seed, n):
    rng = np.random.default_rng(seed)
    return [" ".join("w%d" % min(w, 400) for w in rng.zipf(1.4, rng.integers(0, 90))) for _ in range(n)]


def frame(spark, docs):
    rows = [(k, t, 0, "x", 1.0) for k, t in docs]
    return spark.createDataFrame(rows, "doc_id long, text string, rank int, _id string, weight double").repartition(3)


@pytest.mark.parametrize("max_n, buckets", [(1, 10_000), (3, 97)])
def test_against_loops(spark, max_n, buckets):
    docs = list(enumerate([*ODD, *texts(1, 150)])) + [(None, "null key " * 20), (5, "repeated key " * 20)]
    target = [*texts(2, 8), None, ""]
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance_resample(frame(spark, docs), goal, max_n=max_n, buckets=buckets, percent=30)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, target, max_n, buckets, 30)


def test_blocks_do_not_change_features():
    sample = [t or "" for t in ODD] + texts(3, 20)
    for size in (1, 7, 64, 1 << 20):
        for max_n in (1, 2, 4):
            found = [collections.Counter() for _ in sample]
            singles = 0
            for owner, bucket, n_words in BucketFinder(max_n, 1 << 40, size).blocks(sample):
                singles += n_words
                for o, b in zip(owner.tolist(), bucket.tolist()):
                    found[o][b] += 1
            assert found == [collections.Counter(zlib.crc32(f.encode()) for f in brute_features(t, max_n)) for t in sample], (size, max_n)
            assert singles == sum(len(WORD.findall(lowered(t))) for t in sample)


def test_empty_tables(spark):
    nothing = spark.createDataFrame([], "doc_id long, text string")
    assert importance_resample(nothing, nothing).collect() == []
    docs = list(enumerate(texts(4, 40)))
    got = importance_resample(frame(spark, docs), nothing)
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, [])
    assert bucket_counts(nothing, "text", 1, 10).tolist() == [0] * 10


def test_a_row_repeated_often_is_no_single_range(spark):
    """Ranks are 1 to n whatever repeats, and repeated rows are spread over ranges."""
    rows = spark.range(4000).selectExpr("IF(id < 3000, 7, id) AS score", "id AS _row")
    out = ranked(rows, [rows.score.desc(), rows._row.asc()], "test").collect()
    assert sorted(r["rank"] for r in out) == list(range(1, 4001))
    by_rank = sorted(out, key=lambda r: r["rank"])
    assert [r["score"] for r in by_rank] == sorted((r["score"] for r in out), reverse=True)


def test_drawn_rows_are_written_whole(spark):
    docs = list(enumerate(texts(5, 80)))
    df = frame(spark, docs)
    got = importance_resample(df, spark.createDataFrame([("w1 w2",)], "text string"))
    keys = {r["doc_id"] for r in got.where("rank is not null").collect()}
    kept = write_resampled(df, "doc_id", got)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == keys and keys


def test_bad_parameters():
    with pytest.raises(ValueError):
        BucketFinder(0, 10)
