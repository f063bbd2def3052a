"""Nearest neighbours by brute force, and archives by round trip."""

import base64
import hashlib
import io
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from mailbench.llm.ann import MultiIndex, distances, learn_codes, nearest, shard_count
from mailbench.llm.common import write_shared, shared_folder
from mailbench.llm.warc import (
    archive_round_trip, decode_chunked, digest, frame_chunked, page_records, read_archives, read_records, record, write_archives,
)


def brute(ids, vectors, q, k=10):
    d = distances(vectors[q], vectors)
    d[ids == ids[q]] = math.inf
    best = np.lexsort((ids, d))[:k]
    return [(int(ids[i]), float(d[i])) for i in best if d[i] < math.inf]


def test_probing_finds_all_within_the_radius():
    rng = np.random.default_rng(1)
    vectors = rng.standard_normal((700, 12))
    codes = learn_codes(vectors)
    index = MultiIndex(np.arange(700), vectors, codes)
    for q in range(0, 700, 90):
        code = codes.encode(vectors[q:q + 1])[0]
        for radius in (0, 5, 17, codes.radius, 60, 200):
            want = np.flatnonzero(np.bitwise_count(index.short ^ code).sum(axis=1) <= radius)
            assert index.within(code, radius).tolist() == want.tolist()


def test_nearest(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((6, 16))
    vectors = (centres[rng.integers(0, 6, 9000)] + 0.8 * rng.standard_normal((9000, 16))).astype(np.float32)
    vectors[100:140] = vectors[100]  # ties
    rows = [(i, v.tolist(), 1.0) for i, v in enumerate(vectors)]
    bad = [(9100, None, 0.0), (9200, [0.0] * 16, 0.0), (9300, [1.0] * 15 + [None], 0.0), (9400, [1.0] * 15 + [math.nan], 0.0),
           (9500, [math.inf] + [1.0] * 15, 0.0), (9600, [1.0] * 8, 0.0), (None, [1.0] * 16, 0.0)]
    df = spark.createDataFrame([*rows, *bad, rows[300]], "vec_id long, embedding array<float>, score double")
    got = nearest(df, "vec_id", "embedding", F.col("vec_id") % 100 == 0).toPandas().sort_values(["query_id", "rank"])
    assert got.query_id.unique().tolist() == list(range(0, 9000, 100))
    ids, hits = np.arange(9000), 0
    for q, part in got.groupby("query_id"):
        want = brute(ids, vectors, q)
        assert part["rank"].tolist() == list(range(1, 11))
        assert part.score.tolist() == [pytest.approx(float(distances(vectors[q], vectors[v:v + 1])[0]), abs=0) for v in part.vec_id]
        assert list(zip(part.score, part.vec_id)) == sorted(zip(part.score, part.vec_id))
        hits += len({v for v, _ in want} & set(part.vec_id))
    assert hits / len(got) >= 0.95
    assert got[got.query_id == 100].vec_id.tolist() == list(range(101, 111))


def test_few_and_no_vectors(spark):
    few = spark.createDataFrame([(100 * i, [float(i + 1), 1.0]) for i in range(4)], "vec_id long, embedding array<double>")
    got = nearest(few, "vec_id", "embedding", F.col("vec_id") % 100 == 0)
    assert [tuple(r)[:3] for r in got.where("query_id = 0").orderBy("rank").collect()] == [(0, 1, 100), (0, 2, 200), (0, 3, 300)]
    assert got.count() == 12 and nearest(few.limit(0), "vec_id", "embedding", F.lit(True)).count() == 0


# Archives

PAYLOADS = ["", None, "<p>x</p>", "é☃" * 40000, "a" * 70000, "<p>x</p>", "", "\r\n0\r\n\r\nWARC/1.1\r\n", "<p>x</p>", "é☃" * 40000]


def pages(spark, payloads, extra=()):
    rows = [(i, f"http://h/{i}\r\nX: y" if i % 2 else None, p, "z") for i, p in enumerate(payloads)]
    return spark.createDataFrame([*rows, *extra], "page_id long, url string, html string, number string")


def test_chunked_framing():
    for payload in (b"", b"x", bytes(range(256)) * 100):
        assert decode_chunked(frame_chunked(payload, 999)) == payload
    assert decode_chunked(b"3;ext=1\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc"
    for broken in (b"5\r\nabc", b"3\r\nabcXX0\r\n\r\n", b"zz\r\n", b"3\r\nabc\r\n"):
        with pytest.raises(ValueError):
            decode_chunked(broken)


def test_round_trip(spark):
    got = archive_round_trip(pages(spark, PAYLOADS)).collect()
    data = [(p or "").encode() for p in PAYLOADS]
    last = {p: max(i for i, q in enumerate(data) if q == p) for p in data}
    want = [(i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if last[p] == i else "revisit", None if last[p] == i else last[p], None)
            for i, p in enumerate(data)]
    assert sorted(map(tuple, got)) == want
    assert archive_round_trip(pages(spark, PAYLOADS).limit(0)).count() == 0


def test_payloads_and_repeated_rows(spark):
    df = pages(spark, PAYLOADS, [(3, None, PAYLOADS[3], "z"), (None, None, "null key", "z")])
    archives = write_archives(df, segment_bytes=5000, archive_bytes=500)
    assert archives.count() > 2
    rows = read_archives(archives).collect()
    assert len(rows) == len(PAYLOADS) + 2 and all(r.error is None for r in rows)
    whole = {r.page_id: bytes(r.payload) for r in rows if r.record_type == "response"}
    assert whole[9] == PAYLOADS[9].encode() and whole[4] == b"a" * 70000 and whole[None] == b"null key"


def test_broken_chains_are_told(spark):
    data = b"y" * 9000
    first = list(page_records(1, "u", data, digest(data), len(data), None, 2500))
    second = list(page_records(2, "u", data + b"z", digest(data), len(data), None, 2500))
    other = record({"WARC-Type": "warcinfo", "WARC-Record-ID": "<x>"}, b"software: x\r\n")
    folder = shared_folder(spark, "test-warc")
    uris = [write_shared(folder, "a", b"".join([other, *first[:1], *first[2:]])), write_shared(folder, "b", b"".join(second)),
            write_shared(folder, "c", b"".join(page_records(3, "u", data, digest(data), 0, None, 2500)))]
    rows = {r.page_id: r for r in read_archives(spark.createDataFrame([(u,) for u in uris], "uri string")).collect()}
    assert rows[1].error == "segment missing" and rows[2].error == "payload digest differs" and bytes(rows[3].payload) == data
    with pytest.raises(ValueError):
        list(read_records(io.BytesIO(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nshort")))


def test_records_of_every_type(spark, tmp_path):
    """Resources and conversions, whole and in segments, requests, and a response that is no HTTP message."""
    http = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n3\r\nabc\r\n0\r\n\r\n"
    rows = [("warcinfo", "application/warc-fields", [b"software: x"]), ("resource", "text/plain", [b"one ", b"two ", b"three"]),
            ("conversion", "text/plain", [b"HTTP/1.1 is no head here\r\n\r\nx"]), ("response", "application/http; msgtype=response", [http[:30], http[30:]]),
            ("response", "text/dns", [b"dns answer"]), ("request", "application/http", [b"POST / HTTP/1.1\r\n\r\nbody"]), ("metadata", "", [b""])]
    data = b""
    for i, (kind, content, parts) in enumerate(rows):
        for number, part in enumerate(parts, 1):
            fields = {"WARC-Type": kind if number == 1 else "continuation", "WARC-Record-ID": f"<urn:x:{i}:{number}>", "Page-Id": str(i)}
            if content and number == 1:
                fields["Content-Type"] = content
            if len(parts) > 1:
                fields["WARC-Segment-Number"] = str(number)
                fields |= {"WARC-Segment-Origin-ID": f"<urn:x:{i}:1>"} if number > 1 else {}
                fields |= {"WARC-Segment-Total-Length": str(sum(map(len, parts)))} if number == len(parts) else {}
            data += record(fields, part)
    (tmp_path / "all.warc.gz").write_bytes(data)
    got = read_archives(spark.createDataFrame([(f"file://{tmp_path}/all.warc.gz",)], "uri string")).collect()
    found = {r["page_id"]: (r["record_type"], bytes(r["payload"] or b""), r["error"]) for r in got}
    assert found == {0: ("warcinfo", b"software: x", None), 1: ("resource", b"one two three", None), 2: ("conversion", rows[2][2][0], None),
                     3: ("response", b"abc", None), 4: ("response", b"dns answer", None), 5: ("request", b"body", None), 6: ("metadata", b"", None)}


def test_neighbours_do_not_hang_on_the_cluster(spark):
    """Shards follow from the number of rows alone."""
    rng = np.random.default_rng(8)
    rows = [(i, rng.standard_normal(16).tolist()) for i in range(9000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert shard_count(9000) == 3 and shard_count(1) == 1 and shard_count(10 ** 9) == 7630
    one = sorted(map(tuple, nearest(df, "vec_id", "embedding", F.col("vec_id") % 100 == 0).collect()))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        assert sorted(map(tuple, nearest(df.repartition(9), "vec_id", "embedding", F.col("vec_id") % 100 == 0).collect())) == one
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
