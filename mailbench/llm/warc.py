"""WARC archives: writing with segments and revisits, and reassembly on reading."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailbench.llm.common import arrow_schema, open_shared, shared_folder, write_shared
from mailbench.session import stage

SEGMENT_BYTES = 32 << 10  # of a record's block
CHUNK_BYTES = 8 << 10  # of the chunked transfer framing
ARCHIVE_BYTES = 32 << 20
# Fixed values of the format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2000-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def frame_chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer framing (RFC 9112, section 7.1)."""
    parts = [b"%x\r\n%b\r\n" % (len(p), p) for p in (payload[i:i + size] for i in range(0, len(payload), size))]
    return b"".join(parts) + b"0\r\n\r\n"


def decode_chunked(body: bytes) -> bytes:
    """Undo the framing; chunk extensions and trailers are passed over.  Errors raise."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if len(body) < at + size + 2 or body[at + size:at + size + 2] != b"\r\n":
            raise ValueError("chunk cut short")
        out.append(body[at:at + size])
        at += size + 2


def split_http(block: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and body of an HTTP message."""
    head, _, body = block.partition(b"\r\n\r\n")
    fields = (line.partition(":") for line in head.decode("latin-1").split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, _, value in fields}, body


def payload_of(block: bytes) -> bytes:
    headers, body = split_http(block)
    return decode_chunked(body) if "chunked" in headers.get("transfer-encoding", "").lower() else body


def record(fields: dict[str, str], block: bytes) -> bytes:
    """One record in a gzip member of its own."""
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in fields.items()), b"Content-Length: %d" % len(block)]
    return gzip.compress(b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n", 1, mtime=0)


def page_records(page_id, url: str | None, payload: bytes | None, sha1: str, size: int, original, segment: int) -> Iterator[bytes]:
    """Records of a page: a revisit (no payload), a whole response, or a response with continuations."""
    own = f"<urn:page:{page_id}:{sha1}>"
    place = (url or "about:blank").replace("\r", "%0D").replace("\n", "%0A")
    common = {"WARC-Target-URI": place, "WARC-Date": _DATE, "WARC-Payload-Digest": f"sha1:{sha1}", "Content-Type": "application/http;msgtype=response"}
    if page_id is not None:
        common["Page-Id"] = str(page_id)
    if payload is None:
        # The head of the original answer, with the length of the body that is not repeated.
        head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
        yield record({"WARC-Type": "revisit", "WARC-Record-ID": own, **common, "WARC-Profile": REVISIT_PROFILE,
                      "WARC-Refers-To": f"<urn:page:{original}:{sha1}>"}, head)
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + frame_chunked(payload)
    parts = [block[i:i + segment] for i in range(0, len(block), segment)]
    for number, part in enumerate(parts, 1):
        if number == 1:
            more = {"WARC-Segment-Number": "1"} if len(parts) > 1 else {}
            yield record({"WARC-Type": "response", "WARC-Record-ID": own, **common, **more}, part)
        else:
            more = {"WARC-Segment-Total-Length": str(len(block))} if number == len(parts) else {}
            yield record({"WARC-Type": "continuation", "WARC-Record-ID": f"<urn:page:{page_id}:{sha1}:{number}>", "WARC-Date": _DATE,
                          "WARC-Target-URI": place, "WARC-Segment-Origin-ID": own, "WARC-Segment-Number": str(number), **more}, part)


def write_archives(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", folder: str | None = None,
                   segment_bytes: int = SEGMENT_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write one record (or chain of segments) per page; return the archives' ``uri``.

    Of pages with equal payloads the one with the largest key is the response, the others
    revisit it.  Payloads are compared by SHA-1 and length, counted before anything is shuffled; only
    one narrow row per digest meets the pages.  A task closes an archive at ``archive_bytes``, so that memory
    stays bounded.  Null html is an empty payload; null keys come before all others and rows
    repeated whole are written each.
    """
    folder = folder or shared_folder(pages.sparkSession, "warc")
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    rows = rows.withColumns({"sha1": F.unhex(F.sha1("html")), "size": F.octet_length("html").cast("long")})
    repeated = (rows.groupBy("sha1", "size").agg(F.max("page_id").alias("original"), F.count("*").alias("n"))
                .where("n > 1").select("sha1", "size", "original"))
    marked = rows.join(repeated, ["sha1", "size"], "left")
    revisit = F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))
    out = marked.select("page_id", "url", F.when(~revisit, F.col("html")).alias("html"), "sha1", "size", F.when(revisit, F.col("original")).alias("original"))
    schema = arrow_schema("uri string, records long")

    def run(batches):
        held, records, number = io.BytesIO(), 0, 0

        def close():
            nonlocal held, records, number
            uri = write_shared(folder, f"part-{number:04d}", held.getvalue())
            row = pa.RecordBatch.from_pylist([{"uri": uri, "records": records}], schema)
            held, records, number = io.BytesIO(), 0, number + 1
            return row

        for batch in batches:
            for page in batch.to_pylist():
                payload = None if page["html"] is None else page["html"].encode()
                sha1 = base64.b32encode(page["sha1"]).decode()
                for data in page_records(page["page_id"], page["url"], payload, sha1, page["size"], page["original"], segment_bytes):
                    held.write(data)
                    records += 1
                if held.tell() >= archive_bytes:
                    yield close()
        if records:
            yield close()

    return stage(out.mapInArrow(run, "uri string, records long"), "warc-archives")


def read_records(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of each record of a gzip or plain archive."""
    head = source.read(2)
    source.seek(0)
    stream = gzip.GzipFile(fileobj=source) if head == b"\x1f\x8b" else source
    stream = io.BufferedReader(stream, 1 << 20) if head == b"\x1f\x8b" else stream
    while True:
        line = stream.readline()
        while line == b"\r\n":
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record at {line[:40]!r}")
        fields = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8").partition(":")
            fields[name.strip().lower()] = value.strip()
        size = int(fields["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("record cut short")
        yield fields, block


PARTS = "origin string, number int, total long, kind string, http boolean, page_id long, url string, sha1 string, refers_to string, size long, block binary"
PAGES = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long, error string"


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """One row per record in the archives of ``archives.uri``, reassembled, of whatever type it is.

    HTTP framing is decoded where the content type is ``application/http``; of a request the payload is its body. Other blocks
    (resource, conversion, metadata, warcinfo) are payloads as they stand.

    Whole records are decoded where they are read.  Segments are grouped by their origin's id, sorted
    by number, joined, held against the total length, and decoded; one chain at a time is in memory.
    ``error`` says what is wrong with a chain (a missing segment, another total length, a digest
    that differs, broken framing); its other columns then hold what the first segment says.
    """
    parts_schema, pages_schema = arrow_schema(PARTS), arrow_schema(PAGES)

    def row_of(part, block, error):
        payload = None
        if part["kind"] not in ("revisit", "continuation") and not error:
            try:
                payload = payload_of(block) if part["http"] else block
                error = None if part["sha1"] in (None, digest(payload)) else "payload digest differs"
            except ValueError as e:
                error = str(e)
        refers = part["refers_to"]
        return {"page_id": part["page_id"], "url": part["url"], "payload": payload if payloads else None,
                "payload_bytes": part["size"] if payload is None else len(payload),
                "payload_digest": part["sha1"] if payload is None else digest(payload), "record_type": part["kind"],
                "refers_to": int(refers.split(":")[2]) if refers and refers.split(":")[2].lstrip("-").isdigit() else None, "error": error}

    def parse(batches):
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                out, held = [], 0
                with open_shared(uri) as file:
                    for fields, block in read_records(file):
                        kind = fields.get("warc-type")
                        number = int(fields.get("warc-segment-number", 0))
                        http = fields.get("content-type", "").lower().startswith("application/http")
                        size = int(split_http(block)[0].get("content-length", 0)) if kind == "revisit" else None
                        out.append(dict(zip(parts_schema.names, (
                            fields.get("warc-segment-origin-id", fields.get("warc-record-id")), number,
                            int(t) if (t := fields.get("warc-segment-total-length")) else None, kind, http,
                            int(p) if (p := fields.get("page-id")) else None, fields.get("warc-target-uri"),
                            fields.get("warc-payload-digest", "").removeprefix("sha1:") or None, fields.get("warc-refers-to"), size, block), strict=True)))
                        held += len(block)
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(out, parts_schema)
                            out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_pylist(out, parts_schema)

    def early(batches):
        """Decode what is whole; keep the blocks of segments alone."""
        for batch in parse(batches):
            rows = []
            for part in batch.to_pylist():
                if part["number"] or part["kind"] == "continuation":
                    rows.append({**part, "done": None})
                else:
                    rows.append({**part, "block": None, "done": row_of(part, part["block"], None)})
            yield pa.RecordBatch.from_pylist(rows, mid_schema)

    done_type = pa.struct(list(pages_schema))
    mid_schema = parts_schema.append(pa.field("done", done_type))
    mid = PARTS + ", done struct<" + ", ".join(f"{a}: {b}" for a, b in (x.split() for x in PAGES.split(", "))) + ">"

    def assemble(batches):
        chain: list[dict] = []

        def finish():
            heads = [p for p in chain if p["kind"] != "continuation"]
            segments = list({p["number"]: p for p in reversed(chain)}.values())[::-1]
            segments.sort(key=lambda p: p["number"])
            block, total = b"".join(p["block"] for p in segments), segments[-1]["total"]
            error = None
            if [p["number"] for p in segments] != list(range(1, len(segments) + 1)) or total is None:
                error = "segment missing"
            elif total != len(block):
                error = f"total length {total} but {len(block)} read"
            return [row_of(p, block, error) for p in heads or [{**segments[0], "kind": "continuation"}]]

        for batch in batches:
            rows = []
            for part in batch.to_pylist():
                if chain and part["origin"] != chain[0]["origin"]:
                    rows += finish()
                    chain = []
                chain.append(part)
            if rows:
                yield pa.RecordBatch.from_pylist(rows, pages_schema)
        if chain:
            yield pa.RecordBatch.from_pylist(finish(), pages_schema)

    files = archives.select("uri")
    tasks = max(1, min(archives.count(), 1 << 16))
    read = stage(files.repartition(tasks, "uri").mapInArrow(early, mid), "warc-records")
    chains = read.where("done IS NULL").drop("done").repartition("origin").sortWithinPartitions("origin", "number")
    return read.where("done IS NOT NULL").select("done.*").unionByName(chains.mapInArrow(assemble, PAGES))


def archive_round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to, error`` of every page, from its archive."""
    rows = read_archives(write_archives(pages, key, url, html), payloads=False)
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error")
