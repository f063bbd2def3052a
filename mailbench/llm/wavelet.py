"""Token ids as wavelet matrices: one compressed file per shard of consecutive documents."""

from __future__ import annotations

import io
import json
import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mailbench.llm.common import (
    arrow_schema, byte_encoder, open_shared, shared_folder, text_blocks, write_shared,
)
from mailbench.session import stage

MAGIC = b"WVMX0002"
BLOCK = 512  # bits per entry of the rank directory
FRAME_BYTES = 1 << 14  # of a plane, compressed by themselves
SHARD_TOKENS = 1 << 22


class WaveletMatrix:
    """A sequence of symbols as bit-planes, most significant bit first.

    Symbols are places in the shard's own sorted alphabet, so the planes are as many as the
    bits that its number of distinct ids needs.  On each plane the zeros move before the ones,
    in stable order.
    """

    def __init__(self, alphabet: np.ndarray, length: int, planes: list, zeros: list[int], ones_of=None):
        self.alphabet, self.length, self.planes, self.zeros = alphabet, length, planes, zeros
        self.ones_of = ones_of or (lambda depth: block_ones(self.planes[depth]))
        self.directory: list[np.ndarray | None] = [None] * len(planes)

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        seen = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
        alphabet = np.flatnonzero(seen)
        place = np.zeros(len(seen) or 1, np.uint32)
        place[alphabet] = np.arange(len(alphabet), dtype=np.uint32)
        symbols = place[ids]
        if len(alphabet) <= 1 << 16:
            symbols = symbols.astype(np.uint16)
        planes, zeros = [], []
        for level in reversed(range(max(len(alphabet) - 1, 0).bit_length())):
            ones = (symbols & symbols.dtype.type(1 << level)) != 0
            planes.append(np.packbits(ones, bitorder="little"))
            low, high = np.flatnonzero(~ones), np.flatnonzero(ones)  # places are taken several times faster than masks
            zeros.append(len(low))
            after = np.empty_like(symbols)
            np.take(symbols, low, out=after[:len(low)])
            np.take(symbols, high, out=after[len(low):])
            symbols = after
        return cls(alphabet, len(ids), planes, zeros)

    # Whole sequence

    def ids(self) -> np.ndarray:
        """All ids in order: each plane, from the last up, puts the symbols back in place."""
        symbols, kind = None, np.uint16 if len(self.planes) <= 16 else np.uint32
        for depth in reversed(range(len(self.planes))):
            ones = np.unpackbits(self.planes[depth][:], count=self.length, bitorder="little").view(bool)
            bit = kind(1 << len(self.planes) - 1 - depth)
            back = np.empty(self.length, kind)
            zeros = self.zeros[depth]
            back[np.flatnonzero(~ones)] = 0 if symbols is None else symbols[:zeros]
            back[np.flatnonzero(ones)] = bit if symbols is None else symbols[zeros:] | bit
            symbols = back
        if symbols is None:
            symbols = np.zeros(self.length, np.uint32)
        return self.alphabet[symbols] if self.length else np.zeros(0, np.int64)

    # Single places

    def _before(self, depth: int) -> np.ndarray:
        """Ones before each block of a plane, and in all."""
        if self.directory[depth] is None:
            self.directory[depth] = np.append(0, np.cumsum(self.ones_of(depth), dtype=np.int64))
        return self.directory[depth]

    def _bits(self, depth: int, block: int) -> np.ndarray:
        return np.unpackbits(self.planes[depth][block * BLOCK // 8:(block + 1) * BLOCK // 8], bitorder="little")

    def _rank1(self, depth: int, at: int) -> int:
        """Ones before ``at`` on a plane: the directory's entry and the bits after it."""
        block = at // BLOCK
        inside = self._bits(depth, block)[:at - block * BLOCK].sum() if at % BLOCK else 0
        return int(self._before(depth)[block]) + int(inside)

    def _select(self, depth: int, bit: int, k: int) -> int:
        """The place of the k-th such bit of a plane, from 0: its block by the directory, then its place there."""
        before = self._before(depth)
        if not bit:
            before = np.minimum(np.arange(len(before)) * BLOCK, self.length) - before
        block = int(np.searchsorted(before, k, side="right")) - 1
        return block * BLOCK + int(np.flatnonzero(self._bits(depth, block) == bit)[k - int(before[block])])

    def _bit(self, depth: int, at: int) -> int:
        return int(self.planes[depth][at >> 3]) >> (at & 7) & 1

    def access(self, at: int) -> int:
        """The id at a place."""
        if not 0 <= at < self.length:
            raise IndexError(at)
        symbol = 0
        for depth in range(len(self.planes)):
            bit, ones = self._bit(depth, at), self._rank1(depth, at)
            symbol = symbol << 1 | bit
            at = self.zeros[depth] + ones if bit else at - ones
        return int(self.alphabet[symbol])

    def _symbol(self, token: int) -> int:
        at = int(np.searchsorted(self.alphabet, token))
        return at if at < len(self.alphabet) and self.alphabet[at] == token else -1

    def _range(self, symbol: int, upto: int) -> tuple[int, int]:
        """Where the symbol's run starts on the last order, and where it ends for a prefix."""
        low, high = 0, upto
        for depth in range(len(self.planes)):
            a, b = self._rank1(depth, low), self._rank1(depth, high)
            if symbol >> len(self.planes) - 1 - depth & 1:
                low, high = self.zeros[depth] + a, self.zeros[depth] + b
            else:
                low, high = low - a, high - b
        return low, high

    def rank(self, token: int, upto: int) -> int:
        """How often the id is found before a place."""
        symbol = self._symbol(token)
        if symbol < 0:
            return 0
        low, high = self._range(symbol, min(max(upto, 0), self.length))
        return high - low

    def count(self, token: int) -> int:
        return self.rank(token, self.length)

    def select(self, token: int, k: int) -> int:
        """The place of the k-th occurrence, from 0; -1 if there are fewer."""
        symbol = self._symbol(token)
        if symbol < 0 or not 0 <= k < self.count(token):
            return -1
        at = self._range(symbol, 0)[0] + k
        for depth in reversed(range(len(self.planes))):
            bit = symbol >> len(self.planes) - 1 - depth & 1
            at = self._select(depth, bit, at - self.zeros[depth] if bit else at)
        return at


def block_ones(plane: np.ndarray) -> np.ndarray:
    """Ones in each block of a plane."""
    padded = np.zeros(-(-len(plane) * 8 // BLOCK) * BLOCK // 8, np.uint8)
    padded[:len(plane)] = plane[:]
    return np.bitwise_count(padded).reshape(-1, BLOCK // 8).sum(axis=1, dtype=np.uint16)


def write_shard(keys: list, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """File: magic, length of the head, head, then Zstandard frames, whose sizes the head tells.

    Frames are keys, lengths, alphabet, one rank directory per plane (ones per block of 512 bits), and the planes in
    pieces of 16 kB: a lookup reads the head, the directories and the pieces it touches.
    """
    matrix = WaveletMatrix.build(ids)
    parts = [json.dumps(keys).encode(), lengths.astype("<i8").tobytes(), matrix.alphabet.astype("<u4").tobytes(),
             *(block_ones(p).astype("<u2").tobytes() for p in matrix.planes),
             *(p[i:i + FRAME_BYTES].tobytes() for p in matrix.planes for i in range(0, len(p), FRAME_BYTES))]
    packer = zstandard.ZstdCompressor(1)
    packed = [packer.compress(p) for p in parts]
    head = packer.compress(json.dumps({
        "length": matrix.length, "zeros": matrix.zeros, "frame": FRAME_BYTES, "sizes": [*map(len, packed)]}).encode())
    out = io.BytesIO()
    out.write(MAGIC + struct.pack("<I", len(head)) + head)
    for p in packed:
        out.write(p)
    return out.getvalue()


class StoredPlane:
    """Bytes of a plane in a shard file; the pieces that are touched are read and kept."""

    def __init__(self, shard: ShardFile, first: int, size: int):
        self.shard, self.first, self.size, self.pieces = shard, first, size, {}

    def __len__(self) -> int:
        return self.size

    def _piece(self, i: int) -> np.ndarray:
        if i not in self.pieces:
            self.pieces[i] = np.frombuffer(self.shard.frame(self.first + i), np.uint8)
        return self.pieces[i]

    def __getitem__(self, at):
        step = self.shard.head["frame"]
        if not isinstance(at, slice):
            return self._piece(at // step)[at % step]
        low, high, _ = at.indices(self.size)
        pieces = [self._piece(i)[max(low - i * step, 0):high - i * step] for i in range(low // step, -(-high // step))]
        return pieces[0] if len(pieces) == 1 else np.concatenate(pieces) if pieces else np.zeros(0, np.uint8)


class ShardFile:
    """One shard, read as far as it is asked for; ``bytes_read`` counts that."""

    def __init__(self, file):
        self.file, self.bytes_read = file, 0
        if self._read(0, 8) != MAGIC:
            raise ValueError("not a wavelet shard")
        (size,) = struct.unpack("<I", self._read(8, 4))
        self.head = json.loads(zstandard.ZstdDecompressor().decompress(self._read(12, size)))
        self.starts = 12 + size + np.append(0, np.cumsum(self.head["sizes"], dtype=np.int64))

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        data = self.file.read(size)
        self.bytes_read += len(data)
        return data

    def frame(self, i: int) -> bytes:
        return zstandard.ZstdDecompressor().decompress(self._read(int(self.starts[i]), self.head["sizes"][i]))

    def keys(self) -> list:
        return json.loads(self.frame(0))

    def lengths(self) -> np.ndarray:
        return np.frombuffer(self.frame(1), "<i8")

    def matrix(self) -> WaveletMatrix:
        length, zeros = self.head["length"], self.head["zeros"]
        size = -(-length // 8)
        pieces = -(-size // self.head["frame"])
        planes = [StoredPlane(self, 3 + len(zeros) + depth * pieces, size) for depth in range(len(zeros))]
        return WaveletMatrix(np.frombuffer(self.frame(2), "<u4").astype(np.int64), length, planes, zeros,
                             lambda depth: np.frombuffer(self.frame(3 + depth), "<u2"))


def read_shard(data: bytes) -> tuple[list, np.ndarray, WaveletMatrix]:
    """Keys, tokens per key and the matrix of one file."""
    shard = ShardFile(io.BytesIO(data))
    return shard.keys(), shard.lengths(), shard.matrix()


MANIFEST = "task long, shard long, uri string, documents long, tokens long"


def write_token_shards(df: DataFrame, key: str, text: str, path: str, end_id: int,
                       folder: str | None = None, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode every text and write shards of consecutive keys; return their manifest.

    Keys are spread by ranges and sorted, so shard after shard holds ascending keys (nulls
    first, repeated keys together).  A shard is closed at ``shard_tokens``, or after a single
    longer text; memory is bounded by that.  Null texts are empty and hold the end id alone.
    ``task`` and ``shard`` order the shards; a task that is run again writes files of other names,
    and only those of the attempt that finished are listed.  Keys must be whole numbers.
    """
    folder = folder or shared_folder(df.sparkSession, "token-shards")
    schema = arrow_schema(MANIFEST)

    def run(batches):
        from pyspark import TaskContext

        task, encoder = TaskContext.get().partitionId(), byte_encoder(path)
        end = np.array([end_id], encoder.dtype).tobytes()
        keys, parts, held, shard = [], [], 0, 0

        def close():
            nonlocal keys, parts, held, shard
            lengths = np.array([len(p) // encoder.dtype.itemsize for p in parts], np.int64)
            data = write_shard(keys, lengths, np.frombuffer(b"".join(parts), encoder.dtype))
            uri = write_shared(folder, f"{task:06d}-{shard:04d}", data)
            row = [task, shard, uri, len(keys), int(lengths.sum())]
            keys, parts, held, shard = [], [], 0, shard + 1
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, row, strict=True))], schema)

        for names, texts in text_blocks(batches, "_text"):
            for name, ids in zip(names.to_pylist(), encoder.encode(texts), strict=True):
                size = len(ids) // encoder.dtype.itemsize + 1
                if keys and held + size > shard_tokens:
                    yield close()
                keys.append(name)
                parts.append(ids + end)
                held += size
        if keys:
            yield close()

    ordered = (df.select(F.col(key).cast("long").alias("_key"), F.col(text).alias("_text"))
               .repartitionByRange("_key").sortWithinPartitions("_key"))
    return stage(ordered.mapInArrow(run, MANIFEST), "token-manifest")


def read_token_shards(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the listed files.

    ``start`` counts the ids of all shards and documents before it: sums run over the shards of each writing
    task, and over one row per task.  The crc is that of the ids as little-endian 32-bit numbers.
    """
    ahead = Window.partitionBy("task").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    tasks_before = manifest.groupBy("task").agg(F.sum("tokens").alias("all")).select(
        "task", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("earlier"))
    placed = manifest.withColumn("own", F.coalesce(F.sum("tokens").over(ahead), F.lit(0))).join(tasks_before, "task").select(
        "uri", (F.col("earlier") + F.col("own")).alias("base"))
    out = arrow_schema("doc_id long, start long, n_tokens long, ids_crc32 long")

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                with open_shared(row["uri"]) as file:
                    keys, lengths, matrix = read_shard(file.read())
                ids = matrix.ids().astype("<u4")
                stops = np.cumsum(lengths)
                crc = [zlib.crc32(ids[b - n:b]) for b, n in zip(stops, lengths, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), pa.array(row["base"] + stops - lengths), pa.array(lengths), pa.array(crc, pa.int64())],
                    schema=out)

    # One shard is much work and few bytes: deal the rows out one by one.
    tasks = max(1, min(manifest.count(), 1 << 16))
    return placed.repartition(tasks, "uri").mapInArrow(run, ", ".join(f"{f.name} long" for f in out))


def lookup_tokens(manifest: DataFrame, tokens: list[int]) -> DataFrame:
    """``uri, token, occurrences, first_at, last_at`` from the files alone (-1: not found)."""
    out = arrow_schema("uri string, token long, occurrences long, first_at long, last_at long")

    def run(batches):
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                with open_shared(uri) as file:
                    matrix = ShardFile(file).matrix()
                    rows = [dict(zip(out.names, (uri, t, n := matrix.count(t), matrix.select(t, 0), matrix.select(t, n - 1)), strict=True)) for t in tokens]
                yield pa.RecordBatch.from_pylist(rows, out)

    return manifest.select("uri").mapInArrow(run, "uri string, token long, occurrences long, first_at long, last_at long")
