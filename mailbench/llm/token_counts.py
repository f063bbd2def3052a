"""Token counts by rank-synchronous merging of ragged numpy arrays."""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailbench.llm.common import ChunkCache, arrow_schema, kept, texts_of

# Fixed value: the byte-level pre-token pattern.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_symbols() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class RankMerger:
    """Merge table of a byte-level BPE file, applied to many sequences at once."""

    def __init__(self, path: str):
        import regex

        with open(path) as file:
            spec = json.load(file)
        model, vocab = spec["model"], spec["model"]["vocab"]
        pre = spec.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space", True) \
                or spec.get("normalizer") is not None:
            raise ValueError(f"{path}: not a plain byte-level BPE")
        self.first = np.array([vocab[c] for c in byte_symbols()], np.int64)
        self.size = max(vocab.values()) + 1
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        key = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks = key[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)  # by rank
        self.none = len(pairs)
        self.pattern = regex.compile(PRE_TOKEN)
        added = [a["content"] for a in spec.get("added_tokens") or []]
        if any(re.search(r"\s", a) for a in added):
            raise ValueError(f"{path}: added tokens with white space")
        self.added = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.cache = ChunkCache(self.chunk_counts)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], self.none)

    def surviving(self, tokens: list[bytes]) -> np.ndarray:
        """Symbols left in each pre-token once no pair can be merged."""
        lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        counts = lengths.copy()
        symbols = self.first[np.frombuffer(b"".join(tokens), np.uint8)]
        owner = np.repeat(np.arange(len(tokens)), lengths)
        while len(symbols) > 1:
            same = owner[1:] == owner[:-1]
            rank = np.where(same, self.rank_of(symbols[:-1], symbols[1:]), self.none)
            # The lowest rank in each sequence; the last symbol of one starts no pair.
            rank = np.append(rank, self.none)
            starts = np.flatnonzero(np.append(True, ~same))
            lowest = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(symbols)))
            alive = np.repeat(lowest < self.none, sizes)
            if not alive.all():
                counts[owner[starts[lowest == self.none]]] = sizes[lowest == self.none]
                if not alive.any():
                    return counts
            hit = alive & (rank == np.repeat(lowest, sizes))
            # In a run such as aaaa, every second pair from the left is merged.
            where = np.flatnonzero(hit)
            fresh = np.append(True, np.diff(where) > 1)
            run = np.repeat(where[fresh], np.diff(np.append(np.flatnonzero(fresh), len(where))))
            where = where[(where - run) % 2 == 0]
            symbols[where] = self.merged[rank[where]]
            alive[where + 1] = False
            symbols, owner = symbols[alive], owner[alive]
        counts[owner] = np.bincount(owner, minlength=len(tokens))[owner]
        return counts

    def chunk_counts(self, new: list[str]) -> list[int]:
        total, owner, tokens = np.zeros(len(new), np.int64), [], {}
        for i, chunk in enumerate(new):
            parts = [chunk]
            if self.added and self.added.search(chunk):
                parts = self.added.split(chunk)
                total[i] = len(parts) - 1
            for part in parts:
                for token in self.pattern.findall(part):
                    owner.append((i, tokens.setdefault(token.encode(), len(tokens))))
        if owner:
            at = np.array(owner, np.int64)
            np.add.at(total, at[:, 0], self.surviving(list(tokens))[at[:, 1]])
        return total.tolist()

    def count(self, texts: list[str]) -> list[int]:
        return [sum(values) for values in self.cache.values(texts)]


def token_counts(df: DataFrame, key: str, text: str, path: str, limit: int = 1024) -> DataFrame:
    """``key, n_bytes, n_tokens, over_limit`` for every row of ``df``.

    ``path`` names a byte-level BPE file in the tokenizers format.  Null texts count as empty
    (no tokens); special strings inside a text count as one token each; repeated rows and
    null keys are answered row by row; other columns are not read.  An empty table gives an
    empty result.  Memory is bounded by one batch of texts and the chunk cache.
    """
    schema = arrow_schema("n_bytes long, n_tokens long")

    def run(batches):
        merger = kept(("rank merger", path), lambda: RankMerger(path))
        for batch in batches:
            texts = texts_of(batch, "_text")
            columns = [pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array(merger.count(texts), pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["_key", *schema.names])

    narrow = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    kind = df.schema[key].dataType.simpleString()
    counted = narrow.mapInArrow(run, f"_key {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("_key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
