"""Shared helpers: worker state, shared files, chunked tokenizing, connected components."""

from __future__ import annotations

import json
import posixpath
import re
import sys
import types
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailbench.session import scratch_path, stage

# Fixed value: what the contracts call a word, as a Java pattern.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Column names that ``df`` does not have, as near to the wanted ones as possible."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


FIRST_OWN_KEY = 1 << 62


def with_own_key(df: DataFrame, key: str, name: str) -> DataFrame:
    """``df`` with a column ``name`` that tells its rows apart: the key where it does, else a number beyond all keys.

    Numbers start at 2 ** 62; keys of that size are replaced, too, and nulls and repeated keys.  Verdicts that are joined by it
    are those of the very row, whatever the keys are.  If any key has to be replaced, the rows are written with their numbers;
    the keys to replace are written first, so that their size is known to the join.
    """
    own, bad = F.col(key).cast("long"), free_names(df, "_replaced")[0]
    unfit = F.col("n").cast("long") > 1
    often = df.groupBy(own.alias(bad)).agg(F.count("*").alias("n")).where(unfit | F.col(bad).isNull() | (F.col(bad) >= FIRST_OWN_KEY))
    replaced = stage(often.select(bad), "replaced-keys")
    if replaced.isEmpty():
        return df.withColumn(name, own)
    met = df.join(replaced, own == F.col(bad), "left")
    numbered = F.when(own.isNotNull() & F.col(bad).isNull(), own).otherwise(F.lit(FIRST_OWN_KEY) + F.monotonically_increasing_id())
    return stage(met.select(*[F.col(c) for c in df.columns], numbered.alias(name)), "own-keys")


def worker_state() -> dict:
    """What one Python worker keeps from task to task.

    Functions travel with the job, so their globals are new in each task; a module
    of its own is not.
    """
    module = sys.modules.setdefault("mailbench_worker_state", types.ModuleType("mailbench_worker_state"))
    return module.__dict__.setdefault("kept", {})


def kept(key: tuple, make):
    """``make()`` once per worker and key."""
    state = worker_state()
    if key not in state:
        state[key] = make()
    return state[key]


# Files in the shared folder


def shared_folder(spark: SparkSession, name: str) -> str:
    """URI of a new folder below the shared one."""
    return scratch_path(spark, name)


def write_shared(folder: str, name: str, data: bytes) -> str:
    """Write one file whose name no other attempt uses; return its URI.

    Only names that a finished task returns are ever read, so files of lost or
    repeated attempts do no harm.
    """
    store, path = pafs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    own = f"{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(posixpath.join(path, own)) as out:
        out.write(data)
    return f"{folder}/{own}"


def open_shared(uri: str):
    """Random-access file."""
    store, path = pafs.FileSystem.from_uri(uri)
    return store.open_input_file(path)


def arrow_schema(ddl: str) -> pa.Schema:
    """Arrow schema of a short DDL string: long, int, string, binary, boolean, double."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(),
             "boolean": pa.bool_(), "double": pa.float64(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (part.split() for part in ddl.split(", "))])


def slices(texts: list[str], characters: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about so many characters, or of one longer text.

    A batch has a fixed number of rows, however long they are; work on words takes many times their size.
    """
    yield from slices_by(map(len, texts), characters)


def slices_by(sizes: Iterable[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours whose sizes add up to at most so much, or of one that is larger."""
    start = held = stop = 0
    for i, size in enumerate(sizes):
        if held and held + size > most:
            yield start, i
            start, held = i, 0
        held, stop = held + size, i + 1
    if start < stop:
        yield start, stop


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    return [x or "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]


TEXTS_AT_ONCE = 1 << 23  # bytes of text that are encoded together


def text_blocks(batches: Iterable[pa.RecordBatch], column: str) -> Iterator[tuple[pa.Array, pa.StringArray]]:
    """First column and texts of neighbouring batches, put together to about ``TEXTS_AT_ONCE`` bytes; nulls are empty."""
    held, size = [], 0
    for batch in batches:
        texts = pc.fill_null(batch.column(batch.schema.get_field_index(column)), "").cast(pa.string())
        held.append((batch.column(0), texts))
        size += texts.nbytes
        if size >= TEXTS_AT_ONCE:
            yield tuple(pa.concat_arrays(x) for x in zip(*held))
            held, size = [], 0
    if held:
        yield tuple(pa.concat_arrays(x) for x in zip(*held))


# Byte-level tokenizing

# A space followed by something else than white space: a place where no pre-token crosses.
_GAP = re.compile(r" (?=\S)")
# Anything but single spaces and single line ends between words.
_ODD_SPACE = re.compile(r"\s\s|[^\S \n]|\A\s|\s\Z|\x00")
# One word and no other white space than a space before it.
_PLAIN_ARROW = r"\A ?[^\x00\n \t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+\z"
_LONGEST_KEPT = 64
_STOPS = ".,;:!?"


def chunks(text: str) -> list[str]:
    """Cut where byte-level pre-tokens always end; the parts join to the text.

    Pre-tokens take one leading space and never go on after a word, so a cut before a
    space that a word follows changes no token; nor do cuts around a lone line end.
    """
    if _ODD_SPACE.search(text) is None:
        return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
    first, *others = _GAP.split(text)
    return [first, *(" " + x for x in others)]


class ChunkCache:
    """Answers per chunk of text; repeated chunks are answered once.

    ``answer(list of chunks)`` gives one value each.  The memory is bounded: it is
    emptied at ``entries``, and long chunks are not kept.
    """

    def __init__(self, answer, entries: int = 1 << 20):
        self.answer, self.entries, self.known = answer, entries, {}

    def values(self, texts: list[str]) -> Iterator[Iterator]:
        """For each text the values of its chunks, to be used before the next text's."""
        for start, stop in slices(texts):
            yield from self._values(texts[start:stop])

    def _values(self, texts: list[str]) -> Iterator[Iterator]:
        cut = [chunks(x) for x in texts]
        if len(self.known) > self.entries:
            self.known.clear()
        known = self.known
        new = list(set().union(*cut) - known.keys())
        for chunk, value in zip(new, self.answer(new), strict=True):
            known[chunk] = value
        for parts in cut:
            yield map(known.__getitem__, parts)
        for chunk in new:
            if len(chunk) > _LONGEST_KEPT:
                del known[chunk]


# As _ODD_SPACE, for Arrow's regular expressions, which know ASCII white space only by that name.
_ODD_SPACE_ARROW = (r"[\x00\t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
                    r"|[ \n][ \n]|\A[ \n]|[ \n]\z")


def chunk_lists(texts: pa.StringArray) -> pa.ListArray:
    """The :func:`chunks` of each text."""
    odd = pc.match_substring_regex(texts, _ODD_SPACE_ARROW)
    marked = pc.replace_substring(pc.replace_substring(texts, " ", "\0 "), "\n", "\0\n\0")
    plain = pc.split_pattern(marked, "\0")
    if not pc.any(odd).as_py():
        return plain
    slow = pa.array([chunks(x) for x in texts.filter(odd).to_pylist()], pa.list_(pa.string()))
    where = pc.if_else(odd, pc.add(pc.cumulative_sum(odd.cast(pa.int64())), len(texts) - 1), pa.array(np.arange(len(texts))))
    return pa.concat_arrays([plain, slow]).take(where)


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of all runs that start at ``starts`` and are ``sizes`` long, one run after the other."""
    stops = np.cumsum(sizes)
    at = np.repeat(starts - (stops - sizes), sizes)
    at += np.arange(len(at))
    return at


class ByteEncoder:
    """Token ids of whole texts by the tokenizers library, as bytes of ``dtype``.

    With the plain byte-level pre-tokenizer, distinct chunks go through the library once: their ids stand one after the other in one
    array, and a text's ids are gathered from there by its chunks' places.  Cutting, telling chunks apart and gathering
    are array operations; Python sees new chunks only.  The memory is bounded: the array is emptied at ``entries`` chunks,
    and long chunks are not kept.  Any other tokenizer file gets whole texts.
    """

    def __init__(self, path: str, entries: int = 1 << 21):
        from tokenizers import Tokenizer

        self.tokenizer, self.entries = Tokenizer.from_file(path), entries
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        with open(path) as file:
            spec = json.load(file)
        pre = spec.get("pre_tokenizer") or {}
        added = spec.get("added_tokens") or []
        self.by_chunk = (
            pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)
            and spec.get("normalizer") is None
            and not any(re.search(r"\s", a["content"]) or a["lstrip"] or a["rstrip"] or a["single_word"] for a in added)
        )
        self.line_end = self.tokenizer.token_to_id("Ċ")
        self.added = [a["content"] for a in added]
        self._empty()

    def _empty(self) -> None:
        self.known = pa.array([], pa.string())
        self.ids, self.starts, self.sizes = np.zeros(0, self.dtype), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, self.dtype) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _special(self, texts: pa.StringArray) -> pa.BooleanArray:
        """Whether special strings are in texts."""
        found = pa.array(np.zeros(len(texts), bool))
        for special in self.added:
            found = pc.or_(found, pc.match_substring(texts, special))
        return found

    def _unit_ids(self, units: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of texts in a row, where each one's start, and how many they are.

        Plain texts travel joined by line ends, whose id then parts them again.
        """
        joinable = pc.and_not(pc.match_substring_regex(units, _PLAIN_ARROW), self._special(units)).to_numpy(zero_copy_only=False)
        plain, rest = np.flatnonzero(joinable & (self.line_end is not None)), np.flatnonzero(~joinable | (self.line_end is None))
        words = units.take(pa.array(plain)).to_pylist()
        found, order, sizes, single = [np.zeros(0, self.dtype)], [], np.zeros(len(units), np.int64), [rest]
        groups = range(0, len(plain), 64)
        for i, ids in zip(groups, self._library(["\n".join(words[i:i + 64]) for i in groups]), strict=True):
            group, ends = plain[i:i + 64], np.flatnonzero(ids == self.line_end)
            if len(ends) == len(group) - 1:
                sizes[group] = np.diff(ends, prepend=-1, append=len(ids)) - 1
                found.append(np.delete(ids, ends))
                order.append(group)
            else:
                single.append(group)
        rest = np.concatenate(single)
        for i, ids in zip(rest, self._library(units.take(pa.array(rest)).to_pylist()), strict=True):
            sizes[i] = len(ids)
            found.append(ids)
        order = np.concatenate([*order, rest]).astype(np.int64)
        starts = np.zeros(len(units), np.int64)
        starts[order] = np.cumsum(sizes[order]) - sizes[order]
        return np.concatenate(found), starts, sizes

    def _add(self, new: pa.StringArray) -> None:
        """Put chunks in the table.  Stops and commas behind a letter are pre-tokens of their own: each word goes through the library without."""
        if not len(new):
            return
        words = pc.utf8_rtrim(new, _STOPS)
        words = pc.if_else(pc.and_not(pc.match_substring_regex(words, r"\pL\z"), self._special(new)), words, new)
        cut = pc.not_equal(pc.binary_length(words), pc.binary_length(new))
        stops = pc.replace_substring_regex(new.filter(cut), r"(?s)\A.*?([" + _STOPS + r"]*)\z", r"\1")
        tails = pc.replace_with_mask(pa.array([""] * len(new), pa.string()), cut, stops)
        units = pa.concat_arrays([words, tails]).dictionary_encode()
        pairs = units.indices.to_numpy().reshape(2, -1).T
        ids, starts, sizes = self._unit_ids(units.dictionary)
        own = sizes[pairs].sum(axis=1)
        self.starts = np.append(self.starts, len(self.ids) + np.cumsum(own) - own)
        self.sizes = np.append(self.sizes, own)
        self.ids = np.append(self.ids, ids[ragged(starts[pairs].ravel(), sizes[pairs].ravel())])
        self.known = pa.concat_arrays([self.known, new])

    def _gathered(self, texts: pa.StringArray) -> Iterator[bytes]:
        """Ids of each text.  Texts are cut some at a time, of which chunk numbers are left; the chunks of all are looked up together."""
        if len(self.known) > self.entries:
            self._empty()
        named, counts = [], []
        for start, stop in slices_by(pc.binary_length(texts).to_numpy(), TEXTS_AT_ONCE // 4):
            lists = chunk_lists(texts.slice(start, stop - start))
            named.append(lists.flatten().dictionary_encode())
            counts.append(pc.list_value_length(lists).to_numpy())
        named = pa.chunked_array(named).unify_dictionaries()
        distinct = named.chunk(0).dictionary
        places = pc.index_in(distinct, value_set=self.known)
        unknown = np.flatnonzero(pc.is_null(places).to_numpy(zero_copy_only=False))
        places = pc.fill_null(places, 0).to_numpy().astype(np.int64)
        new = distinct.take(pa.array(unknown))
        too_long = pc.greater(pc.utf8_length(new), _LONGEST_KEPT)
        over = too_long.to_numpy(zero_copy_only=False)
        places[unknown[~over]] = len(self.starts) + np.arange((~over).sum())
        self._add(new.filter(pc.invert(too_long)))
        kept_chunks, kept_ids = len(self.starts), len(self.ids)
        places[unknown[over]] = kept_chunks + np.arange(over.sum())
        self._add(new.filter(too_long))
        for part, sizes_of in zip(named.chunks, counts):
            at = places[part.indices.to_numpy()]
            sizes = self.sizes[at]
            ids = self.ids[ragged(self.starts[at], sizes)]
            edges = np.append(0, np.cumsum(sizes))[np.append(0, np.cumsum(sizes_of))]
            yield from (ids[a:b].tobytes() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()))
        if over.any():
            self.ids, self.starts, self.sizes = self.ids[:kept_ids], self.starts[:kept_chunks], self.sizes[:kept_chunks]
            self.known = self.known.slice(0, kept_chunks)

    def encode(self, texts: pa.StringArray | list[str]) -> Iterator[bytes]:
        if isinstance(texts, list):
            texts = pa.array(texts, pa.string())
        if not self.by_chunk:
            yield from (x.tobytes() for x in self._library(texts.to_pylist()))
            return
        for start, stop in slices_by(pc.binary_length(texts).to_numpy(), TEXTS_AT_ONCE):
            yield from self._gathered(texts.slice(start, stop - start))


def byte_encoder(path: str) -> ByteEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already uses the cores
    return kept(("byte encoder", path), lambda: ByteEncoder(path))


# Connected components


def connected_components(edges: DataFrame, name: str) -> DataFrame:
    """``node, component`` (the smallest node reachable) for every node of ``edges`` (a, b longs).

    Alternates the large-star and small-star steps: each node's larger neighbours, then its
    smaller ones, move to the smallest node in reach.  Rounds grow with the logarithm of the
    longest path.  Every round is a written table; the driver sees two numbers of it.
    """
    links = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links, before = stage(links, name), None
    while True:
        state = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == before or not state[0]:
            break
        before = tuple(state)
        both = links.union(links.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = (both.join(least, F.col("a") == F.col("k")).where("b > a")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        large = stage(large, name)
        least = large.groupBy(F.col("a").alias("k")).agg(F.min("b").alias("m"))
        small = large.join(least, F.col("a") == F.col("k"))
        links = stage(
            small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(least.select(F.col("k"), F.col("m"))).distinct(), name)
    return (links.select(F.col("a").alias("node"), F.col("b").alias("component"))
            .union(links.select("b", "b").distinct()))
