"""Substring dedup: paragraphs by MinHash bands, verified, and passages inside paragraphs."""

from __future__ import annotations

from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mailbench.llm.common import arrow_schema, connected_components, free_names, kept, slices, texts_of
from mailbench.session import stage

SHINGLE = 5
SIMILARITY = 0.8
MIN_WORDS = 25  # shorter paragraphs and passages are common phrases, not copies
ROWS = 3
RECALL = 0.998  # of pairs at the similarity itself

_WORDS_KEPT = 1 << 19
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def tune_bands(similarity: float = SIMILARITY, rows: int = ROWS, recall: float = RECALL) -> int:
    """The fewest bands of so many rows that find a pair of this similarity with this chance."""
    return ceil(log(1 - recall) / log(1 - similarity ** rows))


class WordHashes:
    """64-bit numbers for words, kept for frequent ones."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def of(self, words: list[str]) -> np.ndarray:
        import xxhash

        known = self.known
        if len(known) > _WORDS_KEPT:
            known.clear()
        for word in set(words) - known.keys():
            known[word] = xxhash.xxh64_intdigest(word)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * _PRIME
    return x ^ x >> np.uint64(29)


def _shingles(hashes: np.ndarray, sizes: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word shingles of paragraphs whose word hashes stand in a row, and how many each has."""
    counts = np.where(sizes == 0, 0, np.maximum(sizes - width + 1, 1))
    starts = np.repeat(np.cumsum(sizes) - sizes, counts)
    within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    at, stop = starts + within, starts + np.repeat(sizes, counts)
    total = np.zeros(len(at), np.uint64)
    for k in range(width):
        inside = at + k < stop
        total = total * _PRIME + np.where(inside, hashes[np.minimum(at + k, max(len(hashes) - 1, 0))], np.uint64(k)) if len(at) else total
        total = _mix(total)
    return total, counts


def shingle_hashes(paragraphs: list[str], width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word shingles of the paragraphs, in a row, and how many each has.

    Words are lowered; fewer words than the width are one shingle.
    """
    words = [x.lower().split() for x in paragraphs]
    hashes = kept(("word hashes",), WordHashes).of([w for line in words for w in line])
    return _shingles(hashes, np.fromiter(map(len, words), np.int64, len(words)), width)


def band_keys(hashes: np.ndarray, sizes: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One key per paragraph and band, from minima of ``rows`` hash functions each, over the paragraphs' word hashes."""
    hashes, counts = _shingles(hashes, sizes)
    starts = np.cumsum(counts) - counts
    seeds = np.random.default_rng(7).integers(1, 1 << 63, (bands * rows, 2), dtype=np.uint64) | np.uint64(1)
    keys = np.zeros((len(sizes), bands), np.uint64)
    for band in range(bands):
        key = np.full(len(sizes), band, np.uint64)
        for row in range(rows):
            a, b = seeds[band * rows + row]
            key = _mix(key * _PRIME + np.minimum.reduceat((hashes ^ b) * a >> np.uint64(1), starts))
        keys[:, band] = key
    return keys.view(np.int64)


class RunHashes:
    """Hashes of any run of words, from prefix sums of their hashes times powers of an odd number."""

    _BASE = 0xD1342543DE82EF95

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        power, back = (np.full(n + 1, x, np.uint64) for x in (self._BASE, pow(self._BASE, -1, 1 << 64)))
        power[0] = back[0] = 1
        self.sums = np.append(np.zeros(1, np.uint64), np.cumsum(hashes * np.cumprod(power)[:n]))
        self.back = np.cumprod(back)

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return _mix(_mix((self.sums[stop] - self.sums[start]) * self.back[start]) + (stop - start).astype(np.uint64) * _PRIME)


def run_hashes(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hashes of paragraphs whose word hashes stand in a row: those of the same words as a run."""
    stop = np.cumsum(sizes)
    return RunHashes(hashes).of(stop - sizes, stop)


_SPACE = np.zeros(12290, bool)
_SPACE[[i for i in range(12290) if chr(i).isspace()]] = True


class Words:
    """The words of some texts in a row: their hashes, where they stand, and whose they are.

    Each word is cut out, lowered and hashed once; all units are made of these numbers.
    """

    def __init__(self, texts: list[str]):
        joined = "\n".join(texts)
        self.hashes = kept(("word hashes",), WordHashes).of(joined.lower().split())
        self.codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        edges = np.diff(np.concatenate([[True], _SPACE[np.minimum(self.codes, len(_SPACE) - 1)], [True]]).astype(np.int8))
        self.starts, self.stops = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
        self.begins = np.cumsum([0, *(len(x) + 1 for x in texts[:-1])])
        self.text = np.searchsorted(self.begins, self.starts, "right") - 1
        self.line_ends = np.append(np.flatnonzero(self.codes == 10), len(self.codes))
        self.line = np.searchsorted(self.line_ends, self.starts)
        self.runs = RunHashes(self.hashes)

    def lines(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """First word, and word after the last, of lines of so many words."""
        edges = np.flatnonzero(np.diff(self.line, prepend=-1, append=-2))
        start, stop = edges[:-1], edges[1:]
        enough = stop - start >= least
        return start[enough], stop[enough]

    def passages(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """From every sentence's first word, whole sentences of the text until they have so many words."""
        n = len(self.hashes)
        if not n:
            return (np.zeros(0, np.int64),) * 2
        ended = np.isin(self.codes[self.stops - 1], [ord(c) for c in ".!?"])
        after = np.flatnonzero(ended[:-1] | (self.line[1:] != self.line[:-1])) + 1
        start, ends = np.append(0, after), np.append(after, n)
        which = np.searchsorted(ends, start + least)
        start, stop = start[which < len(ends)], ends[which[which < len(ends)]]
        own = self.text[start] == self.text[stop - 1]
        return start[own], stop[own]

    def spans(self, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code points in their text where runs of words start and stop."""
        begin = self.begins[self.text[start]]
        return self.starts[start] - begin, self.stops[stop - 1] - begin


def _over(x: np.ndarray, width: int, ufunc, fill) -> np.ndarray:
    """``ufunc`` over each element and the ``width`` - 1 after it."""
    done, size = x, 1
    while size < width:
        step = min(size, width - size)
        done = ufunc(done, np.append(done[step:], np.full(min(step, len(done)), fill, x.dtype)))
        size += step
    return done


_ANCHORED = np.uint64(0xA0761D6478BD642F)


def chosen_windows(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of windows of ``width`` words, at places that the words alone choose.

    Of any ``width`` + 1 windows in a row the one with the least hash is taken, so texts that share
    2 * ``width`` words in a row share an anchor, wherever sentences end.  Windows with one
    hash do not overlap in a text.
    """
    n = len(words.hashes) - width + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    text, first = words.text, np.arange(n)
    total = _mix(words.runs.of(first, first + width) ^ _ANCHORED)  # an anchor is equal to no passage
    inside = text[:n] == text[width - 1:]
    least = _over(total, width + 1, np.minimum, 0)
    least[:max(n - width, 0)][text[:max(n - width, 0)] != text[2 * width - 1:]] = 0  # such ranges leave the text
    least[max(n - width, 0):] = 0
    reach = _over(least[::-1], width + 1, np.maximum, 0)[::-1]
    at = np.flatnonzero(inside & (reach == total))
    last: dict[tuple[int, int], int] = {}
    chosen = []
    for i, t, h in zip(at.tolist(), text[at].tolist(), total[at].tolist()):
        if last.get((t, h), -width) + width <= i:
            last[t, h] = i
            chosen.append(i)
    at = np.array(chosen, np.int64)
    return at, total[at]


def anchors(texts: list[str], width: int) -> tuple[np.ndarray, ...]:
    """Text, start, stop and hash of the :func:`chosen_windows`."""
    words = Words(texts)
    at, total = chosen_windows(words, width)
    return words.text[at], *words.spans(at, at + width), total


UNITS = "doc_id long, start int, stop int, n_words int, key long, bands array<long>"


def units(df: DataFrame, key: str, text: str, min_words: int, bands: int, rows: int) -> DataFrame:
    """Paragraphs and passages of at least ``min_words`` words of every whole text, with the hash of their lowered words.

    A paragraph is a line, and has band keys.  A passage starts at any sentence and takes
    sentences, over line ends too, until it has ``min_words`` words: so a passage that was put
    in the middle of a line is met from its second sentence on, whatever stands around it.
    Anchors are windows of ``min_words`` words, for passages whose edges are inside sentences.
    ``start`` and ``stop`` count code points.  Shorter paragraphs are in passages that go on behind them, alone they are none.
    """
    schema = arrow_schema(UNITS)

    def run(batches):
        for batch in batches:
            texts = texts_of(batch, "_text")
            for first, last in slices(texts):
                words = Words(texts[first:last])
                line, line_stop = words.lines(min_words)
                start, stop = words.passages(min_words)
                # A passage that is a whole line is that line.
                of_line = np.full(len(words.hashes) + 1, -1, np.int64)
                of_line[line] = line_stop
                other = of_line[start] != stop
                start, stop = start[other], stop[other]
                anchor, anchor_hash = chosen_windows(words, min_words)

                firsts, stops = np.concatenate([line, start, anchor]), np.concatenate([line_stop, stop, anchor + min_words])
                begin, end = words.spans(firsts, stops)
                # Lines reach from line end to line end, with what space there is.
                ends, text_begin = words.line_ends, words.begins[words.text[line]]
                begin[:len(line)] = np.where(words.line[line] > 0, ends[words.line[line] - 1] + 1, 0) - text_begin
                end[:len(line)] = ends[words.line[line]] - text_begin
                keys = np.concatenate([words.runs.of(line, line_stop), words.runs.of(start, stop), anchor_hash]).view(np.int64)

                found = [np.zeros((0, bands), np.int64)]
                for i in range(0, len(line), 4096):
                    a, b = line[i:i + 4096], line_stop[i:i + 4096]
                    inside = np.repeat(a - (np.cumsum(b - a) - (b - a)), b - a) + np.arange((b - a).sum())
                    found.append(band_keys(words.hashes[inside], b - a, bands, rows))
                lists = pa.ListArray.from_arrays(np.arange(len(line) + 1, dtype=np.int32) * bands, np.concatenate(found).ravel())
                columns = [batch.column(0).take(pa.array(words.text[firsts] + first)), pa.array(begin, pa.int32()), pa.array(end, pa.int32()),
                           pa.array(stops - firsts, pa.int32()), pa.array(keys),
                           pa.concat_arrays([lists, pa.nulls(len(firsts) - len(line), lists.type)])]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    narrow = df.select(F.col(key).cast("long").alias("_key"), F.col(text).alias("_text"))
    return narrow.mapInArrow(run, UNITS)


def _by_bucket(batches, columns: int):
    """Rows of sorted batches, one bucket (equal first column) or several whole ones at a time."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        if not held.num_rows:
            continue
        first = held.column(0).to_numpy()
        whole = int(np.searchsorted(first, first[-1]))
        if whole:
            yield held.slice(0, whole)
            held = held.slice(whole).combine_chunks()
    if held is not None and held.num_rows:
        yield held


def colliding(classes: DataFrame) -> DataFrame:
    """``band, key`` of those buckets that hold several classes."""
    schema = arrow_schema("band long, key long")

    def run(batches):
        for rows in _by_bucket(batches, 2):
            band = rows.column(0).to_numpy()
            same = band[1:] == band[:-1]
            shared = np.append(same, False) | np.append(False, same)
            if shared.any():
                yield from rows.filter(pa.array(shared)).cast(schema).to_batches()

    dealt = classes.select(F.explode("bands").alias("band"), "key").repartition("band")
    return dealt.sortWithinPartitions("band", "key").mapInArrow(run, "band long, key long")


def linked(members: list[int], sets: list[frozenset], similarity: float) -> list[tuple[int, int]]:
    """Links of exact Jaccard similarity that keep connected what is connected in one bucket.

    A member is compared with a group until one of it is near enough, so a bucket of near
    copies takes about one comparison each; nothing is skipped that could join two groups.
    """
    groups: list[list[int]] = []
    links = []
    for i, own in enumerate(sets):
        joined, apart = [i], []
        for group in groups:
            for j in reversed(group):
                other = sets[j]
                small, large = sorted((len(own), len(other)))
                if small >= similarity * large:
                    common = len(own & other)
                    if common >= similarity * (small + large - common):
                        links.append((members[i], members[j]))
                        joined += group
                        break
            else:
                apart.append(group)
        groups = [*apart, joined]
    return links


def verified(candidates: DataFrame, similarity: float) -> DataFrame:
    """``a, b``: links between classes, from ``band, key, shingles``."""
    schema = arrow_schema("a long, b long")

    def run(batches):
        for rows in _by_bucket(batches, 3):
            band, keys = rows.column(0).to_numpy(), rows.column(1).to_pylist()
            cuts = [0, *(np.flatnonzero(np.diff(band)) + 1), len(band)]
            links = []
            for a, b in zip(cuts, cuts[1:]):
                if b - a > 1:
                    sets = [frozenset(x) for x in rows.column(2).slice(a, b - a).to_pylist()]
                    links += linked(keys[a:b], sets, similarity)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links)], schema=schema)

    dealt = candidates.select("band", "key", "shingles").repartition("band").sortWithinPartitions("band", "key")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def class_shingles(paragraphs: DataFrame) -> DataFrame:
    """``key, shingles`` (distinct hashes) of ``key, line``, of those lines whose key it is.

    Where a document key is repeated, other texts have something else at the place.
    """

    def run(batches):
        for batch in batches:
            words = [x.lower().split() for x in texts_of(batch, "line")]
            sizes = np.fromiter(map(len, words), np.int64, len(words))
            own = run_hashes(kept(("word hashes",), WordHashes).of([w for line in words for w in line]), sizes)
            batch = batch.filter(pa.array(own.view(np.int64) == batch.column(0).to_numpy()))
            hashes, counts = shingle_hashes(texts_of(batch, "line"))
            parts = np.split(hashes.view(np.int64), np.cumsum(counts)[:-1]) if len(counts) else []
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([np.unique(x) for x in parts], pa.list_(pa.int64()))], names=["key", "shingles"])

    return paragraphs.select("key", "line").mapInArrow(run, "key long, shingles array<long>")


def repeated_units(df: DataFrame, key: str, text: str, similarity: float = SIMILARITY, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id, start, stop, first_doc_id, removed`` for every unit that is found more than once.

    Equal units are one class, whatever their number.  Classes of paragraphs that share a band
    are compared by exact Jaccard similarity of their word shingles; linked classes are one
    component.  The unit of the smallest document and place stays, the others go.
    """
    bands = tune_bands(similarity)
    found = stage(units(df, key, text, min_words, bands, ROWS), "paragraph-units")
    classes = (found.where("bands IS NOT NULL").groupBy("key").agg(
        F.first("bands").alias("bands"), F.min(F.struct("doc_id", "start", "stop")).alias("at")))
    pairs = stage(colliding(classes), "paragraph-bands")
    wanted = pairs.select("key").distinct()
    places = (found.where("bands IS NOT NULL AND doc_id IS NOT NULL").select("key", "doc_id", "start", "stop").join(wanted, "key", "left_semi")
              .groupBy("key").agg(F.min(F.struct("doc_id", "start", "stop")).alias("at")).select("key", "at.*"))
    whole = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("_text"))
    lines = whole.join(places, "doc_id").select("key", F.expr("substring(_text, start + 1, stop - start)").alias("line"))
    shingles = stage(class_shingles(lines).dropDuplicates(["key"]), "paragraph-shingles")
    links = connected_components(verified(pairs.join(shingles, "key"), similarity), "paragraphs")
    often = found.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("key").alias("node"))
    named = often.join(links, "node", "full").select(
        F.col("node").alias("key"), F.coalesce("component", "node").alias("component"))
    hits = stage(found.select("doc_id", "start", "stop", "key").join(named, "key").drop("key"), "paragraph-hits")
    # Written, so that the join below deals out the rows anew and can split a component of many.
    first = stage(hits.groupBy("component").agg(F.min(F.struct("doc_id", "start", "stop")).alias("first")), "paragraph-first")
    return hits.join(first, "component").select(
        "doc_id", "start", "stop", F.col("first.doc_id").alias("first_doc_id"),
        (F.struct("doc_id", "start", "stop") != F.col("first")).alias("removed"))


def repeated_passages(df: DataFrame, key: str, text: str, similarity: float = SIMILARITY, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per passage that is found more than once: ``doc_id, start, stop, n_chars, first_doc_id, removed``.

    Overlapping units of one document are one passage; ``removed`` tells whether it goes or is the
    occurrence that stays, ``first_doc_id`` where (the first part of) it stays.  Documents without
    repeats have no row.  Null texts have no units; a null key counts as the smallest, and what it
    holds is compared for equality only; rows that are repeated whole are copies of each other
    except for their first; ties go to the smaller start.
    """
    rows = repeated_units(df, key, text, similarity, min_words)
    before = Window.partitionBy("doc_id", "removed").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("doc_id", "removed").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, 0)
    apart = rows.withColumn("new", F.coalesce((F.col("start") > F.max("stop").over(before) + 1).cast("int"), F.lit(1)))
    merged = apart.withColumn("part", F.sum("new").over(upto)).groupBy("doc_id", "removed", "part").agg(
        F.min("start").alias("start"), F.max("stop").alias("stop"), F.min("first_doc_id").alias("first_doc_id"))
    return merged.select("doc_id", "start", "stop", (F.col("stop") - F.col("start")).alias("n_chars"), "first_doc_id", "removed")


def without_repeats(df: DataFrame, key: str, text: str, similarity: float = SIMILARITY, min_words: int = MIN_WORDS) -> DataFrame:
    """``df`` with the passages that go cut out of its texts; all rows and columns stay.

    A row whose key is null or repeated keeps its text.
    """
    gone = repeated_passages(df, key, text, similarity, min_words).where("removed")
    own, cuts = free_names(df, "_key", "_gone")
    once = df.groupBy(F.col(key).cast("long").alias(own)).agg(F.count("*").alias("n")).where("n = 1").select(own)
    spans = (gone.groupBy(F.col("doc_id").alias(own)).agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias(cuts))
             .join(once, own, "left_semi"))
    cut = F.expr(f"""array_join(transform(sequence(0, size({cuts})), i -> CASE
        WHEN i = 0 THEN substring(`{text}`, 1, {cuts}[0].start)
        WHEN i = size({cuts}) THEN substring(`{text}`, get({cuts}, i - 1).stop + 1)
        ELSE substring(`{text}`, get({cuts}, i - 1).stop + 1, get({cuts}, i).start - get({cuts}, i - 1).stop) END), '')""")
    marked = df.join(spans, F.col(key).cast("long") == F.col(own), "left")
    return marked.select(*(F.when(F.col(cuts).isNull(), F.col(c)).otherwise(cut).alias(c) if c == text else F.col(c) for c in df.columns))
