"""SentencePiece encoding and decoding by batched Viterbi in numpy.

Words of equal length advance together, place by place.  At each place the pieces that end
there are found by probing sorted hashes of all pieces with hashes of substrings, and the best
predecessor is kept as a backpointer.  Two kinds of models differ in what "best" is:

* unigram: the largest sum of piece scores;
* BPE: the last piece of the one segmentation that merging would give.  A segmentation is that one if
  and only if each two neighbours are what merging makes of them alone, so every place has exactly
  one predecessor that passes, and the maximum is taken over a pass mark.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailbench.llm.common import arrow_schema, kept, slices, texts_of

SPACE = "▁"
_BASE = np.uint64(0x100000001B3 * 2 + 1)
_NONE = -1
_PRESENT_BITS, _PAIR_BITS = 22, 21
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _BASE)]), dtype=np.uint64)


def piece_hash(text: str) -> int:
    h = 0
    for c in text:
        h = (h * int(_BASE) + ord(c) + 1) & (1 << 64) - 1
    return h


@dataclass
class PieceModel:
    """A model's pieces: sorted hashes with their ids, scores, and (BPE) how each piece was merged."""

    bpe: bool
    unknown: int
    score: np.ndarray
    length: np.ndarray
    hash: np.ndarray
    keys: np.ndarray
    ids: np.ndarray
    byte_ids: np.ndarray
    pieces: list[str]
    longest: int
    left: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    right: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    usable: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))
    # Made where the model is used: which upper bits of hashes any piece has, and pairs of pieces judged before.
    present: np.ndarray | None = None
    pair_keys: np.ndarray | None = None
    pair_stays: np.ndarray | None = None

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Number of the piece with each hash.  Most substrings are no piece, and the upper bits of their hash tell."""
        if self.present is None:
            self.present = np.zeros(1 << _PRESENT_BITS, bool)
            self.present[self.keys >> np.uint64(64 - _PRESENT_BITS)] = True
        out = np.full(hashes.shape, _NONE)
        flat, found = hashes.ravel(), out.ravel()
        maybe = np.flatnonzero(self.present[flat >> np.uint64(64 - _PRESENT_BITS)])
        wanted = flat[maybe]
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        found[maybe] = np.where(self.keys[at] == wanted, self.ids[at], _NONE)
        return out

    def stay(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """:func:`neighbours_stay`, each pair judged once as long as its place in a table of fixed size is not taken by another."""
        if self.pair_keys is None:
            self.pair_keys, self.pair_stays = np.full(1 << _PAIR_BITS, -1), np.zeros(1 << _PAIR_BITS, bool)
        pair = a * len(self.score) + b
        slot = (pair.astype(np.uint64) * _MIX) >> np.uint64(64 - _PAIR_BITS)
        out, new = self.pair_stays[slot], np.flatnonzero(self.pair_keys[slot] != pair)
        if len(new):
            _, one, back = np.unique(pair[new], return_index=True, return_inverse=True)
            some = new[one]
            judged = neighbours_stay(self, a[some], b[some])
            out[new] = judged[back]
            _, last = np.unique(slot[some], return_index=True)  # of pairs with one place, one is kept
            self.pair_keys[slot[some[last]]], self.pair_stays[slot[some[last]]] = pair[some[last]], judged[last]
        return out


def merge_word(model_rank: dict[str, float], word: str) -> list[str]:
    """Plain BPE of one word: again and again the best-scored neighbours, leftmost first."""
    parts = list(word)
    while len(parts) > 1:
        best, at = None, 0
        for i, (a, b) in enumerate(zip(parts, parts[1:])):
            score = model_rank.get(a + b)
            if score is not None and (best is None or score > best):
                best, at = score, i
        if best is None:
            break
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return parts


def load_model(path: str) -> PieceModel:
    """Read a model file with the sentencepiece library; only pieces and scores are used."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    pieces = [sp.id_to_piece(i) for i in range(n)]
    plain = [not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i)) for i in range(n)]
    score = np.array([sp.get_score(i) for i in range(n)], np.float64)
    byte_ids = np.full(256, _NONE, np.int64)
    for i in range(n):
        if sp.is_byte(i):
            byte_ids[int(pieces[i][3:5], 16)] = i
    if any(SPACE in p.lstrip(SPACE) for p, ok in zip(pieces, plain) if ok):
        raise ValueError(f"{path}: pieces go over word ends")
    probe = " a  b\tc\n é"
    if sp.decode(sp.encode(probe)) != probe or sp.encode(probe, out_type=str)[0][0] != SPACE:
        raise ValueError(f"{path}: only models that keep texts as they are, with a leading space, are meant")
    hashes = np.array([piece_hash(p) for p in pieces], np.uint64)
    own = np.flatnonzero(plain)
    order = own[np.argsort(hashes[own], kind="stable")]
    if len(np.unique(hashes[own])) != len(own):
        raise ValueError("two pieces share a hash")
    model = PieceModel(_is_bpe(path), sp.unk_id(), score, np.array([len(p) for p in pieces]), hashes, hashes[order], order, byte_ids,
                       pieces, max(len(p) for p, ok in zip(pieces, plain) if ok))
    if model.bpe:
        ranks = {pieces[i]: score[i] for i in own}
        number = {pieces[i]: i for i in own}
        model.left, model.right, model.usable = np.full(n, _NONE), np.full(n, _NONE), np.zeros(n, bool)
        for i in own:
            parts = _last_merge(ranks, pieces[i])
            if parts is not None:
                model.usable[i] = True
                if len(parts) == 2:
                    model.left[i], model.right[i] = number.get(parts[0], _NONE), number.get(parts[1], _NONE)
    return model


def _last_merge(ranks: dict[str, float], piece: str) -> list[str] | None:
    """The two parts that merging joins last to make the piece; None if it never makes it."""
    if len(piece) == 1:
        return [piece]
    parts = list(piece)
    while len(parts) > 2:
        best, at = None, 0
        for i, (a, b) in enumerate(zip(parts, parts[1:])):
            score = ranks.get(a + b)
            if score is not None and (best is None or score > best):
                best, at = score, i
        if best is None:
            return None
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return parts


def _is_bpe(path: str) -> bool:
    """Model type in the file: field 2 (trainer), in it field 3, where 1 is unigram and 2 is BPE."""
    with open(path, "rb") as file:
        data = file.read()

    def fields(buffer):
        at = 0

        def number():
            nonlocal at
            value = shift = 0
            while True:
                byte = buffer[at]
                at += 1
                value |= (byte & 127) << shift
                shift += 7
                if byte < 128:
                    return value

        while at < len(buffer):
            tag = number()
            if tag & 7 == 0:
                yield tag >> 3, number()
            elif tag & 7 == 2:
                size = number()
                yield tag >> 3, buffer[at:at + size]
                at += size
            else:
                size = {1: 8, 5: 4}[tag & 7]
                yield tag >> 3, buffer[at:at + size]
                at += size

    for name, trainer in fields(data):
        if name == 2:
            kinds = [value for inner, value in fields(trainer) if inner == 3]
            return bool(kinds) and kinds[-1] == 2
    return False


def neighbours_stay(model: PieceModel, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether merging leaves each two pieces as they are when they stand side by side.

    Both pieces are taken apart from their last merge on.  Looking back, the state across the border
    was always the end of the left and the start of the right piece; had these two made a piece
    of a better score than the merge that came next on either side, they would have been joined.
    An equal score means the same piece again, where the leftmost place goes first.
    """
    a, b = a.copy(), b.copy()
    ok = np.ones(len(a), bool)
    # Scores of the merges that came after the state looked at; none yet.
    after_a, after_b = np.full(len(a), -np.inf), np.full(len(a), -np.inf)
    live = np.arange(len(a))
    power = _powers(model.longest + 1)
    while len(live):
        x, y = a[live], b[live]
        joined = model.find(model.hash[x] * power[model.length[y]] + model.hash[y])
        gain = np.where(joined >= 0, model.score[joined], -np.inf)
        # The border lies right of what the left piece merges, left of what the right one does.
        bad = (joined >= 0) & ((gain > after_a[live]) & (gain >= after_b[live]))
        ok[live[bad]] = False
        deep_a, deep_b = model.left[x] >= 0, model.left[y] >= 0
        score_a = np.where(deep_a, model.score[x], np.inf)
        score_b = np.where(deep_b, model.score[y], np.inf)
        # Undo the later of the two merges: the one of the lower score; of equals, the right one.
        undo_b = deep_b & (score_b <= score_a)
        undo_a = deep_a & ~undo_b
        after_a[live] = np.where(undo_a, score_a, after_a[live])
        after_b[live] = np.where(undo_b, score_b, after_b[live])
        a[live] = np.where(undo_a, model.right[x], x)
        b[live] = np.where(undo_b, model.left[y], y)
        live = live[(undo_a | undo_b) & ok[live]]
    return ok


def segment_equal(model: PieceModel, words: list[str]) -> list[list[int]]:
    """Best pieces of words of one length, all at once; characters that are no piece become bytes or unknown."""
    n, size = len(words), len(words[0])
    chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64).reshape(n, size)
    prefix = np.zeros((n, size + 1), np.uint64)
    for i in range(size):
        prefix[:, i + 1] = prefix[:, i] * _BASE + chars[:, i] + np.uint64(1)
    power = _powers(size)
    best = np.full((n, size + 1), -np.inf)
    best[:, 0] = 0
    back = np.zeros((n, size + 1), np.int64)
    piece = np.full((n, size + 1), _NONE)
    floor = model.score.min() - 10
    for end in range(1, size + 1):
        first = max(0, end - model.longest)
        starts = np.arange(first, end)
        hashes = prefix[:, end, None] - prefix[:, starts] * power[end - starts]
        ids = model.find(hashes)
        if model.bpe:
            found = ids >= 0
            found[found] = model.usable[ids[found]]
            # A character that is no piece stands alone.
            alone = ids[:, -1] < 0
            row, col = np.nonzero(found)
            before = piece[row, starts[col]]
            check = (starts[col] > 0) & (before >= 0)
            stays = best[row, starts[col]] == 0
            stays[check] &= model.stay(before[check], ids[row[check], col[check]])
            value = np.full(ids.shape, -np.inf)
            value[row[stays], col[stays]] = 0.0
            value[alone, -1] = best[alone, end - 1]
        else:
            value = np.where(ids >= 0, best[:, starts] + model.score[ids], -np.inf)
            alone = ids[:, -1] < 0
            value[alone, -1] = best[alone, end - 1] + floor
        choice = value.argmax(axis=1)
        rows = np.arange(n)
        best[:, end], back[:, end], piece[:, end] = value[rows, choice], starts[choice], ids[rows, choice]
    # Follow the backpointers of all words together; pieces are filled in from the right.
    taken, count, odd = np.zeros((n, size), np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
    at = np.full(n, size)
    while (live := np.flatnonzero(at > 0)).size:
        ids = piece[live, at[live]]
        odd[live[ids < 0]] = True
        count[live] += 1
        taken[live, size - count[live]] = ids
        at[live] = back[live, at[live]]
    out = [row[size - k:].tolist() for row, k in zip(taken, count.tolist())]
    for i in np.flatnonzero(odd):
        out[i] = _with_bytes(model, words[i], out[i])
    return out


def _with_bytes(model: PieceModel, word: str, ids: list[int]) -> list[int]:
    """Characters that are no piece as their bytes, or as the unknown piece."""
    out, at = [], 0
    for p in ids:
        if p >= 0:
            out.append(p)
            at += int(model.length[p])
        else:
            raw = model.byte_ids[list(word[at].encode("utf-8", "surrogatepass"))]
            out += [model.unknown] if (raw < 0).any() else raw.tolist()
            at += 1
    return out


class PieceEncoder:
    """Ids of whole texts; words that come again are segmented once."""

    def __init__(self, model: PieceModel, entries: int = 1 << 20):
        self.model, self.entries, self.known = model, entries, {}
        # A word starts with its spaces; no piece goes on over them.
        self.words = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.bytes_of = [p.encode() for p in model.pieces]
        self.bytes_of[model.unknown] = " \u2047 ".encode()
        for byte, i in enumerate(model.byte_ids.tolist()):
            if i >= 0:
                self.bytes_of[i] = bytes([byte])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        cut = [self.words.findall((SPACE + x).replace(" ", SPACE)) if x else [] for x in texts]
        if len(self.known) > self.entries:
            self.known.clear()
        known, lengths = self.known, {}
        for word in set().union(*cut) - known.keys():
            lengths.setdefault(len(word), []).append(word)
        for size, words in lengths.items():
            step = max(1, (1 << 18) // (size * min(size, self.model.longest)))
            for i in range(0, len(words), step):
                some = words[i:i + step]
                for word, ids in zip(some, segment_equal(self.model, some), strict=True):
                    known[word] = np.array(ids, "<u4").tobytes()
        out = [np.frombuffer(b"".join([known[w] for w in words]), "<u4") for words in cut]
        for size, words in lengths.items():
            if size > 64:
                for word in words:
                    del known[word]
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text again: pieces joined, bytes put together, the leading space off."""
        text = b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if text[:1] == " " else text


def piece_codec(df: DataFrame, key: str, text: str, path: str, full: bool = True) -> DataFrame:
    """``doc_id, n_pieces, ids_crc32, round_trip`` of every row, and with ``full`` its ``ids`` and the text ``decoded`` from them.

    The crc is that of the ids as little-endian unsigned 32-bit numbers; ``round_trip`` says whether the decoded
    text equals the row's.  Null texts are empty and have no pieces; repeated rows and null keys are answered
    row by row; other columns are not read.  The model is read on the driver and sent out once.
    """
    model = df.sparkSession.sparkContext.broadcast(load_model(path))
    kinds = "doc_id long, n_pieces long, ids_crc32 long, round_trip boolean"
    schema = arrow_schema(kinds)
    if full:
        kinds += ", ids array<int>, decoded string"
        schema = schema.append(pa.field("ids", pa.list_(pa.int32()))).append(pa.field("decoded", pa.string()))

    def run(batches):
        encoder = kept(("pieces", path), lambda: PieceEncoder(model.value))
        for batch in batches:
            texts = texts_of(batch, "_text")
            ids = [x for a, b in slices(texts, 1 << 22) for x in encoder.encode(texts[a:b])]
            decoded = [encoder.decode(x) for x in ids]
            columns = [batch.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()),
                       pa.array([a == b for a, b in zip(texts, decoded, strict=True)], pa.bool_())]
            if full:
                columns += [pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    narrow = df.select(F.col(key).cast("long").alias("_key"), F.col(text).alias("_text"))
    return narrow.mapInArrow(run, kinds)
