"""Token counts, shards, packing and the piece codec against their libraries."""

import io
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from mailbench.llm.common import byte_encoder, chunks
from mailbench.llm.packing import pack_documents, plan_packs
from mailbench.llm.sentencepieces import PieceEncoder, load_model, piece_codec
from mailbench.llm.token_counts import RankMerger, token_counts
from mailbench.llm.wavelet import ShardFile, WaveletMatrix, lookup_tokens, read_shard, read_token_shards, write_shard, write_token_shards

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = Tokenizer.from_file(BYTE_BPE)
ODD = ["", " ", "\n", "a  b   c \n d\t\te", "<|endoftext|>", "x <|endoftext|> y<|endoftext|><|endoftext|> z", "don't we'll 's",
       "aaaaaaaa aaaaaaa", "é ß ü ​ \x1c q  z   w", "   lead", "trail  ", "12 345 6,7 $%&\n\n\nfoo \n bar", "☃☃ 🙂🙂x",
       "a\x00b c", "\r\n x\r\n\r\ny", "word " * 3000, "x" * 5000]
TEXT = st.text(alphabet=st.sampled_from(" \n\tabet'sT19,.éß▁☃ \x1c"), max_size=40)


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def rows(spark, texts):
    """Texts with keys out of order, a column that clashes with the operators' own, and a repeated row."""
    data = [(7 * i % len(texts), t, i) for i, t in enumerate(texts)]
    return spark.createDataFrame([*data, data[0]], "id long, body string, length int")


@settings(max_examples=150, deadline=None)
@given(TEXT)
def test_chunks_join_and_keep_tokens(text):
    assert "".join(chunks(text)) == text
    encoder = byte_encoder(BYTE_BPE)
    (raw,) = encoder.encode([text])
    assert np.frombuffer(raw, encoder.dtype).tolist() == ids_of(text)


@settings(max_examples=150, deadline=None)
@given(TEXT)
def test_merging_counts_as_the_library(text):
    assert MERGER.count([text]) == [len(ids_of(text))]


MERGER = RankMerger(BYTE_BPE)


def test_token_counts(spark):
    texts = [*ODD, None]
    got = token_counts(rows(spark, texts), "id", "body", BYTE_BPE, limit=900).collect()
    want = [(7 * i % len(texts), len((t or "").encode()), len(ids_of(t)), len(ids_of(t)) > 900) for i, t in enumerate(texts)]
    assert sorted(map(tuple, got)) == sorted([*want, want[0]])
    assert token_counts(rows(spark, ["a"]).limit(0), "id", "body", BYTE_BPE).count() == 0


def test_wavelet_matrix():
    rng = np.random.default_rng(3)
    for ids in (rng.zipf(1.3, 3000) % 999, np.zeros(5, int), np.zeros(0, int), rng.integers(0, 50257, 1500)):
        matrix = read_shard(write_shard([1], np.array([len(ids)]), ids.astype(np.uint16)))[2]
        assert matrix.ids().tolist() == ids.tolist()
        for i in range(0, len(ids), 61):
            token, where = int(ids[i]), np.flatnonzero(ids == ids[i])
            assert matrix.access(i) == token
            assert matrix.rank(token, i) == int((ids[:i] == token).sum())
            assert matrix.count(token) == len(where)
            assert matrix.select(token, len(where) - 1) == where[-1] and matrix.select(token, len(where)) == -1
        assert matrix.count(60000) == 0 and matrix.select(60000, 0) == -1
        with pytest.raises(IndexError):
            matrix.access(len(ids))
    assert WaveletMatrix.build(np.zeros(0, int)).planes == []


def test_token_shards(spark):
    texts = [*ODD, None]
    data = rows(spark, texts).limit(len(texts))
    manifest = write_token_shards(data, "id", "body", BYTE_BPE, end_id=2, shard_tokens=400)
    assert manifest.count() > 3
    want, start = [], 0
    by_key = sorted((7 * i % len(texts), t) for i, t in enumerate(texts))
    for key, text in by_key:
        ids = [*ids_of(text), 2]
        want.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, read_token_shards(manifest).collect())) == want
    everywhere = lookup_tokens(manifest, [2, 59999]).groupBy("token").sum("occurrences").collect()
    assert dict(map(tuple, everywhere)) == {2: len(texts), 59999: 0}
    empty = write_token_shards(data.limit(0), "id", "body", BYTE_BPE, end_id=2)
    assert read_token_shards(empty).count() == 0


@pytest.mark.parametrize("kind", ["even", "hot", "tiny", "long", "none"])
def test_plan_uses_every_piece_and_little_room(kind):
    rng = np.random.default_rng(5)
    lengths = np.clip(rng.lognormal(5, 1, 20000).astype(int), 1, 512)
    if kind == "hot":
        lengths[:7000] = 200
    lengths = {"tiny": np.array([3, 3, 510]), "long": np.full(9, 512), "none": np.zeros(0, int)}.get(kind, lengths)
    histogram = np.bincount(lengths, minlength=513)
    packs, used = plan_packs(histogram), np.zeros(513, int)
    for pack, times in packs:
        assert sum(pack) <= 512
        for n in pack:
            used[n] += times
    assert (used == histogram).all()
    least = -(-int(lengths.sum()) // 512)
    assert sum(t for _, t in packs) <= least * (1.05 if kind == "hot" else 1.01) + 1


def test_pack_documents(spark):
    texts = [*ODD, None, *("word " * n for n in range(1, 199))]
    got = pack_documents(rows(spark, texts).repartition(5), "id", "body", BYTE_BPE, size=64).toPandas()
    by_key = {7 * i % len(texts): [*ids_of(t), 0] for i, t in enumerate(texts)}
    first = got.drop_duplicates(["doc_id", "piece"])
    for key, part in first.sort_values("piece").groupby("doc_id"):
        ids = by_key[key]
        assert part.start.tolist() == [0, *np.cumsum(part.length)[:-1]] and part.length.sum() == len(ids)
        assert (part.length.iloc[1:] == 64).all() and part.length.iloc[0] <= 64
        assert part.ids_crc32.tolist() == [zlib.crc32(np.array(ids[a:a + n], "<u4").tobytes()) for a, n in zip(part.start, part.length)]
    assert len(got) - len(first) == len(range(0, len(by_key[0]), 64))  # the repeated row
    for _, part in got.sort_values("offset").groupby("sequence_id"):
        assert part.offset.tolist() == [0, *np.cumsum(part.length)[:-1]] and part.length.sum() <= 64
    assert pack_documents(rows(spark, ["a"]).limit(0), "id", "body", BYTE_BPE).count() == 0


MODEL = load_model(PIECES)
SP = sentencepiece.SentencePieceProcessor(model_file=PIECES)


@settings(max_examples=300, deadline=None)
@given(st.one_of(TEXT, st.text(alphabet="abeinorst -=", max_size=60), st.text(max_size=20)))
def test_pieces_as_the_library(text):
    text = text.replace("\x00", "")
    (ids,) = PieceEncoder(MODEL).encode([text])
    assert ids.tolist() == SP.encode(text)


def test_unigram_segmentation_is_the_best_sum():
    """With the same pieces taken as a unigram model: the largest sum by brute force."""
    from dataclasses import replace
    from mailbench.llm.sentencepieces import segment_equal

    rng = np.random.default_rng(0)
    model = replace(MODEL, bpe=False, score=-rng.random(len(MODEL.score)) * 9)
    number = {p: i for i, p in enumerate(MODEL.pieces)}
    words = ["▁thereof"[:6], "▁banana"[:6], "▁stone"[:6]]
    for word, ids in zip(words, segment_equal(model, words), strict=True):
        best = {0: 0.0}
        for end in range(1, 7):
            best[end] = max(best[a] + model.score[number[word[a:end]]] for a in range(end) if word[a:end] in number)
        assert "".join(MODEL.pieces[i] for i in ids) == word
        assert sum(model.score[ids]) == pytest.approx(best[6])


def test_piece_codec(spark):
    texts = [x.replace("\x00", "") for x in ODD] + [None]
    got = piece_codec(rows(spark, texts), "id", "body", PIECES).toPandas()
    want = {7 * i % len(texts): SP.encode(t or "") for i, t in enumerate(texts)}
    assert len(got) == len(texts) + 1 and got.round_trip.all()
    for row in got.itertuples():
        assert list(row.ids) == want[row.doc_id] and row.n_pieces == len(want[row.doc_id])


def test_lookups_read_little_of_a_file():
    """Access, counts and places from a large shard touch the head, the directories and a few pieces; results equal plain search."""
    rng = np.random.default_rng(6)
    ids = np.minimum(rng.zipf(1.2, 3_000_000), 40_000).astype(np.uint32)
    ids[1_234_567] = 49_999
    data = write_shard([0], np.array([len(ids)]), ids)
    shard = ShardFile(io.BytesIO(data))
    matrix = shard.matrix()
    assert (matrix.count(49_999), matrix.select(49_999, 0), matrix.access(1_234_567)) == (1, 1_234_567, 49_999)
    assert shard.bytes_read < len(data) // 2
    one = ShardFile(io.BytesIO(data))
    assert one.matrix().count(49_999) == 1 and one.bytes_read < len(data) // 3
    for token in (1, 7, 39_999, 45_000):
        places = np.flatnonzero(ids == token)
        assert matrix.count(token) == len(places) and matrix.rank(token, 2_000_001) == (places < 2_000_001).sum()
        for k in {0, len(places) // 2, len(places) - 1} & set(range(len(places))):
            assert matrix.select(token, k) == places[k]
    assert (matrix.ids() == ids).all()
