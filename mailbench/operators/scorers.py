"""Classifiers that turn a text into ``struct<label, confidence, error>``."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.model_cache import ModelCache
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailbench.functions.decisions import round_n, softmax_decide
from mailbench.functions.labels import label_to_text
from mailbench.operators.guards import guard_prediction

# Fixed value: tokens of a text a transformer looks at.
MAX_TOKENS = 512

DECISION = T.StructType([
    T.StructField("chosen", T.LongType()),
    T.StructField("probability", T.DoubleType()),
    T.StructField("error", T.StringType()),
])


class Scorer:
    """One classifier of a registry; its place in the registry breaks ties."""

    def __init__(self, name: str):
        self.name = name

    def raw(self, text: Column) -> Column:
        """What the model says about one text."""
        raise NotImplementedError

    def decide(self, raw: Column) -> Column:
        """``struct<label, confidence, error>`` from the column :meth:`raw` became."""
        raise NotImplementedError


class NativeScorer(Scorer):
    """Linear logits over text features, computed by Spark expressions alone.

    The spam logit is ``bias``, plus ``per_word`` for each of ``words`` in the
    lower-cased text, plus ``if_long`` for texts over ``long_over`` characters.  The
    other logit is 0.
    """

    def __init__(self, name: str, words: Sequence[str] = (), per_word: float = 2.0,
                 bias: float = -1.0, if_long: float = 0.0, long_over: int | None = None):
        super().__init__(name)
        self.words, self.per_word, self.bias = tuple(words), float(per_word), float(bias)
        self.if_long, self.long_over = float(if_long), long_over

    def raw(self, text: Column) -> Column:
        known = F.coalesce(text, F.lit(""))
        lowered = F.lower(known)
        spam = F.lit(self.bias)
        if self.words:
            found = reduce(add, [lowered.contains(word).cast("int") for word in self.words])
            spam = spam + found * self.per_word
        if self.long_over is not None:
            spam = spam + (F.length(known) > self.long_over).cast("int") * self.if_long
        return spam

    def decide(self, raw: Column) -> Column:
        decision = softmax_decide([F.lit(0.0), raw])
        return F.struct(
            decision["label"].alias("label"),
            decision["confidence"].alias("confidence"),
            F.lit(None).cast("string").alias("error"),
        )


def padded_batches(lengths: np.ndarray, budget: int, waste: float) -> list[np.ndarray]:
    """Places of texts in batches of like length: shortest first, each batch padded to its longest.

    A batch's padded size stays within ``budget``, unless it is one text, and within ``waste`` times the
    sum of its lengths, which bounds the work on padding for any mixture of texts.
    """
    order = np.argsort(lengths, kind="stable")
    batches, start, total = [], 0, 0
    for i, place in enumerate(order):
        own = max(int(lengths[place]), 1)
        padded = own * (i - start + 1)
        if i > start and (padded > budget or padded > waste * (total + own)):
            batches.append(order[start:i])
            start, total = i, 0
        total += own
    return [*batches, order[start:]] if len(order) else []


def text_slices(sizes: np.ndarray, rows: int, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of at most so many neighbours, whose sizes add up to at most so much, or of one that is larger."""
    ends, start = np.cumsum(sizes, dtype="int64"), 0
    while start < len(ends):
        fitting = int(np.searchsorted(ends, ends[start] - sizes[start] + most, "right"))
        stop = max(min(start + rows, fitting), start + 1)
        yield start, stop
        start = stop


class BatchScorer(Scorer):
    """A Python model scored in batches of like length.

    ``load(max_tokens)`` runs once per Python worker and returns ``model(texts)``, which
    gives one row of logits per text.  Empty texts are not passed to the model.  Of ``ROWS`` texts
    at a time, or as many as have ``BYTES`` together, those of like length are scored together, as many as padded to the
    longest make ``batch_size`` texts of ``max_tokens``; answers come in the order of the rows.  ``model.lengths(texts)``, if there is one, tells the tokens of texts;
    otherwise four characters count as a token.  If a batch fails, its texts are scored one by one, and those that
    fail alone carry the error and count as not spam.

    Spark's batches (10 000 rows or 64 MB, if not set otherwise) stay Arrow arrays; only the texts that are being
    scored are Python strings, so a worker's memory does not hang on the rows of a table or the width of their characters.
    """

    ROWS, BYTES, WASTE, CHARACTERS = 1024, 1 << 23, 1.2, 4

    def __init__(self, name: str, load: Callable[[int], Callable[[list[str]], np.ndarray]],
                 batch_size: int = 64, max_tokens: int = MAX_TOKENS):
        super().__init__(name)
        rows, most, waste, characters = self.ROWS, self.BYTES, self.WASTE, self.CHARACTERS
        identity = uuid.uuid4()  # made on the driver: a worker keeps the model from task to task under it

        def make_predict_fn():
            model = load(max_tokens)

            def score(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
                logits = np.asarray(model(texts), dtype="float64")
                if len(logits) != len(texts):
                    raise ValueError(f"{len(logits)} rows of logits for {len(texts)} texts")
                above = np.exp(logits - logits.max(axis=1, keepdims=True))
                return logits.argmax(axis=1), 1.0 / above.sum(axis=1)

            def tokens(texts: list[str]) -> np.ndarray:
                known = getattr(model, "lengths", None)
                found = known(texts) if known else [-(-len(t) // characters) for t in texts]
                return np.minimum(np.asarray(found, dtype="int64"), max_tokens)

            def predict(texts: np.ndarray) -> dict[str, np.ndarray]:
                chosen = np.zeros(len(texts), dtype="int64")
                probability = np.zeros(len(texts))
                error = np.full(len(texts), None, dtype=object)
                filled = np.flatnonzero(texts != "")
                if not len(filled):
                    return {"chosen": chosen, "probability": probability, "error": error}
                for group in padded_batches(tokens(texts[filled].tolist()), batch_size * max_tokens, waste):
                    places = filled[group]
                    try:
                        chosen[places], probability[places] = score(texts[places].tolist())
                    except Exception:
                        for place in places:
                            try:
                                found = score([texts[place]])
                                chosen[place], probability[place] = found[0][0], found[1][0]
                            except Exception as problem:
                                error[place] = str(problem) or type(problem).__name__
                return {"chosen": chosen, "probability": probability, "error": error}

            return predict

        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            predict = ModelCache.get(identity)
            if predict is None:
                predict = make_predict_fn()
                ModelCache.add(identity, predict)
            for texts in batches:
                sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
                for start, stop in text_slices(sizes, rows, most):
                    found = predict(np.array(texts[start:stop].to_pylist(), dtype=object))
                    # What is not a number becomes null.
                    yield pa.StructArray.from_arrays([
                        pa.array(found["chosen"]), pa.array(found["probability"], from_pandas=True),
                        pa.array(found["error"], pa.string())], list(found))

        # Not deterministic, so that no filter on its result is pushed down as a second run of the model.
        self._udf = F.arrow_udf(run, DECISION).asNondeterministic()

    def raw(self, text: Column) -> Column:
        return self._udf(F.coalesce(text, F.lit("")))

    def decide(self, raw: Column) -> Column:
        return F.struct(
            label_to_text(raw["chosen"]).alias("label"),
            round_n(raw["probability"]).alias("confidence"),
            raw["error"].alias("error"),
        )


def score_all(df: DataFrame, scorers: Sequence[Scorer], text: str = "text") -> DataFrame:
    """``df`` with one prediction struct per scorer, named after it.  No shuffle.

    Fields are guarded one by one, so that a reader of labels alone leaves the
    confidences uncomputed.
    """
    names = [s.name for s in scorers]
    if len(set(names)) != len(names) or set(names) & set(df.columns):
        raise ValueError(f"scorer names must be new and distinct: {names}")
    raws = [s.raw(F.col(text)).alias(s.name) for s in scorers]
    return df.select("*", *raws).select(*[F.col(f"`{c}`") for c in df.columns], *[
        guard_prediction(F.col(text), s.decide(F.col(s.name))).alias(s.name) for s in scorers
    ])


def score_transformer(df: DataFrame, text: str, load, name: str = "model",
                      batch_size: int = 64, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """``df`` with the prediction of one batched model."""
    return score_all(df, [BatchScorer(name, load, batch_size, max_tokens)], text)


def score_native(df: DataFrame, scorer: NativeScorer, text: str = "text") -> DataFrame:
    """``df`` with the prediction of one native scorer."""
    return score_all(df, [scorer], text)
