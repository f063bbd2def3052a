"""Base patterns against plain regular expressions, decoding against all labellings, and held-out accuracy."""

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mailbench.llm import personal_data as P

PATTERNS = (P.EMAIL, P.IP, P.CARD, P.PHONE)
ODD = ["", None, "@", "a@b", "a@b.c", "@a.b@c.d", "1.2.3.4.5.6.7.8", "256.1.1.1", "001.02.3.4", "4" * 30, "+1 (2", "+" * 500, "1 " * 400,
       "x" * 100_000, "9" * 100_000, "a@" * 5000, "é.55@mail4.example.com", "4539 1488 0343 6467", "4539-1488-0343-6468", "+1 (017) 555-7713"]


def brute_base(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind == 0 or kind == 1 and all(int(p) <= 255 for p in m[0].split(".")) or kind == 2 and 14 <= len(digits) <= 19 and P.luhn(digits)
                    or kind == 3 and 10 <= len(digits) <= 15):
                out.append((m.start(), kind, m.end()))
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab.@+-_ ()0123456789é\n", max_size=60))
def test_base_patterns(text):
    assert P.base_spans(text) == brute_base(text)


def test_base_patterns_on_odd_texts():
    for text in ODD:
        if len(text or "") < 20_000:
            assert P.base_spans(text or "") == brute_base(text or "")
        else:
            assert isinstance(P.base_spans(text), list)  # the plain patterns take the square of the length


@pytest.fixture(scope="module")
def field():
    return P.default_field()


def brute_best(field, stretch, blocked=()):
    """The best score of all labellings, one by one."""
    start, stop, features = stretch.candidates(0, stretch.n, list(blocked))
    scores = field.scores(features) if len(start) else []
    at = {}
    for c in range(len(start)):
        at.setdefault(int(start[c]), []).append(c)
    best = -np.inf
    waiting = [(0, 0, 0.0)]
    while waiting:
        i, label, total = waiting.pop()
        if i == stretch.n:
            best = max(best, total)
            continue
        waiting.append((i + 1, 0, total + field.follows[label, 0]))
        for c in at.get(i, ()):
            waiting += [(int(stop[c]), k + 1, total + field.follows[label, k + 1] + scores[c][k]) for k in range(len(P.KINDS))]
    return best


def total_of(field, stretch, spans):
    start, stop, features = stretch.candidates(0, stretch.n, [])
    scores = field.scores(features)
    where = {(int(a), int(b)): i for i, (a, b) in enumerate(zip(start, stop))}
    total, i, label = 0.0, 0, 0
    for a, b, kind in [*spans, (stretch.n, stretch.n, None)]:
        while i < a:
            total, label, i = total + field.follows[label, 0], 0, i + 1
        if kind is not None:
            total += field.follows[label, kind + 1] + scores[where[a, b]][kind]
            label, i = kind + 1, b
    return total


def test_decoding_is_the_best_of_all_labellings(field):
    tried = 0
    for text in ("a 555 1234 5678 b", "(017) 555-7713", "x @ yy.zz", "4539148803436467 12", "1.2.3.4 5"):
        for a, b in P.stretches(text):
            stretch = P.Stretch(text, a, b)
            for step in (1, 3, 4096):
                spans = field.decode(stretch, [], step)
                assert total_of(field, stretch, spans) == pytest.approx(brute_best(field, stretch))
                tried += 1
    assert tried >= 9


def test_probabilities_against_all_labellings(field):
    """Marginals of training by adding up every labelling."""
    batch = P._Batch([("555 123 4567 1", [(0, 3, 12)])])
    rng = np.random.default_rng(1)
    weights, follows = rng.normal(size=field.weights.shape) / 5, rng.normal(size=field.follows.shape) / 5
    marginal, pairs, whole = P._expected(batch, weights, follows)
    scores, n = weights[batch.features].sum(axis=1), int(batch.size[0])
    want, want_pairs, total = np.zeros_like(marginal), np.zeros_like(pairs), 0.0
    waiting = [(0, 0, 0.0, (), ())]
    while waiting:
        i, label, value, used, met = waiting.pop()
        if i == n:
            mass = np.exp(value)
            total += mass
            for u in used:
                want[u] += mass
            for m in met:
                want_pairs[m] += mass
            continue
        waiting.append((i + 1, 0, value + follows[label, 0], used, (*met, (label, 0))))
        for c in np.flatnonzero(batch.start == i):
            waiting += [(int(batch.stop[c]), k + 1, value + follows[label, k + 1] + scores[c, k], (*used, (c, k)), (*met, (label, k + 1)))
                        for k in range(len(P.KINDS))]
    assert np.log(total) == pytest.approx(whole)
    assert np.allclose(want / total, marginal) and np.allclose(want_pairs / total, pairs)


def test_held_out_accuracy(field):
    right = extra = missed = 0
    for text, spans in P.generated_examples(400, seed=99):
        found = set(field.spans(text)[1])
        right += len(found & set(spans))
        extra += len(found - set(spans))
        missed += len(set(spans) - found)
    assert right / (right + extra) > 0.93 and right / (right + missed) > 0.9


def test_spans_that_base_patterns_lose(field):
    """Neighbours that the patterns run together, and disguises; numbers that are no personal data stay."""
    rng = random.Random(3)
    good, bad = P._with_check_digit(rng, 16), P._without_check_digit(rng, 16)
    for text, want in ((f"x {bad} {good} y", [good]), (f"x {good} {good} y", [good, good]),
                       ("des +1 (826) 555-4081 190.137.223.204 du", ["+1 (826) 555-4081", "190.137.223.204"]),
                       ("ask bob.smith (at) mail (dot) org now", ["bob.smith (at) mail (dot) org"])):
        base, every = field.spans(text)
        assert [text[a:b] for a, _, b in every] == want and set(base) < set(every) | {()}
    for text in (f"nr {bad} end", f'token = "{"".join(rng.choice("0123456789abcdef") for _ in range(40))}"', "on 2024-05-06 14:33:10 it", "years 2019 2020 2021"):
        assert field.spans(text) == ([], [])


def test_added_spans_touch_no_base_span(field):
    for text, _ in P.generated_examples(200, seed=5):
        base, every = field.spans(text)
        assert set(base) <= set(every)
        for a, _, b in set(every) - set(base):
            assert all(b <= c or d <= a for c, _, d in base)


def test_query_rows(spark, field):
    texts = [*ODD, *(t for t, _ in P.generated_examples(60, seed=8))]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, "a@b.cd", "x", 1), (4, "a@b.c", "y", 2), (4, "a@b.c", "y", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string, _key int")
    got = P.personal_data(df, "doc_id", "text", with_text=True)
    assert got.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added", "masked"]
    want = []
    for key, text, *_ in rows:
        base, every = field.spans(text or "")
        counts = [sum(k == i for _, k, _ in base) for i in range(4)]
        digest = hashlib.sha256(",".join(f"{P.KINDS[k]}:{a}:{b}" for a, k, b in base).encode()).hexdigest()
        want.append((key, *counts, digest, ",".join(f"{P.KINDS[k]}:{a}:{b}" for a, k, b in every), len(every) - len(base), P.masked_text(text or "", every)))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert P.personal_data(df.limit(0), "doc_id", "text").collect() == []


def test_masked_text():
    text = "a@b.cd and 1.2.3.4!"
    assert P.masked_text(text, P.base_spans(text)) == "[EMAIL] and [IP]!"


def test_labelled_windows(spark):
    rows = [(i, t) for i, (t, _) in enumerate(P.generated_examples(80, seed=11))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    some = P.labelled_windows(df, "doc_id", "text", rows=50)
    assert 0 < len(some) <= 200 and all(spans == P.base_spans(text) for text, spans in some)
    assert some == P.labelled_windows(df.repartition(5), "doc_id", "text", rows=50)
    model = P.train([*P.generated_examples(200), *some], rounds=30)
    assert model.spans("x 10.0.0.1 y")[1] == [(2, 1, 10)]
