"""Personal data: exact base patterns, and a semi-Markov conditional random field that adds spans they miss.

The field scores whole candidate spans (how many digits in which groups, separators, check digits, what stands beside
them), and a dynamic program over spans of bounded length chooses boundaries and kinds of a stretch of text together.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailbench.llm.common import kept, texts_of

# Fixed values of the contract: kinds in their order, and the base patterns.
KINDS = ("email", "ip", "card", "phone")
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
CARD_DIGITS, PHONE_DIGITS, LARGEST_PART = (14, 19), (10, 15), 255

# The same languages, written so that no text makes a search start over at every character.
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
_PHONE = re.compile(PHONE)
_DIGIT = re.compile("[0-9]")
_NO_DIGITS = re.compile("[^0-9]+")

Span = tuple[int, int, int]  # start, number of the kind, end


def luhn(digits: str) -> bool:
    """Check digit: from the right, every second digit counts twice, digit by digit."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        twice = int(d) << (i & 1)
        total += twice - 9 * (twice > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end = 0
    for match in _DOMAIN.finditer(text):
        at, width = match.start(), 64
        while True:
            left = max(end, at - width)
            run = text[left:at]
            start = left + len(run.rstrip(_LOCAL))
            if start > left or left == end:
                break
            width *= 4
        if start < at:
            yield start, match.end()
            end = match.end()


def base_spans(text: str) -> list[Span]:
    """What the base patterns find, each kind by itself, leftmost and without overlaps; matches that fail their check are dropped."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= LARGEST_PART for part in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= CARD_DIGITS[0]:
                digits = _NO_DIGITS.sub("", m[0])
                if CARD_DIGITS[0] <= len(digits) <= CARD_DIGITS[1] and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text):
            if PHONE_DIGITS[0] <= len(_NO_DIGITS.sub("", m[0])) <= PHONE_DIGITS[1]:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


# Stretches of text that may hold a span, and their atoms

MOST_ATOMS = 24  # of one span
MOST_DIGITS = 19
_AT = re.compile(r"\s?[\[({<]\s?(?:at|AT|@)\s?[\])}>]\s?|\s?[@＠]\s?")
_AT_WORD = re.compile(r" (?:at|AT) (?=[\w-]+ (?:dot|DOT) )")
_NUMBERS = re.compile(
    r"(?:\+ ?)?\(?[0-9]++(?:(?:[ .\-/()\[\]_\xa0+]{1,4}+|\s?[\[({]\s?(?:dot|DOT|\.)\s?[\])}]\s?| (?:dot|DOT) )[0-9]++)*+")
_ATOM = re.compile(r"[0-9]+|[^\W\d_]+|[\s\S]")
_BESIDE = 40  # characters on either side of an at sign that a stretch reaches
_CUES = (  # Fixed values: words that announce a number or address
    ("mail", "contact", "email", "write"), ("ip", "host", "server", "addr", "address"),
    ("card", "visa", "amex", "mastercard", "credit"), ("phone", "tel", "call", "fax", "mobile", "telephone"))
_CUE_OF = {word: i + 1 for i, words in enumerate(_CUES) for word in words}


def stretches(text: str) -> list[tuple[int, int]]:
    """Ranges of the text outside of which no candidate lies, in order and apart from each other."""
    found = []
    if _DIGIT.search(text):
        for m in _NUMBERS.finditer(text):
            if m.end() - m.start() >= 7 and sum(map(str.isdigit, m[0])) >= 4:
                found.append(m.span())
    ats = [*_AT.finditer(text)]
    if " dot " in text or " DOT " in text:
        ats += _AT_WORD.finditer(text)
    found += [(max(0, m.start() - _BESIDE), min(len(text), m.end() + _BESIDE)) for m in ats]
    found.sort()
    out: list[tuple[int, int]] = []
    for a, b in found:
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


# Kinds of atoms
_SPACE, _HYPHEN, _POINT, _BRACKET, _SLASH, _DOT_WORD, _OTHER, _NUMBER, _LETTERS, _PLUS, _SIGN = range(11)
_KIND_OF = {" ": _SPACE, "\xa0": _SPACE, "\t": _SPACE, "\n": _SPACE, "-": _HYPHEN, ".": _POINT, "/": _SLASH, "_": _SLASH,
            **dict.fromkeys("()[]{}<>", _BRACKET), "+": _PLUS, "@": _SIGN, "＠": _SIGN}


def _kind(atom: str) -> int:
    if "0" <= atom[0] <= "9":
        return _NUMBER
    if atom[0].isalpha():
        return _DOT_WORD if atom in ("dot", "DOT") else _SIGN if atom in ("at", "AT") else _LETTERS
    return _KIND_OF.get(atom, _SPACE if atom.isspace() else _OTHER)


# Values of each feature; a candidate has one value of each.
FEATURES = {
    "digits": 21, "atoms": MOST_ATOMS + 1, "runs": 10, "longest": 21, "shortest": 9, "last": 9, "first": 4, "separators": 128,
    "signs": 12, "left": 8, "right": 8, "check": 3, "parts": 3, "letters": 4, "cue": 5, "check_digits": 63, "plus_digits": 42,
    "shape": 1024,
}
_OFFSETS = np.cumsum([0, *FEATURES.values()])
N_FEATURES = int(_OFFSETS[-1])


class Stretch:
    """Atoms of one stretch, and features of all candidate spans that start in a range of atoms."""

    def __init__(self, text: str, start: int, end: int):
        before = text[max(0, start - 24):start]
        atoms = [(m.start() + start, m[0]) for m in _ATOM.finditer(text[start:end])]
        self.at = np.array([a for a, _ in atoms] + [end])
        kinds = np.array([_kind(x) for _, x in atoms], np.int64)
        self.kinds, self.n = kinds, len(atoms)
        self.beside = (_kind(text[start - 1]) if start else _SPACE), (_kind(text[end]) if end < len(text) else _SPACE)
        words = re.findall(r"[^\W\d_]+", before.lower())[-3:]
        self.cue = next((c for w in reversed(words) if (c := _CUE_OF.get(w))), 0)
        numbers = [x if k == _NUMBER else "" for (_, x), k in zip(atoms, kinds)]
        self.lengths = np.array([len(x) for x in numbers], np.int64)
        self.octet = np.array([bool(x) and len(x) <= 3 and int(x) <= LARGEST_PART for x in numbers], bool)
        self.letters = np.array([len(x) if k == _LETTERS else 0 for (_, x), k in zip(atoms, kinds)], np.int64)
        digits = np.frombuffer("".join(numbers).encode("ascii", "replace"), np.uint8).astype(np.int64) - 48
        twice = 2 * digits - 9 * (digits > 4)
        odd = np.arange(len(digits)) % 2 == 1
        self.checks = [np.append(0, np.cumsum(np.where(odd == side, twice, digits))) for side in (False, True)]
        self.sums = {"digits": self._upto(self.lengths), "runs": self._upto(kinds == _NUMBER), "octets": self._upto(self.octet),
                     "letters": self._upto(self.letters), "signs": self._upto(kinds == _SIGN),
                     "points": self._upto((kinds == _POINT) | (kinds == _DOT_WORD))}
        self.of_kind = [self._upto(kinds == k) for k in range(_OTHER + 1)]

    @staticmethod
    def _upto(values: np.ndarray) -> np.ndarray:
        return np.append(0, np.cumsum(values))

    def candidates(self, first: int, last: int, blocked: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end atom of the candidates starting in ``first`` to ``last``, and their features as rows of ``N_FEATURES`` weights.

        Candidates begin and end with a word, a number, a plus or a bracket before digits, and have one at sign and a dot,
        four numbers that may be an address, or 7 to 19 digits.  ``blocked`` ranges of the text are not touched.
        """
        kinds = self.kinds
        start = np.repeat(np.arange(first, last), MOST_ATOMS)
        stop = start + np.tile(np.arange(1, MOST_ATOMS + 1), last - first)
        inside = stop <= self.n
        start, stop = start[inside], stop[inside]

        def count(name):
            return self.sums[name][stop] - self.sums[name][start]

        head, tail = kinds[start], kinds[stop - 1]
        after_head = kinds[np.minimum(start + 1, self.n - 1)]
        # The words at and dot are signs and dots, and no ends of a span.
        opens = (head == _NUMBER) | (head == _LETTERS) | (((head == _PLUS) | (head == _BRACKET)) & (after_head == _NUMBER) & (stop - start > 1))
        closes = (tail == _NUMBER) | (tail == _LETTERS)
        digits, runs, signs, points = count("digits"), count("runs"), count("signs"), count("points")
        number = (signs == 0) & (count("letters") == 0) & (digits <= MOST_DIGITS) & (
            (digits >= 7) | ((digits >= 4) & (runs == 4) & (count("octets") == 4)))
        able = opens & closes & (number | ((signs == 1) & (points >= 1)))
        for a, b in blocked:
            able &= (self.at[stop] <= a) | (self.at[start] >= b)
        start, stop, head, tail = start[able], stop[able], head[able], tail[able]
        return start, stop, self._features(start, stop, head)

    def _features(self, start, stop, head) -> np.ndarray:
        kinds, n = self.kinds, self.n

        def count(name):
            return self.sums[name][stop] - self.sums[name][start]

        digits, runs, signs, points = count("digits"), count("runs"), count("signs"), count("points")
        rows = len(start)
        longest, shortest, last = np.zeros(rows, np.int64), np.full(rows, 99), np.zeros(rows, np.int64)
        shape = np.zeros(rows, np.int64)
        for step in range(MOST_ATOMS):
            at = start + step
            run = np.where(at < stop, self.lengths[np.minimum(at, n - 1)], 0)
            longest = np.maximum(longest, run)
            shortest = np.where(run > 0, np.minimum(shortest, run), shortest)
            last = np.where(run > 0, run, last)
            shape = np.where(run > 0, (shape * 31 + np.minimum(run, 17)) % 1021, shape)
        mask = np.zeros(rows, np.int64)
        for bit, upto in enumerate(self.of_kind):
            mask |= (upto[stop] > upto[start]).astype(np.int64) << bit
        low, high = self.sums["digits"][start], self.sums["digits"][stop]
        # The last digit counts once: which of the two sums holds depends on whether its place is odd.
        total = np.where((high - 1) % 2 == 1, self.checks[0][high] - self.checks[0][low], self.checks[1][high] - self.checks[1][low])
        in_range = (digits >= CARD_DIGITS[0]) & (digits <= CARD_DIGITS[1])
        check = np.where(in_range, 1 + (total % 10 == 0), 0)
        parts = np.where(runs == 4, 1 + (count("octets") == 4), 0)

        def side(beyond, further, edge):
            """What stands beside: letters, a number, a number after one separator, or else its kind."""
            ok, deep = (beyond >= 0) & (beyond < n), (further >= 0) & (further < n)
            near = np.where(ok, kinds[np.clip(beyond, 0, n - 1)], edge)
            far = np.where(deep, kinds[np.clip(further, 0, n - 1)], _OTHER)
            out = np.select([near == _LETTERS, near == _NUMBER, (far == _NUMBER) & (near == _SPACE), far == _NUMBER, near == _SPACE, near == _PLUS,
                             near == _SIGN], [1, 2, 3, 4, 0, 5, 6], 7)
            return out

        first = np.select([head == _NUMBER, head == _LETTERS, head == _PLUS], [0, 1, 2], 3)
        letters = np.digitize(count("letters"), [1, 3, 6])
        few = np.minimum(digits, 20)
        columns = [
            few, np.minimum(stop - start, MOST_ATOMS), np.minimum(runs, 9), np.minimum(longest, 20), np.minimum(shortest, 8), np.minimum(last, 8),
            first, mask, np.minimum(signs, 2) * 4 + np.minimum(points, 3), side(start - 1, start - 2, self.beside[0]),
            side(stop, stop + 1, self.beside[1]), check, parts, letters, np.full(rows, self.cue), check * 21 + few,
            (first == 2) * 21 + few, shape,
        ]
        return np.stack(columns, axis=1) + _OFFSETS[:-1]


# The field: weights of features by kind, and of a label after a label (0 is text, 1 to 4 the kinds)


class SpanField:
    def __init__(self, weights: np.ndarray, follows: np.ndarray, margin: float = 1.0):
        self.weights, self.follows, self.margin = weights, follows, margin

    def scores(self, features: np.ndarray) -> np.ndarray:
        return self.weights[features].sum(axis=1) - self.margin

    def decode(self, stretch: Stretch, blocked: list[tuple[int, int]], step: int = 4096) -> list[tuple[int, int, int]]:
        """Start atom, end atom and kind of the spans of the best labelling; candidates are made for ``step`` atoms at a time."""
        n, labels = stretch.n, len(KINDS) + 1
        best = np.full((n + 1, labels), -np.inf)
        back = np.full((n + 1, labels, 2), -1, np.int64)  # where the segment starts, and the label before it
        best[0, 0] = 0.0
        for first in range(0, n, step):
            last = min(first + step, n)
            start, stop, features = stretch.candidates(first, last, blocked)
            scores = self.scores(features) if len(start) else np.zeros((0, labels - 1))
            edges = np.searchsorted(start, np.arange(first, last + 1))
            if not len(start) and first == 0 and last == n:
                return []
            for i in range(first, last):
                here = best[i]
                # One atom of text.
                ways = here + self.follows[:, 0]
                label = int(ways.argmax())
                if ways[label] > best[i + 1, 0]:
                    best[i + 1, 0], back[i + 1, 0] = ways[label], (i, label)
                low, high = edges[i - first], edges[i - first + 1]
                if low == high:
                    continue
                reach = here[:, None] + self.follows[:, 1:]
                before, most = reach.argmax(axis=0), reach.max(axis=0)
                for c in range(low, high):
                    value = most + scores[c]
                    for kind in np.flatnonzero(value > best[stop[c], 1:]):
                        best[stop[c], kind + 1], back[stop[c], kind + 1] = value[kind], (i, before[kind])
        out, at, label = [], n, int(best[n].argmax())
        while at > 0:
            start, before = back[at, label]
            if label:
                out.append((int(start), at, label - 1))
            at, label = int(start), int(before)
        return out[::-1]

    def added(self, text: str, base: list[Span]) -> list[Span]:
        """Spans beside the base ones, none of which they touch."""
        out = []
        taken = sorted((a, b) for a, _, b in base)
        for start, end in stretches(text):
            near = taken[max(0, bisect_left(taken, (start, 0)) - 4):bisect_left(taken, (end, 0))] if taken else []
            stretch = Stretch(text, start, end)
            for a, b, kind in self.decode(stretch, near):
                out.append((int(stretch.at[a]), kind, int(stretch.at[b])))
        return out

    def spans(self, text: str) -> tuple[list[Span], list[Span]]:
        """Base spans, and all spans."""
        base = base_spans(text)
        return base, sorted(base + self.added(text, base))


# Training

Example = tuple[str, list[Span]]


class _Batch:
    """Candidates of all training stretches, side by side, with the labelled ones marked."""

    def __init__(self, examples: Iterable[Example]):
        size, rows = [], [[], [], [], [], []]
        for text, spans in examples:
            wanted = {(a, b): k for a, k, b in spans}
            for start, end in stretches(text):
                stretch = Stretch(text, start, end)
                if stretch.n > 400:
                    continue
                first, last, features = stretch.candidates(0, stretch.n, [])
                places = list(zip(stretch.at[first].tolist(), stretch.at[last].tolist()))
                kinds = np.array([wanted.get(p, -1) for p in places], np.int64)
                if sum(start <= a and b <= end for a, b in wanted) != (kinds >= 0).sum():
                    continue  # a labelled span that is no candidate
                for column, values in zip(rows, (np.full(len(first), len(size)), first, last, features, kinds)):
                    column.append(values)
                size.append(stretch.n)
        self.size = np.array(size, np.int64)
        if not size:
            rows = [[np.zeros(0, np.int64)] for _ in rows]
            rows[3] = [np.zeros((0, len(FEATURES)), np.int64)]
        self.owner, self.start, self.stop, self.features, self.kind = (np.concatenate(c) for c in rows)
        steps = np.arange(int(self.size.max(initial=0)) + 2)
        # Candidates by where they stop, for the way forth, and by where they start, for the way back.
        self.by_stop, self.by_start = np.argsort(self.stop, kind="stable"), np.argsort(self.start, kind="stable")
        self.stops = np.searchsorted(self.stop[self.by_stop], steps)
        self.starts = np.searchsorted(self.start[self.by_start], steps)

    def gold_follows(self, labels: int) -> np.ndarray:
        """How often each label follows each in the marked labelling."""
        out = np.zeros((labels, labels))
        marked = np.flatnonzero(self.kind >= 0)
        order = marked[np.lexsort((self.start[marked], self.owner[marked]))]
        at = 0
        for stretch, n in enumerate(self.size):
            place, before = 0, 0
            while at < len(order) and self.owner[order[at]] == stretch:
                c = order[at]
                gap = self.start[c] - place
                if gap:
                    out[before, 0] += 1
                    out[0, 0] += gap - 1
                    before = 0
                out[before, self.kind[c] + 1] += 1
                place, before, at = self.stop[c], self.kind[c] + 1, at + 1
            if n > place:
                out[before, 0] += 1
                out[0, 0] += n - place - 1
        return out


def _log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(a - top).sum(axis=axis)) + top.squeeze(axis)


def _expected(batch: _Batch, weights: np.ndarray, follows: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Probabilities of every candidate and kind, expected label pairs, and the sum of log partition sums."""
    labels, n = len(follows), int(batch.size.max())
    scores = weights[batch.features].sum(axis=1)
    forth = np.full((len(batch.size), n + 1, labels), -np.inf)
    forth[:, 0, 0] = 0.0
    for j in range(1, n + 1):
        forth[:, j, 0] = _log_sum(forth[:, j - 1] + follows[:, 0], 1)
        c = batch.by_stop[batch.stops[j]:batch.stops[j + 1]]
        if len(c):
            before = forth[batch.owner[c], batch.start[c]]
            ways = _log_sum(before[:, :, None] + follows[None, :, 1:], 1) + scores[c]
            np.logaddexp.at(forth[:, j, 1:], batch.owner[c], ways)
    whole = _log_sum(forth[np.arange(len(batch.size)), batch.size], 1)
    back = np.full((len(batch.size), n + 1, labels), -np.inf)
    pairs = np.zeros_like(follows)
    marginal = np.zeros_like(scores)
    for j in range(n, -1, -1):
        back[batch.size == j, j] = 0.0
        if j < n:
            on = batch.size > j
            step = back[on, j + 1, 0]
            back[on, j] = np.logaddexp(back[on, j], step[:, None] + follows[:, 0])
            pairs[:, 0] += np.exp(forth[on, j] + follows[:, 0] + (step - whole[on])[:, None]).sum(axis=0)
            c = batch.by_start[batch.starts[j]:batch.starts[j + 1]]
            if len(c):
                ahead = scores[c] + back[batch.owner[c], batch.stop[c], 1:]  # candidates x kinds
                both = follows[None, :, 1:] + ahead[:, None, :]
                np.logaddexp.at(back[:, j], batch.owner[c], _log_sum(both, 2))
                mass = np.exp(forth[batch.owner[c], j][:, :, None] + both - whole[batch.owner[c]][:, None, None])
                marginal[c] = mass.sum(axis=1)
                pairs[:, 1:] += mass.sum(axis=0)
    return marginal, pairs, float(whole.sum())


def train(examples: Iterable[Example], rounds: int = 80, rate: float = 0.15, decay: float = 2e-3, margin: float = 1.0) -> SpanField:
    """Weights of the largest conditional likelihood of the examples' labels, by Adam over all of them at once."""
    batch, labels = _Batch(examples), len(KINDS) + 1
    weights, follows = np.zeros((N_FEATURES, labels - 1)), np.zeros((labels, labels))
    if not len(batch.size):
        return SpanField(weights - 1.0, follows, margin)
    flat = batch.features.ravel()
    gold_pairs, gold = batch.gold_follows(labels), np.zeros((len(batch.kind), labels - 1))
    gold[batch.kind >= 0, batch.kind[batch.kind >= 0]] = 1.0
    state = [(x, np.zeros_like(x), np.zeros_like(x)) for x in (weights, follows)]
    for step in range(1, rounds + 1):
        marginal, pairs, _ = _expected(batch, weights, follows)
        change = np.repeat(gold - marginal, batch.features.shape[1], axis=0)
        up = np.stack([np.bincount(flat, change[:, k], N_FEATURES) for k in range(labels - 1)], axis=1)
        for (value, first, second), slope in zip(state, (up / len(batch.size) - decay * weights,
                                                         (gold_pairs - pairs) / len(batch.size) - decay * follows)):
            first += 0.1 * (slope - first)
            second += 0.01 * (slope * slope - second)
            value += rate * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.99 ** step)) + 1e-6)
    return SpanField(weights, follows, margin)


def _with_check_digit(rng: random.Random, n: int) -> str:
    body = "".join(rng.choice("0123456789") for _ in range(n - 1))
    return body + next(d for d in "0123456789" if luhn(body + d))


def _without_check_digit(rng: random.Random, n: int) -> str:
    body = _with_check_digit(rng, n)
    return body[:-1] + str((int(body[-1]) + rng.randint(1, 9)) % 10)


def _digits(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("0123456789") for _ in range(n))


def _word(rng: random.Random) -> str:
    return "".join(rng.choice("abcdefghijklmnopqrstuvwxyzéüñ") for _ in range(rng.randint(2, 9)))


def _entity(rng: random.Random, kind: int) -> str:
    if kind == 0:
        at = rng.choice(["@", "@", " (at) ", "[at]", " [at] ", " {at} ", " AT ", " at ", " @ ", "＠"])
        dot = rng.choice([" dot ", " DOT "]) if at in (" AT ", " at ") else rng.choice([".", ".", " (dot) ", "[dot]", " [.] "])
        local = rng.choice(["", f"{_ascii(rng)}.", f"{_ascii(rng)}_"]) + rng.choice([_ascii(rng), _ascii(rng) + _digits(rng, 2)])
        return local + at + dot.join(_ascii(rng) for _ in range(rng.choice([2, 2, 3])))
    if kind == 1:
        return rng.choice([".", ".", "[.]", " . ", "(dot)", " dot ", "[dot]"]).join(str(rng.randint(0, 255)) for _ in range(4))
    if kind == 2:
        n = rng.choice([14, 15, 16, 16, 16, 16, 17, 18, 19])
        number, gap = _with_check_digit(rng, n), rng.choice(["", "", "", " ", "-", ".", "/", "_"])
        return gap.join(number[i:i + 4] for i in range(0, n, 4)) if gap else number
    a, b, c = _digits(rng, 3), _digits(rng, 3), _digits(rng, 4)
    return rng.choice([
        f"+{rng.randint(1, 99)} ({a}) {b}-{c}", f"+{rng.randint(1, 99)} {a} {b} {c}", f"+1-{a}-{b}-{c}", f"+{rng.randint(1, 99)}{a}{b}{c}",
        f"({a}) {b}-{c}", f"({a}) {b} {c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{rng.randint(20, 99)} {a} {b}{c}"])


def _ascii(rng: random.Random) -> str:
    return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))


def _decoy(rng: random.Random) -> str:
    """Numbers and signs that are no personal data."""
    d, pick = _digits, rng.randint(0, 17)
    hexa = "".join(rng.choice("0123456789abcdef") for _ in range(40))
    return [
        _without_check_digit(rng, 16), _without_check_digit(rng, rng.randint(14, 19)), hexa, f'token = "{hexa}"',
        f"20{d(rng, 2)}-0{rng.randint(1, 9)}-{rng.randint(10, 28)}", f"{rng.randint(10, 28)}.{rng.randint(10, 12)}.20{d(rng, 2)}",
        f"20{d(rng, 2)}-0{rng.randint(1, 9)}-{rng.randint(10, 28)} {d(rng, 2)}:{d(rng, 2)}:{d(rng, 2)}", f"{d(rng, 3)} {d(rng, 3)} {d(rng, 3)}",
        f"{d(rng, 3)}.{d(rng, 3)}.{d(rng, 3)},{d(rng, 2)}", d(rng, rng.randint(7, 13)), d(rng, rng.randint(20, 30)),
        f"978-{d(rng, 1)}-{d(rng, 2)}-{d(rng, 6)}-{d(rng, 1)}", " ".join(f"20{d(rng, 2)}" for _ in range(rng.randint(2, 7))),
        " ".join(d(rng, rng.randint(1, 3)) for _ in range(rng.randint(3, 14))), f"{d(rng, 4)}-{d(rng, 4)}",
        ".".join(str(rng.randint(256, 999)) for _ in range(4)), f"see @ {_word(rng)}", f"{_without_check_digit(rng, 16)} {_without_check_digit(rng, 16)}",
    ][pick]


def generated_examples(n: int = 1500, seed: int = 7) -> list[Example]:
    """Labelled texts made by rule: entities as written plainly and in disguise, side by side, and decoys among words."""
    rng, out = random.Random(seed), []
    for _ in range(n):
        text, spans = " ".join(_word(rng) for _ in range(3)), []
        for _ in range(rng.choice([1, 1, 2, 3])):
            text += rng.choice([" ", " ", " ", ": ", "\n", " (", ", "])
            # Beside a disguise with spaces or another entity, a single space; words elsewhere.
            kind = rng.choice([0, 1, 2, 3, 4, 4])
            if kind == 4:
                text += _decoy(rng)
            else:
                start = len(text)
                text += _entity(rng, kind)
                spans.append((start, kind, len(text)))
            if rng.random() < 0.6:
                text += rng.choice([" ", ", ", ". ", ") ", "### "]) + " ".join(_word(rng) for _ in range(rng.randint(1, 3)))
        out.append((text + rng.choice(["", ".", " " + _word(rng)]), spans))
    return out


def labelled_windows(df: DataFrame, key: str, text: str, rows: int = 2000, windows: int = 4, beside: int = 80) -> list[Example]:
    """Texts around numbers and at signs of ``rows`` documents, labelled by the base patterns.

    The rows are those whose keys have the smallest hashes, so that any order of the table gives the same ones; the driver gets at
    most ``rows * windows`` short texts.  Windows with a match that failed for being too long are left out: what it holds is not known.
    """
    order = F.xxhash64(F.col(key).cast("string"))
    picked = df.select(order.alias("_order")).distinct().orderBy("_order").limit(rows)

    def run(batches):
        for batch in batches:
            found = []
            for whole in texts_of(batch, "_text"):
                for a, b in stretches(whole)[:windows]:
                    if b - a <= 4 * beside:
                        found.append(whole[max(0, a - beside):b + beside])
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["window"])

    chosen = df.select(order.alias("_order"), F.col(text).alias("_text")).join(picked, "_order", "left_semi")
    texts = [r[0] for r in chosen.select("_text").mapInArrow(run, "window string").distinct().limit(rows * windows).collect()]
    out = []
    for window in sorted(texts):
        failed = [m for m in _PHONE.finditer(window) if len(_NO_DIGITS.sub("", m[0])) > PHONE_DIGITS[1]]
        failed += [m for m in _CARD.finditer(window) if len(_NO_DIGITS.sub("", m[0])) > CARD_DIGITS[1]]
        spans = base_spans(window)
        overlaps = any(a < d and c < b for i, (a, _, b) in enumerate(spans) for c, _, d in spans[:i])
        if not failed and not overlaps:
            out.append((window, spans))
    return out


@cache
def default_field() -> SpanField:
    return train(generated_examples())


# Spark


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def masked_text(text: str, spans: list[Span]) -> str:
    """The text with each span, or each group of overlapping ones, replaced by its kind in brackets."""
    out, end = [], 0
    for start, kind, stop in spans:
        if start >= end:
            out += [text[end:start], f"[{KINDS[kind].upper()}]"]
        end = max(end, stop)
    return "".join([*out, text[end:]])


def personal_data(df: DataFrame, key: str, text: str, field: SpanField | None = None, with_text: bool = False) -> DataFrame:
    """``key, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added`` of every row; with ``with_text`` also the ``masked`` text.

    Counts and hash are those of the base patterns.  ``spans`` has all spans as kind:start:end in code points, by start and
    then kind; ``n_added`` of them come from ``field``, by default one trained on generated examples, and touch no base span.
    Null texts are empty and have no spans; repeated rows and null keys are answered row by row; other columns are not read.  An
    empty table gives an empty result.  A stretch of numbers of any length is decoded whole, with candidates for 4096 atoms at a time.
    """
    model = field or default_field()
    weights, follows, margin = model.weights, model.follows, model.margin
    kind = df.schema[key].dataType.simpleString()
    counts = [f"n_{k}" for k in KINDS]
    schema = f"_key {kind}, " + ", ".join(f"{c} long" for c in counts) + ", base_sha256 string, spans string, n_added long"
    if with_text:
        schema += ", masked string"

    def run(batches):
        own = SpanField(weights, follows, margin)
        for batch in batches:
            columns = [[] for _ in range(len(counts) + 3 + with_text)]
            for one in texts_of(batch, "_text"):
                base, every = own.spans(one)
                row = [sum(k == i for _, k, _ in base) for i in range(len(KINDS))]
                row += [hashlib.sha256(listed(base).encode()).hexdigest(), listed(every), len(every) - len(base)]
                for column, value in zip(columns, [*row, masked_text(one, every)] if with_text else row):
                    column.append(value)
            kinds = [pa.int64()] * len(counts) + [pa.string(), pa.string(), pa.int64(), pa.string()]
            arrays = [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))]
            names = ["_key", *counts, "base_sha256", "spans", "n_added", "masked"]
            yield pa.RecordBatch.from_arrays(arrays, names=names[:len(arrays)])

    narrow = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    return narrow.mapInArrow(run, schema).withColumnRenamed("_key", key)
