"""Conversation repair against a shortest path over rows and states."""

import hashlib
import heapq
import re
import zlib

import numpy as np
import pytest

from mailbench.llm import conversation_repair as C

WORD = re.compile(r"[^\x20\x09-\x0D]")
STATES = {("0", "s"): "s", ("0", "u"): "u", ("s", "u"): "u", ("u", "a"): "e", ("e", "u"): "u"}


def best_path(rows):
    """Cheapest edits by Dijkstra, ties by the edits; rows are (role, text, fault)."""
    heap, seen = [(0, "", 0, "0", ())], set()
    while heap:
        cost, edits, i, state, out = heapq.heappop(heap)
        if i == len(rows) and state in "0e":
            return cost, edits, out
        if (i, state) in seen:
            continue
        seen.add((i, state))
        given = [(r, STATES[state, r[0]]) for r in ("user", "assistant") if (state, r[0]) in STATES]
        for role, new in given:
            heapq.heappush(heap, (cost + 3, edits + "I", i, new, (*out, (role, ""))))
        if i < len(rows):
            role, text, fault = rows[i]
            extra = 3 * (fault == "truncated")
            heapq.heappush(heap, (cost + 4, edits + "D", i + 1, state, out))
            if fault not in ("blank", "duplicate"):
                if (state, role[:1]) in STATES:
                    heapq.heappush(heap, (cost + extra, edits + "K", i + 1, STATES[state, role[:1]], (*out, (role, text))))
                for new_role, new in given:
                    heapq.heappush(heap, (cost + extra + 3, edits + "R", i + 1, new, (*out, (new_role, text))))


def brute(data, damage=True):
    convs = {}
    for conv, turn, role, text in data:
        space = [" " if x is None else x for x in (conv, turn, role, text)]
        rows, (role, text) = convs.setdefault(conv, []), space[2:]
        code = zlib.crc32(f"{space[0]}:{space[1]}".encode()) % 20 if damage else 9
        if code == 0:
            continue
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        rows += [(turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    out = {}
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        seen, faulty = set(), []
        for _, role, text in rows:
            marks = WORD.findall(text)
            fault = "blank" if not marks else "duplicate" if (role, text) in seen else "" if marks[-1] in ".!?" else "truncated"
            faulty.append((role, text, fault))
            seen.add((role, text))
        turns = [t for t, _, _ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        cost, edits, repaired = best_path(faulty)
        faults = [f for _, _, f in faulty]
        out[conv] = (conv, gaps, *map(faults.count, C.FAULTS), illegal, cost, edits,
                     hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest())
    return out


def conversations(seed, n, longest=12):
    rng = np.random.default_rng(seed)
    texts = ["Yes.", "No?", "cut off", " \t", "", "ok.  \n", "why!", "É.", "so , "]
    rows = []
    for conv in range(n):
        turn = 0
        for _ in range(rng.integers(1, longest)):
            turn += int(rng.choice([1, 1, 1, 2, 5]))
            role = str(rng.choice(["user", "assistant", "system", "tool", "human", ""], p=[.4, .4, .08, .04, .04, .04]))
            text = str(rng.choice(texts)) + ("%d." % rng.integers(100) if rng.random() < 0.6 else "")
            rows.append((conv, turn, role, text))
    return rows


ODD = [(900, None, "user", "a."), (901, 1, None, "b."), (902, 1, "user", None), (None, 4, "user", "null key."), (903, None, None, None),
       (904, 2, "user", "same."), (904, 2, "user", "same."), (904, 3, "assistant", "x" * 50_000 + "."), (905, -3, "system", "only.")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, _key string, cost int")


@pytest.mark.parametrize("block", [512, 2])
@pytest.mark.parametrize("damage", [True, False])
def test_against_shortest_paths(spark, monkeypatch, block, damage):
    """Also with conversations cut into stretches of two rows, whose ways are put together again."""
    monkeypatch.setattr(C, "BLOCK_ROWS", block)
    rows = [*conversations(block, 120), *ODD]
    got = C.repair_conversations(frame(spark, rows), damage=damage)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    found = {r[0]: tuple(r) for r in got.collect()}
    want = brute(rows, damage)
    assert got.count() == len(want) and found == want


def test_one_conversation_over_many_tasks(spark, monkeypatch):
    """A conversation that holds nearly all rows is spread over tasks; roles that fit nowhere keep two ways tied all along."""
    monkeypatch.setattr(C, "BLOCK_ROWS", 64)
    rows = [(777, i, "human" if i % 200 < 150 else ("user", "assistant")[i % 2], f"t{i % 900}.") for i in range(3000)] + conversations(5, 6)[:20]
    got = {r[0]: tuple(r) for r in C.repair_conversations(frame(spark, rows).repartition(3)).collect()}
    assert got == brute(rows, False)


def test_everything_dropped_and_empty_tables(spark):
    dropped = next((c, t) for c in range(2000) for t in (1,) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    got = C.repair_conversations(frame(spark, [(*dropped, "user", "gone.")]), damage=True).collect()
    assert [tuple(r) for r in got] == [(dropped[0], 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert C.repair_conversations(frame(spark, []), damage=True).collect() == []


def test_repeated_row_is_split_over_tasks(spark):
    """Thousands of copies of one row: the first one counts, the others are duplicates."""
    rows = [(1, 1, "user", "same.")] * 2000 + [(1, 2, "assistant", "end.")]
    got = C.repair_conversations(frame(spark, rows)).first()
    assert (got["duplicate"], got["cost"], got["audit"]) == (1999, 4 * 1999, "K" + "D" * 1999 + "K")


def test_automaton_is_made_from_the_grammar():
    """Stacks of the role grammar, and a grammar with a choice that only a later role settles."""
    p = C.parser()
    assert len(p.stacks()) == 8 and p.accepts(0)
    assert [p.given_role(n) for n in p.stacks() if p.inserts(n)]
    other = C.RoleParser((("C", ("A",)), ("C", ("B",)), ("A", ("x", "u")), ("B", ("y", "a")), ("x", ("s",)), ("y", ("s",))))
    (one, *more) = other.shift(0, "s")
    assert more  # two readings of one role live side by side
    ends = {t: [m for n in (one, *more) for m in other.shift(n, t)] for t in "ua"}
    assert all(other.accepts(n) for t in "ua" for n in ends[t]) and all(ends.values())


def test_lines_round_trip():
    rows = [C.Row("user", "a.", "", 1), C.Row("user", "b", "truncated", 2), C.Row("assistant", "", "blank", 3)]
    cost, edits, _ = C.ended(C.cheapest(rows))
    want = best_path([(r.role, r.text, r.fault) for r in rows])
    assert (cost, edits) == want[:2]
    assert list(C.replayed(rows, edits)) == list(want[2])
