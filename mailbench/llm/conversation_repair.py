"""Conversation repair: generalised LR parsing of roles with weighted edits.

A conversation's roles must spell a sentence of a small grammar.  Rows are kept, given another role or deleted, and
rows are inserted, at the least cost.  The parser holds a graph-structured stack: stacks are nodes that share their
tails, all of them move together, and equal stacks merge by the smaller (cost, edits so far).
"""

from __future__ import annotations

import hashlib
import json
from collections import namedtuple
from collections.abc import Iterable, Iterator
from functools import cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailbench.llm.common import arrow_schema
from mailbench.session import parallelism, stage

# Fixed values of the contract: what roles may follow each other, what edits cost, and what ends a sentence.
GRAMMAR = (("C", ()), ("C", ("P",)), ("C", ("s", "P")), ("P", ("u", "a")), ("P", ("P", "u", "a")))
NEXT_TO = ("su", "ua", "au")
GIVEN_ROLES = ("user", "assistant")
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
CHARACTER = r"[^\x20\x09-\x0D]"
ENDED = r"[.!?][\x20\x09-\x0D]*\z"

BLOCK_ROWS, BLOCK_CHARACTERS = 512, 1 << 20
_TRIM_EVERY = 64

Row = namedtuple("Row", "role text fault turn")  # fault: "", blank, duplicate or truncated
FAULTS = ("blank", "duplicate", "truncated")


class RoleParser:
    """LR(0) automaton of a grammar, and moves of whole stacks."""

    def __init__(self, grammar=GRAMMAR):
        self.rules = (("", (grammar[0][0],)), *grammar)
        self.names = {left for left, _ in self.rules}
        self.states: list[frozenset] = []
        self.goto: dict[tuple[int, str], int] = {}
        self._state(self._closure({(0, 0)}))
        # Stacks are nodes (state, node below), each made once: stacks with equal tops and tails are one node.
        self.nodes: list[tuple[int, int]] = [(0, -1)]
        self.numbers = {(0, -1): 0}
        self.shift, self.accepts, self.inserts = cache(self._shift), cache(self._accepts), cache(self._inserts)

    def _closure(self, items: set) -> frozenset:
        waiting = list(items)
        while waiting:
            rule, dot = waiting.pop()
            right = self.rules[rule][1]
            for other, (left, _) in enumerate(self.rules):
                if dot < len(right) and left == right[dot] and (other, 0) not in items:
                    items.add((other, 0))
                    waiting.append((other, 0))
        return frozenset(items)

    def _state(self, items: frozenset) -> int:
        if items in self.states:
            return self.states.index(items)
        number = len(self.states)
        self.states.append(items)
        for symbol in sorted({self.rules[r][1][d] for r, d in items if d < len(self.rules[r][1])}):
            moved = {(r, d + 1) for r, d in items if d < len(self.rules[r][1]) and self.rules[r][1][d] == symbol}
            self.goto[number, symbol] = self._state(self._closure(moved))
        return number

    def _push(self, node: int, symbol: str) -> int | None:
        state = self.goto.get((self.nodes[node][0], symbol))
        if state is None:
            return None
        pair = (state, node)
        if pair not in self.numbers:
            self.numbers[pair] = len(self.nodes)
            self.nodes.append(pair)
        return self.numbers[pair]

    def _reduced(self, node: int) -> set[int]:
        """The stack and all it becomes by reductions."""
        seen, waiting = {node}, [node]
        while waiting:
            top = waiting.pop()
            for rule, dot in self.states[self.nodes[top][0]]:
                left, right = self.rules[rule]
                if rule and dot == len(right):
                    below = top
                    for _ in right:
                        below = self.nodes[below][1]
                    new = self._push(below, left)
                    if new is not None and new not in seen:
                        seen.add(new)
                        waiting.append(new)
        return seen

    def _shift(self, node: int, terminal: str) -> tuple[int, ...]:
        """The stacks after one more role; those that can neither shift nor end are left out."""
        after = self._push(node, terminal) if terminal not in self.names else None
        if after is None:
            return ()
        able = [n for n in self._reduced(after)
                if any(s not in self.names for (state, s) in self.goto if state == self.nodes[n][0])]
        if self.accepts(after) and not any(map(self.accepts, able)):
            able.append(after)
        return tuple(sorted(able))

    def _accepts(self, node: int) -> bool:
        return any((0, 1) in self.states[self.nodes[n][0]] for n in self._reduced(node))

    def _inserts(self, node: int) -> tuple[int, ...]:
        return tuple(n for role in GIVEN_ROLES for n in self.shift(node, role[0]))

    def given_role(self, node: int) -> str:
        """The role an inserted or changed row gets."""
        return next(role for role in GIVEN_ROLES if self.shift(node, role[0]))

    def stacks(self) -> list[int]:
        """All stacks that roles can lead to; few, since the grammar repeats to the left."""
        found, waiting = {0}, [0]
        while waiting:
            node = waiting.pop()
            for terminal in sorted({s for _, s in self.goto if s not in self.names}):
                for new in self.shift(node, terminal):
                    if new not in found:
                        found.add(new)
                        waiting.append(new)
        return sorted(found)


@cache
def parser() -> RoleParser:
    return RoleParser()


Frontier = dict[int, tuple[int, str]]  # stack -> cost, edits


def _offer(frontier: Frontier, node: int, value: tuple[int, str]) -> bool:
    """Merge: of two ways to one stack the cheaper stays, and of equal costs that with the smaller edits.

    Ways of equal cost that have used the same rows have as many inserts, hence no edits that begin
    those of the other: what follows changes no order.
    """
    if node not in frontier or value < frontier[node]:
        frontier[node] = value
        return True
    return False


def _with_inserts(frontier: Frontier) -> None:
    waiting = list(frontier)
    while waiting:
        node = waiting.pop()
        cost, edits = frontier[node]
        for new in parser().inserts(node):
            if _offer(frontier, new, (cost + INSERT, edits + "I")):
                waiting.append(new)


def _after(frontier: Frontier, row: Row) -> Frontier:
    _with_inserts(frontier)
    move, out = parser(), {}
    extra = TRUNCATED if row.fault == "truncated" else 0
    required = row.fault in ("blank", "duplicate")
    for node, (cost, edits) in frontier.items():
        _offer(out, node, (cost + DELETE, edits + "D"))
        if not required:
            for new in move.shift(node, row.role[:1]):
                _offer(out, new, (cost + extra, edits + "K"))
            for new in move.inserts(node):
                _offer(out, new, (cost + extra + REROLE, edits + "R"))
    return out


def cheapest(rows: list[Row], start: int = 0) -> Frontier:
    """For every stack that ``rows`` can lead to from ``start``: the least cost and its edits."""
    frontier, settled = {start: (0, "")}, ""
    for i, row in enumerate(rows, 1):
        frontier = _after(frontier, row)
        if i % _TRIM_EVERY == 0:
            # What all ways begin with is settled; comparing and copying it would take time in the square of the rows.
            every = [edits for _, edits in frontier.values()]
            low, high = min(every), max(every)
            same = next((j for j, (a, b) in enumerate(zip(low, high)) if a != b), min(len(low), len(high)))
            settled += low[:same]
            frontier = {node: (cost, edits[same:]) for node, (cost, edits) in frontier.items()}
    return {node: (cost, settled + edits) for node, (cost, edits) in frontier.items()}


def ended(frontier: Frontier) -> tuple[int, str, int]:
    """Cost and edits of the best way to a whole sentence, inserts at the end included, and the stack it comes from."""
    ways = []
    for node, (cost, edits) in frontier.items():
        own = {node: (cost, edits)}
        _with_inserts(own)
        ways += [(*value, node) for end, value in own.items() if parser().accepts(end)]
    return min(ways)


def replayed(rows: list[Row], edits: str, start: int = 0) -> Iterator[tuple[str, str]]:
    """Role and text of the repaired rows."""
    move, node, waiting = parser(), start, iter(rows)
    for edit in edits:
        if edit == "I":
            role, text = move.given_role(node), ""
        else:
            row = next(waiting)
            if edit == "D":
                continue
            role, text = (row.role if edit == "K" else move.given_role(node)), row.text
        yield role, text
        node = move.shift(node, role[:1])[0]


def repaired_lines(rows: list[Row], edits: str, start: int = 0) -> Iterator[bytes]:
    return (f"{role}:{text}".encode() for role, text in replayed(rows, edits, start))


# Statistics of a stretch of rows, and of two stretches in a row


def statistics(rows: list[Row]) -> dict:
    turns = [r.turn for r in rows if r.turn is not None]
    initials = [r.role[:1] for r in rows]
    return {
        **{fault: sum(r.fault == fault for r in rows) for fault in FAULTS},
        "illegal": sum(a + b not in NEXT_TO for a, b in zip(initials, initials[1:])),
        "ends": [initials[0], initials[-1]] if initials else None,
        "turns": [turns[0], turns[-1], len(set(turns))] if turns else None,
    }


def joined(one: dict, two: dict) -> dict:
    out = {fault: one[fault] + two[fault] for fault in FAULTS}
    between = one["ends"] and two["ends"] and one["ends"][1] + two["ends"][0] not in NEXT_TO
    out["illegal"] = one["illegal"] + two["illegal"] + bool(between)
    out["ends"] = [one["ends"][0], two["ends"][1]] if one["ends"] and two["ends"] else one["ends"] or two["ends"]
    a, b = one["turns"], two["turns"]
    out["turns"] = [a[0], b[1], a[2] + b[2] - (a[1] == b[0])] if a and b else a or b
    return out


def _counts(stats: dict) -> list[int]:
    turns = stats["turns"]
    gaps = turns[1] - turns[0] + 1 - turns[2] if turns else 0
    return [gaps, *(stats[fault] for fault in FAULTS), stats["illegal"]]


# Spark


def damaged(df: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    """The contract's damage: ``_key, _turn, _role, _text, _times`` (0 for a dropped row, 2 for a repeated one), ``_row``.

    Nulls are one space, but a null turn stays null in the order of rows.
    """
    def space(name):
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    code = F.crc32(F.concat(space(key), F.lit(":"), space(turn)).cast("binary")) % 20
    text_ = F.when(code <= 1, F.lit("")).when(code == 2, F.regexp_replace(space(text), "[.!?]", "")).otherwise(space(text))
    return df.select(
        F.col(key).alias("_key"), F.col(turn).cast("long").alias("_turn"),
        F.when(code == 4, F.lit("user")).otherwise(space(role)).alias("_role"), text_.alias("_text"),
        F.when(code == 0, 0).when(code == 3, 2).otherwise(1).alias("_times"),
        F.monotonically_increasing_id().alias("_row"))


def undamaged(df: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    """The rows as they are, in the columns of :func:`damaged`."""
    return df.select(
        F.col(key).alias("_key"), F.col(turn).cast("long").alias("_turn"), F.coalesce(F.col(role), F.lit(" ")).alias("_role"),
        F.coalesce(F.col(text), F.lit(" ")).alias("_text"), F.lit(1).alias("_times"), F.monotonically_increasing_id().alias("_row"))


def with_faults(rows: DataFrame) -> DataFrame:
    """Add ``_blank, _ended`` and ``_again``: an earlier row of the conversation has the same role and text.

    First places of repeated rows are found by an aggregate over digests that is combined before
    it is shuffled, and joined back; only digests met twice are.
    """
    own = F.sha2(F.concat_ws(":", "_role", "_text"), 256)
    marked = rows.withColumn("_digest", F.when(F.col("_times") > 0, own))
    place = F.struct(F.col("_turn").isNotNull().alias("known"), "_turn", "_row")
    firsts = (marked.where("_times > 0").groupBy(F.col("_key").alias("_of"), F.col("_digest").alias("_same"))
              .agg(F.count("*").alias("_count"), F.min(place).alias("_first")).where("_count > 1").drop("_count"))
    firsts = stage(firsts, "repair-repeats")  # written, so that its size is known before texts are shuffled for the join
    met = marked.join(firsts, F.col("_key").eqNullSafe(F.col("_of")) & (F.col("_digest") == F.col("_same")), "left")
    return met.select(
        "_key", "_turn", "_role", "_text", "_times", "_row", (~F.col("_text").rlike(CHARACTER)).alias("_blank"),
        F.col("_text").rlike(ENDED).alias("_ended"), F.coalesce(F.col("_first._row") != F.col("_row"), F.lit(False)).alias("_again"))


COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def _stretches(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """``key, rows, whole`` of each stretch of rows with one key, cut after so many rows or characters.

    ``whole`` tells that the stretch is all of its conversation: it is neither cut nor the first or last of
    the partition, whose conversation may go on in a neighbour.
    """
    key, rows, held, cut, first = None, None, 0, False, True
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(c)).to_pylist()
                   for c in ("_key", "_turn", "_role", "_text", "_times", "_blank", "_ended", "_again")]
        for own, turn, role, text, times, blank, end, again in zip(*columns):
            if rows is None or own != key:
                if rows is not None:
                    yield key, rows, not cut and not first
                    first = False
                key, rows, held, cut = own, [], 0, False
            elif len(rows) >= BLOCK_ROWS or held >= BLOCK_CHARACTERS:
                yield key, rows, False
                rows, held, cut = [], 0, True
            for copy in range(times):
                fault = "blank" if blank else "duplicate" if again or copy else "" if end else "truncated"
                rows.append(Row(role, text, fault, turn))
                held += len(text)
    if rows is not None:
        yield key, rows, False


def _repair_stretches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole conversations are answered; of others each stretch gives its rows and its ways from every stack."""
    part, starts, out, schema, size = TaskContext.get().partitionId(), parser().stacks(), [], None, 0

    def emitted():
        columns = list(zip(*out))
        kinds = [schema, *([pa.int64()] * 8), pa.string(), pa.string(), pa.string(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=[
            "_key", "_part", "_block", "gaps", *FAULTS, "illegal", "cost", "audit", "repaired_sha256", "_stats", "_ways", "_rows"])

    def typed():
        nonlocal schema
        for batch in batches:
            schema = batch.schema.field("_key").type
            yield batch

    for number, (key, rows, whole) in enumerate(_stretches(typed())):
        stats = statistics(rows)
        if whole:
            cost, edits, _ = ended(cheapest(rows))
            digest = hashlib.sha256(b"\n".join(repaired_lines(rows, edits))).hexdigest()
            out.append((key, part, number, *_counts(stats), cost, edits, digest, None, None, None))
        else:
            ways = [[start, cheapest(rows, start)] for start in starts]
            plain = [[s, [[n, *v] for n, v in sorted(w.items())]] for s, w in ways]
            out.append((key, part, number, *([None] * 8), json.dumps(stats), json.dumps(plain), json.dumps(rows)))
            size += sum(len(r.text) for r in rows)
        if len(out) >= 1000 or size >= BLOCK_CHARACTERS:
            yield emitted()
            out, size = [], 0
    if out:
        yield emitted()


def _decide(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From the ways of all stretches of a conversation, in order, the stretch's start and edits on the best way.

    Ways that no best way to any stack uses are dropped stretch by stretch; as soon as all that are left agree on a stretch, it is given out.
    """
    schema = arrow_schema("_part long, _block long, _start long, _edits string, _cost long")
    out: list[tuple] = []

    def settle(chain, node):
        """The stretches up to the end, on the best way to ``node``."""
        back = []
        for part, block, ways in reversed(chain):
            start, cost, edits = ways[node]
            back.append((part, block, start, edits, cost))
            node = start
        return back[::-1]

    def flush(chain, frontier):
        last, edits, node = ended({n: (cost, edits) for n, (cost, edits) in frontier.items()})
        found = settle(chain, node)
        tail = edits[len(frontier[node][1]):]
        part, block, start, own, cost = found[-1]
        return [*found[:-1], (part, block, start, own + tail, cost + last - frontier[node][0])]

    key, chain, frontier = None, None, None
    for batch in batches:
        for own, part, block, ways in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if chain is None or own != key:
                if chain is not None:
                    out += flush(chain, frontier)
                key, chain, frontier = own, [], {0: (0, "")}
            new, via = {}, {}
            for start, ends in json.loads(ways):
                if start in frontier:
                    cost, edits = frontier[start]
                    for node, more, added in ends:
                        if _offer(new, node, (cost + more, edits + added)):
                            via[node] = (start, more, added)
            chain.append((part, block, via))
            # Walk back from all stacks: where their ways have met, earlier stretches are decided.
            alive, at = {start for start, _, _ in via.values()}, len(chain) - 1
            while at and len(alive) > 1:
                at -= 1
                alive = {chain[at][2][n][0] for n in alive}
            if at and len(alive) == 1:
                node = next(iter(alive))
                out += settle(chain[:at], node)
                chain = chain[at:]
                # All ways begin with what was settled; costs and edits are compared from there on.
                same = len(_common(new))
                new = {n: (cost, edits[same:]) for n, (cost, edits) in new.items()}
            frontier = new
        if len(out) >= 1000:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out = []
    if chain is not None:
        out += flush(chain, frontier)
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def _common(frontier: Frontier) -> str:
    every = [edits for _, edits in frontier.values()]
    low, high = min(every), max(every)
    return low[:next((j for j, (a, b) in enumerate(zip(low, high)) if a != b), min(len(low), len(high)))]


def _assemble(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations from their decided stretches, in order: one stretch's rows are held at a time."""
    kind, out = None, []

    def result():
        gathered = list(zip(*out))
        kinds = [kind, *([pa.int64()] * 6), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(gathered, kinds)],
                                          names=["_key", "gaps", *FAULTS, "illegal", "cost", "audit", "repaired_sha256"])

    key = stats = None
    for batch in batches:
        kind = batch.schema.field("_key").type
        for own, text_stats, text_rows, start, edits, cost in zip(*(batch.column(i).to_pylist() for i in range(6))):
            if stats is None or own != key:
                if stats is not None:
                    out.append((key, *_counts(stats), total, "".join(audit), digest.hexdigest()))
                key, stats, total, audit, digest, empty = own, None, 0, [], hashlib.sha256(), True
            here = json.loads(text_stats)
            stats = joined(stats, here) if stats else here
            total += cost
            audit.append(edits)
            for line in repaired_lines([Row(*r) for r in json.loads(text_rows)], edits, start):
                digest.update(line if empty else b"\n" + line)
                empty = False
        if len(out) >= 1000:
            yield result()
            out = []
    if stats is not None:
        out.append((key, *_counts(stats), total, "".join(audit), digest.hexdigest()))
    if out:
        yield result()


def repair(rows: DataFrame, kind: str, key: str) -> DataFrame:
    """Repair conversations given in the columns of :func:`damaged`.

    Rows are dealt by ranges of (key, turn), so a conversation of any size is spread over tasks.  What lies whole
    within a range is answered there.  Of others each stretch of rows gives its cheapest way from every stack to every stack;
    these are put together in order, and then the stretches' texts are hashed in order, one at a time: a
    digest of a whole conversation has no other way.
    """
    spark = rows.sparkSession
    order = [F.col("_key").asc_nulls_first(), F.col("_turn").asc_nulls_first(), F.col("_row").asc()]
    dealt = with_faults(stage(rows, "repair-rows")).repartitionByRange(parallelism(spark), *order).sortWithinPartitions(*order)
    columns = f"_key {kind}, _part long, _block long, {COUNTS}, audit string, repaired_sha256 string, _stats string, _ways string, _rows string"
    stretches = stage(dealt.mapInArrow(_repair_stretches, columns), "repair")
    results = ["_key", "gaps", *FAULTS, "illegal", "cost", "audit", "repaired_sha256"]
    whole = stretches.where("_ways is null").select(*results)
    parts = stretches.where("_ways is not null")
    by_place = [F.col("_key").asc_nulls_first(), "_part", "_block"]
    decided = (parts.select("_key", "_part", "_block", "_ways").repartition(parallelism(spark), "_key").sortWithinPartitions(*by_place)
               .mapInArrow(_decide, "_part long, _block long, _start long, _edits string, _cost long"))
    placed = parts.select("_key", "_part", "_block", "_stats", "_rows").join(decided, ["_part", "_block"])
    streamed = placed.repartition(parallelism(spark), "_key").sortWithinPartitions(*by_place).select(
        "_key", "_stats", "_rows", "_start", "_edits", "_cost")
    assembled = streamed.mapInArrow(_assemble, f"_key {kind}, {COUNTS}, audit string, repaired_sha256 string")
    return whole.union(assembled.select(*results)).withColumnRenamed("_key", key)


def repair_conversations(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                         damage: bool = False) -> DataFrame:
    """One row per conversation: ``key, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.

    With ``damage`` the rows are damaged first, as the query's contract says.  ``audit`` has one letter per edit: Keep, Rerole,
    Delete, Insert.  Null roles and texts are one space (no role, blank); null keys are one conversation; null turns come first.  Rows of one turn
    stand in the order in which the table is read, repeated rows included: all but the first are duplicates.  A conversation
    without rows has zeros, an empty audit and the hash of nothing; an empty table gives an empty result.  Other columns are not read.
    """
    rows = (damaged if damage else undamaged)(df, key, turn, role, text)
    return repair(rows, df.schema[key].dataType.simpleString(), key)
