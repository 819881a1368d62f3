"""Conversation structure repair: the cheapest edits that make the roles of a conversation read system?, (user, assistant)*.

Lazy weighted determinisation. The edits of a turn (keep, change the role, delete, insert before) form a weighted automaton over what
the conversation ends with so far: nothing, system, user or assistant. The costs of these four, less the least of them, are one state
of a deterministic automaton; states and transitions are made when they are first met and kept in a table, so that a turn costs one
look-up. States that cannot be part of a cheapest repair leave the vector, so that the automaton is finite. From the end back, arcs
that lie on a cheapest path (tight arcs) are marked, again by look-up, and the first letters along them give the audit.

Turns are first reduced to (conversation, turn, role, digest of the text) with their number; digests find earlier turns of the same
role and text. These are dealt by conversation, sorted and scanned: a task holds a few bytes a turn of one conversation, no texts.
A second pass deals audits and texts by conversation and streams them into the repaired turns or their hash.

Edges: turns of one number are in the order of role and SHA-256 of the text, null numbers come first. A null role or text counts as one
space, and rows of a null conversation are one conversation. Equal rows are all taken. A role is what its first character says; an
empty role has none. A conversation of only blank turns is repaired to none. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: Costs of the edits, and of a kept turn that breaks off.
REROLE, DELETE, INSERT, BROKEN = 1, 2, 5, 5
#: What a repaired conversation ends with.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
_NEVER = 1 << 30
#: Where an inserted turn, or one of changed role, leads.
_ANEW = (USER, USER, ASSISTANT, USER)
#: Where a kept turn leads, by the initial of its role.
_KEPT = {"s": {NOTHING: SYSTEM}, "u": {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
_INITIALS = "sua"
#: Symbols: 0 is a turn that must go; else 1 + the initial's place (3: another role), and 4 more for a turn that breaks off.
GONE = 0
_LEGAL = {"su", "ua", "au"}
_HELD = 10_000


class Repairs:
    """The determinised automaton, as far as conversations have needed it."""

    def __init__(self):
        self.vectors: list[tuple[int, ...]] = []
        self.numbers: dict[tuple[int, ...], int] = {}
        self.next: dict[int, tuple[int, int]] = {}  # state * 16 + symbol -> state, cost
        self.traced: dict[tuple[int, int, int], tuple[int, dict[int, tuple[str, int]]]] = {}
        self.start = self._state([0, _NEVER, _NEVER, _NEVER])[0]

    def _state(self, costs: list[int]) -> tuple[int, int]:
        """The number of the vector of these costs, with insertions, and the cost taken off it."""
        costs[USER] = min(costs[USER], min(costs[NOTHING], costs[SYSTEM], costs[ASSISTANT]) + INSERT)
        costs[ASSISTANT] = min(costs[ASSISTANT], costs[USER] + INSERT)
        # what follows `nothing` may follow `assistant` if a system turn goes; what follows `system` may follow it as it is
        if costs[NOTHING] > costs[ASSISTANT] + DELETE:
            costs[NOTHING] = _NEVER
        if costs[SYSTEM] > costs[ASSISTANT]:
            costs[SYSTEM] = _NEVER
        least = min(costs)
        vector = tuple(c - least if c < _NEVER else _NEVER for c in costs)
        if vector not in self.numbers:
            self.numbers[vector] = len(self.vectors)
            self.vectors.append(vector)
        return self.numbers[vector], least

    @staticmethod
    def arcs(end: int, symbol: int) -> Iterator[tuple[str, int, int]]:
        """(letter, cost, end) of the edits that take a turn, letters ascending."""
        yield "D", DELETE, end
        if symbol != GONE:
            kind, more = (symbol - 1) % 4, BROKEN * (symbol > 4)
            to = _KEPT[_INITIALS[kind]].get(end) if kind < 3 else None
            if to is not None:
                yield "K", more, to
            yield "R", REROLE + more, _ANEW[end]

    def step(self, state: int, symbol: int) -> tuple[int, int]:
        """(state, cost) after a turn."""
        key = state * 16 + symbol
        if key not in self.next:
            costs = [_NEVER] * 4
            for end, cost in enumerate(self.vectors[state]):
                if cost < _NEVER:
                    for _, more, to in self.arcs(end, symbol):
                        costs[to] = min(costs[to], cost + more)
            self.next[key] = self._state(costs)
        return self.next[key]

    def _with_inserts(self, vector: tuple[int, ...], tight: set[int]) -> set[int]:
        """`tight` and the ends from which an insertion on a cheapest path leads to it."""
        for _ in range(2):
            tight |= {e for e in range(4) if vector[e] < _NEVER and _ANEW[e] in tight and vector[e] + INSERT == vector[_ANEW[e]]}
        return tight

    def last(self, state: int) -> tuple[int, set[int], dict[int, tuple[str, int]]]:
        """(cost left, tight ends, the insertions that each of them still needs) after the last turn."""
        vector = self.vectors[state]
        least = min(vector[NOTHING], vector[ASSISTANT])
        done = {e for e in (NOTHING, ASSISTANT) if vector[e] == least}
        tight = self._with_inserts(vector, set(done))
        moves = {}
        for e in tight:
            letters, at = "", e
            while at not in done:
                letters, at = letters + "I", _ANEW[at]
            moves[e] = letters, at
        return least, tight, moves

    def trace(self, state: int, symbol: int, after: int) -> tuple[int, dict[int, tuple[str, int]]]:
        """(ends that are tight before a turn, and for each the least letters up to the turn's own and where they lead), as sets of
        bits, given those after it."""
        key = state, symbol, after
        if key not in self.traced:
            vector, (then, off) = self.vectors[state], self.step(state, symbol)
            onward = self.vectors[then]
            direct = {}
            for e in range(4):
                if vector[e] < _NEVER:
                    own = [(letter, to) for letter, cost, to in self.arcs(e, symbol) if after >> to & 1 and vector[e] + cost == onward[to] + off]
                    if own:
                        direct[e] = own[0]
            tight, moves = self._with_inserts(vector, set(direct)), {}
            for e in tight:
                letters, at = "", e
                # D comes before I, I before K and R
                while at not in direct or direct[at][0] > "I" and _ANEW[at] in tight and vector[at] + INSERT == vector[_ANEW[at]]:
                    letters, at = letters + "I", _ANEW[at]
                moves[e] = letters + direct[at][0], direct[at][1]
            self.traced[key] = sum(1 << e for e in tight), moves
        return self.traced[key]

    def repair(self, symbols: bytes | array, copies: dict[int, int]) -> tuple[int, str]:
        """(cost, audit) of a conversation; copies: how many further turns, all to go, stand behind the turn at a place."""
        state, cost, states = self.start, 0, array("H")
        for symbol in symbols:
            states.append(state)
            state, more = self.step(state, symbol)
            cost += more
        left, tight, moves = self.last(state)
        mask = sum(1 << e for e in tight)
        masks = bytearray(len(symbols))
        for i in range(len(symbols) - 1, -1, -1):
            masks[i] = mask
            mask, _ = self.trace(states[i], symbols[i], mask)
        letters, end = [], NOTHING
        for i, symbol in enumerate(symbols):
            own, end = self.trace(states[i], symbol, masks[i])[1][end]
            letters.append(own + "D" * copies[i] if i in copies else own)
        letters.append(moves[end][0])
        return cost + left + DELETE * sum(copies.values()), "".join(letters)


def _filled(df: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(" "))
    return df.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role"), F.lit(" ")).alias("role"), text.alias("text"), F.sha2(text, 256).alias("digest"))


def turns(df: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, copies, blank, broken, later): rows equal in turn, role and text as one, with their faults."""
    rows = _filled(df).withColumns({"blank": ~F.col("text").rlike(r"[^\x20\x09-\x0D]"), "broken": ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")})
    rows = rows.groupBy("conv_id", "turn", "role", "digest").agg(F.count(F.lit(1)).alias("copies"), F.max("blank").alias("blank"), F.max("broken").alias("broken"))
    firsts = rows.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(F.min(F.struct("turn")).alias("f"))
    joined = rows.join(firsts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")))
    return joined.select(*rows.columns, (~F.col("turn").eqNullSafe(F.col("f.turn"))).alias("later"))


class _Conversation:
    """Counts and symbols of one conversation, taken turn by turn."""

    def __init__(self, conv_id):
        self.conv_id, self.symbols, self.copies, self.faults, self.illegal = conv_id, array("B"), {}, [0, 0, 0], 0
        self.first = self.last = self.initial = None
        self.distinct = 0

    def take(self, turn: int | None, initial: str, copies: int, blank: bool, broken: bool, later: bool) -> None:
        if turn is not None and turn != self.last:
            self.first, self.last, self.distinct = turn if self.first is None else self.first, turn, self.distinct + 1
        self.illegal += (self.initial is not None and f"{self.initial}{initial}" not in _LEGAL) + (copies - 1)
        self.initial = initial
        gone = blank or later
        self.faults[0] += copies * blank
        self.faults[1] += 0 if blank else copies - (not later)
        self.faults[2] += not gone and broken
        if copies > 1:
            self.copies[len(self.symbols)] = copies - 1
        self.symbols.append(GONE if gone else 1 + (_INITIALS.find(initial) if initial in ("s", "u", "a") else 3) + 4 * broken)

    def row(self, repairs: Repairs) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.distinct
        return (self.conv_id, gaps, *self.faults, self.illegal, *repairs.repair(self.symbols, self.copies))


AUDITED = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]


def _fields(df: DataFrame, *more: tuple[str, object]) -> StructType:
    return StructType([StructField("conv_id", df.schema["conv_id"].dataType), *[StructField(n, t) for n, t in more]])


def _audited(df: DataFrame) -> StructType:
    return _fields(df, *[(n, StringType() if n == "audit" else LongType()) for n in AUDITED])


def _as_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def _in_batches(rows: Iterator[tuple], schema: pa.Schema, size) -> Iterator[pa.RecordBatch]:
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += size(row)
        if len(held) >= _HELD or weight >= 8_000_000:
            yield _as_batch(held, schema)
            held, weight = [], 0
    if held:
        yield _as_batch(held, schema)


def audits(df: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of every conversation that has rows."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = _audited(df)
    arrow = to_arrow_schema(schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            repairs, now = Repairs(), None
            for batch in batches:
                for conv_id, *turn in zip(*[c.to_pylist() for c in batch.columns]):
                    if now is None or conv_id != now.conv_id:
                        if now is not None:
                            yield now.row(repairs)
                        now = _Conversation(conv_id)
                    now.take(*turn)
            if now is not None:
                yield now.row(repairs)

        yield from _in_batches(found(), arrow, lambda row: len(row[-1]))

    rows = turns(df).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "digest")
    return rows.select("conv_id", "turn", F.substring("role", 1, 1), "copies", "blank", "broken", "later").mapInArrow(scan, schema)


def _with_texts(df: DataFrame) -> DataFrame:
    """Each conversation's audit, and behind it its rows in the order that the audit has them in."""
    held = F.struct(*AUDITED)
    rows = _filled(df).select("conv_id", "turn", "role", "digest", "text", F.lit(None).cast(_audited(df)[1:]).alias("held"))
    heads = audits(df).select("conv_id", *[F.lit(None).cast(t).alias(n) for n, t in (("turn", "long"), ("role", "string"), ("digest", "string"), ("text", "string"))], held.alias("held"))
    both = heads.union(rows).repartition("conv_id").sortWithinPartitions("conv_id", F.col("held").isNull(), "turn", "role", "digest")
    return both.select("conv_id", "turn", "role", "text", "held")


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conversation, audit, None) for each conversation, and (conversation, audit, (turn, role, text, letter)) for each of its repaired turns."""
    head, place, end = None, 0, NOTHING
    conv_id = None

    def insert() -> tuple:
        nonlocal end, place
        end, place = _ANEW[end], place + 1
        return None, "assistant" if end == ASSISTANT else "user", "", "I"

    def rest() -> Iterator[tuple]:
        while head is not None and place < len(head["audit"]):
            yield conv_id, head, insert()

    for batch in batches:
        for own, turn, role, text, held in zip(*[c.to_pylist() for c in batch.columns]):
            if held is not None:
                yield from rest()
                conv_id, head, place, end = own, held, 0, NOTHING
                yield conv_id, head, None
                continue
            while head["audit"][place] == "I":
                yield conv_id, head, insert()
            letter, place = head["audit"][place], place + 1
            if letter == "K":
                end = _KEPT[role[0]][end]
                yield conv_id, head, (turn, role, text, letter)
            elif letter == "R":
                end = _ANEW[end]
                yield conv_id, head, (turn, "assistant" if end == ASSISTANT else "user", text, letter)
    yield from rest()


def repaired(df: DataFrame) -> DataFrame:
    """(conv_id, place, turn, role, text, edit): the turns of every repaired conversation, numbered from 1; an inserted turn has none."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = _fields(df, ("place", LongType()), ("turn", LongType()), ("role", StringType()), ("text", StringType()), ("edit", StringType()))
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            place = 0
            for conv_id, _, turn in _walk(batches):
                place = place + 1 if turn else 0
                if turn:
                    yield conv_id, place, *turn

        yield from _in_batches(found(), arrow, lambda row: len(row[-2]))

    return _with_texts(df).mapInArrow(run, schema)


def digests(df: DataFrame) -> DataFrame:
    """audits() with `repaired_sha256`, the hash of the repaired conversation as lines `role:text`."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = StructType([*_audited(df), StructField("repaired_sha256", StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            now, hashed, lines = None, hashlib.sha256(), 0
            for conv_id, head, turn in _walk(batches):
                if turn is None:
                    if now is not None:
                        yield *now, hashed.hexdigest()
                    now, hashed, lines = (conv_id, *[head[n] for n in AUDITED]), hashlib.sha256(), 0
                else:
                    hashed.update(f"{chr(10) * (lines > 0)}{turn[1]}:{turn[2]}".encode())
                    lines += 1
            if now is not None:
                yield *now, hashed.hexdigest()

        yield from _in_batches(found(), arrow, lambda row: len(row[-2]))

    return _with_texts(df).mapInArrow(run, schema)


def damaged(df: DataFrame) -> DataFrame:
    """Rows with planted faults, by a hash of conversation and turn: one in twenty each goes, loses its text, loses its full stops,
    stands twice, or becomes the user's."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(named("conv_id"), F.lit(":"), named("turn"))) % 20
    df = df.select("conv_id", "turn", named("role").alias("role"), named("text").alias("text"), fault.alias("fault")).filter("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    df = df.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("fault") == 3, 2).otherwise(1))).alias("_copy"))
    return df.drop("_copy")


def audit_all(original: DataFrame, df: DataFrame) -> DataFrame:
    """digests() of `df` for every conversation of `original`, also those that have no rows in `df`."""
    found = digests(df).withColumnRenamed("conv_id", "_found")
    joined = original.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("_found")), "left")
    none = {n: F.lit("" if n == "audit" else 0) for n in AUDITED} | {"repaired_sha256": F.lit(hashlib.sha256().hexdigest())}
    return joined.select("conv_id", *[F.coalesce(F.col(n), v).alias(n) for n, v in none.items()])
