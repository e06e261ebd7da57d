"""Repair of conversations by the cheapest edits.

A conversation is repaired by a walk through a lattice: its rows on one side,
what has been put out on the other (nothing, a system turn, a user turn, an
assistant turn). Bidirectional Dijkstra finds all cheapest walks: a forward and
a reverse heap meet, go on until no crossing of equal cost is left, and the
least audit among all crossings wins.

A range sort deals the rows out. A conversation that lies inside a sorted slot
is repaired there. One that is cut, since it is long or reaches into the next
slot, is searched block by block for every state before and after it; the few
best ways through each block are then put together from the end.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator, Sequence
from hashlib import sha256
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from quillframe.scratch import written

DELETE, REROLE, INSERT, UNFINISHED = 4, 3, 3, 3
#: What has been put out last. Whole conversations start with nothing and end so, or with an assistant.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (NOTHING, ASSISTANT)
#: The state after the next turn that may be made, and that turn's role.
NEXT = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
LEGAL = frozenset(("su", "ua", "au"))

#: Rows and bytes of a conversation that are held at a time.
BLOCK_ROWS, BLOCK_BYTES = 512, 8 << 20
HASHED_BYTES = 1 << 20

_WHITE = " \t\n\r\x0b\x0c"
_SLOT_BITS = 40

COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


class Fault(NamedTuple):
    """What the lattice has to know of a row."""

    initial: str
    deleted: bool
    unfinished: bool


class Row(NamedTuple):
    turn: int | None
    role: str
    text: str


def kept_state(state: int, initial: str) -> int | None:
    """The state after a row is kept, None where it can't be."""
    if initial == "s":
        return SYSTEM if state == NOTHING else None
    if initial == "u":
        return USER if state != USER else None
    if initial == "a":
        return ASSISTANT if state == USER else None
    return None


def _onward(rows: Sequence[Fault], at: int, state: int) -> Iterator[tuple[int, str, int, int]]:
    """(cost, edit, row, state) of every edge out of a node."""
    yield INSERT, "I", at, NEXT[state]
    if at < len(rows):
        row = rows[at]
        yield DELETE, "D", at + 1, state
        if not row.deleted:
            more = UNFINISHED if row.unfinished else 0
            kept = kept_state(state, row.initial)
            if kept is not None:
                yield more, "K", at + 1, kept
            if kept != NEXT[state]:
                yield more + REROLE, "R", at + 1, NEXT[state]


_INTO = tuple(tuple(s for s in range(4) if NEXT[s] == to) for to in range(4))


def _back(rows: Sequence[Fault], at: int, state: int) -> Iterator[tuple[int, str, int, int]]:
    """(cost, edit, row, state) of every edge into a node."""
    for before in _INTO[state]:
        yield INSERT, "I", at, before
    if at:
        row = rows[at - 1]
        yield DELETE, "D", at - 1, state
        if not row.deleted:
            more = UNFINISHED if row.unfinished else 0
            for before in range(4):
                kept = kept_state(before, row.initial)
                if kept == state:
                    yield more, "K", at - 1, before
                elif NEXT[before] == state:
                    yield more + REROLE, "R", at - 1, before


def cheapest(rows: Sequence[Fault], start: int = NOTHING, ends: Iterable[int] = ENDS) -> tuple[int, str] | None:
    """(cost, least audit) of the cheapest edits that lead from one state to another.

    Edges that cost nothing go one row on, so nodes of equal cost are settled in
    the order of their rows (the reverse side against it), and a node's audit is
    final when it is settled: of two audits of one node at one cost, none begins
    with the other. The sides stop when no unsettled pair can reach the best
    cost any more, so every cheapest walk has a node that both know.
    """
    ahead, behind = {(0, start): (0, "")}, {(len(rows), s): (0, "") for s in ends}
    forward, reverse = [(0, 0, start)], [(0, -len(rows), s) for s in ends]
    heapq.heapify(reverse)
    done_ahead, done_behind = set(), set()
    best = min((0 for node in behind if node in ahead), default=None)
    while forward and reverse and (best is None or forward[0][0] + reverse[0][0] <= best):
        onward = forward[0][0] <= reverse[0][0]
        cost, at, state = heapq.heappop(forward if onward else reverse)
        node = (at if onward else -at), state
        known, others, done = (ahead, behind, done_ahead) if onward else (behind, ahead, done_behind)
        if node in done:  # a stale entry
            continue
        done.add(node)
        audit = known[node][1]
        for more, edit, row, there in (_onward if onward else _back)(rows, *node):
            label = cost + more, audit + edit if onward else edit + audit
            old = known.get((row, there))
            if old is not None and old <= label:
                continue
            known[row, there] = label
            if old is None or label[0] < old[0]:
                heapq.heappush(forward if onward else reverse, (label[0], row if onward else -row, there))
                other = others.get((row, there))
                if other is not None and (best is None or label[0] + other[0] < best):
                    best = label[0] + other[0]
    if best is None:
        return None
    small, large = sorted((ahead, behind), key=len)
    return best, min(ahead[n][1] + behind[n][1] for n in small if n in large and ahead[n][0] + behind[n][0] == best)


class Counts:
    """Faults of consecutive rows; those of the next rows can be put behind them."""

    def __init__(self):
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.first_turn = self.last_turn = None

    def add(self, row: Row, repeated: bool) -> Fault:
        """Counts a row's first fault."""
        end = row.text.rstrip(_WHITE)[-1:]
        initial = row.role[:1]
        fault = Fault(initial, not end or repeated, bool(end) and not repeated and end not in ".!?")
        self.blank += not end
        self.duplicate += bool(end) and repeated
        self.truncated += fault.unfinished
        if self.last is not None:
            self.illegal += self.last + initial not in LEGAL
        self.first, self.last = initial if self.first is None else self.first, initial
        if row.turn is not None:
            self.turns += row.turn != self.last_turn
            self.first_turn, self.last_turn = row.turn if self.first_turn is None else self.first_turn, row.turn
        return fault

    def put_before(self, then: Counts) -> None:
        """Takes in the counts of the rows that follow."""
        for name in ("blank", "duplicate", "truncated", "illegal", "turns"):
            setattr(self, name, getattr(self, name) + getattr(then, name))
        if self.last is None:
            self.first, self.last = then.first, then.last
        elif then.first is not None:
            self.illegal += self.last + then.first not in LEGAL
            self.last = then.last
        if self.last_turn is None:
            self.first_turn, self.last_turn = then.first_turn, then.last_turn
        elif then.first_turn is not None:
            self.turns -= self.last_turn == then.first_turn
            self.last_turn = then.last_turn

    def gaps(self) -> int:
        return 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.turns

    def columns(self, cost: int) -> dict:
        return {"gaps": self.gaps(), "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated,
                "illegal": self.illegal, "cost": cost}


class Replay:
    """Makes the repaired turns of a conversation from its audit, row by row."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, NOTHING

    def _made(self, text: str) -> tuple[str, str, str]:
        self.state = NEXT[self.state]
        return self.audit[self.at], ROLES[self.state], text

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of the turns inserted here."""
        while self.audit[self.at:self.at + 1] == "I":
            yield self._made("")
            self.at += 1

    def row(self, row: Row) -> Iterator[tuple[str, str, str]]:
        """Turns inserted before a row, and the row unless it is deleted."""
        yield from self.inserted()
        edit = self.audit[self.at]
        if edit == "K":
            self.state = kept_state(self.state, row.role[:1])
            yield edit, row.role, row.text
        elif edit == "R":
            yield self._made(row.text)
        self.at += 1


class Digest:
    """SHA-256 of ``role:text`` lines, joined by newlines."""

    def __init__(self):
        self.hash, self.held, self.size, self.empty = sha256(), [], 0, True

    def add(self, role: str, text: str) -> None:
        self.held.append(f"{'' if self.empty else chr(10)}{role}:{text}")
        self.empty, self.size = False, self.size + len(text)
        if self.size >= HASHED_BYTES:
            self._flush()

    def _flush(self) -> None:
        self.hash.update("".join(self.held).encode())
        self.held, self.size = [], 0

    def hex(self) -> str:
        self._flush()
        return self.hash.hexdigest()


def repair_whole(rows: Sequence[Row]) -> tuple[Counts, int, str]:
    """(counts, cost, audit) of a conversation that is all there."""
    counts, seen, faults = Counts(), set(), []
    for row in rows:
        faults.append(counts.add(row, (row.role, row.text) in seen))
        seen.add((row.role, row.text))
    return counts, *cheapest(faults)


# Tables ------------------------------------------------------------------

CUT = "at bigint, block bigint, turn bigint, role string, text string, present boolean"
WAYS = "array<struct<start: int, end: int, cost: bigint, audit: string>>"
PART_COUNTS = ("blank bigint, duplicate bigint, truncated bigint, illegal bigint, turns bigint, "
               "first string, last string, first_turn bigint, last_turn bigint")


def _summary_fields(conv) -> list[StructField]:
    return [StructField("conv", conv), *[StructField(n, LongType()) for n in COUNTS],
            StructField("audit", StringType()), StructField("repaired_sha256", StringType())]


def _turn_fields(conv) -> list[StructField]:
    return [StructField("conv", conv), StructField("place", LongType()), *StructType.fromDDL("edit string, role string, text string").fields]


class _Writer:
    """Collects rows of a table into Arrow batches of bounded size."""

    def __init__(self, schema: StructType):
        from pyspark.sql.pandas.types import to_arrow_schema

        self.schema, self.rows, self.size = to_arrow_schema(schema), [], 0

    def add(self, row: dict, size: int = 0) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.size += size + 100
        if self.size >= BLOCK_BYTES:
            yield self.flush()

    def flush(self) -> pa.RecordBatch:
        batch = pa.RecordBatch.from_pylist(self.rows, schema=self.schema)
        self.rows, self.size = [], 0
        return batch


def _whole_rows(conv, rows: list[Row], want_turns: bool) -> Iterator[tuple[dict, int]]:
    """The result rows of a conversation that is all there, and their sizes."""
    counts, cost, audit = repair_whole(rows)
    replay, digest, place = Replay(audit), Digest(), 0
    made = [turn for row in rows for turn in replay.row(row)] + list(replay.inserted())
    for place, (edit, role, text) in enumerate(made):
        if want_turns:
            yield {"conv": conv, "place": place, "edit": edit, "role": role, "text": text}, len(text)
        else:
            digest.add(role, text)
    if not want_turns:
        yield {"conv": conv, **counts.columns(cost), "audit": audit, "repaired_sha256": digest.hex()}, len(audit)


def _in_slots(rows: DataFrame, want_turns: bool) -> DataFrame:
    """Repairs conversations that a sorted slot holds as a whole; numbers the rows of others.

    Of a slot the first and the last conversation may be cut, and every longer
    one than a block is; their blocks hold rows of one conversation only.
    """
    conv_type = rows.schema["conv"].dataType
    fields = (_turn_fields if want_turns else _summary_fields)(conv_type)
    schema = StructType([*[f for f in fields if f.name not in ("role", "text")], *StructType.fromDDL(CUT).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        out, base = _Writer(schema), TaskContext.get().partitionId() << _SLOT_BITS
        at = block = size = 0
        conv, held, first, cut = None, [], True, False

        def numbered() -> Iterator[pa.RecordBatch]:
            nonlocal at, block, held, size
            for present, row in held:
                yield from out.add({"conv": conv, "at": base + at, "block": base + block, "present": present,
                                    **row._asdict()}, len(row.text))
                at += 1
            held, size, block = [], 0, block + 1

        def ended(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size, first
            if first or last or cut:
                yield from numbered()
            else:
                for row, bytes_ in _whole_rows(conv, [r for present, r in held if present], want_turns):
                    yield from out.add(row, bytes_)
                held, size = [], 0
            first = False

        started = False
        for batch in batches:
            for there, *row, present in zip(*(batch.column(c).to_pylist() for c in ("conv", "turn", "role", "text", "present"))):
                if started and there != conv:
                    yield from ended(last=False)
                    cut = False
                elif len(held) >= BLOCK_ROWS or size >= BLOCK_BYTES:
                    yield from numbered()
                    cut = True
                conv, started = there, True
                held.append((present, Row(*row)))
                size += len(row[2])
        if started:
            yield from ended(last=True)
        yield out.flush()

    keys = ["conv", "turn", "role", "text", "copy"]
    return rows.withColumn("copy", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(
        *keys).mapInArrow(run, schema)


def _ways(rows: DataFrame) -> DataFrame:
    """The cheapest edits of each block of a cut conversation, between any two states."""
    firsts = rows.where("present").groupBy("conv", "role", F.sha2("text", 256)).agg(
        F.min("block").alias("block"), F.min("at").alias("at"))
    schema = StructType([rows.schema["conv"], *StructType.fromDDL(f"block bigint, {PART_COUNTS}, ways {WAYS}").fields])
    names = [f.name for f in StructType.fromDDL(PART_COUNTS)]
    marked = rows.select("block", "at", "conv", "turn", "role", "text", "present", F.lit(False).alias("opens")).unionByName(
        firsts.select("block", "at", F.lit(True).alias("opens")), allowMissingColumns=True)

    def search(table: pa.Table) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema

        listed = table.to_pylist()
        new = {r["at"] for r in listed if r["opens"]}
        own = sorted((r for r in listed if not r["opens"]), key=lambda r: r["at"])
        counts = Counts()
        faults = [counts.add(Row(r["turn"], r["role"], r["text"]), r["at"] not in new) for r in own if r["present"]]
        ways = [{"start": a, "end": b, "cost": found[0], "audit": found[1]}
                for a in range(4) for b in range(4) if (found := cheapest(faults, a, [b]))]
        return pa.Table.from_pylist(
            [{"conv": own[0]["conv"], "block": own[0]["block"], "ways": ways, **{n: getattr(counts, n) for n in names}}],
            schema=to_arrow_schema(schema))

    return marked.groupBy("block").applyInArrow(search, schema)


def _before(a: tuple | None, b: tuple | None) -> bool:
    """Whether one audit, a chain of (text, rest), is less than another."""
    i = j = 0
    while a is not b or i != j:
        if a is None or b is None:
            return a is None
        x, y = a[0][i:], b[0][j:]
        size = min(len(x), len(y))
        if x[:size] != y[:size]:
            return x < y
        i, j = i + size, j + size
        if i == len(a[0]):
            a, i = a[1], 0
        if j == len(b[0]):
            b, j = b[1], 0
    return False


def joined_ways(blocks: Iterable[Sequence[tuple[int, int, int, str]]]) -> tuple[int, str]:
    """(cost, audit) of the best ways (start, end, cost, audit) through blocks, the last block first."""
    best: dict[int, tuple[int, tuple | None]] = {s: (0, None) for s in ENDS}
    for ways in blocks:
        found: dict[int, tuple[int, tuple | None]] = {}
        for start, end, cost, audit in ways:
            if end not in best:
                continue
            rest = best[end]
            chain = (audit, rest[1]) if audit else rest[1]
            old = found.get(start)
            if old is None or cost + rest[0] < old[0] or cost + rest[0] == old[0] and _before(chain, old[1]):
                found[start] = cost + rest[0], chain
        best = found
    cost, chain = best[NOTHING]
    parts = []
    while chain is not None:
        parts.append(chain[0])
        chain = chain[1]
    return cost, "".join(parts)


def _put_together(ways: DataFrame) -> DataFrame:
    """One row for each cut conversation, from its blocks."""
    schema = StructType([f for f in _summary_fields(ways.schema["conv"].dataType) if f.name != "repaired_sha256"])
    names = [f.name for f in StructType.fromDDL(PART_COUNTS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Writer(schema)

        def conversations() -> Iterator[tuple[object, Iterator[dict]]]:
            from itertools import groupby

            return groupby((r for b in batches for r in b.to_pylist()), key=lambda r: r["conv"])

        for conv, blocks in conversations():
            total = Counts()

            def counted() -> Iterator[list[tuple]]:
                nonlocal total
                for block in blocks:
                    here = Counts()
                    for name in names:
                        setattr(here, name, block[name])
                    here.put_before(total)
                    total = here
                    yield [(w["start"], w["end"], w["cost"], w["audit"]) for w in block["ways"]]

            cost, audit = joined_ways(counted())
            yield from out.add({"conv": conv, **total.columns(cost), "audit": audit}, len(audit))
        yield out.flush()

    return ways.repartition("conv").sortWithinPartitions("conv", F.desc("block")).mapInArrow(run, schema)


def _replayed(cut: DataFrame, summaries: DataFrame, want_turns: bool) -> DataFrame:
    """The result rows of cut conversations: rows pass in order behind their audit, and aren't held."""
    conv_type = cut.schema["conv"].dataType
    schema = StructType((_turn_fields if want_turns else _summary_fields)(conv_type))
    both = cut.where("present").select("conv", "at", "turn", "role", "text").unionByName(
        summaries.withColumn("at", F.lit(-1).cast("bigint")), allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, summary, replay, digest, place = _Writer(schema), None, None, None, 0

        def put(turns: Iterator[tuple[str, str, str]]) -> Iterator[pa.RecordBatch]:
            nonlocal place
            for edit, role, text in turns:
                if want_turns:
                    yield from out.add(
                        {"conv": summary["conv"], "place": place, "edit": edit, "role": role, "text": text}, len(text))
                else:
                    digest.add(role, text)
                place += 1

        def ended() -> Iterator[pa.RecordBatch]:
            if summary is not None:
                yield from put(replay.inserted())
                if not want_turns:
                    yield from out.add({**summary, "repaired_sha256": digest.hex()}, len(summary["audit"]))

        for batch in batches:
            for r in batch.to_pylist():
                if r["at"] < 0:
                    yield from ended()
                    summary = {n: r[n] for n in ("conv", *COUNTS, "audit")}
                    replay, digest, place = Replay(r["audit"]), Digest(), 0
                else:
                    yield from put(replay.row(Row(r["turn"], r["role"], r["text"])))
        yield from ended()
        yield out.flush()

    return both.repartition("conv").sortWithinPartitions("conv", "at").mapInArrow(run, schema)


def _repaired(rows: DataFrame, conv_id: str, turn: str, role: str, text: str, present: Column | None, want_turns: bool) -> DataFrame:
    space = F.lit(" ")
    own = rows.select(
        F.col(conv_id).alias("conv"), F.col(turn).cast("bigint").alias("turn"),
        F.coalesce(F.col(role), space).alias("role"), F.coalesce(F.col(text), space).alias("text"),
        F.coalesce(F.lit(True) if present is None else present, F.lit(False)).alias("present"))
    parts = written(_in_slots(own, want_turns), "repair")
    cut = parts.where(F.col("at").isNotNull())
    done = _replayed(cut, _put_together(_ways(cut)), want_turns)
    whole = parts.where(F.col("at").isNull()).select(*done.columns)
    return whole.unionByName(done).withColumnRenamed("conv", conv_id)


def repair_conversations(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                         text: str = "text", present: Column | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation.

    Rows stand by turn, null turns first, those of one turn by role and text. A
    row's first fault counts: blank (no character but white space), duplicate
    (role and text were there before), truncated (doesn't end in ``.``, ``!`` or
    ``?``). ``illegal`` counts neighbours whose initials aren't su, ua or au, and
    ``gaps`` turns missing between the first and the last one. The audit has one
    letter an edit: K keeps a row, R gives it another role, D deletes it, I
    inserts an empty turn; what is left is ``(s?(ua)+)?`` by initials. The edits
    are the cheapest ones, the least audit of these.

    Null roles and texts are one space, so such a text is blank. A null id is a
    conversation of its own. Rows that aren't ``present`` have been lost: they
    only say that there was such a conversation; one without present rows has
    zeros, an empty audit and the digest of nothing. Repeated rows are
    duplicates. Other columns don't count, whatever their names; without rows
    there are no rows. A conversation's audit is one value, so it must fit one;
    its rows needn't: they are never held together.
    """
    return _repaired(rows, conv_id, turn, role, text, present, want_turns=False)


def repaired_turns(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                   text: str = "text", present: Column | None = None) -> DataFrame:
    """(conv_id, place, edit, role, text): the turns that the edits of ``repair_conversations`` leave, in order."""
    return _repaired(rows, conv_id, turn, role, text, present, want_turns=True)
