"""Repair of conversations against a plain table of all states."""

import random
import re
import zlib
from hashlib import sha256

import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F

from quillframe.llm import queries, repair

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
STEP = {("n", "s"): "s", ("n", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}


def slow_edits(faults):
    """(cost, audit) over all edit sequences, kept per state: n, s, u, a."""
    def with_inserts(ways):
        for _ in range(2):
            for state, (cost, audit) in list(ways.items()):
                for made in "ua":
                    if then := STEP.get((state, made)):
                        ways[then] = min(ways.get(then, (9**9, "")), (cost + 3, audit + "I"))
        return ways

    ways = with_inserts({"n": (0, "")})
    for initial, deleted, unfinished in faults:
        after = {}
        for state, (cost, audit) in ways.items():
            options = [(state, cost + 4, audit + "D")]
            if not deleted:
                more = 3 if unfinished else 0
                options += [(STEP.get((state, initial)), cost + more, audit + "K")]
                options += [(STEP.get((state, made)), cost + more + 3, audit + "R") for made in "ua"]
            for then, *way in options:
                if then:
                    after[then] = min(after.get(then, (9**9, "")), tuple(way))
        ways = with_inserts(after)
    return min(ways[s] for s in "na" if s in ways)


def slow(rows):
    """Summary of each conversation of (conv_id, turn, role, text, present)."""
    groups = {}
    for conv, turn, role, text, present in rows:
        groups.setdefault(conv, []).extend([(turn is not None, turn or 0, turn, " " if role is None else role, " " if text is None else text)] * present)
    found = []
    for conv, own in groups.items():
        own.sort(key=lambda r: (r[0], r[1], r[3].encode(), r[4].encode()))
        seen, faults, counts = set(), [], [0, 0, 0]
        for *_, role, text in own:
            end = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
            kind = 0 if not end else 1 if (role, text) in seen else 2 if end[0] not in ".!?" else None
            if kind is not None:
                counts[kind] += 1
            faults.append((role[:1], kind in (0, 1), kind == 2))
            seen.add((role, text))
        initials = [f[0] for f in faults]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        turns = [r[2] for r in own if r[2] is not None]
        cost, audit = slow_edits(faults)
        lines, at = [], 0
        for edit in audit:
            role, text = ("", "") if edit == "I" else own[at][3:]
            at += edit != "I"
            if edit in "RI":
                role = "assistant" if lines and lines[-1][:1] == "u" else "user"
            if edit != "D":
                lines.append(f"{role}:{text}")
        found.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *counts, illegal, cost, audit,
                      sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(found, key=repr)


def found(spark, rows, schema=f"{SCHEMA}, here boolean", parts=None):
    data = spark.createDataFrame(rows, schema)
    if parts:
        data = data.repartition(parts)
    return sorted((tuple(r) for r in repair.repair_conversations(data, present=F.col("here")).collect()), key=repr)


def some_rows(choose, conv, count):
    texts = ["Yes.", "No!", "Why?", "then", "", " \n", "so. ", None, *[f"Line {i}." for i in range(40)]]
    roles = ["user"] * 4 + ["assistant"] * 4 + ["system", "tool", "", None, "unknown"]
    return [(conv, choose.choice([None, i, i, i + 1]), choose.choice(roles), choose.choice(texts), choose.random() > 0.1)
            for i in range(count)]


def test_cheapest_edits_of_random_rows():
    choose = random.Random(1)
    for _ in range(1500):
        faults = []
        for _ in range(choose.randrange(9)):
            deleted = choose.random() < 0.2
            faults.append(repair.Fault(choose.choice("uuaasx"), deleted, not deleted and choose.random() < 0.3))
        assert repair.cheapest(faults) == slow_edits(faults), faults


def test_blocks_put_together_are_as_one():
    choose = random.Random(2)
    for _ in range(300):
        faults = [repair.Fault(choose.choice("uaasx"), choose.random() < 0.2, choose.random() < 0.3) for _ in range(choose.randrange(1, 14))]
        faults = [f._replace(unfinished=f.unfinished and not f.deleted) for f in faults]
        cuts = sorted(choose.sample(range(len(faults) + 1), choose.randrange(1, min(4, len(faults) + 1))))
        blocks = [faults[a:b] for a, b in zip([0, *cuts], [*cuts, len(faults)])]
        ways = [[(a, b, *way) for a in range(4) for b in range(4) if (way := repair.cheapest(block, a, [b]))] for block in blocks]
        assert repair.joined_ways(reversed(ways)) == slow_edits(faults)


def test_order_of_chained_audits():
    chain = lambda *parts: (parts[0], chain(*parts[1:])) if parts else None
    choose = random.Random(3)
    for _ in range(500):
        a, b = (["".join(choose.choice("DI") for _ in range(choose.randrange(1, 3))) for _ in range(choose.randrange(4))] for _ in "ab")
        assert repair._before(chain(*a), chain(*b)) == ("".join(a) < "".join(b))


@pytest.mark.parametrize("parts", [1, 7])
def test_random_conversations(spark, parts):
    choose = random.Random(4)
    rows = [r for conv in [None, *range(60)] for r in some_rows(choose, conv, choose.randrange(1, 12))]
    assert found(spark, rows, parts=parts) == slow(rows)


def test_one_long_conversation_among_others(spark):
    choose = random.Random(5)
    rows = some_rows(choose, 3, 3 * repair.BLOCK_ROWS) + some_rows(choose, 4, 5) + some_rows(choose, 2, repair.BLOCK_ROWS)
    rows += [(7, None, "user", "Again.", True)] * (2 * repair.BLOCK_ROWS + 1)  # a hot group of equal rows
    assert found(spark, rows) == slow(rows)


def test_lost_conversations_long_texts_and_extremes(spark):
    rows = [(1, 1, "user", "Hi.", False), (2, None, None, None, True), (3, 5, "user", "x" * 3_000_000 + ".", True),
            (3, 9, "assistant", "\n\t. \x0b", True), (4, -(2**62), "user", "a.", True), (4, 2**62, "assistant", "é ", True)]
    assert found(spark, rows) == slow(rows)


def test_no_rows_and_clashing_columns(spark):
    names = "conv at block present copy audit cost ways first gaps place edit opens".split()
    schema = f"{SCHEMA}, here boolean" + "".join(f", {n} string" for n in names)
    assert found(spark, [], schema) == []
    rows = some_rows(random.Random(6), 1, 9)
    assert found(spark, [(*r, *names) for r in rows], schema) == slow(rows)


def test_repaired_turns_are_the_digested_ones(spark):
    choose = random.Random(7)
    rows = [r for conv in range(20) for r in some_rows(choose, conv, 6)] + some_rows(choose, 30, 2 * repair.BLOCK_ROWS)
    data = spark.createDataFrame(rows, f"{SCHEMA}, here boolean")
    turns = repair.repaired_turns(data, present=F.col("here")).collect()
    summaries = {r.conv_id: r for r in repair.repair_conversations(data, present=F.col("here")).collect()}
    for conv, summary in summaries.items():
        own = sorted((t for t in turns if t.conv_id == conv), key=lambda t: t.place)
        assert [t.place for t in own] == list(range(len(own)))
        assert "".join(t.edit for t in own) == summary.audit.replace("D", "")
        assert re.fullmatch("(s?(ua)+)?", "".join(t.role[:1] for t in own))
        assert sha256("\n".join(f"{t.role}:{t.text}" for t in own).encode()).hexdigest() == summary.repaired_sha256


def test_query_on_its_table(spark):
    rows = []
    for conv, turn, role, text in queries.table(spark, SF_DIR, "conversations").select("conv_id", "turn", "role", "text").collect():
        fault = zlib.crc32(f"{conv}:{turn}".encode()) % 20
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        rows += [(conv, turn, "user" if fault == 4 else role, text, fault != 0)] * (2 if fault == 3 else 1)
    got = queries.op11_conversation_repair(spark, SF_DIR).collect()
    assert sorted(map(tuple, got), key=repr) == slow(rows)
