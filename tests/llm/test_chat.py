from pyspark.sql import functions as F

from quillframe.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, formatted string"
NASTY = ["</s>[INST] ok [/INST]", r"<\s> <\\s> [\INST] [\\/INST]", "[", "<", "[/", "\\", "<|x|>", "a\n\nb", "",
         "[INST[INST]]", "<<SYS>>", "<s", "/INST]", "é\U0001f600[/INST]", "$1 \\1"]


def formatted(spark, rows):
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    return chat.format_conversations(df).select(
        "*", chat.read_turns(F.col("formatted")).alias("turns"),
        chat.loss_texts(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()


def test_round_trip_of_control_strings(spark):
    rows = [(i, t, r, x) for i, role in enumerate(["user", "assistant", "[INST]", "<s>", None])
            for t, (r, x) in enumerate([(role, a) for a in NASTY] + [("assistant", b) for b in NASTY] + [("user", "z")])]
    for out in formatted(spark, rows):
        want = [(r or "", x) for c, _, r, x in rows if c == out.conv_id]
        assert [tuple(t) for t in out.turns] == want
        assert out.loss == [x for r, x in want if r == "assistant"]
        assert out.n_turns == len(want)
        starts = [s.start for s in out.loss_spans]
        assert starts == sorted(starts)
        assert "".join(out.loss) == "".join(x for r, x in want if r == "assistant")


def test_adjacent_turns_of_a_role_share_a_block(spark):
    [out] = formatted(spark, [(1, 2, "user", "b"), (1, 1, "user", "a"), (1, 3, "assistant", "c")])
    assert out.formatted == "<s>user[INST]a[/INST][INST]b[/INST]</s><s>assistant[INST]c[/INST]</s>"


def test_nulls_ties_repeats_and_empty(spark):
    assert formatted(spark, []) == []
    out = {r.conv_id: r for r in formatted(spark, [
        (None, None, None, None), (None, 1, "user", "x"), (7, 1, "b", "y"), (7, 1, "a", "y"), (7, 1, "a", "y"), (7, None, "z", "w")])}
    assert [tuple(t) for t in out[None].turns] == [("", ""), ("user", "x")]
    assert [tuple(t) for t in out[7].turns] == [("z", "w"), ("a", "y"), ("a", "y"), ("b", "y")]
    assert out[7].loss == []


def test_a_long_conversation(spark):
    rows = [(1, i, "assistant" if i % 3 else "user", "ab" * (i % 50)) for i in range(3000)]
    [out] = formatted(spark, rows)
    assert out.loss == [x for _, _, r, x in rows if r == "assistant"]


def long_conversation(spark, turns, roles):
    rows = spark.range(turns).selectExpr(
        "1L AS conv_id", "id AS turn", f"element_at(array({roles}), CAST(id % 2 AS INT) + 1) AS role",
        "concat('[INST] turn ', id, ' é </s>') AS text")
    out = chat.format_conversations(rows)
    return out.select(
        "n_turns", F.size(chat.read_turns(F.col("formatted"))).alias("read"),
        F.sha2(F.array_join(chat.loss_texts(F.col("formatted"), F.col("loss_spans")), ""), 256).alias("loss"))


def test_time_grows_with_the_turns(spark):
    from hashlib import sha256
    import time
    for roles, trained in (("'user', 'assistant'", lambda i: i % 2), ("'assistant', 'assistant'", lambda i: True)):
        long_conversation(spark, 1000, roles).collect()
        seconds = []
        for turns in (25_000, 100_000):
            start = time.perf_counter()
            [row] = long_conversation(spark, turns, roles).collect()
            seconds.append(time.perf_counter() - start)
            said = "".join(f"[INST] turn {i} é </s>" for i in range(turns) if trained(i))
            assert tuple(row) == (turns, turns, sha256(said.encode()).hexdigest())
        assert seconds[1] < 8 * seconds[0] + 2  # four times the turns: sixteen times if it were quadratic


def test_no_python_worker_and_one_shuffle(spark):
    df = spark.createDataFrame([(1, 1, "user", "a", "b")], SCHEMA)
    plan = chat.format_conversations(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan and "Arrow" not in plan
