"""Chat formatting: turns of a conversation become one marked text.

Turns are sorted, adjacent turns of one role collected as structs into blocks,
and the text is put together by window, array and string expressions, each of
which goes through a conversation once. Control strings inside roles and texts
are escaped reversibly, so the output can be read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Control strings of the template, and others that models give a meaning.
BLOCK_START, BLOCK_END = "<s>", "</s>"
TURN_START, TURN_END = "[INST]", "[/INST]"
TRAINED_ROLE = "assistant"

_CONTROL = r"/?s>|/?INST\]|/?SYS>>|\|"
_TO_ESCAPE = rf"([<\[])(\\*)({_CONTROL})"
_ESCAPED = rf"([<\[])\\(\\*)({_CONTROL})"

def escape(text: Column) -> Column:
    """One more backslash after the bracket of every control string."""
    return F.regexp_replace(text, _TO_ESCAPE, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def format_conversations(rows: DataFrame, trained_role: str = TRAINED_ROLE) -> DataFrame:
    """conv_id, n_turns, formatted, loss_spans from rows (conv_id, turn, role, text).

    A run of turns with one role becomes one block,
    ``<s>role[INST]text[/INST][INST]text[/INST]</s>``. ``loss_spans`` has the
    (start, length) in code points, from 0, of every text of the trained role.
    Null texts and roles are empty, null turns come first, equal turn numbers
    are ordered by role and text, repeated rows are repeated turns. Rows without
    a conv_id form one conversation whose id is null. An empty table gives no
    rows; other columns are ignored. A conversation is one row of the result, so
    it has to fit one.
    """
    turns = rows.select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opens = F.coalesce(F.lag("role").over(order) != F.col("role"), F.lit(True))
    marked = turns.select(
        "conv_id", "role", escape(F.col("text")).alias("text"), F.row_number().over(order).alias("place"),
        opens.alias("opens"))
    head = F.when(F.col("opens"), F.concat(
        F.when(F.col("place") > 1, F.lit(BLOCK_END)).otherwise(F.lit("")), F.lit(BLOCK_START), escape(F.col("role")),
    )).otherwise(F.lit(""))
    # the windows of a conversation go on from the same sorted rows
    by_place = so_far.orderBy("place")
    pieces = marked.select(
        "conv_id", "role", "place", F.length("text").cast("bigint").alias("length"),
        F.concat(head, F.lit(TURN_START), "text", F.lit(TURN_END)).alias("piece"),
        F.sum(F.col("opens").cast("bigint")).over(by_place).alias("block"))
    placed = pieces.withColumn("end", F.sum(F.length("piece").cast("bigint")).over(by_place))
    in_order = lambda field, *rest: F.array_sort(F.collect_list(F.struct(field, *rest)))
    span = F.struct((F.col("end") - len(TURN_END) - F.col("length")).alias("start"), "length")
    blocks = placed.groupBy("conv_id", "block").agg(
        F.first("role").alias("role"), F.count(F.lit(1)).alias("turns"),
        in_order("place", "piece").alias("pieces"), in_order("place", span.alias("span")).alias("spans"))
    merged = blocks.select(
        "conv_id", "block", "turns",
        F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("text"),
        F.when(F.col("role") == trained_role, F.transform("spans", lambda s: s["span"])).otherwise(F.array()).alias("spans"))
    whole = merged.groupBy("conv_id").agg(F.sum("turns").alias("n_turns"), in_order("block", "text", "spans").alias("blocks"))
    return whole.select(
        "conv_id", "n_turns",
        F.concat(F.array_join(F.transform("blocks", lambda b: b["text"]), ""), F.lit(BLOCK_END)).alias("formatted"),
        F.flatten(F.transform("blocks", lambda b: b["spans"])).alias("loss_spans"))


def _once(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is used inside."""
    return F.transform(F.array(value), use)[0]


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) read back from a formatted text, in turn order."""
    blocks = F.filter(F.split(formatted, BLOCK_END), lambda b: b != "")
    opened = F.transform(blocks, lambda b: F.substring(b, len(BLOCK_START) + 1, 2**31 - 1))

    blocks = F.transform(
        F.transform(opened, lambda b: F.split(b, r"\[INST\]")),
        lambda parts: F.struct(unescape(parts[0]).alias("role"), F.slice(parts, 2, F.size(parts)).alias("texts")))
    return F.flatten(F.transform(blocks, lambda b: F.transform(
        b["texts"], lambda t: F.struct(
            b["role"].alias("role"), unescape(F.left(t, F.length(t) - len(TURN_END))).alias("text")))))


def loss_texts(formatted: Column, spans: Column) -> Column:
    """Array of the unescaped texts that the loss mask covers.

    Four bytes a code point make a span a slice, found without counting from the
    front of the text.
    """
    both = F.struct(F.encode(formatted, "UTF-32").alias("points"), spans.alias("spans"))
    return _once(both, lambda x: F.transform(x["spans"], lambda s: unescape(F.decode(F.substring(
        x["points"], (4 * s["start"] + 1).cast("int"), (4 * s["length"]).cast("int")), "UTF-32"))))
