"""Chat formatting: final messages from event logs, rendered with a template that can be read back.

Native Spark SQL throughout; no row leaves the JVM.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixelweave.llm._common import ids_only, table

OPEN, DELTA, EDIT, AGAIN = "open", "delta", "edit", "regenerate"
#: The marks around a turn's text, by role; a turn of any other role names it.
TURNS = {"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), "system": ("[SYS]", "[/SYS]")}
OTHER = ("[ROLE]", "[TEXT]", "[/ROLE]")
CONTROL = [*(m for pair in TURNS.values() for m in pair), *OTHER]
# a control string, or one with backslashes after its bracket
_REST = "|".join(re.escape(m[1:]) for m in CONTROL)
ESCAPE = (rf"([<\[])(\\*)({_REST})", r"$1\\$2$3")
UNESCAPE = (rf"([<\[])\\(\\*)({_REST})", "$1$2$3")
PIECE = 48  # characters of a streamed delta in the logs that are made of finished conversations


def escaped(text: Column) -> Column:
    """A text without control strings: each gets one backslash after its bracket, and so does one that has some."""
    return F.regexp_replace(text, F.lit(ESCAPE[0]), F.lit(ESCAPE[1]))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(UNESCAPE[0]), F.lit(UNESCAPE[1]))


def event_log(conversations: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", piece: int = PIECE) -> DataFrame:
    """The log that a chat service would have written while these conversations took place.

    Each turn is opened with its role, then streamed in deltas. By its hash a turn is streamed plainly,
    or a draft is streamed first and regenerated, or its draft stays until an edit at the end of the
    log puts the text right. Returns conv, seq, message, kind, role, text. Turns come in order (nulls
    first, ties by role and text); null roles and texts count as empty, repeated rows are turns each.
    """
    rows = ids_only(conversations, conv=conv_id, turn=turn, role=role, text=text).fillna("", ["role", "text"])
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = rows.withColumn("message", F.row_number().over(order)).withColumn("way", F.pmod(F.xxhash64("conv", "message"), F.lit(3)))
    none = F.lit(None).cast("string")

    def event(kind: str, body: Column, role: Column = none, late: int = 0) -> Column:
        return F.struct(F.lit(late).alias("late"), F.lit(kind).alias("kind"), role.alias("role"), body.alias("text"))

    draft = F.concat(F.substring("text", 1, piece), F.lit(" [INST]"))
    pieces = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{piece}}}"), F.lit(0))
    streamed = F.transform(pieces, lambda p: event(DELTA, p))
    steps = F.concat(
        F.array(event(OPEN, none, F.col("role"))),
        F.when(F.col("way") == 0, streamed)
        .when(F.col("way") == 1, F.concat(F.array(event(DELTA, draft), event(AGAIN, none)), streamed))
        .otherwise(F.array(event(DELTA, draft), event(EDIT, F.col("text"), none, 1))),
    )
    log = rows.select("conv", "message", F.posexplode(steps).alias("step", "e"))
    return log.select("conv", F.struct("e.late", "message", "step").alias("seq"), "message", "e.kind", "e.role", "e.text")


def messages(log: DataFrame) -> DataFrame:
    """Final messages from a log of events (conv, seq, message, kind, role, text).

    A message's events count in the order of seq: `open` gives its role, `delta` appends to its text,
    `edit` replaces the text, `regenerate` discards it. So the text is what the last edit or
    regeneration, if any, and the deltas after it give. What was discarded goes before anything is
    collected. One shuffle by conversation serves all steps.

    Returns conv, message, role, text. A message without text is empty, one that was never opened has
    an empty role; null texts count as empty, unknown kinds are ignored, events with one seq count in
    the order of kind and text. An empty log gives an empty result.
    """
    one = Window.partitionBy("conv", "message").orderBy("seq", "kind", "text")
    log = log.repartition("conv").withColumn("place", F.row_number().over(one))
    reset = F.max(F.when(F.col("kind").isin(EDIT, AGAIN), F.col("place"))).over(Window.partitionBy("conv", "message"))
    live = log.withColumn("reset", F.coalesce(reset, F.lit(0))).where((F.col("kind") == OPEN) | (F.col("place") >= F.col("reset")))
    part = F.when(F.col("kind").isin(DELTA, EDIT), F.struct("place", "text"))
    return live.groupBy("conv", "message").agg(
        F.coalesce(F.max_by("role", F.when(F.col("kind") == OPEN, F.col("place"))), F.lit("")).alias("role"),
        F.array_join(F.transform(F.sort_array(F.collect_list(part)), lambda p: p["text"]), "").alias("text"),
    )


def rendered(said: DataFrame) -> DataFrame:
    """One formatted text for each conversation (conv, message, role, text), and its loss mask.

    Returns conv, formatted and loss, the spans (start, length in characters) of the assistant's texts
    in it. A turn is its text between the marks of its role, `[ROLE]role[TEXT]text[/ROLE]` for roles
    without marks. Control strings in texts and roles are escaped, so that marks stand only where a
    turn begins or ends, and every text can be had back exactly. The formatted text of a conversation
    is one value, so all its turns meet in one row; nothing else is collected.
    """
    body = escaped(F.col("text"))

    def marked(role: str) -> Column:
        return F.struct(F.lit(TURNS[role][0]).alias("head"), body.alias("body"), F.lit(TURNS[role][1]).alias("tail"), F.lit(role == "assistant").alias("loss"))

    other = F.struct(F.concat(F.lit(OTHER[0]), escaped(F.col("role")), F.lit(OTHER[1])).alias("head"), body.alias("body"), F.lit(OTHER[2]).alias("tail"), F.lit(False).alias("loss"))
    turn = other
    for role in TURNS:
        turn = F.when(F.col("role") == role, marked(role)).otherwise(turn)
    size = F.char_length("t.head") + F.char_length("t.body") + F.char_length("t.tail")
    placed = said.withColumn("t", turn).withColumn("size", size)
    before = F.sum("size").over(Window.partitionBy("conv").orderBy("message").rowsBetween(Window.unboundedPreceding, -1))
    placed = placed.withColumn("start", F.coalesce(before, F.lit(0)) + F.char_length("t.head"))
    span = F.when(F.col("t.loss"), F.struct("start", F.char_length("t.body").alias("length")))
    whole = F.struct("message", F.concat("t.head", "t.body", "t.tail").alias("piece"))
    return placed.groupBy("conv").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(whole)), lambda w: w["piece"]), "").alias("formatted"),
        F.sort_array(F.collect_list(span)).alias("loss"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """The turns (role, text) and the texts under the loss mask, from what `rendered` returns."""
    marks = [*TURNS.values(), (OTHER[0], OTHER[2])]
    turn = "(?s)" + "|".join(f"{re.escape(a)}.*?{re.escape(b)}" for a, b in marks)
    pieces = F.regexp_extract_all("formatted", F.lit(turn), F.lit(0))

    def inner(piece: Column, head: str | Column, tail: str) -> Column:
        size = F.lit(len(head)) if isinstance(head, str) else head
        return unescaped(F.substring(piece, size + 1, F.char_length(piece) - size - len(tail)))

    def turned(piece: Column) -> Column:
        middle = F.instr(piece, OTHER[1]) - 1
        out = F.struct(
            unescaped(F.substring(piece, F.lit(len(OTHER[0]) + 1), middle - len(OTHER[0]))).alias("role"),
            inner(piece, middle + len(OTHER[1]), OTHER[2]).alias("text"),
        )
        for role, (head, tail) in TURNS.items():
            out = F.when(F.startswith(piece, F.lit(head)), F.struct(F.lit(role).alias("role"), inner(piece, head, tail).alias("text"))).otherwise(out)
        return out

    learned = F.transform("loss", lambda s: unescaped(F.substring("formatted", s["start"].cast("int") + 1, s["length"])))
    return formatted.select("conv", "formatted", F.transform(pieces, turned).alias("turns"), learned.alias("learned"))


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one that says control strings, through their event logs, formatted and read back."""
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    says = F.lit("</s>[INST] ok [/INST]")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), says.alias("text"))
    back = read_back(rendered(messages(event_log(given.unionByName(more)))))
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        F.col("conv").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.char_length(F.array_join("learned", "")).cast("long").alias("loss_chars"), F.sha2(F.array_join("learned", ""), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


_TURN = " ".join(f"when role = '{r}' then '{a}' || body || '{b}'" for r, (a, b) in TURNS.items())
_ESCAPED = f"regexp_replace({{}}, '{ESCAPE[0]}', '\\1\\\\\\2\\3', 'g')"

#: The same digests straight from the finished conversations.
ORACLE_SQL = f"""
with said as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, t, case t when 0 then 'user' else 'assistant' end, '</s>[INST] ok [/INST]' from range(2) r(t)
), turned as (
  select *, case {_TURN} else '{OTHER[0]}' || {_ESCAPED.format("role")} || '{OTHER[1]}' || body || '{OTHER[2]}' end as piece
  from (select *, {_ESCAPED.format("text")} as body from said)
), whole as (
  select conv_id, count(*) as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text) as turns, string_agg(piece, '' order by turn, role, text) as formatted,
    coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn, role, text), '') as learned
  from turned group by conv_id
)
select conv_id, n_turns, sha256(turns) as turns_sha256, length(learned) as loss_chars, sha256(learned) as loss_sha256, length(formatted) as formatted_chars
from whole
"""
