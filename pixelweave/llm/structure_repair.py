"""Repair of damaged conversations by a fold over their turns.

A repaired conversation has role initials `(s?(ua)+)?`. That language has four states: nothing yet,
after the system turn, after a user turn, after an assistant turn. A fold carries for each state the
cheapest (cost, audit) that ends there; all of it is native Spark SQL. Only the digest of the repaired
text is taken in Python, from a sorted stream of rows, since no native digest takes its input in parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixelweave.llm._common import by_bytes, ids_only, table

CHUNK = 256  # turns in one fold; longer conversations are folded in chunks, and the chunks then
FAR = 1 << 50  # the cost of a state that can't be reached
SPACE = "[\\x20\\x09-\\x0D]"  # what doesn't count as a character of a turn
MARKS = "[.!?]"
STATES = ("start", "system", "user", "assistant")
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
EMPTY = hashlib.sha256(b"").hexdigest()


def damaged(conversations: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Damage rows by crc32(`conv_id:turn`) % 20, nulls taken as one space, as planted faults do.

    Returns conv, turn, role, text and there (false: the row was dropped and only tells that its
    conversation exists). A null turn stays null for the order.
    """
    spaced = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv", "turn")]
    rows = ids_only(conversations, conv=conv_id, turn=turn, role=role, text=text).fillna(" ", ["role", "text"])
    rows = rows.withColumn("fault", F.crc32(F.concat_ws(":", *spaced).cast("binary")) % 20)
    return rows.select(
        "conv", "turn",
        F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", MARKS, "")).otherwise(F.col("text")).alias("text"),
        (F.col("fault") != 0).alias("there"),
        F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value computed once."""
    return F.transform(F.array(value), then)[0]


def _state(cost: Column | int, audit: Column | str) -> Column:
    cost = F.lit(cost).cast("long") if isinstance(cost, int) else cost
    return F.struct(cost.alias("cost"), (F.lit(audit) if isinstance(audit, str) else audit).alias("audit"))


def _states(*four: Column) -> Column:
    return F.struct(*(s.alias(name) for s, name in zip(four, STATES, strict=True)))


def _edit(state: Column, letter: str, cost: Column | int) -> Column:
    return _state(state["cost"] + cost, F.concat(state["audit"], F.lit(letter)))


def _inserted(n: Column) -> Column:
    """States after any insertions: one leads to a user turn, from there another to an assistant turn."""
    start, system, user, assistant = (n[s] for s in STATES)
    return _states(
        start, system,
        F.least(user, _edit(start, "I", 2), _edit(system, "I", 2), _edit(assistant, "I", 2)),
        F.least(assistant, _edit(user, "I", 2), _edit(start, "II", 4), _edit(system, "II", 4)),
    )


def _turn(acc: Column, t: Column) -> Column:
    """States after one more turn, which is kept, given another role or deleted, and insertions after it."""
    extra = F.when(t["cut"], 1).otherwise(0).cast("long")
    never = _state(FAR, "")

    def moved(was: Column, to: str) -> Column:
        same = t["initial"] == to[0]
        return F.when(t["gone"], never).when(same, _edit(was, "K", extra)).otherwise(_edit(was, "R", extra + 2))

    start, system, user, assistant = (acc[s] for s in STATES)
    after = _states(
        _edit(start, "D", 3),
        F.least(_edit(system, "D", 3), F.when(~t["gone"] & (t["initial"] == "s"), _edit(start, "K", extra)).otherwise(never)),
        F.least(_edit(user, "D", 3), _let(F.least(start, system, assistant), lambda was: moved(was, "user"))),
        F.least(_edit(assistant, "D", 3), moved(user, "assistant")),
    )
    return _let(after, _inserted)


def _only(at: int) -> Column:
    return _states(*(_state(0 if k == at else FAR, "") for k in range(len(STATES))))


def _joined(acc: Column, chunk: Column) -> Column:
    """States after a chunk of turns, from its states after each state before it."""

    def through(to: str) -> Column:
        return F.least(*(
            _state(acc[s]["cost"] + chunk[k][to]["cost"], F.concat(acc[s]["audit"], chunk[k][to]["audit"])) for k, s in enumerate(STATES)
        ))

    return _states(*(through(s) for s in STATES))


def audited(rows: DataFrame, *, chunk: int = CHUNK) -> DataFrame:
    """The faults of each conversation and its cheapest repair, from rows as `damaged` returns them.

    Returns conv, the counts and audit. One shuffle by conversation, of rows without their texts,
    serves both windows and both groupings. No array holds more than `chunk` turns, so a very long
    conversation costs a longer sort, which spills, and an audit with one letter a turn.
    """
    small = rows.select(
        "conv", "turn", "role", "there",
        F.unhex(F.sha2("text", 256)).alias("digest"),
        F.substring("role", 1, 1).alias("initial"),
        (~F.col("text").rlike(SPACE.replace("[", "[^"))).alias("blank"),
        F.col("text").rlike(f"[^.!?\\x20\\x09-\\x0D]{SPACE}*\\z").alias("open"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    by_turn = Window.partitionBy("conv").orderBy(F.col("there").desc(), *order)
    same = Window.partitionBy("conv", "role", "digest").orderBy(F.col("there").desc(), F.col("turn").asc_nulls_first())
    pair = F.concat(F.lag("initial").over(by_turn), "initial")
    flagged = (
        small.withColumn("again", F.row_number().over(same) > 1)
        .withColumns({
            "n": F.row_number().over(by_turn),
            "illegal": F.coalesce(~pair.isin("su", "ua", "au"), F.lit(False)),
            "new": F.coalesce(F.lag("turn").over(by_turn) != F.col("turn"), F.col("turn").isNotNull()),
        })
        .withColumns({
            "chunk": F.floor((F.col("n") - 1) / chunk),
            "gone": F.col("blank") | F.col("again"),
            "cut": ~F.col("blank") & ~F.col("again") & F.col("open"),
        })
    )
    there = F.col("there")

    def counted(flag: Column) -> Column:
        return F.count(F.when(there & flag, 1))

    chunks = flagged.groupBy("conv", "chunk").agg(
        F.sort_array(F.collect_list(F.when(there, F.struct("n", "initial", "gone", "cut")))).alias("turns"),
        counted(F.col("blank")).alias("blank"), counted(~F.col("blank") & F.col("again")).alias("duplicate"),
        counted(F.col("cut")).alias("truncated"), counted(F.col("illegal")).alias("illegal"), counted(F.col("new")).alias("turns_seen"),
        F.min(F.when(there, F.col("turn"))).alias("first"), F.max(F.when(there, F.col("turn"))).alias("last"),
    )
    fold = [F.aggregate("turns", _only(k), _turn) for k in range(len(STATES))]
    begun = F.aggregate("turns", _inserted(_only(0)), _turn)
    chunks = chunks.withColumn("states", F.when(F.col("chunk") == 0, F.array(begun)).otherwise(F.array(*fold))).drop("turns")
    whole = chunks.groupBy("conv").agg(
        F.sort_array(F.collect_list(F.struct("chunk", "states"))).alias("chunks"),
        *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "turns_seen")),
        F.min("first").alias("first"), F.max("last").alias("last"),
    )
    rest = F.slice("chunks", F.lit(2), F.size("chunks"))
    end = F.aggregate(rest, F.col("chunks")[0]["states"][0], lambda acc, c: _joined(acc, c["states"]))
    return whole.withColumn("end", end).withColumn("best", F.least("end.start", "end.assistant")).select(
        "conv", F.coalesce(F.col("last") - F.col("first") + 1 - F.col("turns_seen"), F.lit(0)).cast("long").alias("gaps"),
        "blank", "duplicate", "truncated", "illegal", "best.cost", "best.audit",
    )


class _Repair:
    """Digest of one conversation's repaired lines, fed turn by turn."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state, self.lines, self.sha = audit, 0, "start", 0, hashlib.sha256()

    def line(self, role: str, text: str) -> None:
        self.sha.update(b"\n" * (self.lines > 0) + f"{role}:{text}".encode())
        self.lines += 1

    def next_role(self) -> str:
        self.state = "assistant" if self.state == "user" else "user"
        return self.state

    def insertions(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.line(self.next_role(), "")
            self.at += 1

    def turn(self, role: str, text: str) -> None:
        self.insertions()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self.state = next(s for s in STATES[1:] if s[0] == role[0])
            self.line(role, text)
        elif letter == "R":
            self.line(self.next_role(), text)

    def digest(self) -> str:
        self.insertions()
        return self.sha.hexdigest()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by conversation, its audit first: each audit row with the digest of what its repair gives."""
    head, repair = None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*head.columns, pa.array([repair.digest()])], names=[*head.schema.names, "repaired_sha256"])

    for whole in batches:
        for batch in by_bytes(whole, "text"):
            for k, (audit, role, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("audit", "role", "text")), strict=True)):
                if audit is not None:
                    if repair:
                        yield done()
                    head, repair = batch.slice(k, 1).select(["conv", *COUNTS, "audit"]), _Repair(audit)
                else:
                    repair.turn(role, text)
    if repair:
        yield done()


def repaired(rows: DataFrame, *, chunk: int = CHUNK) -> DataFrame:
    """Faults, cheapest repair and its digest for each conversation, from rows as `damaged` returns them.

    Each row's first fault counts: blank, duplicate (its role and text came before), truncated. Keep
    costs 0, Rerole 2, Delete 3 (the only way for blank and duplicate rows), Insert 2, and each
    truncated row that stays 1. Of equally cheap audits the least in ASCII order is taken.

    Turns may be null (they come first), tied (then by role and by the text's SHA-256) or repeated
    (then duplicates). An empty role has no initial, so such a row cannot be kept as it is. A null
    conversation is one like any other. A conversation without rows, all of
    them dropped, has zeros, an empty audit and the digest of an empty text; an empty table gives an
    empty result. Columns of other names are ignored. The digest reads one conversation's rows one
    after the other in sorted order and holds none of them.
    """
    heads = audited(rows, chunk=chunk)
    conv = rows.schema["conv"].dataType.simpleString()
    empty = {**{c: F.lit(None).cast("long") for c in COUNTS}, "audit": F.lit(None).cast("string")}
    turns = rows.where("there").select("conv", F.lit(1).alias("kind"), "turn", "role", "text", F.unhex(F.sha2("text", 256)).alias("digest"), *(v.alias(k) for k, v in empty.items()))
    kinds = {f.name: f.dataType for f in turns.schema}
    named = heads.select(*(F.col(c) if c in heads.columns else (F.lit(0) if c == "kind" else F.lit(None)).cast(kinds[c]).alias(c) for c in turns.columns))
    stream = turns.unionByName(named).repartition("conv").sortWithinPartitions("conv", "kind", F.col("turn").asc_nulls_first(), "role", "digest")
    fields = ", ".join(f"{c} bigint" for c in COUNTS)
    return stream.drop("digest", "turn", "kind").mapInArrow(_digests, f"conv {conv}, {fields}, audit string, repaired_sha256 string")


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged and repaired."""
    return repaired(damaged(table(spark, sf_dir, "conversations"))).withColumnRenamed("conv", "conv_id")


def _oracle() -> str:
    """The same by one recursive step a turn; a state is (cost, audit, repaired lines)."""

    def state(was: str, cost: str, letters: str, line: str = "") -> str:
        lines = f"{was}.o || case when {was}.o = '' then '' else chr(10) end || {line}" if line else f"{was}.o"
        return f"struct_pack(c := {was}.c + {cost}, a := {was}.a || '{letters}', o := {lines})"

    def least(*of: str) -> str:
        return f"list_sort([{', '.join(of)}])[1]"

    def kept(was: str, letter: str, to: str) -> str:
        keep, role = state(was, "cut", "K", "role || ':' || text"), state(was, "cut + 2", "R", f"'{to}:' || text")
        return f"case when gone then never when initial = '{letter}' then {keep} else {role} end"

    two = "'user:' || chr(10) || 'assistant:'"
    inserted = f"""s0, s1, {least("s2", *(state(s, "2", "I", "'user:'") for s in ("s0", "s1", "s3")))} as s2,
        {least("s3", state("s2", "2", "I", "'assistant:'"), state("s0", "4", "II", two), state("s1", "4", "II", two))} as s3"""
    never = f"struct_pack(c := {FAR}::bigint, a := '', o := '')"
    system = f"case when not gone and initial = 's' then {state('s0', 'cut', 'K', "role || ':' || text")} else never end"
    return f"""
with recursive crc_table as (
  select list(v order by i) as t from (
    select i, list_reduce([i::bigint, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1))) as v from range(256) r(i))
), spaced as (
  select conv_id as conv, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as k from conversations
), faulty as (
  select conv, turn, role, text, xor(4294967295, list_reduce(
    list_prepend(4294967295::bigint, list_transform(range(1, length(k) + 1), lambda j: ord(substr(k, j::int, 1))::bigint)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 20 as fault from spaced, crc_table
), damaged as (
  select conv, turn, case fault when 4 then 'user' else role end as role, copy,
    case fault when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from faulty, range(2) r(copy) where fault <> 0 and (copy = 0 or fault = 3)
), flags as (
  select *, row_number() over w as n, row_number() over (partition by conv, role, text order by turn nulls first, copy) > 1 as again,
    substr(role, 1, 1) as initial, lag(substr(role, 1, 1)) over w as before, not regexp_matches(text, '[^ \\t\\n\\x0B\\f\\r]') as blank,
    regexp_matches(text, '[^.!? \\t\\n\\x0B\\f\\r][ \\t\\n\\x0B\\f\\r]*$') as open
  from damaged window w as (partition by conv order by turn nulls first, role, sha256(text), copy)
), turns as (
  select *, blank or again as gone, case when open and not blank and not again then 1 else 0 end as cut from flags
), counts as (
  select conv, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (blank) as blank,
    count(*) filter (again and not blank) as duplicate, sum(cut)::bigint as truncated,
    count(*) filter (before is not null and before || initial not in ('su', 'ua', 'au')) as illegal, max(n) as n from turns group by conv
), fold as (
  select conv, 0::bigint as n, {inserted} from (
    select distinct conv, struct_pack(c := 0::bigint, a := '', o := '') as s0, {never} as s1, {never} as s2, {never} as s3 from turns)
  union all
  select conv, n, {inserted} from (
    select conv, n, {state("s0", "3", "D")} as s0, {least(state("s1", "3", "D"), system)} as s1,
      {least(state("s2", "3", "D"), kept("came", "u", "user"))} as s2, {least(state("s3", "3", "D"), kept("s2", "a", "assistant"))} as s3
    from (
      select t.conv, t.n, t.role, t.text, t.initial, t.gone, t.cut, f.s0, f.s1, f.s2, f.s3, {least("f.s0", "f.s1", "f.s3")} as came, {never} as never
      from fold f join turns t on t.conv is not distinct from f.conv and t.n = f.n + 1))
), ended as (
  select f.conv, {least("s0", "s3")} as best from fold f join counts c on c.conv is not distinct from f.conv and c.n = f.n
)
select i.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated,
  coalesce(illegal, 0)::bigint as illegal, coalesce(best.c, 0)::bigint as cost, coalesce(best.a, '') as audit, sha256(coalesce(best.o, '')) as repaired_sha256
from (select distinct conv_id from conversations) i left join counts c on c.conv is not distinct from i.conv_id left join ended e on e.conv is not distinct from i.conv_id
"""


ORACLE_SQL = _oracle()
