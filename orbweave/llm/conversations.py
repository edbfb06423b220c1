"""Conversation structure repair by a fold of native expressions.

1. Window functions over a conversation's rows flag faults: blank, repeated (role and text seen before), truncated, a
   turn seen for the first time, and a role that may not follow the one before.
2. The turns of a conversation are collected as structs and sorted by their place.
3. aggregate() folds them. It carries one (cost, audit) struct for each state of `(s?(ua)+)?`: at the start, behind
   system, behind user, behind assistant. least() picks the cheapest, and the ASCII-least audit among equals; a state that can't be
   reached is null, which least() passes over.
4. The audit names every edit, and with the roles' order all roles, so the repaired lines follow from it.

Why one struct a state is enough: an audit's letters fix its cost, so of two equally cheap audits none begins the other, and what
follows leaves their order as it is. Why one insertion between two rows is enough: two bring a state back to
itself for 10, or leave `s` by a way that costs more than deleting it.

A conversation is one value: the hash asked for is of all its text. All of it takes one shuffle, by conversation, and two sorts.

Defined results: in keys and texts a null is one space, a null role too; a null turn comes first and takes no part in gaps; rows of one
turn come in the order of role and text; a null conv_id is a conversation of its own; repeated rows are turns
of their own (and duplicates); extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbweave.llm.expressions import let, running

KEEP, REROLE, DELETE, INSERT = ("K", 0), ("R", 1), ("D", 2), ("I", 5)
#: Added where a truncated row stays.
TRUNCATED = 5
LEGAL = ("su", "ua", "au")
SOLID = r"[^\x20\x09-\x0D]"
FIELDS = ("start", "system", "user", "assistant")
STATE = "struct<cost:bigint,audit:string>"


def damaged(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role, text, dropped: rows as a checksum of their key damages them; dropped rows stay, marked."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said(conv_id), F.lit(":"), said(turn))) % 20
    rows = conversations.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), said(role).alias("role"), said(text).alias("text"), kind.alias("kind"))
    broken = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), broken.alias("text"), (F.col("kind") == 0).alias("dropped"), F.when(F.col("kind") == 3, 2).otherwise(1).alias("copies"))
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).drop("copies", "copy")


def flagged(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text, dropped) with at, blank, duplicate, truncated, new_turn, illegal."""
    whole = Window.partitionBy("conv_id", "dropped").orderBy(F.asc_nulls_first("turn"), "role", "text")
    alike = Window.partitionBy("conv_id", "dropped", "role", "text").orderBy("at")
    rows = rows.repartition("conv_id").withColumn("at", F.row_number().over(whole))
    initial = F.substring("role", 1, 1)
    before = F.lag(initial).over(Window.partitionBy("conv_id", "dropped").orderBy("at"))
    turn_before = F.lag("turn").over(Window.partitionBy("conv_id", "dropped").orderBy("at"))
    rows = rows.withColumns({"pair": F.concat(before, initial), "new_turn": F.col("turn").isNotNull() & (turn_before.isNull() | (turn_before != F.col("turn")))})
    rows = rows.withColumn("seen", F.row_number().over(alike) > 1)
    blank = ~F.col("text").rlike(SOLID)
    cut = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    return rows.select(
        "conv_id", "turn", "role", "text", "dropped", "at", "new_turn", blank.alias("blank"), (~blank & F.col("seen")).alias("duplicate"),
        (~blank & ~F.col("seen") & cut).alias("truncated"), (F.col("pair").isNotNull() & ~F.col("pair").isin(*LEGAL) & (F.col("at") > 1)).alias("illegal"),
    )


def _after(state: Column, edit: tuple[str, int], more: Column | int = 0) -> Column:
    """A state one edit later; null stays null."""
    letter, cost = edit
    return F.when(state.isNotNull(), F.struct((state["cost"] + cost + more).cast("bigint").alias("cost"), F.concat(state["audit"], F.lit(letter)).alias("audit")))


def _best(*states: Column) -> Column:
    return F.least(*states)


def _carry(start: Column, system: Column, user: Column, assistant: Column) -> Column:
    return F.struct(*[s.cast(STATE).alias(n) for n, s in zip(FIELDS, (start, system, user, assistant), strict=True)])


def _inserted(acc: Column) -> Column:
    """The states with up to one inserted row."""
    before_user = _best(acc["start"], acc["system"], acc["assistant"])
    return _carry(acc["start"], acc["system"], _best(acc["user"], _after(before_user, INSERT)), _best(acc["assistant"], _after(acc["user"], INSERT)))


def _step(acc: Column, row: Column) -> Column:
    """The states behind a row."""
    stays, extra = ~row["blank"] & ~row["duplicate"], F.when(row["truncated"], TRUNCATED).otherwise(0)
    named = lambda letter: row["initial"] == letter
    taken = lambda state, letter: F.when(stays, F.when(named(letter), _after(state, KEEP, extra)).otherwise(_after(state, REROLE, extra)))

    def put(open_: Column) -> Column:
        start, system, user, assistant = (open_[f] for f in FIELDS)
        gone = lambda state: _after(state, DELETE)
        return _carry(
            gone(start), _best(gone(system), F.when(stays & named("s"), _after(start, KEEP, extra))),
            _best(gone(user), taken(_best(start, system, assistant), "u")), _best(gone(assistant), taken(user, "a")),
        )

    return let(_inserted(acc), put)


def cheapest(rows: Column) -> Column:
    """struct<cost, audit> of the cheapest repair of sorted structs (initial, blank, duplicate, truncated, ...)."""
    nothing = F.struct(F.lit(0).cast("bigint").alias("cost"), F.lit("").alias("audit"))
    none = F.lit(None).cast(STATE)
    return F.aggregate(rows, _carry(nothing, none, none, none), _step, lambda acc: let(_inserted(acc), lambda open_: _best(open_["start"], open_["assistant"])))


def repaired_lines(rows: Column, audit: Column) -> Column:
    """array<string> of role:text after the edits of an audit."""

    def lines(letters: Column) -> Column:
        of_row = running(F.transform(letters, lambda x: F.when(x == "I", 0).otherwise(1).cast("bigint")))
        stays = running(F.transform(letters, lambda x: F.when(x == "D", 0).otherwise(1).cast("bigint")))

        def placed(tables: Column) -> Column:
            row_at, out_at = tables["row"], tables["out"]
            first = F.array_position(out_at, F.lit(1).cast("bigint")).cast("int")
            opens = F.when(F.element_at(letters, first) == "K", F.element_at(rows, F.element_at(row_at, first).cast("int"))["initial"] == "s").otherwise(False)

            def written(opened: Column) -> Column:
                def line(x: Column, k: Column) -> Column:
                    row = F.element_at(rows, F.greatest(F.element_at(row_at, k + 1), F.lit(1)).cast("int"))
                    user = (F.element_at(out_at, k + 1) - F.when(opened, 1).otherwise(0)) % 2 == 1
                    role = F.when(x == "K", row["role"]).otherwise(F.when(user, "user").otherwise("assistant"))
                    return F.when(x != "D", F.concat(role, F.lit(":"), F.when(x == "I", "").otherwise(row["text"])))

                return F.filter(F.transform(letters, line), lambda s: s.isNotNull())

            return let(F.coalesce(opens, F.lit(False)), written)

        some = let(F.struct(of_row.alias("row"), stays.alias("out")), placed)
        return F.when(F.exists(letters, lambda x: x != "D"), some).otherwise(F.array().cast("array<string>"))

    return let(F.filter(F.split(audit, ""), lambda x: x != ""), lines)


def repair(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, lines (of the repaired conversation)."""
    rows = conversations.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"), *([F.col("dropped")] if "dropped" in conversations.columns else [F.lit(False).alias("dropped")]))
    there = ~F.col("dropped")
    entry = F.struct("at", F.substring("role", 1, 1).alias("initial"), "blank", "duplicate", "truncated", "role", "text")
    counted = lambda c: F.count_if(there & F.col(c)).alias(c)
    live = F.when(there, F.col("turn"))
    gaps = F.coalesce(F.max(live) - F.min(live) + 1 - F.count_if(there & F.col("new_turn")), F.lit(0)).cast("bigint").alias("gaps")
    folded = flagged(rows).groupBy("conv_id").agg(gaps, *[counted(c) for c in ("blank", "duplicate", "truncated", "illegal")], F.array_sort(F.collect_list(F.when(there, entry))).alias("rows"))
    folded = folded.withColumn("best", cheapest(F.col("rows")))
    return folded.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", F.col("best.cost").alias("cost"), F.col("best.audit").alias("audit"), repaired_lines(F.col("rows"), F.col("best.audit")).alias("lines"))


def op13_conversation_repair(spark, sf_dir: str) -> DataFrame:
    """The contract's columns: conversations damaged by checksums, and their cheapest repairs."""
    found = repair(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    return found.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(F.array_join("lines", "\n"), 256).alias("repaired_sha256"))


#: The checksum from its table of 256 numbers, and the edits as a walk along each conversation's rows.
SQL = r"""
WITH RECURSIVE
crc_table AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS v FROM range(256) r(i))),
o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
h AS (SELECT o.*, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(key, ''), lambda c: ascii(c)::BIGINT)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) % 20 AS kind FROM o, crc_table),
e AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM h, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) WHERE kind <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM e),
f AS (SELECT conv_id, turn, role, text, pos, left(role, 1) AS c, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS seen,
        NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS cut, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) || left(role, 1) AS pair FROM n),
x AS (SELECT conv_id, turn, role, text, pos, c, blank, NOT blank AND seen AS duplicate, NOT blank AND NOT seen AND cut AS truncated, coalesce(pair NOT IN ('su', 'ua', 'au'), false) AS illegal FROM f),
ids AS (SELECT row_number() OVER () AS id, conv_id FROM (SELECT DISTINCT conv_id FROM conversations)),
y AS (SELECT ids.id, x.* FROM x JOIN ids ON x.conv_id IS NOT DISTINCT FROM ids.conv_id),
last AS (SELECT ids.id, coalesce(max(pos), 0) AS rows FROM ids LEFT JOIN y USING (id) GROUP BY ids.id),
-- one row for each conversation, row and state (0 start, 1 system, 2 user, 3 assistant), cheapest first; odd steps insert
walk(id, step, state, cost, audit, said) AS (
  SELECT id, 0, 0, 0, '', ''::VARCHAR FROM last
  UNION ALL
  SELECT id, step, state, cost, audit, said FROM (
    SELECT *, row_number() OVER (PARTITION BY id, state ORDER BY cost, audit) AS best FROM (
      SELECT w.id, w.step + 1 AS step, m.state, w.cost + m.cost AS cost, w.audit || m.letter AS audit, w.said || m.line AS said
      FROM walk w JOIN last USING (id) LEFT JOIN y ON y.id = w.id AND y.pos = (w.step + 1) // 2 AND w.step % 2 = 1,
      LATERAL (VALUES
        (w.step % 2 = 0, w.state, 0, '', ''),
        (w.step % 2 = 0 AND w.state <> 2, 2, 5, 'I', 'user:' || chr(10)),
        (w.step % 2 = 0 AND w.state = 2, 3, 5, 'I', 'assistant:' || chr(10)),
        (w.step % 2 = 1, w.state, 2, 'D', ''),
        (w.step % 2 = 1 AND NOT y.blank AND NOT y.duplicate AND w.state = 0 AND y.c = 's', 1, y.truncated::INT * 5, 'K', y.role || ':' || y.text || chr(10)),
        (w.step % 2 = 1 AND NOT y.blank AND NOT y.duplicate AND w.state <> 2 AND y.c = 'u', 2, y.truncated::INT * 5, 'K', y.role || ':' || y.text || chr(10)),
        (w.step % 2 = 1 AND NOT y.blank AND NOT y.duplicate AND w.state <> 2 AND y.c <> 'u', 2, 1 + y.truncated::INT * 5, 'R', 'user:' || y.text || chr(10)),
        (w.step % 2 = 1 AND NOT y.blank AND NOT y.duplicate AND w.state = 2 AND y.c = 'a', 3, y.truncated::INT * 5, 'K', y.role || ':' || y.text || chr(10)),
        (w.step % 2 = 1 AND NOT y.blank AND NOT y.duplicate AND w.state = 2 AND y.c <> 'a', 3, 1 + y.truncated::INT * 5, 'R', 'assistant:' || y.text || chr(10))
      ) AS m(ok, state, cost, letter, line)
      WHERE m.ok AND w.step < 2 * last.rows + 1)) WHERE best = 1),
done AS (SELECT id, cost, audit, said FROM (SELECT w.*, row_number() OVER (PARTITION BY w.id ORDER BY w.cost, w.audit) AS best FROM walk w JOIN last USING (id) WHERE w.step = 2 * last.rows + 1 AND w.state IN (0, 3)) WHERE best = 1),
total AS (SELECT id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(duplicate) AS duplicate, count_if(truncated) AS truncated, count_if(illegal) AS illegal FROM y GROUP BY id)
SELECT ids.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  cost::BIGINT AS cost, audit, sha256(CASE WHEN said = '' THEN '' ELSE left(said, length(said) - 1) END) AS repaired_sha256
FROM ids JOIN done USING (id) LEFT JOIN total USING (id)"""

QUERIES = {"op13_conversation_repair": op13_conversation_repair}
ORACLE_SQL: dict[str, str] = {"op13_conversation_repair": SQL}
