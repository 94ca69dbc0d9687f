"""Conversation structure repair: the cheapest edits that give a conversation a legal order of roles.

A conversation is read backwards first: for each turn and each state of the grammar, what the rest costs, and the
first edits of the cheapest way on (dynamic programming; of equal costs the edit that is first in ASCII). Then it is
read forwards along these edits. Both passes stream over rows that Spark has sorted, so a task holds four numbers, not
a conversation; only a digest's list of edits grows with it.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomline.llm.shared import WORD, WORD_BREAKS

#: Grammar ``(s?(ua)+)?`` over initials of roles. States: nothing yet, a system, a user, an assistant turn read last.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
#: By state, the role that may be put in there and the state behind it; a system turn can only be kept, at the start.
NEXT = (("user", USER), ("user", USER), ("assistant", ASSISTANT), ("user", USER))
#: The state behind a kept turn, by state and the initial of its role.
KEPT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
ENDS = (START, ASSISTANT)
NEVER = 1 << 60
#: The edits, in ASCII order.
DELETE, INSERT, KEEP, REROLE = "DIKR"
#: Pairs of initials that may follow one another.
LEGAL = frozenset({"su", "ua", "au"})


@dataclass(frozen=True)
class Costs:
    keep: int = 0
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of ``turns`` with faults put in by crc32(``conv_id:turn``) % 20, to try repairs on.

    0 drops the row, 1 empties its text, 2 removes its ``[.!?]``, 3 repeats it, 4 makes it a user's. A null role or text
    is one space, and so are a null conv_id and turn within the digest; repeated rows are damaged alike.
    """
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", known("conv_id"), known("turn")).cast("binary")) % 20
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), known("role").alias("role"), known("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.where("kind <> 0").withColumn("copy", F.explode(copies)).select("conv_id", "turn", role.alias("role"), text.alias("text"))


def with_faults(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copy, fault, in one partition for each conversation: the first of blank, duplicate and truncated that holds, or null.

    blank: no character but space and \\x09 to \\x0D. duplicate: the role and text came earlier in the conversation.
    truncated: the last other character is none of ``.!?``. Rows are in the order of turn (nulls first), role and text;
    ``copy`` numbers equal rows. A null role or text is one space.
    """
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), known("role").alias("role"), known("text").alias("text"))
    rows = rows.withColumn("h", F.sha2(F.col("text").cast("binary"), 256)).repartition("conv_id")
    # The window's keys begin with the partition's, so it shuffles nothing; it streams over sorted rows.
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "h").orderBy(F.asc_nulls_first("turn")))
    last = F.substring(F.rtrim("text", F.lit(WORD_BREAKS)), -1, 1)
    fault = F.when(~F.col("text").rlike(WORD), "blank").when(F.col("copy") > 1, "duplicate").when(~last.isin(".", "!", "?"), "truncated")
    return rows.withColumn("copy", seen).withColumn("fault", fault).drop("h")


def _ways(initial: str, fault: str | None, after: list[int], costs: Costs) -> tuple[list[int], list[str]]:
    """By state: what the conversation costs from this turn on, and the edits up to the one that takes this turn.

    ``after``: the same costs behind this turn.
    """
    cost, edit = [NEVER] * STATES, [""] * STATES
    extra = costs.truncated if fault == "truncated" else 0
    for s in range(STATES):
        ways = [(costs.delete + after[s], DELETE)]
        if fault not in ("blank", "duplicate"):
            if initial in KEPT[s]:
                ways.append((costs.keep + extra + after[KEPT[s][initial]], KEEP))
            ways.append((costs.rerole + extra + after[NEXT[s][1]], REROLE))
        cost[s], edit[s] = min(ways)
    for _ in range(STATES):  # a turn may be put in before it, and before that one; a state does not come twice
        for s in range(STATES):
            way = (costs.insert + cost[NEXT[s][1]], INSERT)
            if way < (cost[s], edit[s][0]):
                cost[s], edit[s] = way
    # Chains of inserted turns end with the edit that takes the turn.
    for s in range(STATES):
        t, chain = s, ""
        while edit[t] == INSERT and len(chain) < STATES:
            chain, t = chain + INSERT, NEXT[t][1]
        edit[s] = chain + edit[t] if chain else edit[s]
    return cost, [e if e[-1] != INSERT else "" for e in edit]


def _ending(costs: Costs) -> tuple[list[int], list[str]]:
    """By state, behind the last turn: what is still to be put in."""
    cost, edit = [], []
    for s in range(STATES):
        t, n = s, 0
        while t not in ENDS:
            t, n = NEXT[t][1], n + 1
        cost.append(n * costs.insert)
        edit.append(INSERT * n)
    return cost, edit


_PLANNED = "conv_id long, turn long, role string, text string, copy int, fault string, edits string"
_REPAIRED = "conv_id long, place long, edit string, turn long, was string, role string, text string, fault string, cost long"


def repaired(turns: DataFrame, costs: Costs = Costs()) -> DataFrame:  # noqa: B008
    """The edits of the cheapest repair, a row each: conv_id, place (from 0), edit, turn, was, role, text, fault, cost.

    edit: K keeps a turn, R gives it another role (user or assistant), D deletes it, I puts in an empty one (turn and was are
    null). was is the role before, role the one after; the repaired conversation are the rows but those with D, by place. What is
    blank or a duplicate must go; a truncated turn that stays costs extra. Roles end up as ``(s?(ua)+)?`` by
    their initials; of the cheapest lists of edits the first in ASCII counts. Order, faults, nulls and ties are those
    of :func:`with_faults`; a null conv_id is a conversation; empty texts are blank, long ones count in whole; an
    empty table gives an empty one; further columns are ignored. All rows of a conversation pass one task, in order.
    """
    insert_cost = costs.insert

    def plan(batches):
        now, after, last = object(), None, _ending(costs)[0]
        for batch in batches:
            out = []
            for conv, role, fault in zip(batch["conv_id"].to_pylist(), batch["role"].to_pylist(), batch["fault"].to_pylist(), strict=True):
                if conv != now:
                    now, after = conv, last
                after, edits = _ways(role[:1], fault, after, costs)
                out.append(",".join(edits))
            yield pa.record_batch([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, "edits"])

    def walk(batches):
        now, state, place = object(), START, 0
        ending = _ending(costs)[1]
        rows: list[tuple] = []

        def put_in() -> None:
            nonlocal state, place
            role, state = NEXT[state]
            rows.append((now, place, INSERT, None, None, role, "", None, insert_cost))
            place += 1

        def close() -> None:
            for _ in ending[state]:
                put_in()

        def flushed() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) or [()] * 9
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), *[pa.string()] * 4, pa.int64()]
            return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names="conv_id place edit turn was role text fault cost".split())

        begun = False
        for batch in batches:
            rows = []
            for conv, turn, role, text, _, fault, edits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not begun or conv != now:
                    if begun:
                        close()
                    now, state, place, begun = conv, START, 0, True
                way = edits.split(",")[state]
                for _ in way[:-1]:
                    put_in()
                edit, became, cost = way[-1], role, 0
                if edit == DELETE:
                    cost = costs.delete
                else:
                    cost = (costs.keep if edit == KEEP else costs.rerole) + (costs.truncated if fault == "truncated" else 0)
                    if edit == KEEP:
                        state = KEPT[state][role[:1]]
                    else:
                        became, state = NEXT[state]
                rows.append((now, place, edit, turn, role, became, text, fault, cost))
                place += 1
            yield flushed()
        if begun:
            rows = []
            close()
            yield flushed()

    back = with_faults(turns).sortWithinPartitions("conv_id", F.desc_nulls_last("turn"), F.desc("role"), F.desc("text"), F.desc("copy"))
    planned = back.select("conv_id", "turn", "role", "text", "copy", "fault").mapInArrow(plan, _PLANNED)
    # Conversations are still whole in their partitions: sorted the other way, without a second shuffle.
    there = planned.sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text", "copy")
    return there.mapInArrow(walk, _REPAIRED)


_DIGEST = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def repair_digest(edits: DataFrame) -> DataFrame:
    """A row for each conversation of :func:`repaired`: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    gaps: numbers between the least and the greatest turn that no turn has. illegal: neighbours, before the repair,
    whose roles may not follow one another. audit: the edits, in order. The digest is that of the repaired turns as
    ``role:text``, joined by line feeds. Rows are read in order, whatever partitions they come in.
    """

    def run(batches):
        now, out = None, []

        class Digest:
            def __init__(self, conv):
                self.conv, self.turns, self.low, self.high, self.was, self.n = conv, 0, None, None, None, dict.fromkeys(("blank", "duplicate", "truncated"), 0)
                self.illegal = self.cost = 0
                self.audit, self.said, self.any = [], hashlib.sha256(), False

            def read(self, edit, turn, was, role, text, fault, cost):
                self.audit.append(edit)
                self.cost += cost
                if edit != INSERT:
                    if fault:
                        self.n[fault] += 1
                    if self.was is not None and self.was + was[:1] not in LEGAL:
                        self.illegal += 1
                    self.was = was[:1]
                    if turn is not None:
                        if turn != self.high:
                            self.turns += 1
                        self.low, self.high = turn if self.low is None else self.low, turn
                if edit != DELETE:
                    self.said.update(("\n" if self.any else "").encode() + f"{role}:{text}".encode())
                    self.any = True

            def row(self):
                gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
                return (self.conv, gaps, *self.n.values(), self.illegal, self.cost, "".join(self.audit), self.said.hexdigest())

        def flushed() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [()] * 9
            return pa.record_batch([pa.array(c, k) for c, k in zip(cols, [pa.int64()] * 7 + [pa.string()] * 2, strict=True)], names=[x.split()[0] for x in _DIGEST.split(", ")])

        for batch in batches:
            out = []
            for conv, edit, turn, was, role, text, fault, cost in zip(*(batch[c].to_pylist() for c in ("conv_id", "edit", "turn", "was", "role", "text", "fault", "cost")), strict=True):
                if now is None or conv != now.conv:
                    if now is not None:
                        out.append(now.row())
                    now = Digest(conv)
                now.read(edit, turn, was, role, text, fault, cost)
            yield flushed()
        if now is not None:
            out = [now.row()]
            yield flushed()

    return edits.repartition("conv_id").sortWithinPartitions("conv_id", "place").mapInArrow(run, _DIGEST)


def repair_report(turns: DataFrame) -> DataFrame:
    """The digests of all conversations of ``turns`` after damage and repair; those without a turn left have zeros, no edits and the digest of nothing."""
    found = repair_digest(repaired(damaged(turns))).withColumnRenamed("conv_id", "known")
    every = turns.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    out = every.join(found, F.col("conv_id").eqNullSafe(F.col("known")), "left")
    numbers = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
