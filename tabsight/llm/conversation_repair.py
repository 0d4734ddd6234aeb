"""Conversation structure repair as a lightest derivation (Knuth's agenda).

The role initials of a repaired conversation have the form ``(s?(ua)+)?``. Items are (place, state of the form's automaton):
"the rows from here on can be brought to an end from this state". They are deduced from the end towards the beginning; a deduction
adds an edit's cost and writes its letter before the audit of what follows:

* Keep 0 (a row whose initial the state allows), Rerole to user or assistant 2, Delete 3, Insert an empty user or assistant turn 2;
  a kept or reroled truncated row costs 1 more; blank and duplicate rows can only be deleted.

The agenda pops items by (cost, nearness to the end, audit). Cost never falls along a deduction, and the only free one, Keep,
moves towards the beginning, so an item that is popped is final: its functions are superior in Knuth's sense. From one state
only one of user and assistant can follow, so two deductions of an item differ in their first letter, and the letter decides
between equal costs. The agenda ends when the goal (first place, first state) is popped.

Scale: rows are placed by sampled ranges of (conversation, turn), not by conversation. A conversation is cut into blocks of
``BLOCK`` rows; each block becomes a string of one letter per row, and an agenda for every state at its end gives (cost, audit)
for every state at its beginning. An insertion belongs to the block whose row it stands before, so audits of one block are never
prefixes of one another and their order decides ties. What is left per conversation is a chain of four by four tables,
one per block, and the same deductions over it. Rows are kept or changed by a join on (conversation, place). Only the
final hash passes a conversation's lines through one task, one by one, since it is sequential.

Defined cases: null role or text is one space, as is a null turn in the damage's key; null turns come first, equal turns are ordered by
fingerprint, so that the two copies of a repeated row stay together; a role without characters has no initial and can't be kept; rows without
a conv_id belong to no conversation and are left out; very long texts are compared by a 128-bit fingerprint; an empty table gives
an empty table. Other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsight.llm._order import positions, sha256_in_order
from tabsight.llm._text import written

#: Rows of a conversation that one agenda works on.
BLOCK = 256
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1

#: States of the form: nothing yet, after a system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = (START, SYSTEM, USER, ASSISTANT)
STEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: What can be written from a state: the one of user and assistant that the form allows next.
WRITES = {START: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
ROLES = {"u": "user", "a": "assistant"}
#: Cheapest end of a conversation from each state, by insertions alone.
CLOSE = {START: (0, ""), SYSTEM: (2 * INSERT, "II"), USER: (INSERT, "I"), ASSISTANT: (0, "")}
_BEFORE = {q: [p for p in STATES if STEP[p, WRITES[p]] == q] for q in STATES}
_KEPT_BEFORE = {(q, c): [p for p in STATES if STEP.get((p, c)) == q] for q in STATES for c in "sua"}


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage that crc32(``conv_id:turn``) picks."""
    text, turn = F.coalesce("text", F.lit(" ")), F.col("turn").cast("string")
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"),
        (F.crc32(F.concat(F.col("conv_id").cast("bigint").cast("string"), F.lit(":"), F.coalesce(turn, F.lit(" "))).cast("binary")) % 20).alias("harm"))
    rows = rows.where("harm != 0").withColumns({
        "text": F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")),
        "role": F.when(F.col("harm") == 4, "user").otherwise(F.col("role"))})
    return rows.withColumn("copy", F.explode(F.when(F.col("harm") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("harm")


def placed_rows(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows after damage with their place in the conversation and first fault, written; and their ranges."""
    rows = damaged(conversations).withColumns({"f1": F.xxhash64(F.lit(1), "role", "text"), "f2": F.xxhash64(F.lit(2), "role", "text")})
    ranged, parts = positions(rows, "conv_id", [F.col("turn").asc_nulls_first(), F.col("f1"), F.col("f2"), F.col("copy")], "repair-rows")
    return ranged.join(parts, ["conv_id", "part"]).select("conv_id", "turn", "role", "text", "f1", "f2", (F.col("at") - F.col("first_at") + F.col("before")).alias("pos")), parts


def with_faults(rows: DataFrame) -> DataFrame:
    """conv_id, turn, pos, initial and ``fault`` (blank, duplicate, truncated or null), without the texts."""
    initial = F.substring("role", 1, 1)
    last = F.substring(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), -1, 1)
    own = rows.select("conv_id", "turn", "pos", "f1", "f2", initial.alias("initial"), last.alias("last"))
    first = own.groupBy("conv_id", "f1", "f2").agg(F.min("pos").alias("pos")).select("conv_id", "pos", F.lit(True).alias("is_first"))
    fault = F.when(F.col("last") == "", "blank").when(F.col("is_first").isNull(), "duplicate").when(~F.col("last").isin(".", "!", "?"), "truncated")
    return own.join(first, ["conv_id", "pos"], "left").select("conv_id", "turn", "pos", "initial", fault.alias("fault"))


def _code(initial: Column, fault: Column) -> Column:
    """One letter per row: s, u, a or x for its initial, in upper case if truncated, d if it can only be deleted."""
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    return F.when(fault.isin("blank", "duplicate"), "d").when(fault == "truncated", F.upper(known)).otherwise(known)


def agenda(codes: str, end: int) -> dict[int, tuple[int, str]]:
    """Lightest derivations (cost, audit) of a block of rows that ends in state ``end``, by the state that it begins in.

    Items (place, state) are popped by (cost, nearness to the end, audit); one that is popped is final.
    """
    n = len(codes)
    final: dict[tuple[int, int], tuple[int, str, tuple[int, int] | None]] = {}
    queue: list[tuple[int, int, str, int, tuple[int, int] | None]] = [(0, -n, "", end, None)]
    found = 0
    while queue and found < len(STATES):
        cost, place, letter, state, on = heapq.heappop(queue)
        i = -place
        if (i, state) in final:
            continue
        final[i, state] = (cost, letter, on)
        if i == 0:
            found += 1
        if i < n:  # an insertion before row i
            for p in _BEFORE[state]:
                if (i, p) not in final:
                    heapq.heappush(queue, (cost + INSERT, place, "I", p, (i, state)))
        if i > 0:
            code = codes[i - 1]
            heapq.heappush(queue, (cost + DELETE, place + 1, "D", state, (i, state)))
            if code != "d":
                more = TRUNCATED if code.isupper() else 0
                for p in _KEPT_BEFORE.get((state, code.lower()), ()):
                    heapq.heappush(queue, (cost + KEEP + more, place + 1, "K", p, (i, state)))
                for p in _BEFORE[state]:
                    heapq.heappush(queue, (cost + REROLE + more, place + 1, "R", p, (i, state)))
    out = {}
    for p in STATES:
        if (0, p) in final:
            cost, letters, at = final[0, p][0], [], (0, p)
            while at is not None:
                _, letter, at = final[at]
                letters.append(letter)
            out[p] = (cost, "".join(letters))
    return out


def derive(tables: list[list[tuple[int, int, int]]]) -> tuple[int, list[tuple[int, int]]]:
    """The goal's cost and, for every block, the states at its beginning and end.

    ``tables``: of each block, in order, (cost, order of the audit, end state) for every state at its beginning.
    """
    best = {q: CLOSE[q][0] for q in STATES}
    choice: list[dict[int, int]] = []
    for table in reversed(tables):
        now, pick = {}, {}
        for p in STATES:
            cost, _, q = min((cost + best[q], order, q) for cost, order, q in table[p] if q in best)
            now[p], pick[p] = cost, q
        best = now
        choice.append(pick)
    path, state = [], START
    for pick in reversed(choice):
        path.append((state, pick[state]))
        state = pick[state]
    return best[START], path


def steps(audit: str, n: int, codes: str, state: int) -> list[tuple[int, str, list[str]]]:
    """(row, role or null if kept or empty if deleted, roles inserted before it) of a block's audit; rows after the last are closings."""
    out: list[tuple[int, str | None, list[str]]] = []
    inserted: list[str] = []
    i = 0
    for letter in audit:
        if letter == "I":
            inserted.append(ROLES[WRITES[state]])
            state = STEP[state, WRITES[state]]
            continue
        role: str | None = ""
        if letter == "K":
            role, state = None, STEP[state, codes[i].lower()]
        elif letter == "R":
            role = ROLES[WRITES[state]]
            state = STEP[state, WRITES[state]]
        out.append((i, role, inserted))
        inserted, i = [], i + 1
    if inserted:
        out.append((n, "", inserted))
    return out


_OPTION = pa.struct([("cost", pa.int64()), ("audit", pa.string()), ("end", pa.int32())])
_SOLVED = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("codes", pa.string()), ("options", pa.list_(pa.list_(_OPTION)))])
_SOLVED_DDL = "conv_id bigint, block bigint, codes string, options array<array<struct<cost:bigint,audit:string,end:int>>>"


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memory: dict[str, list] = {}  # blocks of a few rows repeat
    for b in batches:
        rows = []
        for conv, block, codes in zip(*(c.to_pylist() for c in b.columns), strict=True):
            found = memory.get(codes)
            if found is None:
                ends = {q: agenda(codes, q) for q in STATES}
                found = [sorted(({"cost": ends[q][p][0], "audit": ends[q][p][1], "end": q} for q in STATES if p in ends[q]), key=lambda o: o["audit"]) for p in STATES]
                if len(codes) <= 16 and len(memory) < 50_000:
                    memory[codes] = found
            rows.append({"conv_id": conv, "block": block, "codes": codes, "options": found})
        yield pa.RecordBatch.from_pylist(rows, schema=_SOLVED)


_PATH = pa.schema([("conv_id", pa.int64()), ("cost", pa.int64()), ("path", pa.list_(pa.struct([("block", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("last", pa.bool_())])))])


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for conv, tables in zip(*(c.to_pylist() for c in b.columns), strict=True):
            cost, path = derive([[[(o["cost"], k, o["end"]) for k, o in enumerate(options)] for options in t["options"]] for t in tables])
            rows.append({"conv_id": conv, "cost": cost, "path": [
                {"block": t["block"], "start": p, "end": q, "last": t is tables[-1]} for t, (p, q) in zip(tables, path, strict=True)]})
        yield pa.RecordBatch.from_pylist(rows, schema=_PATH)


_EDITED = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("audit", pa.string()), ("edits", pa.list_(pa.struct([("row", pa.int64()), ("role", pa.string()), ("inserted", pa.list_(pa.string()))])))])


def _edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for conv, block, codes, audit, start, end, last in zip(*(c.to_pylist() for c in b.columns), strict=True):
            whole = audit + CLOSE[end][1] if last else audit
            rows.append({"conv_id": conv, "block": block, "audit": whole, "edits": [
                {"row": i, "role": role, "inserted": before} for i, role, before in steps(whole, len(codes), codes, start)]})
        yield pa.RecordBatch.from_pylist(rows, schema=_EDITED)


def edits(faults: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(conv_id, cost, audit) of every conversation with rows, and (conv_id, pos, role, inserted) of its rows: role null if kept, empty if deleted."""
    coded = faults.select("conv_id", F.floor(F.col("pos") / block).alias("block"), "pos", _code(F.col("initial"), F.col("fault")).alias("code"))
    blocks = coded.groupBy("conv_id", "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "code"))), lambda x: x["code"]), "").alias("codes"))
    solved = written(blocks.mapInArrow(_solve, _SOLVED_DDL), "repair-blocks")
    light = F.transform("options", lambda p: F.transform(p, lambda o: F.struct(o["cost"].alias("cost"), o["end"].alias("end"))))
    tables = solved.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("block", light.alias("options")))).alias("tables"))
    chained = written(tables.mapInArrow(_chain, "conv_id bigint, cost bigint, path array<struct<block:bigint,start:int,end:int,last:boolean>>"), "repair-paths")
    picked = chained.select("conv_id", F.explode("path").alias("p")).select("conv_id", "p.*").join(solved, ["conv_id", "block"])
    audit = F.element_at(F.filter(F.element_at("options", F.col("start") + 1), lambda o: o["end"] == F.col("end")), 1)["audit"]
    done = written(picked.select("conv_id", "block", "codes", audit.alias("audit"), "start", "end", "last").mapInArrow(
        _edit, "conv_id bigint, block bigint, audit string, edits array<struct<row:bigint,role:string,inserted:array<string>>>"), "repair-edits")
    audits = done.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "audit"))), lambda x: x["audit"]), "").alias("audit"))
    rows = done.select("conv_id", "block", F.explode("edits").alias("e")).select("conv_id", (F.col("block") * block + F.col("e.row")).alias("pos"), "e.role", "e.inserted")
    return chained.select("conv_id", "cost").join(audits, "conv_id"), rows


def repaired_lines(rows: DataFrame, edited: DataFrame) -> DataFrame:
    """conv_id, pos, role, text of the repaired conversations; inserted turns stand at (pos, nth) before their row."""
    meant = edited.withColumnRenamed("role", "new_role")
    own = meant.join(rows.select("conv_id", "pos", "role", "text"), ["conv_id", "pos"], "left")
    stays = F.when(F.col("new_role").isNull() | (F.col("new_role") != ""), F.array(F.struct(F.coalesce("new_role", "role").alias("role"), F.col("text").alias("text"))))
    empty = F.transform("inserted", lambda r: F.struct(r.alias("role"), F.lit("").alias("text")))
    return own.select("conv_id", "pos", F.posexplode(F.concat(empty, F.coalesce(stays, F.array().cast("array<struct<role:string,text:string>>")))).alias("nth", "t")).select(
        "conv_id", "pos", "nth", "t.role", "t.text")


def repair(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per conversation: gaps, faults, illegal neighbours, cost and audit of the cheapest repair and the hash of its lines."""
    rows, _ = placed_rows(conversations)
    faults = written(with_faults(rows), "repair-faults")

    def of(kind: str) -> Column:
        return F.sum((F.coalesce(F.col("fault"), F.lit("")) == kind).cast("bigint")).alias(kind)
    spans = faults.groupBy("conv_id", "turn").agg(of("blank"), of("duplicate"), of("truncated")).groupBy("conv_id").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"), *[F.sum(k).alias(k) for k in ("blank", "duplicate", "truncated")])
    # neighbours: a row beside the next place's initial; blocks overlap by one row, so no window is a whole conversation
    pair = faults.select("conv_id", F.floor(F.col("pos") / block).alias("b"), "pos", "initial").unionByName(
        faults.where((F.col("pos") % block == 0) & (F.col("pos") > 0)).select("conv_id", (F.floor(F.col("pos") / block) - 1).alias("b"), "pos", "initial"))
    before = F.lag("initial").over(Window.partitionBy("conv_id", "b").orderBy("pos"))
    illegal = pair.withColumn("before", before).where(F.col("before").isNotNull() & ~F.concat("before", "initial").isin("su", "ua", "au")).groupBy("conv_id").agg(F.count(F.lit(1)).alias("illegal"))
    found, edited = edits(faults, block)
    lines = repaired_lines(rows, edited).select("conv_id", F.struct("pos", "nth").alias("place"), F.concat_ws(":", "role", "text").alias("line"))
    hashed = sha256_in_order(lines, "conv_id", "place", "line", "\n")
    ids = conversations.where("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
    zero = F.lit(0).cast("bigint")
    out = ids.join(spans, "conv_id", "left").join(illegal, "conv_id", "left").join(found, "conv_id", "left").join(hashed, "conv_id", "left")
    return out.select("conv_id", *[F.coalesce(c, zero).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                      F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
