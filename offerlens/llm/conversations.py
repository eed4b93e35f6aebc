"""Repair of the turn structure of conversations by Hirschberg's divide and conquer.

A conversation is legal when its roles read ``(s?(ua)+)?`` by their initials. After any prefix it is in one of four states
(start, after s, after u, after a), so the edits up to a row are known by four costs. A path of edits is cut in the middle: the
costs forward from its start and backward from its end meet there, the crossing is the state of least total cost, and the two
halves are solved alike, so that no table of all rows and states is kept. Of crossings of equal cost the one whose edits so far
spell the least string is taken; the forward pass carries the order of the four strings, not the strings. As every row
ends its edits with K, R or D, none of these strings begins another.

Rows that are equal in conversation, turn, role and text are counted, not repeated. The rest is dealt out by ranges of
(conversation, turn, role, text), so a conversation of any length lies in several tasks. Each task turns its stretch of it,
SEGMENT rows at a time, into the 4 x 4 costs and orders between states. Only these come together to choose where the
path crosses from segment to segment; then every segment is solved by itself. The digest of a conversation reads its rows
one after another in order, and keeps none of them.

Order: turn (nulls first), then role, then the MD5 of the text. Null roles and texts are one blank. Null conversation ids form
one conversation. A blank row counts as blank only, a repeated one as duplicate only. Other columns are ignored.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from offerlens.llm.scratch import Scratch

SEGMENT = 2_048
SPACES = " \t\n\x0b\x0c\r"
START, S, U, A = range(4)
AFTER_INSERT = {START: U, S: U, U: A, A: U}
ROLE = {U: "user", A: "assistant"}
KEEPS = {("s", START): S, ("u", START): U, ("u", S): U, ("u", A): U, ("a", U): A}
LEGAL = ("su", "ua", "au")
REROLE, DELETE, INSERT, CUT_OFF = 2, 3, 2, 1
#: What must still be inserted at the end.
TAIL = {START: "", S: "II", U: "I", A: ""}
NEVER = 1 << 60


@lru_cache(maxsize=None)
def moves(initial: str, fault: str, more: int = 0) -> tuple:
    """For every state before a row: the (state after, cost, edits) that can be best. ``more`` equal rows follow and go."""
    out = []
    for p in range(4):
        best = {p: (DELETE, "D")}
        q, inserted = p, 0
        while inserted <= 2 and fault not in ("blank", "duplicate"):
            extra = CUT_OFF * (fault == "truncated") + INSERT * inserted
            for to, cost, edit in ((KEEPS.get((initial, q)), 0, "K"), (AFTER_INSERT[q], REROLE, "R")):
                if to is not None:
                    found = (cost + extra, "I" * inserted + edit)
                    best[to] = min(best.get(to, found), found)
            q, inserted = AFTER_INSERT[q], inserted + 1
        out.append(tuple((q, cost + DELETE * more, edits) for q, (cost, edits) in best.items()))
    return tuple(out)


def forward(steps, lo: int, hi: int, start: int) -> tuple[list[int], list[int]]:
    """Costs of the four states after steps lo to hi from ``start``, and the order of their least strings of edits."""
    cost, rank = [NEVER] * 4, [0] * 4
    cost[start] = 0
    for i in range(lo, hi):
        best = [(NEVER, 0, "")] * 4
        for p, to in enumerate(steps[i]):
            if cost[p] < NEVER:
                for q, c, edits in to:
                    found = (cost[p] + c, rank[p], edits)
                    if best[q][0] == NEVER or found < best[q]:
                        best[q] = found
        cost = [b[0] for b in best]
        reached = sorted((best[q][1:], q) for q in range(4) if cost[q] < NEVER)
        for place, (_, q) in enumerate(reached):
            rank[q] = place
    return cost, rank


def backward(steps, lo: int, hi: int, end: list[int]) -> list[int]:
    """Costs of getting from each state before step lo to the end behind step hi - 1."""
    cost = end
    for i in range(hi - 1, lo - 1, -1):
        cost = [min((c + cost[q] for q, c, _ in to), default=NEVER) for to in steps[i]]
    return cost


def crossings(steps, start: int, end: list[int]) -> list[int]:
    """State before every step and after the last one, on the least of the cheapest paths from ``start``."""
    states = [start] * (len(steps) + 1)

    def crossed(at: int, lo: int, p: int, after: list[int]) -> int:
        cost, rank = forward(steps, lo, at, p)
        return min((cost[q] + after[q], rank[q], q) for q in range(4) if cost[q] < NEVER)[2]

    states[-1] = crossed(len(steps), 0, start, end)
    todo = [(0, len(steps))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo > 1:
            mid = (lo + hi) // 2
            only = [NEVER] * 4
            only[states[hi]] = 0
            states[mid] = crossed(mid, lo, states[lo], backward(steps, mid, hi, only))
            todo += [(lo, mid), (mid, hi)]
    return states


def edits_of(rows: list[dict], start: int, end: int | None) -> list[dict]:
    """The edit of every row of a segment: roles inserted before and after, K, R or D, and the role then."""
    steps = [moves(r["initial"], r["fault"], r["copies"] - 1) for r in rows]
    last = [len(TAIL[q]) * INSERT for q in range(4)] if end is None else [0 if q == end else NEVER for q in range(4)]
    states = crossings(steps, start, last)
    out = []
    for i, r in enumerate(rows):
        p, q = states[i], states[i + 1]
        letters = next(x for to, _, x in steps[i][p] if to == q)
        before = []
        for _ in letters[:-1]:
            p = AFTER_INSERT[p]
            before.append(ROLE[p])
        after = []
        if end is None and i == len(rows) - 1:
            for _ in TAIL[q]:
                q = AFTER_INSERT[q]
                after.append(ROLE[q])
        edit = letters[-1]
        out.append({"before": before, "edit": edit, "role_then": {"K": r["role"], "R": ROLE.get(states[i + 1])}.get(edit), "after": after})
    return out


def turns_of(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, turn, role, text) with blanks for nulls."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return conversations.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), said(role_col).alias("role"), said(text_col).alias("text"))


def _rows(turns: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(each distinct row with its fault, the same rows with their texts)."""
    key = ["conv", "turn", "role", "key"]
    ended = F.rtrim(F.col("text"), F.lit(SPACES))
    whole = scratch.keep(
        turns.withColumn("key", F.md5(F.col("text").cast("binary"))).groupBy(*key).agg(F.count("*").alias("copies"), F.first("text").alias("text"))
        .withColumns({"blank": ended == "", "cut_off": ~F.right(ended, F.lit(1)).isin(".", "!", "?")}))
    rows = whole.drop("text")
    # written, so that both sides of the join are dealt out and a text said very often is split
    first = scratch.keep(rows.where(~F.col("blank")).groupBy("conv", "role", "key").agg(F.min(F.struct("turn")).alias("first_said")))
    first = first.select(F.col("conv").alias("_conv"), F.col("role").alias("_role"), F.col("key").alias("_key"), "first_said")
    faulty = rows.join(first, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("key") == F.col("_key")), "left")
    fault = (F.when(F.col("blank"), "blank").when(F.struct("turn") > F.col("first_said"), "duplicate")
             .when(F.col("cut_off"), "truncated").otherwise(""))
    return faulty.select(*key, "copies", fault.alias("fault")), whole.select(*key, "text")


ROW = "turn: bigint, role: string, key: string, copies: bigint, fault: string"


def _segments(rows: DataFrame) -> DataFrame:
    """Stretches of conversations in order, with the costs and orders between states where a stretch may not be alone."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, held = TaskContext.get().partitionId(), 0, []
        ready: list[dict] = []

        def close(conv, touches_edge: bool):
            nonlocal made, held
            between = []
            if touches_edge:
                steps = [moves(r["role"][:1], r["fault"], r["copies"] - 1) for r in held]
                for p in range(4):
                    between += [{"p": p, "q": q, "cost": c, "place": k} for q, (c, k) in enumerate(zip(*forward(steps, 0, len(steps), p), strict=True)) if c < NEVER]
            ready.append({"conv": conv, "part": task, "seq": made, "alone": not touches_edge, "rows": held, "between": between})
            made, held = made + 1, []

        def flush():
            rows = pa.Table.from_pylist(ready, schema=arrow)
            ready.clear()
            return rows.combine_chunks().to_batches()

        now, edge, arrow = None, True, None
        for batch in batches:
            if arrow is None:
                row = pa.struct([("turn", pa.int64()), ("role", pa.string()), ("key", pa.string()), ("copies", pa.int64()), ("fault", pa.string())])
                step = pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("place", pa.int32())])
                arrow = pa.schema([("conv", batch.schema.field("conv").type), ("part", pa.int32()), ("seq", pa.int64()), ("alone", pa.bool_()),
                                   ("rows", pa.list_(row)), ("between", pa.list_(step))])
            for r in batch.to_pylist():
                conv = r.pop("conv")
                if held and conv != now:
                    close(now, edge)
                    edge = False
                elif len(held) == SEGMENT:
                    close(now, True)
                    edge = True  # what follows is not alone either
                now = conv
                held.append(r)
            if len(ready) > 500:
                yield from flush()
        if held:
            close(now, True)  # the next task may go on with it
        if ready:
            yield from flush()

    order = ["conv", "turn", "role", "key"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    kind = rows.schema["conv"].dataType.simpleString()
    return dealt.mapInArrow(cut, f"conv {kind}, part int, seq long, alone boolean, rows array<struct<{ROW}>>, "
                                 "between array<struct<p: int, q: int, cost: bigint, place: int>>")


def _chosen(table: pa.Table) -> pa.Table:
    """Where a conversation's path enters and leaves each of its segments; the last is left at will."""
    parts = sorted(table.to_pylist(), key=lambda r: (r["part"], r["seq"]))
    steps = [[[(x["q"], x["cost"], x["place"]) for x in r["between"] if x["p"] == p] for p in range(4)] for r in parts]
    states = crossings(steps, START, [len(TAIL[q]) * INSERT for q in range(4)])
    ends = [*states[1:-1], None]
    return pa.table({"part": pa.array([r["part"] for r in parts], pa.int32()), "seq": pa.array([r["seq"] for r in parts], pa.int64()),
                     "start": pa.array(states[:-1], pa.int32()), "end": pa.array(ends, pa.int32())})


def repair(
    conversations: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """One row per distinct row of every conversation, in the order (conv, part, seq, place): turn, role, text, its copies
    and fault, the roles inserted ``before`` it, its edit (K, R, D; copies beyond the first are deleted), the role then, and
    the roles inserted ``after`` the last one. The text is null where it is deleted."""
    scratch = Scratch(conversations.sparkSession)
    rows, texts = _rows(turns_of(conversations, conv_col, turn_col, role_col, text_col), scratch)
    segments = scratch.keep(_segments(scratch.keep(rows)))
    chosen = segments.where(~F.col("alone")).select("conv", "part", "seq", "between").groupBy("conv").applyInArrow(
        lambda t: _chosen(t), "part int, seq long, start int, end int")
    bounded = segments.drop("between", "alone").join(chosen, ["part", "seq"], "left")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for s in batch.to_pylist():
                plain = [r | {"initial": r["role"][:1]} for r in s["rows"]]
                for i, (r, e) in enumerate(zip(s["rows"], edits_of(plain, s["start"] or START, s["end"]), strict=True)):
                    out.append({"conv": s["conv"], "part": s["part"], "seq": s["seq"], "place": i, **r, **e})
            schema = pa.schema([batch.schema.field("conv"), ("part", pa.int32()), ("seq", pa.int64()), ("place", pa.int32()), ("turn", pa.int64()),
                                ("role", pa.string()), ("key", pa.string()), ("copies", pa.int64()), ("fault", pa.string()),
                                ("before", pa.list_(pa.string())), ("edit", pa.string()), ("role_then", pa.string()), ("after", pa.list_(pa.string()))])
            yield from pa.Table.from_pylist(out, schema=schema).combine_chunks().to_batches()

    kind = rows.schema["conv"].dataType.simpleString()
    solved = scratch.keep(bounded.mapInArrow(
        solve, f"conv {kind}, part int, seq long, place int, {ROW.replace(':', '')}, before array<string>, edit string, role_then string, after array<string>"))
    held = texts.select(F.col("conv").alias("_conv"), F.col("turn").alias("_turn"), F.col("role").alias("_role"), F.col("key").alias("_key"), "text")
    same = F.lit(True)
    for c in ("conv", "turn", "role", "key"):
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return solved.join(held, same & (F.col("edit") != "D"), "left").drop("_conv", "_turn", "_role", "_key", "key")


NUMBERS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def digest(repaired: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation with rows."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, any_yet, ready = None, False, []
        n, turns, last_turn, initial, audit, sha, lines = {}, [], None, "", [], None, 0

        def begin():
            nonlocal n, turns, last_turn, initial, audit, sha, lines
            n, turns, last_turn, initial, audit, sha, lines = dict.fromkeys(NUMBERS, 0), [None, None, 0], None, None, [], hashlib.sha256(), 0

        def say(role, text=""):
            nonlocal lines
            sha.update((b"\n" if lines else b"") + f"{role}:{text}".encode())
            lines += 1

        def close():
            gaps = turns[1] - turns[0] + 1 - turns[2] if turns[2] else 0
            ready.append({"conv": now, **n, "gaps": gaps, "audit": "".join(audit), "repaired_sha256": sha.hexdigest()})

        def flush():
            schema = pa.schema([("conv", kind), *((c, pa.int64()) for c in NUMBERS), ("audit", pa.string()), ("repaired_sha256", pa.string())])
            out = pa.Table.from_pylist(ready, schema=schema).combine_chunks().to_batches()
            ready.clear()
            return out

        for batch in batches:
            kind = batch.schema.field("conv").type
            for r in batch.to_pylist():
                if not any_yet or r["conv"] != now:
                    if any_yet:
                        close()
                    now, any_yet = r["conv"], True
                    begin()
                if r["turn"] is not None and r["turn"] != last_turn:
                    turns[0] = r["turn"] if turns[0] is None else turns[0]
                    turns[1], turns[2], last_turn = r["turn"], turns[2] + 1, r["turn"]
                more = r["copies"] - 1
                if r["fault"]:
                    n[r["fault"]] += 1
                n["blank" if r["fault"] == "blank" else "duplicate"] += more
                first = r["role"][:1]
                n["illegal"] += more + (initial is not None and initial + first not in LEGAL)
                initial = first
                inserted = len(r["before"]) + len(r["after"])
                n["cost"] += (INSERT * inserted + DELETE * more + {"K": 0, "R": REROLE, "D": DELETE}[r["edit"]]
                              + CUT_OFF * (r["edit"] != "D" and r["fault"] == "truncated"))
                audit.append("I" * len(r["before"]) + r["edit"] + "D" * more + "I" * len(r["after"]))
                for role in r["before"]:
                    say(role)
                if r["edit"] != "D":
                    say(r["role_then"], r["text"])
                for role in r["after"]:
                    say(role)
            if len(ready) > 1000:
                yield from flush()
        if any_yet:
            close()
            yield from flush()

    kind_sql = repaired.schema["conv"].dataType.simpleString()
    ordered = repaired.repartition("conv").sortWithinPartitions("conv", "part", "seq", "place")
    return ordered.mapInArrow(read, f"conv {kind_sql}, {', '.join(f'{c} long' for c in NUMBERS)}, audit string, repaired_sha256 string")


def summarize(all_rows: DataFrame, digests: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """A row for every conversation of ``all_rows``; one that has no rows left gives zeros and the checksum of nothing."""
    ids = all_rows.select(F.col(conv_col).alias("_id")).distinct()
    found = ids.join(digests, F.col("_id").eqNullSafe(F.col("conv")), "left")
    return found.select(
        F.col("_id").alias(conv_col), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in NUMBERS], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


def damage(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Conversations with made faults, a test of repair: by the checksum of ``conv:turn`` modulo 20, a row is dropped (0),
    emptied (1), stripped of its ``.!?`` (2), repeated (3) or given to the user (4). Nulls are one blank."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    lot: Column = F.crc32(F.concat(said(conv_col), F.lit(":"), said(turn_col)).cast("binary")) % 20
    text = F.when(F.col("_lot") == 1, "").when(F.col("_lot") == 2, F.translate(said(text_col), ".!?", "")).otherwise(said(text_col))
    return (
        conversations.withColumn("_lot", lot).where("_lot != 0")
        .withColumns({role_col: F.when(F.col("_lot") == 4, "user").otherwise(said(role_col)), text_col: text,
                      "_time": F.explode(F.sequence(F.lit(1), F.when(F.col("_lot") == 3, 2).otherwise(1)))})
        .drop("_lot", "_time")
    )
