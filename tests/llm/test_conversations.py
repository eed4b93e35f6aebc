import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from offerlens.llm import conversations as C, queries

TYPE = "conv_id long, turn long, role string, text string"
SAID = re.compile(r"[^\x20\x09-\x0D]")
LEGAL = re.compile(r"(s?(ua)+)?")


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        s = lambda x: " " if x is None else str(x)
        lot = zlib.crc32(f"{s(conv)}:{s(turn)}".encode()) % 20
        role, text = s(role), s(text)
        if lot == 1:
            text = ""
        if lot == 2:
            text = re.sub("[.!?]", "", text)
        if lot == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(lot, 1)
    return out


def faults(turns):
    seen, out = set(), []
    for _, role, text in turns:
        found = SAID.findall(text)
        out.append("blank" if not found else "duplicate" if (role, text) in seen else "truncated" if found[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(turns, fault):
    """(cost, audit, repaired) by trying every edit at every row, best first by (cost, audit), over all of the string so far."""
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}
    full = {"u": "user", "a": "assistant"}
    paths = {"": (0, "", ())}  # last initial -> best

    def insert(paths):
        for _ in range(3):
            new = dict(paths)
            for last, (c, audit, done) in paths.items():
                for x in set(follow[last]) & set("ua"):
                    found = (c + 2, audit + "I", (*done, full[x] + ":"))
                    if x not in new or found < new[x]:
                        new[x] = found
            paths = new
        return paths

    for (_, role, text), f in zip(turns, fault, strict=True):
        new = {}

        def reach(last, found):
            if last not in new or found[:2] < new[last][:2]:
                new[last] = found
        for last, (c, audit, done) in insert(paths).items():
            reach(last, (c + 3, audit + "D", done))
            if f not in ("blank", "duplicate"):
                more = f == "truncated"
                if role[:1] and role[:1] in follow[last]:
                    reach(role[0], (c + more, audit + "K", (*done, f"{role}:{text}")))
                for x in set(follow[last]) & set("ua"):
                    reach(x, (c + 2 + more, audit + "R", (*done, f"{full[x]}:{text}")))
        paths = new
    return min(p for last, p in insert(paths).items() if last in ("", "a"))


def brute(rows, all_rows=None):
    out = []
    for conv in {r[0] for r in (all_rows or rows)}:
        mine = sorted((r[1:] for r in rows if r[0] == conv),
                      key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).hexdigest()))
        f = faults(mine)
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(mine, mine[1:])]
        cost, audit, done = cheapest(mine, f)
        known = [r[0] for r in mine if r[0] is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        text = "\n".join(done)
        assert LEGAL.fullmatch("".join(x[:1] for x in done))
        out.append((conv, gaps, f.count("blank"), f.count("duplicate"), f.count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs),
                    cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def made(seed, convs, longest):
    rng = random.Random(seed)
    rows = []
    for conv in range(convs):
        turn = 0
        for i in range(rng.randint(1, longest)):
            turn += rng.choice([1, 1, 1, 1, 3])
            role = rng.choice(["system"] if i == 0 and rng.random() < 0.4 else ["user", "assistant"] * 3 + ["tool", "u", None, "", "System"])
            text = rng.choice(["Hello.", "same thing!", "", None, " \t\n", "cut off", "done? ", "words and words", f"turn {turn}.", f"of {conv}", "é.…"])
            rows.append((conv if conv % 7 else None, rng.choice([turn, turn, turn, None]), role, text))
    return rows


@pytest.mark.parametrize("segment,parts", [(2048, 4), (3, 7), (1, 3)])
def test_against_brute_force(spark, monkeypatch, segment, parts):
    monkeypatch.setattr(C, "SEGMENT", segment)
    rows = made(segment, 60, 14) + [(900, i, "user", "again and again.") for i in range(12)] + [(901, 5, "user", "x.")] * 9
    rows += [(902, i, r, f"{i}.") for i, r in enumerate("ua" * 40)] + [(903, 1, "assistant", "a.")]
    df = spark.createDataFrame(rows, TYPE).withColumns({c: F.lit("clash") for c in ("conv", "key", "fault", "copies", "_lot", "part")})
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = C.summarize(df, C.digest(C.repair(C.damage(df))))
        got = sorted((tuple(r) for r in out.collect()), key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == brute(damaged(rows), rows)


def test_long_conversation_is_cut(spark, monkeypatch):
    """One conversation over many tasks gives what it gives in one."""
    rows = [(1, i, "user" if i % 3 else "assistant", f"text {i % 50}" + ("." if i % 4 else "")) for i in range(3000)]
    monkeypatch.setattr(C, "SEGMENT", 100)
    df = spark.createDataFrame(rows, TYPE).repartition(5)
    repaired = C.repair(df)
    assert repaired.select("part", "seq").distinct().count() > 20
    got = C.digest(repaired).collect()
    assert [tuple(r) for r in got] == brute(rows)


def test_middle_crossings_need_no_table():
    """Divide and conquer against the plain recurrence, for every start and end."""
    rng = random.Random(1)
    for _ in range(300):
        rows = [{"initial": rng.choice("suax"), "role": "r", "fault": rng.choice(["", "", "truncated", "blank"]), "copies": rng.choice([1, 1, 3])}
                for _ in range(rng.randint(1, 9))]
        steps = [C.moves(r["initial"], r["fault"], r["copies"] - 1) for r in rows]
        for p in range(4):
            best = {p: (0, "")}
            for step in steps:
                new = {}
                for at, (c, audit) in best.items():
                    for q, more, edits in step[at]:
                        new[q] = min(new.get(q, (1 << 60, "")), (c + more, audit + edits))
                best = new
            for end, (cost, audit) in best.items():
                states = C.crossings(steps, p, [0 if q == end else C.NEVER for q in range(4)])
                path = [next((c, x) for q, c, x in steps[i][a] if q == b) for i, (a, b) in enumerate(zip(states, states[1:]))]
                assert (sum(c for c, _ in path), "".join(x for _, x in path)) == (cost, audit)


def test_empty_table(spark):
    df = spark.createDataFrame([], TYPE)
    assert C.summarize(df, C.digest(C.repair(df))).count() == 0


def test_query(spark):
    d = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = sorted((tuple(r) for r in queries.QUERIES["op13_conversations"](spark, d).collect()), key=str)
    assert got == brute(damaged(rows), rows)
