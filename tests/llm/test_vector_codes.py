import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from offerlens.llm import queries, vector_codes as V

TYPE = "vec_id long, embedding array<float>, label int"


def brute(rows, entries=256, rounds=4, parts=4):
    """Codes, errors, label sums and codebooks, by plain loops over whole numbers."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    longest = -(-max((len(r[1]) for r in kept), default=0) // parts) * parts
    ints = [[math.floor(1024 * float(np.float32(x))) for x in r[1]] + [0] * (longest - len(r[1])) for r in kept]
    n = longest // parts
    cut = [[v[p * n: (p + 1) * n] for p in range(parts)] for v in ints]
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, ints[i]))[:entries]
    book = [[list(cut[i][p]) for i in order] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [[min(range(len(book[p])), key=lambda e: (far(c[p], book[p][e]), e)) for p in range(parts)] for c in cut]
    for _ in range(rounds if kept else 0):
        codes = assign()
        for p in range(parts):
            for e in range(len(book[p])):
                mine = [c[p] for c, k in zip(cut, codes) if k[p] == e]
                if mine:
                    book[p][e] = [sum(col) // len(mine) for col in zip(*mine)]
    codes = assign()
    errors = [sum(far(c[p], book[p][k[p]]) for p in range(parts)) for c, k in zip(cut, codes)]
    sums = {}
    for r, e in zip(kept, errors):
        sums[r[2]] = sums.get(r[2], 0) + e
    flat = ",".join(str(x) for part in book for e in part for x in e)
    out = [(r[0], bytes(k).hex(), e, sums[r[2]]) for r, k, e in zip(kept, codes, errors)]
    return sorted(out, key=str), hashlib.sha256(flat.encode()).hexdigest()


def made(seed, n, dim, spread=1.0):
    rng = random.Random(seed)
    middles = [[rng.uniform(-spread, spread) for _ in range(dim)] for _ in range(12)]
    rows = []
    for i in range(n):
        m = rng.choice(middles)
        rows.append((i * 3, [x + rng.gauss(0, 0.05) for x in m], rng.choice([None, 1, 2, 3])))
    return rows


def got(spark, rows):
    df = spark.createDataFrame(rows, TYPE).repartition(3).withColumn("code", F.lit("clash")).withColumn("units", F.lit(1)).withColumn("c0", F.lit(2))
    out, book = V.quantize(df)
    assert out.columns == ["vec_id", "code", "error", "label_error"]
    return sorted(((r.vec_id, bytes(r.code).hex(), r.error, r.label_error) for r in out.collect()), key=str), V.codebooks_sha256(book)


@pytest.mark.parametrize("entries,n", [(256, 60), (16, 250), (1, 9)])
def test_against_brute_force(spark, monkeypatch, entries, n):
    monkeypatch.setattr(V, "ENTRIES", entries)
    rows = made(entries, n, 8)
    rows += [(7, None, 1), (8, [float("nan")] * 8, 1), (9, [None, *[0.0] * 7], 2), (10, [float("inf"), *[0.0] * 7], 3)]
    rows += [(None, [0.1] * 8, None), (1, [0.5] * 8, 9), (1, [0.5] * 8, 9), (1, [-0.5] * 8, 9), (4, [0.25] * 5, 2), (5, [], 2), (6, [0.0] * 8, 2)]
    rows += [(1000 + i, [0.125] * 8, 2) for i in range(40)]
    assert got(spark, rows) == brute(rows, entries)


def test_large_components(spark):
    rows = made(4, 40, 4, spread=90_000.0)
    assert got(spark, rows) == brute(rows)


def test_no_rows(spark):
    assert got(spark, []) == ([], hashlib.sha256(b"").hexdigest())
    assert got(spark, [(1, None, 1)])[0] == []


@pytest.mark.parametrize("b", [0, 1, 4, 32])
def test_bounds_lose_nothing(b):
    """From any bounds of the round before, the nearest entries are those of a comparison with all."""
    rng = np.random.default_rng(b)
    x = rng.integers(-40, 40, (500, 6))
    c = rng.integers(-40, 40, (60, 6))
    c[7] = c[3]  # a tie
    state = V.compare_all(x, c, b)
    for _ in range(6):
        before, c = c, c + rng.integers(-3, 4, c.shape) * (rng.random((60, 1)) < 0.3)
        moved = np.sqrt(((c - before) ** 2).sum(1)) * (1 + 1e-12)
        *state, used = V.compare_some(x, c, moved, b, *state)
        d = ((x[:, None] - c[None]) ** 2).sum(2)
        assert (state[0] == d.argmin(1)).all()
        near, lower, outer = state[1], state[2], state[3]
        assert (np.diff(lower, axis=1) >= 0).all()
        assert (lower <= np.sqrt(np.take_along_axis(d, near, 1))).all()
        d[np.arange(500), state[0]] = 1 << 40
        np.put_along_axis(d, near, 1 << 40, 1)
        assert (outer <= np.sqrt(d.min(1))).all()
    if b == 32:
        assert (used <= b).mean() > 0.5  # most need no comparison with all


def test_query(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    out = queries.QUERIES["op12_vector_codes"](spark, d).collect()
    want, sha = brute(rows)
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in out), key=str) == want
    assert {r.codebooks_sha256 for r in out} == {sha}
