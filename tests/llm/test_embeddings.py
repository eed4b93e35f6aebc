import math
import random

import numpy as np
import pytest

from offerlens.llm import embeddings
from tests.llm.conftest import closure


def brute(rows, least):
    ok = {}
    for n, (i, v, label) in enumerate(rows):
        if label is not None and i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            u = np.array(v, float) / np.abs(v).max()
            ok[n] = (i, label, u / np.linalg.norm(u))
    edges, links = [], {n: 0 for n in range(len(rows))}
    for n, (i, a, u) in ok.items():
        for m, (j, b, w) in ok.items():
            if n != m and a == b and len(u) == len(w) and u @ w >= least:
                links[n] += 1
                edges.append((i, j))
    return links, closure({r[0] for r in rows if r[0] is not None}, edges)


def make(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "'x' AS id", "1 AS dim", "2 AS rep", "3 AS kept")


@pytest.mark.parametrize(("tile", "least"), [(512, 0.98), (8, 0.98), (8, 0.9)])
def test_against_all_pairs(spark, monkeypatch, tile, least):
    monkeypatch.setattr(embeddings, "TILE", tile)
    monkeypatch.setattr(embeddings, "RUN", 4 * tile)
    rng = np.random.default_rng(4)
    rows, base = [], rng.normal(size=(12, 20))
    for i in range(150):
        v = base[i % 12] * rng.uniform(0.1, 9) + rng.normal(size=20) * rng.choice([0, 0.05, 0.1, 0.2, 3])
        rows.append((i, [float(x) for x in v], int(i % 5 // 2)))
    rows += [(200 + k, rows[3][1], 0) for k in range(40)]
    nan, inf = float("nan"), float("inf")
    rows += [(300, None, 1), (301, [0.0] * 20, 1), (302, [nan, *[1.0] * 19], 1), (303, [inf, *[1.0] * 19], 1), (304, [None, *[1.0] * 19], 1),
             (305, [], 1), (306, rows[4][1], None), (307, [1.0, 2.0, 3.0], 1), (308, [2.0, 4.0, 6.0], 1), (309, [2.0], 0), (310, [3.0], 0), (None, rows[4][1], 1),
             (311, [1e30, 1e30, 0.0], 1), (312, [1e-30, 1e-30, 0.0], 1)]
    random.Random(1).shuffle(rows)
    links, root = brute(rows, least)
    got = embeddings.near_duplicates(make(spark, rows), least=least).collect()
    assert len(got) == len(rows)
    want = {r[0]: links[n] for n, r in enumerate(rows)}
    for r in got:
        assert (r.n_links, r.component_id) == (want[r.vec_id], root.get(r.vec_id)), r
        assert r.kept == (r.vec_id == r.component_id)


def test_empty_table_and_bad_threshold(spark):
    assert embeddings.near_duplicates(make(spark, [])).count() == 0
    with pytest.raises(ValueError):
        embeddings.near_duplicates(make(spark, []), least=0.0)


def test_stops_early_and_finds_all():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(50, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = np.concatenate([x[:5], rng.normal(size=(30, 64))])
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    i, j = embeddings.linked(x, y, 0.98)
    assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == [(k, k) for k in range(5)]
    assert len(embeddings.linked(x[:10], y[20:], 0.98)[0]) == 0
