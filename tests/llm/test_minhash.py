import random

import numpy as np
import pytest

from offerlens.llm import minhash
from tests.llm.conftest import closure, shingles


def corpus(seed, n_base=25, copies=6):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(n_base):
        base = [rng.choice(vocab) for _ in range(rng.randint(1, 120))]
        for _ in range(rng.randint(1, copies)):
            t = list(base)
            for _ in range(rng.randint(0, max(1, len(t) // 20))):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            texts.append(" ".join(t))
    return texts


def expected(rows, k, percent):
    sets, edges = {}, []
    for i, t in rows:
        if i is not None:
            sets.setdefault(i, []).append(shingles(t, k))
    flat = [(i, s) for i, group in sets.items() for s in group if s]
    for x, (a, s) in enumerate(flat):
        for b, t in flat[:x]:
            if a != b and 100 * len(s & t) >= percent * len(s | t):
                edges.append((a, b))
    return closure(sets, edges)


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_against_all_pairs(spark, documents, k, percent):
    rows = list(enumerate(corpus(k)))
    rows += [(1000, None), (1001, ""), (1002, " \n "), (1003, "Same TEXT"), (1004, "same text"), (1005, "one"), (1006, "ONE"),
             (1003, "Same TEXT"), (1007, rows[0][1]), (1007, rows[9][1]), (None, rows[0][1]), (None, None),
             (1008, "long " * 30000 + "tail"), (1009, "LONG " * 29999 + "long tail")]
    got = minhash.near_duplicates(documents(rows), shingle=k, percent=percent).collect()
    assert len(got) == len(rows)
    want = expected(rows, k, percent)
    for r in got:
        assert r.component_id == (want[r.id] if r.id is not None else None)
        assert r.kept == (r.id == r.component_id)
    assert sorted(r.n_shingles for r in got) == sorted(len(shingles(t, k)) for _, t in rows)


def test_groups_that_one_hub_does_not_join(spark, documents):
    """A chain of near texts: neighbours are near, the ends are not."""
    base = [f"c{i}" for i in range(100)]
    rows = []
    for i in range(30):
        t = list(base)
        t[: i * 3] = [f"d{j}" for j in range(i * 3)]
        rows.append((i, " ".join(t)))
    got = {r.id: r.component_id for r in minhash.near_duplicates(documents(rows), shingle=3, percent=85).collect()}
    assert got == expected(rows, 3, 85)


def test_an_id_with_a_text_that_another_id_represents(spark, documents):
    a = [f"a{i}" for i in range(100)]
    rows = [(10, " ".join(a)), (10, " ".join(f"c{i}" for i in range(300))), (5, " ".join(f"c{i}" for i in range(300))),
            (20, " ".join([*a[:-1], "other"]))]
    got = {r.id: r.component_id for r in minhash.near_duplicates(documents(rows), shingle=3, percent=85).collect()}
    assert got == expected(rows, 3, 85) == {5: 5, 10: 5, 20: 5}


def test_large_group_of_near_copies(spark, documents):
    rng, base = random.Random(1), [f"g{i}" for i in range(200)]
    rows = []
    for i in range(600):
        t = list(base)
        t[rng.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(t)))
    got = minhash.near_duplicates(documents(rows), shingle=3).collect()
    assert {r.component_id for r in got} == {0} and sum(r.kept for r in got) == 1


def test_empty_table(spark, documents):
    assert minhash.near_duplicates(documents([])).count() == 0


def test_low_threshold_is_refused(spark, documents):
    with pytest.raises(ValueError):
        minhash.near_duplicates(documents([]), percent=50)


def test_every_coordinate_fills_and_estimates_similarity():
    rng = np.random.default_rng(3)
    small = minhash.sketches(np.zeros(1, int), np.array([5], np.uint64), 1)
    assert (small != minhash._EMPTY).all()
    shared, a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (800, 100, 100))
    row = np.repeat([0, 1], 900)
    s = minhash.sketches(row, np.r_[shared, a, shared, b], 2)
    assert abs((s[0] == s[1]).mean() - 0.8) < 0.15


def test_repeated_rows_cost_no_pairs(spark, documents):
    """Two near copies, each many times over: with a pair per pair of rows this takes minutes."""
    import time

    base = [f"w{i}" for i in range(300)]
    near = [*base[:-1], "other"]
    rows = [(1, " ".join(base))] * 2500 + [(2, " ".join(near))] * 2500 + [(3, "quite another text")]
    start = time.time()
    got = minhash.near_duplicates(documents(rows, extra=False), shingle=3, percent=85).groupBy("id", "component_id").count().collect()
    assert sorted(tuple(r) for r in got) == [(1, 1, 2500), (2, 1, 2500), (3, 3, 1)]
    assert time.time() - start < 90
