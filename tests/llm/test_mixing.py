import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from offerlens.llm import mixing
from tests.llm.conftest import spaced


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    """Shares by weight; what is beyond the caps is shared again until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full, left = sum(sizes.values()), {}, set(names)
    while left:
        rest = total - sum(full.values())
        share = {s: rest * w[s] / sum(w[x] for x in left) for s in left}
        over = {s for s in left if share[s] > most * sizes[s]}
        if not over:
            return full | share
        full |= {s: most * sizes[s] for s in over}
        left -= over
    return full


def rows():
    out = []
    for i in range(600):
        source = "big" if i % 3 == 0 else ["a", "b", "Z", None, "é", "tiny"][i % 6 if i % 50 else 5]
        out.append((i, " ".join(["w"] * ((i * 37) % 90)), "en", source))
    return out + [(700, None, "en", "nulls"), (701, "", "en", "nulls"), (702, "x " * 3000, "en", "a"), (5, "repeated id", "en", "b"),
                  (6, rows_6(), "en", "a"), (6, rows_6(), "en", "a"), (None, "no id here", "en", "a")]


def rows_6():
    return "same row twice"


def test_targets_caps_and_taken(spark, documents):
    data = rows()
    got = mixing.mix(documents(data)).collect()
    assert len(got) == len(data)
    sizes = Counter()
    for _, t, _, s in data:
        sizes[s] += len(spaced(t))
    want = brute_targets(sizes)
    taken = Counter()
    for r in got:
        assert r.size == len(spaced(r.text)) and r.source_size == sizes[r.source]
        assert math.isclose(r.target, want[r.source], rel_tol=1e-9, abs_tol=1e-9)
        assert r.taken == r.size * len(r.shards) <= 3 * r.size and all(0 <= x < 16 for x in r.shards)
        taken[r.source] += r.taken
    for s, n in sizes.items():
        largest = max(len(spaced(t)) for _, t, _, x in data if x == s)
        assert abs(taken[s] - want[s]) <= largest, (s, taken[s], want[s])
    again = mixing.mix(documents(data).repartition(5)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id, r.text or "", r.taken, r.shards)
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_sources_without_words_and_empty_table(spark, documents):
    got = mixing.mix(documents([(1, None, "en", None), (2, " ", "en", "a")])).collect()
    assert [(r.target, r.taken, r.shards) for r in got] == [(0.0, 0, [])] * 2
    assert mixing.mix(documents([])).count() == 0


def test_mixed_gives_one_row_per_copy(spark, documents):
    data = rows()
    want = Counter({(r.doc_id, r.text): 0 for r in []})
    for r in mixing.mix(documents(data)).collect():
        want[(r.doc_id, r.text)] += len(r.shards)
    got = mixing.mixed(documents(data))
    assert got.columns == [*documents([]).columns, "mix_shard", "mix_order"]
    assert Counter((r.doc_id, r.text) for r in got.collect()) == +want


@pytest.mark.parametrize("shards", [1, 2, 5, 16])
def test_tree_splits_exactly(spark, shards):
    units = spark.range(1003).select((F.col("id") % 7).cast("string").alias("source"), F.col("id").alias("block"), F.lit(0).alias("pass"))
    got = mixing.split_tree(units, shards).collect()
    assert len({r.block for r in got}) == len(got) == 1003
    counts = Counter(r.shard for r in got)
    assert set(counts) == set(range(shards)) and max(counts.values()) - min(counts.values()) <= math.ceil(math.log2(shards + 1)) + 1
