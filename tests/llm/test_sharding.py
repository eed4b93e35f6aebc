import hashlib
import math
import zlib

import pytest

from offerlens.llm import sharding

ROWS = [(i, f"text {i}" * (i % 7)) for i in range(400)] + [(None, None), (None, "x"), (900, None), (901, ""), (5, "again"), (5, "again")]


def test_slots_checksums_and_growth(spark, documents):
    got = sharding.shard(documents(ROWS)).collect()
    assert len(got) == len(ROWS)
    slots = {}
    for r in got:
        text = (r.text or "").encode()
        assert r.size == len(text) + 1 and r.text_crc32 == zlib.crc32(text)
        assert r.grown_shard in (r.shard, 16) and 0 <= r.shard < 16
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({r.shard for r in got if r.doc_id == 5}) == 1
    grown = {r.doc_id: r.shard for r in sharding.shard(documents(ROWS), (1.0,) * 17).collect()}
    assert all(grown[r.doc_id] == r.grown_shard for r in got)


def test_weights_and_reruns(spark, documents):
    docs = documents([(i, "t") for i in range(3000)], extra=False)
    first = sharding.shard(docs, (3.0, 1.0), grown_weight=None).collect()
    assert abs(sum(r.shard == 0 for r in first) / 3000 - 0.75) < 0.03
    again = sharding.shard(docs.repartition(7), (3.0, 1.0), grown_weight=None).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in first} == {(r.doc_id, r.shard, r.slot) for r in again}


def test_empty_and_bad_weights(spark, documents):
    assert sharding.shard(documents([])).count() == 0
    with pytest.raises(ValueError):
        sharding.shard(documents([]), (1.0, 0.0))


def test_shards_against_brute_force(spark, documents):
    def cost(key, i, weight):
        digest = hashlib.md5(f"{'' if key is None else key}|{i}".encode()).hexdigest()
        return -math.log((int(digest[:13], 16) + 0.5) / 2**52) / weight, i

    weights = [3.0, 1.0, 0.5, 1.0]
    for r in sharding.shard(documents(ROWS), weights, grown_weight=2.0).collect():
        best = min(cost(r.doc_id, i, w) for i, w in enumerate(weights))
        assert (r.shard, r.grown_shard) == (best[1], min(best, cost(r.doc_id, 4, 2.0))[1])


def test_costs_are_worked_out_once(spark, documents):
    """No filter on shards that repeats their costs; rows without text are the same, and written before the two passes."""
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    whole, narrow = sharding.shard(documents(ROWS)), sharding.shard(documents(ROWS), carry=["lang"])
    assert "md5(" in plan(whole) and not any("md5(" in line for line in plan(whole).splitlines() if "Filter" in line)
    assert "md5(" not in plan(narrow) and narrow.columns == ["doc_id", "lang", "size", "text_crc32", "shard", "grown_shard", "slot"]
    rows = lambda df: sorted(map(str, df.select(*narrow.columns).collect()))
    assert rows(whole) == rows(narrow)
