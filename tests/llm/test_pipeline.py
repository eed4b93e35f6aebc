"""The pipeline's stages against plain Python, and the registered queries against their SQL."""
import os
import sys
from collections import Counter

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))

from check_queries import compare, duck  # noqa: E402

import corpus_pipeline  # noqa: E402
from offerlens.llm import queries  # noqa: E402
from tests.llm.conftest import alnum, closure, shingles  # noqa: E402

SF = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not there")


@here
@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, name):
    ok, note, _ = compare(spark, duck(SF), name, queries.QUERIES[name], queries.SQL.get(name), SF)
    assert ok, note


@here
def test_stages_keep_and_drop_what_they_should(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns
        rows = out.collect()
        seen[name] = ([tuple(r)[:5] for r in docs.collect()], [tuple(r)[:5] for r in rows])
        docs = spark.createDataFrame([tuple(r)[:5] for r in rows], docs.schema)
    before, after = seen["minhash"]
    sets = {r[0]: shingles(r[1], 5) for r in before}
    ids = sorted(i for i in sets if sets[i])
    edges = [(a, b) for n, a in enumerate(ids) for b in ids[:n] if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = closure(sets, edges)
    assert sorted(r[0] for r in after) == sorted(i for i in sets if root[i] == i)
    before, after = seen["decontamination"]
    win = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = alnum(r.text)
        win |= {tuple(w[i: i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    leaked = lambda t: any(tuple(w[i: i + 10]) in win for w in [alnum(t)] for i in range(max(1, len(w) - 9)))
    assert sorted(after) == sorted(r for r in before if not leaked(r[1]))
    before, after = seen["mixing"]
    assert set(after) <= set(before) and max(Counter(after).values()) <= 3
    before, after = seen["sharding"]
    assert sorted(before) == sorted(after)


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_rows(spark, tmp_path, stage):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, None), (2, "a b c")], "item_id long, text string")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "x y z w v u", None, "s", 3), (3, "long " * 20000, "en", None, 1)]
    out = stage(spark, spark.createDataFrame(rows, schema), str(tmp_path))
    assert out.count() <= 3 * len(rows) and out.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    assert stage(spark, spark.createDataFrame([], schema), str(tmp_path)).count() == 0
