import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from offerlens.llm import sampling, toxicity


def corpus(n=1600):
    """An insult is toxic only next to the mention of a group: no additive weight tells that."""
    rng = random.Random(2)
    out = []
    for i in range(n):
        w = [f"w{rng.randrange(80)}" for _ in range(rng.randint(5, 60))]
        insult, group = i % 2, (i // 2) % 2
        w += ["rotten"] * insult + ["northerners"] * group
        rng.shuffle(w)
        out.append((i, " ".join(w), "en", "s", 1, int(insult and group)))
    return out


@pytest.fixture(scope="module")
def tables(spark, documents):
    rows = corpus()
    docs = documents([r[:5] for r in rows] + [(9000, None), (9001, ""), (None, "rotten northerners"), (0, rows[0][1])])
    labels = spark.createDataFrame([(r[0], 1, r[5]) for r in rows] + [(1, 1, None), (9000, 1, 0), (None, 1, 1), (0, 1, rows[0][5])], "doc_id long, quality int, toxic int")
    return rows, docs, labels


def test_learns_the_interaction_on_rows_it_has_not_seen(spark, tables):
    rows, docs, labels = tables
    got = toxicity.classify(docs, labels).collect()
    assert len(got) == len(rows) + 4
    truth = {r[0]: r[5] for r in rows}
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    again = {(r.doc_id, r.text): r.score for r in toxicity.classify(docs.repartition(3), labels).collect()}
    assert all(abs(again[(r.doc_id, r.text)] - r.score) < 1e-9 for r in got)


def test_held_out_labels_do_not_change_scores(spark, tables):
    _, docs, labels = tables
    flipped = labels.selectExpr("doc_id", "quality", "CASE WHEN crc32(CAST(doc_id AS string)) % 4 = 2 THEN 1 - toxic ELSE toxic END AS toxic")
    a, b = (sorted((str(r.doc_id), r.score) for r in toxicity.classify(docs, x).collect()) for x in (labels, flipped))
    assert a == b


@pytest.mark.parametrize("labels", [[], [(1, 0)], [(1, None)], [(1, 1), (3, 1)]])
def test_without_both_classes(spark, documents, labels):
    df = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.classify(documents([(1, "a"), (3, None)]), df).collect()
    assert len({r.score for r in got}) == 1 and len(got) == 2


def test_empty_table(spark, documents):
    df = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, toxic int")
    assert toxicity.classify(documents([]), df).count() == 0


def test_against_brute_force(spark, tables):
    """Scores from the learnt weights, pair by pair of a text's terms."""
    rows, docs, labels = tables
    model = toxicity.train(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))
    bias, kept, w, v = model
    place = {int(k): i for i, k in enumerate(kept)}
    for r in toxicity.score(docs, model).collect()[::40]:
        data = np.frombuffer((r.text or "").encode(), np.uint8)
        _, term = toxicity.terms(data, np.array([0, len(data)]))
        own = [place[int(t)] for t in term if int(t) in place]
        y = bias + sum(w[i] for i in own) + sum(v[i] @ v[j] for n, i in enumerate(own) for j in own[:n])
        assert abs(r.score - 1 / (1 + math.exp(-max(-30, min(30, y))))) < 1e-9


def test_a_labelled_id_with_many_rows(spark, monkeypatch):
    """The sample holds one row per text of an id and at most PER_CLASS rows of a class; ids may be strings."""
    monkeypatch.setattr(toxicity, "PER_CLASS", 20)
    equal = spark.range(50_000).selectExpr("'a' AS doc_id", "'rotten northerners' AS text")
    many = spark.range(300).selectExpr("'b' AS doc_id", "concat('fine words ', id) AS text")
    marked = spark.createDataFrame([("a", 1), ("b", 0)], "id string, mark int")
    texts = sampling.texts_of_sample(equal.unionByName(many), marked, 20, id_col="doc_id", text_col="text")
    assert sampling.rows_per_mark(texts, 20).groupBy("mark").count().orderBy("mark").collect() == [(0, 20), (1, 1)]
    labels = marked.withColumnsRenamed({"id": "doc_id", "mark": "toxic"})
    got = toxicity.score(equal.unionByName(many), toxicity.train(equal.unionByName(many), labels))
    assert got.count() == 50_300


def test_cut_before_the_shuffle(spark):
    df = spark.range(10).selectExpr("id", "cast(id % 2 AS int) AS mark", "unhex(sha2(cast(id AS string), 256)) AS body")
    assert sampling.rows_per_mark(df, 3)._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") == 2
