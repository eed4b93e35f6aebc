import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from offerlens.llm import quality


def test_site_and_path(spark):
    urls = ["https://User@Example.com:80/a/b?q#f", "//h/x", "http://h", "no url", None]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    site, path = quality.site_and_path(F.col("url"))
    assert [tuple(r) for r in df.select(site, path).collect()] == [
        ("example.com", "example.com/a"), ("h", "h/x"), ("h", "h"), ("", ""), (None, None)]


@pytest.fixture(scope="module")
def tables(spark, documents):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(1200):
        good = rng.random() < (0.9 if i % 4 else 0.3)
        words = [rng.choice(["house", "river", "to", "a", "walks"]) for _ in range(40)]
        text = " ".join(words) + ". Then it ended." if good else " | ".join(words[: 12])
        rows.append((i, text, f"p{i % 3}", f"s{i % 4}"))
        if i % 2:
            labels.append((i, int(good)))
    rows += [(5000, None, None, None), (5001, "", "p0", "s0"), (5002, "a river", "lone", "lone site"), (None, "a river", "p0", "s1"), (7, rows[7][1], "p1", "s3")]
    truth = {r[0]: int("|" not in r[1]) for r in rows[:1200]}
    return rows, truth, documents(rows), spark.createDataFrame([*labels, (1, None), (None, 1), labels[0]], "doc_id long, quality int")


def test_scores_and_shrinkage(spark, tables):
    rows, truth, docs, labels = tables
    out = quality.classify(docs, labels)
    got = out.collect()
    assert len(got) == len(rows)
    judged = [r for r in got if r.doc_id in truth]
    assert sum(r.kept == bool(truth[r.doc_id]) for r in judged) / len(judged) > 0.98
    p = {id(r): r.text_score for r in got}
    top = sum(p.values()) / len(p)
    # sums without the document itself, shrunk between the group's own mean and the prior
    for r in got:
        own = [x.text_score for x in got if x.source == r.source and x is not r]
        low, high = (min(top, sum(own) / len(own)), max(top, sum(own) / len(own))) if own else (top, top)
        assert low - 1e-9 <= r.site_score <= high + 1e-9
        same = [x.text_score for x in got if x.source == r.source and x.lang == r.lang and x is not r]
        if not same:
            assert abs(r.path_score - r.site_score) < 1e-9
    lone = next(r for r in got if r.source == "lone site")
    assert abs(lone.site_score - top) < 1e-9
    by_site = {s: [r.site_score for r in judged if r.source == s] for s in ("s0", "s1")}
    assert max(by_site["s0"]) < min(by_site["s1"])


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(1, None)]])
def test_without_both_classes(spark, documents, labels):
    got = quality.classify(documents([(1, "a"), (2, None)]), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert len(got) == 2 and len({r.text_score for r in got}) == 1


def test_empty_table(spark, documents):
    assert quality.classify(documents([]), spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")).count() == 0


def shrunk(rows):
    """(site, path, final) scores by plain sums over (site, path, p)."""
    clip = lambda x: min(max(x, quality.CLIP), 1 - quality.CLIP)
    odds = lambda x: math.log(x / (1 - x))
    n, total = len(rows), sum(p for *_, p in rows)
    top = total / n

    def sums(key):
        out = {}
        for s, h, p in rows:
            m, t = out.get(key(s, h), (0, 0.0))
            out[key(s, h)] = m + 1, t + p
        return out

    def strength(groups):
        noise = sum(m * ((t / m - q) ** 2 - q * (1 - q) / m) for m, t, q in groups)
        between = max(noise / sum(m for m, _, _ in groups), 0)
        room = sum(q * (1 - q) for _, _, q in groups) / len(groups)
        return min(max(room / between - 1 if between > 0 else 1e6, 1), 1e6)

    sites, paths = sums(lambda s, h: s), sums(lambda s, h: (s, h))
    a = strength([(m, t, top) for m, t in sites.values()])
    after = {s: (t + a * top) / (m + a) for s, (m, t) in sites.items()}
    b = strength([(m, t, after[s]) for (s, _), (m, t) in paths.items()])
    out = []
    for s, h, p in rows:
        m, t = sites[s]
        site = (t - p + a * top) / (m - 1 + a)
        m, t = paths[s, h]
        path = (t - p + b * site) / (m - 1 + b)
        out.append((site, path, 1 / (1 + math.exp(-(odds(clip(path)) + odds(p) - odds(clip(top)))))))
    return out


def test_against_brute_force(spark, tables):
    """Text scores from the fitted coefficients, one text at a time; posteriors by plain sums."""
    rows, _, docs, labels = tables
    prior, middle, scale, b = quality.train(docs, labels)
    got = quality.classify(docs, labels).collect()
    for r in got:
        data = np.frombuffer((r.text or "").encode(), np.uint8)
        z = np.clip((quality.features(data, np.array([0, len(data)]))[0] - middle) / scale, -6, 6)
        p = 1 / (1 + math.exp(-max(-30, min(30, b[0] + z @ b[1: 1 + len(z)] + z**2 @ b[1 + len(z):]))))
        assert abs(r.text_score - min(max(p, quality.CLIP), 1 - quality.CLIP)) < 1e-9
    want = shrunk([(r.source, r.lang, r.text_score) for r in got])
    for r, w in zip(got, want, strict=True):
        assert np.allclose((r.site_score, r.path_score, r.score), w, atol=1e-9)
        assert r.kept == (r.score >= quality.KEEP)


def test_a_labelled_id_with_many_rows(spark, monkeypatch):
    """50,000 equal rows of an id are one row of the sample, and its many texts no more than PER_CLASS."""
    monkeypatch.setattr(quality, "PER_CLASS", 20)
    seen = []
    fit = quality.fit
    monkeypatch.setattr(quality, "fit", lambda x, good, prior: seen.append((len(x), int(good.sum()))) or fit(x, good, prior))
    equal = spark.range(50_000).selectExpr("'a' AS doc_id", "'A river. It ended.' AS text")
    many = spark.range(300).selectExpr("'b' AS doc_id", "concat('x | ', id) AS text")
    docs = equal.unionByName(many).unionByName(spark.createDataFrame([("c", "A house. Then."), ("d", None)], "doc_id string, text string"))
    labels = spark.createDataFrame([("a", 1), ("b", 0), ("c", 1)], "doc_id string, quality int")
    prior, *model = quality.train(docs, labels)
    assert seen == [(22, 2)] and model[0] is not None
    out = quality.classify(docs.selectExpr("doc_id", "text", "'s' AS source", "'p' AS lang"), labels, carry=["doc_id"])
    assert out.count() == 50_302


def test_long_text(spark, documents):
    rows = [(1, "a river. " * 400_000), (2, "x" * 3_000_000), (3, None)]
    got = quality.classify(documents(rows), spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")).collect()
    assert len(got) == 3 and all(0 <= r.score <= 1 for r in got)
