"""Toxicity scores by a factorization machine over hashed terms.

Terms are a text's distinct words and the first 4 to 8 bytes of its words, so that inflected forms share evidence.
Terms are hashed into ``BUCKETS``; the ones that tell the classes apart best are kept, and a second-order machine

    y = bias + sum w_i + sum_{i<j} <v_i, v_j>

learns their weights and pairwise interactions, such as an insult next to the mention of a group, from a sample of
labelled rows. Only this sample is bounded (``PER_CLASS`` rows of each class, those with the least hash of their
id; equal texts of an id count as one row, and its further texts as rows of their own); it is cut in Spark, turned into terms in Spark and fitted in one task, as its size doesn't grow. Every text is
scored whole, in one pass without a shuffle; the model that the tasks get is bounded by ``KEPT`` terms.

Null and empty texts have no terms and get the score of the bias. Null labels are left out; of repeated labels the
largest counts. Without labels of both classes every score is the share of toxic labels (0.5 without any). Extra
columns pass through; ``score`` and ``predicted`` give way to the results.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from offerlens.llm import sampling, words

BUCKETS = 1 << 20
PREFIXES = (4, 5, 6, 7, 8)
PER_CLASS = 4000
KEPT = 2048
FACTORS = 8
EPOCHS = 30
LINEAR_DECAY = 1e-5
FACTOR_DECAY = 1e-3
THRESHOLD = 0.3
MODEL_SCHEMA = "bias double, bucket binary, weight binary, factors binary"


def terms(data: np.ndarray, at: np.ndarray, slot: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, term) of the distinct terms of every row, sorted by row; ``slot`` maps buckets to kept terms (0: none)."""
    row, start, end = words.spans(data, at, words.ALNUM)
    rows, found = [], []
    for i, h in enumerate(words.hashes(data, start, end, *PREFIXES)):
        bucket = (words.mix(h + np.uint64(i)) % np.uint64(BUCKETS)).astype(np.int64)
        good = h != 0 if i else np.ones(len(h), bool)
        if slot is not None:
            bucket = slot[bucket]
            good &= bucket > 0
        rows.append(row[good])
        found.append(bucket[good])
    both = np.unique(np.concatenate(rows) * np.int64(BUCKETS) + np.concatenate(found)) if rows else np.zeros(0, np.int64)
    return both // BUCKETS, both % BUCKETS


def _term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, at in words.chunks(batch.column(2)):
            row, term = terms(data, at)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i).slice(lo, hi - lo) for i in (0, 1, 3)], words.lists(row, term.astype(np.int32), hi - lo)],
                names=["id", "mark", "body", "terms"])


def _signal(row: np.ndarray, term: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kept buckets: the KEPT largest differences of the classes' rates in standard errors, above two of them."""
    a = np.bincount(term[toxic[row]], minlength=BUCKETS).astype(float)
    b = np.bincount(term[~toxic[row]], minlength=BUCKETS).astype(float)
    n, m = toxic.sum(), (~toxic).sum()
    rate = (a + b) / (n + m)
    error = np.sqrt(np.maximum(rate * (1 - rate), 1e-12) * (1 / n + 1 / m))
    z = np.abs(a / n - b / m) / error
    z[a + b < 3] = 0
    best = np.argsort(-z, kind="stable")[:KEPT]
    return np.sort(best[z[best] > 2])


def fit(row: np.ndarray, term: np.ndarray, toxic: np.ndarray, prior: float) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """(bias, buckets, weights, factors) by Adagrad on the logistic loss, over shuffled parts of 64 rows.

    Rows are weighted so that the classes count as in ``prior``, the share of toxic labels.
    """
    kept = _signal(row, term, toxic)
    slot = np.zeros(BUCKETS, np.int64)
    slot[kept] = np.arange(1, len(kept) + 1)
    use = slot[term] > 0
    row, x = row[use], slot[term[use]]
    at = np.searchsorted(row, np.arange(len(toxic) + 1))
    rng = np.random.default_rng(7)
    w = np.zeros(len(kept) + 1)
    v = rng.normal(0, 0.02, (len(kept) + 1, FACTORS))
    bias = float(np.log(prior / (1 - prior)))
    share = toxic.mean()
    cost = np.where(toxic, prior / share, (1 - prior) / (1 - share))
    sw, sv, sb = np.full(len(w), 1e-2), np.full(v.shape, 1e-2), 1e-2
    for _ in range(EPOCHS):
        order = rng.permutation(len(toxic))
        for a in range(0, len(order), 64):
            part = order[a: a + 64]
            count = at[part + 1] - at[part]
            ids = np.concatenate([x[at[i]: at[i + 1]] for i in part])
            own = np.repeat(np.arange(len(part)), count)
            y, total = _response(bias, w, v, own, ids, len(part))
            slope = (1 / (1 + np.exp(-y)) - toxic[part]) * cost[part] / len(part)
            one, most = np.unique(ids, return_inverse=True)
            gw = np.bincount(most, slope[own], len(one)) + LINEAR_DECAY * w[one]
            gv = np.zeros((len(one), FACTORS))
            np.add.at(gv, most, slope[own][:, None] * (total[own] - v[ids]))
            gv += FACTOR_DECAY * v[one]
            sw[one] += gw**2
            sv[one] += gv**2
            w[one] -= 0.1 * gw / np.sqrt(sw[one])
            v[one] -= 0.05 * gv / np.sqrt(sv[one])
            gb = slope.sum()
            sb += gb**2
            bias -= 0.1 * gb / np.sqrt(sb)
    return bias, kept, w[1:], v[1:]


def _response(bias, w, v, row, term, n):
    """The machine's values and each row's sum of factors."""
    total, squares = np.zeros((n, v.shape[1])), np.zeros((n, v.shape[1]))
    np.add.at(total, row, v[term])
    np.add.at(squares, row, v[term] ** 2)
    y = bias + np.bincount(row, w[term], n) + 0.5 * (total**2 - squares).sum(axis=1)
    return np.clip(y, -30, 30), total


def _fit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = pa.Table.from_batches(list(batches), schema=None) if (batches := list(batches)) else None
    if rows is not None and len(rows):
        rows = rows.sort_by([("id", "ascending"), ("body", "ascending")]).combine_chunks()
        toxic = rows["mark"].to_numpy().astype(bool)
        if toxic.any() and not toxic.all():
            listed = rows["terms"].combine_chunks()
            count = np.diff(listed.offsets.to_numpy())
            row = np.repeat(np.arange(len(toxic)), count)
            bias, kept, w, v = fit(row, listed.flatten().to_numpy().astype(np.int64), toxic, float(rows["prior"][0].as_py()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([bias]), *[pa.array([x.tobytes()], pa.binary()) for x in (kept.astype(np.int64), w, v)]],
                names=["bias", "bucket", "weight", "factors"])


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"):
    """(bias, buckets, weights, factors) learnt from at most PER_CLASS labelled rows of each class."""
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    marked = marked.groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    n, share = marked.agg(F.count("*"), F.avg(F.col("toxic").cast("double"))).first()
    none = np.zeros(0, np.int64), np.zeros(0), np.zeros((0, FACTORS))
    prior = 0.5 if not n else min(max(share, 1e-3), 1 - 1e-3)
    if n and 0 < share < 1:
        texts = sampling.texts_of_sample(docs, marked.withColumnRenamed("toxic", "mark"), PER_CLASS, id_col=id_col, text_col=text_col)
        found = texts.mapInArrow(_term_rows, f"id {sampling.id_type(texts)}, mark int, body binary, terms array<int>")
        # 2 * PER_CLASS rows at most
        found = sampling.rows_per_mark(found, PER_CLASS).withColumn("prior", F.lit(prior)).repartition(1)
        model = found.mapInArrow(_fit_rows, MODEL_SCHEMA).collect()
        if model:
            m = model[0]
            return m.bias, np.frombuffer(m.bucket, np.int64), np.frombuffer(m.weight), np.frombuffer(m.factors).reshape(-1, FACTORS)
    return float(np.log(prior / (1 - prior))), *none


def _scored(model, text_at: int):
    bias, kept, w, v = model
    state: dict[str, np.ndarray] = {}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not state:
            state["slot"] = np.zeros(BUCKETS, np.int64)
            state["slot"][kept] = np.arange(1, len(kept) + 1)
            state["w"], state["v"] = np.r_[0.0, w], np.r_[np.zeros((1, FACTORS)), v]
        for batch in batches:
            scores = [np.zeros(0)]
            for lo, hi, data, at in words.chunks(batch.column(text_at)):
                row, term = terms(data, at, state["slot"])
                y, _ = _response(bias, state["w"], state["v"], row, term, hi - lo)
                scores.append(1 / (1 + np.exp(-y)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(scores))], names=[*batch.schema.names, "score"])

    return rows


def held_out(key: Column) -> Column:
    """Rows that training never sees: a quarter, by the checksum of the id as text. A null id isn't held out."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string")), F.lit(4)) == 2, F.lit(False))


def score(docs: DataFrame, model, *, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` (all) of every document plus score and predicted."""
    carry = [c for c in (docs.columns if carry is None else carry) if c not in ("score", "predicted")]
    rows = docs.select(*carry, F.col(text_col).cast("string").alias("_scored_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carry).schema)
    rows = rows.mapInArrow(_scored(model, len(carry)), f"{kinds}, `_scored_text` string, score double").drop("_scored_text")
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
             carry: list[str] | None = None, label_col: str = "toxic") -> DataFrame:
    """Train on the labels that aren't held out, then score every document; adds held_out, score and predicted."""
    model = train(docs, labels.where(~held_out(F.col(id_col))), id_col=id_col, text_col=text_col, label_col=label_col)
    return score(docs, model, text_col=text_col, carry=carry).withColumn("held_out", held_out(F.col(id_col)))
