"""Document quality by hierarchical empirical Bayes: text evidence combined with site and path posteriors.

1. A logistic model on features of the whole text gives every document p, the chance of good quality from its text. It is
   fitted on at most ``PER_CLASS`` labelled rows of each class (those with the least hash of their id; equal texts of an id
   count as one row, and an id's further texts as rows of their own).
2. Grouped sums over all documents give each site's and each path's count and sum of p. Site means are shrunk towards the
   global mean and path means towards their site's posterior, with strengths found by moments from the spread between
   groups beyond their sampling noise. A sparse site therefore follows the prior, a large one its own documents. A
   document's own p is taken out of its groups' sums, so it doesn't count twice.
3. The score's log-odds are those of the path posterior plus the text's evidence over the global mean.

Sites and paths are columns of the table (for web pages use ``site_and_path``). Null sites and paths are groups of
their own. Null and empty texts have the features of no text. Null labels are left out, of repeated labels the least
counts. Without labels of both classes p is the share of good labels (0.5 without any). Repeated rows count as often as
they occur. Extra columns pass through; those named like a result give way.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from offerlens.llm import sampling, words

PER_CLASS = 4000
KEEP = 0.5
CLIP = 1e-4
MARKS = b"|#$%&*{}<>=_~^\\@"
RESULT = ("text_score", "site_score", "path_score", "score", "kept")
_LINES = np.ones(256, bool)
_LINES[10] = False
_KINDS = np.zeros((6, 256))
_KINDS[0, 0x61:0x7B] = _KINDS[1, 0x41:0x5B] = _KINDS[2, 0x30:0x3A] = _KINDS[3, 0x80:] = 1
_KINDS[4, list(b".,;:!?'\"()-")] = 1
_KINDS[5, list(MARKS)] = 1
N_FEATURES = 13


def site_and_path(url: Column, depth: int = 1) -> tuple[Column, Column]:
    """The host of a url, and the host with the first ``depth`` parts of its path."""
    host = F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/@]*@)?([^/:?#]*)", 1))
    path = F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//[^/?#]*((?:/[^/?#]*){0," + str(depth) + "})", 1)
    return host, F.concat(host, path)


def _sums(row: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(row, value, n)


def features(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(rows, N_FEATURES): sizes, kinds of bytes, repetition of words and lines."""
    n = len(at) - 1
    size = np.diff(at)
    some = np.maximum(size, 1)
    owner = np.repeat(np.arange(n), size)
    kinds = [_sums(owner, k[data], n) / some for k in _KINDS]
    row, start, end = words.spans(data, at, words.SPACED)
    word, = words.hashes(data, start, end)
    n_words = np.bincount(row, minlength=n)
    distinct = np.bincount(words.distinct(row, word)[0], minlength=n)
    length = _sums(row, end - start, n) / np.maximum(n_words, 1)
    short = _sums(row, (end - start <= 3).astype(float), n) / np.maximum(n_words, 1)
    lone = _sums(row, (end - start == 1) & (_KINDS[5][data[start]] > 0), n) / np.maximum(n_words, 1)
    lrow, lstart, lend = words.spans(data, at, _LINES)
    line, = words.hashes(data, lstart, lend)
    n_lines = np.bincount(lrow, minlength=n)
    d_lines = np.bincount(words.distinct(lrow, line)[0], minlength=n)
    return np.stack([*kinds, np.log1p(n_words), distinct / np.maximum(n_words, 1), length, short, lone,
                     np.log1p(n_words / np.maximum(n_lines, 1)), d_lines / np.maximum(n_lines, 1)], axis=1)


def _expanded(x: np.ndarray, middle: np.ndarray, scale: np.ndarray) -> np.ndarray:
    z = np.clip((x - middle) / scale, -6, 6)
    return np.concatenate([np.ones((len(z), 1)), z, z**2], axis=1)


def fit(x: np.ndarray, good: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(middle, scale, coefficients) of a ridge logistic regression by Newton steps, classes weighted to ``prior``."""
    middle, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = _expanded(x, middle, scale)
    share = good.mean()
    cost = np.where(good, prior / share, (1 - prior) / (1 - share))
    b = np.zeros(z.shape[1])
    ridge = np.full(len(b), 1.0)
    ridge[0] = 1e-6
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        slope = z.T @ (cost * (good - p)) - ridge * b
        curve = (z * (cost * p * (1 - p))[:, None]).T @ z + np.diag(ridge + 1e-9)
        step = np.linalg.solve(curve, slope)
        b += step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
    return middle, scale, b


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, at in words.chunks(batch.column(2)):
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i).slice(lo, hi - lo) for i in (0, 1, 3)], pa.array(list(features(data, at)), pa.list_(pa.float64()))],
                names=["id", "mark", "body", "x"])


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality"):
    """(prior, middle, scale, coefficients); the last three are None without labels of both classes."""
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    marked = marked.groupBy(F.col(id_col).alias("id")).agg(F.min(F.col(label_col).cast("int")).alias("good"))
    n, share = marked.agg(F.count("*"), F.avg(F.col("good").cast("double"))).first()
    prior = 0.5 if not n else min(max(share, 1e-3), 1 - 1e-3)
    if n and 0 < share < 1:
        texts = sampling.texts_of_sample(docs, marked.withColumnRenamed("good", "mark"), PER_CLASS, id_col=id_col, text_col=text_col)
        found = texts.mapInArrow(_feature_rows, f"id {sampling.id_type(texts)}, mark int, body binary, x array<double>")
        # 2 * PER_CLASS rows of N_FEATURES numbers at most
        rows = sorted(sampling.rows_per_mark(found, PER_CLASS).collect(), key=lambda r: (r["id"], r["body"]))
        x, good = np.array([r["x"] for r in rows]), np.array([r["mark"] for r in rows], float)
        if len(rows) and 0 < good.mean() < 1:
            return prior, *fit(x, good, prior)
    return prior, None, None, None


def _scored(model, text_at: int):
    prior, middle, scale, b = model

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.zeros(0)]
            for lo, hi, data, at in words.chunks(batch.column(text_at)):
                p = np.full(hi - lo, prior) if b is None else 1 / (1 + np.exp(-np.clip(_expanded(features(data, at), middle, scale) @ b, -30, 30)))
                out.append(np.clip(p, CLIP, 1 - CLIP))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(out))], names=[*batch.schema.names, "text_score"])

    return rows


def _strength(groups: DataFrame, prior_col: str) -> float:
    """Prior strength (pseudo-documents) by moments: the spread of group means beyond sampling noise around their priors."""
    mean = F.col("total") / F.col("n")
    noise = F.col(prior_col) * (1 - F.col(prior_col)) / F.col("n")
    row = groups.where("n > 0").agg(
        F.sum(F.col("n") * ((mean - F.col(prior_col)) ** 2 - noise)), F.sum("n"), F.avg(F.col(prior_col) * (1 - F.col(prior_col)))).first()
    if not row[1]:
        return 1.0
    between = max(row[0] / row[1], 0.0)
    return float(min(max(row[2] / between - 1 if between > 0 else 1e6, 1.0), 1e6))


def classify(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source",
    path_col: str = "lang", label_col: str = "quality", carry: list[str] | None = None,
) -> DataFrame:
    """The columns ``carry`` (all) plus text_score, site_score, path_score, score and kept (score of KEEP or more)."""
    from offerlens.llm.scratch import Scratch

    scratch = Scratch(docs.sparkSession)
    model = train(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col)
    kept = [c for c in (docs.columns if carry is None else carry) if c not in RESULT]
    rows = docs.select(*kept, F.col(site_col).cast("string").alias("__site"), F.col(path_col).cast("string").alias("__path"), F.col(text_col).cast("string").alias("__rated_text"))
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema)
    rated = scratch.keep(rows.mapInArrow(_scored(model, len(kept) + 2), f"{kinds}text_score double").drop("__rated_text"))
    paths = scratch.keep(rated.groupBy("__site", "__path").agg(F.count("*").alias("n"), F.sum("text_score").alias("total")))
    sites = paths.groupBy("__site").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    n, total = sites.agg(F.sum("n"), F.sum("total")).first()
    top = total / n if n else 0.5
    by_site = _strength(sites.withColumn("prior", F.lit(top)), "prior")
    sites = sites.select(F.col("__site").alias("__s"), F.col("n").alias("__site_n"), F.col("total").alias("__site_total"))
    posterior = (F.col("__site_total") + by_site * top) / (F.col("__site_n") + by_site)
    groups = paths.join(sites, F.col("__site").eqNullSafe(F.col("__s"))).drop("__s").withColumn("prior", posterior)
    by_path = _strength(groups, "prior")
    groups = groups.select(*[F.col(c).alias(f"__g{c}") for c in ("__site", "__path", "n", "total")], "__site_n", "__site_total")
    out = rated.join(groups, F.col("__site").eqNullSafe(F.col("__g__site")) & F.col("__path").eqNullSafe(F.col("__g__path")))
    p = F.col("text_score")
    out = out.withColumn("site_score", (F.col("__site_total") - p + by_site * top) / (F.col("__site_n") - 1 + by_site))
    out = out.withColumn("path_score", (F.col("__gtotal") - p + by_path * F.col("site_score")) / (F.col("__gn") - 1 + by_path))
    held = F.least(F.greatest(F.col("path_score"), F.lit(CLIP)), F.lit(1 - CLIP))
    odds = lambda x: F.ln(x / (1 - x))
    mean = min(max(top, CLIP), 1 - CLIP)
    score = 1 / (1 + F.exp(-(odds(held) + odds(p) - float(np.log(mean / (1 - mean))))))
    return out.select(*kept, "text_score", "site_score", "path_score", score.alias("score"), (score >= KEEP).alias("kept"))
