"""Line dedup with a log-template tree.

A line goes down a tree of fixed depth: token count, then its first ``LEAD`` tokens; tokens with a digit are variable fields
and all alike. At a leaf, lines are told apart by the tokens after these in ``SEGMENTS`` stretches (single tokens in short
lines; lines of few tokens have fewer). A template is any choice of ``SIMILAR`` of a line's stretches, rounded up, with
their tokens; the other stretches are variable fields. It recurs when lines of ``MIN_DOCS`` or more documents hold it, so a
leaf may have many templates, whatever else it holds. What the leaf implies anyhow is no evidence, and up to three stretches
must all agree. An exact form (digits aside) found in as many documents recurs as well. Lines that recur are dropped.
Documents of equal text count once, so copies of a document don't make its lines recur, and a document counts once for all
its lines of a template.

A line of ``LONG_TOKENS`` or more that does not recur so, but stands verbatim in two documents or more, stays in one of them
(the one with the smallest text hash) and is dropped in the others, so no text is lost altogether.

Everything about a leaf is a grouped sum, so no leaf is gathered in one task. Texts are scanned once; what is shuffled
is some 80 bytes per line.

Null and empty texts have no lines. Lines that are variable fields for more than half are kept unless they are long and
verbatim. Lines of fewer than ``min_tokens`` tokens are kept by default; with ``min_tokens`` 1, as op9 asks for, short
exact forms recur like others. Rows that share an id
are told apart by their texts, and equal rows get equal results. Other columns are ignored by ``rate`` and kept by ``clean``.
"""
from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from offerlens.llm import words
from offerlens.llm.scratch import Scratch

LEAD = 3
SEGMENTS = 8
SIMILAR = 0.75
MIN_TOKENS = 5
MIN_DOCS = 10
LONG_TOKENS = 10
_FIELD = np.uint64(0xA24BAED4963EE407)
_LINES = np.ones(256, bool)
_LINES[10] = False
_STRETCH = [f"g{k}" for k in range(SEGMENTS)]


def parse(data: np.ndarray, at: np.ndarray):
    """(row, line number, tokens, fields, leaf, whole, stretches beyond the leading tokens, verbatim) of every line that has tokens."""
    lrow, lstart, _ = words.spans(data, at, _LINES)
    row, start, end = words.spans(data, at, words.SPACED)
    token, = words.hashes(data, start, end)
    digits = np.r_[0, np.cumsum((data >= 48) & (data <= 57))]
    field = digits[end] > digits[start]
    exact = token.copy()
    token[field] = _FIELD
    line = np.searchsorted(lstart, start, "right") - 1
    head = np.flatnonzero(np.r_[True, line[1:] != line[:-1]]) if len(line) else np.zeros(0, int)
    count = np.diff(np.r_[head, len(line)])
    own = np.repeat(np.arange(len(head)), count)
    place = np.arange(len(line)) - np.repeat(head, count)
    size = count[own]
    placed = words.mix(token + (place.astype(np.uint64) + np.uint64(1)) * words.PLACE[0])
    whole = np.zeros(len(head), np.uint64)
    np.add.at(whole, own, placed)
    verbatim = np.zeros(len(head), np.uint64)
    np.add.at(verbatim, own, words.mix(exact + (place.astype(np.uint64) + np.uint64(1)) * words.PLACE[1]))
    leaf = np.zeros(len(head), np.uint64)
    lead = place < LEAD
    np.add.at(leaf, own[lead], placed[lead])
    stretch = np.zeros(len(head) * SEGMENTS, np.uint64)
    rest = ~lead
    np.add.at(stretch, own[rest] * SEGMENTS + (place[rest] - LEAD) * SEGMENTS // np.maximum(size[rest] - LEAD, SEGMENTS), placed[rest])
    breaks = np.r_[0, np.cumsum(data == 10)]  # numbers of lines count empty ones as well
    number = breaks[lstart[line[head]]] - breaks[at[lrow[line[head]]]] if len(head) else head
    n = count.astype(np.uint64)
    return (row[head], number, count, np.bincount(own, field, len(head)), words.mix(leaf ^ words.mix(n)), words.mix(whole + n),
            (words.mix(stretch) >> np.uint64(32)).astype(np.uint32).view(np.int32).reshape(-1, SEGMENTS), words.mix(verbatim + n))


def _line_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, at in words.chunks(batch.column(2)):
            row, number, count, fields, leaf, whole, stretch, verbatim = parse(data, at)
            first = np.zeros(len(row), bool)  # of this form in its document
            if len(row):
                order = np.lexsort((number, whole, row))
                first[order] = np.r_[True, (whole[order][1:] != whole[order][:-1]) | (row[order][1:] != row[order][:-1])]
            first &= 2 * fields <= count
            pick = pa.array(row + lo)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pick), batch.column(1).take(pick), pa.array(number, pa.int32()), pa.array(count, pa.int32()),
                 pa.array(leaf.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(verbatim.view(np.int64)), pa.array(first),
                 *[pa.array(np.ascontiguousarray(stretch[:, k])) for k in range(SEGMENTS)]],
                names=["id", "key", "line", "tokens", "leaf", "whole", "verbatim", "first", *_STRETCH])


def _template_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(leaf, whole, docs, template): the templates of line forms (leaf, whole, docs, tokens, stretches)."""
    for batch in batches:
        leaf, whole, docs, tokens, *stretch = (c.to_numpy() for c in batch.columns)
        value = [words.mix(g.astype(np.uint64) + words.PLACE[2 + k]) for k, g in enumerate(stretch)]
        held = np.minimum(tokens - LEAD, SEGMENTS)
        for n in np.unique(held[held > 3]):  # up to three stretches give the exact form
            at = np.flatnonzero(held == n)
            for chosen in combinations(range(n), math.ceil(SIMILAR * n)):
                template = leaf[at].view(np.uint64).copy()
                for k in chosen:
                    template += value[k][at]
                yield pa.RecordBatch.from_arrays([pa.array(leaf[at]), pa.array(whole[at]), pa.array(docs[at]), pa.array(words.mix(template).view(np.int64))],
                                                 names=["leaf", "whole", "docs", "template"])


def recurring(lines: DataFrame, scratch: Scratch, min_docs: int = MIN_DOCS, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """(leaf, whole): the line forms to drop."""
    own = lines.where(F.col("first") & (F.col("tokens") >= min_tokens)).dropDuplicates(["key", "leaf", "whole"])  # documents of equal text count once
    forms = scratch.keep(own.groupBy("leaf", "whole").agg(F.count("*").alias("docs"), F.first("tokens").alias("tokens"), *[F.first(g).alias(g) for g in _STRETCH]))
    # sums over forms are bounds only: a document may hold many forms of a template, and counts once
    leaves = forms.groupBy("leaf").agg(F.sum("docs").alias("most"), F.count("*").alias("forms")).where((F.col("most") >= min_docs) & (F.col("forms") > 1))
    shared = forms.where(F.col("tokens") - LEAD > 3).join(leaves.select("leaf"), "leaf").select("leaf", "whole", "docs", "tokens", *_STRETCH)
    held = shared.mapInArrow(_template_rows, "leaf long, whole long, docs long, template long")
    likely = held.groupBy("template").agg(F.sum("docs").alias("most"), F.max("docs").alias("least")).where(F.col("most") >= min_docs)
    likely = scratch.keep(likely)
    # a form of enough documents makes all its templates recur; those without are counted by document
    open_forms = held.join(likely.where(F.col("least") < min_docs).select("template"), "template").select("leaf", "whole", "template")
    counted = open_forms.join(own.select("leaf", "whole", "key"), ["leaf", "whole"]).select("template", "key").distinct()
    counted = counted.groupBy("template").agg(F.count("*").alias("docs")).where(F.col("docs") >= min_docs)
    many = likely.where(F.col("least") >= min_docs).select("template").unionByName(counted.select("template"))
    follow = held.join(many, "template").select("leaf", "whole")
    return forms.where(F.col("docs") >= min_docs).select("leaf", "whole").unionByName(follow).distinct()


def copied(lines: DataFrame) -> DataFrame:
    """(verbatim, keeper): long lines found in several texts, and the text that keeps its own."""
    known = lines.where(F.col("tokens") >= LONG_TOKENS).groupBy("verbatim").agg(F.min("key").alias("keeper"), F.max("key").alias("last"))
    return known.where("keeper < last").select("verbatim", "keeper")


def rate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """(id, key, n_lines, n_dropped, dropped): lines with tokens per document, and the numbers (from 0) of those to drop.

    One row per distinct (id, text); ``key`` is the hash of the text.
    """
    scratch = Scratch(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("key"), text.alias("text"))
    lines = scratch.keep(rows.mapInArrow(_line_rows, f"id {kind}, key long, line int, tokens int, leaf long, whole long, verbatim long, first boolean, "
                                         + ", ".join(f"{g} int" for g in _STRETCH)))
    bad = recurring(lines, scratch, min_docs, min_tokens).withColumn("bad", F.lit(True))
    marked = lines.select("id", "key", "line", "tokens", "leaf", "whole", "verbatim").join(bad, ["leaf", "whole"], "left")
    # a line of very many documents is marked already and doesn't enter this join
    again = marked.where(F.col("bad").isNull() & (F.col("tokens") >= LONG_TOKENS)).join(copied(lines), "verbatim").where("key != keeper")
    own = marked.select("id", "key", "line", "bad").unionByName(again.select("id", "key", "line", F.lit(True).alias("bad")))
    own = own.groupBy("id", "key").agg(F.collect_set("line").alias("seen"), F.array_sort(F.collect_set(F.when(F.col("bad"), F.col("line")))).alias("dropped"))
    return own.select("id", "key", F.size("seen").cast("long").alias("n_lines"), F.size("dropped").cast("long").alias("n_dropped"), "dropped")


def _joined(docs: DataFrame, rated: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rated = rated.withColumnsRenamed({c: f"__{c}" for c in rated.columns})
    rows = docs.withColumns({"__own": F.col(id_col), "__own_key": F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))})
    return rows.join(rated, F.col("__own").eqNullSafe(F.col("__id")) & (F.col("__own_key") == F.col("__key")), "left")


def summary(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """(id, n_lines, n_dropped, dropped) for every document, also those without lines."""
    out = _joined(docs, rate(docs, id_col=id_col, text_col=text_col, min_docs=min_docs, min_tokens=min_tokens), id_col, text_col)
    none = F.array().cast("array<int>")
    return out.select(F.col("__own").alias(id_col), F.coalesce("__n_lines", F.lit(0)).cast("long").alias("n_lines"),
                      F.coalesce("__n_dropped", F.lit(0)).cast("long").alias("n_dropped"), F.coalesce("__dropped", none).alias("dropped"))


def clean(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """The documents without the dropped lines. A text of dropped lines only becomes empty; a null text stays null."""
    out = _joined(docs, rate(docs, id_col=id_col, text_col=text_col, min_docs=min_docs, min_tokens=min_tokens), id_col, text_col)
    parts = F.filter(F.split(text_col, "\n"), lambda x, i: ~F.array_contains("__dropped", i))
    text = F.when(F.coalesce(F.col("__n_dropped"), F.lit(0)) > 0, F.array_join(parts, "\n")).otherwise(F.col(text_col))
    return out.select(*[text.alias(c) if c == text_col else F.col(c) for c in docs.columns])
