"""Token counts by an exact histogram of encoded lengths.

Every text is encoded whole with a byte-pair vocabulary. Documents are counted by length, which combines map-side to
one row per length, and suffix sums over the lengths answer totals, quantiles and truncated totals for every limit. The
sums are taken in two steps, inside ranges of 1024 lengths and over the ranges, so no window sees all lengths.

The encoder's regular expressions give out on very long runs of white space; a text with one is cut into its pieces
without them, and the pieces are encoded one by one.

Null and empty texts have no tokens and count at length 0. Ids and other columns are not needed. An empty table gives
an empty histogram, and zero totals at limits.
"""
from __future__ import annotations

import base64
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from offerlens.llm.bpe import pieces
from offerlens.llm.scratch import Scratch

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MOST_VOCABULARY_BYTES = 64 << 20
#: The pieces that the vocabulary was made for.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RANGE = 1024
LONG_RUN = re.compile(r"\s{50000}")
_encoders: dict[int, object] = {}


def _encoder(ranks: bytes):
    key = hash(ranks)
    if key not in _encoders:
        import tiktoken

        pairs = (line.split() for line in ranks.splitlines() if line)
        _encoders[key] = tiktoken.Encoding("pieces", pat_str=PIECES, special_tokens={},
                                           mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs})
    return _encoders[key]


def _length(encoder, text: str | None) -> int:
    if not text:
        return 0
    if len(text) < 50_000 or not LONG_RUN.search(text):
        return len(encoder.encode_ordinary(text))
    data, starts, _ = pieces([text])
    single = encoder._core_bpe.encode_single_piece
    return sum(len(single(data[a:b])) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True))


def lengths(docs: DataFrame, *, text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """The document columns plus n_tokens; a column of that name gives way."""
    spark = docs.sparkSession
    found = spark.read.format("binaryFile").load(vocabulary).select("length", "content").first()
    if found["length"] > MOST_VOCABULARY_BYTES:
        raise ValueError("the vocabulary is too large to be sent to every executor")
    ranks = spark.sparkContext.broadcast(bytes(found["content"]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks.value)
        for batch in batches:
            counts = [_length(encoder, x.as_py()) for x in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64())], names=[*batch.schema.names, "n_tokens"])

    kept = [c for c in docs.columns if c != "n_tokens"]
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*kept).schema)
    rowed = docs.select(*kept, F.col(text_col).cast("string").alias("_encoded_text"))
    return rowed.mapInArrow(rows, f"{kinds}`_encoded_text` string, n_tokens long").drop("_encoded_text")


def histogram(counted: DataFrame, length_col: str = "n_tokens") -> DataFrame:
    """(n_tokens, n_docs)."""
    return counted.groupBy(F.col(length_col).alias("n_tokens")).agg(F.count("*").alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """Add, for every length L that occurs: docs_ge and tokens_ge (documents of L or more, and their tokens),
    truncated_total (all tokens when texts are cut at L) and share_le (of documents with at most L).

    The histogram is written first: it is read twice, and encoding the texts again would cost most."""
    hist = Scratch(hist.sparkSession).keep(hist)
    rows = hist.withColumn("range", F.floor(F.col("n_tokens") / RANGE)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    up = Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    ranges = rows.groupBy("range").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    ranges = ranges.select("range", F.coalesce(F.sum("d").over(up), F.lit(0)).alias("docs_above"), F.coalesce(F.sum("t").over(up), F.lit(0)).alias("tokens_above"),
                           F.sum("d").over(every).alias("all_docs"), F.sum("t").over(every).alias("all_tokens"))
    own = Window.partitionBy("range").orderBy(F.desc("n_tokens"))
    out = rows.join(ranges, "range").withColumns({
        "docs_ge": F.col("docs_above") + F.sum("n_docs").over(own), "tokens_ge": F.col("tokens_above") + F.sum("tokens").over(own)})
    return out.select(
        "n_tokens", "n_docs", "docs_ge", "tokens_ge",
        (F.col("all_tokens") - F.col("tokens_ge") + F.col("n_tokens") * F.col("docs_ge")).alias("truncated_total"),
        ((F.col("all_docs") - F.col("docs_ge") + F.col("n_docs")) / F.col("all_docs")).alias("share_le"))


def at_limits(sums: DataFrame, limits: Sequence[int]) -> DataFrame:
    """(limit, total, truncated_total, docs_over) for any context limits, from the suffix sums alone."""
    every = [F.coalesce(F.max("tokens_ge"), F.lit(0)).alias("total")]
    for i, limit in enumerate(limits):
        # the sums fall with the length, so the largest of those beyond the limit belongs to the next length that occurs
        over = F.col("n_tokens") > limit
        every += [F.coalesce(F.max(F.when(over, F.col("tokens_ge"))), F.lit(0)).alias(f"t{i}"), F.coalesce(F.max(F.when(over, F.col("docs_ge"))), F.lit(0)).alias(f"d{i}")]
    rows = F.array(*[F.struct(F.lit(int(limit)).cast("long").alias("limit"), "total",
                              (F.col("total") - F.col(f"t{i}") + limit * F.col(f"d{i}")).alias("truncated_total"),
                              F.col(f"d{i}").alias("docs_over")) for i, limit in enumerate(limits)])
    return sums.agg(*every).select(F.inline(rows))


def quantiles(sums: DataFrame, shares: Sequence[float]) -> DataFrame:
    """(share, n_tokens): the least length that at least this share of documents doesn't exceed."""
    found = [F.min(F.when(F.col("share_le") >= q, F.col("n_tokens"))).alias(f"q{i}") for i, q in enumerate(shares)]
    rows = F.array(*[F.struct(F.lit(float(q)).alias("share"), F.col(f"q{i}").alias("n_tokens")) for i, q in enumerate(shares)])
    return sums.agg(*found).select(F.inline(rows))
