"""Benchmark decontamination: a prefix-filtered set join of item windows with documents.

The tokens are short word shingles. They are ordered by how often the documents hold them, and each window is
joined on its rarest one: as containment must be total, one token is prefix enough. The token's place in the
window bounds where the window can start and end in the document; the words there are compared in full.

Only DataFrame functions are used. Documents are scanned twice for tokens (frequencies, then the join) and once to
count words. While the windows are few and small enough to be sent out, no text is shuffled, only found windows are.
Beyond that the places of tokens are shuffled without their texts, and only texts with a window's token at a possible
place are brought to it.

Null and empty texts have no words. Rows that share an id are told apart by their texts; equal rows get equal
results. Items with no words are ignored, repeated items count once. Other columns are kept; one named like a
result column gives way to it.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from offerlens.llm.scratch import Scratch, small_side

#: ASCII letters, digits and all beyond ASCII; capitals are among them, as they are lower-cased first. The other
#: characters are listed one by one: such a class is one lookup per character, a class of ranges is a chain of tests.
WORD = "[^" + "".join(f"\\x{i:02X}" for i in range(128) if not chr(i).isalnum()) + "]++"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOKEN_WORDS = 3
RESULT = ("n_words", "n_hit", "items", "contaminated")
BROADCAST_ROWS = 2_000_000  # windows or tokens that are sent out at most,
BROADCAST_BYTES = 256 << 20  # and their bytes


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def _token(words: Column | str, at: Column, n: int) -> Column:
    """Hash of the n words from ``at``."""
    words = F.col(words) if isinstance(words, str) else words
    return F.xxhash64(*[words[at + i] for i in range(n)])


def lowered(text: Column) -> Column:
    """Text whose every character is lower-cased by itself, so that equal words give equal words wherever they stand.
    Of all characters only the capital sigma depends on its neighbours. More words may become equal than by the rule for
    A-Z, never fewer; the words themselves are compared in the end."""
    return F.lower(F.replace(text, F.lit("\u03A3"), F.lit("\u03C3")))


def windows(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(item_id, n, words, lower): every window of every item, once."""
    split = items.select(
        F.col(id_col).alias("item_id"), words_of(F.translate(text_col, UPPER, LOWER)).alias("words"),
    ).where(F.size("words") > 0).withColumn("n", F.least(F.lit(window), F.size("words")))
    cut = split.withColumn("at", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("n"))))
    part = F.slice("words", F.col("at") + 1, F.col("n"))
    return cut.select("item_id", "n", F.array_join(part, " ").alias("phrase")).distinct()


def _tokens(win: DataFrame) -> DataFrame:
    """(item_id, n, phrase, size, offset, token) for every token of every window."""
    low = win.withColumn("low", F.split(lowered(F.col("phrase")), " "))
    low = low.withColumn("size", F.least(F.lit(TOKEN_WORDS), F.col("n")))
    low = low.withColumn("offset", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("size"))))
    token = F.lit(None).cast("long")
    for n in range(1, TOKEN_WORDS + 1):
        token = F.when(F.col("size") == n, _token("low", F.col("offset"), n)).otherwise(token)
    return low.select("item_id", "n", "phrase", "size", "offset", token.alias("token"))


def _bytes(df: DataFrame, column: str) -> int:
    return df.agg(F.coalesce(F.sum(F.octet_length(F.col(column).cast("string")) + 64), F.lit(0))).first()[0]


def _places(docs: DataFrame, size: int, keep: list[str]) -> DataFrame:
    """One row per place of a ``size``-word token in the documents, with the columns ``keep``."""
    place = docs.select(*keep, "low", F.posexplode("low").alias("place", "word"))
    place = place.where(F.col("place") + size <= F.size("low"))
    return place.withColumn("token", _token("low", F.col("place"), size)).drop("word", "low")


def occurrences(
    docs: DataFrame, items: DataFrame, *, key: list[str], text_col: str = "text", item_col: str = "item_id",
    item_text: str = "text", window: int = 10, scratch: Scratch,
) -> DataFrame:
    """(*key, start, end, item_id): every place where a window of an item stands in a document."""
    tokens = scratch.keep(_tokens(windows(items, item_col, item_text, window)))
    sizes = [r["size"] for r in tokens.select("size").distinct().orderBy("size").collect()]  # at most TOKEN_WORDS
    text = F.col(text_col)
    split = docs.select(*key, words_of(lowered(text)).alias("low"), words_of(text).alias("words"))
    known = tokens.select("size", "token").distinct()
    n_known = known.count()
    few = lambda df, rows, c: small_side(df, rows, BROADCAST_ROWS) if _bytes(df, c) <= BROADCAST_BYTES else df
    found = None
    counts = [
        _places(split.select("low"), size, [])
        .join(few(known.where(F.col("size") == size).select("token"), n_known, "token"), "token")
        .groupBy("token").agg(F.count("*").alias("uses")).withColumn("size", F.lit(size))
        for size in sizes
    ]
    if not counts:
        return split.select(*key).limit(0).select(
            *key, F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit(None).cast("long").alias("item_id"))
    uses = counts[0]
    for more in counts[1:]:
        uses = uses.unionByName(more)
    # a window whose rarest token is in no document is in none
    rated = tokens.join(uses, ["size", "token"], "left").withColumn("uses", F.coalesce("uses", F.lit(0)))
    rarest = rated.groupBy("item_id", "n", "phrase").agg(
        F.min_by(F.struct("size", "offset", "token"), F.struct("uses", "offset")).alias("rarest"), F.min("uses").alias("uses"),
    ).where("uses > 0").select("item_id", "n", "phrase", "rarest.*")
    rarest = scratch.keep(rarest)
    n_windows = rarest.count()
    sent = n_windows <= BROADCAST_ROWS and _bytes(rarest, "phrase") <= BROADCAST_BYTES
    start = F.col("place") - F.col("offset")
    there = F.translate(F.array_join(F.slice("words", start + 1, F.col("n")), " "), UPPER, LOWER)
    for size in sizes:
        side = rarest.where(F.col("size") == size).drop("size")
        if sent:
            side = side.hint("broadcast")
            spots = _places(split, size, [*key, "words"])
            hits = spots.join(side, (spots["token"] == side["token"]) & (start >= 0) & (start + F.col("n") <= F.size("words"))
                              & (there == F.col("phrase")))
        else:
            spots = _places(split.withColumn("n_words", F.size("low")), size, [*key, "n_words"])
            near = spots.join(side, (spots["token"] == side["token"]) & (start >= 0) & (start + F.col("n") <= F.col("n_words")))
            near = near.select(*[F.col(c).alias(f"_{c}") for c in key], "place", "offset", "n", "phrase", "item_id")
            met = F.lit(True)
            for c in key:
                met = met & F.col(c).eqNullSafe(F.col(f"_{c}"))
            hits = near.join(split.select(*key, "words"), met & (there == F.col("phrase")))
        hits = hits.select(*key, start.alias("start"), (start + F.col("n")).alias("end"), "item_id")
        found = hits if found is None else found.unionByName(hits)
    return found


def _covered(spans: Column) -> Column:
    """Words inside the union of (start, end) spans."""
    step = lambda acc, x: F.struct(
        F.greatest(acc["end"], x["end"]).alias("end"),
        (acc["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["start"], acc["end"]))).alias("n"),
    )
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    return F.aggregate(F.array_sort(spans), zero, step, lambda acc: acc["n"])


def decontaminate(
    docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text: str = "text", window: int = 10,
) -> DataFrame:
    """The document columns plus n_words, n_hit, items (sorted ids as text) and contaminated, one row per document.

    A word is hit when it lies in an occurrence of a window: ``window`` consecutive words of an item, or all
    words of a shorter one. A document's hits are gathered in one row, which its own length bounds.
    """
    scratch = Scratch(docs.sparkSession)
    # the text's own hash joins results back, so texts are not shuffled for it and repeated ids stay apart
    key = ["__id", "__key"]
    own = docs.withColumns({"__id": F.col(id_col), "__key": F.xxhash64(F.coalesce(text_col, F.lit("")))})
    spots = occurrences(own, items, key=key, text_col=text_col, item_col=item_col, item_text=item_text, window=window,
                        scratch=scratch)
    per = spots.groupBy(*key).agg(
        F.collect_set(F.struct("start", "end")).alias("spans"),
        F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("__items"),
    ).select(F.col("__id").alias("__hit_id"), F.col("__key").alias("__hit_key"), _covered(F.col("spans")).alias("__n_hit"), "__items")
    own = own.withColumn("__n_words", F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)))
    out = own.join(per, F.col("__id").eqNullSafe(F.col("__hit_id")) & (F.col("__key") == F.col("__hit_key")), "left")
    return out.select(
        *[c for c in docs.columns if c not in RESULT], F.col("__n_words").cast("long").alias("n_words"),
        F.coalesce("__n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("__items", F.array().cast("array<string>")).alias("items"),
        (F.coalesce("__n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents without any hit, with their own columns."""
    held = docs.withColumn("__row", F.struct(*docs.columns))
    return decontaminate(held, items, **options).where(~F.col("contaminated")).select("__row.*")
