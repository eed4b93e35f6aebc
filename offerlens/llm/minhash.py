"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

Sketch: a set is thrown into ``COORDINATES`` bins in rounds. Round i puts each element into a random bin with a value
in [i, i + 1); after as many random rounds as there are bins, round COORDINATES + j puts every element into bin j.
Each bin keeps its least value, and a set is done when no bin is empty: usually after one or two rounds, always after
2 * COORDINATES. So every coordinate fills, coordinates agree with the sets' similarity as probability, and the
number that agree concentrates as for independent coordinates.

Candidates: 24 bands of 5 coordinates. A pair at similarity 0.85 shares no band with probability below 1e-6. Pairs
whose 2-bit signatures disagree in more than ``MOST_APART`` of 120 coordinates are dropped; at 0.85 fewer than 14 are
expected and more than 41 have a chance below 1e-10.

Equal sets are one class with one representative before anything is paired. In a bucket every representative is first
compared with the hub only, the set with the fewest shingles that no other candidate has. Pairs inside one component need
no further look, so only pairs of a bucket that are still in different components are looked at then. A bound leaves
few of them: two sets share at most the smaller number of their shingles found in more than ``RARE`` candidates, plus the
rarer ones that they have in common, which are counted by a join on these (at most RARE sets each). So links between
components are never missed, and a large group of near copies costs about one comparison per member, also
where many of its members are too far from all others. All links are confirmed on the full shingle sets.

Null and empty texts, and texts without words, have no shingles and link with nothing. A null id links with nothing and
is its own component. Rows with one id are one node: the links of any of its texts count. Other columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from offerlens.llm import words
from offerlens.llm.components import components
from offerlens.llm.scratch import Scratch

COORDINATES = 120
BAND = 5
MOST_APART = 41
RARE = 8
_SIGN_BITS = 2
_PER_LONG = 30  # coordinates in a signature column
_SEEDS = words.mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_EMPTY = np.uint64(2**64 - 1)


def sketches(row: np.ndarray, element: np.ndarray, n: int) -> np.ndarray:
    """(n, COORDINATES) sketches of the sets given as (row, element); rows without elements stay all ones."""
    t = COORDINATES
    bins = np.full(n * t, _EMPTY, np.uint64)
    open_rows = np.zeros(n, bool)
    open_rows[row] = True
    for i in range(2 * t):
        if not len(row):
            break
        draw = words.mix(element + _SEEDS[i]) if i < t else words.mix(element ^ _SEEDS[i - t])
        value = (np.uint64(i) << np.uint64(32)) | (draw >> np.uint64(32))
        place = (((draw & np.uint64(0xFFFFFFFF)) * np.uint64(t)) >> np.uint64(32)).astype(np.int64) if i < t else i - t
        np.minimum.at(bins, row * t + place, value)
        if i < 4 or i % 8 == 7:
            unfilled = (bins.reshape(n, t) == _EMPTY).any(axis=1) & open_rows
            if not unfilled.all():
                left = unfilled[row]
                row, element, open_rows = row[left], element[left], unfilled
    return bins.reshape(n, t)


def _sets(column, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for lo, hi, data, at in words.chunks(column):
        row, start, end = words.spans(data, at, words.SPACED)
        word, = words.hashes(data, start, end)
        yield lo, hi, *words.distinct(*words.shingles(row, word, k))


def _sketch_rows(k: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, row, element in _sets(batch.column(1), k):
                n = hi - lo
                size = np.bincount(row, minlength=n)
                bins = sketches(row, element, n)
                bands = np.stack([
                    words.mix((bins[:, b: b + BAND] * words.PLACE[:BAND]).sum(axis=1, dtype=np.uint64) + np.uint64(b))
                    for b in range(0, COORDINATES, BAND)], axis=1)
                bits = words.mix(bins) & np.uint64(3)
                signs = [(bits[:, a: a + _PER_LONG] << (np.arange(_PER_LONG, dtype=np.uint64) * np.uint64(_SIGN_BITS))).sum(axis=1, dtype=np.uint64)
                         for a in range(0, COORDINATES, _PER_LONG)]
                marks = []
                for salt in (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25):
                    total = np.zeros(n, np.uint64)
                    np.add.at(total, row, words.mix(element + np.uint64(salt)))
                    marks.append(words.mix(total + size.astype(np.uint64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, n), pa.array(size.astype(np.int64)), *[pa.array(m.view(np.int64)) for m in (*marks, *signs)],
                     pa.FixedSizeListArray.from_arrays(pa.array(bands.reshape(-1).view(np.int64)), bands.shape[1]).cast(pa.list_(pa.int64()))],
                    names=["id", "n", "f1", "f2", "s0", "s1", "s2", "s3", "bands"])

    return rows


def _set_rows(k: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, row, element in _sets(batch.column(1), k):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), words.lists(row, element.view(np.int64), hi - lo)], names=["id", "elements"])

    return rows


SIGNS = ["s0", "s1", "s2", "s3"]


def _apart(left: str, right: str) -> Column:
    """Coordinates in which two signatures differ."""
    total = None
    for s in SIGNS:
        x = F.col(f"{left}{s}").bitwiseXOR(F.col(f"{right}{s}"))
        pairs = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555))
        total = F.bit_count(pairs) if total is None else total + F.bit_count(pairs)
    return total


def _possible(percent: int, shared: Column) -> Column:
    """Whether sets of a_n and b_n elements can be near with at most ``shared`` common ones, by their signatures as well."""
    return ((100 + percent) * shared >= percent * (F.col("a_n") + F.col("b_n"))) & (_apart("a_", "b_") <= MOST_APART)


def _sided(known: DataFrame, side: str) -> DataFrame:
    return known.select(*[F.col(c).alias(side if c == "rep" else f"{side}_{c}") for c in known.columns])


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs with similarity of at least ``percent`` on their full sets."""
    both = pairs.join(sets.select(F.col("rep").alias("a"), F.col("elements").alias("x")), "a")
    both = both.join(sets.select(F.col("rep").alias("b"), F.col("elements").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    both = both.select("a", "b", shared.alias("shared"), (F.size("x") + F.size("y")).alias("sizes"))
    return both.where((F.col("shared") > 0) & (100 * F.col("shared") >= percent * (F.col("sizes") - F.col("shared")))).select("a", "b").distinct()


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 85,
) -> DataFrame:
    """(id, n_shingles, component_id, kept), one row per document; links join similarities of ``percent`` or more (80 at least)."""
    if percent < 80:
        raise ValueError("bands and signatures are laid out for similarities of 0.8 and more")
    scratch = Scratch(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(docs.dtypes)["id"]
    schema = f"id {kind}, n long, f1 long, f2 long, s0 long, s1 long, s2 long, s3 long, bands array<long>"
    sketched = scratch.keep(docs.mapInArrow(_sketch_rows(shingle), schema))
    nodes = sketched.where("n > 0 AND id IS NOT NULL")
    classes = nodes.groupBy("f1", "f2").agg(F.min("id").alias("rep"))
    member = scratch.keep(nodes.select("id", "f1", "f2").join(classes, ["f1", "f2"]).select("id", "f1", "f2", "rep"))
    first = member.where("id = rep").select("f1", "f2", "rep").distinct()
    # all texts of an id, as the sets below hold them all, also those of classes that another id represents
    texts_of = member.select("id", "f1", "f2").distinct().groupBy(F.col("id").alias("rep")).agg(F.count("*").alias("texts"))
    rows = nodes.join(first.join(texts_of, "rep").withColumnsRenamed({"f1": "g1", "f2": "g2"}),
                      (F.col("f1") == F.col("g1")) & (F.col("f2") == F.col("g2")) & (F.col("id") == F.col("rep")))
    # one row per class, and below one set per text, however often an id's rows are repeated
    repeated = nodes.groupBy("id").agg(F.count("*").alias("rows")).where("rows > 1").select("id")
    repeats = not repeated.isEmpty()
    if repeats:
        rows = rows.dropDuplicates(["rep", "f1", "f2"])
        repeated = scratch.keep(repeated)
    reps = scratch.keep(rows.select("rep", "n", "texts", *SIGNS, "bands"))
    bucketed = reps.select("rep", F.explode("bands").alias("bucket")).distinct()
    crowded = bucketed.groupBy("bucket").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi").select("bucket")
    shared = scratch.keep(bucketed.join(crowded, "bucket"))
    # full sets of all representatives that have a candidate, and in how many of these sets each element is
    texts = docs.join(shared.select(F.col("rep").alias("id")).distinct(), "id", "left_semi")
    if repeats:
        again = texts.join(repeated, "id", "left_semi").withColumn("hash", F.xxhash64("text")).dropDuplicates(["id", "hash"]).drop("hash")
        texts = texts.join(repeated, "id", "left_anti").unionByName(again)
    sets = scratch.keep(texts.mapInArrow(_set_rows(shingle), f"id {kind}, elements array<long>").withColumnRenamed("id", "rep"))
    elements = sets.select("rep", F.explode("elements").alias("element")).distinct()
    uses = elements.groupBy("element").agg(F.count("*").alias("uses"))
    elements = scratch.keep(elements.join(uses, "element"))
    counts = elements.groupBy("rep").agg(F.count_if(F.col("uses") == 1).alias("own"), F.count_if(F.col("uses") > RARE).alias("common"))
    one = F.col("texts") == 1  # an id with several texts has no bounds but its size
    known = scratch.keep(reps.join(counts, "rep").select(
        "rep", "n", *SIGNS, F.when(one, F.col("own")).otherwise(0).alias("own"), F.when(one, F.col("common")).otherwise(F.col("n")).alias("common")))
    # each bucket's hub is the set with the fewest elements of its own: the likeliest original of a group of copies
    ranked = shared.join(known.select("rep", "own"), "rep")
    hubs = ranked.groupBy("bucket").agg(F.min_by("rep", F.struct("own", "rep")).alias("hub"))
    shared = scratch.keep(ranked.select("bucket", "rep").join(hubs, "bucket"))
    pairs = shared.where("rep != hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    pairs = pairs.join(_sided(known, "a"), "a").join(_sided(known, "b"), "b")
    pairs = pairs.where(_possible(percent, F.least(F.col("a_n") - F.col("a_own"), F.col("b_n") - F.col("b_own")))).select("a", "b").distinct()
    # an id with several texts is in several classes, which it joins
    several = member.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("last")).where("a < last").drop("last")
    own = member.join(several, "id").select("a", F.col("rep").alias("b")).where("a < b")
    links = _confirmed(pairs, sets, percent).unionByName(own)
    found = scratch.keep(components(links, scratch))
    # what the hubs have not joined: pairs across components, which no hub is part of
    rest = shared.where("rep != hub").join(found, F.col("rep") == F.col("node"), "left")
    rest = rest.select("bucket", "rep", F.coalesce("component", "rep").alias("component"))
    mixed = rest.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("bucket")
    rest = scratch.keep(rest.join(mixed, "bucket"))
    listed = rest.groupBy("rep", "component").agg(F.collect_list("bucket").alias("buckets"))  # one per band at most
    placed = scratch.keep(known.join(listed, "rep"))
    side = lambda p: rest.select("bucket", "rep").join(placed, "rep").select("bucket", *[F.col(c).alias(f"{p}_{c}") for c in placed.columns])
    apart = (F.col("a_rep") < F.col("b_rep")) & (F.col("a_component") != F.col("b_component"))
    common = F.least("a_common", "b_common")
    first_met = F.array_min(F.array_intersect("a_buckets", "b_buckets")) == F.col("bucket")  # a pair counts in one bucket
    across = side("a").join(side("b"), "bucket").where(apart & _possible(percent, common) & first_met).select(F.col("a_rep").alias("a"), F.col("b_rep").alias("b"))
    rare = elements.where((F.col("uses") > 1) & (F.col("uses") <= RARE)).join(placed.select("rep", "component"), "rep")
    with_rare = lambda p: rare.select("element", *[F.col(c).alias(f"{p}_{c}") for c in ("rep", "component")])
    met = with_rare("a").join(with_rare("b"), "element").where(apart).groupBy(F.col("a_rep").alias("a"), F.col("b_rep").alias("b")).agg(F.count("*").alias("met"))
    met = met.join(_sided(placed, "a"), "a").join(_sided(placed, "b"), "b").where(_possible(percent, common + F.col("met"))).select("a", "b")
    across = scratch.keep(across.unionByName(met).distinct())
    if not across.isEmpty():
        more = scratch.keep(_confirmed(across, sets, percent))
        found = scratch.keep(components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more), scratch))
    placed = member.select("id", "rep").join(found, F.col("rep") == F.col("node"), "left")
    placed = placed.groupBy("id").agg(F.min(F.coalesce("component", "rep")).alias("component_id"))
    out = sketched.select("id", F.col("n").alias("n_shingles")).join(placed, "id", "left")
    out = out.select("id", "n_shingles", F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
