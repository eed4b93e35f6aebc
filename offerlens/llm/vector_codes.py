"""Vector code compression: integer product quantization with adaptive distance bounds.

A vector's components become integers, its consecutive parts are replaced by the nearest of at most 256 codebook entries.
Between rounds every part keeps, in the spirit of Drake and Hamerly, its b closest other entries with a lower bound for
each, in order of the bounds, and one outer bound for all remaining entries. When the codebooks have moved, bounds shrink by
the moves. Entries whose bound is above the exact distance to the present entry can't be nearer; the few others are
verified in integers, and only parts whose outer bound is passed are compared with all entries. b follows the numbers of
entries that had to be verified.

Each round reads the state once, writes it anew, and sums the parts of each entry: a task sends one row per entry. What
comes to the driver and is sent out is a codebook: at most 256 entries of one vector's length.

Vectors that are null or hold null or non-finite components are dropped. All others get a code: one shorter than the
longest, or than a multiple of the parts, is read as if zeros followed. Components are clamped to 2^27 units, so that
squared distances fit a long. Fewer vectors than entries give fewer entries. The first entries are those of the smallest ids,
null ids last, equal ids by their vectors. Repeated rows stay. Null labels sum together. Other columns, also ones with
the names of results, are dropped unless kept.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from offerlens.llm.scratch import Scratch, small_side

ENTRIES = 256
MOST = 1 << 27            # largest component, in units
FIRST_B, LEAST_B = 32, 4  # entries whose bounds are kept at first, and at least
COVERED = 0.98            # share of parts for which b entries were enough, when b is adapted
EXACT = 2.0**52           # below this, sums of products of whole doubles are exact
BROADCAST_LABELS = 200_000
STATE = "code binary, near binary, lower binary, outer binary, used binary"


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of x to all entries."""
    high = float(max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)))
    if 4 * high * high * max(1, x.shape[1]) < EXACT:
        fx, fc = x.astype(np.float64), c.astype(np.float64)
        return ((fx * fx).sum(1)[:, None] - 2 * (fx @ fc.T) + (fc * fc).sum(1)).astype(np.int64)
    return np.stack([((x - e) ** 2).sum(1) for e in c], axis=1)


def _below(squares: np.ndarray) -> np.ndarray:
    """Single-precision lower bounds of the roots."""
    return np.nextafter(np.sqrt(squares.astype(np.float64)).astype(np.float32), np.float32(-np.inf))


def compare_all(x: np.ndarray, c: np.ndarray, b: int):
    """(entry, near, lower, outer) of every row from all distances. Ties go to the lower index."""
    d = _squares(x, c)
    at, k = np.arange(len(x)), len(c)
    entry = d.argmin(1)
    d[at, entry] = -1  # sorts first
    b = min(b, k - 1)
    outer = np.full(len(x), np.inf, np.float32)
    if b + 1 < k:
        some = np.argpartition(d, b + 1, axis=1)[:, : b + 2]
        values = np.take_along_axis(d, some, 1)
        order = values.argsort(1, kind="stable")
        some, values = np.take_along_axis(some, order, 1), np.take_along_axis(values, order, 1)
        outer = _below(values[:, b + 1])
    else:
        some = d.argsort(1, kind="stable")
        values = np.take_along_axis(d, some, 1)
    return entry, some[:, 1: b + 1], _below(values[:, 1: b + 1]), outer


def compare_some(x: np.ndarray, c: np.ndarray, moved: np.ndarray, b: int, entry, near, lower, outer):
    """The same after the entries moved, from the bounds of the round before, and how many entries each row verified
    (b + 1: all)."""
    b = min(b, near.shape[1])
    outer = np.minimum(outer, lower[:, b:].min(1, initial=np.inf))
    near, lower = near[:, :b].copy(), lower[:, :b].astype(np.float64)
    lower = np.nextafter((lower - moved[near] if b else lower).astype(np.float32), np.float32(-np.inf))
    outer = np.nextafter((outer - moved.max(initial=0)).astype(np.float32), np.float32(-np.inf))
    own = ((x - c[entry]) ** 2).sum(1)
    upper = np.sqrt(own.astype(np.float64)) * (1 + 1e-12)
    open_ = lower <= upper[:, None]
    used = open_.sum(1)
    everywhere = outer <= upper
    # verify the open entries of rows whose outer bound holds
    row, slot = np.nonzero(open_ & ~everywhere[:, None])
    exact = np.full(near.shape, np.iinfo(np.int64).max)
    exact[row, slot] = ((x[row] - c[near[row, slot]]) ** 2).sum(1)
    lower[row, slot] = _below(exact[row, slot])
    least = np.minimum(own, exact.min(1, initial=np.iinfo(np.int64).max))
    best = np.minimum(np.where(own == least, entry, ENTRIES), np.where(exact == least[:, None], near, ENTRIES).min(1, initial=ENTRIES))
    changed = np.flatnonzero((best != entry) & ~everywhere)
    if len(changed):
        slot = (near[changed] == best[changed, None]).argmax(1)
        near[changed, slot] = entry[changed]
        lower[changed, slot] = _below(own[changed])
    entry = np.where(everywhere, entry, best)
    again = np.flatnonzero(everywhere)
    if len(again):
        entry[again], near[again], lower[again], outer[again] = compare_all(x[again], c, b)
        used[again] = b + 1
    order = lower.argsort(1, kind="stable")
    return entry, np.take_along_axis(near, order, 1), np.take_along_axis(lower, order, 1), outer, used


def _stacked(column: pa.Array, kind, shape) -> np.ndarray:
    """Rows of binaries of one length, or of lists, as one array."""
    if pa.types.is_list(column.type):
        return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(shape)
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(shape)


def _binaries(values: np.ndarray) -> pa.Array:
    rows = len(values)
    width = values.nbytes // rows if rows else 0
    return pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(np.arange(rows + 1, dtype=np.int32) * width),
                                                     pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def _pass(state: DataFrame, codebook: np.ndarray, moved: np.ndarray | None, b_before: int, b: int) -> DataFrame:
    """Assign all parts; ``codebook`` is (parts, entries, length). The last pass asks for ``error`` alone."""
    parts, k, length = codebook.shape
    book, moves = state.sparkSession.sparkContext.broadcast(codebook), moved
    b, kept = min(b, k - 1), [f for f in state.schema if f.name not in ("code", "near", "lower", "outer", "used", "error")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = _stacked(batch.column("units"), np.int64, (n, parts, length))
            entry, used = np.zeros((n, parts), np.uint8), np.zeros((n, parts), np.uint8)
            near, lower, outer = np.zeros((n, parts, b), np.uint8), np.zeros((n, parts, b), np.float32), np.zeros((n, parts), np.float32)
            error = np.zeros(n, np.int64)
            if moves is not None:
                before = [_stacked(batch.column(c), t, (n, parts, *w)) for c, t, w in (
                    ("code", np.uint8, ()), ("near", np.uint8, (b_before,)), ("lower", np.float32, (b_before,)), ("outer", np.float32, ()))]
            for p in range(parts):
                c = book.value[p]
                if moves is None:
                    found = (*compare_all(x[:, p], c, b), np.full(n, b + 1))
                else:
                    e, m, w, o = (z[:, p] for z in before)
                    found = compare_some(x[:, p], c, moves[p], b, e.astype(np.int64), m.astype(np.int64), w, o)
                entry[:, p], near[:, p], lower[:, p], outer[:, p], used[:, p] = found
                error += ((x[:, p] - c[entry[:, p]]) ** 2).sum(1)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name) for f in kept), *map(_binaries, (entry, near, lower, outer, used)), pa.array(error)],
                names=[*(f.name for f in kept), "code", "near", "lower", "outer", "used", "error"])

    return state.mapInArrow(rows, "".join(f"{f.name} {f.dataType.simpleString()}, " for f in kept) + STATE + ", error long")


def _sums(state: DataFrame, shape: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(counts, sums) of the parts of every entry, and how many parts verified how many entries. A task sends
    a row per entry."""
    parts, k, length = shape

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros((parts, k), np.int64), np.zeros((parts, k, length), np.int64)
        tried = np.zeros(ENTRIES + 1, np.int64)
        for batch in batches:
            n = batch.num_rows
            x, code = _stacked(batch.column("units"), np.int64, (n, parts, length)), _stacked(batch.column("code"), np.uint8, (n, parts))
            tried += np.bincount(_stacked(batch.column("used"), np.uint8, (-1,)), minlength=ENTRIES + 1)
            for p in range(parts):
                count[p] += np.bincount(code[:, p], minlength=k)
                np.add.at(total[p], code[:, p], x[:, p])
        p, e = np.nonzero(count)
        t = np.flatnonzero(tried)
        empty = [np.zeros(length, np.int64)] * len(t)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.r_[p, np.full(len(t), -1)].astype(np.int32)), pa.array(np.r_[e, t].astype(np.int32)),
             pa.array(np.r_[count[p, e], tried[t]]), pa.array([*total[p, e], *empty], pa.list_(pa.int64()))],
            names=["part", "entry", "n", "sums"])

    per = state.select("units", "code", "used").mapInArrow(rows, "part int, entry int, n long, sums array<long>")
    total = per.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(length)])
    count, sums, tried = np.zeros((parts, k), np.int64), np.zeros(shape, np.int64), np.zeros(ENTRIES + 1, np.int64)
    for r in total.collect():  # at most parts x entries and as many counts
        if r["part"] < 0:
            tried[r["entry"]] = r["n"]
        else:
            count[r["part"], r["entry"]] = r["n"]
            sums[r["part"], r["entry"]] = [r[f"s{i}"] for i in range(length)]
    return count, sums, tried


def units(vectors: DataFrame, vec_col: str, parts: int, scale: int, keep: list[str]) -> tuple[DataFrame, int]:
    """(kept columns and ``units`` of the vectors that can be coded, length of ``units``)."""
    vec = F.col(vec_col).cast("array<double>")
    sound = vec.isNotNull() & ~F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ok = vectors.where(F.coalesce(sound, F.lit(False)))
    longest = ok.agg(F.max(F.size(vec_col))).first()[0] or 0
    length = -(-longest // parts) * parts
    whole = F.transform(vec, lambda x: F.floor(F.greatest(F.lit(float(-MOST)), F.least(F.lit(float(MOST)), x * scale))).cast("int"))
    padded = F.concat(whole, F.array_repeat(F.lit(0), F.lit(length) - F.size(whole)))
    return ok.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], padded.alias("units")), length


def quantize(
    vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", keep: list[str] | None = None,
    parts: int = 4, rounds: int = 4, scale: int = 1024,
) -> tuple[DataFrame, np.ndarray]:
    """(the columns ``keep`` (the id) plus code (binary, a byte per part), error and label_error; the codebooks).

    ``error`` is the squared distance of the vector's units to its entries, ``label_error`` its sum over the label.
    """
    spark = vectors.sparkSession
    keep = [id_col] if keep is None else keep
    scratch = Scratch(spark)
    state, length = units(vectors, vec_col, parts, scale, [id_col, label_col, *keep])
    seeds = state.orderBy(F.col("c0").asc_nulls_last(), "units").limit(ENTRIES).select("units").collect()
    book = np.array([r["units"] for r in seeds], np.int64).reshape(len(seeds), parts, length // parts).transpose(1, 0, 2)
    moved, b_before, b = None, 0, FIRST_B
    for _ in range(rounds if seeds else 0):
        after = scratch.keep(_pass(state, book, moved, b_before, b))
        if moved is not None:
            scratch.drop(state)
        state, b_before = after, min(b, book.shape[1] - 1)
        count, sums, tried = _sums(state, book.shape)
        moving = np.where(count[:, :, None] > 0, sums // np.maximum(count, 1)[:, :, None], book)
        shift = np.sqrt(((moving - book).astype(np.float64) ** 2).sum(2)) * (1 + 1e-12)
        if moved is not None:  # all were compared with all in the first round
            enough = int(np.searchsorted(np.cumsum(tried), COVERED * tried.sum()))
            b = min(b, max(LEAST_B, enough))
        book, moved = moving, shift
    columns = [F.col(f"c{i + 2}").alias(c) for i, c in enumerate(keep)]
    if not seeds:
        none = F.lit(None).cast("long")
        return state.select(*columns, F.lit(None).cast("binary").alias("code"), none.alias("error"), none.alias("label_error")), book
    coded = _pass(state, book, moved, b_before, b)
    coded = scratch.keep(coded.select(*[c for c in coded.columns if c[0] == "c"], "error"))
    scratch.drop(state)
    per = scratch.keep(coded.groupBy("c1").agg(F.sum("error").alias("label_error")))
    side = small_side(per.withColumnRenamed("c1", "_label"), per.count(), BROADCAST_LABELS)
    out = coded.join(side, F.col("c1").eqNullSafe(F.col("_label")), "left")
    return out.select(*columns, "code", "error", "label_error"), book


def codebooks_sha256(book: np.ndarray) -> str:
    """Checksum of all entries' components, by part, entry and position."""
    return hashlib.sha256(",".join(map(str, book.reshape(-1).tolist())).encode()).hexdigest()
