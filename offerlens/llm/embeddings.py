"""Near-duplicate embeddings by PCA-ordered, tiled comparison inside labels.

All vectors are scaled to length 1 and turned onto the principal axes of the whole table, so that the leading
coordinates hold most of their length. Vectors of a label are cut into tiles of neighbours along the leading axes.
Two tiles are compared only when their boxes on these axes are near enough to hold a pair at the threshold. A
comparison adds up products of leading coordinates in blocks; after each block the rest is bounded by the product of the
suffix norms, and it stops when no pair of the two tiles can reach the threshold any more.

Equal vectors are one class with a count before anything is compared; a class of any size costs one row. A task gets
two tiles at a time. It returns link counts per class, and of the links those that keep the two tiles' components: one
tree edge per class at most. So a hot label is many tile pairs and a large group of near copies few rows.

Vectors that are null, zero, or hold null or non-finite components, and those without a label, link with nothing.
Vectors of different lengths don't link. Repeated ids are nodes of their own for counting, one node for components.
Other columns are ignored. An empty table gives an empty result.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from offerlens.llm.components import components
from offerlens.llm.scratch import Scratch

TILE = 512          # vectors in a tile
RUN = 16 * TILE     # vectors that are cut into tiles together
PAIRS = 16          # tile pairs, of two tiles' vectors each, in an Arrow batch
BLOCK = 16          # coordinates added between two looks at the bound
BOX = 8             # axes of a tile's box
SLACK = 1e-9        # for rounding in the bounds; the last product decides alone


def _units(batch_column) -> tuple[np.ndarray, list[np.ndarray]]:
    """(usable rows, unit vectors in double precision)."""
    good, out = [], []
    for i, x in enumerate(batch_column):
        v = x.values
        if v is None or not len(v) or v.null_count:
            continue
        v = v.to_numpy(zero_copy_only=False).astype(np.float64)
        top = np.abs(v).max()
        if not np.isfinite(v).all() or not top:
            continue
        v = v / top  # no overflow in the squares
        good.append(i)
        out.append(v / np.sqrt((v * v).sum()))
    return np.array(good, int), out


def _unit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good, units = _units(batch.column(2))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(good)), batch.column(1).take(pa.array(good)),
             pa.array([len(u) for u in units], pa.int32()), pa.array([u.tobytes() for u in units], pa.binary())],
            names=["id", "label", "dim", "unit"])


def _gram_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        dims = batch.column(0).to_numpy()
        for d in np.unique(dims):
            x = np.stack([np.frombuffer(u.as_py()) for u, k in zip(batch.column(1), dims, strict=True) if k == d])
            sums[int(d)] = sums.get(int(d), 0) + x.T @ x
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())],
                                         names=["dim", "gram"])


def _sum_grams(key, table):
    total = sum(np.frombuffer(g.as_py()) for g in table["gram"])
    d = key[0].as_py()
    _, axes = np.linalg.eigh(total.reshape(d, d))
    return pa.table({"dim": pa.array([d], pa.int32()), "axes": pa.array([np.ascontiguousarray(axes[:, ::-1]).tobytes()], pa.binary())})


def _turned(axes: dict[int, np.ndarray]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.frombuffer(u.as_py()) @ axes[d] for d, u in zip(batch.column(2).to_pylist(), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array([float(x[0]) for x in out], pa.float64()), pa.array([x.tobytes() for x in out], pa.binary()), batch.column(4)],
                names=["id", "label", "dim", "lead", "vec", "copies"])

    return rows


def _halves(x: np.ndarray, rows: np.ndarray, axis: int = 0) -> list[np.ndarray]:
    """Tiles by halving along the axis of the widest spread among the box axes."""
    if len(rows) <= TILE:
        return [rows]
    spread = np.ptp(x[rows][:, :BOX], axis=0)
    order = rows[np.argsort(x[rows, int(np.argmax(spread))], kind="stable")]
    cut = len(order) // 2
    return _halves(x, order[:cut]) + _halves(x, order[cut:])


def _tile_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut sorted (label, dim, lead) rows into tiles; a run never holds more than RUN vectors."""
    held: list[dict] = []

    def cut(group: list[dict]) -> pa.RecordBatch:
        x = np.stack([np.frombuffer(r["vec"]) for r in group])
        tiles = _halves(x, np.arange(len(group)))
        box = [np.pad(x[t], ((0, 0), (0, max(0, BOX - x.shape[1]))))[:, :BOX] for t in tiles]
        pack = lambda parts: pa.array([np.ascontiguousarray(p).tobytes() for p in parts], pa.binary())
        name = lambda i, v: int.from_bytes(hashlib.blake2b(i.tobytes() + v.tobytes(), digest_size=8).digest(), "little", signed=True)
        ids, copies = np.array([r["id"] for r in group], np.int64), np.array([r["copies"] for r in group], np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array([group[0]["label"]] * len(tiles), pa.int64()), pa.array([group[0]["dim"]] * len(tiles), pa.int32()),
             pa.array([name(ids[t], x[t]) for t in tiles], pa.int64()),
             pa.array([b.min(axis=0).tolist() for b in box], pa.list_(pa.float64())), pa.array([b.max(axis=0).tolist() for b in box], pa.list_(pa.float64())),
             pack([ids[t] for t in tiles]), pack([copies[t] for t in tiles]), pack([x[t] for t in tiles])],
            names=["label", "dim", "tile", "low", "high", "ids", "copies", "vecs"])

    for batch in batches:
        for r in batch.to_pylist():
            if held and (len(held) == RUN or (r["label"], r["dim"]) != (held[0]["label"], held[0]["dim"])):
                yield cut(held)
                held = []
            held.append(r)
    if held:
        yield cut(held)


def linked(x: np.ndarray, y: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(row of x, row of y) of all pairs with a product of at least ``least``, in blocks of leading coordinates."""
    d = x.shape[1]
    rest = lambda a: np.sqrt(np.cumsum((a**2)[:, ::-1], axis=1)[:, ::-1])  # noqa: E731  norms of the suffixes
    sx, sy = rest(x), rest(y)
    total = np.zeros((len(x), len(y)))
    for a in range(0, d, BLOCK):
        b = min(a + BLOCK, d)
        total += x[:, a:b] @ y[:, a:b].T
        if b < d:
            can = total + sx[:, b][:, None] * sy[:, b] >= least - SLACK
            n = np.count_nonzero(can)
            if not n:
                return np.zeros(0, int), np.zeros(0, int)
            if n * 8 < can.size:  # finish the few that are left
                i, j = np.nonzero(can)
                ok = [np.zeros(0, bool)]
                for p in range(0, n, 1 << 16):
                    ok.append((x[i[p: p + (1 << 16)]] * y[j[p: p + (1 << 16)]]).sum(axis=1) >= least)
                ok = np.concatenate(ok)
                return i[ok], j[ok]
    return np.nonzero(total >= least)


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """For each of n local nodes the smallest node of its component."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        np.minimum.at(new, root[i], least)
        np.minimum.at(new, root[j], least)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _pair_rows(least: float):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                same = r["tile"] == r["tile2"]
                d = r["dim"]
                ids, copies = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["copies"], np.int64)
                ids2, copies2 = np.frombuffer(r["ids2"], np.int64), np.frombuffer(r["copies2"], np.int64)
                i, j = linked(np.frombuffer(r["vecs"]).reshape(-1, d), np.frombuffer(r["vecs2"]).reshape(-1, d), least)
                if same:
                    off = i != j
                    i, j = i[off], j[off]
                if not len(i):
                    continue
                node = np.concatenate([ids, ids2])
                count = np.bincount(i, copies2[j], len(ids)).astype(np.int64)
                count2 = np.zeros(len(ids2), np.int64) if same else np.bincount(j, copies[i], len(ids2)).astype(np.int64)
                order = np.argsort(node, kind="stable")  # roots are the smallest ids
                rank = np.empty(len(node), np.int64)
                rank[order] = np.arange(len(node))
                base = 0 if same else len(ids)
                root = _forest(rank[i], rank[j + base], len(node))
                total = np.concatenate([count, count2])
                use = total > 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node[use]), pa.array(total[use]), pa.array(node[order][root[rank[use]]])], names=["node", "links", "root"])

    return rows


def near_duplicates(
    rows: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.98,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per vector. ``least`` is the least cosine of a link (above 0)."""
    if not 0 < least <= 1:
        raise ValueError("the threshold must be in (0, 1]")
    spark = rows.sparkSession
    scratch = Scratch(spark)
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("vec"))
    usable = rows.where("label IS NOT NULL AND id IS NOT NULL")
    units = scratch.keep(usable.mapInArrow(_unit_rows, "id long, label long, dim int, unit binary"))
    member = scratch.keep(units.select("id", "label", "dim", F.sha2("unit", 256).alias("mark")))
    # equal vectors of a label are a class, named by its smallest id
    grams = units.select("dim", "unit").mapInArrow(_gram_rows, "dim int, gram binary")
    axes = grams.groupBy("dim").applyInArrow(_sum_grams, "dim int, axes binary").collect()  # dim x dim values per dimension
    axes = {r["dim"]: np.frombuffer(r["axes"]).reshape(r["dim"], r["dim"]) for r in axes}
    classes = scratch.keep(member.groupBy("label", "dim", "mark").agg(F.min("id").alias("rep"), F.count("*").alias("copies")))
    single = units.withColumn("mark", F.sha2("unit", 256)).join(classes, ["label", "dim", "mark"]).where("id = rep")
    single = single.dropDuplicates(["label", "dim", "mark"]).select("id", "label", "dim", "unit", "copies")
    turned = single.mapInArrow(_turned(axes), "id long, label long, dim int, lead double, vec binary, copies long")
    ranged = turned.repartitionByRange("label", "dim", "lead").sortWithinPartitions("label", "dim", "lead", "id")
    tiles = scratch.keep(ranged.mapInArrow(
        _tile_rows, "label long, dim int, tile long, low array<double>, high array<double>, ids binary, copies binary, vecs binary"))
    # unit vectors at the threshold are at most `reach` apart, so on each axis as well: cells of that width find the tiles
    reach = float(np.sqrt(2 - 2 * least)) + SLACK
    cell = lambda c, axis: F.floor(F.col(c)[axis] / reach)
    spread = lambda more: F.explode(F.flatten(F.transform(
        F.sequence(cell("low", 0) - more, cell("high", 0) + more),
        lambda p: F.transform(F.sequence(cell("low", 1) - more, cell("high", 1) + more), lambda q: F.struct(p.alias("p"), q.alias("q"))))))
    boxes = tiles.select("label", "dim", "tile", "low", "high")
    gap = F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(BOX)), lambda k: F.pow(F.greatest(
        F.lit(0.0), F.element_at("low", k) - F.element_at("high2", k), F.element_at("low2", k) - F.element_at("high", k)), F.lit(2.0))),
        F.lit(0.0), lambda a, b: a + b)
    left = boxes.withColumn("at", spread(0))
    right = boxes.select("label", "dim", *[F.col(c).alias(f"{c}2") for c in ("tile", "low", "high")], spread(1).alias("at"))
    pairs = left.join(right, ["label", "dim", "at"]).where((F.col("tile") <= F.col("tile2")) & (gap <= reach * reach)).select(
        "label", "dim", "tile", "tile2").distinct()
    body = tiles.select("label", "dim", "tile", "ids", "copies", "vecs")
    other = body.select("label", "dim", *[F.col(c).alias(f"{c}2") for c in ("tile", "ids", "copies", "vecs")])
    work = pairs.join(body, ["label", "dim", "tile"]).join(other, ["label", "dim", "tile2"])
    found = scratch.keep(work.mapInArrow(_pair_rows(least), "node long, links long, root long"), batch_rows=PAIRS)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    several = member.join(classes, ["label", "dim", "mark"]).select("id", "rep", "copies")
    placed = scratch.keep(several)
    edges = found.where("node != root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    twice = placed.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("last")).where("a < last").select("id", "a")
    edges = edges.unionByName(placed.join(twice, "id").select("a", F.col("rep").alias("b")).where("a < b"))
    comp = scratch.keep(components(edges, scratch))
    own = placed.join(links.withColumnRenamed("node", "rep"), "rep", "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    own = own.groupBy("id").agg(F.max(F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                                F.min(F.coalesce("component", "rep")).alias("component_id"))
    out = rows.select("id").join(own, "id", "left").select(
        F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
