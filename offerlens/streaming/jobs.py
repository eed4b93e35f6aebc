"""Streams over observation files: gate, latest, runs and daily lows."""
from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.readwriter import DataStreamWriter

from offerlens.functions import fixed_values as FV
from offerlens.schemas import COLS, Cols
from offerlens.sources.observations import parse_lines, parse_stream_lines, unsound_lines


def stream_observations(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """New observation files as they land; bad lines are dropped."""
    raw = (
        spark.readStream.format("text").option("pathGlobFilter", "*.jsonl")
        .option("maxFilesPerTrigger", max_files).load(path)
    )
    return parse_stream_lines(raw)


def land_observations(
    spark: SparkSession, path: str, out: str, checkpoint: str, archive: str | None = None, max_files: int = 1000,
    entity: Column | None = None, glob: str = "*.jsonl",
) -> DataStreamWriter:
    """Take in observation files as they land: sound lines to ``out/good``, others with their file to ``out/bad``.

    Each batch overwrites folders of its own when it is repeated, so a line is filed once. Files are taken by their time of
    change; ``seq`` is the number of the folder ``seq=N`` they lie in, if any, and orders appends whatever that time is. With
    ``archive`` Spark moves files there once their batch is committed. ``entity`` names a file's entity, by default its name.
    """
    raw = spark.readStream.format("text").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", max_files)
    if archive is not None:
        raw = raw.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    owner = F.regexp_replace(F.col("_metadata.file_name"), r"\.jsonl$", "") if entity is None else entity
    seq = F.regexp_extract(F.col("_metadata.file_path"), r"/seq=(\d+)/", 1).try_cast("long")
    lines = raw.load(path).select(
        owner.alias("entity_id"), F.struct(seq.alias("seq"), F.lit(0).cast("long").alias("line")).alias("ord"),
        F.col("_metadata.file_path").alias("file"), "value")

    def step(batch: DataFrame, batch_id: int) -> None:
        good = parse_lines(batch)
        good = good.withColumn("ord", F.struct(F.col("ord.seq").alias("seq"), F.unix_micros("obs_ts").alias("line")))
        good.write.mode("overwrite").parquet(os.path.join(out, "good", f"batch={batch_id}"))
        bad = unsound_lines(batch).select("entity_id", "file", "value")
        bad.write.mode("overwrite").parquet(os.path.join(out, "bad", f"batch={batch_id}"))

    return lines.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)


def landed_observations(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(os.path.join(out, "good")).drop("batch")


def landed_bad_lines(spark: SparkSession, out: str) -> DataFrame:
    """(entity_id, bad_lines), for entities with any."""
    return spark.read.parquet(os.path.join(out, "bad")).groupBy("entity_id").agg(F.count("*").alias("bad_lines"))


def stream_latest(obs: DataFrame, values: list[str], keys: Cols = COLS) -> DataFrame:
    """Running last record per (entity, seller); use update mode."""
    last = F.max_by(F.struct(keys.ts, *values), F.struct(keys.ts, keys.ord))
    return obs.groupBy(*keys.pair).agg(last.alias("_r")).select(*keys.pair, "_r.*")


def stream_runs(
    obs: DataFrame, gap_hours: int = FV.RUN_GAP_HOURS, late: str = "1 day", keys: Cols = COLS
) -> DataFrame:
    """Collection runs per entity as session windows; a run is final once the watermark passed."""
    session = F.session_window(keys.ts, f"{gap_hours} hours")
    return (
        obs.filter(F.col(keys.ts).isNotNull()).withWatermark(keys.ts, late)
        .groupBy(keys.entity, session.alias("w"))
        .agg(
            F.count("*").alias("n_obs"),
            F.max(keys.ts).alias("run_end"),
            F.array_sort(F.collect_set(keys.seller)).alias("sellers"),
        )
        .select(keys.entity, F.col("w.start").alias("run_start"), "run_end", "n_obs", "sellers")
    )


def stream_daily_low(offers: DataFrame, late: str = "1 day", keys: Cols = COLS) -> DataFrame:
    """Lowest price per day, entity and seller."""
    return (
        offers.filter(F.col(keys.price) > 0).withWatermark(keys.ts, late)
        .groupBy(*keys.pair, F.window(keys.ts, "1 day").alias("w"))
        .agg(F.min(keys.price).alias("low"))
        .select(*keys.pair, F.to_date("w.start").alias("day"), "low")
    )


def _snapshot_before(spark: SparkSession, path: str, batch_id: int, schema: str | T.StructType) -> DataFrame:
    """The newest snapshot version written by an earlier batch. A repeated batch thus starts from
    the same snapshot as the first time."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(hadoop)] if fs.exists(hadoop) else []
    versions = [int(n[len("batch-"):]) for n in names if n.startswith("batch-")]
    earlier = [v for v in versions if v < batch_id]
    if not earlier:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(os.path.join(path, f"batch-{max(earlier)}"))


def _drop_versions(spark: SparkSession, path: str, before: int) -> None:
    """Delete all versions older than the newest one below ``before``; a repeated batch needs no others."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    paths = [s.getPath() for s in fs.listStatus(hadoop)] if fs.exists(hadoop) else []
    numbered = {int(p.getName()[len("batch-"):]): p for p in paths if p.getName().startswith("batch-")}
    keep = max((v for v in numbered if v < before), default=before)
    for version, p in numbered.items():
        if version < keep:
            fs.delete(p, True)


def _gate_fold(waiting: DataFrame, snapshot: DataFrame, limit_pct: float, keep_baseline: bool, keys: Cols) -> DataFrame:
    """All runs of ``waiting`` gated in order, as one job whatever their number.

    A pair's observations stand one after another in the order of their runs, after its rows in the snapshot; the
    prices that the last accepted observation of the seller's run before left are carried along. Pairs are dealt out by
    hash, and a pair's rows are read as they come, a listing (the sizes of one observation) at a time: however many it
    has, none are gathered.

    Returns the rows with ``old_price`` and ``accepted``, and with ``_kind`` 'snapshot' what the last run left.
    """
    pair, tier, price = keys.pair, keys.tier, keys.price
    runs = waiting.select(F.col(keys.seller).alias("_seller"), F.col("run").alias("_run")).distinct()
    runs = runs.withColumn("_seq", F.row_number().over(Window.partitionBy("_seller").orderBy("_run")))
    ends = runs.groupBy("_seller").agg(F.max("_seq").alias("_last"))
    same = F.col(keys.seller).eqNullSafe(F.col("_seller"))
    offers = waiting.join(runs, same & (F.col("run") == F.col("_run"))).drop("_seller", "_run")
    offers = offers.join(ends, same).drop("_seller").withColumn("_kind", F.lit("offer"))
    before = snapshot.select(*pair, tier, F.col(price).cast("double").alias(price)).join(ends, same).drop("_seller")
    before = before.withColumns({"_kind": F.lit("before"), "_seq": F.lit(0)})
    rows = offers.unionByName(before, allowMissingColumns=True)
    ordered = rows.repartition(*pair).sortWithinPartitions(*pair, "_seq", keys.ord)
    names = rows.columns
    shape = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema]).add("old_price", "double").add("accepted", "boolean")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whose = carried = carried_seq = fresh = fresh_seq = last_run = None

        def left(offer_seq):
            """Prices to compare with in the seller's run ``offer_seq``."""
            nonlocal carried, carried_seq
            if fresh_seq is not None and fresh_seq < offer_seq:
                if fresh or not keep_baseline:
                    carried, carried_seq = fresh, fresh_seq
                elif carried_seq == fresh_seq - 1:
                    carried_seq = fresh_seq  # all of that run was quarantined: the old prices stay
            return carried if carried_seq == offer_seq - 1 else {}

        def snapshot_rows(out):
            if whose is not None:
                for t, p in left(last_run + 1).items():
                    out.append(dict.fromkeys(names) | dict(zip(pair, whose, strict=True)) | {tier: t, price: p, "_kind": "snapshot"})

        def listing(rows, out):
            nonlocal whose, carried, carried_seq, fresh, fresh_seq, last_run
            first = rows[0]
            mine, seq = tuple(first[c] for c in pair), first["_seq"]
            if mine != whose:
                snapshot_rows(out)
                whose, carried, carried_seq, fresh, fresh_seq, last_run = mine, {}, None, {}, None, first["_last"]
            if first["_kind"] == "before":
                carried, carried_seq = {r[tier]: r[price] for r in rows}, 0
                return
            old = left(seq)
            if fresh_seq != seq:
                fresh, fresh_seq = {}, seq
            compared = [(r, old.get(r[tier])) for r in rows]
            swings = any(o is not None and o > 0 and r[price] is not None and r[price] > 0 and abs(r[price] - o) / o * 100 > limit_pct
                         for r, o in compared)
            if not swings:
                fresh = {r[tier]: r[price] for r in rows}
            out += [r | {"old_price": o, "accepted": not swings} for r, o in compared]

        held, key, schema = [], None, None
        for batch in batches:
            schema, out = to_arrow_schema(shape, prefers_large_types=False), []
            for r in batch.to_pylist():
                at = (*(r[c] for c in pair), r["_seq"], r[keys.ord])
                if held and at != key:
                    listing(held, out)
                    held = []
                key = at
                held.append(r)
            if out:
                yield from pa.Table.from_pylist(out, schema=schema).combine_chunks().to_batches()
        out = []
        if held:
            listing(held, out)
        snapshot_rows(out)
        if out:
            yield from pa.Table.from_pylist(out, schema=schema).combine_chunks().to_batches()

    return ordered.mapInArrow(fold, shape)


def gate_batch(
    out: str,
    snapshot_schema: str,
    keep_baseline: bool = False,
    keys: Cols = COLS,
    run: str = "to_date(obs_ts)",
    finish: bool = False,
    limit_pct: float = FV.SWING_PCT,
) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` body: gate collection runs, whatever batches they arrive in.

    A run is one value of ``run`` (the collection day). Its observations wait in ``pending`` until a later
    run shows up, or until a batch with ``finish``; then the runs that are over are gated in order, each
    against the snapshot the one before left. Every observation is filed in ``gated`` once: accepted, or
    quarantined with a reason, which is ``swing`` or, for one whose run is already closed, ``late``. So the
    result doesn't depend on how observations in run order are cut into batches. Folders are named
    after the batch and overwritten when it is repeated. A batch takes the same few jobs whether it closes one run
    or thousands.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        place = lambda name: os.path.join(out, name)
        fresh = batch.withColumn("run", F.expr(run).cast("string"))
        schema = fresh.schema
        pending = _snapshot_before(spark, place("pending"), batch_id, schema)
        closed = _snapshot_before(spark, place("closed"), batch_id, "run STRING").first()
        closed = closed["run"] if closed else None
        snapshot = _snapshot_before(spark, place("snapshot"), batch_id, snapshot_schema)
        is_late = F.lit(False) if closed is None else F.coalesce(F.col("run") <= closed, F.lit(False))
        is_late = is_late | F.col("run").isNull()
        waiting = pending.unionByName(fresh.filter(~is_late))
        newest = waiting.agg(F.max("run")).first()[0]  # it waits for a later one
        over = F.lit(True) if finish else F.col("run") < F.lit(newest)
        bare = F.lit(None).cast("double")
        late = fresh.filter(is_late).withColumns({
            "old_price": bare, "change_pct": bare, "is_anomaly": F.lit(False), "accepted": F.lit(False),
            "reason": F.lit("late"),
        })
        folded = _gate_fold(waiting.filter(over), snapshot, limit_pct, keep_baseline, keys)
        folded.write.mode("overwrite").parquet(place(f"folded/batch-{batch_id}"))
        folded = spark.read.schema(folded.schema).parquet(place(f"folded/batch-{batch_id}"))
        old, now = F.col("old_price"), F.col(keys.price)
        change = F.when((old > 0) & (now > 0), F.abs(now - old) / old * 100)
        gated = folded.filter("_kind = 'offer'").withColumn("change_pct", change).withColumns({
            "is_anomaly": F.coalesce(F.col("change_pct") > limit_pct, F.lit(False)), "reason": F.when(~F.col("accepted"), "swing")})
        gated.select(*late.columns).unionByName(late).write.mode("overwrite").parquet(place(f"gated/batch-{batch_id}"))
        ran = waiting.filter(over).select(keys.seller).distinct()
        others = snapshot.join(ran, keys.seller, "left_anti")
        columns = [*keys.pair, keys.tier, keys.price]
        after = others.select(*columns).unionByName(folded.filter("_kind = 'snapshot'").select(*columns))
        after.write.mode("overwrite").parquet(place(f"snapshot/batch-{batch_id}"))
        waiting.filter(~over).write.mode("overwrite").parquet(place(f"pending/batch-{batch_id}"))
        last = waiting.filter(over).agg(F.max("run").alias("run"))
        last.select(F.coalesce("run", F.lit(closed)).alias("run")).filter("run IS NOT NULL").write.mode("overwrite").parquet(place(f"closed/batch-{batch_id}"))
        for name in ("pending", "closed", "snapshot", "folded"):
            _drop_versions(spark, place(name), batch_id)

    return step


def finish_gate(spark: SparkSession, out: str, schema: str, snapshot_schema: str, **options) -> None:
    """Gate the runs still pending after the stream has ended. ``schema`` is that of the offers."""
    after = 1 << 61
    gate_batch(out, snapshot_schema, finish=True, **options)(spark.createDataFrame([], schema), after)


def gated_offers(spark: SparkSession, out: str) -> DataFrame:
    """All observations that have been filed so far."""
    return spark.read.option("recursiveFileLookup", "true").parquet(os.path.join(out, "gated"))


def stream_gate(
    offers: DataFrame, out: str, checkpoint: str, snapshot_schema: str, keys: Cols = COLS, **options
) -> DataStreamWriter:
    """Gate a stream of offers run by run; ``options`` go to ``gate_batch``."""
    step = gate_batch(out, snapshot_schema, keys=keys, **options)
    return offers.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)


def newest_version(spark: SparkSession, out: str, schema: str) -> DataFrame:
    """The version the last finished batch wrote."""
    return _snapshot_before(spark, out, 1 << 62, schema)
