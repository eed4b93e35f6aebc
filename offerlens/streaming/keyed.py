"""Streams whose state is kept per key: link states with timers, and the last record of each pair.

A batch reads and writes the state of the keys it touches, whatever else is stored. State lives in RocksDB on
the executors, with a changelog in the checkpoint folder, so it may be larger than memory and survives a lost
executor. ``state_of`` reads all of it as a table, without a running query.
"""
from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from offerlens.functions import fixed_values as FV
from offerlens.operators import state as S
from offerlens.schemas import COLS, Cols

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TIMES = ["last_discovery_attempt", "created_at", "updated_at"]
HOUR = 3_600_000_000  # microseconds

_LINK_VALUE = (
    "old_handle STRING, status STRING, candidate_handle STRING, redirect_url STRING, attempts INT, "
    "last_discovery_attempt BIGINT, created_at BIGINT, updated_at BIGINT, common_name STRING, "
    "botanical_name STRING, candidate_title STRING, match_score DOUBLE, reason STRING, "
    "last_ord BIGINT, due BOOLEAN"
)
_LINK_FIELDS = [field.split()[0] for field in _LINK_VALUE.split(", ")]


def use_keyed_state(spark: SparkSession) -> None:
    """Store state in RocksDB. For the session that starts the streams of this module."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def state_of(spark: SparkSession, checkpoint: str, variable: str) -> DataFrame:
    """The newest committed state of a stream: the key's columns, then the value's."""
    stored = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", variable).load()
    return stored.select("key.*", "value.*")


def fold_event(link: dict | None, e: Row) -> dict | None:
    """A link's entry after one event, whose time is ``event_at``, in microseconds; None where there is none. The rules
    are those of ``operators.state``."""
    kind, at = e["event"], e["event_at"]
    if kind == "applied":
        return None
    status = link and link["status"]
    in_flight = status in S.IN_FLIGHT
    if kind in ("redirect", "discovery") or (kind == "broken" and not in_flight):
        old = dict.fromkeys(S.STATE_COLUMNS) | {"attempts": 0, "created_at": at} if link is None else link
        new = dict.fromkeys(S.STATE_COLUMNS) | {
            "old_handle": old["old_handle"] or "", "attempts": old["attempts"], "created_at": old["created_at"],
            "last_discovery_attempt": old["last_discovery_attempt"], "updated_at": at}
        if kind != "discovery":
            new["old_handle"] = e["old_handle"] or ""
        if kind == "broken":
            return new | {"status": "broken"}
        new["candidate_handle"] = e["new_handle"]
        if kind == "redirect":
            return new | {"status": "redirect_candidate", "redirect_url": e["redirect_url"], "attempts": 0, "last_discovery_attempt": None}
        found = {c: e[c] for c in ("common_name", "botanical_name", "candidate_title", "match_score")}
        return new | found | {"status": "discovery_candidate", "attempts": new["attempts"] + 1, "last_discovery_attempt": at}
    if link is None or kind == "broken":
        return link
    if kind == "attempt":
        return link | {"attempts": link["attempts"] + 1, "last_discovery_attempt": at, "updated_at": at}
    ended = {"verdict": (e["verdict"], e["reason"]), "confirm_failed": ("confirmation_failed", S.FAILED_REASON),
             "unrecoverable": ("unrecoverable", e["reason"])}
    if kind not in ended:
        return link
    return link | {"status": ended[kind][0], "reason": ended[kind][1], "updated_at": at}


class LinkStates(StatefulProcessor):
    """Folds link events. With ``timed``, a broken link becomes due once its last attempt rested, or is given up
    once it is out of attempts; both happen when the watermark passes the time."""

    def __init__(self, timed: bool, cooldown_hours: int, limit: int):
        self.timed, self.cooldown, self.limit = timed, cooldown_hours * HOUR, limit

    def init(self, handle) -> None:
        self.handle = handle
        self.link = handle.getValueState("link", _LINK_VALUE)

    def _stored(self) -> tuple[dict | None, int | None]:
        if not self.link.exists():
            return None, None
        held = dict(zip(_LINK_FIELDS, self.link.get(), strict=True))
        return (held if held["status"] is not None else None), held["last_ord"]

    def _store(self, link: dict | None, last_ord: int | None, due: bool = False) -> None:
        held = dict.fromkeys(_LINK_FIELDS) | (link or {}) | {"last_ord": last_ord, "due": due}
        self.link.update(tuple(held[c] for c in _LINK_FIELDS))

    def _row(self, key, link: dict | None, change: str) -> Row:
        shown = dict.fromkeys(S.STATE_COLUMNS) if link is None else {c: link[c] for c in S.STATE_COLUMNS}
        return Row(**dict(zip(S.LINK, key, strict=True)), **shown, change=change)

    def _set_timer(self, link: dict | None) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if link is None or link["status"] != "broken":
            return
        tried = link["last_discovery_attempt"]
        at = link["updated_at"] if tried is None or link["attempts"] >= self.limit else tried + self.cooldown
        self.handle.registerTimer(-(-at // 1000))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        link, last = self._stored()
        was, seen = link, False
        for e in sorted(rows, key=lambda r: r["event_ord"]):
            if last is None or e["event_ord"] > last:  # else it was folded before
                link, last, seen = fold_event(link, e), e["event_ord"], True
        if not seen:
            return
        self._store(link, last)
        if self.timed:
            self._set_timer(link)
        if link is not None or was is not None:
            yield self._row(key, link, "state" if link is not None else "removed")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        link, last = self._stored()
        if link is None or link["status"] != "broken":
            return
        if link["attempts"] >= self.limit:
            link |= {"status": "unrecoverable", "reason": f"No candidate found after {self.limit} attempts",
                     "updated_at": expiredTimerInfo.getExpiryTimeInMs() * 1000}
            self._store(link, last)
            yield self._row(key, link, "expired")
        else:
            self._store(link, last, due=True)
            yield self._row(key, link, "due")

    def close(self) -> None:
        pass


def link_changes(
    events: DataFrame, late: str | None = None, cooldown_hours: int = FV.COOLDOWN_HOURS, limit: int = FV.MAX_ATTEMPTS
) -> DataFrame:
    """Changes of link states, for update mode: a row per touched link and batch, ``change`` being state, removed, due or
    expired. Folding all changes gives ``link_state`` of all events.

    A link's events come in the order of ``event_ord`` from batch to batch; inside a batch any order will do. One that is
    not above the last is a repeat and has no effect. With ``late`` the watermark runs the timers; without,
    there are none. The events of one link in one batch are sorted in memory, so a batch bounds them
    (``maxFilesPerTrigger``).
    """
    timed = late is not None
    asked = events.filter(F.col("event_ts").isNotNull()).withWatermark("event_ts", late) if timed else events
    asked = asked.withColumn("event_at", F.unix_micros("event_ts"))
    shown = ", ".join(_LINK_VALUE.split(", ")[: len(S.STATE_COLUMNS)])
    out = asked.groupBy(*S.LINK).transformWithState(
        LinkStates(timed, cooldown_hours, limit), f"seller_id STRING, entity_id STRING, {shown}, change STRING", "Update",
        "EventTime" if timed else "None")
    return _with_times(out)


def _with_times(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.timestamp_micros(c) for c in TIMES})


def link_states(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The links a stream of ``link_changes`` has, and whether each is ``due``."""
    held = _with_times(state_of(spark, checkpoint, "link").filter(F.col("status").isNotNull()))
    return held.select(*S.LINK, *S.STATE_COLUMNS, "due")


class LastRecords(StatefulProcessor):
    """Keeps the record with the greatest (time, order); an older one that comes late changes nothing."""

    def __init__(self, pair: list[str], names: list[str], value: str, ttl_ms: int | None):
        self.pair, self.names, self.value, self.ttl = pair, names, value, ttl_ms

    def init(self, handle) -> None:
        self.last = handle.getValueState("last", self.value, self.ttl) if self.ttl else handle.getValueState("last", self.value)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        newest = tuple(self.last.get()) if self.last.exists() else None
        before = newest
        rank = lambda v: tuple((x is not None, x) for x in v[:2])  # noqa: E731 - nulls first
        for r in rows:
            found = tuple(r[c] for c in self.names)
            if newest is None or rank(found) > rank(newest):
                newest = found
        if newest != before:
            self.last.update(newest)
            yield Row(**dict(zip(self.pair, key, strict=True)), **dict(zip(self.names, newest, strict=True)))

    def close(self) -> None:
        pass


def latest_changes(obs: DataFrame, values: list[str], keys: Cols = COLS, ttl_ms: int | None = None) -> DataFrame:
    """The last record of each (entity, seller), for update mode: a row whenever it changes, in any order of arrival.

    The state is one record per pair. With ``ttl_ms`` a pair that gets no newer record for that long (by the clock) is
    forgotten; Spark then runs batches without data too, so such a stream needs a trigger that goes on, or
    ``spark.sql.streaming.noDataMicroBatches.enabled`` off.
    """
    given = obs.schema
    rest = [c for c in values if c not in (keys.ts, keys.ord)]
    asked = obs.select(*keys.pair, F.unix_micros(keys.ts).alias("_at"), F.col(keys.ord).alias("_order"), *rest)
    kept = [f for f in asked.schema if f.name not in keys.pair]
    value = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    out = asked.groupBy(*keys.pair).transformWithState(
        LastRecords(keys.pair, [f.name for f in kept], value, ttl_ms), asked.schema, "Update", "ProcessingTime" if ttl_ms else "None")
    shown = {keys.ts: F.timestamp_micros("_at"), keys.ord: F.col("_order")}
    return out.select(*keys.pair, *[shown.get(c, F.col(c)).cast(given[c].dataType).alias(c) for c in dict.fromkeys([keys.ts, keys.ord, *values])])


def latest_records(spark: SparkSession, checkpoint: str, keys: Cols = COLS) -> DataFrame:
    """The records a stream of ``latest_changes`` keeps."""
    held = state_of(spark, checkpoint, "last")
    rest = [c for c in held.columns if c not in (*keys.pair, "_at", "_order")]
    return held.select(*keys.pair, F.timestamp_micros("_at").alias(keys.ts), F.col("_order").alias(keys.ord), *rest)


def state_size(query) -> dict[str, int]:
    """Rows in the state, rows the last batch changed, and rows dropped as late so far, of all stateful operators."""
    progress = [p for p in query.recentProgress if p["stateOperators"]]
    last = progress[-1]["stateOperators"] if progress else []
    return {
        "rows": sum(o["numRowsTotal"] for o in last),
        "updated": sum(o["numRowsUpdated"] for o in last),
        "dropped_late": sum(o["numRowsDroppedByWatermark"] for p in progress for o in p["stateOperators"]),
    }
