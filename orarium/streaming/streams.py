"""Structured Streaming forms: versioned upserts, visits and rate limits with state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from orarium.operators.capture import upsert_latest
from orarium.operators.visits import RATE_LIMIT, RATE_WINDOW, accept
from orarium.sources.sinks import delete

VISIT_GAP = 30 * 60 * 1_000_000
#: How late an event may come, and after how long without one a key is forgotten.
LATE, FORGET = "10 minutes", 30 * 24 * 3600 * 1000


def upsert_sink(path: str, keys: list[str], version: str, content: list[str]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each batch is folded into a table of the latest versions, written as a new generation.

    A generation is named by its batch, so a batch that runs again after a failure writes the same one from the newest
    before it, whatever the first batch's number and whichever wrote nothing. A batch without rows writes nothing. Of the
    older generations the last stays, for readers of it and for a batch that runs again; the others go."""

    def write(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        if rows.isEmpty():
            return
        found = [g for g in generations(spark, path) if g < batch]
        stored = spark.read.parquet(f"{path}/{found[-1]}") if found else rows.limit(0)
        upsert_latest(stored.select(rows.columns), rows, keys, version, content).write.mode("overwrite").parquet(f"{path}/{batch}")
        for g in found[:-1]:
            delete(spark, f"{path}/{g}")

    return write


def generations(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the generations below a path, in order."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in store.listStatus(where)] if store.exists(where) else []
    return sorted(int(n) for n in names if n.isdigit())


def windowed_counts(events: DataFrame, at: str, by: str, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts by tumbling window, closed once the watermark has passed."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), by).count().select(F.col("window.start").alias("start"), by, F.col("count").alias("n"))


def visit_stream(events: DataFrame, key: str, at: str, late: str = LATE, forget: int = FORGET) -> DataFrame:
    """key, visits, latest_us after each batch: an event less than 30 minutes after the last one belongs to its visit.

    A key without an event for `forget` milliseconds of event time loses its state, and its count begins anew."""
    kind = dict(events.dtypes)[key]

    def count(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        visits, latest = state.get if state.exists else (0, None)
        times = sorted(int(t) for f in frames for t in f["us"])
        for t in times:
            visits += latest is None or t - latest >= VISIT_GAP
            latest = t if latest is None else max(latest, t)
        state.update((visits, latest))
        state.setTimeoutTimestamp(max(latest // 1000 + forget, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [k[0]], "visits": [visits], "latest_us": [latest]})

    rows = events.withWatermark(at, late).select(key, at, F.unix_micros(F.col(at)).alias("us"))
    return rows.groupBy(key).applyInPandasWithState(count, f"{key} {kind}, visits long, latest_us long", "visits long, latest long", "update", GroupStateTimeout.EventTimeTimeout)


class OpenVisits(StatefulProcessor):
    """A key's visits that may still grow, each from its first to its last event; a timer closes each when no event in time
    can belong to it any more."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.visits = handle.getMapState("visits", "began long", "latest long, n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        times = sorted(int(t) for f in rows for t in f["us"])
        there = {began[0]: (latest, n) for began, (latest, n) in self.visits.iterator()} if self.visits.exists() else {}
        spans = sorted([(b, e, n) for b, (e, n) in there.items()] + [(t, t, 1) for t in times])
        merged: list[list[int]] = []
        for began, latest, n in spans:
            if merged and began - merged[-1][1] < VISIT_GAP:
                merged[-1][1], merged[-1][2] = max(merged[-1][1], latest), merged[-1][2] + n
            else:
                merged.append([began, latest, n])
        now = {began: (latest, n) for began, latest, n in merged}
        for began, (latest, n) in there.items():
            if now.get(began) != (latest, n):
                self.handle.deleteTimer(closing(latest))
            if began not in now:
                self.visits.removeKey((began,))
        for began, value in now.items():
            if there.get(began) != value:
                self.visits.updateValue((began,), value)
        for _, latest, _ in merged:
            self.handle.registerTimer(closing(latest))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        over = [(began[0], latest, n) for began, (latest, n) in self.visits.iterator() if closing(latest) <= expiredTimerInfo.getExpiryTimeInMs()]
        for began, _, _ in over:
            self.visits.removeKey((began,))
        if over:
            yield pd.DataFrame({"key": [str(key[0])] * len(over), "began_us": [x[0] for x in over], "latest_us": [x[1] for x in over], "n": [x[2] for x in over]})

    def close(self) -> None:
        pass


def closing(latest: int) -> int:
    """The first millisecond of event time at which a visit can't go on."""
    return -(-(latest + VISIT_GAP) // 1000)


def closed_visits(events: DataFrame, key: str, at: str, late: str = LATE) -> DataFrame:
    """key (as text), began_us, latest_us, n of every visit, once it is over: when the watermark has passed its last event
    by 30 minutes. Events may come in any order within `late`; later ones are dropped.

    The state of a key is its open visits alone, closed and removed by event-time timers. Needs the RocksDB state store
    (spark.sql.streaming.stateStore.providerClass)."""
    rows = events.withWatermark(at, late).select(F.col(key).alias("key"), at, F.unix_micros(F.col(at)).alias("us"))
    return rows.groupBy("key").transformWithStateInPandas(OpenVisits(), "key string, began_us long, latest_us long, n long", "append", "eventTime")


def rate_limit_stream(events: DataFrame, client: str, at: str, limit: int = RATE_LIMIT, window: int = RATE_WINDOW, late: str = LATE) -> DataFrame:
    """client, us, allowed: the state is the client's accepted requests of the last window, at most `limit` of them; it
    goes when event time has passed them."""
    kind = dict(events.dtypes)[client]

    def decide(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(state.get[0]) if state.exists else []
        times = sorted(int(t) for f in frames for t in f["us"])
        allowed = accept([*held, *times], limit, window * 1_000_000)[len(held) :]
        kept = [*held, *(t for t, a in zip(times, allowed, strict=True) if a)][-limit:]
        state.update((kept,))
        state.setTimeoutTimestamp(max(kept[-1] // 1000 + 1 + window * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({client: [k[0]] * len(times), "us": times, "allowed": allowed})

    rows = events.withWatermark(at, late).select(client, at, F.unix_micros(F.col(at)).alias("us"))
    return rows.groupBy(client).applyInPandasWithState(decide, f"{client} {kind}, us long, allowed boolean", "held array<long>", "append", GroupStateTimeout.EventTimeTimeout)
