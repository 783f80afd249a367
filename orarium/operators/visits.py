"""Visits, recency and rate limits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

GAP = "INTERVAL 30 MINUTES"
# Requests in a window, and the window in seconds.
RATE_LIMIT, RATE_WINDOW = 5, 600


def sessions(events: DataFrame, keys: list[str], at: str, gap: str = GAP) -> DataFrame:
    """Numbers the visits of each key: one starts where the last event is `gap` or more ago (exactly 30 minutes too)."""
    order = Window.partitionBy(*keys).orderBy(at)
    fresh = F.when(F.lag(at).over(order).isNull() | (F.col(at) - F.lag(at).over(order) >= F.expr(gap)), 1).otherwise(0)
    return events.withColumn("_fresh", fresh).withColumn("visit", F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_fresh")


def visit_counts(events: DataFrame, keys: list[str], at: str) -> DataFrame:
    return sessions(events, keys, at).groupBy(*keys).agg(F.max("visit").alias("visits"), F.max(at).alias("latest"))


def frequent(counts: DataFrame, key: str, exclude: DataFrame, least: int = 2, shown: int = 3) -> DataFrame:
    """The most visited that aren't favourites, latest first among equals."""
    return counts.join(exclude, key, "left_anti").where(F.col("visits") >= least).orderBy(F.desc("visits"), F.desc("latest"), key).limit(shown)


def newest(rows: DataFrame, kind: str, at: str, most: int) -> DataFrame:
    """What a cache keeps of each kind: the `most` last used."""
    order = Window.partitionBy(kind).orderBy(F.desc(at))
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")


def accept(times: list[int], limit: int, window: int, held: list[int] | None = None) -> list[bool]:
    """Which requests pass: fewer than `limit` accepted ones in the window before; a refused one doesn't count. held: the
    accepted times that still matter, which the call brings up to date."""
    held = [] if held is None else held
    out = []
    for t in times:
        held[:] = [x for x in held if t - x < window]
        out.append(len(held) < limit)
        if out[-1]:
            held.append(t)
    return out


def rate_limit(events: DataFrame, client: str, at: str, order: str, limit: int = RATE_LIMIT, window: int = RATE_WINDOW) -> DataFrame:
    """Adds `allowed`. Each answer depends on those before, so a client's requests are read in order, batch by batch, with
    nothing held but its last accepted times.

    A pause of at least the window cuts a client's requests into pieces that don't touch, and pieces are spread over the
    tasks; one that never pauses is one task's work, but no more than a batch of it is in memory."""
    piece = sessions(events.withColumn("_at", F.col(at)), [client], "_at", f"INTERVAL {window} SECONDS").withColumnRenamed("visit", "_piece").drop("_at")
    schema = T.StructType([*events.schema.fields, T.StructField("allowed", T.BooleanType())])

    def decide(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, []
        for rows in frames:
            seconds = rows[at].astype("datetime64[us]").astype("int64").to_numpy()
            keys = list(zip(rows[client].tolist(), rows["_piece"].tolist(), strict=True))
            allowed = []
            for key, t in zip(keys, seconds.tolist(), strict=True):
                if key != now:
                    now, held = key, []
                allowed += accept([t], limit, window * 1_000_000, held)
            yield rows.assign(allowed=allowed)[schema.names]

    return piece.repartition(client, "_piece").sortWithinPartitions(client, "_piece", at, order).mapInPandas(decide, schema)
