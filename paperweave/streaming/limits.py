"""Rate limits, late events, sessions and counters over event streams.

The limiters depend on their own output, so a key's events are read in order.
A silence as long as the window resets a limiter; keys are cut there, so even a
hot key spreads over tasks, and a task keeps `limit` times in memory at most.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _islands(events: DataFrame, key: str, order: list[str], ts: str, seconds: float) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    gap = F.col(ts).cast("double") - F.lag(F.col(ts).cast("double")).over(w)
    cut = F.coalesce((gap >= seconds).cast("long"), F.lit(0))
    return events.withColumn("_cut", cut).withColumn("_island", F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_cut")


def _limited(events: DataFrame, key: str, order: list[str], ts: str, seconds: float, admit) -> DataFrame:
    import pandas as pd

    cut = _islands(events, key, order, ts, seconds).withColumn("_t", F.col(ts).cast("double"))
    schema = T.StructType([*events.schema.fields, T.StructField("admitted", T.BooleanType())])
    columns = events.columns

    def run(frames):
        at, state = None, deque()
        for f in frames:
            out = []
            for k, i, t in zip(f[key], f["_island"], f["_t"], strict=True):
                if (k, i) != at:
                    at, state = (k, i), deque()
                out.append(admit(state, t))
            yield f[columns].assign(admitted=pd.Series(out, index=f.index, dtype=bool))

    return cut.repartition(key, "_island").sortWithinPartitions(key, "_island", *order).mapInPandas(run, schema)


def sliding_log(events: DataFrame, key: str, order: list[str], ts: str, limit: int, seconds: float = 60.0) -> DataFrame:
    """Events with `admitted`: fewer than `limit` admitted ones lie in the window before; rejected ones do not count."""

    def admit(log: deque, t: float) -> bool:
        while log and log[0] <= t - seconds:
            log.popleft()
        if len(log) >= limit:
            return False
        log.append(t)
        return True

    return _limited(events, key, order, ts, seconds, admit)


def anchored_window(events: DataFrame, key: str, order: list[str], ts: str, limit: int, seconds: float) -> DataFrame:
    """Events with `admitted`: `limit` in a window that begins with its first event and is replaced when it has passed."""

    def admit(window: deque, t: float) -> bool:
        if not window or t - window[0] >= seconds:
            window.clear()
            window.extend((t, 0))
        window[1] += 1
        return window[1] <= limit

    return _limited(events, key, order, ts, seconds, admit)


def sessions(events: DataFrame, key: str, order: list[str], ts: str, seconds: float) -> DataFrame:
    """(key, session, first, last, events): runs without a silence longer than `seconds`."""
    w = Window.partitionBy(key).orderBy(*order)
    gap = F.col(ts).cast("double") - F.lag(F.col(ts).cast("double")).over(w)
    runs = events.withColumn("_n", F.coalesce((gap > seconds).cast("long"), F.lit(0))).withColumn("session", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(key, "session").agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.count("*").alias("events"))


def coalesced(events: DataFrame, key: str, action: str, order: list[str], ts: str, seconds: float = 0.9) -> DataFrame:
    """(key, entry, action, last, merged): neighbours of one action within a short time are one entry, the last stands for them."""
    w = Window.partitionBy(key).orderBy(*order)
    near = (F.col(ts).cast("double") - F.lag(F.col(ts).cast("double")).over(w) <= seconds) & F.col(action).eqNullSafe(F.lag(action).over(w))
    runs = events.withColumn("_n", (~F.coalesce(near, F.lit(False))).cast("long")).withColumn("entry", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(key, "entry", action).agg(F.max(ts).alias("last"), F.count("*").alias("merged"))


def accepted(events: DataFrame, ts: str, received: str, early_seconds: int = 300, retention_days: int = 30) -> DataFrame:
    """Events with `verdict`: early (too far ahead of their receipt), late (older than is kept) or ok."""
    ahead = F.col(ts).cast("double") - F.col(received).cast("double")
    verdict = F.when(ahead > early_seconds, "early").when(-ahead > retention_days * 86400, "late").otherwise("ok")
    return events.withColumn("verdict", verdict)


def histogram(events: DataFrame, by: list[str], value: str, bounds: list[float]) -> DataFrame:
    """(by, le, count, total, sum): cumulative buckets, one scan, then one row a bound."""
    counts = [F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)]
    wide = events.groupBy(*by).agg(*counts, F.count("*").alias("total"), F.round(F.sum(value), 4).alias("sum"))
    rows = F.array(*[F.struct(F.lit(b).alias("le"), F.col(f"b{i}").alias("count")) for i, b in enumerate(bounds)])
    return wide.select(*by, "total", "sum", F.explode(rows).alias("b")).select(*by, "b.le", "b.count", "total", "sum")


def windowed_counts(stream: DataFrame, by: str, ts: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts a window and key of a stream (or a table); events later than the watermark are left out of streams."""
    base = stream.withWatermark(ts, late) if stream.isStreaming else stream
    return base.groupBy(F.window(ts, width).alias("w"), by).agg(F.count("*").alias("count")).select(by, F.col("w.start").alias("start"), "count")


def first_seen_stream(stream: DataFrame, key: list[str], ts: str, late: str = "1 hour") -> DataFrame:
    """A stream without repeats of a key within the watermark."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(key)
