"""Event streams: hourly aggregates with late data, and the latest state per key. An extension; batch queries don't need it."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from stayline.operators.common import ship_package


def hourly(events: DataFrame, at: str, keys: Sequence[str], value: str, late: str = "2 hours", width: str = "1 hour") -> DataFrame:
    """Count, sum, least and greatest value per key and window of event time; events later than ``late`` are dropped.

    Works on streams and tables alike. ``at`` must be a timestamp with zone for a watermark; NTZ is taken as the session's.
    """
    e = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    g = e.groupBy(F.window(at, width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("most"))
    return g.select(*keys, F.col("w.start").alias("start_at"), "n", "total", "least", "most")


def distinct_events(events: DataFrame, at: str, key: Sequence[str], late: str = "2 hours") -> DataFrame:
    """Each event once, as far as repeats arrive within the watermark."""
    return events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).dropDuplicatesWithinWatermark(list(key))


def runs(events: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """The current run of equal values per key: ``key, value, since, length``, given out whenever a batch extends or ends it.

    State is one row per key; it is arbitrary state that no built-in aggregate holds.
    """
    ship_package(events.sparkSession)
    kind = dict(events.dtypes)[key]
    out = f"{key} {kind}, value string, since timestamp, length long"

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        cur, since, n = state.get if state.exists else (None, None, 0)
        for pdf in batches:
            for t, v in pdf.sort_values("t")[["t", "v"]].itertuples(index=False):
                cur, since, n = (cur, since, n + 1) if n and v == cur else (v, t, 1)
        state.update((cur, since, n))
        yield pd.DataFrame({key: [k[0]], "value": [cur], "since": [since], "length": [n]})

    e = events.select(F.col(key), F.col(at).cast("timestamp").alias("t"), F.col(value).cast("string").alias("v"))
    return e.groupBy(key).applyInPandasWithState(step, out, "value string, since timestamp, length long", "update", GroupStateTimeout.NoTimeout)
