"""Structured Streaming over spans: windowed statistics, and the newest traces of each name as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RING = 400


def read_spans(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stream of the Parquet files in a folder."""
    return spark.readStream.schema(schema).parquet(path)


def windowed_stats(spans: DataFrame, length: str = "1 minute", late: str = "5 minutes", time: str = "ts", name: str = "name", value: str = "duration_ms") -> DataFrame:
    """(window, name, n, mean, max) of each tumbling window, rows later than late being dropped."""
    grouped = spans.withWatermark(time, late).groupBy(F.window(time, length), F.col(name).alias("name"))
    return grouped.agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.max(value).alias("max"))


def newest(spans: DataFrame, most: int = RING, key: str = "name", time: str = "ts", value: str = "duration_ms") -> DataFrame:
    """(key, kept, oldest, newest) for each key after each batch: a bounded list of its newest values is the state."""

    def update(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        times = list(state.get[0]) if state.exists else []
        for batch in batches:
            times += [int(t.value // 1000) for t in batch[time]]
        times = sorted(times)[-most:]
        state.update((times,))
        yield pd.DataFrame({key: [k[0]], "kept": [len(times)], "oldest": [times[0]], "newest": [times[-1]]})

    return spans.select(key, time, value).groupBy(key).applyInPandasWithState(update, f"{key} string, kept long, oldest long, newest long", "times array<long>", "update", "NoTimeout")
