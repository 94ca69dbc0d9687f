"""Documents as they arrive: windows and triggers on a stream, activity by time, portfolios as state."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fathomline.operators import rules, windows


def arriving(spark: SparkSession, folder: str, schema: str | StructType, files_at_once: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def triggered_windows(docs: DataFrame, hard: str, soft: str) -> DataFrame:
    """Stateless: the same expressions as in batch."""
    return rules.triggered(windows.useful_windows(windows.char_windows(docs)), hard, soft)


def activity(events: DataFrame, time: str = "ts", kind: str = "event_type", value: str = "value", late: str = "10 minutes", span: str = "1 hour") -> DataFrame:
    """Counts and sums of each kind in tumbling windows; rows later than the watermark are left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, span), kind).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total"))


def first_sightings(refs: DataFrame) -> DataFrame:
    """NEW_ADOPTION or CONFIRMED for each arriving reference (company, category, year): the first year of a unit is its state."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        first = state.get[0] if state.exists else None
        for pdf in frames:
            out = []
            for year in sorted(pdf["year"]):
                out.append("CONFIRMED" if first is not None and year > first else "NEW_ADOPTION")
                first = year if first is None else min(first, year)
            yield pd.DataFrame({"company": key[0], "category": key[1], "year": sorted(pdf["year"]), "event_type": out})
        state.update((int(first),))

    return refs.groupBy("company", "category").applyInPandasWithState(step, "company long, category string, year int, event_type string", "first int", "append", "NoTimeout")


def into(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], once: bool = True, progress: Callable[[int, float], None] | None = None):
    """Each micro-batch to ``write``, which must be idempotent for its batch number; then its number and seconds to ``progress``."""

    def batch(df: DataFrame, n: int) -> None:
        began = time.monotonic()
        write(df, n)
        if progress:
            progress(n, time.monotonic() - began)

    out = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start()
