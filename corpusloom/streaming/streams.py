"""Structured streams over growing tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusloom.session import shared_dir


def stream_of(spark: SparkSession, root: str, name: str, files: int = 4) -> DataFrame:
    """The files of a Parquet table as a stream, a few at a time."""
    schema = spark.read.parquet(f"{root}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", f"{name}*.parquet").parquet(root)


def run_available(df: DataFrame, mode: str = "append", each: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """Runs a stream over all that is there and gives its result as a table in the shared folder.

    The checkpoint lets a run that was broken off go on where it stood; each batch has a folder of its own, so a batch
    that is run again replaces itself. In complete and update mode the last batch holds the result.
    """
    spark = df.sparkSession
    root = f"{shared_dir(spark).rstrip('/')}/streams/{uuid.uuid4().hex}"
    last: dict[str, int] = {}

    def save(batch: DataFrame, number: int) -> None:
        (each(batch, number) if each else batch).write.mode("overwrite").parquet(f"{root}/out/batch={number}")
        last["n"] = number

    q = df.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    if "n" not in last:
        return spark.createDataFrame([], df.schema)
    path = f"{root}/out" if mode == "append" else f"{root}/out/batch={last['n']}"
    return spark.read.parquet(path).drop("batch")


def windowed_counts(events: DataFrame, time: str, key: str, value: str, size: str = "1 hour", late: str = "2 days") -> DataFrame:
    """Counts and sums per window and key; rows later than ``late`` behind the latest are dropped once a window is closed."""
    rows = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    out = rows.groupBy(F.window(time, size), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("window.start").alias("start"), key, "n", "total")


def running_totals(events: DataFrame, key: str, value: str) -> DataFrame:
    """A row for each key and batch with its count and total so far, kept as state from batch to batch."""
    key_type = events.schema[key].dataType.simpleString()

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for b in batches:
            n, total = n + len(b), total + float(b[value].fillna(0).sum())
        state.update((n, total))
        yield pd.DataFrame({key: [k[0]], "n": [n], "total": [total]})

    return events.groupBy(key).applyInPandasWithState(step, f"{key} {key_type}, n bigint, total double", "n bigint, total double", "update", GroupStateTimeout.NoTimeout)


def first_seen(events: DataFrame, key: str, time: str, late: str = "7 days") -> DataFrame:
    """Each key once, whenever it is delivered again within the time rows may be late."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark([key])
