"""Operators over streams. Those of single rows (select, map, transform, filter, search, explode, separate, tokenize, scrape)
take a streaming DataFrame as it is; here are the ones that keep state, bounded by watermarks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import aggregates
from ..functions.compiler import select_names
from ..storage import remove, scratch


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A folder's parquet files of a table as a stream."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def _timed(stream: DataFrame, time: str, delay: str) -> DataFrame:
    """With a watermark; times without zone are taken in the session's."""
    return stream.withColumn(time, F.col(f"`{time}`").cast("timestamp")).withWatermark(time, delay)


def dedup(stream: DataFrame, spec: str, time: str, delay: str = "1 hour") -> DataFrame:
    """The first row of a key within the watermark."""
    return _timed(stream, time, delay).dropDuplicatesWithinWatermark(select_names(stream, spec))


def groupby(stream: DataFrame, spec: str, clauses: str, time: str | None = None, delay: str = "1 hour", window: str | None = None, slide: str | None = None) -> DataFrame:
    """Aggregates by group (complete or update mode), or by group and window of event time (append mode too)."""
    keys = [F.col(f"`{n}`") for n in select_names(stream, spec)]
    if time and window:
        stream = _timed(stream, time, delay)
        keys = [F.window(time, window, slide).alias("window") if slide else F.window(time, window).alias("window"), *keys]
    return stream.groupBy(*keys).agg(*aggregates.clauses(stream, clauses))


def frequency(stream: DataFrame, column: str) -> DataFrame:
    value = F.coalesce(F.nullif(F.col(f"`{column}`").cast("string"), F.lit("")), F.lit("<empty>"))
    return stream.groupBy(F.lit(column).alias("field"), value.alias("value")).agg(F.count(F.lit(1)).alias("count"))


def running_sum(stream: DataFrame, group: str, order: str, value: str, name: str = "cumsum", idle: str | None = None) -> DataFrame:
    """Rows with the sum of their group so far. Rows that a trigger brings are put in order first, all of a group; the state is one
    number a group, dropped once a group has brought nothing for `idle` of processing time, if that is given."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        total = state.get[0] if state.exists else 0.0
        rows = pd.concat([b for b in batches if len(b)]).sort_values(order, kind="stable")
        rows[name] = total + rows[value].fillna(0).cumsum()
        state.update((float(rows[name].iloc[-1]),))
        if idle:
            state.setTimeoutDuration(idle)
        yield rows

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema.fields)
    return stream.groupBy(group).applyInPandasWithState(run, f"{fields}, `{name}` double", "total double", "append", GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout)


def collected(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All there is on a stream, run to its end into files of the shared folder: rows go there from the tasks, none to the driver. In
    complete mode the last trigger's rows are the result, in update mode those of all."""
    spark, wrote = stream.sparkSession, []
    path, state = scratch(spark, name), scratch(spark, f"{name}-state")
    writer = stream.writeStream.outputMode(mode).queryName(name).option("checkpointLocation", state).trigger(availableNow=True)

    def write(rows: DataFrame, trigger: int) -> None:
        wrote.append(f"{path}/{trigger}")
        rows.write.mode("overwrite").parquet(wrote[-1])

    query = writer.format("parquet").start(path) if mode == "append" else writer.foreachBatch(write).start()
    query.awaitTermination()
    remove(spark, state)
    kept = {"append": [path], "update": wrote, "complete": wrote[-1:]}[mode]
    return spark.read.schema(stream.schema).parquet(*kept) if kept else spark.createDataFrame([], stream.schema)
