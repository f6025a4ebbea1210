"""The event stream: source, stateful fold to status, counters, merged streams and fan-out, as Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from basaltic.operators.timeline import mapped_stage

STATUS = "run long, phase string, target string, files_total long, stage string, events long"
_STATE = "phase string, phase_at long, target string, target_at long, files_total long, files_total_at long, stage string, stage_at long, events long"


def event_source(spark: SparkSession, path: str, schema, files_a_batch: int = 1, form: str = "json") -> DataFrame:
    """Events from a folder, a bounded number of files at a time: the bound is the back-pressure."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).option("recursiveFileLookup", True).format(form).load(path)


def fold_status(events: DataFrame, run: str = "run", position: str = "position") -> DataFrame:
    """The status of each run after each batch: last phase, last non-empty target, last non-zero total, stage (kept over phases
    that have none), number of events. events has run, position, phase, target and files_total.

    State is one small row for each run, whatever the number of events. Each field keeps the position that it comes from, so events
    may arrive in any order.
    """
    fields = ("phase", "target", "files_total", "stage")

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get) if state.exists else ["", -1, "", -1, 0, -1, "", -1, 0]
        for row in pd.concat(list(frames)).itertuples():
            for k, name in enumerate(fields):
                value = getattr(row, name)
                if row.position >= held[2 * k + 1] and (value or name == "phase"):
                    held[2 * k : 2 * k + 2] = [value if isinstance(value, str) else int(value), int(row.position)]
            held[8] += 1
        state.update(tuple(held))
        yield pd.DataFrame([(key[0], *held[0:8:2], held[8])], columns=["run", *fields, "events"])

    ready = events.select(
        F.col(run).cast("long").alias("run"),
        F.col(position).cast("long").alias("position"),
        F.coalesce("phase", F.lit("")).alias("phase"),
        F.coalesce("target", F.lit("")).alias("target"),
        F.coalesce("files_total", F.lit(0)).cast("long").alias("files_total"),
        F.coalesce(mapped_stage(F.col("phase")), F.lit("")).alias("stage"),
    )
    return ready.groupBy("run").applyInPandasWithState(fold, STATUS, _STATE, "update", GroupStateTimeout.NoTimeout)


def running_counts(events: DataFrame, tool: str, unit: str, count: str, finished: str) -> DataFrame:
    """Finished item counts by tool, kept up over the stream."""
    return events.where((F.col(unit) != "KB") & F.col(finished)).groupBy(tool).agg(F.sum(count).alias("completed"))


def windowed_counts(events: DataFrame, ts: str, kind: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """An addition: events by kind in windows of event time, late ones up to the watermark."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), kind).agg(F.count("*").alias("n"))


def merged(progress: DataFrame, log: DataFrame) -> DataFrame:
    """Two streams of events as one."""
    return progress.unionByName(log, allowMissingColumns=True)


def fan_out(events: DataFrame, sinks: list[Callable[[DataFrame, int], None]], checkpoint: str):
    """Each batch goes to every sink, computed once. Lossless, unlike a queue that drops when full."""

    def each(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        try:
            for sink in sinks:
                sink(kept, number)
        finally:
            kept.unpersist()

    return events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each).trigger(availableNow=True).start()
