"""Continuous stage progress from a stream of stage events."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillgraph.operators.progress import MICROS, STAGES, clamp_events, stage_metrics
from quillgraph.session import work_dir

STATE = "last_seq long, completed int, total int, latest double, cumulative_us long, samples long"
SUMS = (
    "job_id string, stage string, completed int, total int, latest_item_seconds double, "
    "cumulative_us long, sample_count long"
)


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last, done, total, latest, cumulative, samples = state.get if state.exists else (None, 0, 0, None, 0, 0)
    rows = pd.concat(list(batches)).sort_values("seq")
    if last is not None:
        rows = rows[rows["seq"] > last]
    last = int(rows["seq"].max()) if len(rows) else last
    for now, of, seconds in zip(rows["completed"], rows["total"], rows["item_seconds"]):
        if seconds > 0:
            latest = float(seconds)
            if now > done:
                cumulative, samples = cumulative + round(float(seconds) * MICROS), samples + 1
        done, total = int(now), int(of)
    state.update((last, done, total, latest, cumulative, samples))
    yield pd.DataFrame([{
        "job_id": key[0], "stage": key[1], "completed": done, "total": total,
        "latest_item_seconds": None if latest is None else round(latest, 2),
        "cumulative_us": cumulative, "sample_count": samples}])


def stream_stage_progress(events: DataFrame) -> DataFrame:
    """Updated figures of each (job, stage) whenever new events arrive.

    Events count in order of ``seq``.  One that arrives in a later batch than a higher
    ``seq`` of its stage is late and does not move the figures back.
    """
    clean = clamp_events(events.filter(F.col("stage").isin(list(STAGES))))
    sums = clean.groupBy("job_id", "stage").applyInPandasWithState(
        _advance, SUMS, STATE, "update", GroupStateTimeout.NoTimeout)
    return stage_metrics(sums)


def publish_progress(spark: SparkSession, events: DataFrame, folder: str | None = None) -> DataFrame:
    """Run the stream over what has arrived and return the latest row per (job, stage).

    Each micro-batch writes its own folder, so a replayed batch replaces itself;
    readers take the newest batch of each key.
    """
    root = folder or f"{work_dir(spark)}/progress-{uuid.uuid4().hex}"

    def publish(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/updates/batch={batch_id}")

    stream_stage_progress(events).writeStream.outputMode("update").foreachBatch(publish).option(
        "checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{root}/updates")
    rest = [c for c in rows.columns if c not in {"job_id", "stage", "batch"}]
    return rows.groupBy("job_id", "stage").agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(
        "job_id", "stage", "_r.*")
