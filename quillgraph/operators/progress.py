"""Progress of processing stages, job states and the document library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillgraph.operators.communities import ordered_index
from quillgraph.sources.store import ACTIVE_STATUSES

STAGES = ("entity_extraction", "relationship_extraction", "knowledge_fusion")
ENTITY, RELATION, FUSION = STAGES
CHECKPOINT_INTERVAL = 10

# Readable names of the job states.
STATUS_LABELS = {
    "uploading": "上传中", "importing": "迁移包导入中", "processing": "处理中", "updating": "增量更新中",
    "resuming": "继续处理中", "pausing": "暂停中", "redrawing": "重新绘制图谱中", "paused": "已暂停",
    "completed": "已完成", "interrupted": "部分完成，可继续", "error": "处理失败，可重试",
}
TRACKED = [s for s in STATUS_LABELS if s != "completed"]


def clamp_events(events: DataFrame) -> DataFrame:
    """Counters and seconds forced into their valid range."""
    total = F.greatest(F.coalesce("total", F.lit(0)), F.lit(0))
    return events.withColumn("total", total).withColumn(
        "completed", F.greatest(F.lit(0), F.least(F.coalesce("completed", F.lit(0)), F.col("total")))
    ).withColumn("item_seconds", F.greatest(F.coalesce("item_seconds", F.lit(0.0)), F.lit(0.0)))


MICROS = 1_000_000


def stage_metrics(sums: DataFrame) -> DataFrame:
    """Derived figures of a stage from completed, total, samples and their microseconds.

    Whole microseconds add up to the same sum in any order, so rounded figures do
    not depend on how the rows were spread.
    """
    spent = F.col("cumulative_us")
    average = F.when(F.col("sample_count") > 0, spent / F.col("sample_count"))
    remaining = F.greatest(F.col("total") - F.col("completed"), F.lit(0))
    return (
        sums.withColumn("remaining", remaining)
        .withColumn("percentage", F.when(F.col("total") > 0, F.round(
            F.col("completed") * 100.0 / F.col("total"), 1)).otherwise(100.0))
        .withColumn("average_item_seconds", F.round(average / (MICROS / 100), 0) / 100)
        .withColumn("cumulative_seconds", F.round(spent / (MICROS / 1000), 0) / 1000)
        .withColumn("items_per_minute", F.when(
            spent > 0, F.round(F.col("sample_count") * (60.0 * MICROS * 100) / spent, 0) / 100))
        .withColumn("estimated_remaining_seconds", F.when(
            average.isNotNull(), F.round(remaining * average / MICROS, 0)).when(remaining == 0, F.lit(0.0)))
        .drop("cumulative_us")
    )


def stage_progress(events: DataFrame) -> DataFrame:
    """Current figures of every (job, stage) from its events in ``seq`` order.

    An item's seconds count only if the counter advanced over the event before.
    That event is found by number, an even equi-join however long a job's log is.
    """
    clean = clamp_events(events.filter(F.col("stage").isin(list(STAGES))))
    numbered = ordered_index(clean, ["job_id", "stage"], [F.col("seq")], "_i")
    previous = numbered.select("job_id", "stage", (F.col("_i") + 1).alias("_i"), F.col("completed").alias("_was"))
    sample = (F.col("item_seconds") > 0) & (F.col("completed") > F.coalesce("_was", F.lit(0)))
    positive = F.col("item_seconds") > 0
    sums = (
        numbered.join(previous, ["job_id", "stage", "_i"], "left")
        .groupBy("job_id", "stage").agg(
            F.max_by("completed", "seq").alias("completed"), F.max_by("total", "seq").alias("total"),
            F.round(F.max_by(F.when(positive, F.col("item_seconds")), F.when(positive, F.col("seq"))), 2)
            .alias("latest_item_seconds"),
            F.coalesce(F.sum(F.when(sample, F.round(F.col("item_seconds") * MICROS, 0).cast("long"))), F.lit(0).cast("long"))
            .alias("cumulative_us"),
            F.count(F.when(sample, 1)).alias("sample_count"),
            F.min_by(F.struct("completed", "total"), "seq").alias("first")))
    return stage_metrics(sums)


def overall_progress(stages: DataFrame) -> DataFrame:
    """Mean percentage of the three stages, and time left if every total is known.

    Before its own first event the relation stage takes its total from the first
    entity event and runs one chunk behind it.
    """
    value = lambda stage, col: F.max(F.when(F.col("stage") == stage, F.col(col)))
    wide = stages.groupBy("job_id").agg(
        *[value(s, c).alias(f"{s}__{c}") for s in STAGES for c in (
            "percentage", "remaining", "average_item_seconds", "cumulative_seconds")],
        *[value(ENTITY, "first").alias("_entity_first")])
    lead_done = F.greatest(F.col("_entity_first.completed") - 1, F.lit(0))
    lead_total = F.col("_entity_first.total")
    inferred = {
        "percentage": F.when(lead_total > 0, F.round(lead_done * 100.0 / lead_total, 1)).when(lead_total == 0, 100.0),
        "remaining": F.greatest(lead_total - lead_done, F.lit(0)),
    }
    for name, fallback in inferred.items():
        wide = wide.withColumn(f"{RELATION}__{name}", F.coalesce(f"{RELATION}__{name}", fallback))
    of = lambda col: [F.col(f"{s}__{col}") for s in STAGES]
    percentage = sum((F.coalesce(c, F.lit(0.0)) for c in of("percentage")), F.lit(0.0)) / len(STAGES)
    seconds = sum((F.coalesce(c, F.lit(0.0)) for c in of("cumulative_seconds")), F.lit(0.0))
    averages = F.array_compact(F.array(*of("average_item_seconds")))
    fallback = F.when(F.size(averages) > 0, F.aggregate(averages, F.lit(0.0), lambda a, v: a + v) / F.size(averages))
    part = lambda s: F.when(F.col(f"{s}__remaining") == 0, F.lit(0.0)).otherwise(
        F.col(f"{s}__remaining") * F.coalesce(F.nullif(F.col(f"{s}__average_item_seconds"), F.lit(0.0)), fallback))
    left = sum((part(s) for s in STAGES), F.lit(0.0))
    return wide.select(
        "job_id", F.round(percentage, 1).alias("overall_percentage"),
        F.when((seconds > 0) & (percentage > 0), F.round(percentage * 60.0 / seconds, 2))
        .alias("overall_speed_percent_per_minute"),
        F.round(left, 0).alias("estimated_total_remaining_seconds"))


def recover_status(status: DataFrame, artifacts: DataFrame) -> DataFrame:
    """States after a restart: abandoned jobs become paused, interrupted or error.

    ``artifacts``: doc_id, has_result, has_source.
    """
    joined = status.join(artifacts, "doc_id", "left")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    active = F.col("status").isin(ACTIVE_STATUSES)
    pausing = (F.col("status") == "pausing") | flag("pause_requested")
    done = F.coalesce("completed_chunks", F.lit(0)) > 0
    redraw = F.col("status") == "redrawing"
    state = (
        F.when(redraw, F.when(flag("has_result"), "completed").otherwise("error"))
        .when(active, F.when(pausing, "paused").when(done, "interrupted").otherwise("error"))
        .otherwise(F.col("status")))
    return joined.select(
        "doc_id", state.alias("status"), "completed_chunks",
        F.when(redraw | active, F.lit(False)).otherwise(flag("pause_requested")).alias("pause_requested"),
        F.when(active, flag("has_source")).otherwise(flag("resumable")).alias("resumable"))


def finish_status(jobs: DataFrame) -> DataFrame:
    """State of jobs that ended with ``outcome`` paused, completed or failed.

    Needs completed_chunks, total_chunks, stored_chunks, has_result and has_source.
    """
    outcome = F.col("outcome")
    done = F.when((outcome == "failed") & (F.coalesce("completed_chunks", F.lit(0)) == 0),
                  F.coalesce("stored_chunks", F.lit(0))).otherwise(F.coalesce("completed_chunks", F.lit(0)))
    partial = (F.col("_done") > 0) & F.col("has_result")
    total = F.greatest(F.coalesce("total_chunks", F.lit(0)), F.col("_done"))
    share = F.when(F.col("_done") > 0, F.round(F.col("_done") * 100.0 / total, 0)).otherwise(0.0)
    return jobs.withColumn("_done", done).select(
        "doc_id",
        F.when(outcome == "paused", "paused").when(outcome == "completed", "completed")
        .when(partial, "interrupted").otherwise("error").alias("status"),
        F.col("_done").alias("completed_chunks"), total.alias("total_chunks"),
        F.when(outcome == "completed", 100.0).when(outcome == "failed", share).alias("percentage"),
        ((outcome != "completed") & partial).alias("partial_available"),
        ((outcome != "completed") & F.col("has_source")).alias("resumable"))


def character_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"\s+", ""))


def library_listing(stored: DataFrame, status: DataFrame, texts: DataFrame, versions: DataFrame) -> DataFrame:
    """Every stored document, and every tracked job that is not stored yet.

    ``stored``: doc_id, file_name.  ``texts``: doc_id, text, edited_at, is_draft.
    ``versions``: doc_id, revision, created_at.
    """
    jobs = status.select("doc_id", "status", "percentage", "completed_chunks", "total_chunks",
                         F.col("file_name").alias("_job_file"))
    sizes = texts.select("doc_id", character_count(F.col("text")).alias("character_count"),
                         F.col("edited_at").alias("_edited"), "is_draft")
    history = versions.groupBy("doc_id").agg(
        F.max("revision").alias("document_revision"), F.max("created_at").alias("_changed"))
    here = F.col("_stored").isNotNull()
    labels = F.create_map(*[F.lit(v) for pair in STATUS_LABELS.items() for v in pair])
    merged = (
        stored.withColumn("_stored", F.lit(True)).join(jobs, "doc_id", "full_outer")
        .filter(here | F.col("status").isin(TRACKED))
        .join(sizes, "doc_id", "left").join(history, "doc_id", "left")
        .withColumn("percentage", F.when(F.col("status").isNull(), 100.0).otherwise(
            F.coalesce("percentage", F.lit(0.0))))
        .withColumn("status", F.coalesce("status", F.lit("completed"))))
    return merged.select(
        "doc_id", F.coalesce("file_name", "_job_file", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
        .alias("file_name"),
        here.alias("stored"), "status",
        F.coalesce(F.try_element_at(labels, F.col("status")), F.col("status")).alias("display_status"),
        "percentage", F.coalesce("completed_chunks", F.lit(0)).alias("completed_chunks"),
        F.coalesce("total_chunks", F.lit(0)).alias("total_chunks"),
        F.coalesce("is_draft", F.lit(False)).alias("document_modified"),
        F.coalesce("document_revision", F.lit(0)).alias("document_revision"),
        F.coalesce("character_count", F.lit(0)).alias("character_count"),
        F.greatest("_edited", "_changed").alias("last_edited_at"))


def extension_label(file_name: Column, packages: dict[str, str] | None = None) -> Column:
    """Upper-case extension; ``packages`` names longer endings such as transfer packages."""
    label = F.upper(F.element_at(F.split(file_name, r"\."), -1))
    for ending, name in (packages or {}).items():
        label = F.when(F.lower(file_name).endswith(ending), F.lit(name)).otherwise(label)
    return label


def filter_library(files: DataFrame, query: str = "", ext: str = "", status: str = "",
                   page: int = 1, size: int = 20) -> DataFrame:
    """One page of the files that match name, type and state, in name order.

    Pages past the last one show the last one.
    """
    kept = files.filter(F.contains(F.lower("file_name"), F.lit(query.strip().lower())))
    if ext:
        kept = kept.filter(extension_label(F.col("file_name")) == ext)
    if status:
        kept = kept.filter(F.col("status") == status)
    n = kept.select(F.count("*")).scalar()
    shown = F.least(F.lit(page).cast("long"), F.greatest(F.lit(1).cast("long"), F.ceil(n / size)))
    numbered = ordered_index(kept, [], [F.col("file_name"), F.col("doc_id")], "_i")
    return numbered.filter(
        (F.col("_i") >= (shown - 1) * size) & (F.col("_i") < shown * size)).drop("_i")


def viewable(files: DataFrame) -> DataFrame:
    return files.filter(
        (F.col("status") == "completed")
        | (F.col("status").isin("paused", "interrupted") & F.coalesce("partial_available", F.lit(False))))


def publish_points(steps: DataFrame, interval: int = CHECKPOINT_INTERVAL) -> DataFrame:
    """Progress rows at which results are published: every ``interval``-th chunk,
    on a pause, and at the end."""
    return steps.filter(
        (F.col("completed") % interval == 0) | F.col("paused") | (F.col("completed") == F.col("total")))
