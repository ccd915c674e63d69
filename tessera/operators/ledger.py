"""Comparison of clips, and analytics of a ledger of chunk attempts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .pixels import CHANNELS, KEY

#: Failures that end a chunk, and errors that end a job.
CHUNK_FAILURES, JOB_ERRORS = 3, 20


def frame_diff_report(a: DataFrame, b: DataFrame, outlier: int = 16, mean: float = 2.0, share: float = 0.02) -> DataFrame:
    """(clip_id, frame, mean_abs, outliers, passed) of two renders; a pixel of one alone differs by its own value."""
    cols = [*CHANNELS, "a"]
    other = b.select(*KEY, *(F.col(c).alias(f"{c}2") for c in cols))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    d = a.select(*KEY, *cols).join(other, KEY, "full").select(*KEY, F.array(*(F.abs(zero(c) - zero(f"{c}2")) for c in cols)).alias("d"))
    d = d.groupBy("clip_id", "frame").agg((F.avg(F.aggregate("d", F.lit(0), lambda x, y: x + y)) / 4).alias("mean_abs"), F.avg((F.array_max("d") > outlier).cast("double")).alias("outliers"))
    return d.withColumn("passed", (F.col("mean_abs") <= mean) & (F.col("outliers") <= share))


def chunk_status(events: DataFrame) -> DataFrame:
    """(job_id, chunk_id, status) by the attempts that count (see ``attempt_outcomes``)."""
    d = _counted(events)
    return d.groupBy("job_id", "chunk_id").agg(F.when(F.max((F.col("result") == "ok").cast("int")) == 1, "completed").when(F.count_if(F.col("result") == "failed") >= CHUNK_FAILURES, "failed").otherwise("pending").alias("status"))


def job_progress(chunks: DataFrame) -> DataFrame:
    """(job_id, total, completed, failed, progress): the share of finished chunks in per cent, 0.0 for none."""
    d = chunks.groupBy("job_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"))
    return d.withColumn("progress", F.when(F.col("total") == 0, 0.0).otherwise(F.round((F.col("completed") + F.col("failed")) / F.col("total") * 100, 1)))


def _counted(events: DataFrame) -> DataFrame:
    """Attempts at chunks that had neither succeeded nor failed for good, numbered, up to the job's own failure."""
    before = Window.partitionBy("job_id", "chunk_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    d = events.withColumn("_ok", F.coalesce(F.sum((F.col("result") == "ok").cast("int")).over(before), F.lit(0))).withColumn("_fails", F.coalesce(F.sum((F.col("result") == "failed").cast("int")).over(before), F.lit(0)))
    d = d.where(f"_ok = 0 and _fails < {CHUNK_FAILURES}").withColumn("attempt", F.when(F.col("result") == "failed", F.col("_fails") + 1))
    job = Window.partitionBy("job_id").orderBy("ts", "event_id")
    d = d.withColumn("errors", F.count("attempt").over(job.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn("_end", F.col("attempt").isNotNull() & (F.col("attempt") < CHUNK_FAILURES) & (F.col("errors") >= JOB_ERRORS))
    d = d.withColumn("_over", F.coalesce(F.max(F.col("_end").cast("int")).over(job.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return d.where("_over = 0").drop("_ok", "_fails", "_over")


def attempt_outcomes(events: DataFrame) -> DataFrame:
    """(job_id, completed, failed_for_good, errors, job_failed, failed_at, players) of (job_id, chunk_id, player_id, event_id, ts, result).

    A chunk ends with its success or third failure. A job fails when its errors reach 20 at a
    failure that isn't a chunk's third. What comes later counts for nothing.
    """
    d = _counted(events)
    return d.groupBy("job_id").agg(
        F.count_if(F.col("result") == "ok").alias("completed"), F.count_if(F.col("attempt") == CHUNK_FAILURES).alias("failed_for_good"), F.max("errors").alias("errors"),
        F.coalesce(F.bool_or("_end"), F.lit(False)).alias("job_failed"), F.min(F.when(F.col("_end"), F.col("event_id"))).alias("failed_at"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("attempt").isNotNull(), F.col("player_id")))), ",").alias("players"),
    )


def job_status(chunks: DataFrame) -> DataFrame:
    """(job_id, status, message): processing until all chunks are done, then completed or failed."""
    p = job_progress(chunks)
    done = F.col("completed") + F.col("failed") >= F.col("total")
    status = F.when(~done, "processing").when(F.col("failed") == 0, "completed").otherwise("failed")
    return p.select("job_id", status.alias("status"), F.when(status == "failed", F.format_string("%d of %d chunks could not be rendered", "failed", "total")).alias("message"))


def merge_plan(chunks: DataFrame) -> DataFrame:
    """(job_id, chunk_id, start_frame, end_frame, position, fault): merge order; a gap or overlap to the next is a fault."""
    w = Window.partitionBy("job_id").orderBy("start_frame", "chunk_id")
    nxt = F.lead("start_frame").over(w)
    fault = F.when(nxt > F.col("end_frame") + 1, "gap").when(nxt <= F.col("end_frame"), "overlap")
    return chunks.select("job_id", "chunk_id", "start_frame", "end_frame", F.row_number().over(w).alias("position"), fault.alias("fault"))
