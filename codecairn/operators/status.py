"""Latest project status and what it means."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import vocab
from ..functions.lookups import lookup


def latest_status(log: DataFrame) -> DataFrame:
    """Last status per project by (ts, event_id); combines on the map side."""
    last = F.max(F.struct("ts", "event_id", "status")).alias("last")
    return log.groupBy("project_id").agg(last).select("project_id", "last.status", "last.ts", "last.event_id")


def status_view(latest: DataFrame) -> DataFrame:
    """Adds stage, progress and flags. An unknown status is its own stage with progress 0."""
    status = F.col("status")
    stages = {k: stage for k, (stage, _) in vocab.STATUS_STAGES.items()}
    progress = {k: p for k, (_, p) in vocab.STATUS_STAGES.items()}
    return latest.select(
        "*",
        F.coalesce(lookup(status, stages), status).alias("stage"),
        F.coalesce(lookup(status, progress), F.lit(0)).alias("progress"),
        status.isin(vocab.COMPLETE_STATUSES).alias("is_complete"),
        (status == "error").alias("is_error"),
        status.isin(vocab.GENERATE_STATUSES).alias("can_generate"),
        (status == "complete").alias("results_ready"))
