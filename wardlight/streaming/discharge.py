"""Score discharge events as they arrive and raise alerts."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.ml import Transformer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wardlight.operators import scoring
from wardlight.sources.readers import aligned_requests


def score_events(events: DataFrame, model: Transformer, contract: Sequence[str]) -> DataFrame:
    """Stateless: (patient_id, notify_email, p) for a batch or a stream of events."""
    return scoring.with_probability(model, aligned_requests(events, contract)).select("patient_id", "notify_email", "p")


def results(scored: DataFrame) -> DataFrame:
    return scored.select("patient_id", *scoring.response_columns(F.col("p")), "scored_at")


def run_stream(
    scored: DataFrame, scores_path: str, alerts_path: str, checkpoint: str, once: bool = False,
    interval: str = "30 seconds", to_results: Callable[[DataFrame], DataFrame] = results,
    scored_at: Column | None = None,
) -> StreamingQuery:
    """Write scores and alerts of each micro-batch, with the time of scoring and by its day.

    Both come from one persisted batch. A batch has a folder named by the query's own
    id and the batch number: one that is run again after a failure overwrites its
    folder, and a query with a new checkpoint never meets folders of an earlier one. Batches without
    alerts write none. ``scored_at`` replaces the clock.
    """
    ids: list[str] = []

    def write(batch: DataFrame, number: int) -> None:
        if not ids:
            ids.append(json.loads(batch.sparkSession.read.text(f"{checkpoint}/metadata").first()[0])["id"])
        folder = f"query={ids[0]}/batch={number}"
        stamped = batch.withColumn("scored_at", F.current_timestamp() if scored_at is None else scored_at).persist()
        try:
            by_day = F.to_date("scored_at")
            to_results(stamped).withColumn("scored_day", by_day).write.mode("overwrite").partitionBy("scored_day").parquet(
                f"{scores_path}/{folder}")
            alerts = scoring.alert_rows(stamped)
            if not alerts.isEmpty():
                alerts.write.mode("overwrite").parquet(f"{alerts_path}/{folder}")
        finally:
            stamped.unpersist()

    writer = scored.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return writer.trigger(availableNow=True).start() if once else writer.trigger(processingTime=interval).start()
