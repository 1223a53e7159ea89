"""High watermarks kept in a table (T1-T3, S9): they only rise, and late rows are flagged, never dropped."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def current(state: DataFrame | None, source: str, entity: str):
    """The source's own watermark of the entity, else the greatest of any source, else None."""
    if state is None:
        return None
    rows = state.where(F.col("entity") == entity)
    own, every = rows.agg(F.max(F.when(F.col("source") == source, F.col("watermark"))), F.max("watermark")).first()
    return every if own is None else own


def advance(events: DataFrame, before, source: str, entity: str, run_id: str) -> DataFrame:
    """The row to merge: the greater of the old mark and the batch's; no row while both are null."""
    mark = F.max("event_timestamp") if before is None else F.greatest(F.max("event_timestamp"), F.lit(before))
    row = events.agg(mark.cast("timestamp_ntz").alias("watermark")).where("watermark is not null")
    return row.select(F.lit(source).alias("source"), F.lit(entity).alias("entity"), "watermark", F.lit(run_id).alias("pipeline_run_id"), F.current_timestamp().alias("updated_at"))


def select_bronze(bronze: DataFrame, run_id: str, ids: list[str] | None = None, lookback_minutes: int = 0, ingested_until=None) -> DataFrame:
    """Explicit ids, else a window on the time of ingestion (if it holds rows), else the run's own records."""
    if ids:
        return bronze.where(F.col("bronze_record_id").isin(ids))
    if lookback_minutes > 0 and ingested_until is not None:
        recent = bronze.where(F.col("ingestion_timestamp").cast("timestamp") >= F.lit(ingested_until - timedelta(minutes=lookback_minutes)))
        if not recent.isEmpty():
            return recent
    return bronze.where(F.col("pipeline_run_id") == run_id)
