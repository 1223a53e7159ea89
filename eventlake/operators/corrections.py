"""Review of quarantined rows: selection rules, transitions and audit columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlake.functions.rules import CORRECTION


@dataclass(frozen=True)
class Transition:
    status: str
    action: str
    retry: bool


TRANSITIONS = {
    "under_review": Transition("UNDER_REVIEW", "UNDER_REVIEW", False),
    "reject": Transition("REJECTED", "REJECTED", False),
    "approve": Transition("REPROCESSED", "APPROVED", True),
    "approve_failed": Transition("FAILED", "APPROVE_FAILED", True),
    "replay": Transition("REPROCESSED", "REPLAY", True),
}
REPLAYABLE = ("NEW", "UNDER_REVIEW", "FIXED")
CLOSED = ("REPROCESSED", "REJECTED")
NOT_FOUND = "ORIGINAL_EVENT_NOT_FOUND"


def id_list(ids: list[str], what: str) -> list[str]:
    if not isinstance(ids, list) or not ids or not all(isinstance(i, str) and i.strip() for i in ids):
        raise ValueError(f"{what} must be a non-empty list of non-blank strings")
    return sorted({i.strip() for i in ids})


def reason_text(reason: str | None) -> str:
    if not isinstance(reason, str) or not reason.strip():
        raise ValueError("a reason is needed")
    return reason.strip()


def select_for_resolution(quarantine: DataFrame, ids: list[str] | DataFrame) -> DataFrame:
    """The rows of all ids (a list, or a table's first column); an error unless each id is there, a correction, and still open."""
    open_rows = quarantine.where((F.col("error_type") == CORRECTION) & ~F.col("status").isin(*CLOSED))
    if isinstance(ids, DataFrame):
        wanted = ids.select(F.col(f"`{ids.columns[0]}`").alias("quarantine_id")).distinct()
        chosen, expected = open_rows.join(wanted, "quarantine_id", "left_semi"), wanted.count()
    else:
        chosen, expected = open_rows.where(F.col("quarantine_id").isin(ids)), len(set(ids))
    if not expected or chosen.count() != expected:
        raise ValueError("every id must be an open correction in quarantine")
    return chosen


def select_for_replay(quarantine: DataFrame, record_ids: list[str] | DataFrame) -> DataFrame:
    """The open rows of the records (a list, or a table's first column)."""
    waiting = quarantine.where(F.col("status").isin(*REPLAYABLE))
    if isinstance(record_ids, DataFrame):
        return waiting.join(record_ids.select(F.col(f"`{record_ids.columns[0]}`").alias("bronze_record_id")).distinct(), "bronze_record_id", "left_semi")
    return waiting.where(F.col("bronze_record_id").isin(record_ids))


def audit(rows: DataFrame, kind: str, run_id: str, note: Column, at: Column | None = None) -> DataFrame:
    """Rows after a transition, with an explicit list of columns."""
    t = TRANSITIONS[kind]
    at = F.current_timestamp() if at is None else at
    done = at if t.status == "REPROCESSED" else (F.col("reprocessed_at") if "reprocessed_at" in rows.columns else F.lit(None).cast("timestamp"))
    base = [c for c in rows.columns if c not in ("status", "retry_count", "reprocessed_at", "resolution_action", "resolution_note", "resolution_run_id", "resolved_at", "resolution_error")]
    return rows.select(
        *base, F.lit(t.status).alias("status"), (F.coalesce("retry_count", F.lit(0)) + int(t.retry)).cast("int").alias("retry_count"), done.alias("reprocessed_at"),
        F.lit(t.action).alias("resolution_action"), note.alias("resolution_note"), F.lit(run_id).alias("resolution_run_id"), at.alias("resolved_at"),
    )


def split_by_original(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """``problem`` is null where the original event exists.  One left join with a flag."""
    known = existing.select("event_id").where("event_id is not null").distinct().withColumn("_original", F.lit(True))
    return candidates.join(known, "event_id", "left").withColumn("problem", F.when(F.col("_original").isNull(), F.lit(NOT_FOUND))).drop("_original")


def judged(chosen: DataFrame, checked: DataFrame, run_id: str, note: Column) -> DataFrame:
    """The chosen rows after approval; those with a problem, or without a checked event, fail with the problem in their note."""
    found = checked.groupBy("quarantine_id").agg(F.max("problem").alias("problem"), F.lit(True).alias("seen"))
    rows = chosen.join(found, "quarantine_id", "left").withColumn("problem", F.coalesce("problem", F.when(F.col("seen").isNull(), F.lit(NOT_FOUND)))).drop("seen")
    failed, passed = rows.where("problem is not null"), rows.where("problem is null").drop("problem")
    return audit(failed, "approve_failed", run_id, F.concat_ws(" | ", "problem", note)).drop("problem").unionByName(audit(passed, "approve", run_id, note))
