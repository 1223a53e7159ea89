"""Every event's outcome in one pass: rules, reference check, duplicates within the batch and against the table.

One left join with the matches, one with the events that are stored already, and a window by event id on the exchange of that second join.
Rows that fail a rule take no part in duplicate detection, and rows without a match id in the first join; they carry a salt, so that the many
rows without an id do not meet in one task.  No side is broadcast by hand: AQE does so below its checked size, and joins by
sorting beyond it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventlake.functions.identity import quarantine_id
from eventlake.functions.rules import CORE_RULES, CORRECTION, EXACT_DUPLICATE, REFERENCE_RULES, VALID, first_failure

SALTS = 4096
#: What the classification needs of stored events.
STORED = ("event_payload_hash", "bronze_record_id", "pipeline_run_id", "is_late")


def with_match(events: DataFrame, matches: DataFrame) -> DataFrame:
    """Adds the match's teams and kick-off, and ``match_known``."""
    known = matches.select("match_id", F.lit(0).cast("long").alias("_spread"), "home_team_id", "away_team_id", "kickoff_timestamp", F.lit(True).alias("match_known"))
    spread = F.when(F.col("match_id").isNull(), F.pmod(F.xxhash64("bronze_record_id", "ordinal"), F.lit(SALTS)) + 1).otherwise(F.lit(0).cast("long"))
    return events.withColumn("_spread", spread).join(known, ["match_id", "_spread"], "left").drop("_spread")


def check_rows(events: DataFrame, matches: DataFrame) -> DataFrame:
    """Adds the match's columns and ``error``: the first failed core or reference rule."""
    return with_match(events, matches).withColumn("error", first_failure(*CORE_RULES, *REFERENCE_RULES))


def classify(events: DataFrame, matches: DataFrame, order: list[str], primary: str = "primary", existing: DataFrame | None = None) -> DataFrame:
    """Adds ``outcome`` (VALID, EXACT_DUPLICATE or the code of what sends the row to quarantine), ``known``, ``stored_run`` and ``stored_late``.

    Rows of one event id are ranked: source ``primary`` first, then ``order``.  A payload that differs from the stored event's waits for review.
    If the batch itself holds different payloads, rows of another source wait for review, and of the primary ones the first stays, its copies are
    duplicates and the others wait for review.  A copy of a stored event is a duplicate unless it is the very record that was stored, as
    when a run is repeated: that one is VALID and ``known``, and is not inserted again.  ``existing``: event_id and ``STORED``, one row an event.
    """
    checked = check_rows(events, matches)
    salt = F.when(F.col("error").isNotNull(), F.pmod(F.xxhash64("bronze_record_id", "ordinal", *order), F.lit(SALTS)) + 1).otherwise(F.lit(0).cast("long"))
    checked = checked.withColumn("salt", salt)
    if existing is None:
        joined = checked.withColumns({"s_hash": F.lit(None).cast("string"), "s_record": F.lit(None).cast("string"), "stored_run": F.lit(None).cast("string"), "stored_late": F.lit(None).cast("boolean")})
    else:
        names = ("s_hash", "s_record", "stored_run", "stored_late")
        stored = existing.select("event_id", F.lit(0).cast("long").alias("salt"), *(F.col(c).alias(n) for c, n in zip(STORED, names)))
        joined = checked.join(stored, ["event_id", "salt"], "left")
    same = Window.partitionBy("event_id", "salt")
    ranked = same.orderBy((F.col("source") != primary).cast("int"), *(F.col(c).asc_nulls_first() for c in [*order, "bronze_record_id", "ordinal"]))
    payload = F.col("event_payload_hash")
    outcome = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(F.col("s_hash").isNotNull() & (payload != F.col("s_hash")), F.lit(CORRECTION))
        .when((F.col("lo") != F.col("hi")) & (F.col("source") != primary), F.lit(CORRECTION))
        .when((F.col("rank") > 1) & (payload == F.col("leading")), F.lit(EXACT_DUPLICATE))
        .when(F.col("rank") > 1, F.lit(CORRECTION))
        .when(F.col("s_hash").isNotNull() & (F.col("s_record") != F.col("bronze_record_id")), F.lit(EXACT_DUPLICATE))
        .otherwise(F.lit(VALID))
    )
    judged = joined.withColumns({"rank": F.row_number().over(ranked), "leading": F.first("event_payload_hash").over(ranked), "lo": F.min("event_payload_hash").over(same), "hi": F.max("event_payload_hash").over(same)})
    return judged.withColumns({"outcome": outcome, "known": F.col("s_hash").isNotNull()}).drop("salt", "rank", "leading", "lo", "hi", "error", "s_hash", "s_record", "match_known")


def event_time():
    """Kick-off plus the match clock, by interval arithmetic."""
    return F.expr("kickoff_timestamp + make_dt_interval(0, 0, minute, coalesce(second, 0))")


def flag_late(events: DataFrame, watermark) -> DataFrame:
    """Late rows are accepted and flagged: strictly before the watermark; none without a watermark."""
    return events.withColumn("is_late", F.lit(False) if watermark is None else F.col("event_timestamp") < F.lit(watermark))


def quarantine_rows(outcomes: DataFrame, run_id: str) -> DataFrame:
    """P6, one row for each quarantined event; the writer adds the time of detection."""
    code = F.col("outcome")
    held = outcomes.where(~code.isin(VALID, EXACT_DUPLICATE)).withColumn("quarantine_id", quarantine_id("bronze_record_id", "ordinal", "event_id", "event_payload_hash", "outcome"))
    stamped = {
        "record_key": F.col("event_id"), "event_ordinal": F.col("ordinal"), "pipeline_run_id": F.lit(run_id), "error_type": code, "failed_rule": code,
        "error_message": F.format_string("Data quality rule failed: %s", code), "retry_count": F.lit(0), "status": F.lit("NEW"), "rule_version": F.lit("v1"),
    }
    return held.select("quarantine_id", "bronze_record_id", "source", *(value.alias(name) for name, value in stamped.items()))


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    """All counts of a batch in one aggregation."""
    return outcomes.agg(
        F.count("*").alias("input"),
        F.count_if(F.col("outcome") == VALID).alias("valid"),
        F.count_if(~F.col("outcome").isin(VALID, EXACT_DUPLICATE)).alias("quarantined"),
        F.count_if(F.col("outcome") == EXACT_DUPLICATE).alias("duplicates"),
    )
