"""Content-addressed identities as Catalyst expressions."""

from __future__ import annotations

import json
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATOR = "\x1f"


def canonical_json(value: object) -> str:
    """Sorted keys, no spaces, characters as they are; for payloads made at the ingest edge."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def record_id(source: str, source_object: str, locator: str, payload_hash: str) -> Column:
    return F.sha2(F.concat_ws(SEPARATOR, *(F.col(c) for c in (source, source_object, locator, payload_hash))), 256)


def quarantine_id(record: str, ordinal: str, key: str, payload_hash: str, error: str) -> Column:
    """One identity for each event of a record, so that several bad events of a file stay apart."""
    return F.sha2(F.concat_ws("|", record, F.col(ordinal).cast("string"), F.coalesce(key, F.lit("")), payload_hash, error), 256)


def envelopes(records: DataFrame, run_id: str, ingested_at: datetime | None = None) -> DataFrame:
    """Raw source records with their identity, the run and the date of ingestion."""
    at = (ingested_at or datetime.now(UTC)).isoformat()
    known = set(records.columns)
    optional = {c: F.lit(None).cast("string") for c in ("source_timestamp", "source_match_id", "variant_type") if c not in known}
    return (
        records.withColumns(optional)
        .withColumn("payload_hash", F.sha2("raw_payload", 256))
        .withColumn("bronze_record_id", record_id("source", "source_object", "source_record_locator", "payload_hash"))
        .withColumns({"ingestion_timestamp": F.lit(at), "pipeline_run_id": F.lit(run_id), "partition_date": F.lit(at[:10])})
        .select(
            "bronze_record_id", "source", "source_object", "source_uri", "source_commit_sha", "source_record_locator", "source_timestamp",
            "source_match_id", "variant_type", "payload_hash", "raw_payload", "ingestion_timestamp", "pipeline_run_id", "partition_date",
        )
    )
