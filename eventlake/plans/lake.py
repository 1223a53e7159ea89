"""The whole engine: ingest, conform, marts, publish, replay, resolve; each step is a function of a ``Lake``."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from eventlake.functions import quality
from eventlake.functions.identity import envelopes
from eventlake.functions.rules import VALID
from eventlake.operators import classify as c
from eventlake.operators import corrections, marts, parse, serve, watermark
from eventlake.sources import snapshot
from eventlake.sources.staging import remove_folder
from eventlake.sources.table import Table

#: The columns of a typed event.
SILVER_EVENT = [
    "event_id", "match_id", "team_id", "team_name", "player_id", "player_name", "event_index", "period", "event_clock", "minute", "second", "event_type",
    "shot_outcome", "card_type", "event_timestamp", "source", "variant_type", "bronze_record_id", "event_payload_hash", "pipeline_run_id",
]
ENTITY = "match_events"
EMPTY_MATCHES = "match_id long, home_team_id long, away_team_id long, kickoff_timestamp timestamp_ntz"
COUNTS = ("input", "valid", "inserted", "quarantined", "duplicates", "late")


class Lake:
    """Tables below ``root``.  Several functions may use one lake, one after the other."""

    def __init__(self, spark: SparkSession, root: str, source: str = "primary"):
        self.spark, self.root, self.source = spark, root.rstrip("/"), source
        self._staged: list[str] = []

    def table(self, name: str) -> Table:
        return Table(self.spark, f"{self.root}/{name}")

    def stage(self, df: DataFrame, run_id: str) -> DataFrame:
        """Computes once what several outputs read; below the root, which all executors share."""
        path = f"{self.root}/_staging/{run_id}-{uuid.uuid4().hex}"
        self._staged.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    @contextmanager
    def scratch(self):
        """Removes what was staged within, whatever the end."""
        first = len(self._staged)
        try:
            yield
        finally:
            for path in self._staged[first:]:
                remove_folder(self.spark, path)
            del self._staged[first:]


def ingest(lake: Lake, records: DataFrame, run_id: str, at=None) -> int:
    """Immutable envelopes by identity: a record that is already there stays as it is.  Returns the number of records offered."""
    seen = Observation()
    rows = envelopes(records, run_id, at).observe(seen, F.count(F.lit(1)).alias("n"))
    lake.table("bronze/source_records").merge(rows, ["bronze_record_id"], insert_only=True)
    return seen.get.get("n", 0)


def ingest_chunks(lake: Lake, records: Iterator[dict], run_id: str, size: int = 25, at=None) -> int:
    """Records that the driver fetches one at a time, committed in bounded chunks."""
    total = 0
    for some in snapshot.chunks(records, size):
        names = snapshot.RECORD_FIELDS
        total += ingest(lake, lake.spark.createDataFrame([tuple(r[n] for n in names) for r in some], snapshot.RECORD), run_id, at)
    return total


def _dimensions(lake: Lake, bronze: DataFrame, run_id: str) -> DataFrame:
    """Merges matches, teams, stadiums and line-up players; returns all matches known."""
    found = parse.parse_matches(bronze)
    latest = found.groupBy("match_id").agg(F.max_by(F.struct(*[x for x in found.columns if x != "match_id"]), F.struct("kickoff_timestamp", "bronze_record_id")).alias("m")).select("match_id", "m.*")
    latest = lake.stage(latest.select(found.columns).withColumn("pipeline_run_id", F.lit(run_id)), run_id)
    if not latest.isEmpty():
        lake.table("silver/matches").merge(latest, ["match_id"], unique=True)
        lake.table("silver/teams").merge(parse.teams(latest), ["team_id"], unique=True)
        lake.table("silver/stadiums").merge(parse.stadiums(latest), ["stadium_id"], unique=True)
    lake.table("silver/players").merge(parse.parse_lineups(bronze), ["player_id"], unique=True)
    known = lake.table("silver/matches").read_or_none()
    return lake.spark.createDataFrame([], EMPTY_MATCHES) if known is None else known


def _conform(lake: Lake, run_id: str, ids: list[str] | None, lookback_minutes: int, ingested_until, thresholds: quality.Thresholds) -> tuple[quality.Assessment, DataFrame]:
    bronze = watermark.select_bronze(lake.table("bronze/source_records").read(), run_id, ids, lookback_minutes, ingested_until)
    matches = _dimensions(lake, bronze, run_id)

    state, silver = lake.table("ops/processing_watermarks"), lake.table("silver/match_events")
    stored = silver.read_or_none()
    mark = watermark.current(state.read_or_none(), lake.source, ENTITY)
    if mark is None and stored is not None:
        mark = stored.agg(F.max("event_timestamp")).first()[0]

    events = parse.parse_events(bronze)
    events = events.unionByName(parse.unreadable_files(bronze, events))
    order = ["variant_type", "bronze_record_id", "ordinal", "event_payload_hash"]
    judged = c.classify(events, matches, order, lake.source, stored).withColumns({"event_timestamp": c.event_time(), "pipeline_run_id": F.lit(run_id)})
    outcomes = lake.stage(c.flag_late(judged, mark), run_id)

    # A repeated run meets its own rows again: they count as before and are not inserted twice.
    new, own = F.expr("outcome = 'VALID' AND NOT known"), F.col("stored_run").eqNullSafe(run_id) & (F.col("outcome") == VALID)
    fresh = outcomes.where(new).select(*SILVER_EVENT, "is_late")
    silver.merge(fresh, ["event_id"], insert_only=True)
    state.merge(watermark.advance(fresh, mark, lake.source, ENTITY, run_id), ["source", "entity"])
    seen = fresh.where("player_id is not null").groupBy("player_id").agg(F.max(F.struct("player_name", "team_id")).alias("b"))
    seen = seen.select("player_id", "b.player_name", "b.team_id", F.lit(None).cast("string").alias("position"), F.lit(run_id).alias("pipeline_run_id"))
    lake.table("silver/players").merge(seen, ["player_id"], keep=("position",), unique=True)
    bad = c.quarantine_rows(outcomes, run_id).withColumns({"detected_at": F.current_timestamp(), "reprocessed_at": F.lit(None).cast("timestamp")})
    lake.table("quarantine/match_events").merge(bad, ["quarantine_id"], insert_only=True)

    entered = outcomes.agg(F.count_if(new | own).alias("inserted"), F.count_if((new & F.col("is_late")) | (own & F.col("stored_late"))).alias("late"))
    counts = c.outcome_counts(outcomes).first().asDict() | entered.first().asDict()
    metrics = lake.spark.createDataFrame([(run_id, *(counts[k] for k in COUNTS))], "pipeline_run_id string, " + ", ".join(f"{k} long" for k in COUNTS))
    for name, column in quality.status_columns(thresholds).items():
        metrics = metrics.withColumn(name, column)
    lake.table("ops/quality_metrics").merge(metrics.withColumn("created_at", F.current_timestamp()), ["pipeline_run_id"])
    return quality.assess(counts, thresholds), outcomes


def conform(lake: Lake, run_id: str, ids: list[str] | None = None, lookback_minutes: int = 0, ingested_until=None, thresholds=quality.Thresholds(), alert: Callable[[str], object] | None = None) -> quality.Assessment:
    """Bronze to typed tables, quarantine, watermark and metrics; then the gate, which may raise.

    Every event of the batch is counted once: ``input`` = ``valid`` + ``quarantined`` + ``duplicates``; ``inserted`` are the valid ones this run added.
    """
    with lake.scratch():
        assessment, _ = _conform(lake, run_id, ids, lookback_minutes, ingested_until, thresholds)
    quality.enforce(assessment, alert)
    return assessment


def build_marts(lake: Lake, run_id: str, match_ids: list[int] | None = None) -> None:
    """Recomputes the marts of affected keys only; the distribution as a whole."""
    matches, events = lake.table("silver/matches").read_or_none(), lake.table("silver/match_events").read()
    stamp = F.lit(run_id).alias("pipeline_run_id")
    lake.table("gold/event_distribution").overwrite(marts.event_distribution(events).select("*", stamp))
    if matches is None:
        return
    own = F.col("pipeline_run_id") == run_id
    affected = matches.where(F.col("match_id").isin(match_ids)).select("match_id") if match_ids else marts.affected_matches(events.where(own), matches.where(own))
    with lake.scratch():
        affected = lake.stage(affected, run_id)
        if not affected.isEmpty():
            lake.table("gold/match_summary").merge(marts.match_summary(matches, events, affected).select("*", stamp), ["match_id"], unique=True)
            lake.table("gold/team_performance").merge(marts.team_performance(matches, marts.affected_teams(matches, affected)).select("*", stamp), ["team_id"], unique=True)


def publish(lake: Lake, connect: Callable[[], object], mark: str = "?") -> dict[str, int]:
    """Serves every mart that exists, all in one transaction, and returns their rows after it."""
    found = {name: lake.table(f"gold/{name}").read_or_none() for name in serve.SERVED}
    return serve.publish({f"gold_{name}": (mart, *serve.SERVED[name]) for name, mart in found.items() if mart is not None}, connect, mark)


def run_daily(lake: Lake, records: DataFrame, run_id: str, connect: Callable[[], object] | None = None, **gate) -> quality.Assessment:
    ingest(lake, records, run_id)
    assessment = conform(lake, run_id, **gate)
    build_marts(lake, run_id)
    if connect is not None:
        publish(lake, connect)
    return assessment


def replay(lake: Lake, record_ids: list[str], reason: str, run_id: str, thresholds=quality.Thresholds(), alert: Callable[[str], object] | None = None) -> None:
    """Conforms chosen records again and marks as reprocessed those of their open quarantine rows whose event got into the typed table."""
    ids, reason = corrections.id_list(record_ids, "record ids"), corrections.reason_text(reason)
    with lake.scratch():
        assessment, outcomes = _conform(lake, run_id, ids, 0, None, thresholds)
        quality.enforce(assessment, alert)
        applied = outcomes.where(F.col("outcome") == VALID).select("bronze_record_id", F.col("ordinal").alias("event_ordinal"))
        held = lake.table("quarantine/match_events")
        rows = corrections.select_for_replay(held.read(), ids).join(applied, ["bronze_record_id", "event_ordinal"], "left_semi")
        held.merge(lake.stage(corrections.audit(rows, "replay", run_id, F.lit(reason)), run_id), ["quarantine_id"])
    build_marts(lake, run_id)


def resolve(lake: Lake, quarantine_ids: list[str] | DataFrame, action: str, note: str, run_id: str) -> None:
    """``under_review``, ``reject`` or ``approve``.  An approved correction is parsed and checked again, and replaces its original."""
    ids = quarantine_ids if isinstance(quarantine_ids, DataFrame) else corrections.id_list(quarantine_ids, "quarantine ids")
    if action not in ("under_review", "reject", "approve"):
        raise ValueError(f"unknown action {action!r}")
    held, noted = lake.table("quarantine/match_events"), F.lit(note or None).cast("string")
    with lake.scratch():
        chosen = corrections.select_for_resolution(held.read(), ids)
        if action == "approve":
            done = _approve(lake, chosen, noted, run_id)
        else:
            done = corrections.audit(chosen, action, run_id, noted)
        held.merge(lake.stage(done, run_id), ["quarantine_id"])
    if action == "approve":
        build_marts(lake, run_id)


def _approve(lake: Lake, chosen: DataFrame, note: Column, run_id: str) -> DataFrame:
    """Puts those of the chosen corrections that still pass into the typed table; returns all of them after their transition."""
    wanted = chosen.select("bronze_record_id", F.col("event_ordinal").alias("ordinal"), "quarantine_id")
    bronze = lake.table("bronze/source_records").read().join(wanted.select("bronze_record_id").distinct(), "bronze_record_id", "left_semi")
    events = parse.parse_events(bronze).join(wanted, ["bronze_record_id", "ordinal"])
    checked = c.check_rows(events, lake.table("silver/matches").read())
    silver = lake.table("silver/match_events")
    checked = corrections.split_by_original(checked, silver.read()).withColumn("problem", F.coalesce("error", "problem"))
    checked = lake.stage(checked.withColumns({"event_timestamp": c.event_time(), "pipeline_run_id": F.lit(run_id)}), run_id)
    state = lake.table("ops/processing_watermarks")
    mark = watermark.current(state.read_or_none(), lake.source, ENTITY)
    good = c.flag_late(checked.where("problem is null").select(SILVER_EVENT), mark)
    silver.merge(good, ["event_id"])
    state.merge(watermark.advance(good, mark, lake.source, ENTITY, run_id), ["source", "entity"])
    return corrections.judged(chosen, checked, run_id, note)
