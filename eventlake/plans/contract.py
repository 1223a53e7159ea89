"""Name -> query and oracle SQL of the core engine, over the derived domain model (``sources.fixtures``)."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlake.functions import quality
from eventlake.functions.identity import envelopes
from eventlake.functions.rules import CORE_RULES, CORRECTION, VALID, first_failure
from eventlake.operators import classify as c
from eventlake.operators import corrections, marts, parse, watermark
from eventlake.plans import lake as engine
from eventlake.sources import fixtures, snapshot, staging
from eventlake.sources.fixtures import table
from eventlake.sources.staging import materialize, shared_folder
from eventlake.sources.table import Table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

ORDER = ["variant_type", "k"]

MODEL = r"""
WITH m AS (SELECT o_orderkey AS match_id, true AS match_known, CASE WHEN o_orderkey % 71 <> 0 THEN o_custkey END AS home_team_id,
  CASE WHEN o_orderkey % 67 <> 0 THEN o_custkey + 1 + o_orderkey % 24 END AS away_team_id,
  CAST(o_orderkey % 5 AS INT) AS home_score, CASE WHEN o_orderkey % 61 = 0 THEN NULL ELSE CAST((o_orderkey * 7) % 4 AS INT) END AS away_score,
  o_orderdate AS kickoff_timestamp, o_orderkey // 400 AS season_id FROM orders),
slots AS (SELECT *, event_id // 20 % (SELECT count(*) FROM orders) AS slot FROM events),
base AS (SELECT 'primary' AS source, CAST(NULL AS VARCHAR) AS variant_type, e.event_id AS k,
  CASE WHEN e.event_id % 101 = 0 THEN NULL ELSE 'ev-' || e.event_id END AS event_id,
  CASE WHEN slot % 23 = 0 THEN NULL WHEN slot % 25 = 24 THEN -1 - slot ELSE slot END AS match_id,
  CASE WHEN e.event_id % 107 = 0 THEN NULL WHEN e.event_id % 53 = 0 THEN -1 WHEN e.event_id % 2 = 0 THEN o_custkey ELSE o_custkey + 1 + o_orderkey % 24 END AS team_id,
  CAST(CASE WHEN e.event_id % 109 = 0 THEN 200 WHEN e.event_id % 113 = 0 THEN NULL WHEN e.event_id % 127 = 0 THEN -1 ELSE e.event_id % 131 END AS INT) AS minute,
  CAST(CASE WHEN e.event_id % 11 = 0 THEN NULL ELSE e.user_id % 60 END AS INT) AS second,
  CASE e.event_type WHEN 'purchase' THEN 'SHOT' WHEN 'click' THEN 'PASS' WHEN 'view' THEN 'CARRY' WHEN 'signup' THEN 'PRESSURE' ELSE 'FOUL COMMITTED' END AS event_type,
  CASE WHEN e.event_type <> 'error' THEN NULL WHEN e.event_id % 10 = 0 THEN 'RED CARD' WHEN e.event_id % 10 = 1 THEN 'SECOND YELLOW' WHEN e.event_id % 10 < 6 THEN 'YELLOW CARD' END AS card_type,
  e.user_id AS player_id, false AS malformed FROM slots e LEFT JOIN orders o ON o.o_orderkey = slot),
ev AS (SELECT * FROM base
  UNION ALL SELECT 'synthetic', 'exact_duplicate', k, event_id, match_id, team_id, minute, second, event_type, card_type, player_id, false FROM base WHERE k % 97 = 5
  UNION ALL SELECT 'synthetic', 'event_correction', k, event_id, match_id, team_id, minute, second, 'SUBSTITUTION', card_type, player_id, false FROM base WHERE k % 89 = 7
  UNION ALL SELECT 'synthetic', 'late_event', k, event_id || '-late', match_id, team_id, 1, second, event_type, card_type, player_id, false FROM base WHERE k % 83 = 11
  UNION ALL SELECT 'primary', 'primary_conflict', k, event_id, match_id, team_id, minute, second, 'BLOCK', card_type, player_id, false FROM base WHERE k % 79 = 13
  UNION ALL SELECT 'synthetic', 'malformed_payload', k, NULL, match_id, NULL, NULL, NULL, NULL, NULL, NULL, true FROM base WHERE k % 139 = 3),
core AS (SELECT *, CASE WHEN malformed THEN 'MALFORMED_PAYLOAD' WHEN event_id IS NULL THEN 'MISSING_EVENT_ID' WHEN match_id IS NULL THEN 'MISSING_MATCH_ID' WHEN team_id IS NULL THEN 'MISSING_TEAM_ID'
  WHEN minute IS NULL OR minute < 0 OR minute > 130 THEN 'INVALID_MATCH_MINUTE' END AS core_error,
  sha256(concat_ws('|', event_id, match_id, team_id, minute, second, event_type, card_type)) AS event_payload_hash,
  sha256(concat_ws(':', source, coalesce(variant_type, ''), CASE WHEN variant_type IS NULL THEN k // 20 ELSE k END)) AS bronze_record_id,
  CASE WHEN variant_type IS NULL THEN CAST(k % 20 AS INT) ELSE 0 END AS ordinal FROM ev),
checked AS (SELECT core.*, home_team_id, away_team_id, kickoff_timestamp, CASE WHEN core_error IS NOT NULL THEN core_error WHEN match_known IS NULL THEN 'UNKNOWN_MATCH'
  WHEN team_id IS DISTINCT FROM home_team_id AND team_id IS DISTINCT FROM away_team_id THEN 'INVALID_TEAM_MATCH_RELATIONSHIP' END AS error FROM core LEFT JOIN m USING (match_id)),
ranked AS (SELECT *, min(event_payload_hash) OVER w AS lo, max(event_payload_hash) OVER w AS hi, row_number() OVER o AS rn, first_value(event_payload_hash) OVER o AS lead_hash
  FROM checked WHERE error IS NULL WINDOW w AS (PARTITION BY event_id), o AS (PARTITION BY event_id ORDER BY CASE WHEN source = 'primary' THEN 0 ELSE 1 END, variant_type NULLS FIRST, k)),
outcomes AS (SELECT * EXCLUDE (lo, hi, rn, lead_hash), CASE WHEN lo <> hi AND source <> 'primary' THEN 'EVENT_CORRECTION_REQUIRES_REVIEW' WHEN rn = 1 THEN 'VALID'
    WHEN event_payload_hash = lead_hash THEN 'EXACT_DUPLICATE' ELSE 'EVENT_CORRECTION_REQUIRES_REVIEW' END AS outcome FROM ranked
  UNION ALL SELECT *, error FROM checked WHERE error IS NOT NULL),
timed AS (SELECT *, kickoff_timestamp + to_seconds(minute * 60 + coalesce(second, 0)) AS event_timestamp FROM outcomes),
held AS (SELECT *, sha256(concat_ws('|', bronze_record_id, ordinal, coalesce(event_id, ''), event_payload_hash, outcome)) AS quarantine_id FROM outcomes WHERE outcome NOT IN ('VALID', 'EXACT_DUPLICATE')),
silver AS (SELECT * FROM timed WHERE outcome = 'VALID'),
first_batch AS (SELECT * FROM silver WHERE kickoff_timestamp < TIMESTAMP '1999-01-01' AND variant_type IS NULL),
mark AS (SELECT max(event_timestamp) AS w FROM first_batch),
ec AS (SELECT match_id, count(*) AS event_count, CAST(sum(CASE WHEN event_type = 'SHOT' THEN 1 ELSE 0 END) AS BIGINT) AS shot_count,
  CAST(sum(CASE WHEN card_type = 'YELLOW CARD' THEN 1 ELSE 0 END) AS BIGINT) AS yellow_card_count,
  CAST(sum(CASE WHEN card_type IN ('RED CARD', 'SECOND YELLOW') THEN 1 ELSE 0 END) AS BIGINT) AS red_card_count FROM silver GROUP BY match_id),
summary AS (SELECT m.match_id, CAST(1 AS BIGINT) AS competition_id, 'League' AS competition_name, season_id, 'Season ' || season_id AS season_name, CAST(kickoff_timestamp AS DATE) AS match_date,
  home_team_id, 'Team ' || home_team_id AS home_team_name, away_team_id, 'Team ' || away_team_id AS away_team_name, home_score, away_score,
  CASE WHEN home_score > away_score THEN 'Team ' || home_team_id WHEN away_score > home_score THEN 'Team ' || away_team_id ELSE 'DRAW' END AS winner,
  coalesce(home_score, 0) + coalesce(away_score, 0) AS goal_count, coalesce(yellow_card_count, 0) AS yellow_card_count, coalesce(red_card_count, 0) AS red_card_count,
  coalesce(shot_count, 0) AS shot_count, coalesce(event_count, 0) AS event_count FROM m LEFT JOIN ec USING (match_id)),
sides AS (SELECT match_id, home_team_id AS team_id, home_score AS gf, away_score AS ga FROM m WHERE home_team_id IS NOT NULL
  UNION ALL SELECT match_id, away_team_id, away_score, home_score FROM m WHERE away_team_id IS NOT NULL),
perf AS (SELECT *, goals_for - goals_against AS goal_difference, wins * 3 + draws AS points FROM (SELECT team_id, 'Team ' || team_id AS team_name, count(*) AS matches_played, count(*) FILTER (WHERE gf > ga) AS wins,
  count(*) FILTER (WHERE gf = ga) AS draws, count(*) FILTER (WHERE gf < ga) AS losses, CAST(sum(gf) AS BIGINT) AS goals_for, CAST(sum(ga) AS BIGINT) AS goals_against FROM sides GROUP BY team_id)),
dist AS (SELECT event_type, CAST(minute // 15 * 15 AS INT) AS minute_bucket, count(*) AS event_count FROM silver GROUP BY ALL)
"""


def query(name: str, sql: str | None = None, model: bool = True) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = (MODEL if model else "") + sql
        return f

    return add


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.classify(fixtures.events(spark, sf_dir), fixtures.matches(spark, sf_dir), ORDER).withColumn("event_timestamp", c.event_time())


def staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outcomes, computed once for queries that read them several times."""
    return materialize(outcomes(spark, sf_dir), "contract-outcomes")


def silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes(spark, sf_dir).where(F.col("outcome") == VALID)


# --- sources, identity, merge ----------------------------------------------------------------------------------------


@query(
    "bronze_identity_hash",
    "SELECT event_id, sha256(props) AS payload_hash, sha256(concat_ws(chr(31), 'events', 'event', event_id, sha256(props))) AS bronze_record_id FROM events",
    model=False,
)
def bronze_identity_hash(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    text = lambda v: F.lit(v)
    records = e.select(text("events").alias("source"), text("event").alias("source_object"), text("").alias("source_uri"), text("").alias("source_commit_sha"), F.col("event_id").cast("string").alias("source_record_locator"), F.col("props").alias("raw_payload"))
    return envelopes(records, "contract").select(F.col("source_record_locator").cast("long").alias("event_id"), "payload_hash", "bronze_record_id")


def _merged(spark: SparkSession, sf_dir: str, insert_only: bool) -> DataFrame:
    """A table of half the customers, merged with an overlapping three quarters of changed ones."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    target = Table(spark, shared_folder(spark, "merge"))
    target.merge(customers.where("c_custkey % 4 < 2"), ["c_custkey"])
    target.merge(customers.where("c_custkey % 4 <> 0").withColumn("c_nationkey", F.expr("c_nationkey + 100")), ["c_custkey"], insert_only=insert_only)
    return target.read()


@query("merge_upsert", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN c_nationkey ELSE c_nationkey + 100 END AS c_nationkey FROM customer", model=False)
def merge_upsert(spark, sf_dir):
    return _merged(spark, sf_dir, insert_only=False)


@query("bronze_insert_only_merge", "SELECT c_custkey, CASE WHEN c_custkey % 4 < 2 THEN c_nationkey ELSE c_nationkey + 100 END AS c_nationkey FROM customer", model=False)
def insert_only_merge(spark, sf_dir):
    return _merged(spark, sf_dir, insert_only=True)


@query("table_overwrite", "SELECT c_nationkey AS nation, count(*) AS customers FROM customer GROUP BY 1", model=False)
def table_overwrite(spark, sf_dir):
    """K4: a snapshot with another schema, made from the table's own last one."""
    target = Table(spark, shared_folder(spark, "overwrite"))
    target.overwrite(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"))
    target.overwrite(target.read().groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("customers")))
    return target.read()


@query("incremental_lookback", "SELECT event_id, event_type FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 3 DAY", model=False)
def incremental_lookback(spark, sf_dir):
    """No ids are given, so the records of the last three days of ingestion are taken, whatever their run."""
    e = table(spark, sf_dir, "events")
    last = e.agg(F.max("ts")).first()[0]
    records = e.select("event_id", "event_type", F.col("event_id").cast("string").alias("bronze_record_id"), F.lit("other").alias("pipeline_run_id"), F.col("ts").cast("string").alias("ingestion_timestamp"))
    return watermark.select_bronze(records, "contract", None, 3 * 24 * 60, last).select("event_id", "event_type")


@query("incremental_by_ids", "SELECT event_id, event_type, value FROM events WHERE event_id IN (1, 5, 42, 77, 900)", model=False)
def incremental_by_ids(spark, sf_dir):
    return table(spark, sf_dir, "events").where(F.col("event_id").isin(1, 5, 42, 77, 900)).select("event_id", "event_type", "value")


@query("parse_event_json", "SELECT event_id, CAST(props ->> 'k' AS INT) AS k FROM events", model=False)
def parse_event_json(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k INT")["k"].alias("k"))


@query("parse_event_payloads", "SELECT bronze_record_id, ordinal, source, variant_type, match_id, event_id, CASE WHEN NOT malformed THEN k END AS event_index, malformed, minute, second, event_type, team_id, player_id, card_type FROM core")
def parse_event_payloads(spark, sf_dir):
    parsed = parse.parse_events(fixtures.event_payloads(spark, sf_dir))
    return parsed.select("bronze_record_id", "ordinal", "source", "variant_type", "match_id", "event_id", "event_index", "malformed", "minute", "second", "event_type", "team_id", "player_id", "card_type")


@query("parse_match_payloads", "SELECT match_id, season_id, CAST(kickoff_timestamp AS DATE) AS match_date, kickoff_timestamp, home_team_id, away_team_id, 'Team ' || home_team_id AS home_team_name, home_score, away_score FROM m")
def parse_match_payloads(spark, sf_dir):
    parsed = parse.parse_matches(fixtures.match_payloads(spark, sf_dir))
    return parsed.select("match_id", "season_id", "match_date", "kickoff_timestamp", "home_team_id", "away_team_id", "home_team_name", "home_score", "away_score")


@query(
    "parse_lineup_payloads",
    "SELECT c_custkey AS player_id, 'Player ' || c_custkey AS player_name, CAST(c_nationkey AS BIGINT) AS team_id, CASE WHEN c_custkey % 3 <> 0 THEN 'P' || c_custkey % 4 END AS position FROM customer",
    model=False,
)
def parse_lineup_payloads(spark, sf_dir):
    return parse.parse_lineups(fixtures.lineup_payloads(spark, sf_dir)).select("player_id", "player_name", "team_id", "position")


# --- validation ------------------------------------------------------------------------------------------------------


@query("core_rule_outcome", "SELECT k, variant_type, core_error FROM core")
def core_rule_outcome(spark, sf_dir):
    return fixtures.events(spark, sf_dir).select("k", "variant_type", first_failure(*CORE_RULES).alias("core_error"))


@query("reference_rule_outcome", "SELECT k, variant_type, error FROM checked WHERE core_error IS NULL")
def reference_rule_outcome(spark, sf_dir):
    checked = c.check_rows(fixtures.events(spark, sf_dir), fixtures.matches(spark, sf_dir))
    return checked.where(first_failure(*CORE_RULES).isNull()).select("k", "variant_type", "error")


@query("duplicate_classification", "SELECT k, variant_type, event_id, outcome FROM outcomes")
def duplicate_classification(spark, sf_dir):
    return outcomes(spark, sf_dir).select("k", "variant_type", "event_id", "outcome")


@query("outcome_counts", "SELECT outcome, count(*) AS n FROM outcomes GROUP BY outcome")
def outcome_counts(spark, sf_dir):
    return outcomes(spark, sf_dir).groupBy("outcome").agg(F.count("*").alias("n"))


@query("malformed_payload", "SELECT bronze_record_id, error_type, n FROM (SELECT bronze_record_id, outcome AS error_type, count(*) AS n FROM held WHERE outcome = 'MALFORMED_PAYLOAD' GROUP BY ALL)")
def malformed_payload(spark, sf_dir):
    """Broken payloads, read from the raw records: each is an event of the input and a row of the quarantine."""
    parsed = parse.parse_events(fixtures.event_payloads(spark, sf_dir)).withColumn("kickoff_timestamp", F.lit(None))
    held = c.quarantine_rows(c.classify(parsed.drop("kickoff_timestamp"), fixtures.matches(spark, sf_dir), ["variant_type", "event_index"]), "contract")
    return held.where("error_type = 'MALFORMED_PAYLOAD'").groupBy("bronze_record_id", "error_type").agg(F.count("*").alias("n"))


@query("primary_conflict", "SELECT k, variant_type, outcome FROM outcomes WHERE event_id IN (SELECT event_id FROM checked WHERE variant_type = 'primary_conflict' AND error IS NULL)")
def primary_conflict(spark, sf_dir):
    """Different payloads of the primary source: the first stays, the others wait for review."""
    rows = staged(spark, sf_dir)
    ids = rows.where(F.col("outcome").isin(VALID, CORRECTION, "EXACT_DUPLICATE") & (F.col("variant_type") == "primary_conflict")).select("event_id")
    return rows.join(ids, "event_id", "left_semi").select("k", "variant_type", "outcome")


@query(
    "cross_batch_correction",
    """SELECT k, CASE WHEN error IS NOT NULL THEN error WHEN k % 5 = 1 THEN 'VALID' WHEN k % 3 = 0 THEN 'EVENT_CORRECTION_REQUIRES_REVIEW' WHEN k % 7 = 2 THEN 'VALID' ELSE 'EXACT_DUPLICATE' END AS outcome,
  error IS NULL AND k % 5 <> 1 AS known FROM checked WHERE variant_type IS NULL""",
)
def cross_batch_correction(spark, sf_dir):
    """A batch against the events that an earlier one stored."""
    stored = silver(spark, sf_dir).withColumns({"pipeline_run_id": F.lit("first"), "is_late": F.lit(False)})
    return c.classify(fixtures.second_batch(spark, sf_dir), fixtures.matches(spark, sf_dir), ORDER, existing=stored).select("k", "outcome", "known")


HELD = "quarantine_id, bronze_record_id, source, record_key, event_ordinal, error_type, error_message, retry_count, status"


@query("quarantine_rows", "SELECT quarantine_id, bronze_record_id, source, event_id AS record_key, ordinal AS event_ordinal, outcome AS error_type, 'Data quality rule failed: ' || outcome AS error_message, 0 AS retry_count, 'NEW' AS status FROM held")
def quarantine_rows(spark, sf_dir):
    return c.quarantine_rows(outcomes(spark, sf_dir), "contract").select(*HELD.split(", "))


@query("quarantine_unique", "SELECT outcome AS error_type, count(*) AS rows, count(DISTINCT quarantine_id) AS ids, count(DISTINCT bronze_record_id) AS records FROM held GROUP BY 1")
def quarantine_unique(spark, sf_dir):
    """Files hold several bad events: as many ids as rows, more than records."""
    held = c.quarantine_rows(outcomes(spark, sf_dir), "contract")
    return held.groupBy("error_type").agg(F.count("*").alias("rows"), F.count_distinct("quarantine_id").alias("ids"), F.count_distinct("bronze_record_id").alias("records"))


# --- state -----------------------------------------------------------------------------------------------------------


FIRST = "kickoff_timestamp < TIMESTAMP_NTZ '1999-01-01 00:00:00' AND variant_type IS NULL"


def _batches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = staged(spark, sf_dir).where(F.col("outcome") == VALID)
    return rows.where(FIRST), rows.where(f"NOT ({FIRST})")


SECOND = "NOT (kickoff_timestamp < TIMESTAMP '1999-01-01' AND variant_type IS NULL)"


@query("late_events", f"SELECT event_id, event_timestamp, event_timestamp < w AS is_late FROM silver CROSS JOIN mark WHERE {SECOND}")
def late_events(spark, sf_dir):
    first, second = _batches(spark, sf_dir)
    mark = first.agg(F.max("event_timestamp")).first()[0]
    return c.flag_late(second, mark).select("event_id", "event_timestamp", "is_late")


@query("watermark_monotonic", "SELECT batch_no, CASE WHEN batch_no = 1 THEN w ELSE (SELECT max(event_timestamp) FROM silver) END AS watermark FROM mark CROSS JOIN (SELECT unnest([1, 2]) AS batch_no)")
def watermark_monotonic(spark, sf_dir):
    first, second = _batches(spark, sf_dir)
    one = watermark.advance(first, None, "primary", "match_events", "1")
    before = one.first().watermark
    two = watermark.advance(second, before, "primary", "match_events", "2")
    return one.unionByName(two).select(F.col("pipeline_run_id").cast("int").alias("batch_no"), "watermark")


@query("silver_new_events", "SELECT event_id, match_id, minute, event_type FROM silver WHERE event_id NOT IN (SELECT event_id FROM first_batch)")
def silver_new_events(spark, sf_dir):
    first, second = _batches(spark, sf_dir)
    return first.unionByName(second).join(first.select("event_id"), "event_id", "left_anti").select("event_id", "match_id", "minute", "event_type")


@query("team_dimension", "SELECT DISTINCT team_id, 'Team ' || team_id AS team_name, CASE WHEN team_id % 2 = 0 THEN 'North' ELSE 'South' END AS country FROM sides")
def team_dimension(spark, sf_dir):
    return parse.teams(fixtures.matches(spark, sf_dir).withColumn("pipeline_run_id", F.lit("contract"))).drop("pipeline_run_id")


@query("player_dimension_coalesce", "SELECT player_id, max(team_id) AS team_id, CASE WHEN player_id % 3 = 0 THEN 'Keeper' END AS position FROM silver GROUP BY player_id")
def player_dimension_coalesce(spark, sf_dir):
    """Events know no position; one that the line-ups gave stays through the merge."""
    seen = silver(spark, sf_dir).groupBy("player_id").agg(F.max("team_id").alias("team_id")).withColumn("position", F.lit(None).cast("string"))
    seen = materialize(seen, "contract-players")
    players = Table(spark, shared_folder(spark, "players"))
    players.merge(seen.where("player_id % 3 = 0").withColumns({"team_id": F.lit(0).cast("long"), "position": F.lit("Keeper")}), ["player_id"])
    players.merge(seen, ["player_id"], keep=("position",))
    return players.read()


RATED = """SELECT *, CASE WHEN pass_rate < 80 OR quarantine_rate >= 40 OR late_event_rate >= 25 THEN 'FAILED' WHEN pass_rate < 95 OR quarantine_rate >= 20 OR late_event_rate >= 10 THEN 'WARNING' ELSE 'HEALTHY' END AS overall_status
FROM (SELECT *, 100.0::DOUBLE * valid / input AS pass_rate, 100.0::DOUBLE * quarantined / input AS quarantine_rate, 100.0::DOUBLE * late / input AS late_event_rate FROM n)"""
COUNTED = """, n AS (SELECT count(*) AS input, count(*) FILTER (WHERE outcome = 'VALID') AS valid, count(*) FILTER (WHERE outcome NOT IN ('VALID', 'EXACT_DUPLICATE')) AS quarantined,
  count(*) FILTER (WHERE outcome = 'EXACT_DUPLICATE') AS duplicates, {late} AS late FROM {rows}) """


def _rated(rows: DataFrame) -> DataFrame:
    for name, column in quality.status_columns().items():
        rows = rows.withColumn(name, column)
    return rows


@query("quality_metrics", COUNTED.format(late="CAST(0 AS BIGINT)", rows="timed") + RATED)
def quality_metrics(spark, sf_dir):
    return _rated(c.outcome_counts(outcomes(spark, sf_dir)).withColumn("late", F.lit(0).cast("long")))


@query("quality_metrics_late", COUNTED.format(late="count(*) FILTER (WHERE outcome = 'VALID' AND event_timestamp < (SELECT max(event_timestamp) - INTERVAL 200 DAY FROM silver))", rows="timed") + RATED)
def quality_metrics_late(spark, sf_dir):
    """The same batch after a watermark that makes most of it late."""
    rows = staged(spark, sf_dir)
    mark = rows.where(F.col("outcome") == VALID).agg(F.max("event_timestamp")).first()[0] - timedelta(days=200)
    late = c.flag_late(rows, mark).agg(F.count_if((F.col("outcome") == VALID) & F.col("is_late")).alias("late"))
    return _rated(c.outcome_counts(rows).crossJoin(late))  # one row each


@query(
    "quality_by_file",
    """, n AS (SELECT k // 20 AS file, count(*) AS input, count(*) FILTER (WHERE outcome = 'VALID') AS valid, count(*) FILTER (WHERE outcome NOT IN ('VALID', 'EXACT_DUPLICATE')) AS quarantined,
  count(*) FILTER (WHERE outcome = 'EXACT_DUPLICATE') AS duplicates, count(*) FILTER (WHERE outcome = 'VALID' AND minute < 3) AS late FROM timed GROUP BY 1) """ + RATED,
)
def quality_by_file(spark, sf_dir):
    """D3-D6 over very many batches, of every status: each file and its variants is one, and an event of the first three minutes counts as late."""
    outcome = F.col("outcome")
    counts = outcomes(spark, sf_dir).groupBy(F.expr("k div 20").alias("file")).agg(
        F.count("*").alias("input"), F.count_if(outcome == VALID).alias("valid"), F.count_if(~outcome.isin(VALID, "EXACT_DUPLICATE")).alias("quarantined"),
        F.count_if(outcome == "EXACT_DUPLICATE").alias("duplicates"), F.count_if((outcome == VALID) & (F.col("minute") < 3)).alias("late"),
    )
    return _rated(counts)


# --- marts -----------------------------------------------------------------------------------------------------------


@query("match_summary", "SELECT * FROM summary")
def match_summary(spark, sf_dir):
    return marts.match_summary(fixtures.matches(spark, sf_dir), silver(spark, sf_dir))


@query("team_performance", "SELECT * FROM perf")
def team_performance(spark, sf_dir):
    return marts.team_performance(fixtures.matches(spark, sf_dir))


@query("event_distribution", "SELECT * FROM dist")
def event_distribution(spark, sf_dir):
    return marts.event_distribution(silver(spark, sf_dir))


def _affected(events: DataFrame, matches: DataFrame) -> DataFrame:
    """Matches touched by late variants or by one season's match file."""
    return marts.affected_matches(events.where("variant_type = 'late_event'"), matches.where("season_id = 0"))


AFFECTED = ", affected AS (SELECT match_id FROM silver WHERE variant_type = 'late_event' UNION SELECT match_id FROM m WHERE season_id = 0) "


@query("affected_matches", AFFECTED + "SELECT match_id FROM affected")
def affected_matches(spark, sf_dir):
    return _affected(silver(spark, sf_dir), fixtures.matches(spark, sf_dir))


@query("affected_match_summary", AFFECTED + "SELECT * FROM summary WHERE match_id IN (SELECT match_id FROM affected)")
def affected_match_summary(spark, sf_dir):
    events, matches = staged(spark, sf_dir).where(F.col("outcome") == VALID), fixtures.matches(spark, sf_dir)
    return marts.match_summary(matches, events, _affected(events, matches))


@query("affected_team_performance", "SELECT * FROM perf WHERE team_id IN (SELECT s.team_id FROM sides s JOIN silver e USING (match_id) WHERE e.variant_type = 'late_event')")
def affected_team_performance(spark, sf_dir):
    matches = fixtures.matches(spark, sf_dir)
    late = silver(spark, sf_dir).where("variant_type = 'late_event'").select("match_id").distinct()
    return marts.team_performance(matches, marts.affected_teams(matches, late))


# --- corrections -----------------------------------------------------------------------------------------------------


def _corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes(spark, sf_dir).where(F.col("outcome") == CORRECTION)


KNOWN = "(SELECT event_id FROM silver WHERE source = 'primary' AND k % 2 = 0)"


@query("correction_split", f"SELECT event_id, bronze_record_id, CASE WHEN event_id IN {KNOWN} THEN NULL ELSE 'ORIGINAL_EVENT_NOT_FOUND' END AS problem FROM outcomes WHERE outcome = 'EVENT_CORRECTION_REQUIRES_REVIEW'")
def correction_split(spark, sf_dir):
    rows = staged(spark, sf_dir)
    known = rows.where((F.col("outcome") == VALID) & F.expr("source = 'primary' AND k % 2 = 0"))
    return corrections.split_by_original(rows.where(F.col("outcome") == CORRECTION), known).select("event_id", "bronze_record_id", "problem")


@query(
    "correction_verdicts",
    f"""SELECT quarantine_id, CASE WHEN ok THEN 'REPROCESSED' ELSE 'FAILED' END AS status, CASE WHEN ok THEN 'APPROVED' ELSE 'APPROVE_FAILED' END AS resolution_action, 1 AS retry_count,
  CASE WHEN ok THEN 'checked' ELSE 'ORIGINAL_EVENT_NOT_FOUND | checked' END AS resolution_note FROM (SELECT quarantine_id, event_id IN {KNOWN} AS ok FROM held WHERE outcome = 'EVENT_CORRECTION_REQUIRES_REVIEW')""",
)
def correction_verdicts(spark, sf_dir):
    """All open corrections are selected; those whose original is not known fail."""
    rows = staged(spark, sf_dir)
    held = c.quarantine_rows(rows, "contract")
    chosen = corrections.select_for_resolution(held, held.where(F.col("error_type") == CORRECTION).select("quarantine_id"))
    known = rows.where((F.col("outcome") == VALID) & F.expr("source = 'primary' AND k % 2 = 0"))
    checked = corrections.split_by_original(chosen.withColumnRenamed("record_key", "event_id"), known)
    return corrections.judged(chosen, checked, "run-2", F.lit("checked")).select("quarantine_id", "status", "resolution_action", "retry_count", "resolution_note")


def _audited(spark, sf_dir, rows: DataFrame, kind: str) -> DataFrame:
    done = corrections.audit(c.quarantine_rows(rows, "contract"), kind, "run-2", F.lit("checked"))
    return done.select("quarantine_id", "record_key", "status", "retry_count", "resolution_action", "resolution_note", "resolution_run_id")


def _audit_sql(where: str, status: str, action: str, retry: int) -> str:
    return f"SELECT quarantine_id, event_id AS record_key, '{status}' AS status, {retry} AS retry_count, '{action}' AS resolution_action, 'checked' AS resolution_note, 'run-2' AS resolution_run_id FROM held WHERE {where}"


@query("correction_audit", _audit_sql(f"outcome = '{CORRECTION}'", "REPROCESSED", "APPROVED", 1))
def correction_audit(spark, sf_dir):
    return _audited(spark, sf_dir, _corrections(spark, sf_dir), "approve")


@query("correction_reject", _audit_sql(f"outcome = '{CORRECTION}'", "REJECTED", "REJECTED", 0))
def correction_reject(spark, sf_dir):
    return _audited(spark, sf_dir, _corrections(spark, sf_dir), "reject")


@query("replay_selection", "SELECT quarantine_id FROM held WHERE ordinal % 4 <> 0 AND bronze_record_id IN (SELECT bronze_record_id FROM held WHERE outcome = 'INVALID_MATCH_MINUTE')")
def replay_selection(spark, sf_dir):
    """of the records with an invalid minute, all rows that are still open, whatever their rule."""
    held = materialize(c.quarantine_rows(outcomes(spark, sf_dir), "contract"), "contract-held")
    status = F.expr("element_at(array('REPROCESSED', 'NEW', 'UNDER_REVIEW', 'FIXED'), event_ordinal % 4 + 1)")
    chosen = corrections.select_for_replay(held.withColumn("status", status), held.where("error_type = 'INVALID_MATCH_MINUTE'").select("bronze_record_id"))
    return chosen.select("quarantine_id")


@query("replay_audit", _audit_sql("outcome = 'INVALID_MATCH_MINUTE'", "REPROCESSED", "REPLAY", 1))
def replay_audit(spark, sf_dir):
    return _audited(spark, sf_dir, outcomes(spark, sf_dir).where("outcome = 'INVALID_MATCH_MINUTE'"), "replay")


# --- the engine end to end ---------------------------------------------------------------------------------------------


def _lake(spark: SparkSession, sf_dir: str) -> tuple[engine.Lake, DataFrame]:
    """A new lake, and raw records of all matches, line-ups and events."""
    lake = engine.Lake(spark, shared_folder(spark, "lake"))
    parts = [fixtures.match_payloads(spark, sf_dir), fixtures.lineup_payloads(spark, sf_dir), fixtures.event_payloads(spark, sf_dir)]
    raw = parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumnRenamed("bronze_record_id", "source_record_locator")
    held = {"source_uri": F.lit("fixture"), "source_commit_sha": F.lit("fixture"), "source_timestamp": F.lit(None).cast("string")}
    return lake, materialize(raw.withColumns(held).select(*snapshot.RECORD_FIELDS), "contract-records", **staging.WIDE)


LOOSE = quality.Thresholds(pass_warn=0, pass_fail=0, quarantine_warn=100, quarantine_fail=100, late_warn=100, late_fail=100)


@query(
    "lake_repeated_run",
    """SELECT count(*) AS input, count(*) FILTER (WHERE outcome = 'VALID') AS valid, count(*) FILTER (WHERE outcome = 'VALID') AS inserted, count(*) FILTER (WHERE outcome NOT IN ('VALID', 'EXACT_DUPLICATE')) AS quarantined,
  count(*) FILTER (WHERE outcome = 'EXACT_DUPLICATE') AS duplicates, CAST(0 AS BIGINT) AS late, count(*) FILTER (WHERE outcome = 'VALID') AS silver_rows, (SELECT count(*) FROM held) AS quarantine_rows,
  (SELECT count(*) FROM m) AS summary_rows, (SELECT count(DISTINCT team_id) FROM sides) AS team_rows, (SELECT count(*) FROM dist) AS distribution_rows FROM outcomes""",
)
def lake_repeated_run(spark, sf_dir):
    """T4: the whole daily run over raw records, twice under one run id: metrics and tables are those of one run."""
    lake, records = _lake(spark, sf_dir)
    for _ in range(2):
        engine.run_daily(lake, records, "run-1", thresholds=LOOSE)
    metrics = lake.table("ops/quality_metrics").read().select(*engine.COUNTS)
    for name, path in {"silver_rows": "silver/match_events", "quarantine_rows": "quarantine/match_events", "summary_rows": "gold/match_summary", "team_rows": "gold/team_performance", "distribution_rows": "gold/event_distribution"}.items():
        metrics = metrics.withColumn(name, lake.table(path).read().agg(F.count("*")).scalar())
    return metrics


@query(
    "lake_approved_corrections",
    """SELECT event_id, coalesce(changed, event_type) AS event_type FROM silver
  LEFT JOIN (SELECT event_id, max(event_type) AS changed FROM held WHERE outcome = 'EVENT_CORRECTION_REQUIRES_REVIEW' GROUP BY 1) USING (event_id)""",
)
def lake_approved_corrections(spark, sf_dir):
    """A daily run, then all corrections of its quarantine are parsed again and approved; of several for one event the greatest stays."""
    lake, records = _lake(spark, sf_dir)
    engine.run_daily(lake, records, "run-1", thresholds=LOOSE)
    waiting = lake.table("quarantine/match_events").read().where(F.col("error_type") == CORRECTION).select("quarantine_id")
    engine.resolve(lake, waiting, "approve", "checked", "run-2")
    return lake.table("silver/match_events").read().select("event_id", "event_type")


# --- questions -------------------------------------------------------------------------------------------------------


@query("kpi_total_goals", "SELECT CAST(sum(goal_count) AS BIGINT) AS total_goals FROM summary")
def kpi_total_goals(spark, sf_dir):
    return marts.total_goals(match_summary(spark, sf_dir))


@query("league_table_topk", "SELECT team_id, team_name, points FROM perf ORDER BY points DESC, goal_difference DESC NULLS LAST, team_id LIMIT 10")
def league_table_topk(spark, sf_dir):
    return marts.standings(team_performance(spark, sf_dir)).limit(10).select("team_id", "team_name", "points")


@query("top_scoring_teams", "SELECT team_id, team_name, goals_for FROM perf ORDER BY goals_for DESC, team_id LIMIT 10")
def top_scoring_teams(spark, sf_dir):
    return team_performance(spark, sf_dir).orderBy(F.desc("goals_for"), "team_id").limit(10).select("team_id", "team_name", "goals_for")


@query("win_draw_loss", "SELECT team_id, team_name, wins, draws, losses FROM perf")
def win_draw_loss(spark, sf_dir):
    return team_performance(spark, sf_dir).select("team_id", "team_name", "wins", "draws", "losses")


@query("event_timeline", "SELECT minute_bucket, event_type, event_count FROM dist ORDER BY 1, 2")
def event_timeline(spark, sf_dir):
    return event_distribution(spark, sf_dir).orderBy("minute_bucket", "event_type")


@query("match_listing_limit", "SELECT match_id, home_team_name, away_team_name, winner FROM summary ORDER BY match_id LIMIT 10")
def match_listing_limit(spark, sf_dir):
    return match_summary(spark, sf_dir).orderBy("match_id").limit(10).select("match_id", "home_team_name", "away_team_name", "winner")


@query("team_standings_sorted", "SELECT * FROM perf ORDER BY points DESC, goal_difference DESC NULLS LAST, team_id")
def team_standings_sorted(spark, sf_dir):
    return marts.standings(team_performance(spark, sf_dir))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
