"""The domain model derived from the star-schema tables: matches from orders, events with injected defects and variants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One match of each order; some lack a team or a score."""
    base = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS match_id", "CASE WHEN o_orderkey % 71 <> 0 THEN o_custkey END AS home_team_id",
        "CASE WHEN o_orderkey % 67 <> 0 THEN o_custkey + 1 + o_orderkey % 24 END AS away_team_id",
        "CAST(o_orderkey % 5 AS INT) AS home_score", "CASE WHEN o_orderkey % 61 <> 0 THEN CAST(o_orderkey * 7 % 4 AS INT) END AS away_score",
        "o_orderdate AS kickoff_timestamp", "o_orderkey div 400 AS season_id",
    )
    return base.selectExpr(
        "*", "CAST(1 AS BIGINT) AS competition_id", "'League' AS competition_name", "'Season ' || season_id AS season_name", "CAST(kickoff_timestamp AS DATE) AS match_date",
        "'Team ' || home_team_id AS home_team_name", "'Team ' || away_team_id AS away_team_name",
        "CASE WHEN home_team_id % 2 = 0 THEN 'North' WHEN home_team_id % 2 = 1 THEN 'South' END AS home_team_country", "CASE WHEN away_team_id % 2 = 0 THEN 'North' WHEN away_team_id % 2 = 1 THEN 'South' END AS away_team_country",
    )


#: event_type of the source -> type in the model.
TYPES = {"purchase": "SHOT", "click": "PASS", "view": "CARRY", "signup": "PRESSURE"}


def _base_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event, twenty in a row to a match (its slot); some slots name no match or one that does not exist."""
    all_orders = table(spark, sf_dir, "orders")
    orders = all_orders.selectExpr("o_orderkey AS slot", "o_custkey AS home", "o_custkey + 1 + o_orderkey % 24 AS away")
    e = table(spark, sf_dir, "events").withColumnsRenamed({"event_id": "k", "event_type": "kind"})
    e = e.withColumn("slot", F.pmod(F.expr("k div 20"), all_orders.agg(F.count("*")).scalar()))
    kinds = F.create_map(*(F.lit(x) for pair in TYPES.items() for x in pair))
    return e.join(orders, "slot", "left").select(
        F.lit("primary").alias("source"),
        F.lit(None).cast("string").alias("variant_type"),
        "k",
        F.expr("CASE WHEN k % 101 <> 0 THEN 'ev-' || k END").alias("event_id"),
        F.expr("CASE WHEN slot % 23 = 0 THEN NULL WHEN slot % 25 = 24 THEN -1 - slot ELSE slot END").alias("match_id"),
        F.expr("CASE WHEN k % 107 = 0 THEN NULL WHEN k % 53 = 0 THEN -1 WHEN k % 2 = 0 THEN home ELSE away END").alias("team_id"),
        F.expr("CAST(CASE WHEN k % 109 = 0 THEN 200 WHEN k % 113 = 0 THEN NULL WHEN k % 127 = 0 THEN -1 ELSE k % 131 END AS INT)").alias("minute"),
        F.expr("CAST(CASE WHEN k % 11 <> 0 THEN user_id % 60 END AS INT)").alias("second"),
        F.coalesce(F.try_element_at(kinds, "kind"), F.lit("FOUL COMMITTED")).alias("event_type"),
        F.expr("CASE WHEN kind = 'error' THEN CASE WHEN k % 10 = 0 THEN 'RED CARD' WHEN k % 10 = 1 THEN 'SECOND YELLOW' WHEN k % 10 < 6 THEN 'YELLOW CARD' END END").alias("card_type"),
        F.col("user_id").alias("player_id"),
    )


#: Variant -> which events have one.
VARIANTS = {
    "exact_duplicate": "k % 97 = 5",
    "event_correction": "k % 89 = 7",
    "late_event": "k % 83 = 11",
    "primary_conflict": "k % 79 = 13",
    "malformed_payload": "k % 139 = 3",
}


def variants(base: DataFrame) -> DataFrame:
    """S10 by modulus: every base row, and beside it one more row for each of its variants, in one scan."""
    chosen = F.array_compact(F.array(*(F.when(F.expr(which), F.lit(name)) for name, which in VARIANTS.items())))
    rows = base.withColumn("variant_type", F.explode(F.array_insert(chosen, 1, F.lit(None).cast("string"))))
    kind = F.coalesce("variant_type", F.lit(""))
    broken = kind == "malformed_payload"
    blank = {c: F.when(~broken, F.col(c)) for c in ("team_id", "second", "card_type", "player_id")}
    return rows.withColumns(
        {
            **blank,
            "malformed": broken,
            "source": F.when(kind.isin("", "primary_conflict"), "primary").otherwise("synthetic"),
            "event_id": F.when(broken, F.lit(None)).when(kind == "late_event", F.concat("event_id", F.lit("-late"))).otherwise(F.col("event_id")),
            "minute": F.when(broken, F.lit(None)).when(kind == "late_event", 1).otherwise(F.col("minute")),
            "event_type": F.when(broken, F.lit(None)).when(kind == "event_correction", "SUBSTITUTION").when(kind == "primary_conflict", "BLOCK").otherwise(F.col("event_type")),
        }
    )


#: What the payload hash of a derived event covers, as text.
PAYLOAD = ("event_id", "match_id", "team_id", "minute", "second", "event_type", "card_type")


def identified(rows: DataFrame) -> DataFrame:
    """Adds payload hash, record id and ordinal.  The base events of a slot are one file; a variant is a record of its own."""
    text = F.concat_ws("|", *(F.col(c).cast("string") for c in PAYLOAD))
    alone = F.col("variant_type").isNotNull()
    record = F.concat_ws(":", "source", F.coalesce("variant_type", F.lit("")), F.when(alone, F.col("k")).otherwise(F.expr("k div 20")).cast("string"))
    return rows.withColumns({"event_payload_hash": F.sha2(text, 256), "bronze_record_id": F.sha2(record, 256), "ordinal": F.when(alone, 0).otherwise(F.col("k") % 20).cast("int")})


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identified(variants(_base_events(spark, sf_dir)))


def second_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All base events sent again: some new, some changed, some as the very record that was stored, the others as plain copies."""
    first = identified(_base_events(spark, sf_dir).withColumn("malformed", F.lit(False)))
    new, changed, same = F.expr("k % 5 = 1"), F.expr("k % 3 = 0"), F.expr("k % 7 = 2")
    sent = identified(first.withColumns({"event_id": F.when(new, F.concat("event_id", F.lit("-new"))).otherwise(F.col("event_id")), "event_type": F.when(changed & ~new, "RESENT").otherwise(F.col("event_type"))}))
    return sent.withColumn("bronze_record_id", F.when(same & ~new & ~changed, F.col("bronze_record_id")).otherwise(F.concat(F.lit("again:"), "bronze_record_id")))


def event_payloads(spark: SparkSession, sf_dir: str, run_id: str = "fixture") -> DataFrame:
    """The same events as raw JSON records: a file (array) for each slot, one object for each variant, broken text for the malformed ones."""
    named = lambda i, n: F.struct(F.lit(i).cast("long").alias("id"), F.col(n).alias("name"))
    one = F.struct(
        F.col("k").alias("index"), F.col("event_id").alias("id"), F.col("minute"), F.col("second"),
        named(1, "event_type").alias("type"), F.struct(F.col("team_id").alias("id")).alias("team"), F.struct(F.col("player_id").alias("id")).alias("player"),
        F.struct(F.struct(F.lower("card_type").alias("name")).alias("card")).alias("foul_committed"),
    )
    rows = events(spark, sf_dir).select("bronze_record_id", "source", "variant_type", "match_id", "malformed", "k", one.alias("one"))
    alone = rows.where("variant_type IS NOT NULL").withColumn("raw_payload", F.when(F.col("malformed"), F.concat(F.lit('[{"index": '), "k")).otherwise(F.to_json("one")))
    files = rows.where("variant_type IS NULL").groupBy("bronze_record_id", "source", "variant_type", "match_id").agg(F.to_json(F.sort_array(F.collect_list("one"))).alias("raw_payload"))
    both = files.withColumn("source_object", F.lit("events")).unionByName(alone.withColumn("source_object", F.lit("synthetic_event")).drop("malformed", "k", "one"))
    return both.select("bronze_record_id", "source", "source_object", F.col("match_id").cast("string").alias("source_match_id"), "variant_type", "raw_payload", F.lit(run_id).alias("pipeline_run_id"))


def lineup_payloads(spark: SparkSession, sf_dir: str, run_id: str = "fixture") -> DataFrame:
    """Line-ups of all customers, fifty to a file; some play for a second team, some have no position."""
    clubs = F.when(F.expr("c_custkey % 5 = 0"), F.array(F.col("c_nationkey"), F.col("c_nationkey") + 100)).otherwise(F.array("c_nationkey"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.explode(clubs.cast("array<long>")).alias("team"), F.expr("c_custkey div 50").alias("file"))
    positions = F.when(F.expr("c_custkey % 3 <> 0"), F.array(F.struct(F.concat(F.lit("P"), F.expr("c_custkey % 4")).alias("position")))).otherwise(F.array().cast("array<struct<position:string>>"))
    player = F.struct(F.col("c_custkey").alias("player_id"), F.concat(F.lit("Player "), "c_custkey").alias("player_name"), positions.alias("positions"))
    teams = rows.groupBy("file", "team").agg(F.collect_list(player).alias("lineup"))
    files = teams.groupBy("file").agg(F.to_json(F.collect_list(F.struct(F.col("team").alias("team_id"), F.concat(F.lit("Team "), "team").alias("team_name"), "lineup"))).alias("raw_payload"))
    none = F.lit(None).cast("string")
    return files.select(F.concat(F.lit("lineup-"), "file").alias("bronze_record_id"), F.lit("primary").alias("source"), F.lit("lineups").alias("source_object"), none.alias("source_match_id"), none.alias("variant_type"), "raw_payload", F.lit(run_id).alias("pipeline_run_id"))


def match_payloads(spark: SparkSession, sf_dir: str, run_id: str = "fixture") -> DataFrame:
    """The matches as raw JSON envelopes, one for each season: an array of its matches."""
    side = lambda s: F.struct(F.col(f"{s}_team_id"), F.col(f"{s}_team_name"), F.struct(F.col(f"{s}_team_country").alias("name")).alias("country"))
    one = F.struct(
        "match_id", F.date_format("kickoff_timestamp", "yyyy-MM-dd").alias("match_date"), F.date_format("kickoff_timestamp", "HH:mm:ss.SSS").alias("kick_off"),
        F.struct("competition_id", "competition_name").alias("competition"), F.struct("season_id", "season_name").alias("season"),
        side("home").alias("home_team"), side("away").alias("away_team"), "home_score", "away_score", F.lit("available").alias("match_status"),
    )
    files = matches(spark, sf_dir).groupBy("season_id").agg(F.to_json(F.sort_array(F.collect_list(one))).alias("raw_payload"))
    return files.select(F.sha2("raw_payload", 256).alias("bronze_record_id"), F.lit("primary").alias("source"), F.lit("matches").alias("source_object"), F.lit(None).cast("string").alias("source_match_id"), F.lit(None).cast("string").alias("variant_type"), "raw_payload", F.lit(run_id).alias("pipeline_run_id"))
