"""Marts (A2-A4) and the questions asked of them (Q1-Q7).  Scopes of affected keys apply below the aggregations.

Fixed values: the names and the order of the marts' columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def match_summary(matches: DataFrame, events: DataFrame, affected: DataFrame | None = None) -> DataFrame:
    if affected is not None:
        matches, events = (x.join(affected, "match_id", "left_semi") for x in (matches, events))
    counts = events.groupBy("match_id").agg(
        F.count("*").alias("event_count"),
        F.count_if(F.col("event_type") == "SHOT").alias("shot_count"),
        F.count_if(F.col("card_type") == "YELLOW CARD").alias("yellow_card_count"),
        F.count_if(F.col("card_type").isin("RED CARD", "SECOND YELLOW")).alias("red_card_count"),
    )
    joined = matches.join(counts, "match_id", "left").na.fill(0, ["event_count", "shot_count", "yellow_card_count", "red_card_count"])
    return joined.selectExpr(
        "match_id", "competition_id", "competition_name", "season_id", "season_name", "match_date", "home_team_id", "home_team_name", "away_team_id", "away_team_name", "home_score", "away_score",
        "CASE WHEN home_score > away_score THEN home_team_name WHEN away_score > home_score THEN away_team_name ELSE 'DRAW' END AS winner",
        "coalesce(home_score, 0) + coalesce(away_score, 0) AS goal_count", "yellow_card_count", "red_card_count", "shot_count", "event_count",
    )


def team_performance(matches: DataFrame, affected: DataFrame | None = None) -> DataFrame:
    """Both sides from one scan; a renamed team keeps one row, with its greatest name.  A side without a team id has no row."""
    side = lambda a, b: f"struct({a}_team_id AS team_id, {a}_team_name AS team_name, {a}_score AS gf, {b}_score AS ga)"
    rows = matches.selectExpr(f"inline(array({side('home', 'away')}, {side('away', 'home')}))").where("team_id IS NOT NULL")
    if affected is not None:
        rows = rows.join(affected, "team_id", "left_semi")
    table = rows.groupBy("team_id").agg(
        F.max("team_name").alias("team_name"),
        F.count("*").alias("matches_played"),
        F.count_if(F.col("gf") > F.col("ga")).alias("wins"),
        F.count_if(F.col("gf") == F.col("ga")).alias("draws"),
        F.count_if(F.col("gf") < F.col("ga")).alias("losses"),
        F.sum("gf").alias("goals_for"),
        F.sum("ga").alias("goals_against"),
    )
    return table.withColumns({"goal_difference": F.expr("goals_for - goals_against"), "points": F.expr("wins * 3 + draws")})


def event_distribution(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type", F.expr("CAST(minute - minute % 15 AS INT)").alias("minute_bucket")).agg(F.count("*").alias("event_count"))


def affected_matches(events: DataFrame, matches: DataFrame) -> DataFrame:
    """T5: matches that a run's events or match files touch."""
    return events.select("match_id").unionByName(matches.select("match_id")).where("match_id is not null").distinct()


def affected_teams(matches: DataFrame, affected: DataFrame) -> DataFrame:
    return matches.join(affected, "match_id", "left_semi").selectExpr("explode(array(home_team_id, away_team_id)) AS team_id").where("team_id is not null").distinct()


def total_goals(summary: DataFrame) -> DataFrame:
    return summary.agg(F.coalesce(F.sum("goal_count"), F.lit(0)).alias("total_goals"))


def standings(table: DataFrame) -> DataFrame:
    return table.orderBy(F.desc("points"), F.desc_nulls_last("goal_difference"), "team_id")
