"""Raw payloads to typed tables (P1-P4): declared schemas, odd values give nulls, and a payload that is not JSON of the kind gives one malformed event."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlake.sources import schemas


def _items(bronze: DataFrame, objects: tuple[str, ...], fields: str, *kept: str) -> DataFrame:
    rows = bronze.where(F.col("source_object").isin(*objects))
    return rows.select(*kept, F.explode(F.from_json("raw_payload", schemas.array_of(fields))).alias("x")).where("x is not null")


def parse_matches(bronze: DataFrame) -> DataFrame:
    """One row for each match of each match file; matches without id are dropped."""
    x = _items(bronze, ("matches",), schemas.MATCH, "bronze_record_id", "pipeline_run_id")
    return x.selectExpr(
        "x.match_id", "x.competition.competition_id", "x.competition.competition_name", "x.season.season_id", "x.season.season_name",
        "try_cast(x.match_date AS DATE) AS match_date",
        "CAST(try_to_timestamp(x.match_date || ' ' || x.kick_off, 'yyyy-MM-dd HH:mm:ss.SSS') AS TIMESTAMP_NTZ) AS kickoff_timestamp",
        "x.home_team.home_team_id", "x.home_team.home_team_name", "x.home_team.country.name AS home_team_country",
        "x.away_team.away_team_id", "x.away_team.away_team_name", "x.away_team.country.name AS away_team_country",
        "x.stadium.id AS stadium_id", "x.stadium.name AS stadium_name", "x.stadium.country.name AS stadium_country",
        "x.home_score", "x.away_score", "x.match_status AS status", "bronze_record_id", "pipeline_run_id",
    ).where("match_id is not null")


def parse_lineups(bronze: DataFrame) -> DataFrame:
    """One row for each player: of several entries the one with the smallest team, then name."""
    teams = _items(bronze, ("lineups",), schemas.LINEUP, "pipeline_run_id")
    players = teams.select("pipeline_run_id", "x.team_id", F.explode("x.lineup").alias("p")).selectExpr(
        "p.player_id", "p.player_name", "team_id", "try_element_at(p.positions, 1).position AS position", "pipeline_run_id"
    )
    best = F.min_by(F.struct("player_name", "team_id", "position", "pipeline_run_id"), F.struct("team_id", "player_name", "position"))
    return players.where("player_id is not null").groupBy("player_id").agg(best.alias("b")).select("player_id", "b.*")


def parse_events(bronze: DataFrame) -> DataFrame:
    """Event files (arrays) and single events, by one path.  ``ordinal``: the event's place in its file.

    What cannot be read stays as a row with ``malformed`` set: a whole payload, or an element that is null.
    """
    rows = bronze.where(F.col("source_object").isin("events", "synthetic_event"))
    kind = schemas.array_of(schemas.EVENT)
    items = F.coalesce(F.from_json("raw_payload", kind), F.from_json(F.lit("[null]"), kind))
    x = rows.select("bronze_record_id", "source", "source_match_id", "variant_type", "pipeline_run_id", "raw_payload", F.posexplode(items).alias("ordinal", "x"))
    return x.selectExpr(
        "bronze_record_id", "ordinal", "source", "variant_type", "pipeline_run_id", "try_cast(source_match_id AS BIGINT) AS match_id",
        "x.id AS event_id", "x.index AS event_index", "x.period", "x.timestamp AS event_clock", "x.minute", "x.second", "upper(x.type.name) AS event_type",
        "x.team.id AS team_id", "x.team.name AS team_name", "x.player.id AS player_id", "x.player.name AS player_name",
        "upper(x.shot.outcome.name) AS shot_outcome",
        "upper(coalesce(x.foul_committed.card.name, x.bad_behaviour.card.name)) AS card_type",
        "sha2(coalesce(to_json(x), raw_payload, ''), 256) AS event_payload_hash", "x IS NULL AS malformed",
    )


def unreadable_files(bronze: DataFrame, like: DataFrame) -> DataFrame:
    """Match and line-up files that cannot be read, as malformed rows with the columns of ``like``, so that they reach quarantine too."""
    broken = [
        bronze.where(F.col("source_object") == kind).where(F.from_json("raw_payload", schemas.array_of(fields)).isNull())
        for kind, fields in (("matches", schemas.MATCH), ("lineups", schemas.LINEUP))
    ]
    rows = broken[0].unionByName(broken[1])
    own = {"ordinal": F.lit(0), "malformed": F.lit(True), "event_payload_hash": F.sha2(F.coalesce("raw_payload", F.lit("")), 256), "match_id": F.expr("try_cast(source_match_id AS BIGINT)")}
    held = {f.name: own[f.name] if f.name in own else F.col(f.name) if f.name in rows.columns else F.lit(None) for f in like.schema}
    return rows.select(*(held[f.name].cast(f.dataType).alias(f.name) for f in like.schema))


def teams(matches: DataFrame) -> DataFrame:
    """Both sides of each match in one scan; of several names the greatest stands."""
    side = lambda s: f"struct({s}_team_id AS team_id, {s}_team_name AS team_name, {s}_team_country AS country, pipeline_run_id)"
    rows = matches.selectExpr(f"inline(array({side('home')}, {side('away')}))").where("team_id is not null")
    return rows.groupBy("team_id").agg(F.max(F.struct("team_name", "country", "pipeline_run_id")).alias("b")).select("team_id", "b.*")


def stadiums(matches: DataFrame) -> DataFrame:
    best = F.max(F.struct("stadium_name", F.col("stadium_country").alias("country"), "pipeline_run_id")).alias("b")
    return matches.where("stadium_id is not null").groupBy("stadium_id").agg(best).select("stadium_id", "b.*")
