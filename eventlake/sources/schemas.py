"""Fields that are read from the JSON payloads.  Others stay in the raw payload only."""

NAMED = "STRUCT<id: BIGINT, name: STRING>"
CARD = f"STRUCT<card: {NAMED}>"

EVENT = (
    f"id STRING, index BIGINT, period INT, timestamp STRING, minute INT, second INT, type {NAMED}, team {NAMED}, player {NAMED}, "
    f"shot STRUCT<outcome: {NAMED}>, foul_committed {CARD}, bad_behaviour {CARD}"
)
TEAM = "STRUCT<{0}_team_id: BIGINT, {0}_team_name: STRING, country: " + NAMED + ">"
MATCH = (
    "match_id BIGINT, match_date STRING, kick_off STRING, competition STRUCT<competition_id: BIGINT, competition_name: STRING>, "
    f"season STRUCT<season_id: BIGINT, season_name: STRING>, home_team {TEAM.format('home')}, away_team {TEAM.format('away')}, "
    f"home_score INT, away_score INT, match_status STRING, last_updated STRING, stadium STRUCT<id: BIGINT, name: STRING, country: {NAMED}>"
)
LINEUP = "team_id BIGINT, team_name STRING, lineup ARRAY<STRUCT<player_id: BIGINT, player_name: STRING, positions: ARRAY<STRUCT<position: STRING>>>>"


def array_of(fields: str) -> str:
    """Reads an array, and also a single object as an array of one."""
    return f"ARRAY<STRUCT<{', '.join(_colons(fields))}>>"


def _colons(fields: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, c in enumerate(fields + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            name, kind = fields[start:i].strip().split(" ", 1)
            out.append(f"`{name}`: {kind}")
            start = i + 1
    return out
