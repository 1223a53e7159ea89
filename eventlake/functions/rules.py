"""Row rules: an ordered registry that folds into one Catalyst expression."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``fails`` is a SQL predicate; a row on which it is null does not fail."""

    code: str
    fails: str


#: Codes and limits of the quality contract, in order of precedence.
CORE_RULES = (
    Rule("MALFORMED_PAYLOAD", "malformed"),
    Rule("MISSING_EVENT_ID", "event_id IS NULL"),
    Rule("MISSING_MATCH_ID", "match_id IS NULL"),
    Rule("MISSING_TEAM_ID", "team_id IS NULL"),
    Rule("INVALID_MATCH_MINUTE", "minute IS NULL OR minute NOT BETWEEN 0 AND 130"),
)
#: ``match_known``: true where the event's match exists, whatever its columns hold.
REFERENCE_RULES = (
    Rule("UNKNOWN_MATCH", "match_known IS NULL"),
    Rule("INVALID_TEAM_MATCH_RELATIONSHIP", "NOT (team_id <=> home_team_id OR team_id <=> away_team_id)"),
)
CORRECTION = "EVENT_CORRECTION_REQUIRES_REVIEW"
EXACT_DUPLICATE = "EXACT_DUPLICATE"
VALID = "VALID"


def first_failure(*rules: Rule) -> Column:
    """The code of the first rule that the row fails, or null."""
    return F.coalesce(*(F.when(F.expr(r.fails), F.lit(r.code)) for r in rules))
