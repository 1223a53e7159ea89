"""Every core query against its oracle in DuckDB."""

import glob
import os

import duckdb
import pytest

from eventlake.plans import contract

FOLDERS = ["/root/testdata/sf0.001", "/root/testdata/sf0.01"]


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(repr(tuple(r[i] for i in order)) for r in rows)


@pytest.fixture(scope="module", params=FOLDERS, ids=os.path.basename)
def side(request):
    db = duckdb.connect()
    for path in glob.glob(f"{request.param}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return request.param, db


@pytest.mark.parametrize("name", sorted(contract.ORACLES))
def test_oracle(spark, side, name):
    folder, db = side
    df = contract.QUERIES[name](spark, folder)
    got = rows_of(df.columns, df.collect())
    answer = db.execute(contract.ORACLES[name])
    want = rows_of([d[0] for d in answer.description], answer.fetchall())
    assert got[0] == want[0]
    assert got[1] == want[1]


def test_every_event_has_one_outcome(spark):
    """The model holds every outcome, and no row is lost on the way."""
    got = {r.outcome: r.n for r in contract.outcome_counts(spark, FOLDERS[1]).collect()}
    assert set(got) == {
        "VALID", "EXACT_DUPLICATE", "EVENT_CORRECTION_REQUIRES_REVIEW", "MALFORMED_PAYLOAD", "MISSING_EVENT_ID", "MISSING_MATCH_ID",
        "MISSING_TEAM_ID", "INVALID_MATCH_MINUTE", "UNKNOWN_MATCH", "INVALID_TEAM_MATCH_RELATIONSHIP",
    }
    assert sum(got.values()) == contract.fixtures.events(spark, FOLDERS[1]).count() > 10_000
    late = [r.is_late for r in contract.late_events(spark, FOLDERS[1]).collect()]
    assert 0 < sum(late) < len(late)
