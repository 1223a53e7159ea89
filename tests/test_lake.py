"""The engine end to end: snapshot, daily runs, late rows, corrections, replay, serving and stream."""

import glob
import json
import sqlite3
from functools import partial

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from eventlake import cli
from eventlake.functions import quality
from eventlake.operators import corrections, parse, serve
from eventlake.plans import contract
from eventlake.plans import lake as engine
from eventlake.sources import datasource, snapshot, staging
from eventlake.sources.table import CommitConflict, Table
from eventlake.streaming import stream

MANIFEST = snapshot.Manifest("primary", "https://example.org/r", "https://example.org/raw", "a" * 40, 2, 27, "League", "Season")
LOOSE = quality.Thresholds(pass_warn=0, pass_fail=0, quarantine_warn=100, quarantine_fail=100, late_warn=100, late_fail=100)


def match(i, home=1, away=2, score=(1, 0)):
    side = lambda s, t: {f"{s}_team_id": t, f"{s}_team_name": f"Team {t}", "country": {"id": 1, "name": "X"}}
    return {"match_id": i, "match_date": "2016-01-0" + str(i), "kick_off": "15:00:00.000", "competition": {"competition_id": 2, "competition_name": "L"}, "season": {"season_id": 27, "season_name": "S"},
            "home_team": side("home", home), "away_team": side("away", away), "home_score": score[0], "away_score": score[1], "match_status": "available", "stadium": {"id": 5, "name": "Ground"}}


def event(i, minute=10, team=1, kind="Shot", **more):
    return {"id": f"e{i}", "index": i, "minute": minute, "second": 5, "type": {"id": 16, "name": kind}, "team": {"id": team, "name": f"Team {team}"}, "player": {"id": 100 + i, "name": f"P{i}"}} | more


def files(events):
    return {
        "competitions.json": [], "matches/2/27.json": [match(1), match(2, 3, 1, (2, 2))],
        "lineups/1.json": [{"team_id": 1, "team_name": "Team 1", "lineup": [{"player_id": 101, "player_name": "P1", "positions": [{"position": "Keeper"}]}, {"player_id": 102, "player_name": "P2", "positions": []}]}],
        "lineups/2.json": [], "events/1.json": events, "events/2.json": [event(50, 90, 3, "Foul", foul_committed={"card": {"id": 1, "name": "Yellow Card"}})],
    }


def records(spark, events, chaos=False):
    tree = files(events)
    found = list(snapshot.fetch_records(MANIFEST, lambda url: tree[url.split("/data/")[1]]))
    if chaos:
        found += snapshot.controlled_variants(MANIFEST, "1", events)
    return spark.createDataFrame([tuple(r[k] for k in found[0]) for r in found], snapshot.RECORD), found


def test_daily_replay_and_corrections(spark, tmp_path):
    lake = engine.Lake(spark, f"file://{tmp_path}/lake")
    events = [event(i, 10 + i) for i in range(1, 8)]
    rows, found = records(spark, events, chaos=True)
    assert len(found) == 2 + 2 * 2 + 5
    database = str(tmp_path / "serve.db")
    connect = partial(sqlite3.connect, database, timeout=60)
    a = engine.run_daily(lake, rows, "run-1", connect, thresholds=LOOSE)
    metrics = lake.table("ops/quality_metrics").read().first()
    assert (metrics.input, metrics.valid, metrics.quarantined, metrics.duplicates, metrics.late) == (13, 9, 3, 1, 0)
    assert metrics.overall_status == a.overall_status and metrics.input == metrics.valid + metrics.quarantined + metrics.duplicates
    with sqlite3.connect(database) as db:
        assert db.execute("SELECT count(*) FROM gold_match_summary").fetchone() == (2,)
        assert db.execute("SELECT points FROM gold_team_performance WHERE team_id = 1").fetchone() == (4,)
    players = {r.player_id: r.position for r in lake.table("silver/players").read().collect()}
    assert players[101] == "Keeper" and players[102] is None and 107 in players

    assert metrics.inserted == 9

    # The same records in a new run are not taken again; the same run again counts as before.
    engine.run_daily(lake, rows, "run-2", connect, thresholds=LOOSE)
    engine.run_daily(lake, rows, "run-1", connect, thresholds=LOOSE)
    by_run = {r.pipeline_run_id: (r.input, r.valid, r.inserted, r.quarantined, r.duplicates) for r in lake.table("ops/quality_metrics").read().collect()}
    assert by_run == {"run-1": (13, 9, 9, 3, 1), "run-2": (0, 0, 0, 0, 0)}
    assert lake.table("silver/match_events").read().count() == 9 and lake.table("quarantine/match_events").read().count() == 3
    assert lake.table("bronze/source_records").read().count() == len(found)

    # A later batch: a late event is flagged; of the known ones the changed payload waits for review and the equal one is a duplicate.
    later = [event(20, 1), event(1, 99, kind="Pass"), event(2, 12)]
    late_rows, _ = records(spark, later)
    engine.run_daily(lake, late_rows.where("source_object = 'events' AND source_match_id = '1'"), "run-3", thresholds=LOOSE)
    silver = {r.event_id: r for r in lake.table("silver/match_events").read().collect()}
    assert silver["e20"].is_late and silver["e1"].minute == 11 and not silver["e50"].is_late
    third = lake.table("ops/quality_metrics").read().where("pipeline_run_id = 'run-3'").first()
    assert (third.input, third.valid, third.inserted, third.quarantined, third.duplicates, third.late) == (3, 1, 1, 1, 1, 1)
    marks = lake.table("ops/processing_watermarks").read().collect()
    assert len(marks) == 1 and marks[0].watermark == silver["e50"].event_timestamp

    held = lake.table("quarantine/match_events")
    assert held.read().where("pipeline_run_id = 'run-3'").first().record_key == "e1" and held.read().count() == 4
    of = {r.error_type: r for r in held.read().where("pipeline_run_id = 'run-1'").collect()}
    assert set(of) == {"MISSING_EVENT_ID", "INVALID_MATCH_MINUTE", "EVENT_CORRECTION_REQUIRES_REVIEW"}
    wanted = of["EVENT_CORRECTION_REQUIRES_REVIEW"]
    with pytest.raises(ValueError):
        engine.resolve(lake, [of["MISSING_EVENT_ID"].quarantine_id], "approve", "", "run-4")
    engine.resolve(lake, [wanted.quarantine_id], "under_review", "looking", "run-4")
    engine.resolve(lake, [wanted.quarantine_id], "approve", "fine", "run-5")
    row = held.read().where(F.col("quarantine_id") == wanted.quarantine_id).first()
    assert (row.status, row.resolution_action, row.retry_count, row.resolution_note) == ("REPROCESSED", "APPROVED", 1, "fine")
    assert lake.table("silver/match_events").read().where(F.col("event_id") == wanted.record_key).first().event_type == "PASS"
    with pytest.raises(ValueError):
        engine.resolve(lake, [wanted.quarantine_id], "reject", "", "run-6")

    # A replay of a record that is still bad fails the gate, which counts 100 % as over any limit, and stays open.
    with pytest.raises(quality.QualityGateError):
        engine.replay(lake, [of["INVALID_MATCH_MINUTE"].bronze_record_id], "try again", "run-7", thresholds=LOOSE)
    assert held.read().where("error_type = 'INVALID_MATCH_MINUTE'").first().status == "NEW"
    assert not (tmp_path / "lake/_staging").exists() or not list((tmp_path / "lake/_staging").iterdir())


def test_replay_of_events_whose_match_came_late(spark, tmp_path):
    lake = engine.Lake(spark, f"file://{tmp_path}/lake")
    rows, _ = records(spark, [event(1), event(2, 300), event(3)])
    with pytest.raises(quality.QualityGateError):  # nothing is valid without the match
        engine.run_daily(lake, rows.where("source_object = 'events' AND source_match_id = '1'"), "run-1", thresholds=LOOSE)
    held = lake.table("quarantine/match_events")
    assert sorted((r.record_key, r.error_type) for r in held.read().collect()) == [("e1", "UNKNOWN_MATCH"), ("e2", "INVALID_MATCH_MINUTE"), ("e3", "UNKNOWN_MATCH")]
    engine.run_daily(lake, rows.where("source_object = 'matches'"), "run-2", thresholds=LOOSE)
    engine.replay(lake, [held.read().first().bronze_record_id], "the match is there", "run-3", thresholds=LOOSE)
    assert {r.record_key: (r.status, r.retry_count) for r in held.read().collect()} == {"e1": ("REPROCESSED", 1), "e2": ("NEW", 0), "e3": ("REPROCESSED", 1)}
    assert lake.table("silver/match_events").read().count() == 2


def test_bad_events_of_one_file_stay_apart(spark, tmp_path):
    """Three bad minutes of one file, two of them with one id and payload; two primary payloads of one id; a match with a null team."""
    lake = engine.Lake(spark, f"file://{tmp_path}/lake")
    events = [event(1, 500), event(2, 501), event(2, 501), event(3, 20), event(3, 20, kind="Pass"), event(4, team=2), event(5, team=9), event(6, team=1)]
    tree = files(events)
    tree["matches/2/27.json"] = [match(1, home=None), match(2, 3, 1)]
    found = list(snapshot.fetch_records(MANIFEST, lambda url: tree[url.split("/data/")[1]]))
    rows = spark.createDataFrame([tuple(r[k] for k in snapshot.RECORD_FIELDS) for r in found], snapshot.RECORD)
    team_one = [e for e in events if e["team"]["id"] == 1 and e["minute"] <= 130]
    engine.run_daily(lake, rows, "r", thresholds=LOOSE)
    n = lake.table("ops/quality_metrics").read().first()
    held = lake.table("quarantine/match_events").read()
    # The match knows its away team only: team 2 passes, the events of teams 1 and 9 do not.
    assert len(team_one) == 3
    assert (n.input, n.valid, n.quarantined, n.duplicates) == (9, 2, 7, 0) and held.count() == n.quarantined
    assert sorted((r.error_type, r.event_ordinal) for r in held.collect()) == [*(("INVALID_MATCH_MINUTE", i) for i in range(3)), *(("INVALID_TEAM_MATCH_RELATIONSHIP", i) for i in (3, 4, 6, 7))]
    conflict = engine.Lake(spark, f"file://{tmp_path}/lake2")
    rows, _ = records(spark, events[3:5])
    engine.run_daily(conflict, rows, "r", thresholds=LOOSE)
    n = conflict.table("ops/quality_metrics").read().first()
    assert (n.input, n.valid, n.inserted, n.quarantined) == (3, 2, 2, 1)
    assert conflict.table("quarantine/match_events").read().first().error_type == "EVENT_CORRECTION_REQUIRES_REVIEW"


def test_failed_gate_keeps_evidence(spark, tmp_path):
    lake = engine.Lake(spark, f"file://{tmp_path}/lake")
    rows, _ = records(spark, [event(i, 500) for i in range(1, 8)])
    said = []
    with pytest.raises(quality.QualityGateError):
        engine.run_daily(lake, rows, "run-1", alert=said.append)
    assert said and lake.table("ops/quality_metrics").read().first().overall_status == "FAILED"
    assert not lake.table("gold/match_summary").exists()


def test_malformed_payload(spark, tmp_path):
    rows, _ = records(spark, [event(1)])
    broken = rows.withColumn("raw_payload", F.when(F.col("source_object").isin("events", "lineups"), F.lit("{not json")).otherwise(F.col("raw_payload")))
    lake = engine.Lake(spark, f"file://{tmp_path}/lake")
    with pytest.raises(quality.QualityGateError):
        engine.run_daily(lake, broken, "r")
    n, held = lake.table("ops/quality_metrics").read().first(), lake.table("quarantine/match_events").read()
    assert (n.input, n.valid, n.quarantined) == (4, 0, 4) and [r.error_type for r in held.collect()] == ["MALFORMED_PAYLOAD"] * 4
    assert lake.table("silver/match_events").read().count() == 0 and lake.table("silver/matches").read().count() == 2


@pytest.mark.parametrize("text", ["{not json", '[{"id": "a"}, {"id": ', "", " ", "5", "null", "[null]", None, '"text"'])
def test_unreadable_payloads_give_one_row(spark, text):
    raw = spark.createDataFrame([("r", "primary", "synthetic_event", "1", None, "run", text)], "bronze_record_id string, source string, source_object string, source_match_id string, variant_type string, pipeline_run_id string, raw_payload string")
    got = parse.parse_events(raw).collect()
    assert [r.malformed for r in got] == [True] or (len(got) == 2 and got[0].event_id == "a" and got[1].malformed)
    assert all(r.event_payload_hash for r in got)


def test_empty_file_has_no_events(spark):
    raw = spark.createDataFrame([("r", "primary", "events", "1", None, "run", "[]")], "bronze_record_id string, source string, source_object string, source_match_id string, variant_type string, pipeline_run_id string, raw_payload string")
    assert parse.parse_events(raw).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    events = [event(i, 10 + i) for i in range(1, 8)]
    rows, _ = records(spark, events, chaos=True)
    folder = f"file://{tmp_path}/in"
    rows.coalesce(1).write.parquet(folder)
    streamed, batch = (engine.Lake(spark, f"file://{tmp_path}/{n}") for n in ("s", "b"))
    for _ in range(2):
        query = stream.start(streamed, stream.read_records(spark, folder), f"file://{tmp_path}/check", thresholds=LOOSE)
        query.awaitTermination(120)
    engine.run_daily(batch, rows, "run", thresholds=LOOSE)
    for name in ("silver/match_events", "gold/match_summary", "quarantine/match_events"):
        a, b = (sorted(map(repr, x.table(name).read().drop("pipeline_run_id", "detected_at").collect())) for x in (streamed, batch))
        assert a == b and a


def test_snapshot_files(spark, tmp_path):
    for path, value in files([event(1)]).items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(json.dumps(value))
    got = {r.source_record_locator: r for r in snapshot.read_snapshot(spark, f"file://{tmp_path}", MANIFEST).collect()}
    assert set(got) == set(files([])) and got["events/1.json"].source_match_id == "1" and got["matches/2/27.json"].source_object == "matches"
    with pytest.raises(ValueError):
        snapshot.Manifest(**(MANIFEST.__dict__ | {"commit_sha": "main"}))
    with pytest.raises(ValueError):
        list(snapshot.chunks(iter([]), 0))
    assert [len(c) for c in snapshot.chunks(iter([{}] * 5), 2)] == [2, 2, 1]
    with pytest.raises(ValueError):
        snapshot.controlled_variants(MANIFEST, "1", [event(1)])


def test_table(spark, tmp_path):
    t = Table(spark, f"file://{tmp_path}/t")
    assert t.read_or_none() is None and not t.exists()
    frame = lambda rows, schema="k int, v string": spark.createDataFrame(rows, schema)
    t.merge(frame([(1, "a"), (2, "b"), (2, "c"), (None, "n"), (None, "n")]), ["k"])
    pinned = t.read()
    t.merge(frame([(2, "z"), (3, "d")]), ["k"], insert_only=True)
    t.merge(frame([(1, None, 5), (4, "e", 6)], "k int, v string, extra int"), ["k"], keep=("v",))
    live = lambda: sorted(map(tuple, t.read().select("k", "v", "extra").where("k is not null").collect()))
    assert live() == [(1, "a", 5), (2, "c", None), (3, "d", None), (4, "e", 6)]
    assert t.read().where("k is null").count() == 2
    assert pinned.count() == 4 and t.read(0).columns == ["k", "v"]
    with pytest.raises(ValueError):
        t.merge(frame([(1, "a")]), [])
    with pytest.raises(ValueError, match="column 'v'"):
        t.merge(frame([(1, 5)], "k int, v int"), ["k"])
    with pytest.raises(CommitConflict):
        t._publish(0, frame([]).schema, [])
    assert not [p for p in (tmp_path / "t/_commits").iterdir() if not p.name.endswith((".json", ".crc"))]
    before = t.version()
    assert t.merge(frame([]), ["k"]) == before and t.merge(frame([(1, "y")]), ["k"], insert_only=True) == before
    assert live() == [(1, "a", 5), (2, "c", None), (3, "d", None), (4, "e", 6)]
    t.compact()
    assert live() == [(1, "a", 5), (2, "c", None), (3, "d", None), (4, "e", 6)] and t.vacuum() > 0
    assert live()[0] == (1, "a", 5) and t.vacuum() == 0
    t.overwrite(frame([(9, "q")]))
    assert t.read().count() == 1


def test_small_upserts_write_little(spark, tmp_path, monkeypatch):
    """1 % of the keys, spread over the whole table, rewrite no segment; many of them do, and rows stay right throughout."""
    t = Table(spark, f"file://{tmp_path}/t")
    size = lambda: sum(p.stat().st_size for p in (tmp_path / "t").rglob("*.parquet"))
    rows = lambda step, mark: spark.range(0, 100_000, step).selectExpr("id AS k", f"concat('{mark}', sha2(string(id), 256)) AS v")
    t.merge(rows(1, "a"), ["k"])
    first = size()
    t.merge(rows(100, "b"), ["k"])
    assert size() - first < first / 10
    assert t.read().groupBy(F.substring("v", 1, 1).alias("m")).count().orderBy("m").collect() == [("a", 99_000), ("b", 1_000)]
    t.merge(rows(2, "c"), ["k"])
    assert {s["dead"] for s in t.state(t.version())["segments"]} == {0}  # over a third was replaced: rewritten
    assert {r.m: r["count"] for r in t.read().groupBy(F.substring("v", 1, 1).alias("m")).count().collect()} == {"a": 50_000, "c": 50_000}
    monkeypatch.setattr("eventlake.sources.table.MAX_SEGMENTS", 3)
    monkeypatch.setattr("eventlake.sources.table.MAX_DELETIONS", 2)
    for i in range(6):
        t.merge(rows(1000, f"{i}"), ["k"])
        assert t.read().count() == 100_000 and len(t.state(t.version())["segments"]) <= 4
    assert t.read().where("v LIKE '5%'").count() == 100


def row_groups(folder):
    found = [pq.ParquetFile(f).metadata for f in glob.glob(f"{folder.removeprefix('file://')}/*.parquet")]
    return [m.row_group(i).total_byte_size for m in found for i in range(m.num_row_groups)]


def test_rows_that_hold_files_lie_in_small_row_groups(spark, tmp_path, monkeypatch):
    """A reader's batch holds a row group at most: 100 MB of payloads, 5 MB compressed, must not lie in one (F1, F2)."""
    wide = spark.range(1000).coalesce(1).selectExpr("id", "repeat(sha2(CAST(id AS STRING), 256), 1600) AS raw_payload")
    table = Table(spark, f"file://{tmp_path}/wide")
    table.overwrite(wide)
    sizes = row_groups(f"{tmp_path}/wide/{table.state(0)['segments'][0]['name']}")
    assert sum(sizes) > 100e6 and max(sizes) < 50e6
    assert table.read().agg(F.sum(F.length("raw_payload"))).first()[0] == 1000 * 64 * 1600
    monkeypatch.setitem(staging.WIDE, "parquet.block.size", 1 << 17)
    _, raw = contract._lake(spark, "/root/testdata/sf0.01")
    sizes = row_groups(raw._eventlake_folder)
    assert sum(sizes) > 4e6 and max(sizes) < 3e6


def test_merge_of_grouped_rows(spark, tmp_path):
    """Rows grouped by the key are merged as they are; the table is the same."""
    a, b = Table(spark, f"file://{tmp_path}/a"), Table(spark, f"file://{tmp_path}/b")
    for rows in (spark.range(100).selectExpr("id AS k", "id AS v", "'x' AS p"), spark.range(50, 200).selectExpr("id AS k", "id * 2 AS v", "CAST(NULL AS STRING) AS p")):
        a.merge(rows, ["k"], keep=("p",))
        b.merge(rows, ["k"], keep=("p",), unique=True)
    assert {tuple(r) for r in a.read().collect()} == {tuple(r) for r in b.read().collect()}
    assert b.read().count() == 200


def test_serving(spark, tmp_path):
    database = str(tmp_path / "s.db")
    connect = partial(sqlite3.connect, database, timeout=60)
    frame = lambda rows: spark.createDataFrame(rows, "k int, v string")
    assert serve.publish({"u": (frame([(1, "a"), (2, "b")]), ["k"], False), "r": (frame([(1, "a"), (2, "b")]), ["k"], True)}, connect) == {"u": 2, "r": 2}
    assert serve.publish({"u": (frame([(2, "c"), (3, "d")]), ["k"], False), "r": (frame([(2, "c"), (3, "d")]), ["k"], True)}, connect) == {"u": 3, "r": 2}
    with sqlite3.connect(database) as db:
        assert db.execute('SELECT * FROM u ORDER BY k').fetchall() == [(1, "a"), (2, "c"), (3, "d")]
        assert db.execute('SELECT * FROM r ORDER BY k').fetchall() == [(2, "c"), (3, "d")]
        assert [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' ORDER BY 1")] == ["r", "u"]
    broken = frame([(5, "x")]).withColumn("v", F.raise_error(F.lit("no")))
    with pytest.raises(Exception, match="no"):
        serve.publish({"u": (frame([(4, "e")]), ["k"], False), "r": (broken, ["k"], True)}, connect)
    with sqlite3.connect(database) as db:  # neither mart changed
        assert db.execute("SELECT count(*) FROM u").fetchone() == (3,) and db.execute("SELECT count(*) FROM r").fetchone() == (2,)


def _tree(folder, events):
    for path, value in files(events).items():
        at = folder / ("a" * 40) / "data" / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(json.dumps(value))
    manifest = folder / "manifest.json"
    manifest.write_text(json.dumps(MANIFEST.__dict__ | {"raw_base_url": f"file://{folder}"}))
    return str(manifest)


def test_data_source_and_command_line(spark, tmp_path, capsys):
    manifest = _tree(tmp_path, [event(1), event(2)])
    datasource.register(spark)
    read = lambda **o: spark.read.format("eventlake_snapshot").options(manifest=manifest, **o).load()
    want = snapshot.snapshot_records(snapshot.Manifest.from_file(manifest))
    assert sorted(map(tuple, read(files_per_partition="1").collect()), key=str) == sorted((tuple(r[n] for n in snapshot.RECORD_FIELDS) for r in want), key=str)
    assert read(match_limit="1").count() == 4
    with pytest.raises(Exception, match="at least 1"):
        read(files_per_partition="0").count()

    root = f"file://{tmp_path}/lake"
    assert cli.main(["daily", "--root", root, "--run-id", "r1", "--manifest", manifest]) == 0
    lake = engine.Lake(spark, root)
    assert lake.table("silver/match_events").read().count() == 3
    bad = spark.createDataFrame([tuple(want[0][n] if n != "raw_payload" else "{" for n in snapshot.RECORD_FIELDS)], snapshot.RECORD).withColumns({"source_object": F.lit("events")})
    bad.write.parquet(f"file://{tmp_path}/records")
    assert cli.main(["daily", "--root", root, "--run-id", "r2", "--records", f"file://{tmp_path}/records"]) == 1
    held = lake.table("quarantine/match_events").read().first()
    with pytest.raises(ValueError):
        cli.main(["replay", "--root", root, "--run-id", "r3", "--record-id", held.bronze_record_id, "--reason", " "])
    assert cli.main(["replay", "--root", root, "--run-id", "r3", "--record-id", held.bronze_record_id, "--reason", "again"]) == 1
    with pytest.raises(ValueError):
        cli.main(["resolve", "--root", root, "--run-id", "r4", "--quarantine-id", held.quarantine_id, "--action", "reject"])


def test_chunked_ingest(spark, tmp_path):
    lake = engine.Lake(spark, f"file://{tmp_path}/lake")
    _, found = records(spark, [event(1)])
    assert engine.ingest_chunks(lake, iter(found), "r", size=4) == len(found) == lake.table("bronze/source_records").read().count()
    assert engine.ingest_chunks(lake, iter(found), "r2", size=4) == len(found) == lake.table("bronze/source_records").read().count()
    assert engine.ingest_chunks(lake, iter([]), "r3") == 0


def test_shared_folder_is_needed_on_a_cluster():
    class Context:
        master = "spark://host:7077"
        getConf = staticmethod(lambda: {})

    class Session:
        conf = {}
        sparkContext = Context

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        staging.shared_base(Session)


def test_quality_policy():
    t = quality.Thresholds()
    assert [quality.pass_status(x, t) for x in (95, 94.99, 80, 79.99)] == ["HEALTHY", "WARNING", "WARNING", "FAILED"]
    cases = [((100, 98, 2, 1), "HEALTHY", 0), ((100, 80, 20, 0), "WARNING", 2), ((100, 55, 45, 0), "FAILED", 2), ((100, 98, 2, 12), "WARNING", 1), ((100, 98, 2, 30), "FAILED", 1), ((100, 50, 50, 30), "FAILED", 3), ((0, 0, 0, 0), "HEALTHY", 0)]
    for n, status, warnings in cases:
        a = quality.assess(dict(zip(("input", "valid", "quarantined", "late"), n)))
        assert (a.overall_status, len(a.warnings)) == (status, warnings)
    with pytest.raises(ValueError):
        quality.pass_status(101, t)
    with pytest.raises(ValueError):
        quality.Thresholds(pass_warn=50, pass_fail=60)
    with pytest.raises(ValueError, match="numeric"):
        quality.Thresholds.from_env({"EVENTLAKE_DQ_LATE_WARN": "x"})
    assert quality.Thresholds.from_env({"EVENTLAKE_DQ_LATE_WARN": "5"}).late_warn == 5

    def broken(_):
        raise OSError

    assert quality.enforce(quality.assess({"input": 100, "valid": 90, "quarantined": 0, "late": 0}), broken) is False


def test_arguments_and_sql():
    for bad in ([], "x", [""], [1]):
        with pytest.raises(ValueError):
            corrections.id_list(bad, "ids")
    for bad in (None, " "):
        with pytest.raises(ValueError):
            corrections.reason_text(bad)
    assert serve.upsert_sql("t", ["a", 'b"c'], ["a"]) == 'INSERT INTO "t" ("a", "b""c") VALUES (?, ?) ON CONFLICT ("a") DO UPDATE SET "b""c" = excluded."b""c"'
