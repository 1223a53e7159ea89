"""Command line of the three entry points (O5): ``python -m eventlake.cli daily|replay|resolve|publish --root ... --run-id ...``."""

from __future__ import annotations

import argparse
import importlib
import json
from collections.abc import Callable
from datetime import UTC, datetime

from eventlake.functions.quality import QualityGateError, Thresholds
from eventlake.operators import corrections
from eventlake.plans import lake as engine
from eventlake.session import build_session


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="eventlake")
    shared = argparse.ArgumentParser(add_help=False)
    shared.add_argument("--root", required=True, help="folder of the lake's tables")
    shared.add_argument("--run-id", required=True)
    shared.add_argument("--master", help="Spark master; the session's default without it")
    shared.add_argument("--connect", metavar="MODULE:FUNCTION", help="makes a DB-API connection; marts are then served")
    shared.add_argument("--mark", default="?", help="parameter mark of that driver")
    jobs = top.add_subparsers(dest="job", required=True)
    daily = jobs.add_parser("daily", parents=[shared])
    source = daily.add_mutually_exclusive_group(required=True)
    source.add_argument("--records", help="Parquet folder of source records")
    source.add_argument("--manifest", help="file of a pinned snapshot")
    daily.add_argument("--match-limit", type=int, default=0)
    daily.add_argument("--lookback-minutes", type=int, default=0)
    replay = jobs.add_parser("replay", parents=[shared])
    replay.add_argument("--record-id", action="append", required=True)
    replay.add_argument("--reason", required=True)
    resolve = jobs.add_parser("resolve", parents=[shared])
    resolve.add_argument("--quarantine-id", action="append", required=True)
    resolve.add_argument("--action", choices=("under_review", "reject", "approve"), required=True)
    resolve.add_argument("--note", default="")
    jobs.add_parser("publish", parents=[shared])
    return top


def _connector(name: str | None) -> Callable[[], object] | None:
    if not name:
        return None
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def main(arguments: list[str] | None = None) -> int:
    """0 when the run is done, 1 when the quality gate stopped it (its evidence is stored)."""
    args = parser().parse_args(arguments)
    if args.job == "replay":
        corrections.id_list(args.record_id, "record ids"), corrections.reason_text(args.reason)
    connect = _connector(args.connect)
    spark = build_session("eventlake", args.master)
    lake = engine.Lake(spark, args.root)
    try:
        if args.job == "daily":
            if args.records:
                records = spark.read.parquet(args.records)
            else:
                from eventlake.sources import datasource

                datasource.register(spark)
                records = spark.read.format("eventlake_snapshot").options(manifest=args.manifest, match_limit=str(args.match_limit)).load()
            engine.run_daily(lake, records, args.run_id, lookback_minutes=args.lookback_minutes, ingested_until=datetime.now(UTC), thresholds=Thresholds.from_env())
        elif args.job == "replay":
            engine.replay(lake, args.record_id, args.reason, args.run_id, thresholds=Thresholds.from_env())
        elif args.job == "resolve":
            engine.resolve(lake, args.quarantine_id, args.action, args.note, args.run_id)
        if connect is not None and not (args.job == "resolve" and args.action != "approve"):
            print(json.dumps(engine.publish(lake, connect, args.mark)))
    except QualityGateError as error:
        print(f"stopped by the quality gate: {error}")
        return 1
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
