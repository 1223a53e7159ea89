"""Pinned snapshots of JSON files as raw source records.

Layout below the root: ``competitions.json``, ``matches/<competition>/<season>.json``, ``lineups/<match>.json``,
``events/<match>.json``.  Executors read the files, one record for each; the root may be any path that Spark reads, and
``fetch_records`` takes a callable (HTTP, tests) instead.
"""

from __future__ import annotations

import json
import re
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlake.functions.identity import canonical_json

SHA = re.compile(r"[0-9a-f]{40}")
RECORD = "source string, source_object string, source_uri string, source_commit_sha string, source_record_locator string, source_timestamp string, source_match_id string, variant_type string, raw_payload string"
RECORD_FIELDS = tuple(part.split()[0] for part in RECORD.split(", "))


@dataclass(frozen=True)
class Manifest:
    source: str
    repository_url: str
    raw_base_url: str
    commit_sha: str
    competition_id: int
    season_id: int
    competition_name: str
    season_name: str

    def __post_init__(self):
        if not SHA.fullmatch(self.commit_sha):
            raise ValueError("commit_sha must be 40 lower-case hex digits")

    @classmethod
    def from_file(cls, path: str) -> Manifest:
        with open(path, encoding="utf-8") as f:
            return cls(**json.load(f))

    def url(self, relative: str) -> str:
        return f"{self.raw_base_url.rstrip('/')}/{self.commit_sha}/data/{relative}"


def fetch_json(url: str) -> object:
    request = urllib.request.Request(url, headers={"User-Agent": "eventlake"})
    with urllib.request.urlopen(request, timeout=60) as response:  # noqa: S310 - the manifest pins the address
        return json.load(response)


def file_record(m: Manifest, kind: str, path: str, payload: object, match: dict | None = None) -> dict:
    """One file as a record; ``match``: the entry of the match that a line-up or event file belongs to."""
    return {
        "source": m.source, "source_object": kind, "source_uri": m.url(path), "source_commit_sha": m.commit_sha, "source_record_locator": path,
        "source_timestamp": match and match.get("last_updated"), "source_match_id": match and str(match["match_id"]), "variant_type": None, "raw_payload": canonical_json(payload),
    }


def match_files(match: dict) -> list[tuple[str, str]]:
    return [(kind, f"{kind}/{match['match_id']}.json") for kind in ("lineups", "events")]


def fetch_records(m: Manifest, fetch: Callable[[str], object] = fetch_json, match_limit: int | None = None) -> Iterator[dict]:
    """Records one at a time: competitions, matches, then lineups and events of each match."""
    yield file_record(m, "competitions", "competitions.json", fetch(m.url("competitions.json")))
    path = f"matches/{m.competition_id}/{m.season_id}.json"
    matches = fetch(m.url(path))[: match_limit or None]
    yield file_record(m, "matches", path, matches)
    for match in matches:
        for kind, path in match_files(match):
            yield file_record(m, kind, path, fetch(m.url(path)), match)


def snapshot_records(m: Manifest, fetch: Callable[[str], object] = fetch_json, match_limit: int | None = None) -> list[dict]:
    """The same as a list, for small snapshots and tests."""
    return list(fetch_records(m, fetch, match_limit))


def chunks(records: Iterator[dict], size: int = 25) -> Iterator[list[dict]]:
    """Bounded batches for a driver-side ingest."""
    if size < 1:
        raise ValueError("chunk size must be at least 1")
    batch: list[dict] = []
    for r in records:
        batch.append(r)
        if len(batch) == size:
            yield batch
            batch = []
    if batch:
        yield batch


def read_snapshot(spark: SparkSession, root: str, m: Manifest) -> DataFrame:
    """All files below ``root`` as records; the payload stays as it is in the file."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json").select("value", F.col("_metadata.file_path").alias("uri"))
    locator = F.regexp_extract("uri", r"((?:matches/[^/]+/|lineups/|events/)?[^/]+\.json)$", 1)
    kind = F.regexp_extract(F.col("source_record_locator"), r"^([a-z]+)", 1)
    match_id = F.when(kind.isin("lineups", "events"), F.regexp_extract("source_record_locator", r"/([^/]+)\.json$", 1))
    none = F.lit(None).cast("string")
    return files.withColumn("source_record_locator", locator).select(
        F.lit(m.source).alias("source"), kind.alias("source_object"), F.col("uri").alias("source_uri"), F.lit(m.commit_sha).alias("source_commit_sha"), "source_record_locator",
        none.alias("source_timestamp"), match_id.alias("source_match_id"), none.alias("variant_type"), F.col("value").alias("raw_payload"),
    )


#: The controlled variants, each with what it replaces in an event.
VARIANTS = (
    ("exact_duplicate", lambda e: e),
    ("missing_event_id", lambda e: {k: v for k, v in e.items() if k != "id"}),
    ("invalid_minute", lambda e: e | {"minute": 200}),
    ("event_correction", lambda e: e | {"type": {"id": 30, "name": "Pass"}}),
    ("late_event", lambda e: e | {"id": f"{e['id']}-late", "minute": 1}),
)


def controlled_variants(m: Manifest, match_id: str, events: list[dict], source: str = "synthetic") -> list[dict]:
    """One record for each variant, made of the first events that have an id, a team and a minute."""
    usable = [e for e in events if e.get("id") and e.get("team") and e.get("minute") is not None][: len(VARIANTS)]
    if len(usable) < len(VARIANTS):
        raise ValueError(f"{len(VARIANTS)} usable events are needed")
    out = []
    for (name, change), event in zip(VARIANTS, usable):
        payload = change(event)
        out.append(
            {
                "source": source, "source_object": "synthetic_event", "source_uri": m.url(f"events/{match_id}.json"), "source_commit_sha": m.commit_sha,
                "source_record_locator": f"synthetic/{m.competition_id}/{m.season_id}/{match_id}/{name}/{payload.get('id', 'missing-event-id')}",
                "source_timestamp": None, "source_match_id": match_id, "variant_type": name, "raw_payload": canonical_json(payload),
            }
        )
    return out
