"""The pinned snapshot as a Python data source (S1, S3): ``spark.read.format("eventlake_snapshot").option("manifest", path).load()``.

The driver reads the list of matches; executors fetch the files, ``files_per_partition`` matches in each partition.  Any address that
``urllib`` opens will do, also ``file:``.  The manifest's text is part of the plan, so executors need not see its file.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from eventlake.sources import snapshot


class SnapshotPartition(InputPartition):
    def __init__(self, matches: list[dict] | None):
        self.matches = matches


class SnapshotReader(DataSourceReader):
    def __init__(self, manifest: snapshot.Manifest, match_limit: int, size: int):
        self.manifest, self.match_limit, self.size = manifest, match_limit, size

    def _matches(self) -> list[dict]:
        m = self.manifest
        return snapshot.fetch_json(m.url(f"matches/{m.competition_id}/{m.season_id}.json"))[: self.match_limit or None]

    def partitions(self) -> list[InputPartition]:
        slim = [{k: x[k] for k in ("match_id", "last_updated") if k in x} for x in self._matches()]
        return [SnapshotPartition(None), *(SnapshotPartition(slim[i : i + self.size]) for i in range(0, len(slim), self.size))]

    def read(self, partition: SnapshotPartition):
        m = self.manifest
        if partition.matches is None:
            found = [
                snapshot.file_record(m, "competitions", "competitions.json", snapshot.fetch_json(m.url("competitions.json"))),
                snapshot.file_record(m, "matches", f"matches/{m.competition_id}/{m.season_id}.json", self._matches()),
            ]
        else:
            found = (snapshot.file_record(m, kind, path, snapshot.fetch_json(m.url(path)), x) for x in partition.matches for kind, path in snapshot.match_files(x))
        for record in found:
            yield tuple(record[n] for n in snapshot.RECORD_FIELDS)


class SnapshotSource(DataSource):
    """Options: ``manifest_json`` (or ``manifest``, a path that the driver reads), ``match_limit`` (0: all), ``files_per_partition``."""

    @classmethod
    def name(cls) -> str:
        return "eventlake_snapshot"

    def schema(self) -> str:
        return snapshot.RECORD

    def reader(self, schema) -> DataSourceReader:
        text = self.options.get("manifest_json")
        manifest = snapshot.Manifest(**json.loads(text)) if text else snapshot.Manifest.from_file(self.options["manifest"])
        size = int(self.options.get("files_per_partition", 25))
        if size < 1:
            raise ValueError("files_per_partition must be at least 1")
        return SnapshotReader(manifest, int(self.options.get("match_limit", 0)), size)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SnapshotSource)
