"""Versioned Parquet tables: immutable segments, row deletions beside them, and one exclusive commit file a version.

``_commits/N.json`` holds version N: the schema and, for each segment, its rows, its deleted rows and the deletion
files that apply to it.  An insert appends a segment.  An upsert appends a segment and a deletion file with the places (file and row index) of
the rows it replaces, so it writes about as much as it brings; a segment is rewritten only when a third of it is deleted.
Readers keep the version they opened; they skip deleted rows by an anti-join on place, for segments that have any.

A commit file is written aside and then given its name, so no reader meets a half-written one.  The naming is exclusive by a hard
link on local files and by a rename that does not overwrite on HDFS; object stores without such a rename need one writer at a time.

Source rows that repeat a key count once: the greatest row.  Null keys never match; all their rows are kept.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from eventlake.sources import staging

#: Share of deleted rows, and number of deletion files, from which a segment is rewritten; number of segments from which small ones are joined.
REWRITE, MAX_DELETIONS, MAX_SEGMENTS = 1 / 3, 16, 64
NULL_SALTS = 4096
#: A table with this column holds whole files.
PAYLOAD = "raw_payload"


class CommitConflict(RuntimeError):
    """Another writer published this version first."""


def united(old: StructType, new: StructType) -> StructType:
    """The old columns, then those that only ``new`` has; a column may not change its type."""
    known = {f.name: f for f in old}
    for f in new:
        if f.name in known and known[f.name].dataType.simpleString() != f.dataType.simpleString():
            raise ValueError(f"column {f.name!r} is {known[f.name].dataType.simpleString()}, not {f.dataType.simpleString()}")
    return StructType([*old, *(StructField(f.name, f.dataType) for f in new if f.name not in known)])


class Table:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # --- files -------------------------------------------------------------------------------------------------------

    def _hadoop(self, name: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def version(self) -> int | None:
        files, at = self._hadoop("_commits")
        if not files.exists(at):
            return None
        names = (s.getPath().getName() for s in files.listStatus(at))
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=None)

    def exists(self) -> bool:
        return self.version() is not None

    def state(self, version: int) -> dict:
        files, at = self._hadoop(f"_commits/{version:012d}.json")
        stream = files.open(at)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _write(self, df: DataFrame, kind: str = "seg") -> str:
        name = f"{kind}-{uuid.uuid4().hex}"
        df.write.options(**(staging.WIDE if PAYLOAD in df.columns else {})).parquet(f"{self.path}/{name}")
        return name

    def _segment(self, df: DataFrame) -> dict:
        name = self._write(df)
        return {"name": name, "rows": self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}").count(), "dead": 0, "deletions": []}

    def _publish(self, base: int | None, schema: StructType, segments: list[dict]) -> int:
        version = 0 if base is None else base + 1
        files, at = self._hadoop(f"_commits/{version:012d}.json")
        _, aside = self._hadoop(f"_commits/.{uuid.uuid4().hex}")
        stream = files.create(aside, True)
        try:
            stream.write(bytearray(json.dumps({"schema": schema.jsonValue(), "segments": segments}).encode()))
        finally:
            stream.close()
        try:
            self._name(files, aside, at)
        except Exception as error:
            if files.exists(at):
                raise CommitConflict(f"version {version} of {self.path} exists") from error
            raise
        finally:
            if files.exists(aside):
                files.delete(aside, False)
        return version

    def _name(self, files, aside, at) -> None:
        jvm = self.spark._jvm
        if files.getScheme() == "file":
            local = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
            jvm.java.nio.file.Files.createLink(local(at), local(aside))
            return
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), self.spark._jsc.hadoopConfiguration()).rename(aside, at, options)

    # --- reading -----------------------------------------------------------------------------------------------------

    def _scan(self, schema: StructType, segments: list[dict], places: bool = False) -> DataFrame:
        """Live rows of segments; with ``places`` also __segment, __file and __row."""
        where = [F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row")]
        columns = [F.col(f"`{f.name}`") for f in schema]
        parts = []
        for marked in (False, True):
            some = [s for s in segments if bool(s["deletions"]) == marked]
            if not some:
                continue
            rows = self.spark.read.schema(schema).parquet(*(f"{self.path}/{s['name']}" for s in some))
            wanted = [*columns, *where] if marked or places else columns
            if places:
                wanted.append(F.regexp_extract("_metadata.file_path", r"(seg-[0-9a-f]{32})", 1).alias("__segment"))
            rows = rows.select(*wanted)
            if marked:
                names = dict.fromkeys(d for s in some for d in s["deletions"])
                gone = self.spark.read.schema("__segment string, __file string, __row long").parquet(*(f"{self.path}/{d}" for d in names))
                rows = rows.join(gone.select("__file", "__row"), ["__file", "__row"], "left_anti")
            parts.append(rows if places else rows.select(*columns))
        if not parts:
            return self.spark.createDataFrame([], schema)
        return reduce(DataFrame.unionByName, parts)

    def read_or_none(self, version: int | None = None) -> DataFrame | None:
        version = self.version() if version is None else version
        if version is None:
            return None
        state = self.state(version)
        return self._scan(StructType.fromJson(state["schema"]), state["segments"])

    def read(self, version: int | None = None) -> DataFrame:
        found = self.read_or_none(version)
        if found is None:
            raise FileNotFoundError(self.path)
        return found

    # --- writing -----------------------------------------------------------------------------------------------------

    def overwrite(self, df: DataFrame) -> int:
        """A new snapshot with its own schema; old versions stay readable."""
        return self._publish(self.version(), df.schema, [self._segment(df)])

    def merge(self, df: DataFrame, keys: list[str], insert_only: bool = False, keep: tuple[str, ...] = (), unique: bool = False) -> int:
        """Upsert, or insertion of new keys only; returns the version.  In ``keep`` columns a null does not replace a value.

        ``unique``: ``df`` is grouped by the keys, so no search for repeated ones is needed.
        """
        if not keys:
            raise ValueError("a merge needs key columns")
        base = self.version()
        source = df if unique else _one_of_each(df, keys)
        if base is None:
            return self._publish(None, df.schema, [self._segment(source)])
        state = self.state(base)
        schema, segments = StructType.fromJson(state["schema"]), state["segments"]
        target, merged = self._scan(schema, segments), united(schema, df.schema)
        if insert_only:
            fresh = self._segment(source.join(target.select(*keys), keys, "left_anti").select(*df.columns))
            if not fresh["rows"]:
                return base
            return self._publish(base, merged, self._tidy(merged, [*segments, fresh]))
        kept = [c for c in keep if c in target.columns]
        if kept:
            old = target.select(*keys, *(F.col(c).alias(f"_old_{c}") for c in kept))
            source = source.join(old, keys, "left").select(*(F.coalesce(c, f"_old_{c}").alias(c) if c in kept else c for c in df.columns))
        fresh = self._segment(source)
        if not fresh["rows"]:
            return base
        keyed = self._scan(df.schema, [fresh]).select(*keys)
        hits = self._scan(schema, segments, places=True).join(keyed, keys, "left_semi").select("__segment", "__file", "__row")
        deletion = self._write(hits, "del")
        counted = self.spark.read.schema(hits.schema).parquet(f"{self.path}/{deletion}").groupBy("__segment").count()
        dead = {r[0]: r[1] for r in counted.collect()}  # one row for each segment
        segments = [s | {"dead": s["dead"] + dead[s["name"]], "deletions": [*s["deletions"], deletion]} if s["name"] in dead else s for s in segments]
        return self._publish(base, merged, self._tidy(merged, [*segments, fresh]))

    def _tidy(self, schema: StructType, segments: list[dict]) -> list[dict]:
        """Drops dead segments, rewrites mostly deleted ones and joins small ones where there are many."""
        segments = [s for s in segments if s["dead"] < s["rows"]]
        again = {s["name"] for s in segments if s["dead"] > REWRITE * s["rows"] or len(s["deletions"]) > MAX_DELETIONS}
        if len(segments) > MAX_SEGMENTS:
            mean = sum(s["rows"] for s in segments) / len(segments)
            again |= {s["name"] for s in segments if s["rows"] <= mean}
        if not again:
            return segments
        return [*(s for s in segments if s["name"] not in again), self._segment(self._scan(schema, [s for s in segments if s["name"] in again]))]

    def compact(self) -> int:
        """One segment without deletions."""
        base = self.version()
        state = self.state(base)
        schema = StructType.fromJson(state["schema"])
        return self._publish(base, schema, [self._segment(self._scan(schema, state["segments"]))])

    def vacuum(self, versions: int = 1) -> int:
        """Removes old versions and the files that only they use; readers of those versions must be done, and no writer at work."""
        last = self.version()
        if last is None:
            return 0
        first = max(0, last - versions + 1)
        used = {n for v in range(first, last + 1) for s in self.state(v)["segments"] for n in (s["name"], *s["deletions"])}
        files, at = self._hadoop(".")
        gone = [s.getPath() for s in files.listStatus(at) if s.getPath().getName()[:4] in ("seg-", "del-") and s.getPath().getName() not in used]
        files, at = self._hadoop("_commits")
        old = [s.getPath() for s in files.listStatus(at) if s.getPath().getName().endswith(".json") and int(s.getPath().getName()[:-5]) < first]
        for path in [*old, *gone]:
            files.delete(path, True)
        return len(gone)


def _one_of_each(df: DataFrame, keys: list[str]) -> DataFrame:
    """The greatest row of each key.  Rows with a null key are all kept; a salt spreads them."""
    nulls = reduce(lambda a, b: a | b, (F.col(f"`{k}`").isNull() for k in keys))
    rest = [F.col(f"`{c}`").desc_nulls_last() for c in df.columns if c not in keys and not _unordered(df.schema[c].dataType)]
    salt = F.when(nulls, F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in df.columns)), F.lit(NULL_SALTS))).otherwise(F.lit(-1))
    first = Window.partitionBy(*(F.col(f"`{k}`") for k in keys), "__salt").orderBy(*rest or [F.lit(1)])
    return df.withColumn("__salt", salt).withColumn("__rank", F.row_number().over(first)).where((F.col("__rank") == 1) | (F.col("__salt") >= 0)).drop("__salt", "__rank")


def _unordered(kind) -> bool:
    return "map<" in kind.simpleString() or "variant" in kind.simpleString()
