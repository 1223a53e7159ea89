"""Relational serving (K5-K8): tables from schemas, loads by the executors through any DB-API driver, and one transaction for all marts."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from itertools import islice

from pyspark.sql import DataFrame
from pyspark.sql.types import DataType, StructType

#: Key columns of each served mart, and whether it replaces what was served before (marts that the lake overwrites) or is upserted.
SERVED = {"match_summary": (("match_id",), False), "team_performance": (("team_id",), False), "event_distribution": (("event_type", "minute_bucket"), True)}
_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE PRECISION", "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP"}


def quote(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def sql_type(kind: DataType) -> str:
    return _TYPES.get(kind.simpleString(), "TEXT")


def ddl(name: str, schema: StructType, keys: Iterable[str]) -> str:
    columns = [f"{quote(f.name)} {sql_type(f.dataType)}" for f in schema]
    return f"CREATE TABLE IF NOT EXISTS {quote(name)} ({', '.join(columns)}, PRIMARY KEY ({', '.join(map(quote, keys))}))"


def upsert_sql(name: str, columns: list[str], keys: Iterable[str], mark: str = "?") -> str:
    keys = list(keys)
    changed = [f"{quote(c)} = excluded.{quote(c)}" for c in columns if c not in keys]
    act = f"DO UPDATE SET {', '.join(changed)}" if changed else "DO NOTHING"
    return f"INSERT INTO {quote(name)} ({', '.join(map(quote, columns))}) VALUES ({', '.join([mark] * len(columns))}) ON CONFLICT ({', '.join(map(quote, keys))}) {act}"


def move_sql(source: str, name: str, columns: list[str], keys: Iterable[str]) -> str:
    """All rows of a loaded table into the served one."""
    into, act = upsert_sql(name, columns, keys).split(" VALUES ", 1)[0], upsert_sql(name, columns, keys).split(" ON CONFLICT ", 1)[1]
    return f"{into} SELECT {', '.join(map(quote, columns))} FROM {quote(source)} WHERE 1 = 1 ON CONFLICT {act}"


def publish(marts: dict[str, tuple[DataFrame, Iterable[str], bool]], connect: Callable[[], object], mark: str = "?", batch: int = 1000, partitions: int = 8) -> dict[str, int]:
    """``marts``: served name -> rows, keys, whether they replace the served ones.  Returns each table's rows afterwards.

    The executors load tables aside, a few writers at once; a retried task upserts the same rows again.  Then one transaction moves
    all of them, so readers see every mart as it was or as it is, and nothing if any load fails.
    """
    loads = {name: f"{name}__{uuid.uuid4().hex[:12]}" for name in marts}
    connection = connect()
    try:
        for name, (df, keys, _) in marts.items():
            connection.cursor().execute(ddl(loads[name], df.schema, keys))
            connection.cursor().execute(ddl(name, df.schema, keys))
        connection.commit()
        for name, (df, keys, _) in marts.items():
            _load(df, upsert_sql(loads[name], df.columns, keys, mark), connect, batch, partitions)
        counts, cursor = {}, connection.cursor()
        for name, (df, keys, replaces) in marts.items():
            if replaces:
                cursor.execute(f"DELETE FROM {quote(name)}")
            cursor.execute(move_sql(loads[name], name, df.columns, keys))
            cursor.execute(f"SELECT count(*) FROM {quote(name)}")
            counts[name] = cursor.fetchone()[0]
        connection.commit()
        return counts
    except BaseException:
        connection.rollback()
        raise
    finally:
        for load in loads.values():
            connection.cursor().execute(f"DROP TABLE IF EXISTS {quote(load)}")
        connection.commit()
        connection.close()


def _load(df: DataFrame, statement: str, connect: Callable[[], object], batch: int, partitions: int) -> None:
    def write(rows) -> None:
        rows = (tuple(v.isoformat() if hasattr(v, "isoformat") else v for v in r) for r in rows)
        some = list(islice(rows, batch))
        if not some:
            return
        own = connect()
        try:
            while some:
                own.cursor().executemany(statement, some)
                some = list(islice(rows, batch))
            own.commit()
        finally:
            own.close()

    df.repartition(partitions).foreachPartition(write)
