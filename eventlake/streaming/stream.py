"""The daily run as a stream: new record files are micro-batches of the same functions.

Late rows must be flagged against the kept watermark and duplicates judged against the whole table, so each batch runs
``foreachBatch`` over the tables; a repeated batch inserts nothing twice.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from eventlake.plans import lake as engine
from eventlake.sources.snapshot import RECORD


def read_records(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(RECORD).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def start(lake: engine.Lake, records: DataFrame, checkpoint: str, **gate) -> StreamingQuery:
    """Runs over what is there and ends; start it again for what came later."""

    def batch(rows: DataFrame, number: int) -> None:
        if rows.isEmpty():
            return
        # The checkpoint keeps the query's id: a repeated batch has the same run id, a new checkpoint another one.
        query_id = json.loads(rows.sparkSession.read.text(f"{checkpoint.rstrip('/')}/metadata", wholetext=True).first()[0])["id"]
        run_id = f"stream-{query_id}-{number}"
        session_lake = engine.Lake(rows.sparkSession, lake.root, lake.source)
        engine.run_daily(session_lake, rows, run_id, **gate)

    return records.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
