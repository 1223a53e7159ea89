"""What the Python operators share: bounded Arrow slices, schemas and the shared folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlake.sources.staging import materialize, release, remove_folder, shared_folder

__all__ = ["SLICE_BYTES", "map_texts", "materialize", "release", "remove_folder", "shared_folder", "slices"]

#: Bytes of text that a Python worker turns into objects at once.
SLICE_BYTES = 4 << 20


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that each slice holds about ``limit`` bytes of ``column``, one row at least."""
    values = batch.column(column)
    lengths = pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False)
    start = size = 0
    for row, length in enumerate(lengths):
        if row > start and size + length > limit:
            yield batch.slice(start, row - start)
            start, size = row, 0
        size += int(length)
    if start < batch.num_rows:
        yield batch.slice(start)


def map_texts(df: DataFrame, keys: list[str], text: str, schema: str, work: Callable[[], Callable], arrays: bool = False) -> DataFrame:
    """Runs over ``keys`` + ``text`` only, so that other columns are neither read nor clash.

    ``work()`` is called once for each task and returns a function from a slice
    (a record batch with ``keys`` and the texts, nulls as ""; texts as a list, or as an Arrow array with ``arrays``) to columns in the order of ``schema``.
    """
    named = [F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)]
    narrow = df.select(*named, F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, names = work(), None
        for batch in batches:
            for part in slices(batch, "text"):
                columns = step([part.column(i) for i in range(len(keys))], part.column("text") if arrays else part.column("text").to_pylist())
                names = names or schema_names
                yield pa.RecordBatch.from_arrays(columns, names=names)

    from pyspark.sql.types import StructType

    schema_names = StructType.fromDDL(schema).fieldNames()
    return narrow.mapInArrow(run, schema)
