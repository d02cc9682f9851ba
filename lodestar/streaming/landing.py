"""Streams land by the batch operators, one micro-batch at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from lodestar.sources.landing import merge


def merging(read: Callable[[], DataFrame | None], write: Callable[[DataFrame, int], None], keys: list[str]) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch: the batch's keys replace the table's rows.

    Of rows of one key within a batch the largest by its other columns, in their order, stays.  The same batch again gives the
    same table, so a repeated batch does no harm.
    """

    def land(batch: DataFrame, number: int) -> None:
        rest = [c for c in batch.columns if c not in keys]
        rows = batch.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_row")).select(*keys, "_row.*").select(*batch.columns) if rest else batch.distinct()
        table = read()
        write(rows if table is None else merge(table, rows, keys), number)

    return land


def land_stream(stream: DataFrame, land: Callable[[DataFrame, int], None], checkpoint: str) -> DataStreamWriter:
    return stream.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True)
