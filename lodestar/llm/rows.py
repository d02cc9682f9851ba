"""Running a small Python helper over the rows of a DataFrame, in Arrow batches of bounded size."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType, _parse_datatype_string

#: Rows, and characters or bytes of text, in one batch that goes back to Spark.
BATCH_ROWS, BATCH_BYTES = 2048, 16 << 20


_sent: set[str] = set()


def send_package(context: SparkContext) -> None:
    """Give this package to the Python workers, once for each application, so that it need not be installed on their machines."""
    if context.applicationId in _sent:
        return
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.realpath(__file__))))
    path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="lodestar-")), "lodestar.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(os.path.join(top, "lodestar")):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, top))
    context.addPyFile(path)
    _sent.add(context.applicationId)


def give_back() -> None:
    """Return memory that a task no longer uses to the system; workers stay alive between tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def add_column(df: DataFrame, inputs: list[str], name: str, kind: str, start: Callable[[], Callable[..., object]]) -> DataFrame:
    """df with one more column, start()'s function of the inputs; all other columns pass by unread."""
    from pyspark.sql.pandas.types import to_arrow_schema

    send_package(df.sparkSession.sparkContext)
    whole = StructType([*df.schema.fields, *_parse_datatype_string(f"`{name}` {kind}").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(whole)
        each = start()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                made = [each(*row) for row in zip(*(part.column(c).to_pylist() for c in inputs))]
                columns = [c.cast(f.type) for c, f in zip(part.columns, arrow)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(made, type=arrow.field(name).type)], schema=arrow)
        give_back()

    return df.mapInArrow(run, whole)


def map_rows(df: DataFrame, columns: list[str], schema: str, start: Callable[[], Callable[..., Iterable[tuple]]]) -> DataFrame:
    """df.select(columns), each row given to start()'s function, which yields rows of schema.

    start is called once in each task, so that tables and models are set up there.
    If its function has a finish, that yields rows after the task's last row.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    send_package(df.sparkSession.sparkContext)
    kind: StructType = _parse_datatype_string(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(kind)
        each, held, weight = start(), [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in held], type=f.type) for n, f in enumerate(arrow)], schema=arrow)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for row in zip(*(c.to_pylist() for c in part.columns)):
                    for made in each(*row):
                        held.append(made)
                        weight += sum(len(x) for x in made if isinstance(x, (str, bytes, list)))
                        if len(held) >= BATCH_ROWS or weight >= BATCH_BYTES:
                            yield out()
                            held, weight = [], 0
        held.extend(getattr(each, "finish", tuple)())
        if held:
            yield out()
        held = None
        give_back()

    return df.select(*columns).mapInArrow(run, kind)
