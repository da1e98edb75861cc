"""One file in, many rows out: the only way Python code meets data in this engine."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: Rows and bytes of an output batch, and rows of an input batch that are Python objects at once.
BATCH_ROWS, BATCH_BYTES, SLICE_ROWS = 8192, 2 << 20, 64
#: Bytes that count for an entry of an array.
ENTRY = 64
#: Bounds of an Arrow batch, where the session leaves Spark's own: files may be large, and every Python stage of a task holds some.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "512"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", str(2 << 20))}


def per_file(df: DataFrame, schema: str, rows: Callable[..., Iterable[tuple]], *columns: str) -> DataFrame:
    """Rows that ``rows(*values of columns)`` yields for each row of df, file by file.

    ``rows`` must turn malformed input into rows: an exception would fail the job. What
    comes straight from another such step is made in the same pass, without a worker of its own.
    """
    made = getattr(df, "_per_file", None)
    if made:
        df, inner, names, given = made
        want, outer, columns = [names.index(c) for c in columns], rows, given

        def rows(*values):
            for found in inner(*values):
                yield from outer(*[found[k] for k in want])

    kind: StructType = _parse_datatype_string(schema)
    arrow = to_arrow_schema(kind)

    def batch(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), arrow.types)], schema=arrow) if found else pa.RecordBatch.from_arrays([pa.array([], t) for t in arrow.types], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0
        for b in batches:
            for k in range(0, b.num_rows, SLICE_ROWS):
                for values in zip(*(c.to_pylist() for c in b.slice(k, SLICE_ROWS).columns)):
                    for row in rows(*values):
                        out.append(row)
                        size += sum(len(v) * (ENTRY if isinstance(v, list) else 1) for v in row if isinstance(v, (bytes, bytearray, str, list)))
                        if len(out) >= BATCH_ROWS or size >= BATCH_BYTES:
                            yield batch(out)
                            out, size = [], 0
        if out:
            yield batch(out)

    names = kind.names
    assert names
    for key, (default, value) in BATCH.items():
        if df.sparkSession.conf.get(key) == default:
            df.sparkSession.conf.set(key, value)
    out = df.select(*columns).mapInArrow(run, kind)
    out._per_file = df, rows, names, columns
    return out
