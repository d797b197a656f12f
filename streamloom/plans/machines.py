"""One state machine for each key, fed its rows in order, in bounded memory."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def machines(df: DataFrame, keys: list[str], order: str, start: Callable[[], Callable[[dict], list[tuple]]], schema: str) -> DataFrame:
    """Feeds each key's rows, in order, to a machine of its own; its rows out.

    Rows are dealt by key and sorted, then stream through: a task holds one machine and one batch at a time, however many
    rows a key has. There are as many tasks with work as keys, since what becomes of a row hangs on all before it.
    """
    dealt = df.repartition(*keys).sortWithinPartitions(*keys, order)
    kinds = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, feed = None, None
        for batch in batches:
            out = []
            for record in batch.to_pylist():
                key = tuple(record[k] for k in keys)
                if key != current:
                    current, feed = key, start()
                out += feed(record)
            columns = zip(*out, strict=True) if out else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)

    return dealt.mapInArrow(run, schema)
