"""Folds whose step depends on what earlier steps decided, which no window can say."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from basaltic.session import ship


def folded(rows: DataFrame, key: str, order: list[str], inputs: list[str], step: Callable, out: str) -> DataFrame:
    """rows with a long column `out`: step(state, *inputs) gives (state, value) for each row of a key in order, the state None first.

    Rows stream by sorted, so a task holds one batch and one state, however many rows a key has. Null keys are a key of their own."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, first = None, None, True
        for batch in batches:
            values = []
            for k, *given in zip(batch.column(key).to_pylist(), *(batch.column(c).to_pylist() for c in inputs)):
                if first or k != at:
                    at, state, first = k, None, False
                state, value = step(state, *given)
                values.append(value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.int64())], [*batch.schema.names, out])

    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.LongType())])
    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)
