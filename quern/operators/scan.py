"""Recurrences over ordered rows of a key, in constant memory: rows are sorted within partitions and read once, in batches."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scan(df: DataFrame, by: list[str], order: list[str], inputs: list[str], start: Callable[[], list], step: Callable, outputs: list[str]) -> DataFrame:
    """df with double columns outputs: step(state, *values) of the columns inputs (None where null), in order, from start()
    at every key's first row. A key's rows meet in one task, as each needs the one before, but are never held together."""
    kept = df.columns
    doubles = [F.col(f"`{c}`").cast("double").alias(f"__in{k}") for k, c in enumerate(inputs)]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), *(f"`{c}` double" for c in outputs)])

    def run(batches):
        key, state = object(), None
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in by))) if by else [()] * len(batch)
            values = zip(*(batch.column(f"__in{k}").to_pylist() for k in range(len(inputs))))
            rows = []
            for k, v in zip(keys, values):
                if k != key:
                    key, state = k, start()
                rows.append(step(state, *v))
            made = [pa.array([r[i] for r in rows], pa.float64()) for i in range(len(outputs))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *made], [*kept, *outputs])

    return df.select("*", *doubles).repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, schema)
