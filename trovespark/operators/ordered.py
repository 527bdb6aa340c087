"""Order-dependent steps: rows of a group in order, one at a time, with state that is small whatever the group's size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def columns(**types: str) -> StructType:
    """A schema of plain types, made without a session."""
    out = StructType()
    for name, kind in types.items():
        out = out.add(name, kind)
    return out


def folded(df: DataFrame, group: str, order: list[Column], begin: Callable[[], Callable[[dict], dict | None]], schema: StructType) -> DataFrame:
    """For each row of df what step(row) returns, None for nothing; begin() gives a new step for each value of group.

    Rows are dealt by group, sorted within partitions and streamed, so a task holds a batch and a state,
    never a group. Rows should be narrow: join long texts to what is left.
    """
    arrow = to_arrow_schema(schema)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, step = object(), None
        for b in it:
            out = []
            for row in b.to_pylist():
                if row[group] != now:
                    now, step = row[group], begin()
                got = step(row)
                if got is not None:
                    out.append(got)
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return df.repartition(group).sortWithinPartitions(group, *order).mapInArrow(batches, schema)
