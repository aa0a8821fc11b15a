"""Folds whose step depends on the state before: one sorted pass in Arrow batches, with one state in memory at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def folded(rows: DataFrame, key: list[str], order: list[str], fields: list[str], outputs: str, start: tuple, step: Callable) -> DataFrame:
    """rows and outputs: step(state, *fields) gives the next state and the row's outputs; each key begins anew with start.

    An entity's rows are sorted by Spark, which spills, and pass through one task; nothing of them is collected, so an
    entity of any length takes the memory of a batch.
    """
    schema = T.StructType([*rows.schema.fields, *T.StructType.fromDDL(outputs).fields])
    added = [(f.name, to_arrow_type(f.dataType)) for f in T.StructType.fromDDL(outputs).fields]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state = None, start
        for batch in batches:
            out = []
            keys = zip(*(batch.column(c).to_pylist() for c in key))
            for k, *x in zip(keys, *(batch.column(c).to_pylist() for c in fields)):
                if k != held:
                    held, state = k, start
                state, row = step(state, *x)
                out.append(row)
            columns = list(zip(*out)) if out else [()] * len(added)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, t) for c, (_, t) in zip(columns, added))], names=[*batch.schema.names, *(n for n, _ in added)])

    return rows.repartition(*key).sortWithinPartitions(*key, *order).mapInArrow(work, schema)
