"""Ordered folds: what each row gives depends on what the rows before it gave.

A key's rows have one order and pass one task, which no plan can avoid. They pass
it as a stream of sorted Arrow batches: sorting spills, and the fold holds its
own state only, never a key's rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def ordered_fold(rows: DataFrame, key: str, order: list[str], inputs: list[str], outputs: str, start: Callable[[], Callable[..., tuple]]) -> DataFrame:
    """Adds the columns ``outputs`` (DDL): ``start()`` gives a key's step, a function of the values of ``inputs`` that is called for its rows in order and returns the new ones."""
    added = T.StructType.fromDDL(outputs)
    names, schema = rows.columns, T.StructType([*rows.schema.fields, *added.fields])
    kinds = [to_arrow_type(f.dataType) for f in added.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, step = None, None
        for batch in batches:
            found = []
            values = zip(*(batch.column(names.index(c)).to_pylist() for c in inputs))
            for k, v in zip(batch.column(names.index(key)).to_pylist(), values):
                if step is None or k != now:
                    now, step = k, start()
                found.append(step(*v))
            columns = zip(*found) if found else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, t) for c, t in zip(columns, kinds))], names=schema.names)

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)
