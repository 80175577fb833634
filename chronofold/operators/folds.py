"""Ordered folds: one state a key, carried over its rows in order.

Rows are dealt by key and sorted inside their partition, and a task streams them: it holds a batch and one state, so a
long history takes no more memory than a short one. A history is sequential by nature; keys run in parallel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

BATCH = 4096


def folded(df: DataFrame, key: str, order: list[str], start: Callable[[], object], step: Callable, added: str, end: Callable | None = None) -> DataFrame:
    """A row for each input row, or with ``end`` for each key.

    step(state, row) returns (state, values) with the values of the columns ``added`` (a schema string), or None in place
    of the values for no row. With ``end``, end(state) gives the values of a key's one row.
    """
    extra = T._parse_datatype_string(added)
    fields = ([df.schema[key]] if end else df.schema.fields) + extra.fields
    schema = T.StructType(fields)
    arrow = to_arrow_schema(schema)
    names = [f.name for f in extra.fields]

    def rows(batches) -> Iterator[dict]:
        now, state, begun = None, None, False
        for b in batches:
            for row in b.to_pylist():
                if not begun or row[key] != now:
                    if begun and end:
                        yield {key: now, **dict(zip(names, end(state), strict=True))}
                    now, state, begun = row[key], start(), True
                state, values = step(state, row)
                if not end and values is not None:
                    yield {**row, **dict(zip(names, values, strict=True))}
        if begun and end:
            yield {key: now, **dict(zip(names, end(state), strict=True))}

    def run(batches):
        held: list[dict] = []
        for r in rows(batches):
            held.append(r)
            if len(held) >= BATCH:
                yield pa.RecordBatch.from_pylist(held, schema=arrow)
                held = []
        yield pa.RecordBatch.from_pylist(held, schema=arrow)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)
