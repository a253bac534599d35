"""Rules that go through rows in order and depend on what they decided before.

Such a rule cannot be a window function. Rows are sorted within partitions and stream through a
task in batches; of a key only a small state is held, so that a key may have any number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of a batch that a walk gives back.
BATCH = 10_000


def walk_in_order(df: DataFrame, *, by: list[str], order: list[str], columns: list[str], schema: str, walk: Callable[[Iterator[tuple]], Iterable[tuple]]) -> DataFrame:
    """walk gets the values of `columns` of all rows of a task, keys one after the other and each in
    order, and yields rows of the schema."""
    wanted = StructType.fromDDL(schema)
    arrow = to_arrow_schema(wanted)

    def run(batches):
        rows = (row for batch in batches for row in zip(*(batch.column(i).to_pylist() for i in range(len(columns))), strict=True))
        held: list[tuple] = []
        for row in walk(rows):
            held.append(row)
            if len(held) == BATCH:
                yield _batch(held, arrow)
                held = []
        if held:
            yield _batch(held, arrow)

    return df.repartition(*by).sortWithinPartitions(*by, *order).select(*columns).mapInArrow(run, wanted)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def flag_in_order(df: DataFrame, *, by: list[str], order: list[str], values: list[Column], decide: Callable, out: str) -> DataFrame:
    """df with a boolean column. decide(state, *values) is asked for the rows of each key in order and
    returns the flag and the next state; the state of a key is None at first."""
    n = len(df.columns)
    keys = [f"_key{i}" for i in range(len(by))]
    given = [f"_value{i}" for i in range(len(values))]
    rows = df.select("*", *(F.col(c).alias(k) for c, k in zip(by, keys, strict=True)), *(v.alias(g) for v, g in zip(values, given, strict=True)))
    wanted = StructType([*df.schema, *StructType.fromDDL("f boolean")])
    wanted[n].name = out
    wanted.names[n] = out

    def run(batches):
        key, state = None, None
        for batch in batches:
            lists = [batch.column(i).to_pylist() for i in range(n, batch.num_columns)]
            flags = []
            for row in zip(*lists, strict=True):
                if row[: len(keys)] != key:
                    key, state = row[: len(keys)], None
                flag, state = decide(state, *row[len(keys) :])
                flags.append(flag)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(flags, pa.bool_())], names=[*batch.schema.names[:n], out])

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, wanted)
