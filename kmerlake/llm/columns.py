"""Arrow helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from kmerlake.llm.workers import trimmed


def add_columns(df: DataFrame, inputs: list[str], added: T.StructType, work: Callable[..., list[pa.Array]], drop: tuple[str, ...] = ()) -> DataFrame:
    """df without `drop` and with the columns that work(*arrays of inputs) makes of each Arrow batch. Names may be repeated, but for the inputs."""
    names = df.columns
    at = [names.index(c) for c in inputs]
    stay = [i for i, c in enumerate(names) if c not in drop]
    # in between, columns go by their places
    fields = [T.StructField(f"_{i}", df.schema.fields[i].dataType) for i in stay] + [T.StructField(f"_a{i}", f.dataType) for i, f in enumerate(added.fields)]
    schema = T.StructType(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = work(*(b.column(i) for i in at))
            yield pa.RecordBatch.from_arrays([b.column(i) for i in stay] + made, schema.names)

    return df.toDF(*(f"_{i}" for i in range(len(names)))).mapInArrow(trimmed(run), schema).toDF(*(names[i] for i in stay), *added.names)
