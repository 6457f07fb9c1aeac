"""Small helpers around mapInArrow: whole batches in, whole batches out."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomstat.session import ship

Columns = dict[str, "pa.Array | np.ndarray"]


def batches_of(columns: Columns, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, type=f.type) for c, f in zip(columns.values(), schema)],
        schema=schema,
    )


def map_batches(df: DataFrame, work: Callable[[pa.RecordBatch], Columns | None], schema: str) -> DataFrame:
    """Apply ``work`` to each Arrow batch of ``df``; it returns columns in the order of ``schema``."""
    arrow = arrow_schema(df, schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (columns := work(batch)) is not None:
                yield batches_of(columns, arrow)

    return map_tasks(df, run, schema)


def map_tasks(df: DataFrame, run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with this package sent to the executors first."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def arrow_schema(df: DataFrame, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def texts(column: pa.Array) -> list[str]:
    """Strings of an Arrow column, null as empty."""
    return [x or "" for x in column.to_pylist()]
