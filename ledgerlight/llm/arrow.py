"""Row functions over Arrow batches, a few hundred rows at a time."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string


def per_worker(name: str, make: Callable[[], object]):
    """One object for all tasks of a Python worker. Functions come to workers by value, so this module's own globals would not last."""
    kept = sys.__dict__.setdefault("_ledgerlight_kept", {})
    if name not in kept:
        kept[name] = make()
    return kept[name]


def drop_kept() -> None:
    """Frees what tasks of an earlier operator left in this Python worker, and what Arrow holds in reserve."""
    sys.__dict__.pop("_ledgerlight_kept", None)
    pa.default_memory_pool().release_unused()


def map_rows(
    df: DataFrame, make: Callable[[], Callable[[dict[str, list]], dict[str, list]]], schema: str, rows: int = 256, keeps: bool = False
) -> DataFrame:
    """``make`` is called once a task and gives a function from columns (lists of one slice) to columns.

    A slice holds ``rows`` rows, so Python objects of a whole Arrow batch never exist at once. Spark uses its Python
    workers again for other operators; what :func:`per_worker` made stays for the tasks of operators that say ``keeps`` only.
    """
    parsed: StructType = _parse_datatype_string(schema)
    arrow = to_arrow_schema(parsed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            drop_kept()
        work = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                made = work({n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) for f in arrow], schema=arrow)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)
