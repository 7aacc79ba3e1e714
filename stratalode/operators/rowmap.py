"""Arrow-batched row operators: one Python call per record batch, never per row through the JVM bridge."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources.ship import ship

#: Rows turned into one output batch; keeps a batch small where one input row yields many.
OUT_ROWS = 20_000


_kept: dict[str, Callable] = {}


def kept(token: str, make: Callable[[], Callable]) -> Callable:
    """What ``make`` returns, built once per Python worker and query: workers run many tasks, and models and automata take longer to build than a split to read."""
    if token not in _kept:
        while len(_kept) >= 4:
            _kept.pop(next(iter(_kept)))
        _kept[token] = make()
    return _kept[token]


def map_rows(df: DataFrame, make: Callable[[], Callable], schema: str) -> DataFrame:
    """Flat-map the rows of ``df``.

    ``make`` runs once per Python worker and returns a function that takes a row's
    values in column order and returns an iterable of output tuples.  The
    partitions stay those of the input: nothing is shuffled.
    """
    ship(df.sparkSession)
    spec = T.StructType.fromDDL(schema)
    arrow, token = to_arrow_schema(spec), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = kept(token, make)
        out: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                out.extend(f(*row))
                if len(out) >= OUT_ROWS:
                    yield to_batch(out, arrow)
                    out = []
        if out:
            yield to_batch(out, arrow)

    return df.mapInArrow(run, spec)


def to_batch(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(arrow)
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, arrow)], schema=arrow)
