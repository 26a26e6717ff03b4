"""Sequential work over ordered groups: one task reads its groups one after the other, in Arrow batches, whatever their number
or length. A group costs no Python call of its own, and is held only as far as the work on it needs."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows of a batch that goes back.
ROWS = 8192


def in_order(df: DataFrame, part: list[str], order: str, schema: str, work: Callable[[tuple, Iterable[tuple]], Iterable[tuple]]) -> DataFrame:
    """The rows of `schema` that work(key, rows) gives for each group; rows are tuples of df's columns, by `order`."""
    names = df.columns
    at = [names.index(c) for c in part]
    dealt = df.repartition(*part).sortWithinPartitions(*part, order)
    empty = df.sparkSession.createDataFrame([], schema).schema

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                piece = batch.slice(start, ROWS)
                yield from zip(*(c.to_pylist() for c in piece.columns), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, made = to_arrow_schema(empty), []
        for row in chain.from_iterable(work(key, rows) for key, rows in groupby(rows_of(batches), lambda r: tuple(r[i] for i in at))):
            made.append(row)
            if len(made) == ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), arrow, strict=True)], schema=arrow)
                made = []
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), arrow, strict=True)], schema=arrow)

    return dealt.mapInArrow(run, schema)
