"""Functions over Arrow arrays as column functions that answer in parts of bounded size.

Spark bounds the bytes it sends to a Python worker at once, but not what comes back: words take
ten times the room of their text. So a worker cuts what it gets and answers part by part, and
neither the worker nor the executor that reads the answer holds more of it.

The functions travel with the job, so executors need no copy of this package.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def parts(columns: list[pa.Array], most: int) -> Iterator[list[pa.Array]]:
    """Neighbouring rows of ``columns``, at most ``most`` bytes of them or a single row."""
    n = len(columns[0])
    if n > 1 and sum(column.nbytes for column in columns) > most:
        for low, high in ((0, n // 2), (n // 2, n)):
            yield from parts([column.slice(low, high - low) for column in columns], most)
    else:
        yield columns


def in_parts(function: Callable[..., pa.Array], kind: str, most: int, *columns: Column) -> Column:
    """``function`` of the columns, of type ``kind``, for parts of at most ``most`` bytes."""

    def of_one(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for part in parts([batch], most):
                yield function(*part)

    def of_many(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for batch in batches:
            for part in parts(list(batch), most):
                yield function(*part)

    return F.arrow_udf(of_one if len(columns) == 1 else of_many, kind)(*columns)
