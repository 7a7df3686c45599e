"""What the operators on vectors share: usable rows as whole numbers, and merging one row a task in a tree."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from loomline.llm.common import written

#: Rows that one step of a tree merges.
FAN = 16


def usable(vector: Column) -> Column:
    """Neither null nor with an entry that is null or not finite."""
    finite = lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf"))  # noqa: E731  (false for NaN, the largest of all)
    return vector.isNotNull() & F.coalesce(F.forall(vector, finite), F.lit(False))


def whole_numbers(vector: Column, scale: int, shift: int = 0) -> Column:
    """floor(scale * entry) + shift, entries as doubles."""
    return F.transform(vector, lambda c: (F.floor(c.cast("double") * float(scale)) + F.lit(shift)).cast("bigint"))


def common_length(rows: DataFrame, vector_col: str) -> int:
    """The length of most vectors, the longer one of equals; 0 for no rows."""
    first = rows.groupBy(F.size(vector_col).alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    return first["length"] if first else 0


def matrix(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def tree_merged(rows: DataFrame, merge: Callable[[list[dict]], dict], name: str) -> dict | None:
    """One row out of many: rows (part_ from 0, and what `merge` reads and returns), merged FAN at a time until one is left. The
    first rows are written; each step is a grouping whose groups have FAN rows at most."""
    rows = written(rows, name)
    most = rows.agg(F.max("part_")).first()[0]
    if most is None:
        return None
    schema = to_arrow_schema(rows.schema)

    def run(group: pa.Table) -> pa.Table:
        found = sorted(group.to_pylist(), key=lambda r: r["part_"])
        return pa.Table.from_pylist([merge(found) | {"part_": found[0]["part_"] // FAN}], schema=schema)

    while True:
        rows = rows.groupBy(F.expr(f"part_ div {FAN}")).applyInArrow(run, rows.schema)
        most //= FAN
        if not most:
            return rows.first().asDict()
