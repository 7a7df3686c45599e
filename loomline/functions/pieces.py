"""Functions of one column that Python runs piece by piece: what a worker holds is bounded by a piece, whatever the rows of a batch are or make."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A piece ends at so many bytes (a larger value is one alone) or rows.
PIECE_BYTES, PIECE_ROWS = 4 << 20, 128
KINDS = {"string": pa.string(), "binary": pa.binary(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64()}


def pieces(values: pa.Array) -> Iterator[list]:
    """The values of a batch as lists, one after the other."""
    sized = pa.types.is_string(values.type) or pa.types.is_binary(values.type) or pa.types.is_large_string(values.type) or pa.types.is_large_binary(values.type)
    sizes = pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64) if sized else np.zeros(len(values), np.int64)
    ends, a = np.cumsum(sizes), 0
    while a < len(values):
        full = int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PIECE_BYTES, "right"))
        b = min(len(values), a + PIECE_ROWS, max(a + 1, full))
        yield values.slice(a, b - a).to_pylist()
        a = b


def by_pieces(fn: Callable[[list], list], kind: str, name: str | None = None) -> Callable[[Column | str], Column]:
    """fn(values) -> results as a column function. kind: a type, or `name type, name type` for results that are dicts. NaN is null.
    name: what plans call it."""
    fields = [f.split() for f in kind.split(", ")]
    flat = kind in KINDS
    arrow = KINDS[kind] if flat else pa.struct([(f, KINDS[k]) for f, k in fields])

    def plain(v):
        return None if v is None or v != v else v

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for values in pieces(batch):
                found = fn(values)
                yield pa.array(map(plain, found) if flat else [{f: plain(r.get(f)) for f, _ in fields} for r in found], arrow)

    run.__name__ = name or fn.__name__
    return lambda column: F.arrow_udf(run, kind)(column)  # types are parsed by a session, so when there is one
