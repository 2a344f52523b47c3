"""Python functions over Arrow batches on the workers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame

ROOT = str(Path(__file__).resolve().parents[2])
#: Bytes of strings that a function is given at a time, unless a single row holds more.
BATCH_BYTES = 16 << 20


def by_name(fn: Callable, *args) -> Callable:
    """fn(batches, *args), found by its name on the worker, wherever the worker was started."""
    module, name, root = fn.__module__, fn.__qualname__, ROOT

    def run(*given):
        import importlib
        import sys

        if root not in sys.path:
            sys.path.append(root)
        return getattr(importlib.import_module(module), name)(*given, *args)

    return run


def row_bytes(column):
    """Bytes of the strings in each row of an Arrow array, whatever it nests them in, as a numpy array."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    kind, none = column.type, np.zeros(len(column), dtype=np.int64)
    if pa.types.is_struct(kind):
        return sum((row_bytes(part) for part in column.flatten()), none)
    if pa.types.is_list(kind):
        inner = np.append(0, row_bytes(column.flatten()).cumsum())
        ends = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False).cumsum()
        return np.diff(inner[np.append(0, ends)])
    if pa.types.is_map(kind):
        return row_bytes(column.cast(pa.list_(pa.struct([kind.key_field, kind.item_field]))))
    if pa.types.is_string(kind) or pa.types.is_binary(kind) or pa.types.is_large_string(kind) or pa.types.is_large_binary(kind):
        return pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return none


def slices(batch, rows: int, size: int = BATCH_BYTES) -> Iterator:
    """An Arrow batch in slices of at most so many rows, and of at most ``size`` bytes of strings where rows allow it."""
    import numpy as np

    upto, at = sum(row_bytes(c) for c in batch.columns).cumsum() if batch.num_columns else np.zeros(batch.num_rows), 0
    while at < batch.num_rows:
        before = upto[at - 1] if at else 0
        end = min(at + rows, max(at + 1, int(np.searchsorted(upto, before + size, side="right"))))
        yield batch.slice(at, end - at)
        at = end


def map_arrow(df: DataFrame, fn: Callable, schema: str, rows: int, *args) -> DataFrame:
    """df.mapInArrow in batches of so many rows and BATCH_BYTES of strings at most; the session's settings stay as they are."""
    run, small = by_name(fn, *args), by_name(slices)
    return df.mapInArrow(lambda batches: run(part for batch in batches for part in small(batch, rows)), schema)
