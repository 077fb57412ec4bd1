"""Columns of numbers packed as bytes, one row a bucket, so that an exchange moves few rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def pack(bucket: np.ndarray, *columns: np.ndarray, name: str = "bucket") -> pa.RecordBatch:
    """A row for each bucket: its number and each column's values there, in the order given."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    at = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]][: len(bucket)])
    bounds = np.r_[at, len(bucket)]
    packed = []
    for c in columns:
        if len(c) * c.itemsize >= 1 << 31:  # offsets of binary columns have 32 bits
            raise ValueError("more than 2 GiB to be packed at once")
        offsets = (bounds * c.itemsize).astype(np.int32)
        packed.append(pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(c[order].tobytes())]))
    return pa.RecordBatch.from_arrays([pa.array(bucket[at]), *packed], [name, *(f"c{i}" for i in range(len(columns)))])


def unpack(group: pa.Table, *kinds: type) -> list[np.ndarray]:
    """The columns of all rows of a bucket, one after the other."""
    return [np.frombuffer(b"".join(group.column(f"c{i}").to_pylist()), kind) for i, kind in enumerate(kinds)]
