"""Vectors as rows of bytes. A vector that is null, empty, zero, or holds null or non-finite components takes no part."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidelog.llm.common import column as named
from tidelog.llm.common import table


def _rows(width: str):
    def run(batches):
        from pyspark import TaskContext

        uid = TaskContext.get().partitionId() << 36
        for batch in batches:
            bodies, dims = [], []
            for value in batch.column(1):
                own = None
                if value.is_valid and value.values.null_count == 0:
                    v = value.values.to_numpy(zero_copy_only=False).astype(width)
                    if len(v) and np.isfinite(v).all() and v.any():
                        own = (v + 0.0).tobytes()  # -0.0 becomes 0.0
                bodies.append(own)
                dims.append(len(own) // np.dtype(width).itemsize if own else None)
            yield pa.record_batch({"uid": pa.array(np.arange(uid, uid + batch.num_rows), pa.int64()), "vec_id": batch.column(0), "dim": pa.array(dims, pa.int32()), "body": pa.array(bodies, pa.binary())})
            uid += batch.num_rows

    return run


def vectors(rows: DataFrame, vec_id: str, embedding: str) -> tuple[DataFrame, str]:
    """uid (one per row), vec_id, dim and body (little-endian components; both null for vectors that take no part), written to the shared folder; and the components' numpy type."""
    kind = rows.schema[embedding].dataType
    width = "<f4" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else "<f8"
    element = "float" if width == "<f4" else "double"
    plain = rows.select(named(vec_id).cast("long").alias("vec_id"), named(embedding).cast(f"array<{element}>").alias("embedding"))
    return table(plain.mapInArrow(_rows(width), "uid long, vec_id long, dim int, body binary"), "vectors"), width


def stored(column, width: str, dim: int) -> np.ndarray:
    """The bodies as rows of the components' own type."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(column.to_pylist()), width).reshape(-1, dim)


def matrix(column, width: str, dim: int) -> np.ndarray:
    """The bodies as rows of doubles."""
    return stored(column, width, dim).astype(np.float64)


def scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of doubles, each divided by the power of two that brings its largest component to 1/2 or more and below 1, which changes no digit; and the exponents. Products of such rows neither overflow nor vanish."""
    exponent = np.frexp(np.abs(x).max(1))[1]
    return np.ldexp(x, -exponent[:, None]), exponent


def inner(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row, component after component in double precision, so that a pair has one value wherever it is computed."""
    out = np.zeros(len(x))
    for d in range(x.shape[1]):
        out += x[:, d] * y[:, d]
    return out
