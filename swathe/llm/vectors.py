"""Vectors in Arrow columns: which take part, and how they travel between tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rows_of(col) -> list[np.ndarray | None]:
    """A list column's vectors in double precision; None for those that take no part: null,
    empty or zero vectors, and vectors with null or non-finite components."""
    out: list[np.ndarray | None] = []
    values = col.flatten() if not col.null_count else None
    if values is not None and not values.null_count:
        flat = values.to_numpy(zero_copy_only=False).astype(np.float64)
        offs = col.offsets.to_numpy()
        parts = [flat[a - offs[0] : b - offs[0]] for a, b in zip(offs[:-1], offs[1:], strict=True)]
    else:
        parts = [None if x is None or any(y is None for y in x) else np.array(x, np.float64) for x in col.to_pylist()]
    for v in parts:
        out.append(v if v is not None and len(v) and np.isfinite(v).all() and v.any() else None)
    return out


def packed(df: DataFrame, vec_id: str, embedding: str, *more: str, kind: type = np.float64) -> DataFrame:
    """(vec_id, *more, v, dim, norm2): ``v`` holds the components as ``kind`` (doubles), null where
    the vector takes no part."""

    def run(batches):
        for batch in batches:
            vecs = rows_of(batch.column("e"))
            v = pa.array([None if x is None else x.astype(kind).tobytes() for x in vecs], pa.binary())
            dim = pa.array([None if x is None else len(x) for x in vecs], pa.int32())
            norm = pa.array([None if x is None else float(x @ x) for x in vecs], pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), v, dim, norm], [*names, "v", "dim", "norm2"])

    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), *more, F.col(embedding).alias("e"))
    names = ["vec_id", *more]
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.drop("e").dtypes)
    return rows.mapInArrow(run, f"{schema}, v binary, dim int, norm2 double")


def matrix(col) -> np.ndarray:
    """The packed vectors of an Arrow column (equal lengths, none null) as rows."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    if not n:
        return np.zeros((0, 0))
    raw = b"".join(x.as_buffer().to_pybytes() for x in col)
    return np.frombuffer(raw, np.float64).reshape(n, -1)
