"""Vectors from an array column, checked and as raw bytes, for the operators on embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostercast.llm.common import staged


def valid_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(id, v, h)`` of the rows that take part, staged: components as 64-bit floats, and a 128-bit hash of them.

    Vectors that are null, empty, zero or hold null or non-finite components are left out.
    """

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            ids, raw, digest = [], [], []
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if k is None or not v.is_valid or v.values.null_count or not len(v.values):
                    continue
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if np.isfinite(x).all() and x.any():
                    x = x + 0.0  # one zero only
                    ids.append(k)
                    raw.append(x.tobytes())
                    digest.append(xxh3_128_digest(raw[-1]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(raw, pa.binary()), pa.array(digest, pa.binary())], ["id", "v", "h"])

    return staged(rows.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"))
                  .mapInArrow(checked, "id long, v binary, h binary"), "vectors")


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Equal-length vectors, one a row."""
    parts = [x.as_py() for x in column]
    return np.frombuffer(b"".join(parts), np.float64).reshape(len(parts), -1) if parts else np.zeros((0, 0))
