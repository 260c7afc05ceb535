"""Embeddings as rows of bytes: valid vectors only, equal ones once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_matrix(column: pa.Array) -> np.ndarray:
    """A binary column of equal lengths as a matrix of doubles."""
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(len(column), -1)


def valid_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v): double bytes of the vectors that can be compared.

    Left out are rows with a null id, null, empty or zero vectors, and vectors with null or non-finite components.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, vectors = [], []
            for i, v in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                values = v.values  # None for a null vector
                if i is None or values is None or not len(values) or values.null_count:
                    continue
                x = values.to_numpy(zero_copy_only=False)
                if np.isfinite(x).all() and x.any():
                    ids.append(i)
                    vectors.append((x + 0.0).astype("<f8").tobytes())  # -0.0 becomes 0.0
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(vectors, pa.binary())], ["vec_id", "v"])

    narrow = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    return narrow.mapInArrow(run, "vec_id long, v binary")


def by_length(vectors: DataFrame) -> list[DataFrame]:
    """The vectors of each length; those of another cannot be compared with them. One row per length is read."""
    lengths = sorted(r["n"] for r in vectors.select(F.octet_length("v").alias("n")).distinct().collect())
    return [vectors.filter(F.octet_length("v") == n) for n in lengths] if len(lengths) != 1 else [vectors]


def scaled(x: np.ndarray) -> np.ndarray:
    """Every row times a power of two that brings its largest component near 1: exact, and squares neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def distinct_vectors(vectors: DataFrame, most: int) -> DataFrame:
    """(v, ids): every different vector once with its ``most`` smallest ids, sorted.

    Copies are folded within each batch, then within each of 64 shares, before they meet: no list
    grows with a group of copies.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held: dict[bytes, list[int]] = {}
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held.setdefault(v, []).append(i)
            ids = [sorted(set(x))[:most] for x in held.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(ids, pa.list_(pa.int64()))], ["v", "ids"])

    merged = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, most).alias("ids")
    folded = vectors.mapInArrow(fold, "v binary, ids array<bigint>")
    shares = folded.groupBy("v", F.pmod(F.xxhash64(F.element_at("ids", 1)), F.lit(64)).alias("_share")).agg(merged)
    return shares.groupBy("v").agg(merged)
