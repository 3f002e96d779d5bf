"""Vector expressions and the binary form of vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def _product(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def cosine_similarity(a: Column, b: Column) -> Column:
    """0 if either vector is all zero."""
    norms = F.sqrt(_product(a, a)) * F.sqrt(_product(b, b))
    return F.when(norms == 0, F.lit(0.0)).otherwise(_product(a, b) / norms)


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def decode_vectors(df: DataFrame, blob_col: str, out_col: str = "embedding") -> DataFrame:
    """Little-endian float32 blobs (or their base64 text) to arrays; the other columns stay."""
    blob = F.unbase64(df[blob_col]) if dict(df.dtypes)[blob_col] == "string" else df[blob_col]

    @F.arrow_udf("array<float>")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for blobs in batches:
            yield pa.array([None if b is None else np.frombuffer(b, "<f4") for b in blobs.to_pylist()], pa.list_(pa.float32()))

    return df.withColumn(out_col, decode(blob))


def encode_vectors(df: DataFrame, vector_col: str, out_col: str = "blob") -> DataFrame:
    """Arrays to little-endian float32 blobs."""

    @F.arrow_udf("binary")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for vectors in batches:
            yield pa.array([None if v is None else np.asarray(v, "<f4").tobytes() for v in vectors.to_pylist()], pa.binary())

    return df.withColumn(out_col, encode(df[vector_col].cast("array<float>")))
