"""Named arrays of models: archives read through Spark's file readers, and a Parquet form that needs no local files."""

from __future__ import annotations

import io
from collections.abc import Sequence

import numpy as np
from pyspark.sql import SparkSession


def load_npz(spark: SparkSession, path: str, required: Sequence[str] = (), optional: Sequence[str] = ()) -> dict[str, np.ndarray | None]:
    """Arrays of a .npz file on any store that Spark reads, without pickles. Missing optional ones are None; missing required ones raise."""
    content = spark.read.format("binaryFile").load(path).select("content").first()[0]
    with np.load(io.BytesIO(bytes(content)), allow_pickle=False) as z:
        out: dict[str, np.ndarray | None] = {k: z[k] for k in z.files}
    if missing := [k for k in required if k not in out]:
        raise ValueError(f"missing arrays: {missing}")
    return out | {k: None for k in optional if k not in out}


def save_arrays(spark: SparkSession, path: str, arrays: dict[str, np.ndarray]) -> None:
    rows = [(k, a.dtype.str, [int(n) for n in a.shape], np.ascontiguousarray(a).tobytes()) for k, a in arrays.items()]
    spark.createDataFrame(rows, "name string, dtype string, shape array<long>, data binary").coalesce(1).write.mode("overwrite").parquet(path)


def load_arrays(spark: SparkSession, path: str) -> dict[str, np.ndarray]:
    return {r.name: np.frombuffer(r.data, r.dtype).reshape(r["shape"]) for r in spark.read.parquet(path).collect()}
