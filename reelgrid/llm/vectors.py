"""Rows with vectors: which of them count, and their matrices in Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def usable(vector: Column, most: float = float("inf")) -> Column:
    """Whether a vector has entries, all of them finite numbers of a size below `most`."""
    fits = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(most))
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, fits), F.lit(False))


def of_one_length(rows: DataFrame, vector: str) -> tuple[DataFrame, int]:
    """The rows whose vectors have the table's most frequent length (the longest of equally frequent ones), and that length; 0 without rows."""
    found = rows.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = found["d"] if found else 0
    return rows.where(F.size(vector) == d), d


def matrix(column: pa.Array) -> np.ndarray:
    """A batch's list column as a matrix; its lists have one length, and neither they nor their entries are null."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def lists(m: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A matrix as a list column."""
    return pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, max(1, m.shape[1]), dtype=np.int32)), pa.array(np.ascontiguousarray(m).reshape(-1), kind))
