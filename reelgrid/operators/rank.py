"""First row per key, top rows per key and ordered first values, with the null order always written out."""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key in that order; Spark drops rows beyond n before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def latest(value: Column, *by: str) -> Column:
    """The value of the greatest `by` among rows where the value is not null: an aggregate with partial sums."""
    return F.max_by(F.when(value.isNotNull(), value), F.when(value.isNotNull(), F.struct(*by)))


def joined_set(value: str, most: int) -> Column:
    """Distinct non-null values in order, the first `most`, joined by a bar."""
    return F.array_join(F.slice(F.array_sort(F.collect_set(value)), 1, most), "|")


def after(*keys: tuple[str, bool, object]) -> Column:
    """Rows behind a cursor: keys as (column, descending, cursor value), compared in order."""
    found, equal = F.lit(False), F.lit(True)
    for name, down, value in keys:
        c, v = F.col(name), F.lit(value)
        found = found | (equal & ((c < v) if down else (c > v)))
        equal = equal & (c == v)
    return found


def encoded_cursor(position: dict) -> str:
    """A page's last position as one opaque word."""
    return base64.urlsafe_b64encode(json.dumps(position, separators=(",", ":")).encode()).rstrip(b"=").decode()


def decoded_cursor(cursor: str, names: list[str]) -> dict:
    """The position in a cursor; ValueError if it is not one with exactly these names."""
    try:
        found = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
    except ValueError as e:
        raise ValueError("invalid cursor") from e
    if not isinstance(found, dict) or set(found) != set(names):
        raise ValueError("invalid cursor")
    return found
