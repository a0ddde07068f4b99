"""Keyed merges and guarded state changes on plain tables (there is no MERGE INTO on Parquet)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgrid.operators.rank import top_per_key


def merge_keyed(target: DataFrame, source: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Target and source rows, the first of each key in that order; null keys never meet (they bypass uniqueness)."""
    both = target.unionByName(source)
    some_null = F.greatest(*(F.col(k).isNull().cast("int") for k in keys), F.lit(0)) == 1
    return top_per_key(both.where(~some_null), keys, order).unionByName(both.where(some_null))


def changed(old: str, new: str, columns: list[str]) -> Column:
    """Whether any column differs, nulls equal to nulls."""
    out = F.lit(False)
    for c in columns:
        out = out | ~F.col(f"{old}.{c}").eqNullSafe(F.col(f"{new}.{c}"))
    return out


#: Allowed changes of a job's status.
TRANSITIONS = {"QUEUED": ["SENDING", "SKIPPED"], "FAILED": ["SENDING", "SKIPPED"], "SENDING": ["SENT", "FAILED"]}


def may_change(status: Column, to: Column) -> Column:
    out = F.lit(False)
    for source, targets in TRANSITIONS.items():
        out = out | ((status == source) & to.isin(targets))
    return out


def ledger(events: DataFrame, keys: list[str], at: list[str], same: list[str]) -> DataFrame:
    """An append-and-invalidate ledger from decisions: runs of equal decisions are one entry, and each entry is
    invalidated when the next begins (column invalidated_at; null for the active one)."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(*at)
    differs = F.lag(F.lit(True)).over(w).isNull()
    for c in same:
        differs = differs | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    return events.withColumn("_new", differs).where("_new").drop("_new").withColumn("invalidated_at", F.lead(at[0]).over(w))
