"""Pages of a long list, newest first, that are filled however few rows pass their filter.

    path/rows/scope=S    the rows of a scope (a tenant), in files that each hold a range of their order
    path/ranges          (scope, file, rows, first, last): what a file holds

A page reads the files from its cursor on, one, then two, four and so on, until enough rows have passed; so it reads about twice
the files it needs, in few steps, and none beyond. Filters on columns reach the files as pushed-down predicates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def lay_out(rows: DataFrame, path: str, scope: str, order: list[str], files: int | None = None) -> None:
    """Writes rows at path, in about `files` ranges of (scope, order); order: columns, of which the greatest come first on a page."""
    spark = rows.sparkSession
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("scope", F.col(scope)).repartitionByRange(files, "scope", *order).sortWithinPartitions("scope", *(F.desc(c) for c in order))
    dealt.write.partitionBy("scope").parquet(f"{path}/rows")
    ranges_of(spark.read.parquet(f"{path}/rows"), order).write.parquet(f"{path}/ranges")


def ranges_of(rows: DataFrame, order: list[str]) -> DataFrame:
    """(scope, file, rows, first, last) of rows whose files are sorted, so their first and last rows are told by their places in the
    file; max() of a struct over all rows would sort them."""
    held = rows.select("scope", F.struct(*order).alias("place"), F.input_file_name().alias("file"), F.col("_metadata.row_index").alias("_row"))
    counts = held.groupBy("scope", "file").agg(F.count("*").alias("rows"))
    ends = held.drop("scope").join(F.broadcast(counts), "file").where((F.col("_row") == 0) | (F.col("_row") == F.col("rows") - 1))  # counts: a row a file
    return ends.groupBy("scope", "file", "rows").agg(F.max("place").alias("first"), F.min("place").alias("last"))


def page(spark: SparkSession, path: str, scope: object, order: list[str], size: int, keep: Column | None = None, after: tuple | None = None) -> DataFrame:
    """The first `size` rows of a scope behind the cursor `after` (values of order) that `keep` lets through, and one more if there
    is one (so a reader knows whether a next page is there). Rows for which keep is null do not pass."""
    rows = spark.read.parquet(f"{path}/rows")
    ranges = spark.read.parquet(f"{path}/ranges").where(F.col("scope") == F.lit(scope))
    behind = F.lit(True)
    if after is not None:
        at = F.struct(*(F.lit(v).cast(rows.schema[c].dataType).alias(c) for c, v in zip(order, after, strict=True)))
        ranges, behind = ranges.where(F.col("last") < at), F.struct(*order) < at
    wanted = F.coalesce(keep if keep is not None else F.lit(True), F.lit(False)) & behind
    found, seen, step, cursor = None, 0, 1, None
    while True:
        # The manifest is read on as the page is: `step` names at a time come to the driver.
        more = ranges.where(F.col("first") < cursor) if cursor is not None else ranges
        files = more.orderBy(F.desc("first")).limit(step).collect()
        if not files:
            break
        own = spark.read.schema(rows.schema).option("basePath", f"{path}/rows").parquet(*(f["file"] for f in files)).where(wanted)
        found = own if found is None else found.unionByName(own)
        seen += own.limit(size + 1 - seen).count()
        if seen > size or len(files) < step:
            break
        first = files[-1]["first"]
        cursor = F.struct(*(F.lit(first[c]).cast(rows.schema[c].dataType).alias(c) for c in order))
        step *= 2
    if found is None:
        return rows.limit(0).drop("scope")
    return found.orderBy(*(F.desc(c) for c in order)).limit(size + 1).drop("scope")
