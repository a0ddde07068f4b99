"""Parquet tables, and the views of feed analytics derived from them.

Views hold only cheap expressions over one table, so filters and column selection reach the scans.
Each has its SQL for DuckDB beside it, of the same name.
"""

from __future__ import annotations

import tempfile
import uuid

from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The tenant whose feeds, and items of these, the views hold; all tenants' if there is none.
TENANT: ContextVar[int | None] = ContextVar("tenant", default=None)


@contextmanager
def scope(tenant: int):
    """Inside, feeds() and items() are those of one tenant, and so is every read that is built on them."""
    token = TENANT.set(tenant)
    try:
        yield
    finally:
        TENANT.reset(token)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which all executors see; a session of one process may go without."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"{tempfile.gettempdir()}/reelgrid-tables"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def gone_at_exit(spark: SparkSession, path: str) -> str:
    """path, whose folder goes when the application ends."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new, existing folder under spark.checkpoint.dir that goes when the application ends."""
    path = shared_folder(spark, name)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(at)  # what isn't there can't be marked for removal
    return gone_at_exit(spark, path)


def kept(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read back, so what is used several times is computed once. The folder goes when the
    application ends."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(gone_at_exit(spark, path))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed entries: one per order line."""
    q = F.col("l_quantity").cast("long")
    lines = table(spark, sf_dir, "lineitem")
    if TENANT.get() is not None:  # by feed, before anything else is read or joined
        lines = lines.join(feeds(spark, sf_dir).select(F.col("feed_id").alias("l_suppkey")), "l_suppkey", "left_semi")
    return lines.select(
        F.col("l_orderkey").alias("release_id"), F.col("l_linenumber").cast("int").alias("line"), F.col("l_partkey").alias("media_id"), F.col("l_suppkey").alias("feed_id"),
        F.col("l_shipdate").alias("first_seen"), q.alias("qty"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("size_bytes"), F.col("l_returnflag").alias("flag"),
        F.when(q % 4 == 0, "2160p").when(q % 4 == 1, "1080p").when(q % 4 == 2, "720p").alias("quality"),
        F.when(q % 5 != 0, F.concat(F.lit("GRP"), (F.col("l_suppkey") % 7).cast("string"))).alias("release_group"),
    )


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Match decisions: status by order status, none for pending ones."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(
        k.alias("release_id"), F.when(F.col("o_orderstatus") == "F", "MATCHED").otherwise("UNMATCHED").alias("status"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("matched_at"), F.col("o_orderdate").alias("updated_at"),
        F.when(k % 3 != 0, k % 97).alias("metadata_id"), (k % 101).cast("int").alias("confidence"), (k % 11 == 0).alias("invalidated"), F.col("o_custkey").alias("actor_id"),
    )


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("media_id"), F.col("p_name").alias("title"), F.when(F.col("p_size") % 2 == 0, "MOVIE").otherwise("TV_SERIES").alias("media_type"),
        (F.lit(1980) + F.col("p_size")).alias("year"), F.when(F.col("p_partkey") % 4 != 0, F.concat(F.lit("/p"), F.col("p_partkey").cast("string"), F.lit(".jpg"))).alias("poster"),
    )


def feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = table(spark, sf_dir, "supplier")
    if TENANT.get() is not None:
        every = every.where(F.col("s_nationkey") % 5 == TENANT.get())
    return every.select(F.col("s_suppkey").alias("feed_id"), F.col("s_name").alias("feed_name"), (F.col("s_nationkey") % 5).alias("tenant_id"), (F.col("s_suppkey") % 6 != 0).alias("enabled"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Download jobs: one per event."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("job_id"), F.col("user_id").alias("item_id"), F.col("ts").alias("created_at"),
        F.when(F.col("event_type") == "error", "FAILED").when(F.col("event_type") == "purchase", "SENT").when(F.col("event_type") == "signup", "SKIPPED").when(F.col("event_type") == "click", "SENDING").otherwise("QUEUED").alias("status"),
        "props",
    )


DOMAIN_SQL = """
items AS (SELECT l_orderkey AS release_id, CAST(l_linenumber AS INT) AS line, l_partkey AS media_id, l_suppkey AS feed_id, l_shipdate AS first_seen,
    CAST(l_quantity AS BIGINT) AS qty, CAST(round(l_extendedprice * 100) AS BIGINT) AS size_bytes, l_returnflag AS flag,
    CASE CAST(l_quantity AS BIGINT) % 4 WHEN 0 THEN '2160p' WHEN 1 THEN '1080p' WHEN 2 THEN '720p' END AS quality,
    CASE WHEN CAST(l_quantity AS BIGINT) % 5 <> 0 THEN 'GRP' || (l_suppkey % 7) END AS release_group FROM lineitem),
matches AS (SELECT o_orderkey AS release_id, CASE WHEN o_orderstatus = 'F' THEN 'MATCHED' ELSE 'UNMATCHED' END AS status,
    CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS matched_at, o_orderdate AS updated_at, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 97 END AS metadata_id,
    CAST(o_orderkey % 101 AS INT) AS confidence, o_orderkey % 11 = 0 AS invalidated, o_custkey AS actor_id FROM orders WHERE o_orderstatus <> 'P'),
media AS (SELECT p_partkey AS media_id, p_name AS title, CASE WHEN p_size % 2 = 0 THEN 'MOVIE' ELSE 'TV_SERIES' END AS media_type, 1980 + p_size AS year,
    CASE WHEN p_partkey % 4 <> 0 THEN '/p' || p_partkey || '.jpg' END AS poster FROM part),
feeds AS (SELECT s_suppkey AS feed_id, s_name AS feed_name, s_nationkey % 5 AS tenant_id, s_suppkey % 6 <> 0 AS enabled FROM supplier),
jobs AS (SELECT event_id AS job_id, user_id AS item_id, ts AS created_at, CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'purchase' THEN 'SENT'
    WHEN 'signup' THEN 'SKIPPED' WHEN 'click' THEN 'SENDING' ELSE 'QUEUED' END AS status, props FROM events)
"""


def scoped_sql(sql: str, tenant: int) -> str:
    """A query's SQL over the views of one tenant."""
    mine = f"s_nationkey % 5 = {tenant}"
    return sql.replace("END AS release_group FROM lineitem)", f"END AS release_group FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE {mine}))").replace("AS enabled FROM supplier)", f"AS enabled FROM supplier WHERE {mine})")


def oracle(body: str, more: str = "") -> str:
    return f"WITH {DOMAIN_SQL}{more} {body}"
