"""Input tables, the shared checkpoint folder and small column helpers of the operators here."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own only where a session of one process sets none (tests)."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.gettempdir().rstrip("/") + "/reelgrid-checkpoints"  # one process: its own folder is shared


def one_thread_a_task(spark: SparkSession) -> SparkSession:
    """Numpy in this session's Python workers multiplies in one thread: tasks fill the cores, and waiting threads would spin."""
    spark.sparkContext.environment.setdefault("OPENBLAS_NUM_THREADS", "1")
    return spark


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes df as Parquet to the shared folder and reads it back. The folder goes when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


#: A key with one in HOT rows or more is split over SALTS parts in joins.
HOT, SALTS = 1000, 32


def hot_keys(counts: DataFrame, *keys: str) -> DataFrame:
    """The keys of counts(keys, n) that hold one in HOT rows or more: HOT of them at most, so they may be broadcast."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    return F.broadcast(counts.where(F.col("n") * HOT >= total).select(*keys, F.lit(True).alias("is_hot")))


def salted(rows: DataFrame, hot: DataFrame, by: str, *keys: str) -> DataFrame:
    """rows with column salt: 0, or for a hot key one of SALTS by the hash of column `by`."""
    return rows.join(hot, list(keys), "left").withColumn("salt", F.when(F.col("is_hot"), F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).otherwise(0)).drop("is_hot")


def for_salts(table: DataFrame, hot: DataFrame, *keys: str) -> DataFrame:
    """table, a row per key, with a copy for each salt that its rows can have."""
    salts = F.when(F.col("is_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return table.join(hot, list(keys), "left").withColumn("salt", F.explode(salts)).drop("is_hot")


def remainder(doc_id: str = "doc_id", n: int = 5):
    """crc32 of the id as text, modulo n: the split into training and held-out rows (null id: that of the empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % n


def schema_with(df: DataFrame, **more: str) -> T.StructType:
    """df's schema and further columns; df's own is left as it is."""
    return T.StructType([*df.schema.fields, *(T.StructField(n, T.DataType.fromDDL(k)) for n, k in more.items())])
