"""Search for substrings by an inverted index of character trigrams with their places.

The index lies beside its table:

    path/grams/bucket=B   (gram, key, at): the trigram at each place of a lower-cased text, sorted by trigram
    path/texts            (key, text)

A word of n characters stands at place p of a text exactly if its trigrams at offsets 0, 3, 6, ... and n - 3 stand at p plus their
offsets, since these cover it. So hits are postings whose places agree, counted by aggregation: no text is read, and of the
postings only the buckets of the trigrams looked for, in these only the row groups that hold them. Words of one or two
characters have no trigram; they are looked for in the stored texts.

Words match inside words and regardless of case, as contains(lower(text), lower(word)) does. Null and empty words find nothing, null
and empty texts are not found. Texts of one key count together; a key is found once per word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Letters of a gram, and parts of the postings.
GRAM, BUCKETS = 3, 64


def bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def places(text: Column) -> Column:
    """Each trigram of a text with its place, from 1."""
    starts = F.when(F.length(text) >= GRAM, F.sequence(F.lit(1), F.length(text) - (GRAM - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct(F.substring(text, i, F.lit(GRAM)).alias("gram"), i.alias("at")))


def add(rows: DataFrame, path: str, key: str, text: str) -> None:
    """Adds rows(key, text) to the index at path, which need not exist. A key's earlier texts stay."""
    clean = rows.select(F.col(key).alias("key"), F.lower(F.col(text)).alias("text")).where("text <> ''").distinct()
    clean = clean.withColumn("text_id", F.xxhash64("text"))  # tells the texts of one key apart
    clean.write.mode("append").parquet(f"{path}/texts")
    posted = clean.select("key", "text_id", F.explode(places(F.col("text"))).alias("p")).select(F.col("p.gram").alias("gram"), "key", "text_id", F.col("p.at").alias("at"))
    dealt = posted.withColumn("bucket", bucket(F.col("gram"))).hint("rebalance", "bucket")  # a frequent trigram's bucket is split
    dealt.sortWithinPartitions("bucket", "gram").write.mode("append").partitionBy("bucket").parquet(f"{path}/grams")


def wanted(words: DataFrame, word: str) -> DataFrame:
    """(word, gram, offset, n): the trigrams that cover each word of three characters or more, and how many they are."""
    low, n = F.lower(F.col(word)), F.length(F.col(word))
    offsets = F.array_distinct(F.concat(F.sequence(F.lit(0), n - GRAM, F.lit(GRAM)), F.array(n - GRAM)))
    each = words.where(n >= GRAM).select(F.col(word).alias("word"), low.alias("low"), F.explode(offsets).alias("offset"), F.size(offsets).alias("n")).distinct()
    return each.select("word", F.substring(F.col("low"), F.col("offset") + 1, F.lit(GRAM)).alias("gram"), "offset", "n").withColumn("bucket", bucket(F.col("gram")))


def postings(spark: SparkSession, path: str, grams: DataFrame) -> DataFrame:
    """The postings in the buckets of these grams."""
    buckets = [r[0] for r in grams.select("bucket").distinct().collect()]  # BUCKETS numbers at most
    key = spark.read.parquet(f"{path}/texts").schema["key"].dataType.simpleString()
    return spark.read.schema(f"gram string, key {key}, text_id long, at int, bucket int").parquet(f"{path}/grams").where(F.col("bucket").isin(buckets) if buckets else F.lit(False))


def find(spark: SparkSession, path: str, words: DataFrame, word: str) -> DataFrame:
    """(word, key) of each of words(word) and the keys of the index at path that have a text which holds it."""
    grams = wanted(words, word)
    hits = postings(spark, path, grams).join(grams, ["bucket", "gram"])
    # Places agree if all offsets are there; a set, since a text may have been added twice.
    long = hits.groupBy("word", "key", "text_id", (F.col("at") - F.col("offset")).alias("start"), "n").agg(F.size(F.collect_set("offset")).alias("there")).where("there = n").select("word", "key")
    brief = words.where(F.length(word).between(1, GRAM - 1)).select(F.col(word).alias("word"), F.lower(F.col(word)).alias("part")).distinct()
    if brief.isEmpty():
        return long.distinct()
    pairs = F.transform(F.sequence(F.lit(1), F.length("text")), lambda i: F.substring("text", i, F.lit(GRAM - 1)))
    parts = spark.read.parquet(f"{path}/texts").select("key", F.explode(F.array_distinct(F.concat(F.split("text", ""), pairs))).alias("part"))
    return long.unionByName(parts.join(brief, "part").select("word", "key")).distinct()
