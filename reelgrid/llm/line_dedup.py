"""Cross-site boilerplate lines: HyperLogLog sketches per line hash, exact counts near the thresholds.

A line (split at \\n, with a character other than white space) is boilerplate if it stands on at
least MIN_SITES distinct sites and in as many distinct texts: copies of a document count as one, so
they keep their own lines for document deduplication.

1. Lines are counted by hash (128 bits); lines with fewer occurrences than MIN_SITES are settled.
2. For the rest, sketches of sites and of texts merge by aggregation, partly before the shuffle. A
   line with a thousandth of all occurrences or more is split by document before it is joined.
3. Lines whose estimates are clear are settled; those near a threshold get exact distinct counts.
4. Documents get the hashes of their own boilerplate lines by a join on doc_id and drop them.

Only DataFrame functions are used. Null text counts as empty and null sources as one site; a
document keeps its row even if no line is left. Rows that repeat a doc_id are cleaned alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgrid.llm.tables import documents, for_salts, hot_keys, salted, written

MIN_SITES = 6
#: 4096 registers: a relative standard error under 2 %; estimates within BAND (over five of these) of a threshold are counted exactly.
REGISTERS_LOG2, BAND = 12, 0.1


def first_hash(line: Column) -> Column:
    return F.xxhash64(line)


def second_hash(line: Column) -> Column:
    return F.xxhash64(F.lit(1), line)


def lines(docs: DataFrame, text: str, site: str) -> DataFrame:
    """(doc_id, h, g, site, whole) of every line with a word; hashes stand for lines and whole texts."""
    whole = F.coalesce(F.col(text), F.lit(""))
    split = docs.select("doc_id", F.xxhash64(F.coalesce(F.col(site), F.lit(""))).alias("site"), F.xxhash64(whole).alias("whole"), F.explode(F.split(whole, "\n")).alias("line"))
    return split.where(F.col("line").rlike(r"[^\x20\x09-\x0D]")).select("doc_id", first_hash(F.col("line")).alias("h"), second_hash(F.col("line")).alias("g"), "site", "whole")


def boilerplate(every: DataFrame, often: DataFrame, hot: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(h, g) of boilerplate lines among those of often(h, g, n)."""
    rows = salted(every, hot, "doc_id", "h", "g").join(for_salts(often.select("h", "g"), hot, "h", "g"), ["h", "g", "salt"])
    rows = written(rows.select("h", "g", "site", "whole"), "lines")
    sketch = lambda c: F.hll_sketch_estimate(F.hll_sketch_agg(c, F.lit(REGISTERS_LOG2)))
    about = rows.groupBy("h", "g").agg(sketch("site").alias("sites"), sketch("whole").alias("texts"))
    least = F.least("sites", "texts")
    clear = F.when(least >= min_sites * (1 + BAND) + 1, True).when(least < min_sites * (1 - BAND) - 1, False)
    about = written(about.select("h", "g", clear.alias("is")), "estimates")
    # Each count is of its own distinct rows.
    unsure = rows.join(about.where(F.col("is").isNull()).select("h", "g"), ["h", "g"], "left_semi")
    exact = unsure.groupBy("h", "g").agg(F.count_distinct("site").alias("sites"), F.count_distinct("whole").alias("texts")).where(least >= min_sites)
    return about.where("is").select("h", "g").union(exact.select("h", "g"))


def without_boilerplate(docs: DataFrame, text: str = "text", site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """docs with boilerplate lines taken out of the text, and columns n_lines, n_removed_lines."""
    every = lines(docs, text, site)
    often = written(every.groupBy("h", "g").agg(F.count("*").alias("n")).where(F.col("n") >= min_sites), "often")
    hot = hot_keys(often, "h", "g")
    found = written(boilerplate(every, often, hot, min_sites), "boilerplate")
    own = salted(every.select("doc_id", "h", "g"), hot, "doc_id", "h", "g").join(for_salts(found, hot, "h", "g"), ["h", "g", "salt"])
    own = own.groupBy("doc_id").agg(F.collect_set(F.struct("h", "g")).alias("own_boilerplate")).withColumnRenamed("doc_id", "own_doc_id")
    joined = docs.drop("n_lines", "n_removed_lines").join(own, F.col("doc_id").eqNullSafe(F.col("own_doc_id")), "left").drop("own_doc_id")
    split = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    kept = F.filter(split, lambda x: ~F.array_contains("own_boilerplate", F.struct(first_hash(x).alias("h"), second_hash(x).alias("g"))))
    left = joined.withColumn("left_lines", F.when(F.col("own_boilerplate").isNull(), split).otherwise(kept)).withColumn("n_lines", F.size(split).cast("long"))
    left = left.withColumn("n_removed_lines", F.col("n_lines") - F.size("left_lines"))
    return left.withColumn(text, F.when(F.col("own_boilerplate").isNull(), F.col(text)).otherwise(F.array_join("left_lines", "\n"))).drop("left_lines", "own_boilerplate")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's lines, boilerplate lines taken out, and a digest of what is left."""
    out = without_boilerplate(documents(spark, sf_dir).select("doc_id", "text", "source"))
    return out.select("doc_id", "n_lines", "n_removed_lines", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


SQL = f"""
WITH split AS (SELECT doc_id, coalesce(source, '') AS site, coalesce(text, '') AS whole, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
line AS (SELECT doc_id, site, whole, unnest(ls) AS line, unnest(range(len(ls))) AS p FROM split),
bad AS (SELECT line FROM line WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY line
    HAVING count(DISTINCT site) >= {MIN_SITES} AND count(DISTINCT whole) >= {MIN_SITES}),
marked AS (SELECT c.doc_id, c.line, c.p, b.line IS NOT NULL AS bad FROM line c LEFT JOIN bad b ON c.line = b.line)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (bad) AS n_removed_lines,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT bad), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
QUERIES = {"op9_line_dedup": op9_line_dedup}
ORACLES = {"op9_line_dedup": SQL}
