"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

Word, symbol, line and repetition figures of a text come from built-in array functions. Rules are
ratios of these figures. For each stratum (language) and rule, cutoffs from lenient to strict are
tested on labelled good rows: the next cutoff is taken only while the exact binomial tail
P(X <= wrongly rejected | n, ALPHA / rules) is at most DELTA / (strata * rules). Testing in fixed
order needs no further correction within a rule, and Bonferroni's covers strata and rules, so with
probability 1 - DELTA all rules together reject at most the share ALPHA of good rows of every
stratum. Equal labelled texts of a stratum are one trial. Where labels are too few for that, the
rule rejects nothing there.

Null and empty texts have zero in all figures and fail the base rule (fewer than 50 words). Rows
with a null stratum form one of their own. Repeated rows are judged alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelgrid.llm.tables import documents, labels, written

WORD = r"[^\x20\x09-\x0D]"
SYMBOL = "[#*$%&|<>]"
ALPHA, DELTA = 0.02, 0.05
#: Per rule: the figure, and cutoffs in thousandths from lenient to strict (a row at or above is rejected).
RULES = {
    "symbols": [2000, 1000, 500, 300, 200, 150, 100, 70, 50, 30],
    "shouting": [2000, 1000, 700, 500, 300, 200, 150, 100, 70, 50],
    "repeats": [450, 400, 300, 250, 200, 150, 120, 100],
    "dup_lines": [900, 700, 500, 400, 300, 200],
}


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def figures(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_loud and n_lines.

    Repeated windows of three words: pairs of 64-bit hash and position; sorted, equal windows stand
    side by side. A covered word counts once: of each repeated window the part
    before the next one.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    n = F.size("words")
    at = F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    df = docs.withColumns({"words": words(t), "lines": F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))})
    df = df.withColumns({
        "n_words": n.cast("long"),
        "word_chars": F.length(F.array_join("words", "")).cast("long"),
        "windows": F.transform(at, lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2))),
    })
    some = F.size(F.array_distinct("windows")) < F.size("windows")  # most texts repeat none
    df = df.withColumn("placed", F.when(some, F.sort_array(F.transform("windows", lambda x, i: F.struct(x.alias("h"), i.cast("long").alias("p"))))))
    same = F.filter("placed", lambda x, i: (x.h == F.get("placed", i - 1).h) | (x.h == F.get("placed", i + 1).h))
    df = df.withColumn("again", F.sort_array(F.transform(same, lambda x: x.p)))
    gaps = F.transform("again", lambda x, i: F.least(F.lit(3).cast("long"), F.coalesce(F.get("again", i + 1) - x, F.lit(3))))
    return df.withColumns({
        "n_symbols": F.regexp_count(t, F.lit(SYMBOL)).cast("long"),
        "n_loud": F.regexp_count(t, F.lit("!")).cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "n_lines": F.size("lines").cast("long"),
        "n_repeat_words": F.coalesce(F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0)).cast("long"),
    }).drop("words", "windows", "placed", "again", "lines")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def ratios() -> dict[str, Column]:
    """Thousandths, rounded down, of each rule's figure; null where there is nothing to divide by."""
    by = lambda a, b: F.floor(1000 * F.col(a) / F.nullif(F.col(b), F.lit(0)))
    return {"symbols": by("n_symbols", "n_words"), "shouting": by("n_loud", "n_words"), "repeats": by("n_repeat_words", "n_words"), "dup_lines": by("n_dup_lines", "n_lines")}


def tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) of a binomial of n trials: terms by their ratios, in logarithms so that none vanishes early."""
    step = lambda i: F.log((n - i + 1) / i) + F.log(F.lit(p / (1 - p)))
    start = F.struct((n * F.log(F.lit(1 - p))).alias("term"), F.exp(n * F.log(F.lit(1 - p))).alias("sum"))
    over = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(over, start, lambda a, i: F.struct((a.term + step(i)).alias("term"), (a.sum + F.exp(a.term + step(i))).alias("sum")), lambda a: F.least(a.sum, F.lit(1.0)))


def cutoffs(good: DataFrame, stratum: str, rules: dict[str, list[int]] = RULES, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, one column per rule with its cutoff or null) from labelled good rows with the rules' columns.

    One row per stratum: labelled rows are counted per cutoff in one aggregation.
    """
    counts = [F.count_if(F.col(r) >= c).alias(f"{r}_{c}") for r, cs in rules.items() for c in cs]
    by = good.groupBy(F.col(stratum).alias("stratum")).agg(F.count("*").alias("n"), *counts)
    by = by.withColumn("strata", F.count("*").over(Window.partitionBy(F.lit(1))))  # over the few rows of strata
    limit, alpha = F.lit(delta) / (F.col("strata") * len(rules)), alpha / len(rules)
    out = []
    for r, cs in rules.items():
        # Above the mean the tail is never small, so long sums are not needed there.
        passed = lambda c: (F.col(f"{r}_{c}") <= F.col("n") * alpha) & (tail(F.least(F.col(f"{r}_{c}"), F.floor(F.col("n") * alpha).cast("long")), F.col("n"), alpha) <= limit)  # noqa: B023, E731
        taken = F.array(*(F.when(passed(c), F.lit(c)) for c in cs))
        until = F.aggregate(taken, F.struct(F.lit(None).cast("int").alias("cut"), F.lit(True).alias("go")), lambda a, x: F.struct(F.when(a.go & x.isNotNull(), x).otherwise(a.cut).alias("cut"), (a.go & x.isNotNull()).alias("go")), lambda a: a.cut)
        out.append(until.alias(f"{r}_cut"))
    return by.select("stratum", *out)


def judged(docs: DataFrame, labelled: DataFrame, stratum: str = "lang", text: str = "text") -> DataFrame:
    """docs, without the text, with figures, base_failed and kept. labelled(doc_id, quality): good rows have quality 1.

    Figures are written once; labels are joined to them, so no text is shuffled.
    """
    measured = written(figures(docs.withColumn("text_key", F.xxhash64(text)), text).drop(text).withColumn("base_failed", base_failed()).withColumns(ratios()), "figures")
    good = measured.where(~F.col("base_failed")).join(labelled.where("quality = 1").select("doc_id").distinct(), "doc_id", "left_semi").dropDuplicates([stratum, "text_key"])
    cut = written(cutoffs(good, stratum), "cutoffs")  # a row per stratum: broadcast while small, by Spark's own threshold
    hit = F.lit(False)
    for r in RULES:
        hit = hit | F.coalesce(F.col(r) >= F.col(f"{r}_cut"), F.lit(False))
    return measured.join(cut, F.col(stratum).eqNullSafe(F.col("stratum")), "left").withColumn("kept", ~F.col("base_failed") & ~hit).drop("stratum", "text_key")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's figures, the base rule and the verdict of the risk-controlled cutoffs."""
    out = judged(documents(spark, sf_dir).select("doc_id", "text", "lang"), labels(spark, sf_dir))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES = {"op5_quality_rules": op5_quality_rules}
ORACLES: dict[str, str] = {}
