"""Acquisition of content units: keys, scores, and the ordered fold of decisions, in windows.

The fold needs no group in memory. An entry of a feed that its unit has not seen is a cross-seed if
allowed (but for the unit's first entry, which satisfies it) and leaves the held quality alone, so
what is held before an entry is the running maximum over the other entries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelgrid.functions.text import padded
from reelgrid.sources.tables import kept


def unit_key(media_type: Column, title_id: Column, season: Column, episode: Column, episode_end: Column, special: Column, variant: Column, part: Column) -> Column:
    """movie:ID, tv:ID:sNN:season, tv:ID:sNN:eNN[-eMM][:variant:V][:part:P] or tv:ID:sNN:sp:N; null if none applies."""
    base = F.concat(F.lit("tv:"), title_id.cast("string"), F.lit(":s"), padded(season))
    last = F.when(episode_end > episode, F.concat(F.lit("-e"), padded(episode_end))).otherwise("")
    canonical = F.coalesce(part.try_cast("long").cast("string"), F.upper(part))
    more = F.concat(F.coalesce(F.concat(F.lit(":variant:"), F.upper(variant)), F.lit("")), F.coalesce(F.concat(F.lit(":part:"), canonical), F.lit("")))
    tv = F.when(season.isNull(), None).when(special.isNotNull(), F.concat(base, F.lit(":sp:"), special.cast("string"))).when(episode.isNull(), F.concat(base, F.lit(":season"))).otherwise(F.concat(base, F.lit(":e"), padded(episode), last, more))
    return F.when(media_type == "MOVIE", F.concat(F.lit("movie:"), title_id.cast("string"))).when(media_type == "TV_SERIES", tv)


def fold(entries: DataFrame, key: list[str], order: list[Column], feed: str, resolution: str, rank: str, cross_seed: str, upgrade: str) -> DataFrame:
    """entries with action (SATISFY, CROSS_SEED, UPGRADE, REJECT) and the quality held after each."""
    seen = Window.partitionBy(*key, feed).orderBy(*order)
    line = Window.partitionBy(*key).orderBy(*order)
    past = line.rowsBetween(Window.unboundedPreceding, -1)
    quality = F.struct(F.coalesce(resolution, F.lit(-1)).alias("resolution"), F.coalesce(rank, F.lit(-1)).alias("rank"))
    one = entries.withColumns({"_first": F.row_number().over(line) == 1, "_new_feed": F.row_number().over(seen) == 1})
    # Rows whose quality the state may take: the first, and those that are no cross-seed and may upgrade.
    two = one.withColumn("_seeds", ~F.col("_first") & F.col(cross_seed) & F.col("_new_feed")).withColumn("_counts", F.col("_first") | (~F.col("_seeds") & F.col(upgrade)))
    three = two.withColumn("_held", F.max(F.when(F.col("_counts"), quality)).over(past))
    better = F.col("_counts") & (quality > F.col("_held"))
    action = F.when(F.col("_first"), "SATISFY").when(F.col("_seeds"), "CROSS_SEED").when(better, "UPGRADE").otherwise("REJECT")
    held = F.when(action.isin("SATISFY", "UPGRADE"), quality).otherwise(F.col("_held"))
    return three.withColumns({"action": action, "held_resolution": held.resolution, "held_rank": held.rank}).drop("_first", "_new_feed", "_seeds", "_counts", "_held")


def fold_in_ranges(entries: DataFrame, key: list[str], order: list[str], feed: str, resolution: str, rank: str, cross_seed: str, upgrade: str, ranges: int | None = None) -> DataFrame:
    """fold() for units of any size: the same result, in tasks that hold about a task's share of the entries at most.

    Units of more than a share (fewer than `ranges`) are folded in ranges; the others are dealt by hash and sorted once.
    order: columns, all ascending, that tell a unit's entries apart.
    """
    spark = entries.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    of_unit = kept(entries.groupBy(*key).agg(F.count("*").alias("_n")), "units")
    share = (of_unit.agg(F.sum("_n")).first()[0] or 0) / ranges
    large = kept(of_unit.where(F.col("_n") > share).select(*(F.col(k).alias(f"_{k}_") for k in key)), "large-units")
    same = _all([F.col(k).eqNullSafe(F.col(f"_{k}_")) for k in key])
    small = entries.join(F.broadcast(large), same, "left_anti").repartition(ranges, *key)
    folded = fold(small, key, [F.asc(c) for c in order], feed, resolution, rank, cross_seed, upgrade)
    if large.isEmpty():
        return folded
    return folded.unionByName(_folded_ranges(entries.join(F.broadcast(large), same, "left_semi"), key, order, feed, resolution, rank, cross_seed, upgrade, ranges))


def _folded_ranges(entries: DataFrame, key: list[str], order: list[str], feed: str, resolution: str, rank: str, cross_seed: str, upgrade: str, ranges: int) -> DataFrame:
    """fold() of units that are large: no task holds more than a range of a unit's entries.

    What a run of entries does to the held quality is a maximum, which composes: entries are sorted into ranges, each range has
    its greatest counted quality, a unit's ranges (a row each) give what is held before each of them, and within a range the
    running maximum goes on from there. Whether a feed or a unit is new is told by its least place, an aggregate; entries with equal
    `order` are taken as one place.
    """
    place = F.struct(*order)
    of_feed = entries.groupBy(*key, feed).agg(F.min(place).alias("_place"))
    of_unit = of_feed.groupBy(*key).agg(F.min("_place").alias("_place"))
    both = of_feed.alias("f").join(of_unit.alias("u"), _all([F.col(f"f.{k}").eqNullSafe(F.col(f"u.{k}")) for k in key]))
    new = both.select(*(F.col(f"f.{k}").alias(f"_{k}_") for k in [*key, feed]), F.col("f._place").alias("_place"), (F.col("f._place") == F.col("u._place")).alias("_first"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}_")) for k in [*key, feed]] + [F.col(c).eqNullSafe(F.col(f"_place.{c}")) for c in order]
    one = entries.join(new, _all(same), "left").withColumns({"_new_feed": F.col("_place").isNotNull(), "_first": F.coalesce("_first", F.lit(False))}).drop("_place", *(f"_{k}_" for k in [*key, feed]))
    quality = F.struct(F.coalesce(resolution, F.lit(-1)).alias("resolution"), F.coalesce(rank, F.lit(-1)).alias("rank"))
    two = one.withColumn("_seeds", ~F.col("_first") & F.col(cross_seed) & F.col("_new_feed")).withColumn("_counted", F.when(F.col("_first") | (~F.col("_seeds") & F.col(upgrade)), quality))
    # The range is written down, so what follows does not hang on how often Spark samples.
    three = kept(two.repartitionByRange(ranges, *key, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    of_range = three.groupBy(*key, "_range").agg(F.max("_counted").alias("_most"))
    before = Window.partitionBy(*key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carry = of_range.withColumn("_carry", F.max("_most").over(before)).select(*(F.col(k).alias(f"_{k}_") for k in key), F.col("_range").alias("_of"), "_carry")
    carry = carry.where("_carry IS NOT NULL")  # only units that go over a range's border have one
    four = three.join(carry, _all([F.col(k).eqNullSafe(F.col(f"_{k}_")) for k in key] + [F.col("_range") == F.col("_of")]), "left").drop("_of", *(f"_{k}_" for k in key))
    line = Window.partitionBy("_range", *key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    five = four.repartitionById(ranges, F.col("_range")).withColumn("_held", F.max("_counted").over(line))
    five = five.withColumn("_held", F.greatest("_held", "_carry"))
    better = F.col("_counted").isNotNull() & (quality > F.col("_held"))
    action = F.when(F.col("_first"), "SATISFY").when(F.col("_seeds"), "CROSS_SEED").when(better, "UPGRADE").otherwise("REJECT")
    held = F.when(action.isin("SATISFY", "UPGRADE"), quality).otherwise(F.col("_held"))
    return five.withColumns({"action": action, "held_resolution": held.resolution, "held_rank": held.rank}).drop("_first", "_new_feed", "_seeds", "_counted", "_held", "_carry", "_range")


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out
