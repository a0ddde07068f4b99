"""Keeping the catalogue: scoped reads, upserts with identities, get-or-create, reparsing, rebuilding and policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgrid.operators.merge import changed
from reelgrid.operators.rank import top_per_key


def scoped(df: DataFrame, tenant: object, column: str = "tenant_id") -> DataFrame:
    """Rows of one tenant; with tables partitioned by tenant, of one folder."""
    return df.where(F.col(column) == F.lit(tenant))


IDENTITY = ["feed_id", "key_type", "key_hash"]


def identified(stored: DataFrame, incoming: DataFrame, joined: bool = False) -> DataFrame:
    """incoming with item_id, a row per item: the stored item with its key; else the newest of its feed that shares a hash (link,
    info, guid); else a new one, whose id follows from its key. Of incoming rows of one item the last counts.

    joined: new rows that share a hash, or each share one with a third, are one item, as if they had come one after the other
    (longer chains of shared hashes stay apart); without it each new key is an item.

    stored(item_id, feed_id, key_type, key_hash, hashes, seen_at, ...) and incoming(feed_id, key_type, key_hash, hashes, seen_at, ...).
    """
    exact = incoming.join(stored.select(*IDENTITY, F.col("item_id").alias("_by_key")), IDENTITY, "left")
    shared = stored.select("feed_id", "item_id", "seen_at", F.explode("hashes").alias("_hash"))
    probe = exact.where("_by_key IS NULL").select(*IDENTITY, F.explode("hashes").alias("_hash")).distinct()
    near = probe.join(shared, ["feed_id", "_hash"]).groupBy(*IDENTITY).agg(F.max_by("item_id", F.struct("seen_at", "item_id")).alias("_by_hash"))
    placed = exact.join(near, IDENTITY, "left")
    own = F.struct("key_type", "key_hash")
    named = placed.withColumn("_first", own)
    if joined:  # called after the least of their keys
        fresh = placed.where("_by_key IS NULL AND _by_hash IS NULL").select("feed_id", own.alias("_own"), F.explode("hashes").alias("_hash")).distinct()
        least = fresh.groupBy("feed_id", "_hash").agg(F.min("_own").alias("_least"))
        first = fresh.join(least, ["feed_id", "_hash"]).groupBy("feed_id", "_own").agg(F.min("_least").alias("_first"))
        ahead = first.select("feed_id", F.col("_own").alias("_first"), F.col("_first").alias("_ahead"))
        first = first.join(ahead, ["feed_id", "_first"], "left").select("feed_id", F.col("_own.key_type").alias("key_type"), F.col("_own.key_hash").alias("key_hash"), F.coalesce("_ahead", "_first").alias("_first"))
        named = placed.join(first, IDENTITY, "left").withColumn("_first", F.coalesce("_first", own))
    made = F.concat_ws(":", F.lit("new"), F.col("feed_id").cast("string"), F.col("_first.key_type"), F.col("_first.key_hash"))
    placed = named.withColumn("item_id", F.coalesce("_by_key", "_by_hash", made)).drop("_by_key", "_by_hash", "_first")
    return top_per_key(placed, ["item_id"], [F.desc("seen_at"), F.asc("key_type"), F.asc("key_hash")])


def ingested(stored: DataFrame, incoming: DataFrame, compared: list[str]) -> DataFrame:
    """The incoming items (identified, joined) as they are to be stored, with outcome: created, changed or unchanged; stored rows that do
    not come are left out."""
    last = identified(stored, incoming, joined=True)
    both = last.alias("n").join(stored.select("item_id", F.lit(True).alias("_there"), *compared).alias("o"), "item_id", "left")
    outcome = F.when(F.col("o._there").isNull(), "created").when(changed("o", "n", compared), "changed").otherwise("unchanged")
    return both.select("item_id", *(F.col(f"n.{c}").alias(c) for c in stored.columns if c != "item_id"), outcome.alias("outcome"))


def upserted(stored: DataFrame, incoming: DataFrame, compared: list[str]) -> DataFrame:
    """All items after an ingest, with outcome: created, changed, unchanged or kept. Their identities: see identified()."""
    both = identified(stored, incoming).alias("n").join(stored.alias("o"), "item_id", "full")
    there, new = F.col("o.feed_id").isNotNull(), F.col("n.feed_id").isNotNull()
    outcome = F.when(new & ~there, "created").when(new & changed("o", "n", compared), "changed").when(new, "unchanged").otherwise("kept")
    columns = [c for c in stored.columns if c != "item_id"]
    return both.select("item_id", *(F.when(new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in columns), outcome.alias("outcome"))


def conflicts(read: DataFrame, current: DataFrame, key: str, compared: list[str]) -> DataFrame:
    """Rows whose compared fields changed between the read and now, or that are gone: their writes must stop."""
    digest = lambda df: df.select(key, F.sha2(F.to_json(F.struct(*compared), {"ignoreNullFields": "false"}), 256).alias("digest"))
    return read.select(key).join(digest(read).join(digest(current), [key, "digest"]).select(key), key, "left_anti")


def get_or_create(titles: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted(media_type, title_key, year) with media_id and created: the oldest known title of that type and key with the year,
    or without one; else a new id that follows from the three (nulls equal)."""
    keys = ["media_type", "title_key"]
    row = F.struct("created_at", "media_id")
    by_year = titles.groupBy(*keys, "year").agg(F.min(row).alias("known"))
    with_year = wanted.alias("w").join(by_year.alias("t"), (F.col("w.media_type") == F.col("t.media_type")) & (F.col("w.title_key") == F.col("t.title_key")) & F.col("w.year").eqNullSafe(F.col("t.year")), "left").select("w.*", F.col("t.known").alias("known"))
    yearless = titles.where("year IS NULL").groupBy(*keys).agg(F.min(row).alias("open"))
    found = F.least("known", "open").media_id
    made = F.sha2(F.concat_ws("|", "media_type", "title_key", F.coalesce(F.col("year").cast("string"), F.lit("-"))), 256)
    return with_year.join(yearless, keys, "left").select(*wanted.columns, F.coalesce(found.cast("string"), made).alias("media_id"), found.isNull().alias("created"))


def policy_problems(rows: DataFrame, supported: dict[str, list[str]]) -> DataFrame:
    """(tenant_id, media_type, problem) of policy sets that may not replace the stored ones: unknown or unsuitable sources,
    repeated sources, and equal priorities of enabled ones."""
    pairs = F.array(*(F.lit(f"{s}|{m}") for s, ms in supported.items() for m in ms))
    key = ["tenant_id", "media_type"]
    unfit = rows.where(~F.array_contains(pairs, F.concat_ws("|", "source", "media_type"))).select(*key, F.lit("unsupported source").alias("problem"))
    twice = rows.groupBy(*key, "source").count().where("count > 1").select(*key, F.lit("duplicate source").alias("problem"))
    equal = rows.where("enabled").groupBy(*key, "priority").agg(F.count_distinct("source").alias("n")).where("n > 1").select(*key, F.lit("duplicate priority").alias("problem"))
    return unfit.union(twice).union(equal).distinct()


def replaced_policies(stored: DataFrame, new: DataFrame, supported: dict[str, list[str]]) -> DataFrame:
    """Stored policies with each tenant's and type's set replaced by its new one, unless that has a problem."""
    key = ["tenant_id", "media_type"]
    good = new.join(policy_problems(new, supported).select(*key).distinct(), key, "left_anti")
    return stored.join(good.select(*key).distinct(), key, "left_anti").unionByName(good)


def reparsed(stored: DataFrame, fresh: DataFrame, key: str, compared: list[str]) -> DataFrame:
    """Fresh parses of the rows that changed: these are to be written, and their matches invalidated."""
    both = fresh.alias("n").join(stored.alias("o"), key)
    return both.where(changed("o", "n", compared)).select(key, *(F.col(f"n.{c}").alias(c) for c in compared))


def invalidated(matches: DataFrame, touched: DataFrame, key: str, at: Column, why: str) -> DataFrame:
    """Matches with the active ones of touched rows invalidated."""
    hit = touched.select(key).distinct().withColumn("_hit", F.lit(True))
    now = F.col("_hit").isNotNull() & F.col("invalidated_at").isNull()
    return matches.join(hit, key, "left").withColumns({"stale_reason": F.when(now, F.lit(why)).otherwise(F.col("stale_reason")), "invalidated_at": F.when(now, at).otherwise(F.col("invalidated_at"))}).drop("_hit")
