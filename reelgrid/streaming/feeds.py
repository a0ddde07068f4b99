"""Streaming ingestion: files as they land, entries once, windows, acquisition and the refresh of feeds in micro-batches.

Streams read with a bounded number of files a trigger and keep their progress and state in a folder that the caller
names, so a restart goes on where it stopped. State is kept in RocksDB, with its changes checkpointed, so a batch
costs its own keys. Sinks write each batch to its own folder and overwrite it on a retry, which makes them exactly-once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgrid.functions import release
from reelgrid.functions.titles import title_info
from reelgrid.operators.catalogue import ingested
from reelgrid.operators.rank import top_per_key
from reelgrid.sources import feeds as source
from reelgrid.sources.tables import scratch_folder
from reelgrid.streaming import acquisition
from reelgrid.sources.store import Store

# Fixed names: where Spark keeps the state of streams, and that it checkpoints what changed.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def stream_of(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    """A stream of a Parquet table's files; path may be a folder or one file, and no sibling of it is read."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():  # the path only; no file is opened here
        return reader.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())
    return reader.parquet(path)


def drained(stream: DataFrame, name: str, mode: str = "append", each=None, keys: list[str] | None = None, home: str | None = None) -> DataFrame:
    """Runs a stream over all files there are and reads back what it wrote; each(batch, n, home) changes a batch first.

    home holds the stream's progress, state and output: with the same home a later run goes on where this one stopped, and the
    result is that of all runs. Without one the stream lives in a folder of its own, called after `name`, that goes when the
    application ends. In update mode each batch writes the rows that changed; of rows with equal keys those of the last batch count.
    """
    spark = stream.sparkSession
    home = home.rstrip("/") if home else scratch_folder(spark, name)

    def put(batch: DataFrame, n: int):
        out = each(batch, n, home) if each else batch
        out.write.mode("overwrite").parquet(f"{home}/out/batch={n}")

    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:  # a query takes its settings when it starts
        run = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{home}/progress").trigger(availableNow=True).foreachBatch(put).start()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    run.awaitTermination()
    out = spark.read.parquet(f"{home}/out")
    if mode == "update":
        out = top_per_key(out, keys, [F.desc("batch")])
    return out.drop("batch")


def unique(entries: DataFrame, keys: list[str]) -> DataFrame:
    """Entries once per key, whatever their age: the state store holds all keys seen, dealt by hash, and grows with them."""
    return entries.dropDuplicates(keys)


def windows(size: str, slide: str | None = None, time: str = "at") -> Callable[[DataFrame, int, str], DataFrame]:
    """For drained(): counts (start, n) of the windows that a batch touches, over all batches so far.

    Each batch's counts are stored by window and added up outside Spark's own state, so there is no watermark: an entry of any
    age corrects its window. Stored counts are folded to a row per window as they grow. Entries without a time have no window.
    """

    def each(batch: DataFrame, n: int, home: str) -> DataFrame:
        w = F.window(time, size, slide) if slide else F.window(time, size)
        total = lambda rows: rows.groupBy("start").agg(F.sum("n").alias("n"))
        store = Store(batch.sparkSession, f"{home}/windows", "start timestamp, n long", "start", total, buckets=16)
        store.add(batch.groupBy(w.alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n"), n)
        touched = store.touched(n)
        store.compact(n, touched)
        return store.read(n + 1, touched).join(store.changes(n).select("start"), "start", "left_semi")

    return each


def acquired(entries: DataFrame, settled: float | None = None) -> DataFrame:
    """The decisions of a stream of (key, at, entry_id, feed, resolution) in update mode, with each key's state carried from batch
    to batch in the order of `at` whatever the order of the files; see streaming/acquisition.py. rank, cross_seed and upgrade
    may be columns of their own; without them there are no ranks, no cross-seeds, and upgrades are allowed."""
    plain = {"rank": F.lit(0), "cross_seed": F.lit(False), "upgrade": F.lit(True)}
    return acquisition.decisions(entries.withColumns({k: v for k, v in plain.items() if k not in entries.columns}), settled)


#: Parts of the stored items by feed; a batch reads only those of its feeds.
BUCKETS = 16
#: What makes a stored item changed: the parsed attributes, the list of search titles in its order.
COMPARED = [
    "title", "search_titles", "year", "media_type", "tv_unit_type", "season", "episode", "episode_end", "special_number", "episode_part",
    "resolution", "quality", "source", "codec", "audio", "release_group", "variant", "confidence",
]
ITEM = (
    "item_id string, feed_id long, key_type string, key_hash string, hashes array<string>, seen_at long, raw_title string, size_bytes long, title string, search_titles array<string>, year int, "
    "media_type string, tv_unit_type string, season int, episode int, episode_end int, special_number int, episode_part string, resolution int, quality string, source string, codec string, audio string, "
    "release_group string, variant string, confidence int"
)


#: What becomes of items to be matched, and what is known of a feed.
WORK = "item_id string, feed_id long, raw_title string, at long, status string, candidate string"
FEED = "feed_id long, polls long, last_polled long, next_attempt long, created long, changed long, unchanged long, skipped long, claimed long"
#: Items of a feed that a refresh claims for matching; later refreshes of the feed claim the rest.
CLAIMED = 50


def keyed(parsed: DataFrame) -> DataFrame:
    """Parsed items with their key (info hash, else signature, else link) and the hashes by which others may be the same item."""
    sha = lambda c: F.sha2(c, 256)
    kind = lambda t, v: F.when(v.isNotNull(), F.struct(F.lit(t).alias("type"), sha(v).alias("hash")))
    key = F.coalesce(kind("INFO_HASH", F.col("info_hash")), kind("RELEASE_SIGNATURE", release.signature(F.col("size_bytes"))), kind("LINK_HASH", F.col("torrent_url")))
    found = F.array_compact(F.array(sha(F.col("torrent_url")), sha(F.col("info_hash")), sha(F.col("guid"))))
    search = title_info("head", "raw_title", "title")["search"]
    known = parsed.withColumns({"key": key, "search_titles": search})
    return known.select("feed_id", F.col("key.type").alias("key_type"), F.col("key.hash").alias("key_hash"), found.alias("hashes"), "seen_at", "raw_title", "size_bytes", *COMPARED)


def stores(spark: SparkSession, home: str) -> dict[str, Store]:
    """The tables that refreshes keep: items, work (what is to be matched, and was) and feeds."""
    latest = lambda *keys: lambda rows: top_per_key(rows, list(keys), [F.desc("batch")])
    sums = ["polls", "created", "changed", "unchanged", "skipped", "claimed"]
    feed = lambda rows: rows.groupBy("feed_id").agg(*(F.sum(c).alias(c) for c in sums), *(F.max_by(c, "batch").alias(c) for c in ("last_polled", "next_attempt")))
    return {
        "items": Store(spark, f"{home}/items", ITEM, "feed_id", latest("feed_id", "item_id"), BUCKETS),
        "work": Store(spark, f"{home}/work", WORK, "feed_id", latest("feed_id", "item_id"), BUCKETS),
        "feeds": Store(spark, f"{home}/feeds", FEED, "feed_id", feed, BUCKETS),
    }


def once(df: DataFrame, path: str) -> DataFrame:
    """df, computed once: written over what an earlier attempt left, and read back."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def refreshed(batch: DataFrame, n: int, home: str, interval: int = 300, claims: int = CLAIMED, match: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """A refresh of feeds as one micro-batch of raw items (with feed_id and seen_at): normalised, parsed, merged into the stored
    items of their feeds, rescheduled, claimed and matched; returns what happened to each item that came.

    New and changed items are queued for matching; what an earlier match said of a changed item is void. Of each feed that came
    the `claims` items queued longest are claimed, and match(items with item_id) -> (item_id, candidate) says what they are:
    those it does not name are unmatched. Without `match` they stay claimed. A feed's next attempt is `interval` seconds (of
    seen_at) from its last item, also if all its items were skipped. An item whose feed_id is null is skipped with its feed.
    """
    spark = batch.sparkSession
    store = stores(spark, home)
    # Parsing costs more than moving a row: a batch that came in few files is dealt out first.
    dealt = batch.where("feed_id IS NOT NULL").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    raw = once(source.normalised(dealt, ["feed_id", "seen_at"]), f"{home}/step/raw")
    incoming = once(keyed(release.parse(raw.where("skip_reason IS NULL"), "raw_title")), f"{home}/step/parsed")
    buckets = store["items"].buckets_of(raw)  # of all three tables, which have the same key
    for s in store.values():
        s.compact(n, buckets)
    stored = store["items"].read(n, buckets)
    merged = once(ingested(stored, incoming, COMPARED), f"{home}/step/merged")
    store["items"].add(merged, n)
    opened = merged.where("outcome <> 'unchanged'").select("item_id", "feed_id", "raw_title", F.col("seen_at").alias("at"), F.lit("queued").alias("status"), F.lit(None).cast("string").alias("candidate"))
    # An item that still waits keeps its place in the queue.
    waiting = store["work"].read(n, buckets).where("status = 'queued'")
    both = opened.withColumn("new", F.lit(1)).unionByName(waiting.withColumn("new", F.lit(0)))
    queue = both.groupBy("item_id", "feed_id").agg(F.max_by("raw_title", "new").alias("raw_title"), F.min("at").alias("at"), F.max("new").alias("new"))
    came = raw.select("feed_id").distinct()
    first = top_per_key(queue.join(came, "feed_id", "left_semi"), ["feed_id"], [F.asc("at"), F.asc("item_id")], claims).select("item_id", F.lit(True).alias("mine"))
    queue = queue.join(first, "item_id", "left").withColumn("status", F.when(F.col("mine"), "claimed").otherwise("queued"))
    work = once(queue.where("new = 1 OR mine").select("item_id", "feed_id", "raw_title", "at", "status", F.lit(None).cast("string").alias("candidate")), f"{home}/step/claimed")
    if match:
        mine = work.where("status = 'claimed'").select("item_id", "feed_id").join(store["items"].read(n + 1, buckets), ["feed_id", "item_id"])
        found = match(mine).select("item_id", F.col("candidate").cast("string").alias("found"))
        known = work.join(found, "item_id", "left")
        status = F.when(F.col("status") == "queued", F.col("status")).when(F.col("found").isNotNull(), "matched").otherwise("unmatched")
        work = once(known.select("item_id", "feed_id", "raw_title", "at", status.alias("status"), F.col("found").alias("candidate")), f"{home}/step/matched")
    store["work"].add(work, n)
    count = lambda c: F.count(F.when(c, 1))
    of_raw = raw.groupBy("feed_id").agg(F.lit(1).cast("long").alias("polls"), F.max("seen_at").alias("last_polled"), (F.max("seen_at") + F.lit(interval)).alias("next_attempt"), count(F.col("skip_reason").isNotNull()).alias("skipped"))
    of_items = merged.groupBy("feed_id").agg(*(count(F.col("outcome") == o).alias(o) for o in ("created", "changed", "unchanged")))
    of_work = work.groupBy("feed_id").agg(count(F.col("status") != "queued").alias("claimed"))
    store["feeds"].add(of_raw.join(of_items, "feed_id", "left").join(of_work, "feed_id", "left").na.fill(0, ["created", "changed", "unchanged", "claimed"]), n)
    return merged.select("feed_id", "item_id", "raw_title", "outcome")
