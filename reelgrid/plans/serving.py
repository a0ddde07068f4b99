"""Serving queries: trending, timelines, heat, ranked rows, lists, searches and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelgrid.operators.merge import ledger, may_change, merge_keyed
from reelgrid.operators.rank import after, joined_set, latest, top_per_key
from reelgrid.sources.tables import feeds, items, jobs, matches, media, oracle, table

NOW, SINCE = "2001-06-30 00:00:00", "2001-04-01 00:00:00"
QUERIES, ORACLES = {}, {}


def query(sql: str | None = None, name: str | None = None):
    def put(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return put


def trending_groups(spark: SparkSession, d: str) -> DataFrame:
    """Per media title: matched releases first seen in the window, with what their feeds and releases hold."""
    seen = items(spark, d).where(F.col("first_seen").between(F.lit(SINCE).cast("timestamp"), F.lit(NOW).cast("timestamp")))
    active = matches(spark, d).where("status = 'MATCHED' AND NOT invalidated")
    base = seen.join(active, "release_id").join(feeds(spark, d), "feed_id", "left")
    groups = base.groupBy("media_id").agg(
        F.count("*").alias("release_count"), F.max("first_seen").alias("latest_release_at"), F.count_distinct("feed_id").alias("feed_count"),
        joined_set("feed_name", 6).alias("feeds"), joined_set("quality", 8).alias("qualities"), joined_set("release_group", 8).alias("release_groups"),
        latest(F.col("metadata_id"), "matched_at", "updated_at", "metadata_id").alias("metadata_id"),
    )
    return groups.join(media(spark, d).select("media_id", "title", "media_type"), "media_id")


TRENDING = f"""groups AS (SELECT media_id, count(*) AS release_count, max(first_seen) AS latest_release_at, count(DISTINCT feed_id) AS feed_count,
    coalesce(array_to_string(list_slice(list_sort(list(DISTINCT feed_name) FILTER (feed_name IS NOT NULL)), 1, 6), '|'), '') AS feeds,
    coalesce(array_to_string(list_slice(list_sort(list(DISTINCT quality) FILTER (quality IS NOT NULL)), 1, 8), '|'), '') AS qualities,
    coalesce(array_to_string(list_slice(list_sort(list(DISTINCT release_group) FILTER (release_group IS NOT NULL)), 1, 8), '|'), '') AS release_groups,
    (array_agg(metadata_id ORDER BY matched_at DESC NULLS LAST, updated_at DESC NULLS LAST, metadata_id DESC) FILTER (metadata_id IS NOT NULL))[1] AS metadata_id
    FROM items JOIN matches USING (release_id) LEFT JOIN feeds USING (feed_id)
    WHERE first_seen BETWEEN TIMESTAMP '{SINCE}' AND TIMESTAMP '{NOW}' AND status = 'MATCHED' AND NOT invalidated GROUP BY media_id),
trend AS (SELECT g.*, title, media_type FROM groups g JOIN media USING (media_id))"""
TREND_ORDER = [F.desc, F.desc, F.asc]


@query(oracle("SELECT * FROM trend ORDER BY release_count DESC, latest_release_at DESC, media_id LIMIT 20", "," + TRENDING))
def trending(spark, d):
    return trending_groups(spark, d).orderBy(F.desc("release_count"), F.desc("latest_release_at"), F.asc("media_id")).limit(20)


@query(oracle(
    "SELECT * FROM trend WHERE release_count < 3 OR (release_count = 3 AND latest_release_at < TIMESTAMP '2001-06-01 00:00:00') "
    "OR (release_count = 3 AND latest_release_at = TIMESTAMP '2001-06-01 00:00:00' AND media_id > 10) ORDER BY release_count DESC, latest_release_at DESC, media_id LIMIT 20", "," + TRENDING))  # fmt: skip
def trending_page2(spark, d):
    """The page behind a cursor; the cursor is compared after grouping."""
    behind = after(("release_count", True, 3), ("latest_release_at", True, F.lit("2001-06-01 00:00:00").cast("timestamp")), ("media_id", False, 10))
    return trending_groups(spark, d).where(behind).orderBy(F.desc("release_count"), F.desc("latest_release_at"), F.asc("media_id")).limit(20)


@query("""WITH last AS (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 300), hourly AS (SELECT date_trunc('hour', ts) AS hour, count(*) AS n FROM last GROUP BY 1)
SELECT hour, n, CAST(greatest(6, floor(100 * n / max(n) OVER ())) AS BIGINT) AS bar FROM hourly""")  # fmt: skip
def timeline_hourly(spark, d):
    """The newest 300 entries by hour, with bars of at least 6 per cent of the largest."""
    last = table(spark, d, "events").select("ts", "event_id").orderBy(F.desc("ts"), F.desc("event_id")).limit(300)
    hourly = last.groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("n"))
    return hourly.withColumn("bar", F.greatest(F.lit(6), F.floor(100 * F.col("n") / F.max("n").over(Window.partitionBy(F.lit(1))))).cast("long"))


@query("""SELECT e.user_id % 200 AS media_id, count(*) AS n, max(ts) AS latest, min(CASE WHEN p_partkey % 4 <> 0 THEN '/p' || p_partkey || '.jpg' END) AS poster
FROM events e JOIN part p ON p.p_partkey = e.user_id % 200 WHERE ts BETWEEN TIMESTAMP '2024-01-28 00:00:00' AND TIMESTAMP '2024-01-29 00:00:00'
GROUP BY 1 ORDER BY n DESC, latest DESC, media_id LIMIT 20""")  # fmt: skip
def heat_24h(spark, d):
    """Titles by entries of a day."""
    day = table(spark, d, "events").where("ts BETWEEN TIMESTAMP '2024-01-28 00:00:00' AND TIMESTAMP '2024-01-29 00:00:00'").select((F.col("user_id") % 200).alias("media_id"), "ts")
    counted = day.join(media(spark, d).select("media_id", "poster"), "media_id").groupBy("media_id").agg(F.count("*").alias("n"), F.max("ts").alias("latest"), F.min("poster").alias("poster"))
    return counted.orderBy(F.desc("n"), F.desc("latest"), F.asc("media_id")).limit(20)


@query(oracle("SELECT * FROM (SELECT release_id, metadata_id, matched_at FROM matches WHERE status = 'MATCHED' AND NOT invalidated ORDER BY matched_at DESC, release_id DESC LIMIT 40) WHERE metadata_id IS NOT NULL"))
def posters(spark, d):
    """The newest 40 active matches, then those with metadata: the limit comes first."""
    newest = matches(spark, d).where("status = 'MATCHED' AND NOT invalidated").orderBy(F.desc("matched_at"), F.desc("release_id")).limit(40)
    return newest.where("metadata_id IS NOT NULL").select("release_id", "metadata_id", "matched_at")


@query(oracle("SELECT DISTINCT ON (actor_id) actor_id, release_id, status FROM matches WHERE NOT invalidated ORDER BY actor_id, matched_at DESC NULLS LAST, updated_at DESC, release_id"))
def active_match_distinct_on(spark, d):
    return top_per_key(matches(spark, d).where("NOT invalidated"), ["actor_id"], [F.desc_nulls_last("matched_at"), F.desc("updated_at"), F.asc("release_id")]).select("actor_id", "release_id", "status")


@query(oracle("SELECT actor_id, release_id, status FROM matches WHERE NOT invalidated QUALIFY row_number() OVER (PARTITION BY actor_id ORDER BY matched_at DESC NULLS FIRST, updated_at DESC, release_id) = 1"))
def active_match_nulls_first(spark, d):
    """As a database that sorts nulls first when descending would choose."""
    return top_per_key(matches(spark, d).where("NOT invalidated"), ["actor_id"], [F.desc_nulls_first("matched_at"), F.desc("updated_at"), F.asc("release_id")]).select("actor_id", "release_id", "status")


@query(oracle("SELECT item_id, job_id, status FROM jobs QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY created_at DESC, job_id DESC) <= 3"))
def top3_jobs(spark, d):
    return top_per_key(jobs(spark, d), ["item_id"], [F.desc("created_at"), F.desc("job_id")], 3).select("item_id", "job_id", "status")


@query(oracle("SELECT item_id, max_by(job_id, (created_at, job_id)) AS job_id, max_by(status, (created_at, job_id)) AS status FROM jobs GROUP BY item_id"))
def latest_job(spark, d):
    row = F.max_by(F.struct("job_id", "status"), F.struct("created_at", "job_id"))
    return jobs(spark, d).groupBy("item_id").agg(row.alias("j")).select("item_id", "j.job_id", "j.status")


METADATA = """metadata AS (SELECT DISTINCT media_id, feed_id, feed_id % 4 AS source, (media_id + feed_id) % 3 = 0 AS selected, (media_id * 7 + feed_id) % 5 <> 0 AS has_content,
    (media_id * 31 + feed_id) % 100 AS rating, (media_id + feed_id * 3) % 50 AS votes FROM items)"""


def metadata(spark, d):
    m, f = F.col("media_id"), F.col("feed_id")
    return items(spark, d).select("media_id", "feed_id").distinct().withColumns({
        "source": f % 4, "selected": (m + f) % 3 == 0, "has_content": (m * 7 + f) % 5 != 0, "rating": (m * 31 + f) % 100, "votes": (m + f * 3) % 50,
    })


@query(oracle("SELECT media_id, feed_id, source FROM metadata QUALIFY row_number() OVER (PARTITION BY media_id ORDER BY has_content DESC, selected DESC, (media_id + feed_id) % 2, source, votes > 25 DESC, rating DESC, feed_id) = 1", "," + METADATA))
def best_metadata(spark, d):
    """The first row with content in presentation order, else the first: selected ones, of the title's type, by provider, fresh
    ones, by payload time, by key."""
    order = [F.desc("has_content"), F.desc("selected"), F.asc((F.col("media_id") + F.col("feed_id")) % 2), F.asc("source"), F.desc(F.col("votes") > 25), F.desc("rating"), F.asc("feed_id")]
    return top_per_key(metadata(spark, d), ["media_id"], order).select("media_id", "feed_id", "source")


@query(oracle("SELECT media_id, feed_id, rating, CASE WHEN rating >= 70 THEN 'high' WHEN rating >= 40 THEN 'middle' ELSE 'low' END AS band FROM metadata WHERE source = 1 AND rating > 0 AND votes >= 5 "
              "QUALIFY row_number() OVER (PARTITION BY media_id ORDER BY votes DESC, feed_id) = 1", "," + METADATA))  # fmt: skip
def best_rating(spark, d):
    """Valid ratings of one source only; there is no fallback to others."""
    best = top_per_key(metadata(spark, d).where("source = 1 AND rating > 0 AND votes >= 5"), ["media_id"], [F.desc("votes"), F.asc("feed_id")])
    return best.select("media_id", "feed_id", "rating", F.when(F.col("rating") >= 70, "high").when(F.col("rating") >= 40, "middle").otherwise("low").alias("band"))


STATE = """state AS (SELECT i.release_id, i.line, i.media_id, i.feed_id, i.first_seen, i.size_bytes, i.quality, title, media_type, feed_name, m.status, m.confidence, m.metadata_id,
    CASE WHEN m.release_id IS NULL THEN 'PENDING' ELSE m.status END AS enrichment,
    concat_ws(',', CASE WHEN m.status = 'UNMATCHED' THEN 'unmatched' END, CASE WHEN m.status = 'MATCHED' AND m.confidence < 88 THEN 'low_confidence' END,
        CASE WHEN m.status = 'MATCHED' AND poster IS NULL THEN 'no_cover' END) AS attention
    FROM items i JOIN media USING (media_id) LEFT JOIN feeds USING (feed_id) LEFT JOIN matches m ON m.release_id = i.release_id AND NOT m.invalidated),
rated AS (SELECT *, CASE WHEN status = 'MATCHED' AND attention = '' THEN 'resolved' WHEN status IS NOT NULL THEN 'review' ELSE 'unresolved' END AS identity_state FROM state)"""


def item_state(spark, d):
    """Items with match, enrichment, attention reasons and identity state."""
    m = matches(spark, d).where("NOT invalidated").select("release_id", "status", "confidence", "metadata_id")
    matched = F.col("status") == "MATCHED"
    joined = items(spark, d).join(media(spark, d), "media_id").join(feeds(spark, d), "feed_id", "left").join(m, "release_id", "left")
    attention = F.concat_ws(",", F.when(F.col("status") == "UNMATCHED", "unmatched"), F.when(matched & (F.col("confidence") < 88), "low_confidence"), F.when(matched & F.col("poster").isNull(), "no_cover"))
    return joined.withColumns({"enrichment": F.coalesce("status", F.lit("PENDING")), "attention": attention}).withColumn(
        "identity_state", F.when(matched & (F.col("attention") == ""), "resolved").when(F.col("status").isNotNull(), "review").otherwise("unresolved")
    )


@query(oracle("SELECT attention, enrichment, count(*) AS n FROM rated GROUP BY ALL", "," + STATE))
def attention_reasons(spark, d):
    return item_state(spark, d).groupBy("attention", "enrichment").agg(F.count("*").alias("n"))


@query(oracle("SELECT release_id, line, media_id, feed_id, first_seen, title FROM rated WHERE contains(lower(title), 'ring') OR contains(lower(feed_name), '00007') ORDER BY first_seen DESC, release_id DESC, line, media_id, feed_id, size_bytes LIMIT 50", "," + STATE))
def items_search(spark, d):
    """Case-insensitive search over title and feed, newest first."""
    found = item_state(spark, d).where(F.contains(F.lower("title"), F.lit("ring")) | F.contains(F.lower("feed_name"), F.lit("00007")))
    order = [F.desc("first_seen"), F.desc("release_id"), F.asc("line"), F.asc("media_id"), F.asc("feed_id"), F.asc("size_bytes")]
    return found.orderBy(*order).limit(50).select("release_id", "line", "media_id", "feed_id", "first_seen", "title")


@query(oracle("SELECT identity_state, media_type, count(*) AS n, sum(size_bytes) AS size_bytes FROM rated GROUP BY ALL", "," + STATE))
def items_status(spark, d):
    return item_state(spark, d).groupBy("identity_state", "media_type").agg(F.count("*").alias("n"), F.sum("size_bytes").alias("size_bytes"))


@query(oracle("SELECT CASE media_type WHEN 'MOVIE' THEN 'MOVIE' WHEN 'TV_SERIES' THEN 'TV' ELSE 'OTHER' END AS category, quality, count(*) AS n FROM rated GROUP BY ALL", "," + STATE))
def items_category(spark, d):
    kind = F.when(F.col("media_type") == "MOVIE", "MOVIE").when(F.col("media_type") == "TV_SERIES", "TV").otherwise("OTHER")
    return item_state(spark, d).groupBy(kind.alias("category"), "quality").agg(F.count("*").alias("n"))


@query(oracle("SELECT release_id, line, media_id, feed_id, size_bytes, first_seen FROM items WHERE first_seen < TIMESTAMP '2000-05-01 00:00:00' OR (first_seen = TIMESTAMP '2000-05-01 00:00:00' AND release_id < 5000) "
              "ORDER BY first_seen DESC, release_id DESC, line, media_id, feed_id, size_bytes LIMIT 51"))  # fmt: skip
def items_keyset(spark, d):
    page = items(spark, d).where(after(("first_seen", True, F.lit("2000-05-01 00:00:00").cast("timestamp")), ("release_id", True, 5000)))
    return page.orderBy(F.desc("first_seen"), F.desc("release_id"), F.asc("line"), F.asc("media_id"), F.asc("feed_id"), F.asc("size_bytes")).limit(51).select("release_id", "line", "media_id", "feed_id", "size_bytes", "first_seen")


@query(oracle("SELECT media_id, title, year, media_type FROM media m WHERE contains(lower(title), 'widget') AND EXISTS (SELECT 1 FROM metadata x WHERE x.media_id = m.media_id AND has_content)", "," + METADATA))
def media_search(spark, d):
    return media(spark, d).where(F.contains(F.lower("title"), F.lit("widget"))).join(metadata(spark, d).where("has_content"), "media_id", "left_semi").select("media_id", "title", "year", "media_type")


@query(oracle("SELECT media_id, any_value(title) AS title, count(*) AS n_rows, string_agg(CAST(feed_id AS VARCHAR), ',' ORDER BY selected DESC, feed_id) AS sources FROM media JOIN metadata USING (media_id) GROUP BY media_id", "," + METADATA))
def media_detail(spark, d):
    """One row per title with its metadata nested in order."""
    nested = metadata(spark, d).groupBy("media_id").agg(F.array_sort(F.collect_list(F.struct((~F.col("selected")).alias("later"), "feed_id"))).alias("rows"))
    return media(spark, d).join(nested, "media_id").select("media_id", "title", F.size("rows").cast("long").alias("n_rows"), F.array_join(F.transform("rows", lambda r: r.feed_id.cast("string")), ",").alias("sources"))


@query(oracle("SELECT f.feed_id, feed_name, tenant_id, count(i.release_id) AS n_items FROM feeds f LEFT JOIN items i USING (feed_id) GROUP BY ALL"))
def feeds_with_counts(spark, d):
    n = items(spark, d).groupBy("feed_id").agg(F.count("*").alias("n"))
    return feeds(spark, d).join(n, "feed_id", "left").select("feed_id", "feed_name", "tenant_id", F.coalesce("n", F.lit(0)).alias("n_items"))


@query(oracle("SELECT c.c_custkey AS downloader_id, count(j.job_id) AS n_jobs, count(j.job_id) FILTER (status = 'FAILED') AS n_failed FROM customer c LEFT JOIN jobs j ON j.item_id = c.c_custkey GROUP BY 1"))
def downloaders_with_counts(spark, d):
    n = jobs(spark, d).groupBy(F.col("item_id").alias("downloader_id")).agg(F.count("*").alias("n"), F.count_if(F.col("status") == "FAILED").alias("f"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("downloader_id")).join(n, "downloader_id", "left").select("downloader_id", zero("n").alias("n_jobs"), zero("f").alias("n_failed"))


@query(oracle("SELECT release_id, line, feed_id, media_id, qty FROM items i WHERE EXISTS (SELECT 1 FROM matches m WHERE m.release_id = i.release_id AND status = 'MATCHED' AND NOT invalidated)"))
def active_items_semi(spark, d):
    return items(spark, d).join(matches(spark, d).where("status = 'MATCHED' AND NOT invalidated"), "release_id", "left_semi").select("release_id", "line", "feed_id", "media_id", "qty")


@query(oracle("SELECT release_id, line, feed_id, media_id, size_bytes FROM items i WHERE NOT EXISTS (SELECT 1 FROM matches m WHERE m.release_id = i.release_id AND NOT invalidated) ORDER BY first_seen DESC, release_id DESC, line, media_id, feed_id, size_bytes LIMIT 50"))
def backlog_anti(spark, d):
    """The newest 50 items whose release has no active match."""
    open_items = items(spark, d).join(matches(spark, d).where("NOT invalidated"), "release_id", "left_anti")
    return open_items.orderBy(F.desc("first_seen"), F.desc("release_id"), F.asc("line"), F.asc("media_id"), F.asc("feed_id"), F.asc("size_bytes")).limit(50).select("release_id", "line", "feed_id", "media_id", "size_bytes")


@query(oracle("SELECT media_id FROM media m WHERE media_id > 100 AND EXISTS (SELECT 1 FROM metadata x WHERE x.media_id = m.media_id) AND NOT EXISTS (SELECT 1 FROM metadata x WHERE x.media_id = m.media_id AND source = 1 AND rating > 0) ORDER BY media_id LIMIT 25", "," + METADATA))
def rating_backfill(spark, d):
    """Titles behind a cursor with metadata but no rating of the wanted source."""
    rows = metadata(spark, d)
    return media(spark, d).where("media_id > 100").join(rows, "media_id", "left_semi").join(rows.where("source = 1 AND rating > 0"), "media_id", "left_anti").select("media_id").orderBy("media_id").limit(25)


DUE = "due AS (SELECT feed_id, tenant_id, enabled, CASE WHEN feed_id % 5 = 0 THEN NULL ELSE TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(feed_id % 48 AS INT)) END AS next_attempt FROM feeds)"


@query(oracle("SELECT feed_id, tenant_id, next_attempt FROM due WHERE enabled AND (next_attempt IS NULL OR next_attempt <= TIMESTAMP '2024-01-01 20:00:00') ORDER BY next_attempt NULLS FIRST, feed_id LIMIT 20", "," + DUE))
def due_feeds(spark, d):
    at = F.when(F.col("feed_id") % 5 != 0, F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(F.lit(0), (F.col("feed_id") % 48).cast("int")))
    due = feeds(spark, d).withColumn("next_attempt", at).where("enabled AND (next_attempt IS NULL OR next_attempt <= TIMESTAMP '2024-01-01 20:00:00')")
    return due.orderBy(F.asc_nulls_first("next_attempt"), "feed_id").limit(20).select("feed_id", "tenant_id", "next_attempt")


@query(oracle("""SELECT release_id, media_id, status, confidence FROM (SELECT DISTINCT ON (m.release_id, i.media_id) m.release_id, i.media_id, m.status, m.confidence, poster FROM (SELECT * FROM matches WHERE NOT invalidated) m JOIN items i USING (release_id) LEFT JOIN media x ON x.media_id = m.metadata_id
ORDER BY m.release_id, i.media_id, matched_at DESC NULLS LAST, updated_at DESC) WHERE status = 'UNMATCHED' OR (status = 'MATCHED' AND (confidence < 88 OR poster IS NULL))"""))  # fmt: skip
def rematch_candidates(spark, d):
    """Releases of items whose newest active match is missing, weak or without a poster."""
    active = top_per_key(matches(spark, d).where("NOT invalidated"), ["release_id"], [F.desc_nulls_last("matched_at"), F.desc("updated_at")])
    cover = media(spark, d).select(F.col("media_id").alias("metadata_id"), "poster")
    both = active.join(items(spark, d).select("release_id", "media_id").distinct(), "release_id").join(cover, "metadata_id", "left")
    return both.where("status = 'UNMATCHED' OR (status = 'MATCHED' AND (confidence < 88 OR poster IS NULL))").select("release_id", "media_id", "status", "confidence")


ROLE = "CASE c_mktsegment WHEN 'BUILDING' THEN 'OWNER' WHEN 'MACHINERY' THEN 'ADMIN' WHEN 'HOUSEHOLD' THEN 'MEMBER' ELSE 'VIEWER' END"


@query(f"WITH m AS (SELECT c_custkey AS user_id, {ROLE} AS role FROM customer), r AS (SELECT *, CASE role WHEN 'OWNER' THEN 0 WHEN 'ADMIN' THEN 1 WHEN 'MEMBER' THEN 2 ELSE 3 END AS role_rank FROM m) SELECT user_id, role, role_rank FROM r WHERE role_rank <= 2 ORDER BY role_rank, user_id")
def members_ranked(spark, d):
    """All members with at least the role MEMBER, by declared role order, not by name: a sort by ranges."""
    ranks = {"OWNER": 0, "ADMIN": 1, "MEMBER": 2, "VIEWER": 3}
    rank = F.element_at(F.create_map(*(F.lit(x) for kv in ranks.items() for x in kv)), F.col("role"))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.expr(ROLE).alias("role")).withColumn("role_rank", rank).where("role_rank <= 2").orderBy("role_rank", "user_id")


@query("SELECT event_type AS reason, count(*) AS n FROM events GROUP BY 1")
def reason_histogram(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("reason")).agg(F.count("*").alias("n"))


@query("""SELECT user_id AS feed_id, count(*) FILTER (event_type = 'signup') AS created, count(*) FILTER (event_type IN ('view', 'click')) AS updated, count(*) FILTER (event_type = 'view') AS changed,
count(*) FILTER (event_type = 'click') AS unchanged, count(*) FILTER (event_type = 'error') AS skipped FROM events GROUP BY 1""")  # fmt: skip
def refresh_summary(spark, d):
    e = F.col("event_type")
    return table(spark, d, "events").groupBy(F.col("user_id").alias("feed_id")).agg(
        F.count_if(e == "signup").alias("created"), F.count_if(e.isin("view", "click")).alias("updated"), F.count_if(e == "view").alias("changed"), F.count_if(e == "click").alias("unchanged"), F.count_if(e == "error").alias("skipped")
    )


@query("SELECT count(*) AS scanned, count(*) FILTER (event_type <> 'error') AS mapped, count(*) FILTER (event_type = 'error' AND value < 10) AS missing_raw_title, count(*) FILTER (event_type = 'error' AND value >= 10) AS missing_torrent_url, sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS evidence FROM events")
def import_summary(spark, d):
    e, bad = table(spark, d, "events"), F.col("event_type") == "error"
    return e.agg(F.count("*").alias("scanned"), F.count_if(~bad).alias("mapped"), F.count_if(bad & (F.col("value") < 10)).alias("missing_raw_title"), F.count_if(bad & (F.col("value") >= 10)).alias("missing_torrent_url"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("evidence"))


@query(oracle("SELECT (SELECT count(*) FROM feeds WHERE enabled) AS enabled_feeds, count(*) FILTER (status = 'MATCHED') AS matched, CAST(floor((100 * count(*) FILTER (status = 'MATCHED') + count(*) / 2) / count(*)) AS BIGINT) AS match_rate FROM matches"))
def dashboard_kpis(spark, d):
    n, m = F.count("*"), F.count_if(F.col("status") == "MATCHED")
    rate = F.floor((100 * m + n / 2) / n).cast("long")
    enabled = feeds(spark, d).where("enabled").agg(F.count("*").alias("enabled_feeds"))
    return matches(spark, d).agg(m.alias("matched"), rate.alias("match_rate")).withColumn("one", F.lit(1)).join(enabled.withColumn("one", F.lit(1)), "one").select("enabled_feeds", "matched", "match_rate")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_path(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


INGEST = "keyed AS (SELECT *, 'sig|' || media_id || '|' || coalesce(quality, '') || '|' || coalesce(release_group, '') AS signature FROM items)"


@query(oracle("SELECT feed_id, signature, release_id, line, first_seen FROM keyed QUALIFY row_number() OVER (PARTITION BY feed_id, signature ORDER BY first_seen DESC, release_id, line, qty, size_bytes) = 1", "," + INGEST))
def ingest_dedupe(spark, d):
    """The newest entry of each key of a feed, as upserting all of them in order would leave."""
    signature = F.concat(F.lit("sig|"), F.col("media_id").cast("string"), F.lit("|"), F.coalesce("quality", F.lit("")), F.lit("|"), F.coalesce("release_group", F.lit("")))
    return top_per_key(items(spark, d).withColumn("signature", signature), ["feed_id", "signature"], [F.desc("first_seen"), F.asc("release_id"), F.asc("line"), F.asc("qty"), F.asc("size_bytes")]).select("feed_id", "signature", "release_id", "line", "first_seen")


@query(oracle("""SELECT DISTINCT i.release_id, i.line, i.feed_id, i.media_id, i.qty, min(o.release_id) OVER (PARTITION BY i.feed_id, i.release_id, i.line, i.media_id, i.qty) AS identity FROM items i JOIN items o ON i.feed_id = o.feed_id
AND o.first_seen <= i.first_seen AND o.media_id = i.media_id"""))  # fmt: skip
def identity_resolution(spark, d):
    """The least earlier release of the same feed and title: a running minimum, not a self join."""
    w = Window.partitionBy("feed_id", "media_id").orderBy("first_seen").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    one = items(spark, d).withColumn("identity", F.min("release_id").over(w))
    return one.groupBy("release_id", "line", "feed_id", "media_id", "qty").agg(F.min("identity").alias("identity"))


@query(oracle("SELECT item_id, status, created_at, lead(created_at) OVER (PARTITION BY item_id ORDER BY created_at, job_id) AS invalidated_at FROM (SELECT *, lag(status) OVER (PARTITION BY item_id ORDER BY created_at, job_id) AS was FROM jobs) WHERE was IS NULL OR was <> status".replace("item_id, status, created_at, lead", "item_id, job_id, status, created_at, lead")))
def match_ledger(spark, d):
    return ledger(jobs(spark, d), ["item_id"], ["created_at", "job_id"], ["status"]).select("item_id", "job_id", "status", "created_at", "invalidated_at")


@query(oracle("SELECT was, status AS wanted, count(*) AS n, bool_or((was IN ('QUEUED', 'FAILED') AND status IN ('SENDING', 'SKIPPED')) OR (was = 'SENDING' AND status IN ('SENT', 'FAILED'))) AS allowed FROM (SELECT *, lag(status) OVER (PARTITION BY item_id ORDER BY created_at, job_id) AS was FROM jobs) WHERE was IS NOT NULL GROUP BY ALL"))
def job_state_changes(spark, d):
    was = F.lag("status").over(Window.partitionBy("item_id").orderBy("created_at", "job_id"))
    steps = jobs(spark, d).withColumn("was", was).where("was IS NOT NULL")
    return steps.groupBy("was", F.col("status").alias("wanted")).agg(F.count("*").alias("n")).withColumn("allowed", may_change(F.col("was"), F.col("wanted")))


@query(oracle("SELECT dedupe_key, job_id FROM (SELECT CASE WHEN job_id % 10 = 0 THEN NULL ELSE 'k' || item_id || status END AS dedupe_key, job_id FROM jobs) QUALIFY dedupe_key IS NULL OR row_number() OVER (PARTITION BY dedupe_key ORDER BY job_id) = 1"))
def job_dedupe(spark, d):
    """Job creation with a unique key; forced duplicates have a null key and bypass it."""
    key = F.when(F.col("job_id") % 10 != 0, F.concat(F.lit("k"), F.col("item_id").cast("string"), F.col("status")))
    rows = jobs(spark, d).select(key.alias("dedupe_key"), "job_id")
    return merge_keyed(rows.where("job_id < 500"), rows.where("job_id >= 500"), ["dedupe_key"], [F.asc("job_id")])
