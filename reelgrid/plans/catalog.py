"""Queries of the catalogue: scoped and searched reads, shelves, presentation, merges, matching and upkeep."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelgrid.operators import catalogue, matching, rank
from reelgrid.operators.merge import changed
from reelgrid.operators.links import ends, merged
from reelgrid.operators.rank import top_per_key
from reelgrid.plans.serving import METADATA, STATE, TRENDING, item_state, metadata, trending_groups
from reelgrid.sources.tables import feeds, items, jobs, matches, media, oracle, table

QUERIES, ORACLES = {}, {}
ITEM = ["release_id", "line", "feed_id", "media_id", "qty"]


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def tenant_items(spark: SparkSession, d: str, tenant: int) -> DataFrame:
    """Items of a tenant's feeds."""
    return items(spark, d).join(catalogue.scoped(feeds(spark, d), tenant).select("feed_id"), "feed_id", "left_semi")


@query(oracle("SELECT media_id, count(*) AS n, max(first_seen) AS latest FROM items JOIN feeds USING (feed_id) WHERE tenant_id = 3 GROUP BY 1"))
def tenant_titles(spark, d):
    """Only rows of the tenant are read into the aggregation."""
    return tenant_items(spark, d, 3).groupBy("media_id").agg(F.count("*").alias("n"), F.max("first_seen").alias("latest"))


ALIASES = "alias AS (SELECT media_id, title || ' ' || (media_id % 7) AS alias, media_id % 3 AS provider FROM media UNION ALL SELECT media_id, 'The ' || upper(title), 9 FROM media WHERE media_id % 2 = 0)"


def title_aliases(spark, d):
    m, t = F.col("media_id"), F.col("title")
    one = media(spark, d).select("media_id", F.concat(t, F.lit(" "), (m % 7).cast("string")).alias("alias"), (m % 3).alias("provider"))
    return one.unionByName(media(spark, d).where("media_id % 2 = 0").select("media_id", F.concat(F.lit("The "), F.upper(t)).alias("alias"), F.lit(9).cast("long").alias("provider")))


@query(oracle("""SELECT release_id, line, feed_id, media_id, qty FROM items i JOIN media m USING (media_id) JOIN feeds USING (feed_id) WHERE tenant_id = 1 AND (contains(lower(title), 'e 3') OR contains(lower(coalesce(quality, '')), 'e 3')
OR contains(lower(coalesce(release_group, '')), 'e 3') OR contains(lower(feed_name), 'e 3') OR EXISTS (SELECT 1 FROM alias a WHERE a.media_id = i.media_id AND contains(lower(alias), 'e 3')))""", "," + ALIASES))  # fmt: skip
def items_search_all(spark, d):
    """A search over an item's own fields and all titles and aliases linked to it."""
    linked = title_aliases(spark, d).groupBy("media_id").agg(F.collect_list("alias").alias("aliases"))  # a title's own
    found = tenant_items(spark, d, 1).join(media(spark, d).select("media_id", "title"), "media_id").join(feeds(spark, d).select("feed_id", "feed_name"), "feed_id").join(linked, "media_id", "left")
    values = F.concat(F.array("title", "quality", "release_group", "feed_name"), F.coalesce("aliases", F.array().cast("array<string>")))
    return found.where(F.exists(values, lambda v: F.coalesce(F.contains(F.lower(v), F.lit("e 3")), F.lit(False)))).select(*ITEM)


@query(oracle("SELECT media_id, title FROM media m WHERE EXISTS (SELECT 1 FROM alias a WHERE a.media_id = m.media_id AND alias = 'The ' || upper(m.title)) AND media_id % 3 = 0", "," + ALIASES))
def alias_membership(spark, d):
    """Titles that list an alias exactly."""
    listed = title_aliases(spark, d).groupBy("media_id").agg(F.collect_set("alias").alias("aliases"))
    return media(spark, d).where("media_id % 3 = 0").join(listed, "media_id").where(F.array_contains("aliases", F.concat(F.lit("The "), F.upper("title")))).select("media_id", "title")


@query(oracle("SELECT media_id, title FROM media m WHERE contains(trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')), 'small') OR contains(lower(title), 'small') OR EXISTS (SELECT 1 FROM alias a WHERE a.media_id = m.media_id AND contains(lower(alias), 'ring 3'))", "," + ALIASES))
def title_search(spark, d):
    """Titles whose key, name or any alias holds the query."""
    hit = title_aliases(spark, d).where(F.contains(F.lower("alias"), F.lit("ring 3"))).select("media_id").distinct().withColumn("by_alias", F.lit(True))
    key = F.trim(F.regexp_replace(F.lower("title"), "[^a-z0-9]+", " "))
    return media(spark, d).join(hit, "media_id", "left").where(F.contains(key, F.lit("small")) | F.contains(F.lower("title"), F.lit("small")) | F.col("by_alias")).select("media_id", "title")


SHELVES = f"""{STATE}, last_job AS (SELECT item_id, max_by(status, (created_at, job_id)) AS job FROM jobs GROUP BY 1), shelved AS (SELECT r.*, job, identity_state = 'resolved' AS is_matched, coalesce(job NOT IN ('FAILED', 'SENT', 'COMPLETE', 'COMPLETED', 'SKIPPED'), false) AS is_downloading,
coalesce(job = 'FAILED', false) OR identity_state <> 'resolved' AS is_attention, CASE WHEN job = 'FAILED' THEN 'failed' WHEN job IN ('SENT', 'COMPLETED') THEN 'downloaded' WHEN job IS NOT NULL THEN lower(job) WHEN status IS NULL THEN 'processing'
WHEN status = 'UNMATCHED' THEN 'needs_title' WHEN attention <> '' THEN 'check_match' WHEN r.release_id % 5 = 0 THEN 'manual_match' ELSE 'ready' END AS label FROM rated r LEFT JOIN last_job ON item_id = r.release_id % 200)"""
TERMINAL = ["FAILED", "SENT", "COMPLETE", "COMPLETED", "SKIPPED"]


@query(oracle("SELECT is_matched, is_downloading, is_attention, label, count(*) AS n FROM shelved GROUP BY ALL", "," + SHELVES))
def item_shelves(spark, d):
    """Shelves that items belong to, and what is shown of their state: the newest job first, then the match."""
    last = jobs(spark, d).groupBy("item_id").agg(F.max_by("status", F.struct("created_at", "job_id")).alias("job"))
    one = item_state(spark, d).withColumn("item_id", F.col("release_id") % 200).join(last, "item_id", "left")
    job, resolved = F.col("job"), F.col("identity_state") == "resolved"
    label = F.when(job == "FAILED", "failed").when(job.isin("SENT", "COMPLETED"), "downloaded").when(job.isNotNull(), F.lower(job)).when(F.col("status").isNull(), "processing")
    label = label.when(F.col("status") == "UNMATCHED", "needs_title").when(F.col("attention") != "", "check_match").when(F.col("release_id") % 5 == 0, "manual_match").otherwise("ready")
    flags = one.select(resolved.alias("is_matched"), F.coalesce(~job.isin(TERMINAL), F.lit(False)).alias("is_downloading"), (F.coalesce(job == "FAILED", F.lit(False)) | ~resolved).alias("is_attention"), label.alias("label"))
    return flags.groupBy(*flags.columns).agg(F.count("*").alias("n"))


@query(oracle("SELECT confidence < 88 AS was_low, metadata_id % 3 AS old_provider, (metadata_id + 1) % 4 AS new_provider, count(*) AS n, count(*) FILTER (release_id % 3 = 0) AS improved FROM matches WHERE status = 'MATCHED' AND NOT invalidated AND metadata_id IS NOT NULL GROUP BY ALL"))
def rematch_progress(spark, d):
    """A rematch run by old and new provider."""
    m = matches(spark, d).where("status = 'MATCHED' AND NOT invalidated AND metadata_id IS NOT NULL")
    keys = [(F.col("confidence") < 88).alias("was_low"), (F.col("metadata_id") % 3).alias("old_provider"), ((F.col("metadata_id") + 1) % 4).alias("new_provider")]
    return m.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col("release_id") % 3 == 0).alias("improved"))


@query("SELECT c_nationkey % 5 AS tenant_id, count(*) FILTER (c_mktsegment = 'BUILDING') AS owners, count(*) AS users FROM customer GROUP BY 1")
def owner_counts(spark, d):
    return table(spark, d, "customer").groupBy((F.col("c_nationkey") % 5).alias("tenant_id")).agg(F.count_if(F.col("c_mktsegment") == "BUILDING").alias("owners"), F.count("*").alias("users"))


@query(oracle("SELECT actor_id, release_id, status FROM matches WHERE NOT invalidated QUALIFY row_number() OVER (PARTITION BY actor_id ORDER BY status = 'MATCHED' DESC, CASE WHEN status = 'MATCHED' THEN coalesce(metadata_id % 4, 9) ELSE 0 END, greatest(coalesce(matched_at, updated_at), updated_at) DESC, release_id) = 1"))
def presentation_match(spark, d):
    """Matched ones by provider priority, then time and id; else the newest."""
    matched = F.col("status") == "MATCHED"
    priority = F.when(matched, F.coalesce(F.col("metadata_id") % 4, F.lit(9))).otherwise(0)
    order = [F.desc(matched), F.asc(priority), F.desc(F.greatest("matched_at", "updated_at")), F.asc("release_id")]
    return top_per_key(matches(spark, d).where("NOT invalidated"), ["actor_id"], order).select("actor_id", "release_id", "status")


@query(oracle("SELECT media_id, feed_id, CASE WHEN score >= 94 THEN score ELSE greatest(0, score - 3 * least(place, 4)) END AS score FROM (SELECT media_id, feed_id, rating AS score, row_number() OVER (PARTITION BY media_id ORDER BY votes DESC, feed_id) - 1 AS place FROM metadata)", "," + METADATA))
def rank_penalty(spark, d):
    """Scores less for their place in the result list."""
    place = F.row_number().over(Window.partitionBy("media_id").orderBy(F.desc("votes"), "feed_id")) - 1
    return metadata(spark, d).withColumn("place", place).select("media_id", "feed_id", matching.with_rank_penalty(F.col("rating"), F.col("place")).alias("score"))


CURSOR = rank.encoded_cursor({"release_count": 2, "latest_release_at": "2001-06-20 00:00:00", "media_id": 50})


@query(oracle("SELECT * FROM trend WHERE release_count < 2 OR (release_count = 2 AND latest_release_at < TIMESTAMP '2001-06-20 00:00:00') OR (release_count = 2 AND latest_release_at = TIMESTAMP '2001-06-20 00:00:00' AND media_id > 50) ORDER BY release_count DESC, latest_release_at DESC, media_id LIMIT 21", "," + TRENDING))
def trending_cursor(spark, d):
    """The page behind an encoded cursor, and one row more that tells whether another follows."""
    at = rank.decoded_cursor(CURSOR, ["release_count", "latest_release_at", "media_id"])
    behind = rank.after(("release_count", True, at["release_count"]), ("latest_release_at", True, F.lit(at["latest_release_at"]).cast("timestamp")), ("media_id", False, at["media_id"]))
    return trending_groups(spark, d).where(behind).orderBy(F.desc("release_count"), F.desc("latest_release_at"), F.asc("media_id")).limit(21)


@query(oracle("""SELECT tenant_id, media_id FROM (SELECT DISTINCT tenant_id, media_id FROM items JOIN feeds USING (feed_id)) x WHERE media_id > CASE WHEN tenant_id < 3 THEN tenant_id * 100 ELSE 0 END AND NOT EXISTS (SELECT 1 FROM metadata m WHERE m.media_id = x.media_id AND source = 1 AND rating > 0)
QUALIFY row_number() OVER (PARTITION BY tenant_id ORDER BY media_id) <= 5""", "," + METADATA))  # fmt: skip
def rating_backfill_cursors(spark, d):
    """The next five titles behind each tenant's stored cursor; tenants without one begin at the start."""
    cursors = spark.createDataFrame([(0, 0), (1, 100), (2, 200)], "tenant_id long, behind long")
    owned = items(spark, d).join(feeds(spark, d).select("feed_id", "tenant_id"), "feed_id").select("tenant_id", "media_id").distinct()
    rated = metadata(spark, d).where("source = 1 AND rating > 0").select("media_id").distinct()
    rest = owned.join(F.broadcast(cursors), "tenant_id", "left").where(F.col("media_id") > F.coalesce("behind", F.lit(0))).join(rated, "media_id", "left_anti")
    return top_per_key(rest, ["tenant_id"], [F.asc("media_id")], 5).select("tenant_id", "media_id")


@query(oracle("SELECT media_id, CASE WHEN media_id % 2 = 0 THEN title || '|The ' || title || '|' || (media_id % 7) ELSE title || '|' || (media_id % 7) END AS search FROM media"))
def search_titles(spark, d):
    """The parsed title and further ones, once each regardless of case, five at most."""
    t, m = F.col("title"), F.col("media_id")
    more = F.array(F.concat(F.lit(" "), F.upper(t)), F.when(m % 2 == 0, F.concat(F.lit("The "), t)), F.lit(""), (m % 7).cast("string"))
    return media(spark, d).select("media_id", F.array_join(matching.search_titles(t, more), "|").alias("search"))


@query(oracle("SELECT media_id, count(DISTINCT (source, feed_id % 9)) AS n_ids FROM metadata WHERE feed_id % 9 <> 0 GROUP BY 1", "," + METADATA))
def imported_ids(spark, d):
    """Imported identities of a title, each once."""
    some = F.col("feed_id") % 9
    pair = F.struct(F.col("source").alias("source"), F.when(some != 0, some).alias("id"))
    per = metadata(spark, d).groupBy("media_id").agg(F.collect_list(pair).alias("found")).withColumn("ids", matching.imported_ids(F.col("found")))
    return per.where(F.size("ids") > 0).select("media_id", F.size("ids").cast("long").alias("n_ids"))


@query(oracle("SELECT media_id, source, feed_id % 9 AS provider_id, selected, feed_id AS place FROM metadata QUALIFY row_number() OVER (PARTITION BY media_id, source, feed_id % 9 ORDER BY selected DESC, feed_id) = 1", "," + METADATA))
def provider_choices(spark, d):
    """A title's metadata rows once per provider identity, selected ones first."""
    rows = metadata(spark, d).select("media_id", F.lit(None).cast("long").alias("id"), F.col("source").cast("string").alias("source"), (F.col("feed_id") % 9).cast("string").alias("provider_id"), "selected", F.col("feed_id").alias("place"))
    return matching.provider_choices(rows, "media_id").select("media_id", F.col("source").cast("long").alias("source"), F.col("provider_id").cast("long").alias("provider_id"), "selected", "place")


# An ingest: the older half of the items is stored, the rest comes in; keys are signatures, hashes those of links.
UPSERT = """split AS (SELECT feed_id, 'SIG' AS key_type, CAST(media_id AS VARCHAR) || coalesce(quality, '') AS key_hash, 'l' || (media_id * 10 + qty % 10) AS link, first_seen AS seen_at, quality, release_group, release_id, line, qty, size_bytes FROM items),
one AS (SELECT * FROM split QUALIFY row_number() OVER (PARTITION BY feed_id, key_hash, seen_at < TIMESTAMP '1999-01-01 00:00:00' ORDER BY seen_at DESC, release_id, line, qty, size_bytes) = 1),
stored AS (SELECT 'i' || feed_id || ':' || key_hash AS item_id, * FROM one WHERE seen_at < TIMESTAMP '1999-01-01 00:00:00'), incoming AS (SELECT * FROM one WHERE seen_at >= TIMESTAMP '1999-01-01 00:00:00'),
placed AS (SELECT n.*, coalesce(s.item_id, (SELECT max_by(o.item_id, (o.seen_at, o.item_id)) FROM stored o WHERE o.feed_id = n.feed_id AND o.link = n.link), 'new:' || n.feed_id || ':SIG:' || n.key_hash) AS item_id FROM incoming n LEFT JOIN stored s ON s.feed_id = n.feed_id AND s.key_hash = n.key_hash),
last AS (SELECT * FROM placed QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY seen_at DESC, key_hash) = 1)"""


@query(oracle("""SELECT coalesce(n.item_id, o.item_id) AS item_id, coalesce(n.seen_at, o.seen_at) AS seen_at, CASE WHEN n.item_id IS NULL THEN 'kept' WHEN o.item_id IS NULL THEN 'created' WHEN n.release_group IS DISTINCT FROM o.release_group OR n.quality IS DISTINCT FROM o.quality THEN 'changed' ELSE 'unchanged' END AS outcome
FROM last n FULL JOIN stored o ON n.item_id = o.item_id""", "," + UPSERT))  # fmt: skip
def ingest_upsert(spark, d):
    """Items after an ingest, with what happened to each."""
    key = F.concat(F.col("media_id").cast("string"), F.coalesce("quality", F.lit("")))
    link = F.concat(F.lit("l"), (F.col("media_id") * 10 + F.col("qty") % 10).cast("string"))
    old = F.col("first_seen") < F.lit("1999-01-01 00:00:00").cast("timestamp")
    split = items(spark, d).select("feed_id", F.lit("SIG").alias("key_type"), key.alias("key_hash"), F.array(link).alias("hashes"), F.col("first_seen").alias("seen_at"), "quality", "release_group", "release_id", "line", "qty", "size_bytes", old.alias("old"))
    one = top_per_key(split, ["feed_id", "key_hash", "old"], [F.desc("seen_at"), F.asc("release_id"), F.asc("line"), F.asc("qty"), F.asc("size_bytes")]).drop("release_id", "line", "qty", "size_bytes")
    stored = one.where("old").drop("old").select(F.concat(F.lit("i"), F.col("feed_id").cast("string"), F.lit(":"), "key_hash").alias("item_id"), "*")
    return catalogue.upserted(stored, one.where("NOT old").drop("old"), ["quality", "release_group"]).select("item_id", "seen_at", "outcome")


CHANGED = "media_id % 12 = 0"


@query(oracle(f"SELECT media_id FROM media WHERE {CHANGED} OR media_id % 40 = 1"))
def snapshot_conflicts(spark, d):
    """Titles that changed or vanished between a read and the write that relies on it."""
    read = media(spark, d).select("media_id", "title", "year", "media_type")
    now = read.where("media_id % 40 <> 1").withColumn("year", F.when(F.expr(CHANGED), F.col("year") + 1).otherwise(F.col("year")))
    return catalogue.conflicts(read, now, "media_id", ["title", "year", "media_type"])


TITLES = """known AS (SELECT media_id, media_type, title AS title_key, CASE WHEN media_id % 5 = 0 THEN NULL ELSE year END AS year, TIMESTAMP '2020-01-01 00:00:00' + to_days(CAST(media_id % 100 AS INT)) AS created_at FROM media WHERE media_id % 3 <> 0),
wanted AS (SELECT DISTINCT media_type, title AS title_key, CASE WHEN media_id % 7 = 0 THEN NULL ELSE year END AS year FROM media)"""


@query(oracle("""SELECT w.*, k.media_id IS NULL AS created, coalesce(CAST(k.media_id AS VARCHAR), sha256(concat_ws('|', w.media_type, w.title_key, coalesce(CAST(w.year AS VARCHAR), '-')))) AS media_id FROM wanted w LEFT JOIN LATERAL
(SELECT media_id FROM known k WHERE k.media_type = w.media_type AND k.title_key = w.title_key AND (k.year IS NOT DISTINCT FROM w.year OR k.year IS NULL) ORDER BY created_at, media_id LIMIT 1) k ON true""", "," + TITLES))  # fmt: skip
def title_get_or_create(spark, d):
    m = F.col("media_id")
    known = media(spark, d).where("media_id % 3 <> 0").select("media_id", "media_type", F.col("title").alias("title_key"), F.when(m % 5 != 0, F.col("year")).alias("year"), (F.lit("2020-01-01 00:00:00").cast("timestamp") + F.make_dt_interval((m % 100).cast("int"))).alias("created_at"))
    wanted = media(spark, d).select("media_type", F.col("title").alias("title_key"), F.when(m % 7 != 0, F.col("year")).alias("year")).distinct()
    return catalogue.get_or_create(known, wanted).select("media_type", "title_key", "year", "created", "media_id")


POLICIES = """own AS (SELECT n_nationkey AS tenant_id, 'MOVIE' AS media_type, s AS source, CAST(p AS INT) AS priority, true AS enabled FROM nation, (VALUES ('tmdb', 1), ('tvdb', 2)) v(s, p)),
new AS (SELECT n_nationkey AS tenant_id, 'MOVIE' AS media_type, CASE WHEN n_nationkey % 5 = 1 AND s = 'tvdb' THEN 'bangumi' ELSE s END AS source, CAST(CASE WHEN n_nationkey % 5 = 2 THEN 1 ELSE p END AS INT) AS priority, n_nationkey % 10 <> 7 AS enabled FROM nation, (VALUES ('ptgen_imdb', 1), ('tvdb', 2)) v(s, p) WHERE n_nationkey % 2 = 1),
good AS (SELECT * FROM new WHERE n_nationkey_ok(tenant_id))""".replace("n_nationkey_ok(tenant_id)", "tenant_id % 5 <> 1 AND (tenant_id % 5 <> 2 OR NOT enabled)")


@query(f"WITH {POLICIES} SELECT * FROM own WHERE tenant_id NOT IN (SELECT tenant_id FROM good) UNION ALL SELECT * FROM good")
def policy_replacement(spark, d):
    """Policy sets replaced whole, unless a source does not fit or two enabled ones have one priority."""
    n = F.col("n_nationkey")

    def rows(pairs, source, priority, enabled):
        base = table(spark, d, "nation").select(n, F.explode(F.array(*(F.struct(F.lit(s).alias("s"), F.lit(p).alias("p")) for s, p in pairs))).alias("v"))
        return base.select(n.alias("tenant_id"), F.lit("MOVIE").alias("media_type"), source.alias("source"), priority.cast("int").alias("priority"), enabled.alias("enabled"))

    s, p = F.col("v.s"), F.col("v.p")
    own = rows([("tmdb", 1), ("tvdb", 2)], s, p, F.lit(True))
    new = rows([("ptgen_imdb", 1), ("tvdb", 2)], F.when((n % 5 == 1) & (s == "tvdb"), "bangumi").otherwise(s), F.when(n % 5 == 2, 1).otherwise(p), n % 10 != 7).where("tenant_id % 2 = 1")
    return catalogue.replaced_policies(own, new, matching.SUPPORTED)


@query(oracle("SELECT release_id, status, CASE WHEN release_id % 4 = 0 AND NOT invalidated THEN 'release_parse_changed' WHEN invalidated THEN 'old' END AS stale_reason, invalidated OR release_id % 4 = 0 AS is_stale FROM matches WHERE EXISTS (SELECT 1)"))
def reparse(spark, d):
    """An incremental reparse: releases whose parse changed lose their active matches."""
    at = F.lit("2024-01-01 00:00:00").cast("timestamp")
    m = matches(spark, d).select("release_id", "status", F.when(F.col("invalidated"), F.lit("2000-01-01 00:00:00").cast("timestamp")).alias("invalidated_at"), F.when(F.col("invalidated"), "old").alias("stale_reason"))
    stored = m.select("release_id", F.lit("1080p").alias("quality"))
    fresh = stored.withColumn("quality", F.when(F.col("release_id") % 4 == 0, "720p").otherwise(F.col("quality")))
    touched = catalogue.reparsed(stored, fresh, "release_id", ["quality"])
    return catalogue.invalidated(m, touched, "release_id", at, "release_parse_changed").select("release_id", "status", "stale_reason", F.col("invalidated_at").isNotNull().alias("is_stale"))


@query(oracle("SELECT media_id, CASE WHEN media_id % 50 = 0 THEN media_id ELSE media_id - media_id % 50 END AS target FROM media WHERE media_id >= 50"))
def superseded_titles(spark, d):
    """Titles and where their chains of redirects end: each points to the one before, to every 50th."""
    links = media(spark, d).where("media_id >= 50 AND media_id % 50 <> 0").select("media_id", (F.col("media_id") - 1).alias("superseded_by"))
    targets = ends(links, "media_id", "superseded_by")
    return media(spark, d).where("media_id >= 50").select("media_id").join(targets, "media_id", "left").select("media_id", F.coalesce("target", "media_id").alias("target"))


@query(oracle("SELECT media_id, CASE WHEN media_id // 10 % 4 = 0 THEN media_id - media_id % 10 END AS ended, media_id - media_id % 10 AS target FROM media WHERE media_id % 10 > 0"))
def superseded_in_cycles(spark, d):
    """Chains of ten titles; three of four end in a cycle of two, three or five, of which the least title survives."""
    m, back = F.col("media_id"), F.floor(F.col("media_id") / 10) % 4
    to = F.when(m % 10 > 0, m - 1).when(back == 1, m + 1).when(back == 2, m + 2).when(back == 3, m + 4)
    links = media(spark, d).select("media_id", to.alias("superseded_by"))
    kept_ends, all_ends = ends(links, "media_id", "superseded_by").withColumnRenamed("target", "ended"), ends(links, "media_id", "superseded_by", "least")
    return media(spark, d).where("media_id % 10 > 0").select("media_id").join(kept_ends.hint("merge"), "media_id", "left").join(all_ends.hint("merge"), "media_id", "left").select("media_id", "ended", "target")


@query(oracle("""SELECT a AS media_id, min(b) AS survivor FROM reach GROUP BY 1""", """,
identity AS (SELECT media_id, 'tmdb:' || (media_id // 2) AS id FROM media WHERE media_id % 5 < 3 UNION ALL SELECT media_id, 'imdb:' || (media_id // 3) FROM media WHERE media_id % 7 < 3 UNION ALL SELECT media_id, 'tvdb:1' FROM media WHERE media_id % 50 = 49),
reach(a, b) AS (SELECT media_id, media_id FROM media UNION SELECT r.a, y.media_id FROM reach r JOIN identity x ON x.media_id = r.b JOIN identity y ON y.id = x.id)""").replace("WITH ", "WITH RECURSIVE ", 1))  # fmt: skip
def merged_titles(spark, d):
    """Titles that share identities, directly or by way of others, are one; the least stays."""
    m = F.col("media_id")
    of = lambda source, value, rows: media(spark, d).where(rows).select("media_id", F.concat(F.lit(f"{source}:"), F.floor(value).cast("string")).alias("id"))
    identities = of("tmdb", m / 2, m % 5 < 3).unionByName(of("imdb", m / 3, m % 7 < 3)).unionByName(of("tvdb", F.lit(1), m % 50 == 49))
    return merged(media(spark, d).select("media_id"), identities, "media_id", "id")


@query(oracle("SELECT title AS title_key, media_type, count(*) AS n_items, count(DISTINCT release_id) AS n_releases, min(first_seen) AS first_seen FROM items JOIN media USING (media_id) GROUP BY ALL"))
def rebuild(spark, d):
    """Derived titles built anew from the items, whatever was derived before."""
    return items(spark, d).join(media(spark, d).select("media_id", F.col("title").alias("title_key"), "media_type"), "media_id").groupBy("title_key", "media_type").agg(F.count("*").alias("n_items"), F.count_distinct("release_id").alias("n_releases"), F.min("first_seen").alias("first_seen"))


FOUND = """found AS (SELECT media_id, media_type, feed_id, source, source <> 3 OR media_id % 4 <> 0 AS enabled, source <> 2 AS available, source * 1000000 + votes * 1000 + feed_id AS ordinal, votes % 4 <> 0 AS year_known, CASE WHEN media_id % 31 = 0 THEN 'UNKNOWN' ELSE media_type END AS kind,
CASE WHEN media_type = 'TV_SERIES' THEN NOT year - votes % 3 + 1 > year ELSE votes % 3 = 1 END AS compatible, rating AS score FROM metadata JOIN media USING (media_id))"""


@query(oracle("""SELECT media_id, CASE WHEN kind = 'UNKNOWN' THEN 'unknown_media_type' WHEN NOT some_enabled THEN 'provider_disabled_by_policy' WHEN sure IS NOT NULL THEN 'automatic_match' WHEN low IS NOT NULL THEN 'automatic_low_confidence_match' WHEN NOT some_available THEN 'provider_not_configured' WHEN yearless THEN 'missing_release_year_for_auto_match' ELSE 'no_result' END AS reason,
CASE WHEN kind <> 'UNKNOWN' THEN coalesce(sure, low) END AS candidate FROM (SELECT media_id, any_value(kind) AS kind, bool_or(enabled) AS some_enabled, bool_or(enabled AND available) AS some_available, bool_or(enabled AND available AND NOT year_known) AS yearless,
min_by(feed_id, ordinal) FILTER (enabled AND available AND year_known AND compatible AND score >= 88) AS sure, max_by(feed_id, (score, -ordinal)) FILTER (enabled AND available AND year_known AND compatible AND score >= 30) AS low FROM found GROUP BY 1)""", "," + METADATA + "," + FOUND))  # fmt: skip
def automatic_match(spark, d):
    """Every title's match among its candidates, with the reason."""
    v, year = F.col("votes"), F.col("year")
    compatible = ~matching.year_incompatible(F.col("media_type") == "TV_SERIES", F.lit(0), F.when(F.col("media_type") == "TV_SERIES", 1 - v % 3).otherwise(v % 3 - 1))
    found = metadata(spark, d).join(media(spark, d).select("media_id", "media_type", "year"), "media_id").select(
        "media_id", F.when(F.col("media_id") % 31 == 0, "UNKNOWN").otherwise(F.col("media_type")).alias("media_type"), "source", ((F.col("source") != 3) | (F.col("media_id") % 4 != 0)).alias("enabled"), (F.col("source") != 2).alias("available"),
        (F.col("source") * 1_000_000 + v * 1000 + F.col("feed_id")).alias("ordinal"), (v % 4 != 0).alias("year_known"), compatible.alias("compatible"), F.col("rating").alias("score"), F.col("feed_id").alias("candidate"), year,
    )
    return matching.best_candidates(found, "media_id").select("media_id", "reason", "candidate")


@query(oracle("""SELECT media_id, candidate, score, source FROM (SELECT media_id, media_id % 7 AS candidate, 100 AS score, 'MANUAL' AS source FROM media WHERE media_id % 6 = 0 UNION ALL SELECT DISTINCT media_id, source, 100, 'IMPORT' FROM metadata WHERE feed_id % 9 = 0 AND media_id % 6 <> 0
UNION ALL SELECT media_id, media_id % 11, media_id % 101, 'AUTO' FROM media m WHERE media_id % 6 <> 0 AND NOT EXISTS (SELECT 1 FROM metadata x WHERE x.media_id = m.media_id AND feed_id % 9 = 0))""", "," + METADATA))  # fmt: skip
def active_matches(spark, d):
    """Automatic, imported and manual matches of titles: who overrides whom."""
    m = F.col("media_id")
    auto = media(spark, d).select("media_id", (m % 11).alias("candidate"), (m % 101).alias("score"))
    manual = media(spark, d).where("media_id % 6 = 0").select("media_id", (m % 7).alias("candidate"))
    known = metadata(spark, d).where("feed_id % 9 = 0").select("media_id", F.col("source").alias("candidate"))
    return matching.overridden(auto, manual, known, "media_id")


@query(oracle("SELECT media_id, CASE WHEN media_type <> 'TV_SERIES' THEN score WHEN s AND c AND e AND p THEN greatest(score, CASE WHEN ep THEN 96 ELSE 93 END) WHEN s AND ep AND cn AND e THEN greatest(score, 93) WHEN s AND ep AND pt AND e THEN greatest(score, 88) WHEN cn AND nat THEN greatest(score, 88) ELSE score END AS score FROM (SELECT media_id, media_type, media_id % 101 AS score, media_id % 2 = 1 AS s, media_id % 5 <> 0 AS ep, media_id % 3 = 0 AS c, media_id % 7 <> 0 AS e, true AS p, media_id % 4 = 0 AS cn, media_id % 9 < 5 AS pt, media_id % 11 = 0 AS nat FROM media)"))
def evidence_scores(spark, d):
    """Scores of series lifted by what the provider confirms."""
    m = F.col("media_id")
    season, episode = F.when(m % 2 == 1, 1), F.when(m % 5 != 0, 2)
    score = matching.with_evidence(m % 101, F.col("media_type") == "TV_SERIES", season, episode, m % 3 == 0, m % 7 != 0, m % 9 < 5, F.when(m % 4 == 0, "CN").otherwise("US"), m % 11 == 0)
    return media(spark, d).select("media_id", score.alias("score"))


@query(oracle("SELECT m.media_id, x.feed_id FROM metadata x JOIN media m USING (media_id) WHERE rating > 0 AND votes % 2 = 0 AND x.feed_id % 4 <> 0 AND (CASE WHEN media_type = 'MOVIE' THEN x.feed_id % 3 = 0 ELSE x.feed_id % 3 <> 2 END) AND (x.source <> m.media_id % 4 AND m.media_id % 101 >= 88)", "," + METADATA))
def strict_ratings(spark, d):
    """Results that may lend a title their rating, of another source than its sure match."""
    f, m = F.col("feed_id"), F.col("media_id")
    found = metadata(spark, d).join(media(spark, d).select("media_id", "title", "media_type", "year"), "media_id")
    year = F.col("year") + F.when(f % 3 == 0, 0).when(f % 3 == 1, -1).otherwise(1)
    titles = F.array(F.lit("other"), F.when(f % 4 != 0, F.upper("title")).otherwise(F.lit("no")))
    key = F.trim(F.regexp_replace(F.lower("title"), "[^a-z0-9]+", " "))
    fits = matching.strict_rating(F.col("media_type"), key, F.col("year"), F.col("media_type"), titles, year, F.when(F.col("rating") > 0, F.col("rating")), F.lit(10), F.when(F.col("votes") % 2 == 0, "user"))
    return found.where(fits & matching.may_keep_rating(F.col("source"), m % 4, m % 101)).select("media_id", "feed_id")


@query(oracle("SELECT DISTINCT CAST(q AS VARCHAR) AS query, media_id, kind FROM (VALUES ('tt0000012', 'imdb'), ('https://movie.douban.com/subject/30/', 'douban'), ('tmdb:44', 'tmdb')) v(q, kind) JOIN media m ON (kind = 'imdb' AND q = 'tt' || lpad(CAST(media_id AS VARCHAR), 7, '0')) OR (kind = 'douban' AND media_id = 30) OR (kind = 'tmdb' AND media_id = 44) "
              "UNION SELECT q, media_id, kind FROM (VALUES ('tmdb small', 'hinted', 'small'), ('large ring', 'broad', 'large ring')) v(q, kind, w) JOIN media ON contains(lower(title), w)"))  # fmt: skip
def smart_search(spark, d):
    """Free queries: identities, provider hints and plain words."""
    queries = spark.createDataFrame([("tt0000012",), ("https://movie.douban.com/subject/30/",), ("tmdb:44",), ("tmdb small",), ("large ring",), ("tt9999999",)], "query string")
    m = F.col("media_id")
    ids = F.array(F.struct(F.lit("imdb").alias("p"), F.concat(F.lit("tt"), F.lpad(m.cast("string"), 7, "0")).alias("i")), F.struct(F.lit("douban").alias("p"), m.cast("string").alias("i")), F.struct(F.lit("tmdb").alias("p"), m.cast("string").alias("i")))
    known = media(spark, d).select("media_id", "title", F.explode(ids).alias("x")).select("media_id", "title", F.col("x.p").alias("provider"), F.col("x.i").alias("provider_id"))
    return matching.searched(queries, known, "query")


@query(oracle("SELECT source, provider_id, title, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS title_key, locale_key, aliases, year FROM (SELECT 'tmdb' AS source, CAST(media_id AS VARCHAR) AS provider_id, title, 'en-US' AS locale_key, '' AS aliases, year FROM media UNION ALL SELECT 'tvdb', CAST(media_id AS VARCHAR), title, 'en', 'Other ' || title, year FROM media WHERE media_id % 3 <> 0 AND (media_id % 100) % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY media_id % 100 ORDER BY media_id) <= 8)"))
def provider_records(spark, d):
    """Records of two providers in one form; of the second, eight usable ones a query."""
    base, m = media(spark, d), F.col("media_id")
    none, tv = F.lit(None).cast("string"), F.col("media_type") == "TV_SERIES"
    first = matching.from_tmdb(base.select(m.alias("id"), F.when(~tv, F.col("title")).alias("title"), F.when(tv, F.col("title")).alias("name"), none.alias("original_title"), none.alias("original_name"), F.lit("en").alias("language"), F.lit("US").alias("region"), F.when(~tv, F.concat(F.col("year").cast("string"), F.lit("-01-01"))).alias("release_date"), F.when(tv, F.concat(F.col("year").cast("string"), F.lit("-05-01"))).alias("first_air_date"), F.lit(1).alias("votes"), F.lit(7.0).alias("vote_average")))
    second = matching.from_tvdb(base.select((m % 100).alias("query"), F.when(m % 3 != 0, F.concat(F.lit("series-"), m.cast("string"))).alias("id"), F.when((m % 100) % 3 != 0, F.col("title")).otherwise(F.lit(" ")).alias("name"), F.array(F.lit(" "), F.concat(F.lit("Other "), "title"), F.upper("title")).alias("aliases"), F.lit("en").alias("language"), F.col("year").cast("string").alias("year"), m.alias("position"))).drop("query")
    every = matching.canonical_results(first.unionByName(second))
    return every.select("source", "provider_id", "title", "title_key", "locale_key", F.array_join("aliases", "|").alias("aliases"), "year")


DUE = "CASE WHEN feed_id % 5 = 0 THEN NULL ELSE TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(feed_id % 48 AS INT)) END"


@query(oracle(f"SELECT feed_id, CASE WHEN due THEN TIMESTAMP '2024-01-01 20:00:00' + to_minutes(CAST(10 + feed_id % 3 AS INT)) ELSE next_attempt END AS next_attempt, CASE WHEN due THEN CASE WHEN feed_id % 7 = 0 THEN 'failed' ELSE 'ok' END END AS outcome FROM (SELECT *, enabled AND (next_attempt IS NULL OR next_attempt <= TIMESTAMP '2024-01-01 20:00:00') AS due FROM (SELECT *, {DUE} AS next_attempt FROM feeds))"))
def feed_reschedule(spark, d):
    """Feeds after a tick: those that were due are tried again an interval from now, whether they failed or not."""
    f, now = F.col("feed_id"), F.lit("2024-01-01 20:00:00").cast("timestamp")
    at = F.when(f % 5 != 0, F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(F.lit(0), (f % 48).cast("int")))
    due = F.col("enabled") & (F.col("next_attempt").isNull() | (F.col("next_attempt") <= now))
    tried = feeds(spark, d).withColumn("next_attempt", at).withColumn("due", due)
    return tried.select("feed_id", F.when(F.col("due"), now + F.make_dt_interval(F.lit(0), F.lit(0), (10 + f % 3).cast("int"))).otherwise(F.col("next_attempt")).alias("next_attempt"), F.when(F.col("due"), F.when(f % 7 == 0, "failed").otherwise("ok")).alias("outcome"))


@query(oracle("SELECT job_id, status, CASE WHEN status IN ('QUEUED', 'FAILED') THEN 'SENDING' ELSE status END AS new_status, CASE WHEN status IN ('QUEUED', 'FAILED') THEN job_id % 4 + 1 ELSE job_id % 4 END AS attempts FROM jobs"))
def job_claims(spark, d):
    """Jobs that a dispatcher may claim become SENDING, with one attempt more."""
    free = F.col("status").isin("QUEUED", "FAILED")
    return jobs(spark, d).select("job_id", "status", F.when(free, "SENDING").otherwise(F.col("status")).alias("new_status"), (F.col("job_id") % 4 + free.cast("int")).alias("attempts"))


@query(oracle("SELECT release_id, line, feed_id, media_id, qty FROM items i WHERE qty % 2 = 0 AND NOT EXISTS (SELECT 1 FROM matches m WHERE m.release_id = i.release_id AND NOT invalidated) QUALIFY row_number() OVER (PARTITION BY feed_id ORDER BY first_seen DESC, release_id, line, media_id, qty, size_bytes) <= 50"))
def enrichment_batch(spark, d):
    """The first fifty changed items of each feed's refresh that have no match; the rest stays for later sweeps."""
    open_items = items(spark, d).where("qty % 2 = 0").join(matches(spark, d).where("NOT invalidated"), "release_id", "left_anti")
    return top_per_key(open_items, ["feed_id"], [F.desc("first_seen"), F.asc("release_id"), F.asc("line"), F.asc("media_id"), F.asc("qty"), F.asc("size_bytes")], 50).select(*ITEM)


@query(oracle("SELECT i.release_id, i.line, i.feed_id, i.qty, o.was IS DISTINCT FROM i.quality OR o.grp IS DISTINCT FROM i.release_group AS is_changed FROM items i JOIN (SELECT release_id, line, feed_id, qty, media_id, size_bytes, CASE WHEN release_id % 6 = 0 THEN '720p' ELSE quality END AS was, CASE WHEN release_id % 9 = 0 THEN NULL ELSE release_group END AS grp FROM items) o ON o.release_id = i.release_id AND o.line = i.line AND o.feed_id = i.feed_id AND o.qty = i.qty AND o.media_id = i.media_id AND o.size_bytes = i.size_bytes"))
def parse_changes(spark, d):
    """Whether stored fields of an item differ, nulls equal to nulls."""
    i = items(spark, d)
    old = i.select("release_id", "line", "feed_id", "qty", "media_id", "size_bytes", F.when(F.col("release_id") % 6 == 0, "720p").otherwise(F.col("quality")).alias("quality"), F.when(F.col("release_id") % 9 != 0, F.col("release_group")).alias("release_group"))
    both = i.alias("n").join(old.alias("o"), ["release_id", "line", "feed_id", "qty", "media_id", "size_bytes"])
    return both.select("release_id", "line", "feed_id", "qty", changed("o", "n", ["quality", "release_group"]).alias("is_changed"))
