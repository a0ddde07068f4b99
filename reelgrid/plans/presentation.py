"""Queries of what is shown: titles, items with jobs and reasons, candidates of rules, and records of the generator service."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelgrid.operators import presentation as shown
from reelgrid.operators import ptgen
from reelgrid.plans.serving import METADATA, metadata
from reelgrid.sources.tables import feeds, items, jobs, matches, media, oracle

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


DETAILS = """details AS (SELECT *, CASE WHEN feed_id % 2 = 0 THEN 'tmdb' ELSE 'tvdb' END AS provider, CASE WHEN has_content AND feed_id % 3 <> 0 THEN 'about ' || feed_id END AS overview, CASE WHEN has_content AND feed_id % 5 <> 0 THEN '/p' || feed_id ELSE ' ' END AS poster,
CASE WHEN feed_id % 7 <> 0 THEN 'Title ' || feed_id END AS shown_title, CASE WHEN feed_id % 4 <> 0 THEN 1900 + feed_id END AS own_year FROM metadata),
best AS (SELECT * FROM details QUALIFY row_number() OVER (PARTITION BY media_id ORDER BY overview IS NOT NULL OR trim(poster) <> '' DESC, selected DESC, source, provider, feed_id) = 1),
ratings AS (SELECT * FROM details WHERE source = 1 AND rating > 0 AND votes % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY media_id ORDER BY votes DESC, provider, feed_id) = 1)"""


@query(oracle("""SELECT m.media_id, coalesce(b.shown_title, CASE WHEN m.media_id % 6 <> 0 THEN m.title END, CASE WHEN m.media_id % 12 <> 0 THEN 'release ' || m.media_id END, 'raw ' || m.media_id) AS title, coalesce(CASE WHEN m.media_id % 5 <> 0 THEN m.year END, b.own_year, 1) AS year, b.overview,
CASE WHEN trim(b.poster) <> '' THEN CASE WHEN b.provider = 'tmdb' THEN 'https://image.tmdb.org/t/p/w342' ELSE '' END || b.poster END AS poster, r.rating, coalesce(trim(b.poster) <> '', false) AS has_cover FROM media m LEFT JOIN best b USING (media_id) LEFT JOIN ratings r USING (media_id)""", "," + METADATA + "," + DETAILS))  # fmt: skip
def presented_titles(spark, d):
    """Titles as they are shown, each field by its chain of fallbacks; ratings of one source alone."""
    f, m = F.col("feed_id"), F.col("media_id")
    text = lambda cond, c: F.when(cond, F.concat(F.lit(c), f.cast("string")))
    details = metadata(spark, d).select(
        "media_id", F.when(f % 2 == 0, "tmdb").otherwise("tvdb").alias("provider"), F.when(F.col("source") == 1, "one").otherwise("other").alias("provider_source"), F.lpad(f.cast("string"), 9, "0").alias("provider_id"), "selected", F.col("source").alias("place"),
        text(f % 7 != 0, "Title ").alias("title"), F.lit(None).cast("string").alias("original_title"), F.when(f % 4 != 0, 1900 + f).alias("year"), text(F.col("has_content") & (f % 3 != 0), "about ").alias("overview"), F.coalesce(text(F.col("has_content") & (f % 5 != 0), "/p"), F.lit(" ")).alias("poster"),
        F.lit(None).cast("string").alias("backdrop"), F.when(F.col("rating") > 0, F.col("rating")).alias("rating"), F.lit(100).alias("rating_scale"), "votes", F.col("votes").alias("rating_votes"), F.when(F.col("votes") % 3 != 0, "USER_SCORE").alias("rating_type"), F.col("votes").alias("fetched_at"),
    )
    titles = media(spark, d).select("media_id", F.when(m % 6 != 0, F.col("title")).alias("title"), "media_type", F.when(m % 5 != 0, F.col("year")).alias("year"), F.when(m % 12 != 0, F.concat(F.lit("release "), m.cast("string"))).alias("release_title"), F.lit(1).alias("release_year"), F.concat(F.lit("raw "), m.cast("string")).alias("raw_title"))
    return shown.presented(titles, details, "one").select("media_id", "title", "year", "overview", "poster", "rating", "has_cover")


REASON = "CASE WHEN i.release_id % 4 = 0 THEN 'no_result' WHEN i.release_id % 4 = 1 THEN 'other' WHEN i.release_id % 4 = 2 THEN 'automatic_low_confidence_match' END"


@query(oracle(f"""SELECT release_id, line, feed_id, media_id, qty, coalesce(n, 0) AS n_jobs, coalesce(last, '') AS last_jobs, concat_ws(',', CASE WHEN failed AND status IS NOT NULL THEN 'failed_download' END, CASE WHEN status = 'UNMATCHED' THEN 'unmatched' END,
CASE WHEN status = 'UNMATCHED' AND reason = 'no_result' THEN reason END, CASE WHEN status = 'MATCHED' AND (coalesce(reason = 'automatic_low_confidence_match', false) OR release_id % 3 <> 0 AND confidence < 88) THEN 'low_confidence' END, CASE WHEN status = 'UNMATCHED' OR status = 'MATCHED' AND poster IS NULL THEN 'no_cover' END) AS reasons
FROM (SELECT i.*, poster, m.status, m.confidence, {REASON} AS reason FROM items i JOIN media USING (media_id) LEFT JOIN feeds f USING (feed_id) LEFT JOIN matches m ON m.release_id = i.release_id AND NOT invalidated WHERE tenant_id = 2) x
LEFT JOIN (SELECT item_id, count(*) AS n, bool_or(status = 'FAILED') AS failed, string_agg(CASE WHEN place <= 3 THEN CAST(job_id AS VARCHAR) END, ',' ORDER BY place) AS last FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY created_at DESC, job_id DESC) AS place FROM jobs) GROUP BY 1) j ON j.item_id = x.release_id % 200"""))  # fmt: skip
def item_pages(spark, d):
    """A tenant's items with their jobs, the newest three by name, and all reasons for attention."""
    r = F.col("release_id")
    mine = items(spark, d).join(feeds(spark, d).where("tenant_id = 2").select("feed_id"), "feed_id").join(media(spark, d).select("media_id", "poster"), "media_id")
    m = matches(spark, d).where("NOT invalidated").select("release_id", "status", "confidence")
    every = mine.join(m, "release_id", "left").withColumns({"item_id": r % 200, "reason": F.when(r % 4 == 0, "no_result").when(r % 4 == 1, "other").when(r % 4 == 2, "automatic_low_confidence_match"), "match_source": F.when(r % 3 == 0, "MANUAL").otherwise("AUTO")})
    both = shown.with_jobs(every, jobs(spark, d), "item_id", 3)
    why = shown.attention(F.col("status"), F.col("reason"), F.col("match_source"), F.col("confidence"), F.col("poster").isNotNull(), F.col("failed"))
    names = F.array_join(F.transform(F.coalesce("jobs", F.array().cast("array<struct<created_at:timestamp,job_id:bigint,status:string>>")), lambda j: j.job_id.cast("string")), ",")
    return both.select("release_id", "line", "feed_id", "media_id", "qty", "n_jobs", names.alias("last_jobs"), F.array_join(why, ",").alias("reasons"))


@query(oracle("""SELECT release_id, CASE WHEN modern THEN 'tmdb:' || metadata_id ELSE 'imdb:' || release_id END AS selected, CASE WHEN modern THEN NULL ELSE 'title' END AS entity, CASE WHEN modern THEN 'user_score' WHEN release_id % 4 = 0 THEN 'critic_score' END AS rating_type FROM
(SELECT *, metadata_id IS NOT NULL AND release_id % 5 <> 0 AS modern FROM matches WHERE status = 'MATCHED' AND NOT invalidated AND release_id % 13 <> 0) WHERE modern OR release_id % 2 = 0"""))
def candidate_matches(spark, d):
    """The match of each release that rules look at: modern metadata, else the legacy record, else none."""
    r = F.col("release_id")
    none = lambda kind: F.lit(None).cast(kind)
    view = lambda provider, of, entity, kind: F.struct(F.lit(provider).alias("provider"), F.lit("MOVIE").alias("mediaType"), entity.alias("providerEntityType"), of.cast("string").alias("providerId"), kind.alias("ratingType"), none("bigint").alias("ratingValue"), none("bigint").alias("ratingScale"), none("bigint").alias("ratingVoteCount"))
    modern = F.when(F.col("metadata_id").isNotNull() & (r % 5 != 0), view("tmdb", F.col("metadata_id"), none("string"), F.lit("USER_SCORE")))
    legacy = F.when(r % 2 == 0, view("imdb", r, F.lit("title"), F.when(r % 4 == 0, "CRITIC_SCORE")))
    now = matches(spark, d).select("release_id", r.alias("match_id"), "status", "matched_at", F.when(F.col("invalidated"), F.col("updated_at")).alias("invalidated_at"), F.when(r % 13 != 0, r).alias("media_id"), modern.alias("modern"), legacy.alias("legacy"))
    # An older match of the same release, and one that was invalidated, do not count.
    older = now.where("release_id % 3 = 0").withColumn("matched_at", F.lit("1990-01-01").cast(now.schema["matched_at"].dataType)).withColumn("modern", none(now.schema["modern"].dataType))
    found = shown.active_match(now.unionByName(older).where("NOT (release_id % 13 = 0 AND matched_at < '1991-01-01')"), "release_id")
    s = F.col("selected")
    return found.select("release_id", F.concat(s.provider, F.lit(":"), s.providerId).alias("selected"), s.providerEntityType.alias("entity"), s.ratingType.alias("rating_type"))


def hits(spark, d):
    """A hit of the service for each title, under ids of all forms."""
    m, none = F.col("media_id"), F.lit(None).cast("string")
    imdb, douban = F.concat(F.lit("tt"), F.lpad(m.cast("string"), 7, "0")), m.cast("string")
    record = F.when(m % 6 == 0, F.concat(F.lit("imdb-"), imdb)).when(m % 6 == 1, F.concat(F.lit("Douban-"), douban)).when(m % 6 == 2, F.concat(F.lit("work_imdb_"), imdb)).when(m % 6 == 3, F.concat(F.lit("w"), douban))
    ids = F.struct(F.when(m % 6 == 3, F.concat(F.lit("https://www.imdb.com/title/"), imdb, F.lit("/?ref=1"))).alias("imdb"), F.when(m % 6 == 4, F.concat(F.lit("https://movie.douban.com/subject/"), douban, F.lit("/"))).alias("douban"))
    score = lambda v: F.struct(v.cast("string").alias("score"), (m % 50).cast("string").alias("votes"))
    return media(spark, d).select(
        (m % 100).alias("query"), m.alias("position"), record.alias("id"), ids.alias("source_ids"), F.when(m % 4 == 0, F.array(F.lit("imdb"), F.lit("douban"))).otherwise(F.array(F.lit("imdb"))).alias("sources"), F.array(F.concat(F.lit("片"), m.cast("string")), F.lit(" "), F.col("title")).alias("titles"),
        F.array(F.lit(" 又名 ")).alias("aliases"), F.when(m % 2 == 0, "TV").otherwise("film").alias("kind"), F.when(m % 9 == 0, "MOVIE").alias("wanted_type"), F.when(m % 3 != 0, F.col("year").cast("string")).alias("year"), F.lit("2001-05-01").alias("release_date"), F.when(m % 7 != 0, (m % 10).cast("string")).alias("rating_score"),
        F.lit("12.7").alias("rating_votes"), F.struct(score(m % 8).alias("imdb"), score(m % 9).alias("douban")).alias("scores"), none.alias("description"), F.lit("https://x/own.jpg").alias("poster"), F.when(m % 2 == 0, "/p.jpg").alias("own_poster"), F.lit("https://gen.example/api/").alias("base_url"), F.when(m % 5 == 0, "zh-CN").otherwise("en").alias("language"),
    )


HITS = """hit AS (SELECT *, media_id % 6 AS form, media_id % 6 IN (1, 4) AS douban, lpad(CAST(media_id AS VARCHAR), 7, '0') AS padded, media_id % 5 = 0 AS zh, media_id % 6 IN (2, 3, 4) AND media_id % 4 = 0 AS mixed FROM media WHERE media_id % 6 <> 5),
told AS (SELECT *, CASE WHEN mixed THEN CASE WHEN douban THEN media_id % 9 ELSE media_id % 8 END WHEN media_id % 7 <> 0 THEN media_id % 10 WHEN douban THEN media_id % 9 ELSE media_id % 8 END AS score FROM hit)"""


@query(oracle("""SELECT 'ptgen_' || CASE WHEN douban THEN 'douban' ELSE 'imdb' END AS source, CASE WHEN douban THEN 'douban-' || media_id ELSE 'imdb-tt' || padded END AS provider_id, CASE WHEN media_id % 9 = 0 OR media_id % 2 = 1 THEN 'MOVIE' ELSE 'TV_SERIES' END AS media_type, CASE WHEN zh THEN '片' || media_id ELSE title END AS title,
CASE WHEN zh THEN title ELSE '片' || media_id END AS original, CASE WHEN media_id % 3 <> 0 THEN year ELSE 2001 END AS year, CAST(score AS DOUBLE) AS rating, CASE WHEN mixed THEN media_id % 50 ELSE 12 END AS rating_votes, CASE WHEN media_id % 2 = 0 THEN 'https://gen.example/p.jpg' ELSE 'https://x/own.jpg' END AS poster,
CASE WHEN douban THEN 'https://movie.douban.com/subject/' || media_id || '/' ELSE 'https://www.imdb.com/title/tt' || padded || '/' END AS page FROM told""", "," + HITS))  # fmt: skip
def ptgen_records(spark, d):
    """Hits of the generator service in the common form: identities, titles by language, ratings of the right source."""
    return ptgen.from_ptgen(hits(spark, d)).select("source", "provider_id", "media_type", "title", "original", "year", "rating", "rating_votes", "poster", "page")


@query(oracle("""SELECT media_id AS query, position, CASE WHEN media_id % 4 = 0 THEN 1 WHEN media_id % 4 = 1 THEN 2 WHEN media_id % 4 = 2 THEN CASE WHEN media_id % 6 = 0 THEN 2 ELSE 3 END END AS attempt FROM media, (SELECT unnest([1, 2, 3]) AS position) WHERE media_id % 4 <> 3 AND position <= 2"""))
def ptgen_attempts(spark, d):
    """Searches that widen attempt by attempt until one finds something; the first two hits of that one."""
    m = F.col("media_id")
    asked = media(spark, d).select(m.alias("query"), "media_type", F.when(m % 6 != 0, F.col("year")).alias("year"))
    kind = F.when(F.col("media_type") == "TV_SERIES", "tv").otherwise("movie")
    year = F.when(m % 6 != 0, F.col("year")).cast("int")
    none = F.lit(None).cast("int")
    # Each search would find three hits from one attempt on (m % 4: the first, the second, the third; never), and in later ones.
    one = lambda k, y: F.struct(k.alias("kind"), y.alias("year"))
    first, second, third, last = one(kind, year), one(kind, none), one(F.lit("work"), year), one(F.lit("work"), none)
    found = F.when(m % 4 == 0, F.array(first, second, third, last)).when((m % 4 == 1) & (m % 6 == 0), F.array(second)).when(m % 4 == 1, F.array(second, third, last)).when(m % 4 == 2, F.array(third, last))
    answers = media(spark, d).select(m.alias("query"), F.explode(F.array_distinct(found)).alias("a"))
    answers = answers.select("query", "a.kind", "a.year", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("position"))
    return ptgen.in_turn(asked, answers, 2).select("query", "position", "attempt")
