"""What is shown of a title and of an item: chains of fallbacks, reasons for attention, jobs, and the candidate that rules judge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgrid.operators.rank import top_per_key

# Where a provider's relative images lie, when an automatic match is of low confidence, and the kinds of ratings.
IMAGES = {"tmdb": "https://image.tmdb.org/t/p/w342"}
SURE = 88
RATINGS = {"USER_SCORE": "user_score", "CRITIC_SCORE": "critic_score", "POPULARITY": "popularity"}
REASONS_KEPT = ["provider_not_configured", "no_result", "unknown_media_type"]


def image(provider: Column, path: Column) -> Column:
    """An image's address; null for blank paths."""
    p = F.nullif(F.trim(path), F.lit(""))
    out = F.when(p.rlike("(?i)^https?://"), p)
    for name, base in IMAGES.items():
        out = out.when(provider == name, F.concat(F.lit(base), p))
    return out.otherwise(p)


def has_content(*values: Column) -> Column:
    """Whether an overview or an image says anything."""
    out = F.lit(False)
    for v in values:
        out = out | F.coalesce(F.trim(v) != "", F.lit(False))
    return out


def presented(titles: DataFrame, metadata: DataFrame, rating_source: str) -> DataFrame:
    """titles(media_id, title, media_type, year, release_title, release_year, raw_title) as they are shown, by metadata(media_id, provider, provider_source,
    provider_id, selected, place, title, original_title, year, overview, poster, backdrop, rating, rating_scale, rating_votes, rating_type, fetched_at).

    Metadata: the first with an overview or image, else the first; selected ones first, then by place, then by provider and id. Title: the
    metadata's, the catalogue's, the release's, the raw one. Year: the catalogue's, the metadata's, the release's. Rating: the newest valid one of
    rating_source alone.
    """
    shown = metadata.withColumn("_content", has_content(F.col("overview"), F.col("poster"), F.col("backdrop")))
    best = top_per_key(shown, ["media_id"], [F.desc("_content"), F.desc("selected"), F.asc("place"), F.asc("provider"), F.asc("provider_id")])
    best = best.select("media_id", F.struct("provider", "title", "original_title", "year", "overview", "poster", "backdrop").alias("m"))
    valid = metadata.where((F.col("provider_source") == rating_source) & F.col("rating").isNotNull() & (F.col("rating_scale") > 0) & F.col("rating_type").isin(*RATINGS))
    rated = top_per_key(valid, ["media_id"], [F.desc("fetched_at"), F.asc("provider"), F.asc("provider_id")]).select("media_id", F.struct("rating", "rating_scale", "rating_votes").alias("r"))
    both = titles.join(best, "media_id", "left").join(rated, "media_id", "left")
    cover = image(F.col("m.provider"), F.col("m.poster"))
    return both.select(
        "media_id", F.coalesce("m.title", "title", "release_title", "raw_title", F.lit("Unknown")).alias("title"), F.col("m.original_title").alias("original_title"), F.coalesce("media_type", F.lit("UNKNOWN")).alias("media_type"),
        F.coalesce("year", "m.year", "release_year").alias("year"), F.col("m.overview").alias("overview"), cover.alias("poster"), image(F.col("m.provider"), F.col("m.backdrop")).alias("backdrop"), F.col("r.rating").alias("rating"),
        F.col("r.rating_scale").alias("rating_scale"), F.col("r.rating_votes").alias("rating_votes"), cover.isNotNull().alias("has_cover"),
    )


def attention(status: Column, reason: Column, source: Column, confidence: Column, has_cover: Column, failed: Column) -> Column:
    """The reasons why an item needs a look, in their order: a failed download; no match, with what is known of why; an automatic match of
    low confidence; no cover."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    unmatched, matched = yes(status == "UNMATCHED"), yes(status == "MATCHED")
    low = matched & (yes(reason == "automatic_low_confidence_match") | yes((source == "AUTO") & (confidence < SURE)))
    return F.array_compact(F.array(
        F.when(yes(failed) & status.isNotNull(), "failed_download"), F.when(unmatched, "unmatched"), F.when(unmatched & reason.isin(*REASONS_KEPT), reason), F.when(low, "low_confidence"), F.when(unmatched | (matched & ~yes(has_cover)), "no_cover"),
    ))


def with_jobs(items: DataFrame, jobs: DataFrame, key: str, most: int = 20) -> DataFrame:
    """items with their jobs (newest first, `most` are shown), how many there are, and whether one failed."""
    shown = top_per_key(jobs, [key], [F.desc("created_at"), F.desc("job_id")], most).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("created_at", "job_id", "status")), asc=False).alias("jobs"))  # `most` a key
    counts = jobs.groupBy(key).agg(F.count("*").alias("n_jobs"), F.bool_or(F.col("status") == "FAILED").alias("failed"))
    return items.join(counts, key, "left").join(shown, key, "left").withColumns({"n_jobs": F.coalesce("n_jobs", F.lit(0)).cast("long"), "failed": F.coalesce("failed", F.lit(False))})


def rating_kind(c: Column) -> Column:
    out = F.lit(None).cast("string")
    for stored, said in RATINGS.items():
        out = F.when(c == stored, said).otherwise(out)
    return out


def active_match(matches: DataFrame, key: str) -> DataFrame:
    """The newest match of each item that is neither invalidated nor without a title, with the provider's title that rules look at:
    of the modern metadata if it has any, else of the legacy record; a match with neither is none.

    matches(key, match_id, status, matched_at, invalidated_at, media_id, modern, legacy): modern and legacy are structs (provider, providerId,
    mediaType, providerEntityType, ratingValue, ratingScale, ratingVoteCount, ratingType), null where there is none.
    """
    live = matches.where("invalidated_at IS NULL AND status = 'MATCHED'")
    newest = top_per_key(live, [key], [F.desc("matched_at"), F.desc("match_id")])
    view = lambda s, entity: F.when(s.isNotNull(), F.struct(s.provider.alias("provider"), s.mediaType.alias("mediaType"), entity.alias("providerEntityType"), s.providerId.alias("providerId"), rating_kind(s.ratingType).alias("ratingType"), s.ratingValue.alias("ratingValue"), s.ratingScale.alias("ratingScale"), s.ratingVoteCount.alias("ratingVoteCount")))
    modern, legacy = F.col("modern"), F.col("legacy")
    selected = F.coalesce(view(modern, F.lit(None).cast("string")), view(legacy, legacy.providerEntityType))
    return newest.withColumn("selected", selected).where("media_id IS NOT NULL AND selected IS NOT NULL").drop("modern", "legacy")


def resolution_of(stored: Column, quality: Column, raw_title: Column) -> Column:
    """A release's resolution: the stored one, that of its quality if this is one, else the first in its raw title."""
    named = lambda c: F.when(F.lower(F.trim(c)) == "4k", 2160).otherwise(F.regexp_extract(F.lower(F.trim(c)), "^([0-9]{3,4})p?$", 1).try_cast("int"))
    words = F.filter(F.split(F.lower(raw_title), "[^a-z0-9_]+"), lambda w: w.isin("2160p", "4k", "1080p", "720p", "480p"))
    return F.coalesce(stored, named(quality), named(F.get(words, F.lit(0))))


def merged_pages(pages: DataFrame, key: str, page: str, place: str) -> DataFrame:
    """Rows of pages that were read one after the other, each key once, where it came first, in that order."""
    return top_per_key(pages, [key], [F.asc(page), F.asc(place)]).orderBy(page, place)
