"""Matching of releases to catalogue titles: search titles, provider records, scores with evidence, choices and ratings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgrid.functions.text import aliases, key_of, locale_key, same_ignoring_case
from reelgrid.operators import substrings
from reelgrid.operators.rank import top_per_key
from reelgrid.sources.tables import scratch_folder

# Confidences that decide, reasons, and what providers can find.
SURE, LOW = 88, 30
SUPPORTED = {"tmdb": ["MOVIE", "TV_SERIES"], "tvdb": ["MOVIE", "TV_SERIES"], "ptgen_imdb": ["MOVIE", "TV_SERIES"], "ptgen_douban": ["MOVIE", "TV_SERIES"], "bangumi": ["TV_SERIES"]}
MOST_SEARCH_TITLES = 5
REGIONAL = ["CN", "HK", "TW"]


def search_titles(title: Column, more: Column, most: int = MOST_SEARCH_TITLES) -> Column:
    """The parsed title, then others, trimmed, each once regardless of case (accents count)."""
    every = F.filter(F.transform(F.concat(F.array(title), F.coalesce(more, F.array().cast("array<string>"))), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))
    first = F.filter(every, lambda x, i: ~F.exists(F.slice(every, F.lit(1), i), lambda y: same_ignoring_case(x, y)))
    return F.slice(first, 1, most)


def imported_ids(found: Column) -> Column:
    """Imported identities (source, id), each once."""
    return F.array_distinct(F.filter(found, lambda x: x.id.isNotNull()))


def with_evidence(score: Column, tv: Column, season: Column, episode: Column, confirmed: Column, exact: Column, parsed_title: Column, country: Column, native: Column) -> Column:
    """Hundredths lifted by evidence of a series: season and episode confirmed by the provider, a regional origin, the parsed
    title itself, or a regional display title; the first that holds decides."""
    numbered = season.isNotNull() & episode.isNotNull()
    regional = F.coalesce(country.isin(REGIONAL), F.lit(False))
    lifted = F.when(season.isNotNull() & confirmed & exact, F.when(episode.isNotNull(), 96).otherwise(93)).when(numbered & regional & exact, 93).when(numbered & parsed_title & exact, 88).when(regional & native, 88)
    return F.when(tv, F.greatest(score, F.coalesce(lifted, F.lit(0)))).otherwise(score)


def with_rank_penalty(score: Column, index: Column) -> Column:
    """Hundredths less three per place in the result list, up to four places; scores of 94 and more keep theirs."""
    return F.when(score >= 94, score).otherwise(F.greatest(F.lit(0), score - 3 * F.least(index, F.lit(4))))


def year_incompatible(tv: Column, expected: Column, actual: Column) -> Column:
    """Films need equal years; a series may have begun before. Unknown years are compatible."""
    return F.coalesce(F.when(tv, actual > expected).otherwise(actual != expected), F.lit(False))


def best_candidates(found: DataFrame, key: str) -> DataFrame:
    """Per release the match and its reason, from found(key, media_type, source, enabled, available, ordinal, year_known, compatible, score, candidate).

    In order of source, search title and result: a candidate without year is remembered and skipped, incompatible and weak ones
    are skipped, the first of SURE wins, else the best of LOW and more, the first of equals.
    """
    usable = F.col("enabled") & F.col("available") & (F.col("media_type") != "UNKNOWN") & F.col("candidate").isNotNull()
    fit = usable & F.col("year_known") & F.col("compatible")
    row = F.struct("candidate", "score")
    out = found.groupBy(key).agg(
        F.min_by(F.when(fit & (F.col("score") >= SURE), row), F.when(fit & (F.col("score") >= SURE), F.col("ordinal"))).alias("sure"),
        F.max_by(F.when(fit & (F.col("score") >= LOW), row), F.when(fit & (F.col("score") >= LOW), F.struct("score", -F.col("ordinal")))).alias("low"),
        F.bool_or("enabled").alias("some_enabled"), F.bool_or(F.col("enabled") & F.col("available")).alias("some_available"), F.bool_or(usable & ~F.col("year_known")).alias("yearless"), F.first("media_type").alias("media_type"),
    )
    why = F.when(F.col("media_type") == "UNKNOWN", "unknown_media_type").when(~F.col("some_enabled"), "provider_disabled_by_policy").when(F.col("sure").isNotNull(), "automatic_match").when(F.col("low").isNotNull(), "automatic_low_confidence_match")
    why = why.when(~F.col("some_available"), "provider_not_configured").when(F.col("yearless"), "missing_release_year_for_auto_match").otherwise("no_result")
    best = F.coalesce("sure", "low")
    return out.select(key, best.candidate.alias("candidate"), best.score.alias("score"), why.alias("reason"), F.when(best.isNotNull(), "MATCHED").otherwise("UNMATCHED").alias("status"))


def overridden(automatic: DataFrame, manual: DataFrame, imported: DataFrame, key: str) -> DataFrame:
    """Active matches (key, candidate, score, source): a manual one replaces all others of its release; imported identities,
    of confidence 100, stand beside each other and replace automatic ones."""
    hand = manual.select(key, "candidate", F.lit(100).alias("score"), F.lit("MANUAL").alias("source"))
    known = imported.select(key, "candidate", F.lit(100).alias("score"), F.lit("IMPORT").alias("source")).dropDuplicates([key, "candidate"]).join(manual.select(key).distinct(), key, "left_anti")
    rest = automatic.where("candidate IS NOT NULL").select(key, "candidate", F.col("score").cast("int").alias("score"), F.lit("AUTO").alias("source"))
    return hand.unionByName(known).unionByName(rest.join(manual.select(key), key, "left_anti").join(imported.select(key), key, "left_anti"))


def strict_rating(wanted_type: Column, wanted_key: Column, wanted_year: Column, media_type: Column, titles: Column, year: Column, value: Column, scale: Column, kind: Column) -> Column:
    """Whether a result may lend its rating: same type, a valid rating, known compatible years and an equal title key."""
    valid = value.isNotNull() & (scale > 0) & kind.isNotNull() & wanted_year.isNotNull() & year.isNotNull()
    return F.coalesce((media_type == wanted_type) & valid & ~year_incompatible(media_type == "TV_SERIES", wanted_year, year) & F.exists(titles, lambda t: key_of(t) == wanted_key), F.lit(False))


def may_keep_rating(source: Column, selected_source: Column, confidence: Column) -> Column:
    """A rating of another source than the selected one, whose match is not of low confidence."""
    return (selected_source.isNull() | (source != selected_source)) & (selected_source.isNull() | (F.coalesce(confidence, F.lit(0)) >= SURE))


def provider_choices(rows: DataFrame, key: str) -> DataFrame:
    """Rows (key, id, source, provider_id, selected, ...) once per id, or per source and provider id where there is none; selected ones first."""
    identity = F.coalesce(F.concat(F.lit("id:"), F.col("id").cast("string")), F.concat_ws(":", F.coalesce("source", F.lit("")), F.coalesce("provider_id", F.lit(""))))
    return top_per_key(rows.withColumn("_identity", identity), [key, "_identity"], [F.desc("selected"), F.asc("place")]).drop("_identity")


def canonical_results(raw: DataFrame) -> DataFrame:
    """Provider results (source, provider_id, title, original, aliases, language, region) in one form: ids without their source's
    prefix, title and locale keys, clean aliases."""
    bare = F.regexp_replace("provider_id", r"(?i)^(?:movie|series|tv|subject)[-/:]", "")
    return raw.withColumns({"provider_id": F.trim(bare), "title_key": key_of(F.col("title")), "locale_key": locale_key(F.col("language"), F.col("region")), "aliases": aliases(F.col("aliases"), F.col("title"), F.col("original"))})


def from_tmdb(rows: DataFrame) -> DataFrame:
    """TMDB-like records; a film's own names differ from a series'."""
    return rows.select(F.lit("tmdb").alias("source"), F.col("id").cast("string").alias("provider_id"), F.coalesce("title", "name").alias("title"), F.coalesce("original_title", "original_name").alias("original"), F.array().cast("array<string>").alias("aliases"), "language", "region", F.substring(F.coalesce("release_date", "first_air_date"), 1, 4).try_cast("int").alias("year"), F.when(F.col("votes") > 0, F.col("vote_average")).alias("rating"), F.lit(10).alias("rating_scale"))


def from_tvdb(rows: DataFrame, most: int = 8) -> DataFrame:
    """TVDB-like records of a query: rows without id or name go, the first `most` stay."""
    usable = top_per_key(rows.where("id IS NOT NULL AND trim(coalesce(name, '')) <> ''"), ["query"], [F.asc("position"), F.asc("id")], most)
    return usable.select("query", F.lit("tvdb").alias("source"), F.col("id").cast("string").alias("provider_id"), F.col("name").alias("title"), F.lit(None).cast("string").alias("original"), F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), "language", F.lit(None).cast("string").alias("region"), F.col("year").try_cast("int").alias("year"), F.lit(None).cast("double").alias("rating"), F.lit(10).alias("rating_scale"))


def smart_route(query: Column) -> Column:
    """How a free query is looked up: (kind, value). Identities of known providers are looked up exactly, a provider's name in
    front narrows the search, everything else is a broad search."""
    imdb, douban = F.regexp_extract(query, r"(?i)\b(tt\d{5,10})\b", 1), F.regexp_extract(query, r"(?i)douban\.com/(?:subject|movie)/(\d+)", 1)
    tmdb, tvdb = F.regexp_extract(query, r"(?i)(?:themoviedb\.org/(?:movie|tv)/|^tmdb:)(\d+)", 1), F.regexp_extract(query, r"(?i)(?:thetvdb\.com/\S*?(?:id=|series/)|^tvdb:)(\d+)", 1)
    hint = F.regexp_extract(query, r"(?i)^(tmdb|tvdb|imdb|douban)\s+(\S.*)$", 2)
    pair = lambda k, v: F.struct(F.lit(k).alias("kind"), v.alias("value"))
    return (
        F.when(imdb != "", pair("imdb", F.lower(imdb))).when(douban != "", pair("douban", douban)).when(tmdb != "", pair("tmdb", tmdb)).when(tvdb != "", pair("tvdb", tvdb))
        .when(hint != "", pair("hinted", F.trim(hint))).otherwise(pair("broad", F.trim(query)))
    )


def indexed_titles(catalogue: DataFrame, path: str) -> str:
    """Adds the title keys of catalogue(media_id, title) to the substring index at path."""
    substrings.add(catalogue.select("media_id", key_of(F.col("title")).alias("title_key")).distinct(), path, "media_id", "title_key")
    return path


def searched(queries: DataFrame, catalogue: DataFrame, query: str, index: str | None = None) -> DataFrame:
    """(query, media_id, kind) of what queries find in catalogue(media_id, title, provider, provider_id): by identity, else by the
    key of their words, which may stand inside words of the title key. A query whose identity is unknown finds nothing.

    index: the folder of the catalogue's index (indexed_titles); without one it is made for this search.
    """
    spark = queries.sparkSession
    routed = queries.withColumn("_route", smart_route(F.col(query))).select(query, "_route.kind", "_route.value")
    exact = routed.where("kind NOT IN ('hinted', 'broad')").join(catalogue, (F.col("kind") == F.col("provider")) & (F.col("value") == F.col("provider_id"))).select(query, "media_id", "kind")
    wanted = routed.where("kind IN ('hinted', 'broad')").withColumn("word", key_of(F.col("value")))
    hits = substrings.find(spark, index or indexed_titles(catalogue, scratch_folder(spark, "titles")), wanted.select("word").distinct(), "word")
    found = wanted.join(hits, "word").select(query, F.col("key").alias("media_id"), "kind")
    return exact.unionByName(found).distinct()
