"""Records of a generator service that joins IMDb and Douban: identities, the common form, and its ladder of attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgrid.operators.rank import top_per_key

# The two sources, how a title's address looks in each, and the kinds that are asked for.
PAGES = {"imdb": "https://www.imdb.com/title/{}/", "douban": "https://movie.douban.com/subject/{}/"}
KINDS = {"MOVIE": "movie", "TV_SERIES": "tv"}
WIDE = "work"
SERIES = ["tv", "series", "anime"]
SCALE = 10


def first(values: Column, test) -> Column:
    return F.get(F.filter(values, test), F.lit(0))


def clean_list(*lists: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.filter(F.transform(F.concat(*(F.coalesce(x, none) for x in lists)), lambda v: F.trim(v)), lambda v: v.isNotNull() & (v != ""))


def imdb_id(raw: Column) -> Column:
    """tt and digits: of an address its first such folder, else the whole, with or without tt or imdb- in front."""
    text = F.lower(F.rtrim(F.trim(raw), F.lit("/")))
    folder = first(F.split(text, "[/?#]"), lambda p: p.rlike("^tt[0-9]+$"))
    bare = F.regexp_replace(F.coalesce(folder, text), "^imdb-", "")
    bare = F.when(bare.startswith("tt"), bare).otherwise(F.concat(F.lit("tt"), bare))
    return F.when(bare.rlike("^tt[0-9]+$"), bare)


def douban_id(raw: Column) -> Column:
    """Digits: of an address what follows a folder subject or movie, else the whole, with or without douban- in front."""
    text = F.rtrim(F.trim(raw), F.lit("/"))
    parts = F.split(F.lower(text), "[/?#]")
    behind = first(F.transform(parts, lambda p, i: F.when(p.isin("subject", "movie"), F.get(parts, i + 1))), lambda p: p.rlike("^[0-9]+$"))
    bare = F.regexp_replace(F.coalesce(behind, text), "(?i)^douban-", "")
    return F.when(bare.rlike("^[0-9]+$"), bare)


def source_id(source: Column, raw: Column) -> Column:
    return F.when(source == "imdb", imdb_id(raw)).when(source == "douban", douban_id(raw))


def identity(record_id: Column, source_ids: Column, sources: Column) -> Column:
    """(source, source_id, transient) of a record: by an id of its own kind (imdb-..., douban-...); by that of a work
    (work_imdb_...), where source_ids knows better; by the only id in source_ids; by the only source named. Null if none holds."""
    value = F.trim(record_id)
    of = lambda source, raw, transient: F.struct(source.alias("source"), source_id(source, raw).alias("source_id"), F.lit(transient).alias("transient"))
    kind, own = F.lower(F.split_part(value, F.lit("-"), F.lit(1))), F.regexp_replace(value, "^[^-]*-", "")
    canonical = F.when(kind.isin(*PAGES) & (own != value) & (own != ""), of(kind, own, False))
    work = F.split(F.regexp_replace(value, "(?i)^work[-_]", "work-"), "[-_]", 3)
    named = F.lower(F.get(work, F.lit(1)))
    listed = F.when(named == "imdb", source_ids.imdb).when(named == "douban", source_ids.douban)
    transitional = F.when((F.get(work, F.lit(0)) == "work") & named.isin(*PAGES) & F.get(work, F.lit(2)).isNotNull(), of(named, F.coalesce(listed, F.get(work, F.lit(2))), True))
    valid = lambda s: F.when(s.source_id.isNotNull(), s)
    imdb, douban = valid(of(F.lit("imdb"), source_ids.imdb, True)), valid(of(F.lit("douban"), source_ids.douban, True))
    only = F.when(douban.isNull(), imdb).when(imdb.isNull(), douban)
    both = F.filter(F.coalesce(sources, F.array().cast("array<string>")), lambda s: s.isin(*PAGES))
    single = F.when(F.size(both) == 1, F.when(F.get(both, F.lit(0)) == "imdb", imdb).otherwise(douban))
    return F.coalesce(valid(canonical), F.when(canonical.isNull(), valid(transitional)), F.when(canonical.isNull() & transitional.isNull(), F.coalesce(only, single)))


def year_in(c: Column) -> Column:
    """The first four digits in a row."""
    return F.nullif(F.regexp_extract(c.cast("string"), "([0-9]{4})", 1), F.lit("")).try_cast("int")


def number_in(c: Column) -> Column:
    """A finite number, else null."""
    n = F.nullif(F.trim(c.cast("string")), F.lit("")).try_cast("double")
    return F.when(~F.isnan(n) & (F.abs(n) < F.lit(float("inf"))), n)


def whole_in(c: Column) -> Column:
    n = number_in(c)
    return F.when(n >= 0, F.floor(n)).otherwise(F.ceil(n)).cast("long")


def preferred(titles: Column, aliases: Column, language: Column) -> Column:
    """The first title under a Chinese language, else the first with Latin letters, else the first."""
    every = clean_list(titles, aliases)
    latin = first(every, lambda v: v.rlike("[A-Za-z]"))
    return F.when(F.lower(language).startswith("zh"), F.get(every, F.lit(0))).otherwise(F.coalesce(latin, F.get(every, F.lit(0))))


def other_script(titles: Column, aliases: Column, title: Column, language: Column) -> Column:
    """The first other title in the other script: Latin under a Chinese language, else without Latin letters."""
    every, zh = clean_list(titles, aliases), F.coalesce(F.lower(language).startswith("zh"), F.lit(False))
    return first(every, lambda v: (v != title) & (v.rlike("[A-Za-z]") == zh))


def poster(path: Column, base: Column) -> Column:
    """A poster's address: whole ones as they are, others below the service's."""
    p = F.nullif(F.trim(path), F.lit(""))
    root = F.regexp_replace(base, "^([a-z]+://[^/]+).*$", "$1")
    below = F.when(p.startswith("/"), F.concat(root, p)).otherwise(F.concat(F.rtrim(base, F.lit("/")), F.lit("/"), p))
    return F.when(p.rlike("(?i)^https?://") | base.isNull(), p).otherwise(below)


def from_ptgen(hits: DataFrame) -> DataFrame:
    """Hits (query, position, id, source_ids, sources, titles, aliases, kind, wanted_type, year, release_date, rating_score, rating_votes,
    scores (by source: score, votes), description, poster, own_poster, base_url, language) in the common form; hits without an identity go.

    A transient record of several sources has the rating of its own source only; others have their own first.
    """
    known = hits.withColumn("_i", identity(F.col("id"), F.col("source_ids"), F.col("sources"))).where("_i.source_id IS NOT NULL")
    source, own = F.col("_i.source"), F.col("_i.source_id")
    score = F.when(source == "imdb", F.col("scores.imdb")).otherwise(F.col("scores.douban"))
    mixed = F.col("_i.transient") & (F.coalesce(F.size("sources"), F.lit(0)) > 1)
    rating = F.when(mixed, number_in(score.score)).otherwise(F.coalesce(number_in(F.col("rating_score")), number_in(score.score)))
    votes = F.when(mixed, whole_in(score.votes)).otherwise(F.coalesce(whole_in(F.col("rating_votes")), whole_in(score.votes)))
    title = F.coalesce(preferred(F.col("titles"), F.col("aliases"), F.col("language")), own)
    page = F.when(source == "imdb", F.concat(F.lit(PAGES["imdb"].split("{}")[0]), own, F.lit("/"))).otherwise(F.concat(F.lit(PAGES["douban"].split("{}")[0]), own, F.lit("/")))
    return known.select(
        "query", "position", F.concat(F.lit("ptgen_"), source).alias("source"), F.concat(source, F.lit("-"), own).alias("provider_id"),
        F.coalesce("wanted_type", F.when(F.lower("kind").isin(*SERIES), "TV_SERIES").otherwise("MOVIE")).alias("media_type"), title.alias("title"), other_script(F.col("titles"), F.col("aliases"), title, F.col("language")).alias("original"),
        clean_list(F.col("aliases")).alias("aliases"), "language", F.lit(None).cast("string").alias("region"), year_in(F.coalesce(F.col("year").cast("string"), "release_date")).alias("year"), rating.alias("rating"),
        F.when(rating.isNotNull(), SCALE).alias("rating_scale"), F.when(rating.isNotNull(), votes).alias("rating_votes"), "description", F.coalesce(poster(F.col("own_poster"), F.col("base_url")), "poster").alias("poster"), page.alias("page"),
    )


def from_legacy(records: DataFrame) -> DataFrame:
    """Older records (source, source_id, name, chinese_title, foreign_title, this_title, trans_title (lists), type, episodes, wanted_type, year, imdb_rating,
    imdb_votes, douban_rating, douban_votes, language) in the common form; records whose id is not valid go."""
    own = source_id(F.col("source"), F.col("source_id"))
    this, trans = F.get("this_title", F.lit(0)), F.get("trans_title", F.lit(0))
    pick = lambda *values: F.get(clean_list(F.array(*values)), F.lit(0))
    zh = F.coalesce(F.lower("language").startswith("zh"), F.lit(False))
    title = F.when(F.col("source") == "imdb", pick(F.col("name"), F.col("foreign_title"), this, F.col("chinese_title"))).when(zh, pick(F.col("chinese_title"), trans, F.col("foreign_title"), F.col("name"))).otherwise(pick(F.col("foreign_title"), F.col("name"), this, F.col("chinese_title")))
    title = F.coalesce(title, own)
    others = F.when(zh, clean_list(F.array(F.col("foreign_title"), F.col("name"), this))).otherwise(clean_list(F.array(F.col("chinese_title"), trans)))
    kind = F.lower("type")
    series = kind.isin("tvseries", "tvepisode") | (F.coalesce(kind != "movie", F.lit(True)) & (number_in(F.col("episodes")) > 0))
    media_type = F.when(F.coalesce(series, F.lit(False)), "TV_SERIES").when(kind == "movie", "MOVIE").otherwise(F.coalesce("wanted_type", F.lit("MOVIE")))
    rating = F.when(F.col("source") == "douban", number_in(F.col("douban_rating"))).otherwise(number_in(F.col("imdb_rating")))
    votes = F.when(F.col("source") == "douban", whole_in(F.col("douban_votes"))).otherwise(whole_in(F.col("imdb_votes")))
    return records.where(own.isNotNull()).select(
        F.concat(F.lit("ptgen_"), "source").alias("source"), F.concat("source", F.lit("-"), own).alias("provider_id"), media_type.alias("media_type"), title.alias("title"), first(others, lambda v: v != title).alias("original"), year_in(F.col("year")).alias("year"),
        rating.alias("rating"), F.when(rating.isNotNull(), SCALE).alias("rating_scale"), F.when(rating.isNotNull(), votes).alias("rating_votes"),
    )


def attempts(queries: DataFrame) -> DataFrame:
    """(query, attempt, kind, year) of queries(query, media_type, year): the kind with the year, without it, then any work with it and
    without; without a year two remain."""
    kind = F.when(F.col("media_type") == "TV_SERIES", KINDS["TV_SERIES"]).otherwise(KINDS["MOVIE"])
    none = F.lit(None).cast("int")
    one = lambda k, y: F.struct(k.alias("kind"), y.cast("int").alias("year"))
    ladder = F.array_distinct(F.array(one(kind, F.col("year")), one(kind, none), one(F.lit(WIDE), F.col("year")), one(F.lit(WIDE), none)))
    return queries.select("query", F.posexplode(ladder).alias("at", "a")).select("query", (F.col("at") + 1).alias("attempt"), "a.kind", "a.year")


def in_turn(queries: DataFrame, answers: DataFrame, most: int) -> DataFrame:
    """What the service's answers(query, kind, year, position, ...) hold for each query: all hits, up to `most`, of the first attempt that
    has any, with its number. Only a query's own attempts meet its answers; no later one is looked at.

    Both sides are rows multiplied by explode, of which Spark's estimate knows nothing: without the hints it would send them
    through the driver as broadcasts."""
    key = ["query", "kind"]
    tried = attempts(queries).withColumnRenamed("year", "_year")
    met = answers.join(tried.hint("merge"), key).where(F.col("year").eqNullSafe(F.col("_year"))).drop("_year")
    best = met.groupBy("query").agg(F.min("attempt").alias("_first"))
    return top_per_key(met.join(best.hint("merge"), "query").where("attempt = _first").drop("_first"), ["query"], [F.asc("position")], most)
