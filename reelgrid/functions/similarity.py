"""Title similarity in array functions; scores are whole millionths, so engines agree to the last digit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MILLION = 1_000_000
# Tokens that do not count.
HONORIFICS = ["mr", "mrs", "ms", "miss", "dr"]
SEASON_WORDS = ["season", "series", "part", "cour"]


def bound(value: Column, use) -> Column:
    """use(value), with the value computed once: Spark computes what a lambda refers to anew for each element, but a lambda's own
    variable only once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def tokens(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda x: x != "")


def score_tokens(t: Column) -> Column:
    return F.filter(t, lambda x: ~x.isin(HONORIFICS))


def numbered(t: Column) -> Column:
    """Tokens with how many equal ones stand before each: sets of these intersect as the multisets do.

    Sorted, equal tokens stand together, and the count is the distance to the first of them.
    """
    return bound(F.array_sort(t), lambda o: F.transform(o, lambda x, i: F.concat(x, F.lit("#"), (i + 1 - F.array_position(o, x)).cast("string"))))


def numbered_dice(a: Column, b: Column) -> Column:
    """2 * |intersection| / (|a| + |b|) of numbered tokens; number them before a join, once per row."""
    shared = F.size(F.array_intersect(a, b)).cast("long")
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.floor(shared * 2 * MILLION / (F.size(a) + F.size(b))).cast("long")).otherwise(0)


def dice(a: Column, b: Column) -> Column:
    """2 * |multiset intersection| / (|a| + |b|)."""
    return numbered_dice(numbered(a), numbered(b))


def trigrams(c: Column) -> Column:
    places = lambda s: F.sequence(F.lit(1), F.greatest(F.length(s) - 2, F.lit(1)))
    each = lambda s: F.when(F.length(s) <= 3, F.array(s)).otherwise(F.transform(places(s), lambda i: F.substring(s, i, F.lit(3))))
    return bound(F.regexp_replace(c, r"\s+", ""), each)


def contains_window(long: Column, short: Column) -> Column:
    n = F.size(long) - F.size(short)
    starts = F.when((n >= 0) & (F.size(short) > 0), F.sequence(F.lit(1), n + 1)).otherwise(F.array().cast("array<int>"))
    return F.exists(starts, lambda i: F.slice(long, i, F.size(short)) == short)


def only_season(long: Column, short: Column, season: Column) -> Column:
    """Whether what the longer list has beyond the shorter is the season's number, with or without words for it."""
    rest = F.filter(F.array_except(long, short), lambda x: ~x.isin(SEASON_WORDS))
    return rest == F.array(season.cast("string"))


def containment(a: Column, b: Column, tv: Column | None = None, season: Column | None = None) -> Column:
    """One token list within the other, by how many tokens are left over; 0 if neither holds the other."""
    short, extra = F.least(F.size(a), F.size(b)), F.abs(F.size(a) - F.size(b))
    score = F.when(extra == 0, 1_000_000)
    if tv is not None:
        seasonal = F.when(F.size(a) > F.size(b), only_season(a, b, season)).otherwise(only_season(b, a, season))
        score = score.when(tv & season.isNotNull() & seasonal, 940_000)
    score = score.when((short >= 3) & (extra <= 1), 880_000).when((short >= 4) & (extra <= 2), 900_000).when((short >= 5) & (extra <= 4), 880_000).otherwise(800_000)
    return F.when(contains_window(a, b) | contains_window(b, a), score).otherwise(0).cast("long")


def title_parts(c: Column) -> Column:
    """What a normalised title is compared by: its tokens, and the numbered tokens and trigrams that count. Made once a title, before
    titles are joined."""
    def of(title: Column) -> Column:
        words = score_tokens(tokens(title))
        return F.struct(title.alias("title"), tokens(title).alias("tokens"), numbered(words).alias("words"), numbered(trigrams(F.array_join(words, " "))).alias("grams"))

    return bound(c, of)


def parts_similarity(a: Column, b: Column, tv: Column | None = None, season: Column | None = None) -> Column:
    """The largest of containment, token dice and 0.96 times trigram dice of two titles' parts."""
    grams = F.floor(numbered_dice(a.grams, b.grams) * 96 / 100).cast("long")
    return F.when(a.title == b.title, F.lit(MILLION).cast("long")).otherwise(F.greatest(containment(a.tokens, b.tokens, tv, season), numbered_dice(a.words, b.words), grams))


def title_similarity(a: Column, b: Column, tv: Column | None = None, season: Column | None = None) -> Column:
    """parts_similarity() of two normalised titles."""
    return parts_similarity(title_parts(a), title_parts(b), tv, season)


def candidate_score(t: Column, expected: Column, actual: Column, tv: Column, season: Column, episode: Column | None = None, boost: Column | None = None) -> Column:
    """Hundredths, rounded down, from the title similarity and the years. Without `boost` an unconfirmed season lifts no score."""
    boost = F.lit(True) if boost is None else boost
    numbered_episode = season.isNotNull() & (F.lit(False) if episode is None else episode.isNotNull())
    base = t * 78 / 100
    delta = F.abs(expected - actual)
    known = expected.isNotNull() & actual.isNotNull()
    moved = base + F.when(delta == 0, 200_000).when(delta == 1, 80_000).otherwise(-150_000)
    floored = F.when((delta == 0) & (t >= 940_000), F.greatest(moved, F.lit(930_000))).when((delta == 0) & (t >= 880_000), F.greatest(moved, F.lit(900_000)))
    floored = floored.when((delta == 0) & tv & season.isNotNull() & (t >= 860_000), F.greatest(moved, F.lit(880_000))).when(delta > 1, F.least(moved, F.lit(550_000))).otherwise(moved)
    series = F.when(tv & season.isNotNull() & (t >= 980_000) & expected.isNull() & boost, F.greatest(base, F.lit(880_000))).otherwise(base)
    earlier = F.when(boost & (delta == 1) & numbered_episode & (t >= 980_000), F.greatest(base, F.lit(900_000))).otherwise(base)
    score = F.when(known & tv & (expected > actual), earlier).when(known, floored).otherwise(series)
    return F.floor(F.greatest(F.lit(0), F.least(F.lit(MILLION), score)) / 10_000).cast("long")
