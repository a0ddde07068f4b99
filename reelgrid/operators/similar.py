"""Similar rows by an inverted join on rare tokens: exact for its threshold, without all pairs of a block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgrid.functions.similarity import MILLION, contains_window, numbered_dice
from reelgrid.sources.tables import kept


def classes(df: DataFrame, key: str, tokens: str) -> DataFrame:
    """(class, tokens, members) of rows with equal sets of tokens; rows without tokens are in none. A class is called after its least key."""
    return token_sets(df, key, tokens).where(F.size(tokens) > 0).groupBy(tokens).agg(F.min(key).alias("class"), F.count("*").alias("members"))


def token_sets(df: DataFrame, key: str, tokens: str) -> DataFrame:
    return df.select(key, F.array_sort(F.array_distinct(tokens)).alias(tokens))


def by_rarity(sets: DataFrame, key: str, tokens: str) -> DataFrame:
    """(key, tokens) with each row's tokens as structs (n, token) from the rarest of all rows to the most frequent."""
    each = sets.select(key, F.explode(tokens).alias("token"))
    often = each.groupBy("token").agg(F.count("*").alias("n"))
    return each.join(often, "token").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias(tokens))  # a row's own tokens


#: Longs of a set's sketch, and rows of a class that one task pairs with others.
WORDS, SHARE = 4, 1024


def sketch(tokens: Column) -> list[Column]:
    """A set's tokens as bits of some longs, by hash: a bit that another set lacks is a token that it lacks."""
    bit = lambda x, k: F.when(F.shiftright(F.xxhash64(x), 6).bitwiseAND(F.lit(WORDS - 1)) == k, F.call_function("shiftleft", F.lit(1).cast("long"), F.xxhash64(x).bitwiseAND(F.lit(63)).cast("int"))).otherwise(F.lit(0).cast("long"))
    word = lambda k: F.aggregate(tokens, F.lit(0).cast("long"), lambda bits, x: bits.bitwiseOR(bit(x, k)))
    return [word(k) for k in range(WORDS)]


def candidates(rare: DataFrame, key: str, tokens: str, least: int) -> DataFrame:
    """(short, long) of rows that may have a dice of `least` millionths: the short one has no more tokens than the long one.

    Sets of n <= m tokens and dice t share t * (n + m) / 2 of them at least, and m is at most n * (2 - t) / t. So of the short one a
    token among the first n - t * n + 1 in order of rarity is shared, of the long one among the first m - m * t / (2 - t) + 1: only
    these prefixes are joined. A shared token that is the i-th of n and the j-th of m leaves min(n - i, m - j) behind it and
    min(i, j) - 1 before; and behind the prefix that ends first in the order, no more can be shared than that row has left, beyond
    those counted in the prefixes. Pairs that cannot come to t * (n + m) / 2 by both bounds go before any set is read. The bits
    that one's sketch has and the other's lacks are tokens that are not shared, which leaves few pairs to be sent anywhere.
    """
    # Whole numbers, so that no pair is lost by rounding: a ceiling is taken of a quotient of integers.
    up = lambda a, b: F.expr(f"CAST(({a} + {b} - 1) DIV {b} AS INT)")
    bits = [f"bits{k}" for k in range(WORDS)]
    sized = rare.withColumns({"n": F.size(tokens), **dict(zip(bits, sketch(F.transform(tokens, lambda x: x.token)), strict=True))})
    short = sized.withColumn("prefix", F.col("n") - up(f"n * {least}L", f"{MILLION}L") + 1)
    long = sized.withColumn("prefix", F.col("n") - up(f"n * {least}L", f"{2 * MILLION - least}L") + 1)

    def posted(rows: DataFrame, name: str) -> DataFrame:
        last = F.element_at(tokens, F.col("prefix"))
        p = rows.select(F.col(key).alias(name), F.col("n").alias(f"{name}_n"), F.col("prefix").alias(f"{name}_prefix"), last.alias(f"{name}_last"), *(F.col(b).alias(f"{name}_{b}") for b in bits), F.posexplode(F.slice(tokens, F.lit(1), F.col("prefix"))).alias("i", "x"))
        return p.withColumn("token", F.col("x.token")).withColumn(f"{name}_at", F.col("i") + 1).drop("i", "x")

    need = up(f"(short_n + long_n) * {least}L", f"{2 * MILLION}L")
    order = (F.col("short_n") < F.col("long_n")) | ((F.col("short_n") == F.col("long_n")) & (F.col("short") < F.col("long")))
    met = posted(short, "short").join(posted(long, "long"), "token").where(order & (F.col("long_n").cast("long") * least <= F.col("short_n").cast("long") * (2 * MILLION - least)))
    met = met.where(F.least("short_at", "long_at") + F.least(F.col("short_n") - F.col("short_at"), F.col("long_n") - F.col("long_at")) >= need)
    lacking = lambda a, b: sum((F.bit_count(F.col(f"{a}_{k}").bitwiseAND(F.bitwise_not(F.col(f"{b}_{k}")))) for k in bits), F.lit(0))
    met = met.where((F.col("short_n") - lacking("short", "long") >= need) & (F.col("long_n") - lacking("long", "short") >= need))
    left = F.when(F.col("short_last") < F.col("long_last"), F.col("short_n") - F.col("short_prefix")).otherwise(F.col("long_n") - F.col("long_prefix"))
    found = met.withColumns({"left": left, "need": need}).groupBy("short", "long").agg(F.count("*").alias("shared"), F.first("left").alias("left"), F.first("need").alias("need"))
    return found.where("shared + left >= need").select("short", "long")


def class_pairs(sets: DataFrame, tokens: str, least: int) -> DataFrame:
    """(short, long, dice) of classes(class, tokens) with a dice of `least` millionths or more."""
    rare = kept(by_rarity(sets, "class", tokens), "rare")
    found = candidates(rare, "class", tokens, least)
    names = F.transform(tokens, lambda x: x.token)
    both = found.join(rare.select(F.col("class").alias("short"), names.alias("x")), "short").join(rare.select(F.col("class").alias("long"), names.alias("y")), "long")
    return both.select("short", "long", numbered_dice(F.col("x"), F.col("y")).alias("dice")).where(F.col("dice") >= least)


def pairs(df: DataFrame, key: str, tokens: str, least: int) -> DataFrame:
    """(left_id, right_id, dice) of rows whose sets of tokens have a dice of `least` millionths or more; left_id < right_id.

    Rows of equal sets are compared as one class; its pairs are made at the end, since this lists all pairs. Who wants
    groups takes classes() and class_pairs(). Sets without tokens are like none.
    """
    rows = kept(token_sets(df, key, tokens), "token-sets")  # computed once, not in each of the joins
    sets = kept(classes(rows, key, tokens), "classes")
    found = class_pairs(sets, tokens, least)
    own = kept(rows.withColumnRenamed(key, "id").join(sets.select("class", tokens), tokens).select("id", "class"), "members")
    same = sets.where("members > 1").select(F.col("class").alias("short"), F.col("class").alias("long"), F.lit(MILLION).cast("long").alias("dice"))
    return expanded(found.unionByName(same), own).select("left_id", "right_id", "dice")


def expanded(found: DataFrame, own: DataFrame) -> DataFrame:
    """found(short, long, ...) of classes as (left_id, right_id, ...) of their rows own(id, class); left_id < right_id. A class beside
    itself is the pairs within it.

    Pairs of rows are made in the last join and sent no further; a class of many rows is dealt over tasks of SHARE rows.
    """
    shares = own.groupBy(F.col("class").alias("long")).agg((F.count("*") / SHARE).cast("int").alias("last"))
    left = own.select(F.col("class").alias("short"), F.col("id").alias("a"))
    one = found.join(shares.hint("merge"), "long").join(left.hint("merge"), "short").withColumn("_share", F.pmod(F.xxhash64("a"), F.col("last") + 1).cast("int"))
    right = own.select(F.col("class").alias("long"), F.col("id").alias("b")).join(shares.hint("merge"), "long").select("long", "b", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("_share"))
    every = one.join(right.hint("merge"), ["long", "_share"]).where("short <> long OR a < b")
    more = [c for c in found.columns if c not in ("short", "long")]
    return every.select(F.least("a", "b").alias("left_id"), F.greatest("a", "b").alias("right_id"), *more)


def containing(df: DataFrame, tokens: str, parts: DataFrame, part: str) -> DataFrame:
    """Rows of df and of parts where the token list holds the part as a run: joined on the part's rarest token.

    Equal lists and equal parts meet once; their rows are joined to what was found, which no estimate of Spark's knows the size of.
    """
    lists = kept(df.select(tokens).distinct(), "lists")
    probe = lists.select(tokens, F.explode(F.array_distinct(tokens)).alias("token"))
    often = probe.groupBy("token").agg(F.count("*").alias("often"))
    each = parts.select(F.col(part).alias("_part")).distinct().select("_part", F.explode(F.array_distinct("_part")).alias("token")).join(often, "token")
    rarest = each.groupBy("_part").agg(F.min(F.struct("often", "token")).alias("r")).select("_part", F.col("r.token").alias("token"))
    found = probe.join(rarest.hint("merge"), "token").where(contains_window(F.col(tokens), F.col("_part"))).select(tokens, "_part")
    rows = found.join(df.hint("merge"), tokens)
    return rows.join(parts.hint("merge"), F.col("_part") == F.col(part)).select(*df.columns, *parts.columns)
