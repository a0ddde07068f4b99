"""Searches by the substring index, rules of regular expressions by their literals, filtered pages, and titles parsed anew where stale."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelgrid.functions import release
from reelgrid.operators import catalogue, matching, pages, patterns, substrings
from reelgrid.operators.derived import Derived
from reelgrid.plans.catalog import ALIASES, title_aliases
from reelgrid.sources.tables import feeds, items, matches, media, oracle, scratch_folder, table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


#: What is searched for: parts of words, over their borders, in capitals, one and two letters, a word that is nowhere.
WORDS = ["mal", "ALL RIN", "ing", "idge", "e w", "w", "ed", "red widget", "quartz", "the old"]
LISTED = f"(VALUES {', '.join(f'({w!r})' for w in WORDS)}) v(word)"


def words(spark):
    return spark.createDataFrame([(w,) for w in WORDS], "word string")


@query(oracle(f"SELECT DISTINCT word, media_id FROM {LISTED} JOIN (SELECT media_id, title AS name FROM media UNION ALL SELECT media_id, alias FROM alias) n ON contains(lower(name), lower(word))", "," + ALIASES))
def inside_words(spark, d):
    """Titles of which the name or an alias holds a word, also inside its words."""
    index = scratch_folder(spark, "names")
    substrings.add(media(spark, d).select("media_id", F.col("title").alias("name")), index, "media_id", "name")
    substrings.add(title_aliases(spark, d), index, "media_id", "alias")
    return substrings.find(spark, index, words(spark), "word").select("word", F.col("key").alias("media_id"))


@query(oracle(f"""SELECT DISTINCT word, release_id, line, feed_id, media_id, qty FROM {LISTED} JOIN (SELECT i.*, title, feed_name FROM items i JOIN media USING (media_id) JOIN feeds USING (feed_id)) i ON contains(lower(title), lower(word))
OR contains(lower(feed_name), lower(word)) OR contains(lower(coalesce(release_group, '')), lower(word)) OR EXISTS (SELECT 1 FROM alias a WHERE a.media_id = i.media_id AND contains(lower(alias), lower(word)))""", "," + ALIASES))  # fmt: skip
def items_by_word(spark, d):
    """Items whose title, any alias, feed or release group holds a word: one index of all names, each under the kind of its key."""
    index, every = scratch_folder(spark, "fields"), items(spark, d)
    kind = lambda k, c: F.concat(F.lit(k), F.col(c).cast("string")).alias("key")
    names = [
        media(spark, d).select(kind("m", "media_id"), F.col("title").alias("name")), title_aliases(spark, d).select(kind("m", "media_id"), F.col("alias").alias("name")),
        feeds(spark, d).select(kind("f", "feed_id"), F.col("feed_name").alias("name")), every.select(kind("g", "release_group"), F.col("release_group").alias("name")).distinct(),
    ]
    for n in names:
        substrings.add(n, index, "key", "name")
    hit = substrings.find(spark, index, words(spark), "word")
    keyed = every.withColumn("key", F.explode(F.array_compact(F.array(kind("m", "media_id"), kind("f", "feed_id"), kind("g", "release_group")))))
    return keyed.join(hit, "key").select("word", "release_id", "line", "feed_id", "media_id", "qty").distinct()


@query(oracle("SELECT q AS query, media_id, 'broad' AS kind FROM (VALUES ('mal'), ('ing'), ('mall ring'), ('d widge')) v(q) JOIN media ON contains(trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')), q)"))
def smart_search_inside(spark, d):
    """Free queries whose words are parts of words, by the index of title keys."""
    known = media(spark, d).select("media_id", "title", F.lit("tmdb").alias("provider"), F.col("media_id").cast("string").alias("provider_id"))
    index = matching.indexed_titles(known, scratch_folder(spark, "titles"))
    return matching.searched(spark.createDataFrame([("mal",), ("ing",), ("mall ring",), ("d widge",)], "query string"), known, "query", index)


PATTERN = """CASE c_custkey % 7 WHEN 0 THEN 'Widget|r.ng' WHEN 1 THEN '(large|small) (bolt|ring)$' WHEN 2 THEN '^o.*e' WHEN 3 THEN 'hot +[a-f]' WHEN 4 THEN 'gi?zmo' WHEN 5 THEN 'RED w+' END"""


@query(f"""WITH rule AS (SELECT c_custkey AS rule_id, c_nationkey % 5 AS tenant_id, {PATTERN} AS pattern FROM customer WHERE c_custkey % 10 = 3), title AS (SELECT p_partkey AS media_id, p_partkey % 5 AS tenant_id, p_name AS title FROM part)
SELECT rule_id, media_id FROM rule JOIN title USING (tenant_id) WHERE regexp_matches(title, '(?i)' || pattern)""")  # fmt: skip
def regex_rules(spark, d):
    """Rules of regular expressions and the titles of their tenant that they match."""
    rules = table(spark, d, "customer").where("c_custkey % 10 = 3").select(F.col("c_custkey").alias("rule_id"), (F.col("c_nationkey") % 5).alias("tenant_id"), F.expr(PATTERN).alias("pattern"))
    titles = table(spark, d, "part").select(F.col("p_partkey").alias("media_id"), (F.col("p_partkey") % 5).alias("tenant_id"), F.col("p_name").alias("title"))
    return patterns.matching_pairs(titles, rules, "tenant_id", "title", "rule_id", "pattern", ["media_id"]).select("rule_id", "media_id")


PAGE = ["first_seen", "release_id", "line", "feed_id", "qty", "size_bytes"]
CURSOR = ("1998-01-01 00:00:00", 10**9, 9, 10**9, 10**9, 10**12)


@query(oracle("SELECT first_seen, release_id, line, feed_id, qty, size_bytes, title FROM items JOIN feeds USING (feed_id) JOIN media USING (media_id) WHERE tenant_id = 3 AND first_seen <= DATE '1998-01-01' AND contains(title, 'hot') AND qty > 45 ORDER BY first_seen DESC, release_id DESC, line DESC, feed_id DESC, qty DESC, size_bytes DESC LIMIT 41"))
def filtered_page(spark, d):
    """A page of forty of a tenant's items behind a cursor that pass a filter, and one more, from a table laid out by tenant and time."""
    path = scratch_folder(spark, "pages") + "/items"
    rows = items(spark, d).join(feeds(spark, d).select("feed_id", "tenant_id"), "feed_id").join(media(spark, d).select("media_id", "title"), "media_id")
    pages.lay_out(rows.select("tenant_id", "title", *PAGE), path, "tenant_id", PAGE, 64)
    return pages.page(spark, path, 3, PAGE, 40, F.contains("title", F.lit("hot")) & (F.col("qty") > 45), CURSOR).select(*PAGE, "title")


PARSED = "media_id long, title string, year int, media_type string, quality string, source string, codec string, release_group string, confidence int"


@query("""WITH runs AS (SELECT p_partkey AS media_id, unnest([1, 2, 3]) AS run FROM part)
SELECT run, media_id, CASE WHEN run = 1 THEN 'created' WHEN media_id % 11 = 5 THEN 'gone' WHEN media_id % 7 = 0 THEN 'changed' ELSE 'unchanged' END AS outcome FROM runs
WHERE run = 1 OR run = 2 AND (media_id % 11 = 5 OR media_id % 7 IN (0, 1))""")  # fmt: skip
def reparse_stale(spark, d):
    """What three runs over stored parses do: all are made; then those whose raw title changed (also in a way that parses alike) and
    those that went; then, with nothing new, none."""
    k = F.col("p_partkey")
    raw = lambda spelled, size: F.concat(F.col("p_name"), F.lit(" "), (1980 + F.col("p_size")).cast("string"), spelled, size, F.lit(" WEB-DL x264-GRP"))
    first = table(spark, d, "part").select(k.alias("media_id"), raw(F.lit(" "), F.lit("1080p")).alias("raw_title"))
    second = table(spark, d, "part").where(k % 11 != 5).select(k.alias("media_id"), raw(F.when(k % 7 == 1, "_").otherwise(" "), F.when(k % 7 == 0, "2160p").otherwise("1080p")).alias("raw_title"))
    names = [c.split()[0] for c in PARSED.split(", ")]
    stored = Derived(spark, scratch_folder(spark, "parsed"), PARSED, "media_id", lambda rows: release.parse(rows, "raw_title").select(*names), "parser-1", names[1:])
    runs = [stored.refresh(rows).select(F.lit(i + 1).alias("run"), "media_id", "outcome") for i, rows in enumerate((first, second, second))]
    return runs[0].unionByName(runs[1]).unionByName(runs[2])


RELEASES = PARSED.replace("media_id", "release_id")


@query(oracle("""SELECT release_id, status, CASE WHEN NOT invalidated AND release_id % 7 = 0 AND release_id % 2 = 0 THEN 'parsed_release_changed' END AS stale_reason, invalidated OR release_id % 7 = 0 AND release_id % 2 = 0 AS is_stale FROM matches"""))
def reparse_matches(spark, d):
    """Matches after a reparse: the active ones of releases that parse otherwise now are invalidated; of the raw titles that changed,
    half parse as before. A rebuild beside the stored parses then changes nothing that is read."""
    k = F.col("o_orderkey")
    raw = lambda quality, gap: table(spark, d, "orders").select(k.alias("release_id"), F.concat(F.lit("Order K"), k.cast("string"), gap, F.lit("1999 "), quality, F.lit(" WEB-DL x264-GRP")).alias("raw_title"))
    names = [c.split()[0] for c in RELEASES.split(", ")]
    stored = Derived(spark, scratch_folder(spark, "releases"), RELEASES, "release_id", lambda rows: release.parse(rows, "raw_title").select(*names), "parser-1", names[1:])
    stored.refresh(raw(F.lit("1080p"), F.lit(" ")))
    now = raw(F.when((k % 7 == 0) & (k % 2 == 0), "720p").otherwise("1080p"), F.when((k % 7 == 0) & (k % 2 == 1), "_").otherwise(" "))
    changed = stored.refresh(now).where("outcome = 'changed'")
    stored.rebuild(now)
    same = stored.read().select("release_id").join(changed, "release_id")  # what was swapped in holds all of them
    m = matches(spark, d).select("release_id", "status", F.when(F.col("invalidated"), F.col("updated_at")).alias("invalidated_at"), F.lit(None).cast("string").alias("stale_reason"))
    at = F.lit("2024-01-01 00:00:00").cast(m.schema["invalidated_at"].dataType)
    return catalogue.invalidated(m, same, "release_id", at, "parsed_release_changed").select("release_id", "status", "stale_reason", F.col("invalidated_at").isNotNull().alias("is_stale"))
