"""Fallback chains, reasons, candidates and the generator service's records, case by case."""

import pytest
from pyspark.sql import functions as F

from reelgrid.operators import presentation, ptgen

IDS = "id string, source_ids struct<imdb:string,douban:string>, sources array<string>"


@pytest.mark.parametrize(
    ("record", "want"),
    [
        (("imdb-tt012", (None, None), None), ("imdb", "tt012", False)),
        ((" Douban-77 ", (None, None), None), ("douban", "77", False)),
        (("imdb-012", (None, None), None), ("imdb", "tt012", False)),
        (("douban-x", ("tt1", None), None), None),
        (("work_imdb_5", (None, None), None), ("imdb", "tt5", True)),
        (("Work-douban-5", (None, "99"), None), ("douban", "99", True)),
        (("other", ("https://www.imdb.com/title/TT044/?a=1", None), None), ("imdb", "tt044", True)),
        (("other", (None, "https://movie.douban.com/subject/123/"), None), ("douban", "123", True)),
        (("other", ("tt1", "2"), ["douban"]), ("douban", "2", True)),
        (("other", ("tt1", "2"), ["imdb", "douban"]), None),
        ((None, (None, None), None), None),
        (("", ("nonsense", None), None), None),
    ],
)
def test_identities(spark, record, want):
    got = spark.createDataFrame([record], IDS).select(ptgen.identity(F.col("id"), F.col("source_ids"), F.col("sources")).alias("x")).first().x
    assert (None if got is None else tuple(got)) == want


def test_values(spark):
    f = spark.createDataFrame([("2011-05",), ("x1999y2001",), ("7.9",), ("-3.7",), ("NaN",), ("Infinity",), ("",), (None,), ("99",)], "v string")
    got = [tuple(r) for r in f.select(ptgen.year_in(F.col("v")), ptgen.number_in(F.col("v")), ptgen.whole_in(F.col("v"))).collect()]
    assert got == [(2011, None, None), (1999, None, None), (None, 7.9, 7), (None, -3.7, -3), (None, None, None), (None, None, None), (None, None, None), (None, None, None), (None, 99.0, 99)]
    base = spark.createDataFrame([("/p.jpg", "https://a/b/"), ("p.jpg", "https://a/b"), ("HTTP://z/p", "https://a"), (" ", "https://a"), ("x", None)], "p string, b string")
    assert [r[0] for r in base.select(ptgen.poster(F.col("p"), F.col("b"))).collect()] == ["https://a/p.jpg", "https://a/b/p.jpg", "HTTP://z/p", None, "x"]


def test_legacy_records(spark):
    rows = [
        ("imdb", "0044", "Name", "中名", "Foreign", ["This"], ["译名"], "TVSeries", None, None, "2004-01", "8.1", "1200", "9", "7", "en"),
        ("douban", "subject/9", "Name", "中名", None, [], ["译名"], None, "12", "MOVIE", "1999", None, "5", "7.5", "33.9", "zh-CN"),
        ("douban", "10", None, "中名", None, None, None, "Movie", "12", None, None, None, None, None, "5", "en"),
        ("douban", "bad", "x", None, None, None, None, None, None, None, None, None, None, None, None, None),
        ("imdb", "tt5", None, None, " ", None, None, None, None, None, None, "x", None, None, None, None),
    ]
    names = "source string, source_id string, name string, chinese_title string, foreign_title string, this_title array<string>, trans_title array<string>, type string, episodes string, wanted_type string, year string, imdb_rating string, imdb_votes string, douban_rating string, douban_votes string, language string"
    got = [tuple(r) for r in ptgen.from_legacy(spark.createDataFrame(rows, names)).collect()]
    assert got == [
        ("ptgen_imdb", "imdb-tt0044", "TV_SERIES", "Name", "中名", 2004, 8.1, 10, 1200), ("ptgen_douban", "douban-9", "TV_SERIES", "中名", "Name", 1999, 7.5, 10, 33),
        ("ptgen_douban", "douban-10", "MOVIE", "中名", None, None, None, None, None), ("ptgen_imdb", "imdb-tt5", "MOVIE", "tt5", None, None, None, None, None),
    ]


def test_attempts(spark):
    asked = spark.createDataFrame([("a", "TV_SERIES", 2001), ("b", "MOVIE", None), ("c", None, 5)], "query string, media_type string, year int")
    got = sorted((r.query, r.attempt, r.kind, r.year) for r in ptgen.attempts(asked).collect())
    assert got == [("a", 1, "tv", 2001), ("a", 2, "tv", None), ("a", 3, "work", 2001), ("a", 4, "work", None), ("b", 1, "movie", None), ("b", 2, "work", None), ("c", 1, "movie", 5), ("c", 2, "movie", None), ("c", 3, "work", 5), ("c", 4, "work", None)]
    answers = spark.createDataFrame([("a", "work", 2001, 2, "x"), ("a", "work", 2001, 1, "y"), ("a", "work", None, 1, "z"), ("a", "movie", 2001, 1, "no"), ("b", "work", None, 1, "w"), ("d", "tv", None, 1, "other")], "query string, kind string, year int, position int, hit string")
    assert sorted((r.query, r.attempt, r.hit) for r in ptgen.in_turn(asked, answers, 5).collect()) == [("a", 3, "x"), ("a", 3, "y"), ("b", 2, "w")]
    assert [(r.query, r.hit) for r in ptgen.in_turn(asked, answers, 1).where("query = 'a'").collect()] == [("a", "y")]


def test_attention(spark):
    rows = [("UNMATCHED", "no_result", "AUTO", None, False, True), ("MATCHED", "automatic_match", "AUTO", 87, True, False), ("MATCHED", "automatic_low_confidence_match", "MANUAL", 99, False, None), ("MATCHED", None, "MANUAL", 10, True, False), (None, None, None, None, None, True), ("UNMATCHED", "strange", None, None, None, None)]
    f = spark.createDataFrame(rows, "status string, reason string, source string, confidence int, cover boolean, failed boolean")
    got = [r[0] for r in f.select(presentation.attention(*(F.col(c) for c in f.columns))).collect()]
    assert got == [["failed_download", "unmatched", "no_result", "no_cover"], ["low_confidence"], ["low_confidence", "no_cover"], [], [], ["unmatched", "no_cover"]]


def test_resolutions_and_pages(spark):
    rows = [(720, "1080p", "x 2160p"), (None, " 4K ", "x"), (None, "1080", "x"), (None, "WEB-DL", "Some.720p.4k"), (None, None, "x_1080p 480P"), (None, None, None)]
    f = spark.createDataFrame(rows, "r int, q string, t string")
    assert [r[0] for r in f.select(presentation.resolution_of(F.col("r"), F.col("q"), F.col("t"))).collect()] == [720, 2160, 1080, 720, 480, None]
    pages = spark.createDataFrame([(2, 1, "a"), (1, 1, "b"), (1, 2, "a"), (2, 2, "c")], "page int, place int, k string")
    assert [(r.k, r.page) for r in presentation.merged_pages(pages, "k", "page", "place").collect()] == [("b", 1), ("a", 1), ("c", 2)]


def test_presented_without_metadata(spark):
    titles = spark.createDataFrame([(1, None, None, None, None, 1999, "Raw"), (2, None, "MOVIE", None, None, None, None)], "media_id long, title string, media_type string, year int, release_title string, release_year int, raw_title string")
    none = spark.createDataFrame([], "media_id long, provider string, provider_source string, provider_id string, selected boolean, place int, title string, original_title string, year int, overview string, poster string, backdrop string, rating double, rating_scale int, rating_votes long, rating_type string, fetched_at long")
    got = {r.media_id: (r.title, r.media_type, r.year, r.has_cover, r.rating) for r in presentation.presented(titles, none, "x").collect()}
    assert got == {1: ("Raw", "UNKNOWN", 1999, False, None), 2: ("Unknown", "MOVIE", None, False, None)}


def test_answers_stay_off_the_driver(spark):
    asked = spark.createDataFrame([("a", "MOVIE", 2001)], "query string, media_type string, year int")
    answers = spark.createDataFrame([("a", "movie", 2001, 1)], "query string, kind string, year int, position int")
    assert "BroadcastExchange" not in ptgen.in_turn(asked, answers, 2)._jdf.queryExecution().executedPlan().toString()
