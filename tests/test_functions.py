from pyspark.sql import functions as F

from reelgrid.functions import release, similarity, text
from reelgrid.operators import acquisition, merge, rules


def one(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items()))
    return frame.select(column.alias("x")).first().x


def test_sizes(spark):
    for shown, want in (("1.5 GB", 1610612736), ("700 MiB", 734003200), ("3 B", 3), ("0.1 KB", 102), ("12", None), ("x GB", None)):
        assert one(spark, text.human_size(F.col("s")), s=shown) == want


def test_secrets(spark):
    assert one(spark, text.redact(F.col("s")), s="http://a/?TOKEN=abc&x=1") == "http://a/?TOKEN=[REDACTED]&x=1"
    assert one(spark, text.redact(F.col("s")), s="passkey_abcdefgh1") == "passkey_[REDACTED]"


def test_title_keys(spark):
    assert one(spark, text.title_key(F.col("s")), s="Amélie  (2001)!") == "amelie 2001"
    assert one(spark, text.score_key(F.col("s")), s="It’s Us & Them") == "its us and them"


def test_dates(spark):
    got = [str(one(spark, text.rss_date(F.col("s")), s=v)) for v in ("Tue, 2 Jan 2024 03:04:05 +0000", "2024-01-02T03:04:05Z", "soon")]
    assert got == ["2024-01-02 03:04:05", "2024-01-02 03:04:05", "None"]


def test_similarity(spark):
    a, b = F.col("a"), F.col("b")
    assert one(spark, similarity.title_similarity(a, b), a="the big film", b="the big film") == 1_000_000
    assert one(spark, similarity.title_similarity(a, b), a="the big film", b="the big film two") == 880_000
    assert one(spark, similarity.dice(similarity.tokens(a), similarity.tokens(b)), a="x x y", b="x y z") == 666_666
    assert one(spark, similarity.dice(similarity.tokens(a), similarity.tokens(b)), a="", b="x") == 0


def test_unit_keys(spark):
    n = lambda v: F.lit(v).cast("int")
    s = lambda v: F.lit(v).cast("string")
    key = lambda *v: one(spark, acquisition.unit_key(s(v[0]), n(7), *(n(x) for x in v[1:5]), *(s(x) for x in v[5:])), a=1)
    assert key("MOVIE", None, None, None, None, None, None) == "movie:7"
    assert key("TV_SERIES", 2026, 3, 5, None, "pure", "02") == "tv:7:s2026:e03-e05:variant:PURE:part:2"
    assert key("TV_SERIES", 1, None, None, 4, None, None) == "tv:7:s01:sp:4"
    assert key("TV_SERIES", None, 3, None, None, None, None) is None


def test_fold(spark):
    rows = [("k", i, f, r) for i, (f, r) in enumerate([(1, 720), (2, 1080), (1, 1080), (1, 1080), (2, 2160), (1, None)])]
    df = spark.createDataFrame(rows, "key string, at int, feed int, resolution int").withColumns({"rank": F.lit(0), "seed": F.lit(True), "up": F.lit(True)})
    out = acquisition.fold(df, ["key"], [F.asc("at")], "feed", "resolution", "rank", "seed", "up").orderBy("at").collect()
    assert [r.action for r in out] == ["SATISFY", "CROSS_SEED", "UPGRADE", "REJECT", "UPGRADE", "REJECT"]
    assert [r.held_resolution for r in out] == [720, 720, 1080, 1080, 2160, 2160]


def test_normal_values(spark):
    v = F.col("v")
    assert one(spark, rules.normal_source(v), v="web-dl") == "WEB-DL"
    assert one(spark, rules.normal_codec(v), v="HEVC") == "H.265"
    assert [one(spark, rules.normal_resolution(v), v=x) for x in ("4K", "720p", "1080i")] == [2160, 720, None]
    assert one(spark, rules.normal_variant(v), v="纯享版") == "PURE"


def test_merge_keeps_null_keys(spark):
    a = spark.createDataFrame([("x", 1), (None, 2)], "k string, n int")
    b = spark.createDataFrame([("x", 3), (None, 4), ("y", 5)], "k string, n int")
    assert sorted(r.n for r in merge.merge_keyed(a, b, ["k"], [F.desc("n")]).collect()) == [2, 3, 4, 5]
