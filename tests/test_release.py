"""Parsed titles by cases: raw title, what it says, and the titles it may mean."""

from pyspark.sql import functions as F

from reelgrid.functions import release
from reelgrid.functions.titles import titles_of

CASES = [
    ("Quiet.River.2021.2160p.WEB-DL.DDP5.1.H.265-ABC", dict(title="Quiet River", year=2021, media_type="MOVIE", quality="2160p", resolution=2160, source="WEB-DL", codec="H.265", audio="DDP5.1", release_group="ABC", confidence=85)),
    ("[Site] Some.Show.S02E05-E07.1080p.HDTV.x264-GRP", dict(title="Some Show", season=2, episode=5, episode_end=7, tv_unit_type="EPISODE", media_type="TV_SERIES", source="HDTV")),
    ("Old Doctor 2004 S00E09E13E14 Anniversary 1080p Blu-ray AVC DTS-HD MA 5.1-XYZ", dict(title="Old Doctor", year=2004, season=0, episode=9, episode_end=14, source="BluRay", audio="DTS-HD")),
    ("S2026E11 0 1080p WEB-DL AAC2.0 H.264-BTN", dict(title="S2026E11 0", media_type="UNKNOWN", season=None, episode=None, audio="AAC2.0")),
    ("Night.Watch.S2026E41.2010.2160p.WEB-DL-AB", dict(title="Night Watch", season=2026, episode=41, year=2010)),
    ("Some Show S01SP02 720p", dict(special_number=2, season=1, episode=None, tv_unit_type="SPECIAL")),
    ("Other.Show.Season.3.HDTV", dict(title="Other Show", season=3, episode=None, media_type="TV_SERIES", tv_unit_type=None)),
    ("Other.Show.S04.1080p.BluRay.x265-GRP", dict(season=4, episode=None)),
    ("Show Name S01E1234 720p HDTV", dict(season=1, episode=1234)),
    ("Show.Name.EP07-EP08.1920x1080.WEB.DD+5.1-GRP", dict(season=1, episode=7, episode_end=8, quality="1080p", resolution=1080, audio="DD+5.1")),
    ("Some.Show.S01E02.Part2.PLUS.2023.1080p.WEB-DL-GRP", dict(episode_part="2", variant="PLUS", year=2023)),
    ("Some.Show.S01E02.Plus.Minus.1080p.WEB-DL-GRP", dict(episode_part=None, variant=None)),
    ("Some.Show.S01E02.纯享版.1080p.WEB-DL-GRP", dict(variant="PURE")),
    ("[电影][香港][金山][The.Gold.Hill.1969.1080p.BluRay.x265.DTS-HD-WiKi][The Gold Hill | 类型： 动作][9.34 GiB][]", dict(title="The Gold Hill", year=1969, media_type="MOVIE", codec="H.265", release_group="WiKi")),
    ("[综艺][2021][克拉的农场][][英语][92.58 GiB]", dict(title="克拉的农场", year=2021)),
    ("[Anime][TV][Group][星之声][Voice of Stars][01-12 fin][1080p]", dict(title="Voice of Stars", episode=1, episode_end=12, media_type="TV_SERIES")),
    ("[Anime][TV][星之声][Voice of Stars][07]", dict(title="Voice of Stars", episode=7)),
    ("[Music] Band Live 1999 FLAC-GRP", dict(media_type="UNKNOWN", year=1999)),
    ("[Movies] Quiet River 1080p BluRay", dict(media_type="MOVIE", title="Quiet River")),
    ("[TV Series]CCTV-3 Opera Night S01E05 1080p HDTV x264-AAA", dict(title="Opera Night", season=1, episode=5)),
    ("Jade Old Town III EP05 1080p HDTV-TVB", dict(title="Old Town", season=3, episode=5)),
    ("Jade Empire 2005 1080p WEB-DL-AA", dict(title="Jade Empire", media_type="MOVIE")),
    ("1917.2019.1080p.BluRay.x264-XYZ", dict(title="1917", year=2019)),
    ("Old Film [1984] by Jane Roe [Old.Film.1985.1080p.BluRay.x264-GRP]", dict(title="Old Film", year=1984)),
    ("Old Film [1954] by Jane Roe [New.Thing.1985.1080p.BluRay.x264-GRP]", dict(year=1985)),
    ("山河 第二季 第3-5集 2160p WEB-DL", dict(title="山河", season=2, episode=3, episode_end=5)),
    ("某剧 第十二集 1080p", dict(season=1, episode=12, media_type="TV_SERIES")),
    ("[电视剧][全24集][山河故事][12 GB]", dict(media_type="TV_SERIES", season=None)),
    ("[电视剧][全1集][山河故事][12 GB]", dict(media_type="UNKNOWN")),
    ("Quiet_River_1999_PROPER_720p.mkv", dict(title="Quiet River", year=1999, quality="720p")),
    ("nothing here", dict(title="nothing here", media_type="UNKNOWN", confidence=35, year=None)),
    ("", dict(title=None, media_type="UNKNOWN", confidence=0)),
    (None, dict(title=None)),
]


def test_cases(spark):
    rows = release.parse(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "i int, raw string"), "raw", 2027).collect()
    got = {r.i: r.asDict() for r in rows}
    wrong = [(t, k, got[i][k], v) for i, (t, want) in enumerate(CASES) for k, v in want.items() if got[i][k] != v]
    assert not wrong


def test_titles():
    of = lambda *x: titles_of(*x)[:3]
    assert of("Two Lakes AKA Zwei Seen", "x", "Two Lakes AKA Zwei Seen") == ("Two Lakes", ["Two Lakes", "Zwei Seen"], ["Zwei Seen"])
    assert of("某剧 Some Show", "某剧 Some Show [某剧二 | 类型： 动作][香港][1080p]", "某剧 Some Show") == ("Some Show", ["某剧", "Some Show", "某剧 Some Show", "某剧二", "香港"], ["某剧", "某剧 Some Show", "某剧二"])
    assert of("1984", "[1984][大洋国]", "1984")[0] == "大洋国"
    assert of("Quiet River", "[12 GB][英语][Quiet River]", "Quiet River") == ("Quiet River", ["Quiet River"], [])
    assert titles_of(None, None, None) == (None, [], [], None)


#: Raw titles whose brackets hold more than titles, and what they may be searched for.
FIELDS = [
    ("The Red Orchid", "[电视剧 (TV Series)]CCTV-8 The Red Orchid 2026 S01E14-E15 1080i HDTV-AA[中央电视台电视剧频道 红兰 第14-15集【AVS+卫星源码｜高码率】【导演：某人 | 主演：某某】]", ["红兰"]),
    ("Vocalist 2026", "[TV Shows/综艺]HunanTV Vocalist 2026 20260612 HDTV 1080i H264-BB[湖南卫视 歌者2026 20260612][8.26 GB][anonymous]", ["歌者2026", "歌者"]),
    ("Night Gate", "[电影][夜门][Night.Gate.1976.BluRay.1080p.x265-CC][动作][华语][导演: 某某 主演: 甲 / 乙|转自CCGROUP|如有侵权请立刻联系删除][6.04 GiB]", ["夜门"]),
    ("So Into Tea", "[综艺]So Into Tea S06E04 2026 2160p WEB-DL H265 AAC-DD[茶香你我 第六季 正片 第02期上 嘉宾来了 | 茶香你我 旅行季 *某平台*][1.58 GB][国语 | 中字 | 官方]", ["茶香你我", "茶香你我 旅行季"]),
    ("Ai Chang Hui", "[综艺]Ai Chang Hui S2026E58 2010 1080p WEB-DL-DD[爱唱会 2026年度 正片 又见老友？ *某平台*][376.62 MB]", ["爱唱会"]),
    ("Young Summer", "[综艺]Young Summer S01E01 2026 1080p WEB-DL-AD[少年长夏 第一季 同学录 同学录：现场！ *某平台*][209.20 MB]", ["少年长夏"]),
    ("Marta", "[剧集]Marta S01 1080p WEB-DL-EE[Marta Lunghi  [第一季] / Marta: A Coastal Inspector | 2022][24.27 GB][anonymous][完结]", ["Marta Lunghi", "Marta: A Coastal Inspector"]),
    ("11/11/11", "11/11/11 2011 UNCUT 1080p-AA", []),
    ("The Clinic AU", "[剧集]The Clinic AU S01 1080p-AA[The Clinic (AU) | 诊所][2 GB]", ["诊所", "The Clinic"]),
    ("Old Town", "[剧集]Old Town[短剧：老城故事 全24集][翡翠台]", ["老城故事"]),
    ("Harbour", "[剧集][港剧]Harbour 2020 1080p-AA[原创录制 翡翠台][翡翠台 4K][压制组 某字幕社][港湾第二季][香港]", ["港湾"]),
]


def test_titles_among_fields():
    wrong = [(raw, titles_of(head, raw, head)[2], want) for head, raw, want in FIELDS if titles_of(head, raw, head)[2] != want]
    assert not wrong


def test_lists_sent_to_functions_are_not_null(spark):
    """Of null lists Spark's Arrow writer walks through all before it, at each row of a batch."""
    plan = release.parse(spark.createDataFrame([("Some.Show.S01E02.1080p.WEB-DL",), (None,)], "raw STRING"), "raw")._jdf.queryExecution().analyzed().toString()
    for function in ("parts_marked(", "field_labels("):
        assert plan.count(function + "coalesce(") == plan.count(function) > 0


def test_field_labels():
    from reelgrid.functions.fields import brackets, label

    said = {"": "empty", "9.34 GiB": "size", "2021": "year", "TV Shows/综艺": "category", "香港": "region", "动作/剧情": "genre", "翡翠台 4K": "broadcaster", "原创录制第3部 翡翠台": "recording", "转自ABC": "credit", "某发布组/某压制组": "credit", "如有侵权请删除": "disclaimer", "01-12 fin": "episodes", "7 (19)": "episodes", "正片 加更版": "section", "全24集": "count", "第2季 第3-5集": "season", "第3话": "count", "S02": "season", "导演: 某": "information", "山河": "native", "Old Town": "latin", "!?": "other", "13 Lakes": "latin"}
    assert {k: label(k) for k in said} == said
    assert [label("TV", ["category"]), label("TV", []), label("韩剧", ["category"]), label("韩剧", ["category", "native"])] == ["layout", "category", "drama", "region"]
    assert brackets("a[b [c] d][e") == [("b  d", ["c"]), ("e", [])] and brackets("a]b") == [] and brackets("") == [] and brackets("[]") == [("", [])]


def test_marks():
    """Marks by words; what is no mark."""
    from reelgrid.functions.markers import details, marks

    some = lambda s: {k: m[2:] for k, m in marks(s).items()}
    assert some("A.S02E05-E07.x") == {"tv": (2, 5, 7), "lone": (None, 7, None)} and marks("A.S02E05-E07.x")["tv"][:2] == (3, 12)
    assert some("S00E09E13E14") == {"tv": (0, 9, 14)} and some("S01E02.03 720p") == {"tv": (1, 2, 3)} and some("S01E02.720p") == {"tv": (1, 2, None)}
    assert some("S01E1234-1235") == {"long": (1, 1234, 1235)} and some("S001E1234") == {} and some("S01SP02") == {"special": (1, 2, None)}
    assert some("EP07EP08") == {"lone": (None, 7, 8)} and some("E0007") == {"long_lone": (None, 7, None)} and some("Season 3") == {"word": (3, None, None)}
    assert some("S03 E04") == {"tv": (3, 4, None), "lone": (None, 4, None)} and some("S03") == {"season": (3, None, None)}
    assert some("xS01E02 S1E2v2 _S01_ S123 E12345 SE01") == {} and marks(None) == {} and some("第S01E01集") == {"tv": (1, 1, None)}
    assert details(".Part2.PLUS.2023") == [("2", None, ".PLUS.2023"), ("2", "PLUS", ".2023")] and details(".Extra.Part03.x")[0][:2] == ("3", "EXTRA") and details(".Partly") == [] and details(None) == []


def test_urls(spark):
    from reelgrid.functions import text

    urls = ["magnet:?x", " https://a/b.torrent ", "https://a/download.php?id=1", "https://a/?action=download", "https://a/?action=downloads", "https://a/downloads/x", None]
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select(text.is_torrent_url(F.col("u")).alias("x")).collect()
    assert [r.x for r in rows] == [True, True, True, True, False, False, False]


def test_aliases(spark):
    from reelgrid.functions import text

    row = spark.createDataFrame([([" 0 A", "1st ", "a", "B", "b"], "A", "C")], "f array<string>, t string, o string").select(text.aliases(F.col("f"), F.col("t"), F.col("o")).alias("x")).first()
    assert row.x == ["0 A", "1st", "B"]


def test_download_links(spark):
    from reelgrid.functions import text

    links = [("alternate", "text/html", "https://a/page", None), ("enclosure", "x", " https://a/t.torrent ", "77")]
    row = (links, None, "https://b/u.torrent", "https://a/page", "guid", "99")
    df = spark.createDataFrame([row, ([], None, None, "https://a/page", None, "99"), (None, "magnet:?x", None, None, None, None)], "links array<struct<rel:string,type:string,href:string,length:string>>, m string, e string, l string, g string, n string")
    url = text.download_url(*(F.col(c) for c in "links m e l g".split()))
    rows = df.withColumn("url", url).select("url", text.download_size(F.col("links"), F.col("url"), F.col("n")).alias("size")).collect()
    assert [tuple(r) for r in rows] == [("https://a/t.torrent", 77), (None, 99), ("magnet:?x", None)]


def test_equivalent_keys(spark):
    from reelgrid.functions import text

    rows = spark.createDataFrame([("The Quest & Son II",), ("Quest and Son 2",), ("A",), ("Anna",)], "t string").select(text.equivalent_key(F.col("t")).alias("k")).collect()
    assert [r.k for r in rows] == ["quest and son 2", "quest and son 2", "a", "anna"]
    near = spark.createDataFrame([("quiet river", "quiet rivers"), ("abc", "abd"), ("quiet river", "loud river")], "a string, b string").select(text.near_titles(F.col("a"), F.col("b")).alias("x")).collect()
    assert [r.x for r in near] == [True, False, False]


def test_feed_events_and_states(spark):
    from reelgrid.sources import feeds

    rows = spark.createDataFrame([('{"a": [1, {"b": "{[{"}]}',), ('{"a":{"b":{"c":{"d":{"e":{"f":{}}}}}}}',)], "j string").select(feeds.shallow(F.col("j")).alias("x")).collect()
    assert rows[0].x is not None and rows[1].x is None
    got = feeds.torrent_states(spark.createDataFrame([(1, "x", "1.5", None, 4, "10", None, "-1"), (2, "y", None, "Seeding", None, None, None, None), (3, "z", None, None, 99, None, None, None)], "id int, name string, progress string, state string, code int, download_speed string, upload_speed string, ratio string")).collect()
    assert [(r.progress, r.state, r.ratio) for r in got] == [(1.0, "downloading", 0.0), (0.0, "seeding", 0.0), (0.0, "unknown", 0.0)]


def test_cursors():
    import pytest

    from reelgrid.operators import rank

    at = {"a": 1, "b": "x"}
    assert rank.decoded_cursor(rank.encoded_cursor(at), ["b", "a"]) == at
    for bad in ("%%", "e30", rank.encoded_cursor({"a": 1})):
        with pytest.raises(ValueError):
            rank.decoded_cursor(bad, ["a", "b"])


def test_a_title_goes_through_few_python_processes(spark):
    """Each function that waits for another's result is a process of its own in each task; there were six of them."""
    raws = [("[剧集]CCTV-4K Some.Show.S01E02.Extra.Part2.2020.1080p.WEB-DL.x264-GRP",), ("TVB Jade Some Show S02E03 1080p HDTV x264-GRP",), (None,)]
    done = release.parse(spark.createDataFrame(raws, "raw string"), "raw", 2027).withColumn("info", release.title_info("head", "raw", "title"))
    assert done._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") <= 3
    got = {r["raw"]: (r["title"], r["season"], r["episode"], r["episode_part"], r["variant"]) for r in done.collect()}
    assert got[raws[0][0]] == ("Some Show", 1, 2, "2", "EXTRA") and got[raws[1][0]] == ("Some Show", 2, 3, None, None)
