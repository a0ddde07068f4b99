"""Substring search and regular-expression rules against plain Python."""

import re

import pytest
from pyspark.sql import functions as F

from reelgrid.operators import matching, patterns, similar, substrings

TEXTS = [(1, "Small Thing"), (2, "Smaller Ring"), (3, "SMALLEST"), (3, "thing two"), (4, "ab"), (5, "a"), (6, ""), (7, None), (8, "Ünïcode Straße"), (9, "aaaaaa"), (10, "x" * 50_000 + "needle"), (1, "Small Thing")]
WORDS = ["small", "mall", "MALL", "g t", "ing", "thing", "a", "AB", "aaa", "aaaaaa", "aaaaaaa", "needle", "eedl", "ïcod", "straße", "zz", "", None, "small thing", "lest", "st"]


def test_words_inside_words(spark, tmp_path):
    index = str(tmp_path / "index")
    frame = spark.createDataFrame(TEXTS, "id long, text string")
    substrings.add(frame.where("id < 5"), index, "id", "text")
    substrings.add(frame.where("id >= 3"), index, "id", "text")  # some twice
    got = sorted(tuple(r) for r in substrings.find(spark, index, spark.createDataFrame([(w,) for w in WORDS], "word string"), "word").collect())
    assert got == sorted({(w, i) for w in WORDS if w for i, t in TEXTS if t and w.lower() in t.lower()})


def test_only_the_postings_of_the_words_are_read(spark, tmp_path):
    index = str(tmp_path / "index")
    substrings.add(spark.createDataFrame([(i, f"title number {i * 7919}") for i in range(2000)], "id long, text string"), index, "id", "text")
    grams = substrings.wanted(spark.createDataFrame([("7919",)], "word string"), "word")
    assert {(r.gram, r.offset, r.n) for r in grams.collect()} == {("791", 0, 2), ("919", 1, 2)}
    read = substrings.postings(spark, index, grams)
    folders = {r[0].split("bucket=")[1].split("/")[0] for r in read.select(F.input_file_name()).distinct().collect()}
    every = {r[0] for r in spark.read.parquet(f"{index}/grams").select("bucket").distinct().collect()}
    assert folders == {str(r.bucket) for r in grams.collect()} and len(folders) < len(every) / 4
    assert "PartitionFilters: [isnotnull(bucket" in read._jdf.queryExecution().toString() or "PartitionFilters: [bucket" in read._jdf.queryExecution().toString()


def test_search_of_nothing(spark, tmp_path):
    index = str(tmp_path / "index")
    substrings.add(spark.createDataFrame([], "id long, text string"), index, "id", "text")
    assert substrings.find(spark, index, spark.createDataFrame([("abc",), ("a",)], "word string"), "word").count() == 0
    titles = spark.createDataFrame([(1, "Smaller Ring", "tmdb", "1"), (2, "Small Thing", "tmdb", "2")], "media_id long, title string, provider string, provider_id string")
    found = matching.searched(spark.createDataFrame([("small",), ("mall",), ("tmdb:2",), ("tmdb:9",)], "query string"), titles, "query").collect()
    assert sorted((r.query, r.media_id) for r in found) == [("mall", 1), ("mall", 2), ("small", 1), ("small", 2), ("tmdb:2", 2)]


#: Patterns and literals of which each match holds one; none where that is not known.
REQUIRED = {
    "widget|ring": ["ring", "widget"], "a.*e": None, "(large|small) ring.*\\d": ["large", "small"], "web.?rip": ["web"], "(?:foo)?barbaz": ["barbaz"], "x{3}": None, "[Ff]oo": None, "(?i)foo": None, "(?!abc)def": None,
    "a+bcd": ["bcd"], "\\p{L}foo": None, "Ab\\.Cd": ["ab.cd"], "(abc)+": ["abc"], "(abc)*": None, "": None, "foo\\b": ["foo"], "a|": None, "(": None, "abc|.*": None, "abcd|ef": None, "\\Qa.b\\E": None,
}


@pytest.mark.parametrize("pattern", REQUIRED)
def test_required_literals(pattern):
    assert patterns.required(pattern) == REQUIRED[pattern]


@pytest.mark.parametrize("most", [patterns.MOST_BYTES, 0])
def test_pairs_by_literals(spark, monkeypatch, most):
    """By automata and by the join of trigrams: the pairs that all pairs give."""
    monkeypatch.setattr(patterns, "MOST_BYTES", most)
    rules = [(i, i % 2, p) for i, p in enumerate(p for p in REQUIRED if p not in ("(", "\\p{L}foo", "\\Qa.b\\E") for _ in (0, 1))] + [(90, 0, None), (91, None, "foo"), (92, 0, "\\p{Lu}mall")]
    texts = [(i, i % 2, t) for i, t in enumerate(t for t in ["Large RING 7", "small ring", "FooBarBaz", "webrip xxx", "aaBCD ab.cd", "abcabc", "", "ΑΣ foo Σ", "é", "axe", None, "Small"] for _ in (0, 1))] + [(70, None, "foo")]
    got = patterns.matching_pairs(spark.createDataFrame(texts, "id long, tenant int, text string"), spark.createDataFrame(rules, "rule int, tenant int, pattern string"), "tenant", "text", "rule", "pattern", ["id"]).collect()
    want = {(i, r) for i, g, t in texts for r, h, p in rules if g is not None and g == h and t is not None and p is not None and (re.search(p.replace("\\p{Lu}", "[A-Z]"), t, re.I | re.A))}
    assert sorted((x.id, x.rule) for x in got) == sorted(want)


def test_equal_patterns_and_texts_are_judged_once(spark, monkeypatch):
    """A hundred rules of one pattern and fifty equal texts are one pair to judge and five thousand rows."""
    met, hits = [], patterns.hits
    monkeypatch.setattr(patterns, "hits", lambda texts, literals, *more: met.append((texts.count(), literals.count())) or hits(texts, literals, *more))
    monkeypatch.setattr(patterns, "MOST_LISTED", 30)
    rules = spark.range(100).selectExpr("id AS rule", "0 AS tenant", "'r.ng|widget' AS pattern")
    texts = spark.range(50).selectExpr("id", "0 AS tenant", "'red widget' AS text")
    got = patterns.matching_pairs(texts, rules, "tenant", "text", "rule", "pattern", ["id"])
    assert got.distinct().count() == got.count() == 5000
    # "r.ng" has no literal of useful length, so the pattern meets the one text without the automata.
    assert met == [(1, 0)]


def test_pairs_without_enough_tokens_are_not_sent(spark):
    """Sketches tell apart most pairs that share a token, and lose none that are similar."""
    rows = [(i, [f"common{i % 3}", *(f"own{i}-{k}" for k in range(9))]) for i in range(60)] + [(100 + i, [f"both{k}" for k in range(8)] + [f"x{i}a", f"x{i}b"]) for i in range(5)]
    sets = spark.createDataFrame(rows, "class int, x array<string>")
    # Rarity as if the common ones were rare, so that prefixes meet in them.
    rare = sets.select("class", F.transform("x", lambda t: F.struct(F.when(t.startswith("common"), 1).otherwise(2).alias("n"), t.alias("token"))).alias("x")).withColumn("x", F.sort_array("x"))
    found = {tuple(r) for r in similar.candidates(rare, "class", "x", 600_000).collect()}
    assert found == {(100 + i, 100 + j) for i in range(5) for j in range(i + 1, 5)}
    met = similar.sketch(F.col("x"))
    assert sum(map(sum, (tuple(r) for r in sets.where("class = 0").select(*(F.bit_count(c) for c in met)).collect()))) in range(8, 11)


def test_a_class_of_many_rows_is_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(similar, "SHARE", 4)
    own = spark.createDataFrame([(i, 0) for i in range(21)] + [(100, 100), (101, 100)], "id int, class int")
    found = spark.createDataFrame([(0, 0, 7), (100, 0, 8)], "short int, long int, of int")
    got = sorted(map(tuple, similar.expanded(found, own).collect()))
    assert got == sorted([(i, j, 7) for i in range(21) for j in range(i + 1, 21)] + [(i, j, 8) for i in range(21) for j in (100, 101)])
