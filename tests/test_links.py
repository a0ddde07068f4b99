"""Chains, cycles, merged titles and similar sets against plain Python."""

import random

import pytest

from reelgrid.operators import links, similar


def walked(pairs, cycles):
    """Each old one's end, step by step."""
    to = {}
    for a, b in pairs:
        if a is not None and b is not None and a != b:
            to[a] = min(b, to.get(a, b))
    out = {}
    for a in to:
        seen, x = [], a
        while x in to and x not in seen:
            seen.append(x)
            x = to[x]
        if x not in to:
            out[a] = x
        elif cycles == "least":
            least = min(seen[seen.index(x) :])
            if least != a:
                out[a] = least
    return out


@pytest.mark.parametrize("cycles", ["none", "least"])
def test_chains_and_cycles(spark, cycles):
    r = random.Random(3)
    shapes = [(1, 2), (2, 3), (3, 1), (9, 1), (20, 21), (21, 20), (22, 21), (30, 31), (31, 32), (32, 33), (33, 34), (34, 30), (40, 40), (41, None), (None, 4), (50, 60), (50, 55), (55, 50)]
    shapes += [(i, i + 1) for i in range(100, 171)] + [(200 + i, 200 + r.randrange(300)) for i in range(150)]
    for rows in (shapes, shapes[:4], [(1, 2)], []):
        got = links.ends(spark.createDataFrame(rows, "old long, new long"), "old", "new", cycles).collect()
        assert {x.old: x.target for x in got} == walked(rows, cycles) and len(got) == len(walked(rows, cycles))


def test_merged_titles(spark):
    r = random.Random(5)
    rows = [(r.randrange(400), f"x{r.randrange(300)}") for _ in range(420)] + [(i, "hot") for i in range(0, 400, 7)] + [(5, None), (None, "x1"), (398, "own")]
    want = {i: i for i in range(400)}
    for _ in range(400):
        by = {}
        for t, x in rows:
            if t is not None and x is not None:
                by[x] = min(by.get(x, 999), want[t])
        after = {t: min([want[t], *(by[x] for u, x in rows if u == t and x is not None)]) for t in want}
        if after == want:
            break
        want = after
    titles = spark.createDataFrame([(i,) for i in range(400)], "title long")
    got = links.merged(titles, spark.createDataFrame(rows, "title long, id string"), "title", "id").collect()
    assert {x.title: x.survivor for x in got} == want and len(got) == 400


@pytest.mark.parametrize("least", [400_000, 600_000, 850_000, 1_000_000])
def test_similar_sets(spark, least):
    r = random.Random(least)
    words = [f"w{min(r.randrange(80), r.randrange(80))}" for _ in range(4000)]
    sets = [sorted(set(r.sample(words, r.randrange(1, 14)))) for _ in range(250)]
    sets += [s[:-1] for s in sets[:80]] + [[*s, "more"] for s in sets[80:120]] + sets[:20] + [[], []]
    rows = list(enumerate(sets))
    frame = spark.createDataFrame(rows, "id long, tokens array<string>")
    got = sorted(tuple(x) for x in similar.pairs(frame, "id", "tokens", least).collect())
    dice = lambda a, b: 2_000_000 * len({*a} & {*b}) // (len(a) + len(b)) if a and b else 0
    want = [(i, j, dice(a, b)) for i, a in rows for j, b in rows if i < j and dice(a, b) >= least]
    assert got == want


def test_candidates_are_few(spark, sf):
    """Of the trigrams of page titles at 0.6: pairs whose sets are read, against pairs found."""
    from reelgrid.functions import similarity
    from reelgrid.plans import text

    t = text.page_titles(spark, sf).withColumn("grams", similarity.numbered(similarity.trigrams(text.F.col("a"))))
    sets = similar.classes(t, "page_id", "grams")
    found = similar.candidates(similar.by_rarity(sets, "class", "grams"), "class", "grams", 600_000).count()
    assert found <= 20 * similar.class_pairs(sets, "grams", 600_000).count() + 20


def test_parts_within_lists(spark):
    rows = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["b", "a"]), (3, []), (4, ["a", "a", "b"])], "id long, t array<string>")
    parts = spark.createDataFrame([("p", ["a", "b"]), ("q", ["a", "b"]), ("r", ["zz"]), ("s", ["c"])], "name string, part array<string>")
    got = similar.containing(rows, "t", parts, "part").select("id", "name").collect()
    assert sorted(tuple(x) for x in got) == [(1, "p"), (1, "q"), (1, "s"), (4, "p"), (4, "q")]


def test_chains_stay_off_the_driver(spark, monkeypatch):
    plans = []
    written = links.kept
    monkeypatch.setattr(links, "kept", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or written(df, name))
    rows = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5), (5, 6)], "a long, b long")
    assert sorted(tuple(r) for r in links.ends(rows, "a", "b", "least").collect()) == [(2, 1), (3, 1), (4, 6), (5, 6)]
    links.connected(rows, "a", "b").collect()
    assert len(plans) > 5 and not any("BroadcastExchange" in p for p in plans)


def test_equal_lists_meet_a_part_once(spark, monkeypatch):
    """Thirty equal rows and twenty equal parts: one list is looked through, six hundred rows come of it."""
    met, written = [], similar.kept
    monkeypatch.setattr(similar, "kept", lambda df, name: met.append(df.count()) or written(df, name))
    rows = spark.range(30).selectExpr("id", "split('a red ring', ' ') AS x")
    parts = spark.range(20).selectExpr("id AS other", "split('red ring', ' ') AS y")
    got = similar.containing(rows, "x", parts, "y")
    assert got.distinct().count() == got.count() == 600 and met == [1]
