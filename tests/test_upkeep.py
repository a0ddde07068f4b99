"""Folds of hot units, filled pages and derived rows against plain Python and their simpler forms."""

import os
import random

import pytest
from pyspark.sql import functions as F

from reelgrid.operators import acquisition, pages, rules
from reelgrid.operators.derived import Derived


def entries(spark, n, keys):
    r = random.Random(n)
    rows = [(r.choice(keys), None if i % 97 == 0 else r.randrange(500), i, r.choice([None, 1, 2, 3, 4]), r.choice([None, 720, 1080, 2160]), r.randrange(60), r.random() < 0.3, r.random() < 0.7) for i in range(n)]
    return spark.createDataFrame(rows, "key string, at int, id int, feed int, resolution int, rank int, cross_seed boolean, upgrade boolean")


@pytest.mark.parametrize("keys", [["hot"] * 6 + ["a", "b", None, "c", "d", "e"], ["one"], [f"k{i}" for i in range(300)]])
def test_fold_in_ranges_is_the_fold(spark, keys):
    rows = entries(spark, 1500, keys)
    names = ["key", "id", "action", "held_resolution", "held_rank"]
    plain = acquisition.fold(rows, ["key"], [F.asc("at"), F.asc("id")], "feed", "resolution", "rank", "cross_seed", "upgrade").select(*names)
    ranged = acquisition.fold_in_ranges(rows, ["key"], ["at", "id"], "feed", "resolution", "rank", "cross_seed", "upgrade", ranges=9).select(*names)
    assert sorted(map(tuple, ranged.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)


def test_a_hot_unit_is_many_tasks(spark):
    rows = entries(spark, 4000, ["hot"] * 50 + [f"k{i}" for i in range(50)])
    done = acquisition.fold_in_ranges(rows, ["key"], ["at", "id"], "feed", "resolution", "rank", "cross_seed", "upgrade", ranges=8)
    tasks = [r["count"] for r in done.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(tasks) == 4000 and max(tasks) <= 2 * 4000 / 8


def test_each_range_is_a_task(spark):
    done = acquisition.fold_in_ranges(entries(spark, 4000, ["hot"]), ["key"], ["at", "id"], "feed", "resolution", "rank", "cross_seed", "upgrade", ranges=8)
    tasks = [r["count"] for r in done.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(tasks) == 8 and sum(tasks) == 4000 and max(tasks) <= 1000


def test_release_scores(spark):
    rows = [("better_quality", 1080, "Remux", "X"), ("better_quality", None, "blu-ray", None), ("better_quality", 720, "TELESYNC", "X"), ("preferred_release_group", 1080, "REMUX", " abc "), ("preferred_release_group", 2160, None, None), ("none", 2160, "REMUX", "ABC")]
    f = spark.createDataFrame(rows, "p string, r int, s string, g string")
    got = f.select(rules.release_score(F.col("p"), F.col("r"), F.col("s"), F.col("g"), F.array(F.lit("ABC"))).alias("x")).select("x.*").collect()
    assert [tuple(x) for x in got] == [(1080, 60), (-1, 50), (720, 0), (1, 0), (0, 0), (0, 0)]


def test_pages_read_what_they_need(spark, tmp_path, monkeypatch):
    r = random.Random(1)
    rows = [(i % 3, r.randrange(400), i, r.randrange(100)) for i in range(3000)]
    frame = spark.createDataFrame(rows, "tenant int, at int, id int, v int")
    path = str(tmp_path / "p")
    pages.lay_out(frame, path, "tenant", ["at", "id"], 60)
    held = spark.read.parquet(f"{path}/ranges").collect()
    assert len(held) >= 55 and sum(x["rows"] for x in held) == 3000
    spans = sorted((x["scope"], tuple(x["last"]), tuple(x["first"])) for x in held)
    assert all(a[0] != b[0] or a[2] < b[1] for a, b in zip(spans, spans[1:], strict=False))  # ranges do not overlap
    want = lambda t, keep, after: sorted(((a, i, v) for s, a, i, v in rows if s == t and keep(v) and (after is None or (a, i) < after)), reverse=True)
    for t, limit, after in ((0, 101, None), (1, 60, (200, 1500)), (2, 3, None), (1, -1, None), (9, 101, None), (0, 101, (0, -1))):
        got = pages.page(spark, path, t, ["at", "id"], 20, F.col("v") < limit, after)
        assert [tuple(x[c] for c in ("at", "id", "v")) for x in got.collect()] == want(t, lambda v: v < limit, after)[:21]  # noqa: B023
    first = pages.page(spark, path, 0, ["at", "id"], 20, F.col("v") < 101)
    assert len(first.inputFiles()) <= 3  # of some twenty of that tenant
    cursor, seen = None, []
    while True:  # page by page to the end
        some = [tuple(x[c] for c in ("at", "id", "v")) for x in pages.page(spark, path, 2, ["at", "id"], 150, F.col("v") < 50, cursor).collect()]
        seen += some[:150]
        if len(some) <= 150:
            break
        cursor = some[149][:2]
    assert seen == want(2, lambda v: v < 50, None)


def test_ranges_of_files_need_no_sort(spark, tmp_path):
    r = random.Random(2)
    rows = [(None if i % 9 == 0 else i % 3, r.choice([None, *range(50)]), i) for i in range(900)]
    path = str(tmp_path / "p")
    pages.lay_out(spark.createDataFrame(rows, "tenant int, at int, id int"), path, "tenant", ["at", "id"], 7)
    stored = spark.read.parquet(f"{path}/rows")
    place = F.struct("at", "id")
    plain = stored.groupBy("scope", F.input_file_name().alias("file")).agg(F.count("*").alias("rows"), F.max(place).alias("first"), F.min(place).alias("last"))
    found = pages.ranges_of(stored, ["at", "id"])
    key = lambda x: str(x["file"])
    assert sorted(spark.read.parquet(f"{path}/ranges").select(*plain.columns).collect(), key=key) == sorted(plain.collect(), key=key)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan[plan.index("BroadcastHashJoin") :]  # nothing below the join, where all rows are


def test_derived_rows(spark, tmp_path):
    made = []

    def make(rows):
        rows = rows.persist()
        made.append(sorted(r.k for r in rows.collect()))
        return rows.select("k", F.upper("raw").alias("name"), F.length("raw").alias("size"))

    of = lambda version: Derived(spark, str(tmp_path), "k long, name string, size int", "k", make, version, ["name"])
    frame = lambda *rows: spark.createDataFrame(rows, "k long, raw string")
    ran = lambda d, *rows: sorted((r.k, r.outcome) for r in d.refresh(frame(*rows)).collect())
    state = lambda: sorted(tuple(r) for r in of("1").read().collect())
    assert state() == []
    one = of("1")
    assert ran(one, (1, "a"), (2, "bb"), (3, None), (None, "x")) == [(1, "created"), (2, "created"), (3, "created")] and made[-1] == [1, 2, 3]
    assert ran(one, (1, "A"), (2, "bb"), (4, "d")) == [(1, "unchanged"), (3, "gone"), (4, "created")] and made[-1] == [1, 4]
    assert state() == [(1, "A", 1), (2, "BB", 2), (4, "D", 1)]
    assert ran(one, (1, "A"), (2, "bb"), (4, "d")) == [] and made[-1] == []
    assert ran(of("2"), (1, "A"), (2, "bc"), (3, "z"), (4, "d")) == [(1, "unchanged"), (2, "changed"), (3, "created"), (4, "unchanged")]
    before = one.current()
    of("2").rebuild(frame((7, "g"), (8, "h")))
    assert state() == [(7, "G", 1), (8, "H", 1)] and one.current() > before
    of("2").rebuild(frame((9, "i")))
    assert state() == [(9, "I", 1)] and sorted(x for x in os.listdir(tmp_path) if x.startswith("build")) == ["build=1", "build=2"]
    # A run that stopped before its pointer moved has changed nothing that is read, and the next one does its work.
    store = one.store(2)
    store.add(spark.createDataFrame([(9, "half", 4, "x", False)], store.schema), 1)
    assert state() == [(9, "I", 1)] and ran(of("2"), (9, "j")) == [(9, "changed")] and state() == [(9, "J", 1)]


def test_scope_reaches_the_scans_and_ends(spark, sf):
    from reelgrid.plans import serving, tenants
    from reelgrid.sources import tables

    mine = {r.feed_id for r in tables.feeds(spark, sf).where("tenant_id = 2").collect()}
    with tables.scope(2):
        assert {r.feed_id for r in tables.feeds(spark, sf).collect()} == mine and {r.feed_id for r in tables.items(spark, sf).select("feed_id").distinct().collect()} <= mine
        with tables.scope(3):
            assert not mine & {r.feed_id for r in tables.feeds(spark, sf).collect()}
        assert tables.TENANT.get() == 2
    with pytest.raises(ZeroDivisionError), tables.scope(1):
        raise ZeroDivisionError
    assert tables.TENANT.get() is None
    # What was built inside stays the tenant's when it runs outside; every tenant's reads add up to all.
    one = [tenants.of_tenant(serving.items_status, t)(spark, sf) for t in range(5)]
    assert sum(r.n for q in one for r in q.collect()) == sum(r.n for r in serving.items_status(spark, sf).collect())
    assert serving.items_status.__name__ in tenants.READS[serving]


def test_names_of_queries_are_their_own():
    from reelgrid.plans import registry

    assert len(registry.queries()) == sum(len(m.QUERIES) for m in registry.MODULES)


def test_units_of_a_task_s_share_are_sorted_once(spark):
    """None is large: the entries are dealt once, and no ranges are written."""
    rows = entries(spark, 400, [f"k{i}" for i in range(40)])
    plan = acquisition.fold_in_ranges(rows, ["key"], ["at", "id"], "feed", "resolution", "rank", "cross_seed", "upgrade", ranges=4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "rangepartitioning" not in plan


def test_a_rebuild_is_many_tasks(spark, tmp_path):
    """Inputs of one file are made in more than one task."""
    spark.range(100).coalesce(1).write.parquet(f"{tmp_path}/in")
    stored = Derived(spark, f"{tmp_path}/home", "id long, part int", "id", lambda rows: rows.select("id", F.spark_partition_id().alias("part")), "1", ["part"])
    stored.rebuild(spark.read.parquet(f"{tmp_path}/in"))
    assert stored.read().agg(F.count("id"), F.count_distinct("part")).first() == (100, 4)
