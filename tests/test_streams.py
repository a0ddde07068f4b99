"""Streams over many files, in several batches and out of order, equal their batch forms."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from reelgrid.plans import streams
from reelgrid.streaming import feeds


@pytest.fixture(autouse=True)
def one_file_a_batch(monkeypatch):
    of = feeds.stream_of
    monkeypatch.setattr(feeds, "stream_of", lambda spark, path, *_: of(spark, path, 1))


def landed(spark, home, pieces):
    """An events table of one file for each piece, landing in that order."""
    os.makedirs(f"{home}/events.parquet")
    for i, rows in enumerate(pieces):
        df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, props string").withColumn("ts", F.to_timestamp("ts"))
        df.coalesce(1).write.parquet(f"{home}/{i}")
        (name,) = (x for x in os.listdir(f"{home}/{i}") if x.endswith(".parquet"))
        os.rename(f"{home}/{i}/{name}", f"{home}/events.parquet/part-{i:03}.parquet")
        os.utime(f"{home}/events.parquet/part-{i:03}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    return str(home)


def test_old_entries_are_kept_and_late_copies_dropped(spark, tmp_path):
    pieces = [[(i, f"2024-03-{28 - i:02} 00:00:00", i % 5, "view", "{}")] for i in range(6)]
    home = landed(spark, tmp_path, pieces + [[(3, "2023-01-01 00:00:00", 3, "view", "{}")]])
    rows = streams.stream_ingest(spark, home).collect()
    assert sorted(r.event_id for r in rows) == list(range(6))


def test_acquisition_goes_on_from_batch_to_batch(spark, tmp_path):
    r = random.Random(4)
    rows = [(i, f"2024-03-01 {i // 60:02}:{i % 60:02}:00", r.choice([None, 1, 2, 3]), "view", f'{{"k":{r.randrange(9)}}}') for i in range(240)]
    home = landed(spark, tmp_path, [rows[i : i + 60] for i in range(0, 240, 60)])
    held, want = {}, {}
    for i, _, key, _, props in rows:
        k = json.loads(props)["k"]
        want[i] = "SATISFY" if key not in held else "UPGRADE" if k > held[key] else "REJECT"
        held[key] = max(k, held.get(key, -1))
    assert {x.entry_id: x.action for x in streams.stream_acquisition(spark, home).collect()} == want


def test_refresh_merges_batches(spark, tmp_path):
    """New, changed and unchanged items over three micro-batches; a retried batch gives the same."""
    from reelgrid.sources.feeds import ITEM
    from reelgrid.streaming import feeds

    def batch(*rows):
        made = [(t, link, guid, h, f, at) for t, link, guid, h, f, at in rows]
        return spark.createDataFrame(made, "title string, link string, guid string, infoHash string, feed_id long, seen_at long").selectExpr("*", "CAST(NULL AS STRING) pubDate", "CAST(NULL AS STRING) isoDate", "CAST(NULL AS STRING) description", "CAST(NULL AS STRUCT<_url: STRING, _length: STRING, _type: STRING>) enclosure", "CAST(NULL AS STRING) contentLength", "CAST(NULL AS STRING) magnetURI")

    assert "infoHash" in ITEM
    home, h = str(tmp_path), "a" * 40
    one = batch(("Some.Show.S01E01.1080p.WEB-DL-G", "https://x/1.torrent", "g1", h, 1, 1), ("A.Film.1999.720p.BluRay-G", "https://x/2.torrent", "g2", None, 1, 1), ("A.Film.1999.720p.BluRay-G", "https://x/2.torrent", "g2", None, 2, 1), (None, "https://x/3", "g3", None, 1, 1))
    two = batch(("Some.Show.S01E01.2160p.WEB-DL-G", "https://x/1.torrent", "g1", h, 1, 2), ("A.Film.1999.720p.BluRay-G", "https://x/2.torrent", "g2", None, 1, 2), ("B.Film.2001.720p-G", "https://x/4.torrent", "g2", None, 2, 2), ("New.Film.2005.720p-G", "https://x/9.torrent", "g9", None, 2, 2))
    out = lambda b, n: sorted((r.feed_id, r.raw_title[:4], r.outcome) for r in feeds.refreshed(b, n, home).collect())
    assert out(one, 0) == [(1, "A.Fi", "created"), (1, "Some", "created"), (2, "A.Fi", "created")]
    want = [(1, "A.Fi", "unchanged"), (1, "Some", "changed"), (2, "B.Fi", "changed"), (2, "New.", "created")]
    assert out(two, 1) == want and out(two, 1) == want
    assert out(batch(("C.Film.2002-G", "https://x/7.torrent", "g9", None, 2, 3)), 2) == [(2, "C.Fi", "changed")]


def acquisitions(rows):
    """By hand: entries in order of time and id, each judged by what its key holds then."""
    held, want = {}, {}
    for i, _, key, _, props in sorted(rows, key=lambda r: (r[1], r[0])):
        k = json.loads(props)["k"]
        want[i] = "SATISFY" if key not in held else "UPGRADE" if k > held[key] else "REJECT"
        held[key] = max(k, held.get(key, -1))
    return want


def test_acquisition_of_files_out_of_order(spark, tmp_path):
    r = random.Random(6)
    rows = [(i, f"2024-03-{1 + i // 30:02} 00:{i % 30:02}:00", r.choice([None, 1, 2]), "view", f'{{"k":{r.randrange(9)}}}') for i in range(240)]
    mixed = list(rows)
    r.shuffle(mixed)
    home = landed(spark, tmp_path, [mixed[i : i + 60] for i in range(0, 240, 60)] + [mixed[5:9]])  # some come again
    got = [(x.entry_id, x.action) for x in streams.stream_acquisition(spark, home).collect()]
    assert len(got) == 240 and dict(got) == acquisitions(rows)


def test_a_stream_goes_on_from_its_folder(spark, tmp_path):
    rows = [(i, f"2024-03-01 00:{59 - i:02}:00", i % 3, "view", f'{{"k":{i * 7 % 5}}}') for i in range(40)]
    s = lambda at: feeds.stream_of(spark, f"{at}/events.parquet").select("event_id", F.col("user_id").alias("key"), F.col("ts").alias("at"), F.col("event_id").alias("entry_id"), F.lit(1).cast("long").alias("feed"), F.get_json_object("props", "$.k").cast("int").alias("resolution"))
    run = lambda at: feeds.drained(feeds.acquired(s(at).drop("event_id")), "x", "update", keys=["key", "entry_id"], home=f"{tmp_path}/state")
    counts = lambda at: feeds.drained(s(at).select("at"), "x", "update", feeds.windows("1 hour"), ["start"], home=f"{tmp_path}/counts")
    home = landed(spark, tmp_path, [rows[:10], rows[10:20]])
    assert {x.entry_id: x.action for x in run(home).collect()} == acquisitions(rows[:20]) and [x.n for x in counts(home).collect()] == [20]
    more = str(tmp_path / "more")
    os.makedirs(more)
    landed(spark, more, [rows[20:]])
    os.rename(f"{more}/events.parquet/part-000.parquet", f"{home}/events.parquet/part-009.parquet")
    assert {x.entry_id: x.action for x in run(home).collect()} == acquisitions(rows) and [x.n for x in counts(home).collect()] == [40]
    assert len(os.listdir(f"{tmp_path}/state/out")) == 3  # three batches in all, none of them twice


def test_settled_entries_leave_the_state():
    """The processor by itself, on plain dictionaries: what is held outlives the entries that a timer drops."""
    from reelgrid.streaming.acquisition import Acquisition

    class Value:
        def __init__(self, *_):
            self.v = None

        exists, get = (lambda self: self.v is not None), (lambda self: self.v)

        def update(self, v):
            self.v = v

    class Map(dict):
        containsKey, updateValue, removeKey, iterator = dict.__contains__, dict.__setitem__, dict.pop, (lambda self: iter(list(self.items())))

    class Handle:
        getValueState, getMapState, registerTimer = (lambda self, *_: Value()), (lambda self, *_: Map()), (lambda self, t: timers.append(t))

    class Now:
        def __init__(self, t):
            self.t = t

        getCurrentProcessingTimeInMs = getExpiryTimeInMs = lambda self: self.t

    timers = []
    one = Acquisition("long", "long", "long", settled=10)
    one.init(Handle())
    entry = lambda at, i, feed, k: {"at": at, "entry_id": i, "feed": feed, "resolution": k, "rank": 0, "cross_seed": True, "upgrade": True}
    said = lambda rows, t: [(r.entry_id, r.action) for r in one.handleInputRows((7,), iter(rows), Now(t))]
    assert said([entry(5, 1, 1, 3), entry(6, 2, 1, 4)], 0) == [(1, "SATISFY"), (2, "UPGRADE")] and timers == [10_000]
    assert said([entry(4, 0, 1, 4)], 5_000) == [(0, "SATISFY"), (1, "REJECT"), (2, "REJECT")]
    assert list(one.handleExpiredTimer((7,), Now(0), Now(10_000))) == [] and len(one.entries) == 3  # the oldest came last and stays, so all do
    list(one.handleExpiredTimer((7,), Now(0), Now(15_000)))
    assert not one.entries and one.base.get() == (4, 0) and dict(one.base_feeds) == {(1,): (True,)}
    assert said([entry(1, 9, 2, 9), entry(2, 8, 1, 3)], 16_000) == [(9, "CROSS_SEED"), (8, "REJECT")]


def test_entries_are_noted_in_blocks():
    """A call of the state for a block of entries, not for each; late entries and timers work across blocks."""
    from reelgrid.streaming import acquisition

    class Value:
        v = None
        exists, get = (lambda self: self.v is not None), (lambda self: self.v)

        def update(self, v):
            self.v = v

    class Map(dict):
        containsKey, removeKey, iterator = dict.__contains__, dict.pop, (lambda self: iter(list(self.items())))

        def updateValue(self, k, v):
            calls.append(k)
            self[k] = v

    class Handle:
        getValueState, getMapState, registerTimer = (lambda self, *_: Value()), (lambda self, *_: Map()), (lambda self, t: None)

    class Now:
        def __init__(self, t):
            self.getCurrentProcessingTimeInMs = self.getExpiryTimeInMs = lambda: t

    calls, r = [], random.Random(8)
    one = acquisition.Acquisition("long", "long", "long", settled=10)
    one.init(Handle())
    rows = [{"at": i, "entry_id": i, "feed": r.randrange(3), "resolution": r.randrange(4), "rank": r.randrange(400), "cross_seed": r.random() < 0.5, "upgrade": True} for i in range(2500)]
    early, late = [x for x in rows if x["at"] not in (1, 1500)], [rows[1500], rows[1], rows[7]]
    said = {x.entry_id: x for x in one.handleInputRows((7,), iter(early), Now(0))}
    assert len(calls) <= 3 + 3  # of blocks and of feeds
    said |= {x.entry_id: x for x in one.handleInputRows((7,), iter(late), Now(5_000))}
    held, feeds, want = None, set(), {}
    for x in rows:
        want[x["entry_id"]], held = acquisition.judged(held, feeds, (x["feed"], x["resolution"], x["rank"], x["cross_seed"], x["upgrade"]))
        feeds.add(x["feed"])
    assert {i: x.action for i, x in said.items()} == want and len(one.entries) == 2500
    list(one.handleExpiredTimer((7,), Now(0), Now(10_000)))  # up to the second entry, which came late
    assert len(one.entries) == 2499 and one.base.get() == (rows[0]["resolution"], rows[0]["rank"])
    list(one.handleExpiredTimer((7,), Now(0), Now(15_000)))
    assert len(one.entries) == 0 and one.base.get() == one.held.get() == held


def test_windows_of_any_age(spark, tmp_path):
    pieces = [[(i, f"{day} 10:30:00", 1, "view", "{}")] for i, day in enumerate(["2024-06-10", "2024-01-11", "2023-08-14", "2023-03-17"])]
    home = landed(spark, tmp_path, pieces + [[(9, "2024-01-11 10:59:59", 1, "view", "{}"), (10, None, 1, "view", "{}")]])
    got = {str(r.start): r.n for r in streams.stream_window(spark, home).collect()}
    assert got == {"2024-06-10 10:00:00": 1, "2024-01-11 10:00:00": 2, "2023-08-14 10:00:00": 1, "2023-03-17 10:00:00": 1}
    assert sum(r.n for r in streams.stream_sliding(spark, home).collect()) == 5 * 7


def test_store_stays_within_twice_its_rows(spark, tmp_path):
    """A hundred batches of changes to the same keys; old folders go, results and retries are right."""
    from reelgrid.operators.rank import top_per_key
    from reelgrid.sources.store import Store

    store = Store(spark, str(tmp_path / "s"), "k long, v string", "k", lambda rows: top_per_key(rows, ["k"], [F.desc("batch")]), buckets=2)
    folders = lambda: sum(len(of) for kind in ("base", "changes") for of in store._listed(kind).values())
    want, most = {}, 0
    for n in range(100):
        rows = [(k, f"{n}-{'x' * 200}-{k}") for k in {n % 7, n % 11, 50 + n}]
        store.compact(n, [0, 1])
        store.add(spark.createDataFrame(rows, "k long, v string").coalesce(1), n)
        want |= dict(rows)
        most = max(most, folders())
        if n in (30, 31):  # a retry
            store.compact(n, [0, 1])
            store.add(spark.createDataFrame(rows, "k long, v string").coalesce(1), n)
    assert {r.k: r.v for r in store.read(100).collect()} == want
    store.read(100).withColumn("bucket", store.bucket()).repartition("bucket").drop("bucket").write.parquet(str(tmp_path / "live"))
    live = sum(os.path.getsize(f"{tmp_path}/live/{f}") for f in os.listdir(tmp_path / "live") if f.endswith(".parquet"))
    assert store.bytes() <= 2 * live + 2 * 2000 and most < 60


def test_refresh_claims_matches_and_reschedules(spark, tmp_path):
    base = "CAST(NULL AS STRING) pubDate, CAST(NULL AS STRING) isoDate, CAST(NULL AS STRING) description, CAST(NULL AS STRUCT<_url: STRING, _length: STRING, _type: STRING>) enclosure, CAST(NULL AS STRING) contentLength, CAST(NULL AS STRING) magnetURI, CAST(NULL AS STRING) infoHash".split(", CAST")
    extra = [base[0], *(f"CAST{x}" for x in base[1:])]
    raw = lambda rows: spark.createDataFrame(rows, "title string, link string, guid string, feed_id long, seen_at long").selectExpr("*", *extra)
    home = str(tmp_path)
    match = lambda items: items.where("title <> 'Unknown'").select("item_id", F.concat(F.lit("m-"), "title").alias("candidate"))
    item = lambda name, f, at, more="": (f"{name} 2001 1080p WEB-DL{more}-G", f"https://x/{name}.torrent", f"g-{name}", f, at)
    one = [item("Alpha", 1, 10), item("Beta", 1, 10), item("Unknown", 1, 10), item("Gamma", 2, 10), (None, "https://x/z", "z", 1, 10), (None, "https://x/y", "y", 3, 12), (None, "u", "u", None, 1)]
    run = lambda rows, n: sorted((r.feed_id, r.raw_title.split()[0], r.outcome) for r in feeds.refreshed(raw(rows), n, home, interval=60, claims=2, match=match).collect())
    assert run(one, 0) == [(1, "Alpha", "created"), (1, "Beta", "created"), (1, "Unknown", "created"), (2, "Gamma", "created")]
    store = feeds.stores(spark, home)
    work = lambda n: {r.raw_title.split()[0]: (r.status, r.candidate) for r in store["work"].read(n).collect()}
    first = work(1)
    assert sorted(s for s, _ in first.values()) in (["matched", "matched", "matched", "queued"], ["matched", "matched", "queued", "unmatched"]) and first["Gamma"] == ("matched", "m-Gamma")
    assert run([item("Gamma", 2, 20, " x265")], 1) == [(2, "Gamma", "changed")]  # feed 1 does not come, its queue waits
    assert {k: v for k, v in work(2).items() if k != "Gamma"} == {k: v for k, v in first.items() if k != "Gamma"}
    assert run([item("Alpha", 1, 30)], 2) == [(1, "Alpha", "unchanged")]
    assert work(3) == {"Alpha": ("matched", "m-Alpha"), "Beta": ("matched", "m-Beta"), "Unknown": ("unmatched", None), "Gamma": ("matched", "m-Gamma")}
    feed = {r.feed_id: r.asDict() for r in store["feeds"].read(3).collect()}
    assert feed[1] == {"feed_id": 1, "polls": 2, "last_polled": 30, "next_attempt": 90, "created": 3, "changed": 0, "unchanged": 1, "skipped": 1, "claimed": 3}
    assert (feed[2]["changed"], feed[2]["claimed"]) == (1, 2) and (feed[3]["skipped"], feed[3]["next_attempt"], feed[3]["created"]) == (1, 72, 0)


def test_items_of_one_batch_that_share_a_hash(spark):
    from reelgrid.operators.catalogue import ingested, upserted

    schema = "feed_id long, key_type string, key_hash string, hashes array<string>, seen_at long, title string"
    stored = spark.createDataFrame([], "item_id string, " + schema)
    rows = [(1, "S", "b", ["link", "g1"], 1, "old"), (1, "S", "a", ["link"], 2, "new"), (1, "S", "c", ["g1"], 0, "first"), (2, "S", "d", ["link"], 1, "x"), (1, "S", "e", ["f"], 1, "y"), (1, "S", "f", [], 1, "z")]
    frame = spark.createDataFrame(rows, schema)
    got = sorted((r.item_id, r.title, r.outcome) for r in ingested(stored, frame, ["title"]).collect())
    assert got == [("new:1:S:a", "new", "created"), ("new:1:S:e", "y", "created"), ("new:1:S:f", "z", "created"), ("new:2:S:d", "x", "created")]
    assert upserted(stored, frame, ["title"]).count() == 6  # a key each


def test_dispatch(spark, tmp_path):
    """Claims before sends, retries of a tick, lost ticks, limits of attempts and of a tick."""
    from reelgrid.streaming import dispatch

    home, sent = str(tmp_path), []

    def send(claimed, bad=()):
        ids = sorted(r.job_id for r in claimed.collect())
        sent.append(ids)
        return spark.createDataFrame([(i, "at https://x/?token=abc123 no" if i in bad else None) for i in ids], "job_id long, error string")

    state = lambda n: {r.job_id: (r.status, r.attempts) for r in dispatch.jobs_of(spark, home).read(n).collect()}
    jobs = spark.createDataFrame([(1, 10, 5), (2, 20, 1), (3, 30, 3), (3, 31, 9), (None, 1, 1)], "job_id long, item_id long, changed_at long")
    dispatch.queued(spark, home, jobs, 0)
    dispatch.queued(spark, home, jobs.where("job_id = 1"), 1)
    assert state(2) == {1: ("QUEUED", 0), 2: ("QUEUED", 0), 3: ("QUEUED", 0)}
    first = lambda: dispatch.ticked(spark, home, 2, 100, lambda c: send(c, bad=[2]), most=2).collect()
    assert sorted((r.job_id, r.status) for r in first()) == [(2, "FAILED"), (3, "SENT")]
    assert sorted((r.job_id, r.status) for r in first()) == [(2, "FAILED"), (3, "SENT")] and sent == [[2, 3], [2, 3]]  # a retry is the same tick
    assert state(4) == {1: ("QUEUED", 0), 2: ("FAILED", 1), 3: ("SENT", 1)}
    assert "abc123" not in dispatch.jobs_of(spark, home).read(4).where("job_id = 2").first().error

    def stops(claimed):
        raise RuntimeError("stopped")

    with pytest.raises(RuntimeError):
        dispatch.ticked(spark, home, 4, 200, stops)
    assert state(6) == {1: ("SENDING", 1), 2: ("SENDING", 2), 3: ("SENT", 1)}
    assert dispatch.ticked(spark, home, 6, 300, send, lease=600).collect() == [] and sent[-1] == []  # they may still be on their way
    assert sorted((r.job_id, r.status) for r in dispatch.ticked(spark, home, 8, 900, send, tries=2).collect()) == [(1, "SENT"), (2, "FAILED")]
    assert state(10) == {1: ("SENT", 2), 2: ("FAILED", 2), 3: ("SENT", 1)}
    assert dispatch.ticked(spark, home, 10, 999, lambda c: c.select("job_id", F.lit(None).cast("string").alias("error")).where("false"), tries=3).collect()[0].error == "no answer"
