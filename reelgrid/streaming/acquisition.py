"""The acquisition fold as a stream: what each unit holds, its feeds and its entries live in keyed state.

Entries that come in order of (at, entry_id) cost what they are: the held quality and the feeds seen are read, the entry is
judged and noted. An older entry than the unit's newest makes the unit's noted entries be folded again; what that
changes is put out anew, so of a unit's entry the last decision put out counts, and all decisions equal the batch fold in
order of time however files come. A repeated entry is judged once. A call of the state costs more than judging an entry,
so entries are noted in blocks, a call each and opaque to Spark, and Spark reads rows cell by cell, so an entry comes as one
struct. A stream that was begun with a call an entry has to begin anew.

`settled` bounds the noted entries: those that came so many seconds ago are dropped from the state by a timer. What is
held and which feeds were seen stays; entries older than dropped ones are then judged against that.
"""

from __future__ import annotations

import pickle

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

QUALITY = "resolution int, rank int"
#: Entries of a block of noted ones.
BLOCK = 1024


def judged(held: tuple | None, feeds: set, entry: tuple) -> tuple[str, tuple]:
    """An entry's action and the quality held after it; entry: (feed, resolution, rank, cross_seed, upgrade)."""
    feed, resolution, rank, cross_seed, upgrade = entry
    own = (-1 if resolution is None else resolution, -1 if rank is None else rank)
    if held is None:
        return "SATISFY", own
    if cross_seed and feed not in feeds:
        return "CROSS_SEED", held
    if upgrade and own > held:
        return "UPGRADE", own
    return "REJECT", held


class Noted:
    """A unit's noted entries, in blocks of one call of the state each; a block's key is the place of its first entry.

    A place is (at, entry_id); an entry (feed, resolution, rank, cross_seed, upgrade, action, held_resolution, held_rank, came).
    """

    def __init__(self, blocks):
        self.blocks = blocks

    def read(self) -> dict[tuple, dict[tuple, tuple]]:
        """Entries by place, by block."""
        return {tuple(k): {e[:2]: e[2:] for e in pickle.loads(v[0])} for k, v in self.blocks.iterator()}

    def put(self, entries: dict[tuple, tuple]) -> None:
        """Entries in the order of their places as blocks; blocks that begin alike are overwritten."""
        rows = [(*place, *e) for place, e in entries.items()]
        for lo in range(0, len(rows), BLOCK):
            self.blocks.updateValue(rows[lo][:2], (pickle.dumps(rows[lo : lo + BLOCK]),))

    def drop(self, block: tuple) -> None:
        self.blocks.removeKey(block)

    def __len__(self) -> int:
        return sum(map(len, self.read().values()))


class Acquisition(StatefulProcessor):
    def __init__(self, key: str, entry: str, feed: str, settled: float | None):
        """The types of a key, an entry's id and a feed."""
        self.types, self.settled = (key, entry, feed), settled

    def init(self, handle: StatefulProcessorHandle) -> None:
        _, entry, feed = self.types
        self.handle = handle
        self.newest = handle.getValueState("newest", f"at long, entry_id {entry}")
        self.held = handle.getValueState("held", QUALITY)
        # What was held, and which feeds were known, before the noted entries.
        self.base = handle.getValueState("base", QUALITY)
        self.base_feeds = handle.getMapState("base_feeds", f"feed {feed}", "seen boolean")
        self.feeds = handle.getMapState("feeds", f"feed {feed}", "seen boolean")
        self.entries = Noted(handle.getMapState("blocks", f"at long, entry_id {entry}", "entries binary"))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new = {(r["at"], r["entry_id"]): (r["feed"], r["resolution"], r["rank"], bool(r["cross_seed"]), bool(r["upgrade"])) for r in rows}
        came = timerValues.getCurrentProcessingTimeInMs() if self.settled is not None else 0
        newest = self.newest.get()
        newest = tuple(newest) if newest is not None else None
        late = newest is not None and any(place <= newest for place in new)
        blocks, noted = {}, {}
        if late:
            blocks = self.entries.read()
            noted = {place: e for of in blocks.values() for place, e in of.items()}
            new = {place: e for place, e in new.items() if place not in noted}
            held = self.base.get()
            feeds = {k[0] for k in self.base_feeds.keys()}
            todo = sorted([*new, *noted]) if new else []
        else:
            held = self.held.get() if newest is not None else None
            feeds = {f for f in {e[0] for e in new.values()} if self.feeds.containsKey((f,))} if newest is not None else set()
            todo = sorted(new)
        held, known, judgements = tuple(held) if held is not None else None, set(feeds), {}
        for place in todo:
            entry = new[place] if place in new else noted[place][:5]
            action, held = judged(held, known, entry)
            known.add(entry[0])
            if place in new or (action, *held) != noted[place][5:8]:
                judgements[place] = (*entry, action, *held, came if place in new else noted[place][8])
                yield Row(key=key[0], entry_id=place[1], action=action, held_resolution=held[0], held_rank=held[1])
        if todo:
            self.entries.put({place: e for place, e in judgements.items() if place in new})
            for of in blocks.values():
                if not judgements.keys().isdisjoint(of):
                    self.entries.put({place: judgements.get(place, e) for place, e in of.items()})
            self.held.update(held)
            self.newest.update(max(todo[-1], newest) if newest else todo[-1])
            for feed in known - feeds:
                self.feeds.updateValue((feed,), (True,))
            if self.settled is not None:
                self.handle.registerTimer(came + int(self.settled * 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """Drops the entries that came `settled` ago and before every one that stays; the base takes their place."""
        until = expiredTimerInfo.getExpiryTimeInMs() - int(self.settled * 1000)
        blocks, gone = self.entries.read(), set()
        for place, e in sorted((place, e) for of in blocks.values() for place, e in of.items()):
            if e[8] > until:
                break
            gone.add(place)
            last = e
            self.base_feeds.updateValue((e[0],), (True,))
        if gone:
            self.base.update((last[6], last[7]))
        for block, of in blocks.items():
            if not gone.isdisjoint(of):
                self.entries.drop(block)
                self.entries.put({place: e for place, e in of.items() if place not in gone})
        return iter(())

    def close(self) -> None:
        pass


class OfStructs(Acquisition):
    """Of rows that hold an entry as one struct."""

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        return super().handleInputRows(key, (r[-1] for r in rows), timerValues)


def decisions(entries: DataFrame, settled: float | None = None) -> DataFrame:
    """Decisions (key, entry_id, action, held_resolution, held_rank) on a stream of (key, at, entry_id, feed, resolution, rank,
    cross_seed, upgrade), in update mode; of equal (key, entry_id) the last counts. Entries without a time come first."""
    kind = {f.name: f.dataType.simpleString() for f in entries.schema}
    at = F.coalesce(F.unix_micros(F.col("at").cast("timestamp")), F.lit(-(1 << 62)))
    rows = entries.select("key", F.struct(at.alias("at"), "entry_id", "feed", F.col("resolution").cast("int").alias("resolution"), F.col("rank").cast("int").alias("rank"), "cross_seed", "upgrade").alias("entry"))
    of = OfStructs(kind["key"], kind["entry_id"], kind["feed"], settled)
    return rows.groupBy("key").transformWithState(of, f"key {kind['key']}, entry_id {kind['entry_id']}, action string, held_resolution int, held_rank int", "Update", "None" if settled is None else "ProcessingTime")
