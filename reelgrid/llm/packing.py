"""Sum-of-squares online packing of documents into windows of at most 2048 tokens.

Each partition packs its own documents as they come, so no row moves. A document's ids (an end id
follows each document) give whole windows and a rest; the rest goes to the fill level that makes
the sum of squared counts of partially filled windows least, which an array of counts by level
tells: leaving level h changes the sum by 1 - 2 * count[h], joining h + r by 1 + 2 * count[h + r],
where a new window leaves no level and a full one joins none. Ties take the fullest level. Since documents may be cut, windows still open at the end of a partition are
joined, the fullest first, and cut at window borders, which leaves one window with padding at most.

Null text counts as empty: its only token is the end id. Repeated rows are packed each. A
sequence id holds the partition in its upper bits, so ids are unique and the same on a retry.
"""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from reelgrid.llm.bpe import batches_of, encoder
from reelgrid.llm.tables import documents

BPE_50K = public_tokenizers.path("byte_bpe_50k.json")
WINDOW = 2048
END_ID = 1


class Levels:
    """Counts of partially filled windows by fill level, and their pieces: rows of the piece table."""

    def __init__(self, window: int):
        self.window = window
        self.counts = np.zeros(window + 1, np.int64)
        self.open: dict[int, list[list[int]]] = {}

    def level_for(self, length: int) -> int:
        """The level, of those with a window or 0, where a piece of that length makes the sum of squares least."""
        most = self.window - length
        change = 2 * (self.counts[length : self.window + 1] - self.counts[: most + 1]) + 2
        change[0] -= 1  # a new window leaves no level,
        change[most] -= 1  # and a full one joins none
        used = self.counts[: most + 1] > 0
        used[0] = True
        change[~used] = np.iinfo(np.int64).max
        best = change.min()
        return int(np.flatnonzero(change == best)[-1])

    def place(self, piece: int, length: int) -> list[int] | None:
        """Puts a piece in; the pieces of its window, if it is full now."""
        h = self.level_for(length)
        pieces = self.open[h].pop() if h else []
        if h:
            self.counts[h] -= 1
        pieces.append(piece)
        if h + length == self.window:
            return pieces
        self.counts[h + length] += 1
        self.open.setdefault(h + length, []).append(pieces)
        return None

    def rest(self) -> list[list[int]]:
        return [pieces for h in sorted(self.open, reverse=True) for pieces in self.open[h]]


class Packer:
    """Packs the documents of one partition; a piece is (document row, start, length)."""

    def __init__(self, partition: int, window: int):
        self.window, self.levels, self.base, self.made = window, Levels(window), partition << 40, 0
        self.pieces: dict[int, tuple] = {}  # of open windows only
        self.next = 0

    def sequence(self) -> int:
        self.made += 1
        return self.base + self.made - 1

    def add(self, doc, ids: bytes):
        """Rows (doc_id, start, length, crc, doc tokens, sequence, offset) of windows that are full."""
        n, w = len(ids) // 4, self.window
        whole = n - n % w
        for start in range(0, whole, w):
            yield doc, start, w, zlib.crc32(ids[4 * start : 4 * (start + w)]), n, self.sequence(), 0
        if whole < n:
            k, self.next = self.next, self.next + 1
            self.pieces[k] = doc, whole, n - whole, ids[4 * whole :], n
            if (full := self.levels.place(k, n - whole)) is not None:
                yield from self.laid(full)

    def laid(self, full: list[int]):
        at, s = 0, self.sequence()
        for k in full:
            doc, start, length, raw, n = self.pieces.pop(k)
            yield doc, start, length, zlib.crc32(raw), n, s, at
            at += length

    def close(self):
        """Open windows' pieces one after the other, cut at window borders."""
        at, s = 0, None
        for pieces in self.levels.rest():
            for k in pieces:
                doc, start, length, raw, n = self.pieces.pop(k)
                done = 0
                while done < length:
                    if s is None or at == self.window:
                        at, s = 0, self.sequence()
                    take = min(length - done, self.window - at)
                    yield doc, start + done, take, zlib.crc32(raw[4 * done : 4 * (done + take)]), n, s, at
                    done, at = done + take, at + take


def pack(docs: DataFrame, path: str = BPE_50K, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    end = np.uint32(end_id).tobytes()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    id_type = docs.schema["doc_id"].dataType

    def table(rows, kind):
        cols = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], kind), *(pa.array(c, pa.int64()) for c in cols[1:])], names=names)

    def run(batches):
        enc, packer, rows, kind = encoder(path), Packer(TaskContext.get().partitionId(), window), [], None
        for whole in batches:
            kind = whole.column(0).type
            for b in batches_of(whole, "text"):
                for doc, ids in zip(b.column(0).to_pylist(), enc.encode(b.column(1).to_pylist()), strict=True):
                    rows.extend(packer.add(doc, ids + end))
                if len(rows) > 10_000:
                    yield table(rows, kind)
                    rows = []
        rows.extend(packer.close())
        if rows:
            yield table(rows, kind)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type.simpleString()}, " + ", ".join(f"`{n}` long" for n in names[1:]))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of at most 2048 tokens."""
    return pack(documents(spark, sf_dir))


QUERIES = {"op10_packing": op10_packing}
ORACLES: dict[str, str] = {}
