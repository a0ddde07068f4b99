"""Repeated 50-byte strings across documents, by a distributed merge sort of front-coded suffix runs.

Which suffixes: of every WINDOW bytes, the positions whose GRAM-byte string has the least hash are
anchors. Equal windows have equal anchors, so two documents with a common window have a common
anchor string. Anchor hashes are exchanged once, as sorted runs of differences, and those found in
one document only are done with; suffixes at the others are sorted.

Sorting: a record is the WINDOW bytes from an anchor and, read backwards, the bytes before it that
a window can hold. Each task sorts its records and codes each by the length of the prefix shared
with the one before and the remaining bytes. Runs go to the task of the anchor's hash, where a
loser tree merges them: every head knows the prefix it shares with the last string that left the
tree, a longer shared prefix decides at once, and for equal ones comparison starts behind it. The
merge also yields the shared prefix of neighbours in the order of all runs.

Deciding: a window that starts j bytes before an anchor is equal in two records if they share
WINDOW - j bytes of suffix (a stretch of the order with long enough shared prefixes) and j bytes
before. Per j, records are classed by both and the least document of each class found. So groups
of any size cost sorting, not pairs, and no hash decides equality. All windows of a record hold its
anchor, so what is removed around it is one interval.

Null text counts as empty; texts under WINDOW bytes lose nothing. Rows with a null doc_id lose
nothing and cause no removal. Rows that repeat a doc_id cause no removal in each other: together
they are the document of that id for later ones, and each loses its own bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelgrid.llm.bpe import batches_of
from reelgrid.llm.tables import documents, written
from reelgrid.llm.words import BYTE_VALUE, mix, powers_for

WINDOW, GRAM = 50, 16
BACK = WINDOW - GRAM
WIDTH = WINDOW + BACK
#: Anchors and records a task gathers before it sends a sorted run.
RUN_ANCHORS, RUN_RECORDS = 1_000_000, 200_000
#: Records of a merging bucket, on average; the number of buckets follows the counted anchors.
BUCKET_RECORDS = 1_000_000


def sliding(x: np.ndarray, width: int, least) -> np.ndarray:
    """least (np.minimum or np.maximum) of each width values in a row."""
    size = 1
    while size * 2 <= width:
        x = least(x[:-size], x[size:])
        size *= 2
    return least(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


def anchors(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the part, position in it, hash) of every anchor of the parts."""
    none = np.empty(0, np.int64)
    data = np.frombuffer(b"".join(parts), np.uint8)
    at = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=at[1:])
    n = len(data)
    if n < WINDOW:
        return none, none, none.astype(np.uint64)
    up, down = powers_for(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_VALUE[data] * up[:n], out=sums[1:])
    h = mix((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1]) | np.uint64(1)
    low = sliding(h, BACK + 1, np.minimum)
    inside = np.zeros(len(low), bool)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        inside[a : max(a, b - WINDOW + 1)] = True
    low[~inside] = 0
    edge = np.zeros(BACK, np.uint64)
    most = sliding(np.concatenate((edge, low, edge)), BACK + 1, np.maximum)
    pos = np.flatnonzero(most == h)
    doc = np.searchsorted(at, pos, "right") - 1
    return doc, pos - at[doc], h[pos]


def planes(x: np.ndarray) -> bytes:
    """Bytes of equal weight together: high ones, mostly zero, then compress to nothing."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def from_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def by_bucket(batches, key: str = "r"):
    """(bucket, list of rows) of batches sorted by bucket; one bucket is held at a time."""
    at, rows = None, []
    for b in batches:
        for row in b.to_pylist():
            if row[key] != at and rows:
                yield at, rows
                rows = []
            at = row[key]
            rows.append(row)
    if rows:
        yield at, rows


def shared_anchors(docs: DataFrame, buckets: int) -> DataFrame:
    """(doc_id, h): anchor hashes of each document that stand in another document too."""

    def send(batches):
        hs, ids, count = [], [], 0

        def run():
            h, d = np.concatenate(hs), np.concatenate(ids)
            order = np.lexsort((d, h))
            h, d = h[order], d[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
            h, d = h[new], d[new]
            r = (h >> np.uint64(32)) % np.uint64(buckets)
            order = np.argsort(r, kind="stable")
            r, h, d = r[order], h[order], d[order]
            cut = np.flatnonzero(np.diff(r)) + 1
            lo, hi = [0, *cut.tolist()], [*cut.tolist(), len(r)]
            return pa.RecordBatch.from_arrays([
                pa.array(r[lo].astype(np.int32)),
                pa.array([planes(np.diff(h[a:b], prepend=np.uint64(0))) for a, b in zip(lo, hi, strict=True)], pa.binary()),
                pa.array([planes(d[a:b]) for a, b in zip(lo, hi, strict=True)], pa.binary()),
            ], names=["r", "h", "d"])

        for whole in batches:
            for b in batches_of(whole, "text"):
                doc, _, h = anchors([(t or "").encode() for t in b.column(1).to_pylist()])
                if len(h):
                    hs.append(h)
                    ids.append(b.column(0).to_numpy()[doc])
                    count += len(h)
                if count > RUN_ANCHORS:
                    yield run()
                    hs, ids, count = [], [], 0
        if count:
            yield run()

    def meet(batches):
        for _, rows in by_bucket(batches):
            h = np.concatenate([np.cumsum(from_planes(x["h"]), dtype=np.uint64) for x in rows])
            d = np.concatenate([from_planes(x["d"]).view(np.int64) for x in rows])
            order = np.argsort(h, kind="stable")
            h, d = h[order], d[order]
            first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            several = np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first)
            use = np.repeat(several, np.diff(np.append(first, len(h))))
            yield pa.RecordBatch.from_arrays([pa.array(d[use]), pa.array(h[use].view(np.int64))], names=["doc_id", "h"])

    sent = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(send, "r int, h binary, d binary")
    return sent.repartition("r").sortWithinPartitions("r").mapInArrow(meet, "doc_id long, h long").distinct()


ZSTD = "zstd"


def small(raw: bytes) -> bytes:
    return pa.Codec(ZSTD, 1).compress(raw, asbytes=True)


def large(packed: bytes, size: int) -> bytes:
    return pa.Codec(ZSTD).decompress(packed, decompressed_size=size, asbytes=True) if size else b""


def packed_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, z, t): the compressed bytes of each text, which is what shuffles carry, and a hash of it."""

    def run(batches):
        for whole in batches:
            for b in batches_of(whole, "text"):
                parts = [(t or "").encode() for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(p) for p in parts], pa.int64()), pa.array([small(p) for p in parts], pa.binary()), b.column(2)], names=["doc_id", "n_bytes", "z", "t"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", text_hash().alias("t")).mapInArrow(run, f"doc_id {kind}, n_bytes long, z binary, t long")


def text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def texts_with_anchors(docs: DataFrame, shared: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, z, v, at): positions of a document's shared anchors; z is null where it has none, and
    whole_sha256 then holds the digest. v tells the texts of one doc_id apart: 0 where there is one, else its hash."""
    own = shared.groupBy(F.col("doc_id").alias("own")).agg(F.collect_list("h").alias("hs"))
    joined = packed_texts(docs).join(own, F.col("doc_id").cast("long") == F.col("own"), "left")
    # Rows are dealt by doc_id already. Null ids keep apart: they have no shared anchors.
    same = Window.partitionBy("doc_id", F.when(F.col("doc_id").isNull(), F.col("t")))
    joined = joined.withColumn("v", F.when(F.min("t").over(same) == F.max("t").over(same), 0).otherwise(F.col("t"))).select("doc_id", "n_bytes", "z", "hs", "v")

    def run(batches):
        for whole in batches:
            for b in batches_of(whole, "z", 1 << 19):
                packed, sizes = b.column(2).to_pylist(), b.column(1).to_pylist()
                parts = [large(z, n) for z, n in zip(packed, sizes, strict=True)]
                had = b.column(3).is_valid().to_pylist()
                doc, pos, h = anchors([p if x else b"" for p, x in zip(parts, had, strict=True)])
                ends = np.searchsorted(doc, np.arange(len(parts) + 1))
                at = []
                for i, x in enumerate(had):
                    lo, hi = ends[i], ends[i + 1]
                    at.append(pos[lo:hi][np.isin(h[lo:hi], b.column(3)[i].values.to_numpy().view(np.uint64))].astype(np.int32).tobytes() if x else None)
                yield pa.RecordBatch.from_arrays([
                    b.column(0), b.column(1), pa.array([z if x else None for z, x in zip(packed, had, strict=True)], pa.binary()),
                    pa.array(at, pa.binary()), pa.array([None if x else hashlib.sha256(p).hexdigest() for p, x in zip(parts, had, strict=True)], pa.string()), b.column(4),
                ], names=["doc_id", "n_bytes", "z", "at", "whole_sha256", "v"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"doc_id {kind}, n_bytes long, z binary, at binary, whole_sha256 string, v long")


def records(raw: bytes, at: np.ndarray) -> np.ndarray:
    """A row per anchor: WINDOW bytes from it, then those before it backwards; zero where the document ends."""
    padded = np.zeros(len(raw) + WINDOW + BACK, np.uint8)
    padded[BACK : BACK + len(raw)] = np.frombuffer(raw, np.uint8)
    step = np.concatenate((np.arange(WINDOW), -1 - np.arange(BACK)))
    return padded[at[:, None] + BACK + step]


def front_code(rows: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Of sorted rows: lengths of the prefixes shared with the row before, and the other bytes."""
    differ = rows[1:] != rows[:-1]
    lcp = np.zeros(len(rows), np.uint8)
    lcp[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return lcp, rows[np.arange(rows.shape[1]) >= lcp[:, None]].tobytes()


def front_decode(lcp: np.ndarray, packed: bytes) -> np.ndarray:
    rest = large(packed, int((WIDTH - lcp.astype(np.int64)).sum()))
    own = np.zeros((len(lcp), WIDTH), np.uint8)
    own[np.arange(WIDTH) >= lcp[:, None]] = np.frombuffer(rest, np.uint8)
    row = np.arange(len(lcp))
    for c in range(WIDTH):
        own[:, c] = own[np.maximum.accumulate(np.where(lcp <= c, row, 0)), c]
    return own


class LoserTree:
    """Merges sorted runs of byte strings; yields (run, row, prefix shared with the string before)."""

    def __init__(self, runs: list[list[bytes]], lcps: list[list[int]]):
        self.runs, self.lcps = runs, lcps

    def __iter__(self):
        runs, lcps, k = self.runs, self.lcps, len(self.runs)
        size = 1
        while size < k:
            size *= 2
        head = [r[0] if r else None for r in runs] + [None] * (size - k)
        row, known = [0] * size, [0] * size  # known: prefix shared with the last string that left
        tree = [-1] * size  # losers

        def play(a: int, b: int) -> tuple[int, int]:
            """(winner, loser); the loser's known prefix becomes the one shared with the winner."""
            x, y = head[a], head[b]
            if y is None:
                return a, b
            if x is None:
                return b, a
            p, q = known[a], known[b]
            if p != q:
                return (a, b) if p > q else (b, a)
            if x == y:
                known[b] = len(y)
                return a, b
            u, v = int.from_bytes(x[p:]), int.from_bytes(y[p:])
            shared = len(x) - ((u ^ v).bit_length() + 7) // 8
            if u < v:
                known[b] = shared
                return a, b
            known[a] = shared
            return b, a

        winners = list(range(size))
        level = size
        while level > 1:
            level //= 2
            after = []
            for i in range(level):
                w, lost = play(winners[2 * i], winners[2 * i + 1])
                tree[level + i] = lost
                after.append(w)
            winners = after
        win = winners[0]
        while head[win] is not None:
            yield win, row[win], known[win]
            row[win] += 1
            i = row[win]
            if i < len(runs[win]):
                head[win], known[win] = runs[win][i], lcps[win][i]
            else:
                head[win] = None
            node = (win + size) // 2
            while node >= 1:
                win, tree[node] = play(win, tree[node])
                node //= 2


def intervals(texts: DataFrame, buckets: int) -> DataFrame:
    """(doc_id, v, lo, hi): bytes of windows that stand in a document of a smaller doc_id."""

    def send(batches):
        rows, keys, docs, texts, at, count = [], [], [], [], [], 0

        def run():
            m, d, v, a = np.concatenate(rows), np.concatenate(docs), np.concatenate(texts), np.concatenate(at)
            r = np.concatenate(keys)
            order = np.lexsort((d, m.view(f"S{WIDTH}").ravel(), r))
            m, d, v, a, r = m[order], d[order], v[order], a[order], r[order]
            new = np.ones(len(m), bool)
            new[1:] = (m[1:] != m[:-1]).any(axis=1) | (r[1:] != r[:-1])
            out = []
            cut = np.flatnonzero(np.diff(r)) + 1
            for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(r)], strict=True):
                first = np.flatnonzero(new[lo:hi])
                lcp, rest = front_code(m[lo:hi][first])
                out.append((int(r[lo]), lcp.tobytes(), small(rest), planes(np.diff(np.append(first, hi - lo))), planes(d[lo:hi]), planes(v[lo:hi]) if v[lo:hi].any() else None, planes(a[lo:hi])))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int32(), *[pa.binary()] * 6), strict=True)], names=["r", "lcp", "rest", "n", "d", "v", "a"])

        for b in (x for whole in batches for x in batches_of(whole, "z")):
            for doc, size, z, where, text in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                pos = np.frombuffer(where, np.int32)
                if not len(pos):
                    continue
                raw = large(z, size)
                m = records(raw, pos)
                first = np.ascontiguousarray(m[:, :GRAM]).view("<u8")
                rows.append(m)
                keys.append((mix(first[:, 0] ^ mix(first[:, 1])) % np.uint64(buckets)).astype(np.int32))
                docs.append(np.full(len(pos), doc, np.int64))
                texts.append(np.full(len(pos), text, np.int64))
                # The bytes that a window can have before and behind the anchor go with the position.
                at.append(pos.astype(np.int64) << 14 | np.minimum(pos, BACK).astype(np.int64) << 7 | np.minimum(len(raw) - pos, WINDOW))
                count += len(pos)
                if count > RUN_RECORDS:
                    yield run()
                    rows, keys, docs, texts, at, count = [], [], [], [], [], 0
        if count:
            yield run()

    def merge(batches):
        for _, blocks in by_bucket(batches):
            ms = [front_decode(np.frombuffer(x["lcp"], np.uint8), x["rest"]) for x in blocks]
            strings = [[s[i : i + WIDTH] for i in range(0, len(s), WIDTH)] for s in (m.tobytes() for m in ms)]
            start = np.cumsum([0, *map(len, ms)])
            merged = [(start[run] + row, lcp) for run, row, lcp in LoserTree(strings, [list(x["lcp"]) for x in blocks])]
            order = np.array([i for i, _ in merged], np.int64)
            lcp = np.array([p for _, p in merged], np.int64)
            counts = np.concatenate([from_planes(x["n"]).astype(np.int64) for x in blocks])
            d = np.concatenate([from_planes(x["d"]).view(np.int64) for x in blocks])
            a = np.concatenate([from_planes(x["a"]).view(np.int64) for x in blocks])
            v = np.concatenate([from_planes(x["v"]).view(np.int64) if x["v"] else np.zeros(len(x["d"]) // 8, np.int64) for x in blocks])
            back_bytes = np.concatenate(ms)[order][:, WINDOW:].astype(np.int64)
            ends = np.cumsum(counts)
            least = np.minimum.reduceat(d, ends - counts)[order]  # by string, in the order of all
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            string = np.repeat(place, counts)
            can_back, can_ahead = a >> 7 & 127, a & 127
            far, near = np.full(len(d), -1, np.int64), np.full(len(d), WINDOW, np.int64)
            back = np.zeros(len(order), np.int64)
            for j in range(BACK + 1):
                if j:
                    back = np.unique(back * 256 + back_bytes[:, j - 1], return_inverse=True)[1]
                ahead = np.cumsum(lcp < WINDOW - j)
                both = np.unique(ahead * (len(order) + 1) + back, return_inverse=True)[1]
                # Only documents that reach as far as the window take part.
                fits = (can_back >= j) & (can_ahead >= WINDOW - j)
                low = np.full(len(order), np.iinfo(np.int64).max)
                if fits.all():
                    np.minimum.at(low, both, least)
                else:
                    np.minimum.at(low, both[string[fits]], d[fits])
                hit = fits & (low[both][string] < d)
                far[hit] = j
                near[hit] = np.minimum(near[hit], j)
            use = far >= 0
            pos = a[use] >> 14
            yield pa.RecordBatch.from_arrays([pa.array(d[use]), pa.array(v[use]), pa.array(pos - far[use]), pa.array(pos - near[use] + WINDOW)], names=["doc_id", "v", "lo", "hi"])

    some = texts.where("z is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "n_bytes", "z", "at", "v")
    sent = some.mapInArrow(send, "r int, lcp binary, rest binary, n binary, d binary, v binary, a binary")
    return sent.repartition("r").sortWithinPartitions("r").mapInArrow(merge, "doc_id long, v long, lo long, hi long")


def with_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, v, n_bytes, z, whole_sha256, spans): sorted intervals to remove, which may overlap; z is null, and the
    digest of the whole set, where nothing can repeat."""
    buckets = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = written(texts_with_anchors(docs, shared_anchors(docs, buckets)), "anchored")
    count = texts.agg(F.sum(F.octet_length("at"))).first()[0] or 0
    found = intervals(texts, max(buckets, count // 4 // BUCKET_RECORDS)).groupBy(F.col("doc_id").alias("of"), F.col("v").alias("of_v")).agg(F.sort_array(F.collect_set(F.struct("lo", "hi"))).alias("spans"))
    return texts.drop("at").join(found, (F.col("doc_id").cast("long") == F.col("of")) & (F.col("v") == F.col("of_v")), "left").drop("of", "of_v")


def merged(spans: pa.ListScalar) -> tuple[list[int], list[int]]:
    """Starts and ends of the maximal runs of sorted intervals."""
    if not spans.is_valid or not len(spans.values):
        return [], []
    lo, hi = spans.values.field(0).to_numpy(), spans.values.field(1).to_numpy()
    reach = np.maximum.accumulate(hi)
    first = np.append(True, lo[1:] > reach[:-1])
    return lo[first].tolist(), reach[np.append(first[1:], True)].tolist()


def removed_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, v, los, his) of documents that lose bytes: the maximal runs."""

    def run(batches):
        longs = pa.list_(pa.int64())
        for b in batches:
            runs = [merged(x) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array([r[0] for r in runs], longs), pa.array([r[1] for r in runs], longs)], names=["doc_id", "v", "los", "his"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return with_spans(docs).where("spans is not null").select("doc_id", "v", "spans").mapInArrow(run, f"doc_id {kind}, v long, los array<long>, his array<long>")


def cut(raw: bytes, los: list[int], his: list[int]) -> bytes:
    return b"".join(raw[a:b] for a, b in zip([0, *his], [*los, len(raw)], strict=True))


def whole_characters(raw: bytes, los: list[int], his: list[int]) -> tuple[list[int], list[int]]:
    """Spans without the characters that they hold in part only, so what is left is valid UTF-8."""
    inner = lambda i: i < len(raw) and raw[i] & 0xC0 == 0x80
    new_los, new_his = [], []
    for lo, hi in zip(los, his, strict=True):
        while lo < hi and inner(lo):
            lo += 1
        while hi > lo and inner(hi):
            hi -= 1
        if lo < hi:
            new_los.append(lo)
            new_his.append(hi)
    return new_los, new_his


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with repeated strings cut out of the text, in whole characters; other columns and rows stay."""
    spans = removed_spans(docs).select(F.col("doc_id").alias("span_of"), F.col("v").alias("span_v"), "los", "his").dropDuplicates(["span_of", "span_v"])
    own = docs.select("*", text_hash().alias("text_hash"))
    joined = own.join(spans, (own.doc_id == F.col("span_of")) & ((F.col("span_v") == 0) | (F.col("span_v") == own.text_hash)), "left").select(*(own[c] for c in docs.columns), "los", "his")
    names, at = docs.columns, docs.columns.index("text")

    def run(batches):
        for whole in batches:
            for b in batches_of(whole, "text"):
                texts = []
                for t, los, his in zip(*(b.column(i).to_pylist() for i in (at, -2, -1)), strict=True):
                    if los and t is not None:
                        raw = t.encode()
                        t = cut(raw, *whole_characters(raw, los, his)).decode()
                    texts.append(t)
                cols = list(b.columns[:-2])
                cols[at] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return joined.mapInArrow(run, docs.schema)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""

    def run(batches):
        for b in (x for whole in batches for x in batches_of(whole, "z")):
            rows = []
            for size, z, sha, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4), strict=True):
                los, his = merged(spans)
                rows.append((sum(his) - sum(los), len(los), sha if z is None else hashlib.sha256(cut(large(z, size), los, his)).hexdigest()))
            cols = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([*b.columns[:2], *(pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.string()), strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return with_spans(docs).select("doc_id", "n_bytes", "z", "whole_sha256", "spans").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes, those removed because a smaller doc_id has the same 50 bytes, and a digest of the rest."""
    return digests(documents(spark, sf_dir))


QUERIES = {"op8_suffix_dedup": op8_suffix_dedup}
ORACLES: dict[str, str] = {}
