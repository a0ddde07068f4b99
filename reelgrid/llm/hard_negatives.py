"""Hard negatives by bit-sliced integer products.

1. Each component x becomes floor(256 * x); the integers are kept once, as a written table. Of B bits (the least that hold
   all of them), the top one weighs -2^(B-1), the others 2^b: a row is B planes of bits, and its product with an anchor is
   the weighted sum of the anchor's products with its planes.
2. Rows are dealt into blocks of bounded size, and every block meets every anchor (a stated query set against all rows). A
   block's rows are held, as bytes of one plane after the other; anchors stream past them.
3. Planes are taken from the top. What is left of a score after some planes lies between its sums of the anchor's negative
   and positive components times 2^(planes left) - 1, so each plane halves the interval. A candidate goes once its
   interval lies outside all of the anchor's bands, or below the n-th best lower end of those that are inside for sure.
   Scores are matrix products while many candidates are left, and products of single pairs after that.
4. First the band is all scores and the candidates are rows of the anchor's label: the best are its positives, per block and then
   overall. Then each positive's score gives a band from 80 % of it to itself, for rows of other labels.

Integers are exact: products of planes and anchors are sums below 2^53 (below 2^24 in single precision), scores are longs.

Rows with a null vec_id, null label, null or empty vector, or a null or non-finite component take no part, nor do vectors of
another length than most (of_one_length), nor those with a component of 2^15 or more, whose products
could exceed a long.
Rows equal in vec_id, label and vector count once; others of one vec_id are rows of their own (ties among these go by their hash).
An anchor without positives or without negatives in a band has no rows for it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelgrid.llm.tables import one_thread_a_task, written
from reelgrid.llm.vectors import embeddings, lists, matrix, of_one_length, usable

SCALE, LARGEST = 256, float(1 << 15)
#: Rows of a block, which one task holds, and anchors that a task takes at most; rows and anchors that are multiplied at once.
BLOCK, ANCHORS, ROWS_AT_ONCE, ANCHORS_AT_ONCE = 1 << 18, 1 << 18, 4096, 256
#: Candidates are multiplied as single pairs once fewer than one in so many are left.
FEW = 16
LEAST, MOST = -(1 << 62), 1 << 62


class Planes:
    """Rows as planes of bits, the top one first."""

    def __init__(self, x: np.ndarray, bits: int):
        self.bits, self.d = bits, x.shape[1]
        u = x & ((1 << bits) - 1)
        self.packed = [np.packbits((u >> b & 1).astype(np.uint8), axis=1) for b in range(bits)]

    def weight(self, b: int) -> int:
        return -(1 << b) if b == self.bits - 1 else 1 << b

    def of(self, b: int, rows) -> np.ndarray:
        return np.unpackbits(self.packed[b][rows], axis=1, count=self.d)


def nth(values: np.ndarray, group: np.ndarray, groups: int, n: int) -> np.ndarray:
    """The n-th largest value of each group, LEAST where it has fewer."""
    order = np.lexsort((-values, group))
    v, g = values[order], group[order]
    first = np.searchsorted(g, np.arange(groups)) + n - 1
    found = np.full(groups, LEAST)
    there = first < len(g)
    there[there] = g[first[there]] == np.flatnonzero(there)
    found[there] = v[first[there]]
    return found


def sliced(a: np.ndarray, planes: Planes, rows: slice, may: np.ndarray, low: np.ndarray, high: np.ndarray, reach: np.ndarray, n: int):
    """(anchor, row, score) of the pairs allowed by `may` that can be among an anchor's n best of one of its bands.

    low, high: each anchor's bands; reach: the n-th best score known so far in each.
    """
    up, down = np.maximum(a, 0).sum(axis=1), np.minimum(a, 0).sum(axis=1)
    exact = np.float32 if np.abs(a).sum(axis=1).max() < 1 << 24 else np.float64
    dense, alive, score = a.astype(exact), may, np.zeros(may.shape, np.int64)
    floor = np.maximum(low, reach)
    b = planes.bits - 1
    while b >= 0 and np.count_nonzero(alive) * FEW >= alive.size:
        score += planes.weight(b) * (dense @ planes.of(b, rows).astype(exact).T).astype(np.int64)
        left = (1 << b) - 1
        lo, hi = score + (left * down)[:, None], score + (left * up)[:, None]
        if low.shape[1] == 1:  # several bands are narrow, and leave few pairs to the second part anyway
            sure = np.where(alive & (lo >= low) & (hi <= high), lo, LEAST)
            if sure.shape[1] >= n:
                floor = np.maximum(floor, np.partition(sure, -n, axis=1)[:, -n][:, None])
        ok = np.zeros_like(alive)
        for k in range(low.shape[1]):
            ok |= (hi >= floor[:, k, None]) & (lo <= high[:, k, None])
        alive = alive & ok
        b -= 1
    i, j = np.nonzero(alive)
    s = score[i, j]
    while b >= 0 and len(i):
        bit, got = planes.of(b, rows), np.empty(len(i), np.int64)
        for at in range(0, len(i), 1 << 16):
            pair = slice(at, at + (1 << 16))
            got[pair] = np.einsum("ij,ij->i", a[i[pair]], bit[j[pair]])
        s += planes.weight(b) * got
        left = (1 << b) - 1
        lo, hi = s + left * down[i], s + left * up[i]
        ok = np.zeros(len(i), bool)
        for k in range(low.shape[1]):
            sure = (lo >= low[i, k]) & (hi <= high[i, k])
            floor[:, k] = np.maximum(floor[:, k], nth(lo[sure], i[sure], len(a), n))
            ok |= (hi >= floor[i, k]) & (lo <= high[i, k])
        i, j, s = i[ok], j[ok], s[ok]
        b -= 1
    return i, j, s


class Block:
    """The rows of a block, by label and vec_id, and the best of them for anchors."""

    def __init__(self, ids: np.ndarray, hashes: np.ndarray, labels: np.ndarray, x: np.ndarray, bits: int):
        order = np.lexsort((hashes, ids, labels))
        ids, hashes, labels = ids[order], hashes[order], labels[order]
        new = np.ones(len(ids), bool)
        new[1:] = (ids[1:] != ids[:-1]) | (hashes[1:] != hashes[:-1])  # the hash holds the label
        self.ids, self.hashes, self.labels = ids[new], hashes[new], labels[new]
        self.planes = Planes(x[order[new]], bits)

    def best(self, ids, hashes, labels, a, low, high, same: bool, n: int):
        """(anchor, band, score, vec_id, hash) of the n best rows in each band of anchors, of the same label or of others."""
        reach = np.full(low.shape, LEAST)
        held = [np.zeros(0, np.int64)] * 4
        for at in range(0, len(self.ids), ROWS_AT_ONCE):
            rows = slice(at, at + ROWS_AT_ONCE)
            may = (self.labels[rows][None, :] == labels[:, None]) == same
            may &= (self.ids[rows][None, :] != ids[:, None]) | (self.hashes[rows][None, :] != hashes[:, None])
            if not may.any():
                continue
            i, j, s = sliced(a, self.planes, rows, may, low, high, reach, n)
            for k in range(low.shape[1]):
                ok = (s >= low[i, k]) & (s <= high[i, k])
                held = [np.concatenate(z) for z in zip(held, (i[ok], np.full(ok.sum(), k), s[ok], j[ok] + at), strict=True)]
            order = np.lexsort((self.hashes[held[3]], self.ids[held[3]], -held[2], held[1], held[0]))
            held = [h[order] for h in held]
            group = held[0] * low.shape[1] + held[1]
            place = np.arange(len(group)) - np.searchsorted(group, group)
            held = [h[place < n] for h in held]
            full = place == n - 1
            reach.reshape(-1)[group[full]] = held[2][np.flatnonzero(place[place < n] == n - 1)]
        i, k, s, j = held
        return i, k, s, self.ids[j], self.hashes[j]


def integers(rows: DataFrame) -> DataFrame:
    """vec_id, label, anchor, v, h: the integer vectors of rows(vec_id, label, anchor, vector) and a hash of label and vector."""
    kind = rows.schema["label"].dataType.simpleString()

    def run(batches):
        for b in batches:
            v = np.floor(SCALE * matrix(b.column(3))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], lists(v, pa.int32())], names=["vec_id", "label", "anchor", "v"])

    made = rows.select("vec_id", "label", "anchor", "vector").mapInArrow(run, f"vec_id long, label {kind}, anchor boolean, v array<int>")
    return made.withColumn("h", F.xxhash64("label", "v"))


def met(rows: DataFrame, anchors: DataFrame, blocks: int, chunks: int, bits: int, same: bool, n: int) -> DataFrame:
    """(anchor_id, anchor_h, band, score, vec_id, h): the n best rows of each block for each band of anchors(..., low, high).

    A task is a block and a chunk of the anchors; it holds the block and lets the anchors, which come behind it, stream past.
    """
    task = lambda block, chunk: block * F.lit(chunks) + chunk
    of = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
    no_bands = F.array().cast("array<long>")
    left = rows.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(chunks - 1)), lambda c: task(of("vec_id", blocks), c))).alias("task"), F.lit(0).alias("side"), "vec_id", "h", "label", "v", no_bands.alias("low"), no_bands.alias("high"))
    right = anchors.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda b: task(b, of("h", chunks)))).alias("task"), F.lit(1).alias("side"), "vec_id", "h", "label", "v", "low", "high")
    dealt = left.unionByName(right).repartitionById(blocks * chunks, F.col("task")).sortWithinPartitions("task", "side")

    def run(batches):
        block, held, at = None, [], None

        def answer(b):
            a = matrix(b["v"]).astype(np.int64)
            col = lambda name: b[name].to_numpy(zero_copy_only=False)
            i, k, s, ids, hashes = block.best(col("vec_id"), col("h"), col("label"), a, matrix(b["low"]), matrix(b["high"]), same, n)
            own = [pa.array(col("vec_id")[i]), pa.array(col("h")[i]), pa.array(k, pa.int32()), pa.array(s, pa.int64()), pa.array(ids, pa.int64()), pa.array(hashes, pa.int64())]
            return pa.RecordBatch.from_arrays(own, names=["anchor_id", "anchor_h", "band", "score", "vec_id", "h"])

        for whole in batches:
            edges = np.flatnonzero(np.diff(whole["task"].to_numpy().astype(np.int64) * 2 + whole["side"].to_numpy())) + 1
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(whole)], strict=True):
                b = whole.slice(lo, hi - lo)
                if not len(b):
                    continue
                if b["task"][0].as_py() != at:
                    at, block, held = b["task"][0].as_py(), None, []
                if b["side"][0].as_py() == 0:
                    held.append(b)
                    continue
                if block is None and held:
                    x = np.concatenate([matrix(p["v"]) for p in held])
                    block = Block(*(np.concatenate([p[c].to_numpy(zero_copy_only=False) for p in held]) for c in ("vec_id", "h", "label")), x, bits)
                    held = []
                if block is not None:
                    for some in range(0, len(b), ANCHORS_AT_ONCE):
                        yield answer(b.slice(some, ANCHORS_AT_ONCE))

    return dealt.mapInArrow(run, "anchor_id long, anchor_h long, band int, score long, vec_id long, h long")


def first(found: DataFrame, n: int) -> DataFrame:
    """The n best of each anchor and band over all blocks, with their rank from 1."""
    place = F.row_number().over(Window.partitionBy("anchor_id", "anchor_h", "band").orderBy(F.desc("score"), "vec_id", "h"))
    return found.withColumn("rank", place).where(F.col("rank") <= n)


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, share: int = 80) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of rows(vec_id, label, embedding).

    For each anchor its first `positives` rows of the same label, and for each of these the first `negatives` of other labels
    with share * positive_score <= 100 * negative_score <= 100 * positive_score.
    """
    spark = one_thread_a_task(rows.sparkSession)
    whole = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.coalesce(is_anchor, F.lit(False)).alias("anchor"), F.col("embedding").cast("array<double>").alias("vector"))
    whole, d = of_one_length(whole.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vector"), LARGEST)), "vector")
    if not d:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    x = written(integers(whole), "integers")
    size = x.agg(F.count("*").alias("n"), F.count(F.when(F.col("anchor"), 1)).alias("a"), F.max(F.array_max("v")).alias("hi"), F.min(F.array_min("v")).alias("lo")).first()
    bits = 1 + max(1, size["hi"].bit_length(), (-size["lo"] - 1).bit_length() if size["lo"] < 0 else 0)
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size["n"] // BLOCK))
    chunks = max(1, -(-size["a"] // ANCHORS))
    anchors = x.where("anchor").dropDuplicates(["vec_id", "h"]).drop("anchor")
    band = lambda v: F.array(F.lit(v).cast("long"))
    best = first(met(x, anchors.withColumns({"low": band(LEAST), "high": band(MOST)}), blocks, chunks, bits, True, positives), positives)
    own = best.groupBy("anchor_id", "anchor_h").agg(F.sort_array(F.collect_list(F.struct("rank", "score", "vec_id"))).alias("own"))  # `positives` at most
    scores = F.transform("own", lambda p: p["score"])
    # All anchors get as many bands: where positives lack, or have a score below 0, the band holds nothing.
    filled = F.concat(scores, F.array_repeat(F.lit(-1).cast("long"), F.lit(positives) - F.size("own")))
    known = written(anchors.join(own, (anchors.vec_id == own.anchor_id) & (anchors.h == own.anchor_h)).drop("anchor_id", "anchor_h").withColumn("scores", filled), "anchors")
    bands = {"low": F.expr(f"transform(scores, s -> IF(s < 0, {MOST}L, (s * {share} + 99) DIV 100))"), "high": F.expr(f"transform(scores, s -> IF(s < 0, {LEAST}L, s))")}
    found = first(met(x, known.withColumns(bands), blocks, chunks, bits, False, negatives), negatives)
    of = known.select(F.col("vec_id").alias("anchor_id"), F.col("h").alias("anchor_h"), F.posexplode("own").alias("band", "p"))
    return found.join(of, ["anchor_id", "anchor_h", "band"]).select("anchor_id", F.col("p.vec_id").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("p.score").alias("positive_score"), F.col("score").alias("negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of the embeddings whose vec_id is divisible by 100, against all; labels of ids divisible by 7 are shifted."""
    rows = embeddings(spark, sf_dir).select("vec_id", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"), "embedding")
    return hard_negatives(rows, F.col("vec_id") % 100 == 0)


QUERIES = {"op12_hard_negatives": op12_hard_negatives}
ORACLES = {
    "op12_hard_negatives": """WITH usable AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS v
    FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
scores AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM usable a JOIN usable b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
ranked AS (SELECT p.anchor_id, positive_id, positive_score, other_id AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) AS rank
    FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 5""",
}
