"""MinHash near duplicates by an inverted join over signature coordinates.

1. Each text's set of word shingles, a key of the whole set and a signature of N coordinates are
   made in one pass. Texts of equal sets are one class; classes are numbered, since a doc_id may stand for several texts.
2. Each class is posted under its (coordinate, value) pairs. Pairs of frequency one are of no use;
   a class with fewer than MATCHES others can't reach the threshold and leaves. Of the rest only
   the rarest N - MATCHES + 1 coordinates are merged (two classes that agree in MATCHES of N
   coordinates share one of those); the frequent lists are skipped, and their coordinates count
   only when the two signatures are compared.
3. First every class meets the least class of each of its lists, which joins large groups of
   copies by few links. Then, in lists that still hold more than one component, classes of
   different components are compared, in parts of bounded size and each pair in the list of its
   first common coordinate only. A second, longer sketch rules out most pairs that are similar but
   not enough; for the rest the full sets are in the part, links join components as they are found,
   and only links leave it, fewer than its rows.
4. A pair with at least MATCHES equal coordinates is confirmed on the full sets: linked if
   100 * intersection >= threshold * union. Components of the links are the classes of the result.
   Rows sent grow with the lists' lengths; in a list of more than BLOCK rows they grow with the
   rows outside its largest component times its blocks.

Tables that grow with the input are merged by hints where Spark would go by the sizes of files: sixty-four values in a list,
or sets of long strings, take far more as rows than as a compressed column, and a broadcast of them passes through the driver.

For sets of similarity 0.8 the chance that fewer than 36 of 64 coordinates agree, or that more than
148 of the 1024 bits differ (102 are expected), is below 1e-5.

Texts that are null, empty or without words have an empty set, link with nothing and are kept.
Rows of one doc_id with different texts are documents of their own, each in its text's component. A row with a null doc_id is never kept when another
row has its set, and never represents other rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgrid.llm.bpe import batches_of
from reelgrid.llm.graph import components
from reelgrid.llm.tables import documents, written
from reelgrid.llm.words import shingle_sets, signature, words_of

COORDINATES, MATCHES = 64, 36
#: Rows of a list, and bytes of their full sets, that are compared in one part.
BLOCK, BLOCK_BYTES = 4096, 64 << 20
#: Second sketch, of classes that share coordinates: one bit of each of so many further coordinates, and how many may differ.
BITS, DIFFERENT = 1024, 148


def key_of(shingles: np.ndarray) -> bytes | None:
    """A key of a whole set; none for an empty one."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, set_key (null for an empty set) and sig of every row."""

    def run(batches):
        for whole in batches:
            for b in batches_of(whole, "text"):
                n, keys, sigs = [], [], []
                for s in shingle_sets(words_of(b.column(1).to_pylist()), k):
                    n.append(len(s))
                    keys.append(key_of(s))
                    sigs.append(signature(s, COORDINATES) if len(s) else None)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.list_(pa.int32()))], names=["doc_id", "n_shingles", "set_key", "sig"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, set_key binary, sig array<int>")


def full_sets(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, set_key, the sorted 64-bit shingle hashes of each text, and its second sketch, as bytes."""

    def run(batches):
        for whole in batches:
            for b in batches_of(whole, "text"):
                sets = shingle_sets(words_of(b.column(1).to_pylist()), k)
                bits = [np.packbits(signature(s, COORDINATES + BITS)[COORDINATES:] & 1).tobytes() for s in sets]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([key_of(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array(bits, pa.binary())], names=["doc_id", "set_key", "shingles", "bits"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, set_key binary, shingles binary, bits binary")


def postings(classes: DataFrame) -> DataFrame:
    """(key, id, n): each class under the rarest of its coordinates that another class shares; n is the list's length."""
    every = classes.select(
        "id",
        F.posexplode("sig").alias("at", "value"),
    ).select("id", (F.shiftleft(F.col("at").cast("long"), 32) + F.col("value").cast("long") + F.lit(1 << 31)).alias("key"))
    often = every.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = every.join(often.hint("merge"), "key").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("own"))  # N at most
    shared = shared.where(F.size("own") >= MATCHES)
    rarest = F.slice("own", F.lit(1), F.greatest(F.lit(0), F.size("own") - (MATCHES - 1)))
    return shared.select("id", F.explode(rarest).alias("p")).select("p.key", "id", "p.n")


def agreeing(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Of pairs (a, b), those whose signatures agree in MATCHES coordinates."""
    sig = classes.select("id", "sig").hint("merge")
    both = pairs.join(sig.select(F.col("id").alias("a"), F.col("sig").alias("x")), "a").join(sig.select(F.col("id").alias("b"), F.col("sig").alias("y")), "b")
    same = F.aggregate(F.zip_with("x", "y", lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, e: n + e)
    return both.where(same >= MATCHES).select("a", "b")


def confirmed(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Of pairs (a, b), those with 100 * intersection >= threshold * union of the full sets."""
    own = sets.select("id", "shingles").hint("merge")
    with_b = pairs.join(own.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    both = with_b.join(own.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").select("a", "b", "x", "y")

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                z = np.concatenate((x, y))
                z.sort(kind="stable")
                shared = int(np.count_nonzero(z[1:] == z[:-1]))
                keep.append(100 * shared >= threshold * (len(z) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def grouped(batches, of: list[str]):
    """Tables of the rows with equal values in columns `of`, of batches sorted by them; one is held at a time."""
    held = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if held is None else pa.concat_tables([held, t])
        cols = [t.column(c).to_numpy() for c in of]
        edge = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        at = [0, *edge.tolist()]
        for lo, hi in zip(at[:-1], at[1:], strict=True):
            yield t.slice(lo, hi - lo)
        held = t.slice(at[-1])
    if held is not None and len(held):
        yield held


class Sketches:
    """The rows of one group, and which of them agree."""

    def __init__(self, t: pa.Table):
        self.at, self.whole = int(t.column("key")[0].as_py()) >> 32, t.column("whole")[0].as_py()
        self.side = t.column("side").to_numpy()
        self.sig = t.column("sig").combine_chunks().values.to_numpy().reshape(len(t), COORDINATES)
        self.bits = np.frombuffer(b"".join(t.column("bits").to_pylist()), np.uint64).reshape(len(t), -1)
        self.used = (t.column("merged").to_numpy()[:, None] >> np.arange(COORDINATES) & 1).astype(bool)

    def agree(self, r: int, component: np.ndarray) -> np.ndarray:
        """Rows behind r of other components that look similar to it and have this list's coordinate as first common one."""
        ok = component[r + 1 :] != component[r]
        if not self.whole:
            ok &= self.side[r + 1 :] != self.side[r]
        there = np.flatnonzero(ok) + r + 1
        if len(there):
            there = there[np.bitwise_count(self.bits[there] ^ self.bits[r]).sum(axis=1, dtype=np.int64) <= DIFFERENT]
        if len(there):
            same = self.sig[there] == self.sig[r]
            there = there[(same.sum(axis=1) >= MATCHES) & ((same & self.used[there] & self.used[r]).argmax(axis=1) == self.at)]
        return there


def placed(lists: DataFrame, label: DataFrame, sizes: DataFrame) -> DataFrame:
    """(key, part, side, whole, id, component) of the rows of lists that hold several components.

    A list of BLOCK rows and BLOCK_BYTES of sets is one part. Of a longer one, the rows of its largest component, which need
    no comparison among themselves, are dealt once over parts of that size; the rest, whose rows go to each of these, is
    compared with itself in parts of two blocks.
    """
    known = lists.join(label.hint("merge"), lists.id == label.node, "left").select("key", "id", F.coalesce("component", "id").alias("component")).join(sizes.hint("merge"), "id")
    of = known.groupBy("key", "component").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    blocks = lambda n, size: F.ceil(F.greatest(n / BLOCK, size / BLOCK_BYTES)).cast("int")
    mixed = of.groupBy("key").agg(F.count("*").alias("components"), F.max_by(F.struct("component", "n", "bytes"), F.struct("n", "component")).alias("top"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).where("components > 1")
    mixed = mixed.select("key", F.col("top.component").alias("major"), blocks(F.col("n"), F.col("bytes")).alias("all"), blocks(F.col("top.n"), F.col("top.bytes")).alias("major_blocks"), blocks(F.col("n") - F.col("top.n"), F.col("bytes") - F.col("top.bytes")).alias("rest_blocks"))
    rows = known.join(mixed, "key")
    number = F.xxhash64("id")
    part = lambda p, side, whole: F.struct(p.alias("part"), side.cast("int").alias("side"), whole.alias("whole"))
    own = F.pmod(number, F.col("rest_blocks")).cast("int")
    with_rest = F.transform(F.sequence(F.lit(0), F.col("rest_blocks") - 1), lambda o: part(F.col("major_blocks") + F.least(o, own) * F.col("rest_blocks") + F.greatest(o, own), own > o, o == own))
    with_major = F.transform(F.sequence(F.lit(0), F.col("major_blocks") - 1), lambda o: part(o, F.lit(1), F.lit(False)))
    to = F.when(F.col("all") == 1, F.array(part(F.lit(0), F.lit(0), F.lit(True)))).when(F.col("component") == F.col("major"), F.array(part(F.pmod(number, F.col("major_blocks")).cast("int"), F.lit(0), F.lit(False)))).otherwise(F.concat(with_major, with_rest))
    return rows.select("key", "id", "component", F.explode(to).alias("to")).select("key", "to.part", "to.side", "to.whole", "id", "component")


def across(lists: DataFrame, label: DataFrame, classes: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Links (a, b) between components that meet in a list, fewer than the rows of each part.

    First the sketches of a part's rows tell which have a similar row of another component there; only these get their full
    sets, and within the part links are confirmed and join components at once, so pairs neither leave it nor repeat.
    """
    sizes = sets.select("id", F.octet_length("shingles").alias("bytes"))
    merged = lists.groupBy("id").agg(F.sum(F.expr("shiftleft(1L, cast(shiftright(key, 32) as int))")).alias("merged"))  # a bit per coordinate
    sketches = classes.select("id", "sig").join(merged.hint("merge"), "id").join(sets.select("id", "bits").hint("merge"), "id")
    names = ["key", "part", "side", "whole", "id", "component", "merged", "sig", "bits"]
    rows = placed(lists, label, sizes).join(sketches, "id").select(*names)
    dealt = lambda df: df.repartition("key", "part").sortWithinPartitions("key", "part")

    def met(batches):
        for t in grouped(batches, ["key", "part"]):
            sketch, component, similar = Sketches(t), t.column("component").to_numpy(), np.zeros(len(t), bool)
            for r in range(len(t) - 1):
                there = sketch.agree(r, component)
                similar[there] = True
                similar[r] |= len(there) > 0
            if similar.any():
                yield from t.filter(pa.array(similar)).to_batches()

    some = dealt(rows).mapInArrow(met, rows.schema)
    some = some.join(sets.select("id", "shingles").hint("merge"), "id").select(*names, "shingles")

    def linked(batches):
        for t in grouped(batches, ["key", "part"]):
            sketch, component, ids = Sketches(t), t.column("component").to_numpy().copy(), t.column("id").to_numpy()
            own = [np.frombuffer(x.as_buffer(), np.uint64) for c in t.column("shingles").chunks for x in c]
            sizes = np.array([len(x) for x in own])
            # Shingles of the part by number, so that one row is compared with many by lookups.
            values, number = np.unique(np.concatenate(own), return_inverse=True)
            number = np.split(number, np.cumsum(sizes)[:-1])
            there_is, a, b = np.zeros(len(values), np.int64), [], []
            for r in range(len(t) - 1):
                there = sketch.agree(r, component)
                if not len(there):
                    continue
                there_is[number[r]] = 1
                for x in there.tolist():
                    if component[x] == component[r]:
                        continue
                    shared = int(there_is[number[x]].sum())
                    if 100 * shared >= threshold * (sizes[x] + sizes[r] - shared):
                        a.append(min(ids[x], ids[r]))
                        b.append(max(ids[x], ids[r]))
                        component[component == component[x]] = component[r]
                there_is[number[r]] = 0
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return dealt(some).mapInArrow(linked, "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 5, threshold: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs(doc_id, text, ...)."""
    sigs = written(signatures(docs, k), "signatures")
    classes = sigs.where("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("least"), F.first("sig").alias("sig")).where("least is not null")
    classes = written(classes.withColumn("id", F.monotonically_increasing_id()), "classes")  # what is written counts, however often a task ran
    lists = written(postings(classes), "postings")
    member = classes.select("set_key", "least", "id").join(lists.select("id").distinct().hint("merge"), "id", "left_semi")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = texts.join(member.select(F.col("least").alias("doc_id")).distinct().hint("merge"), "doc_id", "left_semi")
    sets = full_sets(texts, k).dropDuplicates(["set_key", "doc_id"]).join(member.withColumnRenamed("least", "doc_id").hint("merge"), ["set_key", "doc_id"])
    sets = written(sets.select("id", "shingles", "bits"), "sets")
    heads = lists.groupBy("key").agg(F.min("id").alias("a"), F.count("*").alias("m")).where("m > 1")
    star = lists.join(heads, "key").where("id <> a").select("a", F.col("id").alias("b")).distinct()
    links = written(confirmed(agreeing(star, classes), sets, threshold), "links")
    label = components(links)
    more = written(across(lists, label, classes, sets, threshold), "links")
    label = components(links.union(more))
    linked = classes.select("set_key", "least", "id").join(label.hint("merge"), F.col("id") == label.node, "left").select("set_key", "least", "component")
    ends = linked.where("component is not null").groupBy("component").agg(F.min("least").alias("first"))
    of_class = linked.join(ends, "component", "left").select("set_key", F.coalesce("first", "least").alias("class_component"))
    return (
        sigs.select("doc_id", "n_shingles", "set_key")
        .join(of_class, "set_key", "left")
        .select("doc_id", "n_shingles", F.coalesce("class_component", "doc_id").alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component under four-word shingles and similarity 0.8."""
    return near_duplicates(documents(spark, sf_dir), k=4, threshold=80)


QUERIES = {"op3_near_duplicates": op3_near_duplicates}
ORACLES: dict[str, str] = {}
