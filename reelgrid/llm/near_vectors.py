"""Near-duplicate embeddings by sorted projection passes.

1. Equal vectors of a label are one class, held by its least vec_id; copies are counted, not compared.
2. A pass has 64 random hyperplanes of its own. A class's key is its 64 sides, first plane first, and classes are sorted by
   label and key: a range partitioning, so a large label spreads over tasks. Rows at most WINDOW places apart are compared by
   cosine in double precision, in matrix products of two windows. A task also hands out its first and last WINDOW rows; a
   second, small step puts them side by side by their place in the whole order, so windows do not end where partitions do.
   Of the pairs found, as many links leave as are needed to connect the rows of a window.
3. Two vectors of an angle t are on one side of a plane with a chance of 1 - t / pi. Their first log2(n / WINDOW) sides must agree
   to bring them together among n rows of a label, so the number of passes follows from the largest label, such that a pair
   at the threshold is missed by all of them with a chance of 1 % at most. Passes' links are united into components.
4. Every link inside a component is then counted, also those that no window held. Components of up to GROUP classes are compared in
   whole. Of larger ones, vectors within half the threshold's angle of the component's mean direction (its core) are all
   linked with each other, so they need no comparison; only the others, the fringe, are compared with all members, in cells
   of bounded size. Counts leave a cell, no pairs.

Vectors that are null, empty, zero or hold null or non-finite entries link with nothing, nor do those with a null label or a null
vec_id, or of another length than most (of_one_length). Every row is returned; without links it is its own component and kept.
A row with a null vec_id has a null component and is kept. Of repeated rows each counts as a vector of its own, linked with its copies.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgrid.llm.graph import components
from reelgrid.llm.near_dup import grouped
from reelgrid.llm.tables import one_thread_a_task, schema_with, written
from reelgrid.llm.vectors import embeddings, lists, matrix, of_one_length, usable

WINDOW, PLANES, MISSED = 128, 64, 0.01
#: Rows of a sorted partition; passes of one job.
ROWS, PASSES = 1 << 17, 4
#: Classes of a component that is compared in whole, and rows of a cell of a larger one.
GROUP, CELL = 512, 2048
#: Angles this close to the threshold's count as undecided until the cosine is computed.
NEAR = 1e-6


def units(column: pa.Array) -> np.ndarray:
    """A batch's vectors in double precision and of length 1; scaled first, so squares neither vanish nor overflow."""
    x = matrix(column).astype(np.float64)
    if len(x):
        x = x / np.abs(x).max(axis=1, keepdims=True)
        x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x


def passes_for(n: int, threshold: float) -> int:
    """How many passes find a pair at the threshold among n rows but for a chance of MISSED."""
    places = max(0.0, math.log2(max(1, n) / (WINDOW / 2)))
    hit = (1 - math.acos(threshold) / math.pi) ** places
    return 2 if hit > 0.9 else max(2, math.ceil(math.log(MISSED) / math.log(1 - hit)))


def sides(u: np.ndarray, number: int) -> np.ndarray:
    """The rows' sides of a pass's planes as longs in the order of the concatenated bits."""
    planes = np.random.default_rng([13, number]).standard_normal((u.shape[1], PLANES))
    bits = np.packbits(u @ planes > 0, axis=1).view(">u8")[:, 0].astype(np.uint64)
    return (bits ^ np.uint64(1 << 63)).view(np.int64)


def connected(near: np.ndarray) -> np.ndarray:
    """The least row reachable from each row of a symmetric matrix of links."""
    label = np.arange(len(near))
    there = near | np.eye(len(near), dtype=bool)
    while True:
        least = np.where(there, label[None, :], len(near)).min(axis=1)
        least = least[least]
        if (least == label).all():
            return label
        label = least


def links_of(t: pa.Table, near: np.ndarray) -> dict:
    """Columns a, ah, b, bh that connect the rows of a table with these links."""
    some = np.flatnonzero(near.any(axis=1))
    least = some[connected(near[np.ix_(some, some)])]
    a, b = least[least != some], some[least != some]
    ids, hs = t.column("id").to_numpy(), t.column("h").to_numpy()
    return {"a": ids[a], "ah": hs[a], "b": ids[b], "bh": hs[b]}


def windows(t: pa.Table, threshold: float, window: int, first: int, last: int, split: int | None = None):
    """Links of a sorted table's pairs (i, j), first <= i < last, i < j <= i + window; with `split`, of those on both sides of it."""
    u = np.concatenate([units(c) for c in t.column("vector").chunks])
    label = t.column("label").to_numpy()
    turn = t.column("pass").to_numpy()
    for lo in range(first, last, window):
        hi = min(lo + 2 * window, len(u))
        mid = min(lo + window, last)
        near = np.zeros((hi - lo, hi - lo), bool)
        i, j = np.arange(lo, mid)[:, None], np.arange(lo, hi)[None, :]
        ok = (u[lo:mid] @ u[lo:hi].T >= threshold) & (j > i) & (j - i <= window) & (label[i] == label[j]) & (turn[i] == turn[j])
        if split is not None:
            ok &= (i < split) & (j >= split)
        if ok.any():
            near[: mid - lo] = ok
            yield links_of(t.slice(lo, hi - lo), near | near.T)


def pass_links(classes: DataFrame, passes: list[int], parts: int, threshold: float) -> DataFrame:
    """Links (a, b) of classes that meet in the windows of these passes."""
    def keyed(batches):
        for b in batches:
            u = units(b["vector"])
            for p in passes:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(b), p, np.int32)), pa.array(sides(u, p) if len(b) else [], pa.int64())], names=[*b.schema.names, "pass", "key"])

    rows = classes.select("id", "h", "label", "vector")
    order = ["pass", "label", "key", "id", "h"]
    rows = rows.mapInArrow(keyed, schema_with(rows, **{"pass": "int", "key": "long"}))
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    out = schema_with(dealt, a="long", ah="long", b="long", bh="long", part="int", at="long")
    arrow = [f.name for f in out.fields]

    def batch_of(t: pa.Table, links: dict | None, **more):
        """Links, or rows for the border, as batches of the output's columns."""
        n = len(links["a"]) if links else len(t)
        cols = {name: pa.nulls(n, t.schema.field(name).type) if links else t.column(name).combine_chunks() for name in t.schema.names}
        for name, kind in (("a", pa.int64()), ("ah", pa.int64()), ("b", pa.int64()), ("bh", pa.int64()), ("part", pa.int32()), ("at", pa.int64())):
            got = (links or more).get(name)
            cols[name] = pa.nulls(n, kind) if got is None else pa.array(got, kind)
        return pa.RecordBatch.from_arrays([cols[name] for name in arrow], names=arrow)

    def run(batches):
        part, held, start, done, given = TaskContext.get().partitionId(), None, 0, 0, 0
        border = lambda lo, hi: batch_of(held.slice(lo - start, hi - lo), None, part=np.full(hi - lo, part), at=np.arange(lo, hi))
        for b in batches:
            if not len(b):
                continue
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            end = start + len(held)
            if given < WINDOW and (upto := min(end, WINDOW)) > given:
                yield border(given, upto)
                given = upto
            # Rows with a whole window behind them are compared; the last ones wait.
            if (ready := end - WINDOW) > done:
                for links in windows(held, threshold, WINDOW, done - start, ready - start):
                    yield batch_of(held, links)
                done = ready
                held, start = held.slice(max(0, end - WINDOW - start)), max(start, end - WINDOW)
        if held is not None:
            end = start + len(held)
            for links in windows(held, threshold, WINDOW, done - start, end - start):
                yield batch_of(held, links)
            if end > given:
                yield border(max(given, end - WINDOW), end)

    met = written(dealt.mapInArrow(run, out), "pass")
    pair = lambda df: df.select(F.struct(F.col("a").alias("id"), F.col("ah").alias("h")).alias("a"), F.struct(F.col("b").alias("id"), F.col("bh").alias("h")).alias("b"))
    borders = met.where("at IS NOT NULL")
    sizes = dict(borders.groupBy("part").agg((F.max("at") + 1).alias("n")).collect())  # a row per partition
    begins = np.cumsum([0, *(sizes[p] for p in sorted(sizes))])
    begin_of = {p: int(begins[k]) for k, p in enumerate(sorted(sizes))}
    inner = begins[1:-1]
    names = ["border", "place", "id", "h", "label", "vector", "pass"]

    def beside(batches):
        for b in batches:
            place = b["at"].to_numpy() + np.array([begin_of[p] for p in b["part"].to_pylist()], np.int64)
            # Borders o with o - WINDOW <= place < o + WINDOW.
            lo, hi = np.searchsorted(inner, place - WINDOW, "right"), np.searchsorted(inner, place + WINDOW, "right")
            row = np.repeat(np.arange(len(b)), hi - lo)
            o = inner[np.concatenate([np.arange(x, y) for x, y in zip(lo, hi, strict=True)] or [np.zeros(0, int)]).astype(int)] if len(row) else np.zeros(0, np.int64)
            some = b.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(o, pa.int64()), pa.array(place[row], pa.int64()), *(some[n] for n in names[2:])], names=names)

    kind = lambda n: dealt.schema[n].dataType.simpleString()
    near = borders.mapInArrow(beside, "border long, place long, " + ", ".join(f"`{n}` {kind(n)}" for n in names[2:]))

    def across(batches):
        for t in grouped(batches, ["border"]):
            o, place = t.column("border")[0].as_py(), t.column("place").to_numpy()
            split = int(np.searchsorted(place, o))
            for links in windows(t, threshold, WINDOW, max(0, split - WINDOW), split, split):
                yield pa.RecordBatch.from_arrays([pa.array(links[n], pa.int64()) for n in ("a", "ah", "b", "bh")], names=["a", "ah", "b", "bh"])

    more = near.repartition("border").sortWithinPartitions("border", "place").mapInArrow(across, "a long, ah long, b long, bh long")
    return pair(met.where("a IS NOT NULL")).unionByName(pair(written(more, "border")))


def counted(members: DataFrame, threshold: float) -> DataFrame:
    """(id, h, linked): for classes (component, id, h, n, vector) the number of other classes' vectors in their component that they link with."""
    sizes = members.groupBy("component").agg(F.count("*").alias("size"))
    known = members.join(sizes, "component")
    names = ["id", "h", "linked"]
    schema = "id long, h long, linked long"

    def in_whole(batches):
        for t in grouped(batches, ["cid", "ch"]):
            u, n = np.concatenate([units(c) for c in t.column("vector").chunks]), t.column("n").to_numpy()
            linked = (u @ u.T >= threshold).astype(np.int64) @ n - n  # a vector links with itself: its square is 1 up to rounding
            yield pa.RecordBatch.from_arrays([t.column("id").combine_chunks(), t.column("h").combine_chunks(), pa.array(linked, pa.int64())], names=names)

    flat = known.select(F.col("component.id").alias("cid"), F.col("component.h").alias("ch"), "id", "h", "n", "vector", "size")
    small = flat.where(F.col("size") <= GROUP).repartition("cid", "ch").sortWithinPartitions("cid", "ch").mapInArrow(in_whole, schema)
    large = written(flat.where(F.col("size") > GROUP), "large")
    if large.isEmpty():
        return small
    return small.unionByName(beyond(large, threshold))


def beyond(large: DataFrame, threshold: float) -> DataFrame:
    """counted() for components that are too large to compare in whole: rows (cid, ch, id, h, n, vector, size)."""
    def sums(batches):
        for b in batches:
            u, own = units(b["vector"]), np.stack([b["cid"].to_numpy(), b["ch"].to_numpy()], axis=1)
            if len(own):
                keys, of = np.unique(own, axis=0, return_inverse=True)
                total = np.zeros((len(keys), u.shape[1]))
                np.add.at(total, of.reshape(-1), u)
                yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), lists(total, pa.float64())], names=["cid", "ch", "total"])

    parts = large.select("cid", "ch", "vector").mapInArrow(sums, "cid long, ch long, total array<double>")
    total = parts.select("cid", "ch", F.posexplode("total").alias("at", "v")).groupBy("cid", "ch", "at").agg(F.sum("v").alias("v"))
    centre = written(total.groupBy("cid", "ch").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "v"))), lambda e: e["v"]).alias("centre")), "centres")
    half = math.acos(threshold) / 2 - NEAR

    def sorted_out(batches):
        for b in batches:
            u, c = units(b["vector"]), matrix(b["centre"])
            with np.errstate(divide="ignore", invalid="ignore"):
                cos = (u * c).sum(axis=1) / np.sqrt((c * c).sum(axis=1))
            core = np.arccos(np.clip(np.nan_to_num(cos, nan=-1.0), -1, 1)) <= half
            yield pa.RecordBatch.from_arrays([*(b[n] for n in ("cid", "ch", "id", "h", "n", "vector")), pa.array(core)], names=["cid", "ch", "id", "h", "n", "vector", "core"])

    rows = large.select("cid", "ch", "id", "h", "n", "vector")
    rows = written(rows.join(centre, ["cid", "ch"]).select("cid", "ch", "id", "h", "n", "vector", "centre").mapInArrow(sorted_out, schema_with(rows, core="boolean")), "core")
    of = rows.groupBy("cid", "ch").agg(F.sum(F.when(F.col("core"), F.col("n")).otherwise(0)).alias("core_n"), F.ceil(F.sum((~F.col("core")).cast("long")) / CELL).cast("int").alias("fringes"), F.ceil(F.count("*") / CELL).cast("int").alias("blocks"))
    known = rows.join(of, ["cid", "ch"])
    inside = known.where("core").select("id", "h", (F.col("core_n") - F.col("n")).alias("linked"))
    # A cell is a part of the fringe and a part of all members.
    own = lambda many: F.pmod(F.xxhash64("id", "h"), many).cast("int")
    upto = lambda many: F.sequence(F.lit(0), many - 1)
    fringe = known.where("NOT core").select("cid", "ch", own(F.col("fringes")).alias("i"), F.explode(upto(F.col("blocks"))).alias("j"), F.lit(0).alias("side"), "id", "h", "n", "vector", "core")
    every = known.where("fringes > 0").select("cid", "ch", F.explode(upto(F.col("fringes"))).alias("i"), own(F.col("blocks")).alias("j"), F.lit(1).alias("side"), "id", "h", "n", "vector", "core")
    cell = ["cid", "ch", "i", "j"]

    def compared(batches):
        for t in grouped(batches, cell):
            side, n, core = (t.column(c).to_numpy() for c in ("side", "n", "core"))
            u = np.concatenate([units(c) for c in t.column("vector").chunks])
            ids, hs = t.column("id").to_numpy(), t.column("h").to_numpy()
            f, m = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            near = (u[f] @ u[m].T >= threshold) & ((ids[f][:, None] != ids[m][None, :]) | (hs[f][:, None] != hs[m][None, :]))
            to_f, to_m = near.astype(np.int64) @ n[m], near.T.astype(np.int64) @ n[f]
            m_core = core[m].astype(bool)  # the fringe's own counts come from its side
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([ids[f], ids[m][m_core]])), pa.array(np.concatenate([hs[f], hs[m][m_core]])), pa.array(np.concatenate([to_f, to_m[m_core]]), pa.int64())], names=["id", "h", "linked"])

    cells = fringe.unionByName(every).repartition(*cell).sortWithinPartitions(*cell).mapInArrow(compared, "id long, h long, linked long")
    return inside.unionByName(cells).groupBy("id", "h").agg(F.sum("linked").alias("linked"))


def near_vectors(rows: DataFrame, threshold: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of rows(vec_id, label, embedding)."""
    spark = one_thread_a_task(rows.sparkSession)
    zero = F.lit(0).cast(rows.schema["embedding"].dataType.elementType)
    every = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.transform("embedding", lambda x: x + zero).alias("vector"))  # -0.0 becomes 0.0
    links = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & usable(F.col("vector")) & F.exists("vector", lambda x: x != zero)
    every = every.withColumns({"h": F.when(links, F.xxhash64("label", "vector")), "h2": F.when(links, F.xxhash64("vector", "label"))})
    classes, d = of_one_length(every.where("h IS NOT NULL"), "vector")
    if not d:
        return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"), F.lit(True).alias("kept"))
    classes = written(classes.groupBy("h", "h2").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("vector").alias("vector")), "classes")
    by_label = classes.groupBy("label").count().agg(F.sum("count"), F.max("count")).first()
    turns = passes_for(by_label[1], threshold)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-by_label[0] * PASSES // ROWS))
    found = None
    for at in range(0, turns, PASSES):
        some = pass_links(classes, list(range(at, min(turns, at + PASSES))), parts, threshold)
        found = some if found is None else found.unionByName(some)
    label = components(found)
    members = classes.join(label, F.struct("id", "h") == label.node).select("component", "id", "h", "n", "vector")
    linked = counted(written(members, "members"), threshold)
    node = label.select(F.col("node.id").alias("id"), F.col("node.h").alias("h"), F.col("component.id").alias("component_id"))
    of_class = classes.select("id", "h", "h2", "n").join(node, ["id", "h"], "left").join(linked, ["id", "h"], "left")
    of_class = of_class.select("h", "h2", F.coalesce("component_id", "id").alias("component"), (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("links"))
    out = every.select("vec_id", "h", "h2").join(of_class, ["h", "h2"], "left")
    out = out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op13_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding's links and component at cosine 0.93 within its label."""
    return near_vectors(embeddings(spark, sf_dir).select("vec_id", "label", "embedding"))


QUERIES = {"op13_near_vectors": op13_near_vectors}
ORACLES = {
    "op13_near_vectors": """WITH RECURSIVE usable AS (SELECT vec_id, label, embedding AS v FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
scaled AS (SELECT vec_id, label, list_transform(v, lambda c: CAST(c AS DOUBLE)) AS v FROM usable),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM scaled a JOIN scaled b ON a.label = b.label AND a.vec_id <> b.vec_id
    WHERE list_inner_product(a.v, b.v) >= 0.93 * sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
found AS (SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, least(vec_id, coalesce((SELECT min(b) FROM reach WHERE a = vec_id), vec_id)) AS component_id FROM embeddings)
SELECT vec_id, n_links, component_id, vec_id = component_id AS kept FROM found""",
}
