"""Scoring by a gated recurrent language model with a class-factored softmax, in numpy.

1. Token counts of all training documents are one aggregation by 64-bit token hash, summed within
   tasks first. They grow with the input and stay distributed; only the HEAD most frequent tokens,
   a fixed number, are sent to all tasks.
2. Output classes follow frequency: the most frequent tokens (one in WORD_OF of the counted ones) are
   classes of equal size whose members the hidden state tells apart, and have input rows of their own;
   rarer ones are a few bands, within which a token has its smoothed share of the band's counts. The
   last band holds all tokens beyond HEAD and unknown ones.
   log P(token) = log P(class | state) + log P(token | class, state).
3. Training: every training document is in one of ROUNDS rounds and there in one shard, by hash. Shards
   have SHARE tokens for each learned word on average, whatever the files. In each round every shard is
   learned from by truncated backpropagation, in order of hash, from the same start: Adam for what all
   tokens use, Adagrad for the rows of words. The parameters are then averaged by Spark, weighted by tokens.
4. Scoring: all documents of a batch advance together, a window of steps at a time; a document's
   state is carried from window to window to its end, so whole texts are scored. Tokens beyond
   HEAD get their counts by a join of (document, token) rows with the counts table.

Null text counts as empty: its only token is the end. Each row is scored by itself, repeated ones and
those with a null doc_id too. Without training documents all tokens are unknown.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgrid.llm.bpe import batches_of
from reelgrid.llm.tables import documents, one_thread_a_task, remainder, written
from reelgrid.llm.words import mix, words_of

END = mix(np.array([0x656E64], np.uint64))
HEAD = 1 << 18
#: Bits of a hash behind those that index the head.
LEAD = np.uint64(64 - 18)
#: Learned words: a power of two, one in WORD_OF of the counted ones or less.
WORDS_LEAST, WORDS_MOST, WORD_OF = 1 << 10, 1 << 15, 16
#: Ranks where a band ends, those above the learned words; the head ends the last but one.
BANDS = (8192, 65536, HEAD)
STEPS = 32
HIDDEN, WINDOW, LANES_LEAST, LANES, ROUNDS, SHARE, RATE, ROW_RATE = 24, 16, 32, 512, 4, 64, 0.004, 0.1
#: Rows of a softmax at a time, and parameters of a block that are averaged together.
ROWS, BLOCK = 1 << 8, 1 << 12
LN10 = float(np.log(10))


def tokens_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, each closed by the end token, and where each text starts."""
    w = words_of(texts)
    first = w.first + np.arange(len(w.first))
    out = np.empty(first[-1], np.uint64)
    ends = first[1:] - 1
    word = np.ones(len(out), bool)
    word[ends] = False
    out[word] = w.hashes()
    out[ends] = END
    return out, first


class Head:
    """The most frequent tokens, their ranks and counts, and the sizes of the classes."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, total: int, distinct: int):
        order = np.lexsort((hashes, -counts))
        hashes, counts = hashes[order], counts[order].astype(np.float64)
        self.total, self.distinct = total, distinct
        self.words = min(WORDS_MOST, max(WORDS_LEAST, 1 << max(1, int(distinct) // WORD_OF).bit_length() - 1))
        self.classes = 1 << (self.words.bit_length() - 1) // 2
        self.members = self.words // self.classes
        bands = [b for b in BANDS if b > self.words]
        self.n_classes, self.inputs = self.classes + len(bands) + 1, self.words + len(bands) + 1
        by_hash = np.argsort(hashes)
        self.hashes, self.ranks = hashes[by_hash], by_hash.astype(np.int32)
        # Where the hashes of each leading bits begin: a token's place is there or a few further.
        self.begin = np.searchsorted(self.hashes >> LEAD, np.arange(1 << 64 - int(LEAD), dtype=np.uint64)).astype(np.int32)
        self.counts = np.append(counts, 0)
        base = np.log10((counts + 0.5) / (total + 0.5 * (distinct + 1)))
        self.base = np.append(base, 0)
        rank = np.arange(len(counts))
        # Class of each rank, its input row and its fixed log share within a band (0 for learned ones); the last entry is the tail.
        band = np.searchsorted(bands, rank, "right")
        self.cls = np.append(np.where(rank < self.words, rank // self.members, self.classes + band), self.n_classes - 1).astype(np.int32)
        self.input = np.append(np.where(rank < self.words, rank, self.words + band), self.inputs - 1).astype(np.int32)
        self.share = np.zeros(len(counts) + 1)
        mass = np.zeros(self.n_classes)
        np.add.at(mass, self.cls[:-1], counts + 0.5)
        for c in range(self.classes, self.n_classes - 1):
            here = self.cls[:-1] == c
            self.share[:-1][here] = np.log((counts[here] + 0.5) / mass[c]) if here.any() else 0
        self.tail_tokens, self.tail_distinct = total - counts.sum(), distinct - len(counts)
        mass[-1] += self.tail_tokens + 0.5 * (self.tail_distinct + 1)
        self.class_bias = np.log(np.maximum(mass, 0.5) / np.maximum(mass, 0.5).sum()).astype(np.float32)
        words = np.zeros(self.words)
        words[: min(self.words, len(counts))] = counts[: self.words]
        self.word_bias = np.log(words + 0.5).astype(np.float32)

    def rank(self, tokens: np.ndarray) -> np.ndarray:
        """Rank of each token; len(hashes) beyond the head."""
        n = len(self.hashes)
        if not n:
            return np.zeros(len(tokens), np.int32)
        at = np.minimum(self.begin[tokens >> LEAD], n - 1)
        left = np.flatnonzero(self.hashes[at] < tokens)
        while len(left):
            at[left] += 1
            left = left[at[left] < n]
            left = left[self.hashes[at[left]] < tokens[left]]
        at = np.minimum(at, n - 1)
        return np.where(self.hashes[at] == tokens, self.ranks[at], n).astype(np.int32)


def shapes(head: Head) -> dict[str, tuple]:
    return {"x": (head.inputs, 3 * HIDDEN), "u": (HIDDEN, 3 * HIDDEN), "b": (3 * HIDDEN,), "c": (HIDDEN, head.n_classes), "cb": (head.n_classes,), "w": (head.words, HIDDEN), "wb": (head.words,)}


def start(head: Head) -> dict[str, np.ndarray]:
    r = np.random.default_rng(7)
    p = {k: (r.standard_normal(s) * 0.1).astype(np.float32) for k, s in shapes(head).items()}
    return p | {"b": np.zeros(3 * HIDDEN, np.float32), "cb": head.class_bias.copy(), "wb": head.word_bias.copy()}


def flat(p: dict) -> np.ndarray:
    return np.concatenate([x.ravel() for x in p.values()])


def unflat(v: np.ndarray, like: dict) -> dict:
    """Parameters of the shapes of `like`; what follows them in v is padding."""
    out, at = {}, 0
    for k, x in like.items():
        out[k] = v[at : at + x.size].reshape(x.shape).astype(np.float32)
        at += x.size
    return out


def step(p: dict, x: np.ndarray, h: np.ndarray):
    """One step of states h, a column each, on inputs x, which are overwritten; gates are whole rows, so numpy runs over long ones."""
    a = p["u"].T @ h
    g, n, an = x[: 2 * HIDDEN], x[2 * HIDDEN :], a[2 * HIDDEN :]
    g += a[: 2 * HIDDEN]
    np.negative(g, out=g)
    np.exp(g, out=g)
    g += 1
    np.divide(1, g, out=g)
    z, r = g[:HIDDEN], g[HIDDEN:]
    n += r * an
    np.tanh(n, out=n)
    new = h - n
    new *= z
    new += n
    return new, (z, r, n, an)


def outputs(p: dict, head: Head, h: np.ndarray, ranks: np.ndarray, grads: dict | None = None):
    """Natural log probabilities of tokens given states; with grads, adds the loss's gradients and returns that of the states.

    A gradient is (exp(logits) - total at the token) / total; dividing the states by total instead saves a pass over the logits,
    and a state's last entry of 1 makes the bias a weight.
    grads["w"] and grads["wb"] get the learned classes that occur, in order, with grads["classes"].
    """
    cls = head.cls[ranks]
    # |h| <= 1 in each entry, so norms bound the logits; float32 exponentials overflow above 88.
    largest = max(float(np.einsum("ij,ij->j", p["c"], p["c"]).max()), float(np.einsum("ij,ij->i", p["w"], p["w"]).max()))
    safe = (HIDDEN * largest) ** 0.5 + max(float(np.abs(p["cb"]).max()), float(np.abs(p["wb"]).max())) < 80
    out, dh = head.share[ranks], None if grads is None else np.empty_like(h)
    states = np.ones((len(h), HIDDEN + 1), np.float32)
    states[:, :HIDDEN] = h

    def part(here, own, w, wb, one, at):
        """w: HIDDEN columns, wb: w with the bias as one more, one: as many ones. Adds to out; the gradients of states and wb."""
        row = np.arange(len(own))
        d = own @ wb.T
        if not safe:
            d -= d.max(axis=1, keepdims=True)
        mine = d[row, at]
        np.exp(d, out=d)
        total = d @ one
        out[here] += mine - np.log(total)
        if grads is None:
            return None
        d[row, at] -= total
        by = (1 / total)[:, None]
        back = d @ w
        back *= by
        return back, d.T @ (own * by)

    w, one = np.ascontiguousarray(p["c"].T), np.ones(head.n_classes, np.float32)
    wb = np.column_stack((w, p["cb"]))
    for lo in range(0, len(h), ROWS):
        here = slice(lo, lo + ROWS)
        got = part(here, states[here], w, wb, one, cls[here])
        if grads is not None:
            dh[here] = got[0]
            grads["c"] += got[1][:, :HIDDEN].T
            grads["cb"] += got[1][:, HIDDEN]
    order = np.argsort(cls, kind="stable")
    edge = np.searchsorted(cls[order], np.arange(head.classes + 1))
    order = order[: edge[-1]]
    own, at = states[order], ranks[order]
    found = np.flatnonzero(np.diff(edge))
    if grads is not None:
        both = np.zeros((len(found), head.members, HIDDEN + 1), np.float32)
        grads["classes"], grads["w"], grads["wb"] = found, both[:, :, :HIDDEN], both[:, :, HIDDEN]
        back = np.empty((len(own), HIDDEN), np.float32)
    wb, one = np.empty((head.members, HIDDEN + 1), np.float32), np.ones(head.members, np.float32)
    for i, c in enumerate(found.tolist()):
        first = c * head.members
        w = p["w"][first : first + head.members]
        wb[:, :HIDDEN], wb[:, HIDDEN] = w, p["wb"][first : first + head.members]
        for lo in range(edge[c], edge[c + 1], ROWS):
            here = slice(lo, min(lo + ROWS, edge[c + 1]))
            got = part(order[here], own[here], w, wb, one, at[here] - first)
            if grads is not None:
                back[here] = got[0]
                both[i] += got[1]
    if grads is not None:
        dh[order] += back
    return out, dh


class Steps:
    """Adam for parameters that every token uses; for rows of words, whose tokens differ in frequency, Adagrad with a sum per row."""

    def __init__(self, p: dict):
        self.m, self.v = ({k: np.zeros_like(p[k]) for k in ("u", "b", "c", "cb")} for _ in range(2))
        self.sums, self.t = {k: np.zeros(len(p[k]), np.float32) for k in ("x", "w", "wb")}, 0

    def apply(self, p: dict, g: dict, rows: dict) -> None:
        """One step. Rows named change only; g has these, in blocks of as many rows each as it says."""
        self.t += 1
        for k, m in self.m.items():
            v, new = self.v[k], g[k]
            m += 0.1 * (new - m)
            v += 0.01 * (new * new - v)
            p[k] -= RATE * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.99**self.t)) + 1e-6)
        for k, sums in self.sums.items():
            if not len(rows[k]):
                continue
            new = g[k].reshape(len(rows[k]), -1, *p[k].shape[1:])
            per = new.shape[1]
            square = np.einsum("abc,abc->ab", new, new) / new.shape[2] if new.ndim == 3 else new * new
            s = sums.reshape(-1, per)
            at = slice(None) if len(new) == len(s) else rows[k]
            s[at] += square
            rate = ROW_RATE / (np.sqrt(s[at]) + 1e-6)
            new *= rate[:, :, None] if new.ndim == 3 else rate
            p[k].reshape(-1, per, *p[k].shape[1:])[at] -= new


def train(p: dict, head: Head, docs: list[np.ndarray], steps: Steps | None = None) -> None:
    """Truncated backpropagation over the documents as one stream, cut into equal parts (up to LANES) side by side.

    The state starts anew behind each end token.
    """
    stream = np.concatenate(docs)
    lanes = max(LANES_LEAST, min(LANES, len(stream) // (64 * WINDOW)))
    longest = -(-len(stream) // lanes)
    grid = np.full(longest * lanes, -1, np.int64)
    grid[: len(stream)] = stream
    grid = grid.reshape(lanes, longest).T
    end_rank = int(head.rank(END)[0])
    steps, h = steps or Steps(p), np.zeros((HIDDEN, lanes), np.float32)
    before = np.full(lanes, -1, np.int64)
    for lo in range(0, longest, WINDOW):
        here = grid[lo : lo + WINDOW]
        here = here[: int(np.count_nonzero(here.max(axis=1) >= 0))]  # lanes are filled one after the other, so the first row has most
        g = {k: np.zeros_like(p[k]) for k in ("u", "b", "c", "cb")}
        inputs = np.vstack((before, here[:-1]))
        fresh = (inputs < 0) | (inputs == end_rank)
        stays = (~fresh).astype(np.float32)
        ids = head.input[np.maximum(inputs, 0)]
        x = p["x"][ids]
        x[fresh] = 0
        x += p["b"]
        x = np.ascontiguousarray(x.transpose(0, 2, 1))
        kept, states = [], np.empty((len(here), HIDDEN, lanes), np.float32)
        for k in range(len(here)):
            h *= stays[k]
            was, (h, parts) = h, step(p, x[k], h)
            kept.append((was, parts))
            states[k] = h
        before = here[-1]
        live = here >= 0
        _, d = outputs(p, head, states.transpose(0, 2, 1)[live], here[live], g)
        dh_out = np.zeros((len(here), lanes, HIDDEN), np.float32)
        dh_out[live] = d
        dh_out = np.ascontiguousarray(dh_out.transpose(0, 2, 1))
        dh, dx = np.zeros_like(h), np.empty((len(here), 3 * HIDDEN, lanes), np.float32)
        da = np.empty((3 * HIDDEN, lanes), np.float32)
        for k in range(len(here) - 1, -1, -1):
            was, (z, r, n, an) = kept[k]
            dh += dh_out[k]
            dn = dh - dh * z
            dn *= 1 - n * n
            np.multiply(dh, was - n, out=da[:HIDDEN])
            da[:HIDDEN] *= z - z * z
            np.multiply(dn, an, out=da[HIDDEN : 2 * HIDDEN])
            da[HIDDEN : 2 * HIDDEN] *= r - r * r
            np.multiply(dn, r, out=da[2 * HIDDEN :])
            dx[k, : 2 * HIDDEN], dx[k, 2 * HIDDEN :] = da[: 2 * HIDDEN], dn
            g["u"] += was @ da.T
            dh *= z
            dh += p["u"] @ da
            dh *= stays[k]
        g["b"] += dx.sum(axis=(0, 2))
        ids[fresh] = head.inputs  # behind the last row
        rows, of = np.unique(ids, return_inverse=True)
        of = of.ravel()
        g["x"] = np.stack([np.bincount(of, dx[:, j].ravel(), len(rows)) for j in range(3 * HIDDEN)], axis=1).astype(np.float32)
        if rows[-1] == head.inputs:
            rows, g["x"] = rows[:-1], g["x"][:-1]
        scale = np.float32(1 / max(1, live.sum()))
        classes = g.pop("classes")
        steps.apply(p, {k: v * scale for k, v in g.items()}, {"x": rows, "w": classes, "wb": classes})


def score(p: dict, head: Head, ranks: np.ndarray, first: np.ndarray, rows: int = 1 << 16) -> np.ndarray:
    """Natural log probability of each document, without the shares of tokens beyond the head.

    The states of `rows` tokens at a time are held, or of one step of all documents.
    """
    lens = np.diff(first)
    order = np.argsort(-lens, kind="stable")
    lens, starts = lens[order], first[:-1][order]
    total = np.zeros(len(order))
    h = np.zeros((HIDDEN, len(order)), np.float32)
    inputs = p["x"] + p["b"]
    lo = 0
    while live := int(np.searchsorted(-lens, -lo, "left")):  # documents longer than lo, the longest first
        window = min(256, max(1, rows // live))
        states, tokens, who = [], [], []
        for t in range(lo, lo + window):
            m = int(np.searchsorted(-lens, -t, "left"))
            if not m:
                break
            x = inputs[head.input[ranks[starts[:m] + t - 1]]] if t else np.broadcast_to(p["b"], (m, 3 * HIDDEN))
            h, _ = step(p, np.array(x.T, order="C"), h[:, :m])
            states.append(h.T)
            tokens.append(ranks[starts[:m] + t])
            who.append(np.arange(m))
        lp, _ = outputs(p, head, np.concatenate(states), np.concatenate(tokens))
        total[:live] += np.bincount(np.concatenate(who), lp, live)
        lo += window
    out = np.empty(len(order))
    out[order] = total
    return out


def token_counts(docs: DataFrame) -> DataFrame:
    """(token, c): how often each token hash stands in docs."""

    def run(batches):
        held, n = [], 0
        for whole in batches:
            for b in batches_of(whole, "text"):
                held.append(tokens_of(b.column(0).to_pylist())[0])
                n += len(held[-1])
                if n > 4_000_000:
                    t, c = np.unique(np.concatenate(held), return_counts=True)
                    held, n = [], 0
                    yield pa.RecordBatch.from_arrays([pa.array(t.view(np.int64)), pa.array(c)], names=["token", "c"])
        if held:
            t, c = np.unique(np.concatenate(held), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(t.view(np.int64)), pa.array(c)], names=["token", "c"])

    return docs.select("text").mapInArrow(run, "token long, c long").groupBy("token").agg(F.sum("c").alias("c"))


def head_of(counts: DataFrame) -> Head:
    """The most frequent tokens, HEAD at most; these, two sums and a histogram come to the driver.

    The histogram has STEPS bins per doubling of the count; the bins from the top that hold HEAD tokens at most are taken
    whole, so no task sorts or gathers more than the head.
    """
    bins = counts.groupBy(F.floor(F.log2("c") * STEPS).alias("bin")).agg(F.sum("c").alias("c"), F.count("*").alias("n")).orderBy(F.desc("bin")).collect()
    total, distinct = sum(r.c for r in bins), sum(r.n for r in bins)
    lowest, taken = None, 0
    for r in bins:
        taken += r.n
        if taken > HEAD:
            break
        lowest = r.bin
    top = counts.where(F.lit(False) if lowest is None else F.floor(F.log2("c") * STEPS) >= lowest).toArrow()
    return Head(top.column("token").to_numpy().view(np.uint64), top.column("c").to_numpy(), total, distinct)


def dealt(docs: DataFrame, rounds: int, shards: int) -> DataFrame:
    """(round, shard, key, text) of every document, by hash of id and text."""
    key = F.xxhash64("doc_id", "text")
    return docs.select(F.pmod(key, F.lit(rounds)).alias("round"), F.pmod(F.xxhash64(F.lit(1), "doc_id", "text"), F.lit(shards)).alias("shard"), key.alias("key"), "text")


def fit(docs: DataFrame, head: Head, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """Parameters after averaging `rounds` times; every document is learned from once, in its round and shard."""
    spark, p = one_thread_a_task(docs.sparkSession), start(head)
    shared_head = spark.sparkContext.broadcast(head)
    share = SHARE * head.words
    shards = max(1, round(head.total / rounds / share))
    parts = dealt(docs, rounds, shards)
    for i in range(rounds):
        shared = spark.sparkContext.broadcast(p)

        def run(batches, shared=shared):
            shard, own, steps, held, n, done = None, None, None, [], 0, 0

            def learn():
                nonlocal held, n, done
                if held:
                    train(own, shared_head.value, held, steps)
                held, n, done = [], 0, done + n

            def blocks():
                v = flat(own)
                v = np.append(v, np.zeros(-len(v) % BLOCK, np.float32))
                count = len(v) // BLOCK
                values = pa.ListArray.from_arrays(pa.array(np.arange(count + 1, dtype=np.int32) * BLOCK), pa.array(v))
                return pa.RecordBatch.from_arrays([pa.array(np.arange(count, dtype=np.int32)), pa.array(np.full(count, float(done))), values], names=["block", "n", "v"])

            for whole in batches:
                for b in batches_of(whole, "text"):
                    t, first = tokens_of(b.column(1).to_pylist())
                    r = shared_head.value.rank(t)
                    for of, x, y in zip(b.column(0).to_pylist(), first[:-1], first[1:], strict=True):
                        if of != shard:
                            if shard is not None:
                                learn()
                                yield blocks()
                            shard, own, done = of, {k: v.copy() for k, v in shared.value.items()}, 0
                            steps = Steps(own)
                        held.append(r[x:y])
                        n += int(y - x)
                        if n > 2 * share:  # bounds memory; the parameters go on
                            learn()
            if shard is not None:
                learn()
                yield blocks()

        def mean(t: pa.Table) -> pa.Table:
            n = t.column("n").to_numpy()
            total = np.zeros(BLOCK)
            for one, v in zip(n, t.column("v").combine_chunks(), strict=True):
                total += one * v.values.to_numpy()
            return pa.table({"block": t.column("block")[:1], "v": pa.array([total / n.sum()], pa.list_(pa.float32()))})

        # More partitions than shards, so that few hold two; a partition's shards are learned from one after another.
        part = parts.where(F.col("round") == i).repartition(4 * shards, "shard").sortWithinPartitions("shard", "key").select("shard", "text").mapInArrow(run, "block int, n double, v array<float>")
        out = part.groupBy("block").applyInArrow(mean, "block int, v array<float>").toArrow().sort_by("block")
        if len(out):
            p = unflat(out.column("v").combine_chunks().flatten().to_numpy(), p)
    return p


def scored(docs: DataFrame, counts: DataFrame, head: Head, params: dict) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score of every row."""
    sc = one_thread_a_task(docs.sparkSession).sparkContext
    shared = sc.broadcast((head, params))  # of fixed size
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        head, p = shared.value
        n_head, row = len(head.hashes), TaskContext.get().partitionId() << 40
        for whole in batches:
            for b in batches_of(whole, "text", 8 << 20):
                t, first = tokens_of(b.column(1).to_pylist())
                r = head.rank(t)
                tail = r == n_head
                before = np.concatenate(([0], np.cumsum(tail)))
                base = np.add.reduceat(head.base[r], first[:-1])
                known = np.diff(first) - np.diff(before[first])
                s = score(p, head, r, first)
                rest = pa.ListArray.from_arrays(pa.array(before[first].astype(np.int32)), pa.array(t[tail].view(np.int64)))
                rows = pa.array(np.arange(row, row + len(b)))
                row += len(b)
                yield pa.RecordBatch.from_arrays([b.column(0), rows, pa.array(np.diff(first)), pa.array(known), pa.array(base), pa.array(s / LN10), rest], names=["doc_id", "row", "n_tokens", "known", "base", "model", "rest"])

    rows = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, row long, n_tokens long, known long, base double, model double, rest array<long>")
    rows = written(rows, "scored")
    rare = rows.select("row", F.explode("rest").alias("token")).join(counts, "token", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    all_of = float(head.total + 0.5 * (head.distinct + 1))
    tail_of = float(head.tail_tokens + 0.5 * (head.tail_distinct + 1))
    sums = rare.groupBy("row").agg(
        F.count_if(F.col("c") > 0).alias("rare_known"), F.sum(F.log10((F.col("c") + 0.5) / all_of)).alias("rare_base"), F.sum(F.log10((F.col("c") + 0.5) / tail_of)).alias("rare_model")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    both = rows.drop("rest").join(sums, "row", "left")
    return both.select("doc_id", "n_tokens", (F.col("known") + zero("rare_known")).alias("n_known"), (F.col("base") + zero("rare_base")).alias("base_score"), (F.col("model") + zero("rare_model")).alias("score"))


def op4_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens and log10 probabilities, learned from those that are not held out."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    learn = docs.where(remainder() != 1)
    counts = written(token_counts(learn), "counts")
    head = head_of(counts)
    out = scored(docs, counts, head, fit(learn, head))
    return out.select("doc_id", (remainder() == 1).alias("held_out"), "n_tokens", "n_known", F.lit(int(head.total)).cast("long").alias("train_tokens"), "base_score", "score")


QUERIES = {"op4_recurrent_lm": op4_recurrent_lm}
ORACLES: dict[str, str] = {}
