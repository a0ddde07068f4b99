"""Quality classifier by hierarchical empirical Bayes: document evidence, host and path posteriors.

Evidence: two logistic models, fitted in numpy on at most SAMPLE labelled rows (those of least hash
of doc_id). One tells good from poor texts by shares of bytes, of repeated words and of distinct
words; the other tells toxic texts by hashed words present, with an L1 penalty so that words that
say nothing get no weight.

Sites: soft counts (sums of the evidence) by host and by path are one grouped aggregation each. A
host's rate is shrunk towards the global one, a path's towards its host's, with strengths estimated
from the spread between sites beyond what sampling explains, so sparse sites hardly move. A
document's own evidence is left out of its site's counts. The posterior log odds are the document's
plus the path's minus the global ones.

A null, empty or wordless text has score 0 and is not kept. A null host or path is a site of its
own. Without labels of both kinds the model says what all labels say, or 0.5. Repeated rows of a
doc_id are judged by their own text; in the filter a doc_id goes only if no row of it is kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgrid.llm.bpe import batches_of
from reelgrid.llm.tables import documents, hot_keys, labels, one_thread_a_task, schema_with, written
from reelgrid.llm.words import words_of

SAMPLE, WORD_BITS = 12_000, 17
DENSE = 256 + 4
KEEP_FROM, TOXIC_FROM = 0.5, 0.3


def features(texts: list[str | None]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Shape figures of each text (a row each), and its hashed distinct words."""
    w = words_of(texts, lower=False)
    low = words_of(texts)
    exact, hashed = w.hashes(), (low.hashes() >> np.uint64(64 - WORD_BITS)).astype(np.int32)
    dense, bags = np.zeros((len(texts), DENSE), np.float32), []
    for i, row in enumerate(dense):
        data = w.data[w.texts[i] : w.texts[i + 1] - 1]
        h = exact[w.first[i] : w.first[i + 1]]
        if len(h):
            row[:256] = np.sqrt(np.bincount(data, minlength=256) / len(data))
            row[256] = np.count_nonzero(h[1:] == h[:-1]) / len(h)
            row[257] = len(np.unique(h)) / len(h)
            row[258] = np.log1p(len(h)) / 10
            row[259] = len(data) / len(h) / 20
        bags.append(np.unique(hashed[w.first[i] : w.first[i + 1]]))
    return dense, bags


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_dense(x: np.ndarray, y: np.ndarray, rounds: int = 400, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Logistic regression on scaled columns by Adam."""
    if not len(y):
        return np.zeros(x.shape[1], np.float32), 0.0
    scale = x.std(axis=0) + 1e-3
    z, w, b = x / scale, np.zeros(x.shape[1]), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, rounds + 1):
        e = sigmoid(z @ w + b) - y
        g = np.append(z.T @ e / len(y) + ridge * w, e.mean())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return (w / scale).astype(np.float32), float(b)


def fit_words(bags: list[np.ndarray], y: np.ndarray, rounds: int = 150, l1: float = 2e-4) -> tuple[np.ndarray, float]:
    """Sparse logistic regression on words present, by adaptive proximal steps."""
    size = 1 << WORD_BITS
    at = np.concatenate(bags) if bags else np.empty(0, np.int32)
    lens = np.array([len(b) for b in bags], np.int64)
    doc = np.repeat(np.arange(len(bags)), lens)
    seen = np.bincount(at, minlength=size)
    use = seen[at] >= 3
    at, doc = at[use], doc[use]
    w, b, gg, gb = np.zeros(size), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))), np.full(size, 1e-8), 1e-8
    for _ in range(rounds):
        e = (sigmoid(np.bincount(doc, w[at], len(y)) + b) - y) / len(y)
        g = np.bincount(at, e[doc], size)
        gg += g * g
        rate = 0.3 / np.sqrt(gg)
        w -= rate * g
        w = np.sign(w) * np.maximum(0, np.abs(w) - rate * l1)
        gb += e.sum() ** 2
        b -= 0.1 * e.sum() / np.sqrt(gb)
    return w.astype(np.float32), float(b)


class Evidence:
    def __init__(self, dense: np.ndarray, bags: list[np.ndarray], good: np.ndarray, toxic: np.ndarray):
        self.good, self.toxic = fit_dense(dense, good), fit_words(bags, toxic)

    def scores(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        dense, bags = features(texts)
        (w, b), (u, c) = self.good, self.toxic
        good = sigmoid(dense @ w + b)
        good[[len(x) == 0 for x in bags]] = 0
        return good, sigmoid(np.array([u[x].sum() for x in bags]) + c)


def fit(docs: DataFrame, labelled: DataFrame, sample: int = SAMPLE) -> Evidence:
    """Fitted on at most `sample` labelled documents; only their features come to the driver."""
    picked = labelled.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # `sample` rows at most

    def run(batches):
        for whole in batches:
            for b in batches_of(whole, "text"):
                dense, bags = features(b.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in dense], pa.binary()), pa.array([x.tobytes() for x in bags], pa.binary()), b.column(1), b.column(2)], names=["dense", "words", "quality", "toxic"])

    got = rows.select("text", F.col("quality").cast("int"), F.col("toxic").cast("int")).mapInArrow(run, "dense binary, words binary, quality int, toxic int").toArrow()
    dense = np.array([np.frombuffer(x, np.float32) for x in got.column(0).to_pylist()], np.float32).reshape(-1, DENSE)
    bags = [np.frombuffer(x, np.int32) for x in got.column(1).to_pylist()]
    return Evidence(dense, bags, np.array(got.column(2).to_pylist(), np.float64), np.array(got.column(3).to_pylist(), np.float64))


def evidence(docs: DataFrame, model: Evidence, host: Column, path: Column) -> DataFrame:
    """doc_id, host, path, good and toxic of every row; the text is not carried on."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size
    slim = docs.select("doc_id", host.alias("host"), path.alias("path"), "text")
    schema = schema_with(slim.drop("text"), good="double", toxic="double")

    def run(batches):
        for whole in batches:
            for b in batches_of(whole, "text"):
                good, toxic = shared.value.scores(b.column(3).to_pylist())
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(good, pa.float64()), pa.array(toxic, pa.float64())], names=[f.name for f in schema])

    return slim.mapInArrow(run, schema)


def strength(groups: DataFrame, mean: str) -> float:
    """Pseudo-counts of the prior of groups(n, s, mean): the larger, the less groups differ beyond sampling.

    One row comes to the driver.
    """
    rate = F.col("s") / F.col("n")
    r = groups.agg(
        F.sum("n").alias("n"), F.count("*").alias("k"), F.sum("s").alias("s"),
        F.sum(F.col("n") * (rate - F.col(mean)) ** 2).alias("between"), F.sum(F.col("n") * F.col(mean) * (1 - F.col(mean))).alias("inner"),
    ).first()
    if not r["n"] or r["k"] < 2:
        return 10.0
    noise = r["inner"] / r["n"]
    spread = (r["between"] - r["k"] * noise) / r["n"]
    return float(min(1e4, max(10.0, noise / spread - 1))) if spread > 0 else 1e4


def logit(p: Column) -> Column:
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(p / (1 - p))


def posteriors(scored: DataFrame, keep_from: float = KEEP_FROM, toxic_from: float = TOXIC_FROM) -> DataFrame:
    """scored with host_rate, path_rate, posterior and kept."""
    paths = written(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("good").alias("s")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    total = hosts.agg(F.sum("s") / F.sum("n")).first()[0]
    total = 0.5 if total is None else float(total)
    k = strength(hosts.withColumn("mean", F.lit(total)), "mean")
    hosts = hosts.withColumn("host_rate", (F.col("s") + k * total) / (F.col("n") + k)).select(F.col("host").alias("of"), F.col("n").alias("host_n"), F.col("s").alias("host_s"), "host_rate")
    sites = paths.join(hosts, F.col("host").eqNullSafe(F.col("of"))).drop("of")
    j = strength(sites, "host_rate")
    sites = written(sites.withColumnsRenamed({"host": "h", "path": "p", "n": "path_n", "s": "path_s"}), "sites")
    own = F.col("good")
    host_rate = (F.col("host_s") - own + k * total) / (F.col("host_n") - 1 + k)
    path_rate = (F.col("path_s") - own + j * host_rate) / (F.col("path_n") - 1 + j)
    # Sites with a thousandth of all rows or more are a thousand at most: broadcast, so none of them meets in one task.
    hot = hot_keys(sites.select("h", "p", F.col("path_n").alias("n")), "h", "p").select(F.col("h").alias("hot_h"), F.col("p").alias("hot_p"))
    same = F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p"))
    is_hot = lambda h, p: F.col(h).eqNullSafe(F.col("hot_h")) & F.col(p).eqNullSafe(F.col("hot_p"))
    joined = scored.join(F.broadcast(sites.join(hot, is_hot("h", "p"), "left_semi")), same).unionByName(scored.join(hot, is_hot("host", "path"), "left_anti").join(sites.join(hot, is_hot("h", "p"), "left_anti"), same))
    joined = joined.select(*scored.columns, host_rate.alias("host_rate"), path_rate.alias("path_rate"))
    odds = logit(F.col("good")) + logit(F.col("path_rate")) - logit(F.lit(total))
    return joined.withColumn("posterior", F.when(F.col("good") > 0, 1 / (1 + F.exp(-odds))).otherwise(0.0)).withColumn("kept", (F.col("posterior") >= keep_from) & (F.col("toxic") < toxic_from))


def host_of(source: Column) -> Column:
    """A source's part before the first slash; an address's scheme and port are left out."""
    return F.regexp_extract(source, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?#:]*)", 1)


def path_of(source: Column, section: Column) -> Column:
    """The first step of a source's path; a source without one has its sections (documents: languages) in place of paths."""
    step = F.regexp_extract(source, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?[^/?#]*/([^/?#]+)", 1)
    return F.when(step != "", F.concat(F.lit("/"), step)).otherwise(section)


def classified(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """Hosts and paths of documents are those of their sources."""
    one_thread_a_task(docs.sparkSession)
    model = fit(docs, labelled)
    scored = written(evidence(docs, model, host_of(F.col("source")), path_of(F.col("source"), F.col("lang"))), "evidence")
    return posteriors(scored)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's evidence, its site's shrunk rates, the posterior and the verdict."""
    out = classified(documents(spark, sf_dir).select("doc_id", "text", "lang", "source"), labels(spark, sf_dir))
    return out.select("doc_id", "good", "toxic", "host_rate", "path_rate", "posterior", "kept")


QUERIES = {"op7_quality": op7_quality}
ORACLES: dict[str, str] = {}
