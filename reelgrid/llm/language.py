"""Hierarchical language identification: the family first, then one-versus-one linear SVMs within it.

A text's features are the square roots of the shares of hashed byte 1-grams and 3-grams of the
lower-cased whole text, a vector of length one. Linear support vector machines are fitted in numpy
on a bounded sample (SAMPLE distinct training texts of each language, those of least hash; for
families twice as many, of their languages alike): one for each pair of families, and one for each
pair of languages of a family. Each pair is fitted in a task of its own and only its weights come to
the driver. Votes of the pairs decide, margins break ties. The score is the product of the decisive margins' logistic values, family and language.

A null text, or one without a letter (Unicode category L), is `und` with score 0. Rows with null lang are predicted but
never learned from. With one learned language, it is predicted with score 1; with none, `und`.
Repeated rows and equal texts get equal predictions.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelgrid.llm.bpe import batches_of
from reelgrid.llm.tables import documents, one_thread_a_task, remainder, schema_with, written

#: Language to family; languages that are not listed are a family each.
FAMILIES = {
    **dict.fromkeys(["en", "de", "nl", "sv", "da", "no", "is"], "germanic"),
    **dict.fromkeys(["fr", "es", "it", "pt", "ro", "ca", "gl"], "romance"),
    **dict.fromkeys(["ru", "uk", "be", "pl", "cs", "sk", "bg", "mk", "sr", "hr", "bs", "sl"], "slavic"),
    **dict.fromkeys(["lt", "lv"], "baltic"),
    **dict.fromkeys(["fi", "et", "hu"], "uralic"),
    **dict.fromkeys(["tr", "az", "kk", "uz", "ky", "tt"], "turkic"),
    **dict.fromkeys(["hi", "ur", "bn", "pa", "mr", "gu", "ne"], "indic"),
    **dict.fromkeys(["fa", "ku", "ps", "tg"], "iranian"),
    **dict.fromkeys(["ar", "he", "mt", "am"], "semitic"),
    **dict.fromkeys(["ta", "te", "kn", "ml"], "dravidian"),
    **dict.fromkeys(["id", "ms", "tl", "jv", "mg"], "austronesian"),
    **dict.fromkeys(["ga", "cy", "gd", "br"], "celtic"),
    **dict.fromkeys(["zh", "yue"], "sinitic"),
}
BITS, SAMPLE, ROUNDS = 13, 1000, 200
LETTER = regex.compile(r"\p{L}")


def features(texts: list[str]) -> np.ndarray:
    """One row per text, of 2**BITS columns."""
    size = 1 << BITS
    out = np.zeros((len(texts), size), np.float32)
    for row, text in zip(out, texts, strict=True):
        raw = np.frombuffer(b" " + " ".join(text.lower().split()).encode() + b" ", np.uint8).astype(np.uint32)
        grams = raw[:-2] * np.uint32(0x9E3779B1) ^ raw[1:-1] * np.uint32(0x85EBCA6B) ^ raw[2:] * np.uint32(0xC2B2AE35)
        grams = (grams ^ grams >> np.uint32(15)) * np.uint32(0x2C1B3C6D) >> np.uint32(32 - BITS)
        counts = np.bincount(grams, minlength=size)
        counts[: 256] += np.bincount(raw, minlength=256)
        np.sqrt(counts / max(1, counts.sum()), out=row)
    return out


def svm(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and offset of a linear SVM, squared hinge loss with classes of equal weight, by momentum descent."""
    each = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w, b, vw, vb = np.zeros(x.shape[1], np.float32), 0.0, 0.0, 0.0
    for _ in range(ROUNDS):
        slack = np.maximum(0, 1 - y * (x @ w + b)) * y * each
        vw = 0.9 * vw + x.T @ slack - ridge * w
        vb = 0.9 * vb + slack.sum()
        w, b = w + 0.5 * vw, b + 0.5 * vb
    return w, float(b)


def vote(x: np.ndarray, names: list[str], machines: dict) -> tuple[np.ndarray, np.ndarray]:
    """The name with most pairs won and its least logistic margin, per row of x."""
    won = np.zeros((len(x), len(names)))
    least = np.full((len(x), len(names)), np.inf)
    for (a, b), (w, c) in machines.items():
        m = x @ w + c
        for name, s in ((a, m), (b, -m)):
            i = names.index(name)
            won[:, i] += (s > 0) + 1e-3 * np.tanh(s)
            least[:, i] = np.minimum(least[:, i], s)
    best = won.argmax(axis=1)
    margin = least[np.arange(len(x)), best]
    return best, 1 / (1 + np.exp(-4 * np.clip(margin, -10, 10)))


class Model:
    """machines: weights and offset by level (family pairs: "") and pair."""

    def __init__(self, langs: list[str], machines: dict[tuple[str, str, str], tuple[np.ndarray, float]]):
        family = {v: FAMILIES.get(v, v) for v in langs}
        self.families = sorted(set(family.values()))
        self.langs = {f: sorted(v for v in langs if family[v] == f) for f in self.families}
        self.between = {(a, b): m for (level, a, b), m in machines.items() if not level}
        self.within = {f: {(a, b): m for (level, a, b), m in machines.items() if level == f} for f in self.families}

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        rows = [i for i, t in enumerate(texts) if t and LETTER.search(t)]
        if not rows or not self.families:
            return names, scores
        x = features([texts[i] for i in rows])
        fam, fs = vote(x, self.families, self.between)
        for k, f in enumerate(self.families):
            here = np.flatnonzero(fam == k)
            if len(here):
                lang, ls = vote(x[here], self.langs[f], self.within[f])
                for r, v, s in zip(here.tolist(), lang.tolist(), (fs[here] * ls).tolist(), strict=True):
                    names[rows[r]], scores[rows[r]] = self.langs[f][v], s
        return names, scores


def sampled(docs: DataFrame, sample: int) -> DataFrame:
    """(lang, rank, x): features of at most `sample` distinct texts of each language, those of least hash."""
    keyed = docs.where("lang is not null and text is not null").select("lang", F.xxhash64("text").alias("h"), "text")
    every = keyed.select("lang", "h").distinct()
    # Hashes are even, so the least twice `sample` of a language hold its least `sample`; only they are ranked, in a task a language.
    often = F.broadcast(every.groupBy("lang").agg(F.count("*").alias("n")))  # a row a language
    least = every.join(often, "lang").where((F.col("n") <= 2 * sample) | ((F.col("h") / 2.0**64 + 0.5) * F.col("n") <= 2 * sample))
    ranked = least.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("rank") <= sample).select("lang", "h", "rank")
    picked = keyed.join(F.broadcast(ranked), ["lang", "h"]).groupBy("lang", "rank").agg(F.first("text").alias("text"))  # languages x `sample` rows

    def run(batches):
        for whole in batches:
            for b in batches_of(whole, "text"):
                x = features(b.column(2).to_pylist()).astype(np.float16)
                yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array([r.tobytes() for r in x], pa.binary())], names=["lang", "rank", "x"])

    return picked.mapInArrow(run, "lang string, rank int, x binary")


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """A machine for each pair, each fitted in its own task on at most 2 * `sample` rows a side."""
    spark = one_thread_a_task(docs.sparkSession)
    rows = written(sampled(docs, sample), "language_sample")
    langs = sorted(r.lang for r in rows.select("lang").distinct().collect())
    of: dict[str, list[str]] = {}
    for v in langs:
        of.setdefault(FAMILIES.get(v, v), []).append(v)
    # (lang, most rows, level, pair, the side of the language)
    sides = [(v, sample, f, a, b, 1.0 if v == a else -1.0) for f, vs in of.items() for a, b in itertools.combinations(vs, 2) for v in (a, b)]
    sides += [(v, max(1, 2 * sample // len(of[f])), "", a, b, 1.0 if f == a else -1.0) for a, b in itertools.combinations(sorted(of), 2) for f in (a, b) for v in of[f]]
    if not sides:
        return Model(langs, {})
    pairs = spark.createDataFrame(sides, "lang string, most int, level string, a string, b string, side double")
    dealt = rows.join(F.broadcast(pairs), "lang").where("rank <= most").select("level", "a", "b", "side", "x")

    def machine(t: pa.Table) -> pa.Table:
        order = np.lexsort((np.array(t.column("x").to_pylist(), object), t.column("side").to_numpy()))  # the same on a retry
        x = np.stack([np.frombuffer(v, np.float16) for v in t.column("x").take(order).to_pylist()]).astype(np.float32)
        w, c = svm(x, t.column("side").to_numpy()[order].astype(np.float32))
        return t.select(["level", "a", "b"]).slice(0, 1).append_column("w", pa.array([w.tobytes()], pa.binary())).append_column("c", pa.array([c]))

    got = dealt.groupBy("level", "a", "b").applyInArrow(machine, "level string, a string, b string, w binary, c double").collect()
    return Model(langs, {(r.level, r.a, r.b): (np.frombuffer(r.w, np.float32), r.c) for r in got})


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred and score."""
    keep = docs.drop("lang_pred", "score")
    schema = schema_with(keep, lang_pred="string", score="double")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages squared times 2**BITS numbers at most

    def run(batches):
        for whole in batches:
            for b in batches_of(whole, text):
                names, scores = shared.value.predict(b.column(b.schema.get_field_index(text)).to_pylist())
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[f.name for f in schema])

    return keep.mapInArrow(run, schema)


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's predicted language, learned from those that are not held out."""
    docs = documents(spark, sf_dir).withColumn("held_out", remainder() == 0)
    model = fit(docs.where(~F.col("held_out")))
    return predict(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


QUERIES = {"op2_language": op2_language}
ORACLES: dict[str, str] = {}
