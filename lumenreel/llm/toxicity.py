"""Toxicity scores by non-negative positive-unlabelled learning.

Only some toxic texts are confirmed; all other texts are unlabelled, and hold toxic ones as well.  With class prior ``p``
the risk of a score ``g`` is ``p * E_pos[l(g)] + max(0, E_unl[l(-g)] - p * E_pos[l(-g)])`` (Kiryo et al. 2017): the
unlabelled texts' negative risk is corrected by the positives', and kept from going below zero, where plain unbiased
estimators overfit.  The classifier is a numpy logistic model on the presence of lower-cased letter runs, trained by
Adam; presence makes scores independent of a text's length.

Training texts are bounded samples of distinct texts (smallest hash first).  Features are all of their words whose share
of the positive texts differs from that of the unlabelled ones by ``least_z`` standard errors, counted by Spark; there is
no cap on them, and the rows are sparse.  Scores are of whole texts; null and empty texts have the score of a text without known words.

A document with several labels is toxic if any says so.  Labels without a document, null labels and held-out rows are
not learned from.  Without any positive row all scores are 0.  Repeated rows get equal scores.  Rows without ``doc_id``
are scored, and never held out.  Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenreel.llm.common import cut, held_out

WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def train(positive: list[list[int]], unlabelled: list[list[int]], size: int, prior: float, steps: int = 600, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of the logistic model; texts are lists of feature numbers below ``size``."""

    class Rows:
        """A sparse 0/1 matrix; every row has the bias, feature ``size``."""

        def __init__(self, rows: list[list[int]]) -> None:
            self.n = np.array([len(r) + 1 for r in rows])
            self.at = np.fromiter((x for r in rows for x in (*r, size)), np.int64, self.n.sum())
            self.start = np.concatenate([[0], np.cumsum(self.n)[:-1]])

        def __matmul__(self, w: np.ndarray) -> np.ndarray:
            return np.add.reduceat(w[self.at], self.start)

        def weighted(self, c: np.ndarray) -> np.ndarray:
            """Sum of the rows, each times its coefficient."""
            return np.bincount(self.at, weights=np.repeat(c, self.n), minlength=size + 1)

    pos, unl = Rows(positive), Rows(unlabelled)
    w = np.zeros(size + 1)
    w[size] = np.log(prior / (1 - prior))
    m1, m2 = np.zeros_like(w), np.zeros_like(w)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for t in range(1, steps + 1):
        zp, zu = pos @ w, unl @ w
        as_pos = -prior * pos.weighted(sig(-zp)) / len(zp)  # gradient of p * E_pos[l(g)]
        as_neg = unl.weighted(sig(zu)) / len(zu) - prior * pos.weighted(sig(zp)) / len(zp)
        risk = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        grad = as_pos + as_neg if risk >= 0 else -as_neg  # below zero: step back out
        grad = grad + decay * np.append(w[:-1], 0.0)
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad * grad
        w = w - rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def learn(docs: DataFrame, labels: DataFrame, positives: int = 3000, unlabelled: int = 8000, least_z: float = 4.0) -> tuple[dict[str, float], float] | None:
    """Word weights and bias.  ``positives`` and ``unlabelled`` bound the samples; ``least_z`` is a word's significance."""
    toxic = labels.filter(~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic")).filter("doc_id is not null and toxic is not null")
    n, share = toxic.agg(F.count("*"), F.avg((F.col("toxic") == 1).cast("int"))).first()
    if not n or not share:
        return None
    texts = docs.filter(F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    keys = cut(texts.select("doc_id", "h").join(toxic, "doc_id", "left").groupBy("h").agg(F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("pos")))
    some = cut(keys.filter("pos").orderBy("h").limit(positives).withColumn("unl", F.lit(False)).union(keys.orderBy("h").limit(unlabelled).select("h", F.lit(False).alias("pos"), F.lit(True).alias("unl"))).groupBy("h").agg(F.max("pos").alias("pos"), F.max("unl").alias("unl")))
    # At most `positives + unlabelled` hashes: texts stay where they are.
    sample = texts.join(F.broadcast(some), "h").dropDuplicates(["h"]).select("pos", "unl", "text")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([sorted(words_of(t)) for t in part.column(2).to_pylist()], pa.list_(pa.string()))], ["pos", "unl", "words"])

    sample = cut(sample.mapInArrow(split, "pos boolean, unl boolean, words array<string>"))
    np_, nu = sample.agg(F.count_if("pos"), F.count_if("unl")).first()
    if not np_ or not nu:
        return None
    p, u = F.col("p") / np_, F.col("u") / nu
    both = (F.col("p") + F.col("u") + 1) / (np_ + nu)
    counts = sample.select("pos", "unl", F.explode("words").alias("word")).groupBy("word").agg(F.count_if("pos").alias("p"), F.count_if("unl").alias("u"))
    z = F.abs(p - u) / F.sqrt(both * F.greatest(1 - both, F.lit(1e-9)) * (1 / np_ + 1 / nu))
    vocabulary = sorted(r.word for r in counts.filter(z >= least_z).select("word").collect())  # words of the bounded sample
    place = sample.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(vocabulary)})

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = place.value
        for b in batches:
            at = [sorted(known[w] for w in words if w in known) for words in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(at, pa.list_(pa.int32()))], ["pos", "unl", "at"])

    rows = sample.mapInArrow(numbered, "pos boolean, unl boolean, at array<int>").collect()
    rows.sort(key=lambda r: (r.pos, r.unl, r.at))
    weights, bias = train([r.at for r in rows if r.pos], [r.at for r in rows if r.unl], len(vocabulary), min(0.5, max(0.01, float(share))))
    return dict(zip(vocabulary, weights.tolist(), strict=True)), bias


def score_toxicity(docs: DataFrame, labels: DataFrame, **options: float) -> DataFrame:
    """One row per document of ``docs(doc_id, text)``: doc_id, held_out, score, predicted."""
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, **options))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = model.value or ({}, -np.inf)
        known = weights.keys()
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                z = np.array([bias + sum(weights[w] for w in sorted(words_of(t) & known)) for t in part.column(2).to_pylist()])
                s = 1 / (1 + np.exp(-np.maximum(z, -700))) * (bias > -np.inf)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")
