"""Language identification with string kernels.

The kernel is the blended-spectrum presence kernel: texts are sets of byte n-grams of lengths 1 to 3 (of the lower-cased
UTF-8 text), and ``k(x, y) = |x & y| / sqrt(|x| |y|)``.  A Nyström approximation replaces the full kernel matrix by
similarities to *landmark* texts, and one-versus-rest kernel ridge regression in that space gives a score per language.
The sums of the regression are taken in tasks; the driver solves a system as large as the number of landmarks.  A score
is linear in a text's n-grams, so landmarks and weights are multiplied once, and whole texts are scored in batches: a
presence matrix times the n-grams' weights.

Landmarks and training rows are a bounded sample: for each language the texts with the smallest hash.  The bounds are
parameters.  Every text is scored as a whole; texts that are null or have no letter (Unicode category L) are ``und`` with
score 0.

Repeated rows get equal predictions.  Rows without ``doc_id`` are predicted like others, and are never held out.
Null languages are not learned from.  An empty table gives an empty result; without any training row all texts are
``und``.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenreel.llm.common import cut, held_out

UND = "und"
#: Sampled keys (of about 50 bytes) that may be broadcast; with more, texts are shuffled instead.
BROADCAST_ROWS = 100_000
#: Shares in which a language's sampled keys are first ranked.
SHARES = 16
#: Tasks that sum the regression's matrices, which all reach the driver.
TASKS = 8
#: Entries of one batch's presence matrix.
CELLS = 8_000_000
#: Bytes of one text that are turned into n-gram codes at once.
CHUNK = 1_000_000


class Grams:
    """Distinct n-grams of texts as codes below 2**24; shorter n-grams have leading zero bytes."""

    def __init__(self) -> None:
        self.seen = np.zeros(1 << 24, np.int32)

    def _distinct(self, c: np.ndarray) -> np.ndarray:
        order = np.arange(len(c), dtype=np.int32)
        self.seen[c] = order
        return c[self.seen[c] == order]

    def __call__(self, text: str) -> np.ndarray:
        raw = np.frombuffer(text.lower().encode().replace(b"\0", b" "), np.uint8)
        found = []
        for i in range(0, max(1, len(raw)), CHUNK):
            b = raw[i : i + CHUNK + 2].astype(np.int32)
            pairs = (b[:-1] << 8) | b[1:]
            found.append(self._distinct(np.concatenate([b, pairs, (pairs[:-1] << 8) | b[2:]])))
        return found[0] if len(found) == 1 else np.unique(np.concatenate(found))


class Landmarks:
    """Landmark texts as sets of n-grams, by n-gram: which landmarks have it."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        every = np.concatenate(sets)
        order = np.argsort(every, kind="stable")
        self.codes, first = np.unique(every[order], return_index=True)
        self.start = np.append(first, len(every)).astype(np.int64)
        self.marks = np.repeat(np.arange(len(sets)), [len(x) for x in sets])[order].astype(np.int32)
        self.root = np.sqrt([len(x) for x in sets])

    def open(self) -> Landmarks:
        """Tables that a task builds once."""
        self.grams = Grams()
        self.column = np.full(1 << 24, -1, np.int32)
        self.column[self.codes] = np.arange(len(self.codes), dtype=np.int32)
        return self

    def known(self, grams: np.ndarray) -> np.ndarray:
        """Numbers of the n-grams that some landmark has."""
        at = self.column[grams]
        return at[at >= 0]

    def kernel(self, grams: np.ndarray) -> np.ndarray:
        """Kernel values of one text against all landmarks."""
        at = self.known(grams)
        n = self.start[at + 1] - self.start[at]
        place = np.arange(n.sum()) + np.repeat(self.start[at] - np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else n, n)
        return np.bincount(self.marks[place], minlength=len(self.root)) / (self.root * np.sqrt(max(1, len(grams))))

    def weights(self, beta: np.ndarray) -> np.ndarray:
        """What each n-gram adds to each language's score, given the landmarks' weights."""
        return np.stack([np.add.reduceat((b / self.root)[self.marks], self.start[:-1]) for b in beta.T], axis=1).astype(np.float32)

    def scores(self, texts: list[str], weights: np.ndarray) -> np.ndarray:
        x = np.zeros((len(texts), len(self.codes)), np.float32)
        norm = np.ones(len(texts), np.float32)
        for i, t in enumerate(texts):
            g = self.grams(t)
            x[i, self.known(g)] = 1
            norm[i] = np.sqrt(max(1, len(g)))
        return (x @ weights) / norm[:, None]


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def _sample(docs: DataFrame, rows: int) -> DataFrame:
    """(lang, text, rank): for each language the ``rows`` learnable texts with the smallest hash.

    A language's keys are first ranked in SHARES shares, and then at most ``rows`` of each share together.
    """
    h = F.xxhash64("text", "lang")
    known = docs.filter(F.col("lang").isNotNull() & has_letter(F.col("text")) & ~held_out(F.col("doc_id"))).select("lang", "text", h.alias("h"))
    first = lambda df, *by: df.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy("h"))).filter(F.col("rank") <= rows)
    keys = first(known.select("lang", "h", F.pmod("h", F.lit(SHARES)).alias("share")).distinct(), "lang", "share")
    keys = cut(first(keys.select("lang", "h"), "lang"))
    keys = F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys  # `rows` for each language that there is
    return known.join(keys, ["lang", "h"]).dropDuplicates(["lang", "h"])


def learn(docs: DataFrame, landmarks: int = 64, rows: int = 512, ridge: float = 1e-3, most: int = 1024) -> tuple[Landmarks, np.ndarray, list[str]] | None:
    """Landmarks, their n-grams' weights (n-gram x language) and languages.

    ``landmarks`` and ``rows`` are per language; with many languages there are fewer landmarks, at most ``most`` (or one
    a language) in all.
    """
    sample = cut(_sample(docs, rows))
    langs = sorted(r.lang for r in sample.select("lang").distinct().collect())
    if not langs:
        return None
    landmarks = max(1, min(landmarks, most // len(langs)))

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = Grams()
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([g(t).tobytes() for t in b.column(0).to_pylist()], pa.binary())], ["codes"])

    marks = sample.filter(F.col("rank") <= landmarks).orderBy("lang", "rank").select("text").mapInArrow(grams, "codes binary").collect()
    sets = [np.frombuffer(r.codes, np.int32) for r in marks]
    model = Landmarks(sets)
    model.open()
    value, vector = np.linalg.eigh(np.stack([model.kernel(x) for x in sets]))
    root = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-6))) @ vector.T
    del model.grams, model.column
    shared = docs.sparkSession.sparkContext.broadcast((model, root))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's part of the regression's two matrices."""
        m, root = shared.value
        m.open()
        left, right, n = np.zeros((len(m.root),) * 2), np.zeros((len(m.root), len(langs))), 0
        for b in batches:
            for i in range(0, b.num_rows, 128):
                part = b.slice(i, 128)
                phi = np.stack([m.kernel(m.grams(t)) for t in part.column(1).to_pylist()]) @ root
                y = np.where(np.array(part.column(0).to_pylist())[:, None] == np.array(langs), 1.0, -1.0)
                left, right, n = left + phi.T @ phi, right + phi.T @ y, n + len(phi)
        yield pa.RecordBatch.from_arrays([pa.array([left.tobytes()], pa.binary()), pa.array([right.tobytes()], pa.binary()), pa.array([n])], ["a", "b", "n"])

    parts = sample.select("lang", "text").coalesce(TASKS).mapInArrow(sums, "a binary, b binary, n long").collect()
    add = lambda c, shape: np.sum([np.frombuffer(r[c]) for r in parts], axis=0).reshape(shape)
    a, b, n = add("a", (len(sets),) * 2), add("b", (len(sets), len(langs))), sum(r.n for r in parts)
    return model, model.weights(root @ np.linalg.solve(a + ridge * n * np.eye(len(sets)), b)), langs


def predict_language(docs: DataFrame, landmarks: int = 64, rows: int = 512, ridge: float = 1e-3, most: int = 1024) -> DataFrame:
    """One row per document of ``docs(doc_id, text, lang)``: doc_id, held_out, lang_pred, score."""
    learned = docs.sparkSession.sparkContext.broadcast(learn(docs, landmarks, rows, ridge, most))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, weights, langs = learned.value or (None, None, [])
        step = max(1, min(128, CELLS // max(1, len(model.open().codes)))) if model is not None else 128
        for b in batches:
            for i in range(0, b.num_rows, step):
                part = b.slice(i, step)
                texts, able = part.column(2).to_pylist(), part.column(3).to_pylist()
                lang, score = [UND] * len(texts), [0.0] * len(texts)
                able = [j for j, x in enumerate(able) if x and model is not None]
                if able:
                    s = model.scores([texts[j] for j in able], weights)
                    for j, best, row in zip(able, s.argmax(1), s, strict=True):
                        lang[j], score[j] = langs[best], float(min(1.0, max(0.0, (row[best] + 1) / 2)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows_ = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), "text", has_letter(F.col("text")).alias("able"))
    return rows_.mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double")
