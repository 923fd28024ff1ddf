"""Vectors as short codes: product quantisation whose training rounds skip exact scans by norm-of-sum bounds.

Components become integers and vectors are cut into ``parts``; each part has a codebook of ``entries``, trained by rounds of
assigning every part to its nearest entry (ties to the lower index) and moving entries to the floored mean of their parts.

Between rounds every part keeps, for each of a few groups of entries, a lower bound of its distance to the group and the
round in which the bound was taken (its *stamp*).  All earlier codebooks are kept, so that a bound of round ``s`` can be
lowered in round ``t`` by how far the group's entries have really moved between the two, ``max |c_t - c_s|``: the norm of
the sum of their moves, which is never more than the sum of the norms of each round's moves that is usually taken off.
Only groups that a bound does not rule out are scanned exactly.  All distances are exact integers, and bounds are rounded
down, so results do not depend on what is skipped.

A round is one pass of numpy over Arrow batches and one aggregation of partial sums; a codebook has ``parts * entries``
rows, whatever the table's size, and is all that the driver sees.  Rounds are cut by checkpoints.

Dropped: vectors that are null, hold null or not finite components, or have another length than the kept row of smallest
``vec_id``.  Rows without ``vec_id`` are encoded, but start no codebook; repeated ids start it in order of their components.
With fewer rows than ``entries`` the codebooks are as short.  Components of a size of 2^20 or more are an error, as squared
distances would not fit.  Lengths that ``parts`` does not divide are an error.  An empty table gives an empty result; other
columns are ignored.  Equal labels' errors are added up by partial aggregation and looked up in shares of a label.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenreel.llm.common import cut, salted_join

#: Integer components below this keep sums of squared differences within 64 bits.
LARGEST = 1 << 28
_FAR = np.iinfo(np.int64).max
_STATE = "vec_id long, label string, v binary, code binary, bound binary, stamp binary, scanned long, error long"


def whole(x: Column) -> Column:
    """True for vectors without null or not finite components; false for null."""
    return F.coalesce(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of (n, d) integers to (k, d) integers."""
    out = np.zeros((len(x), len(entries)), np.int64)
    for i in range(x.shape[1]):
        out += (x[:, i, None] - entries[None, :, i]) ** 2
    return out


def moved(history: Sequence[np.ndarray], groups: int, by_rounds: bool = False) -> np.ndarray:
    """(rounds, groups): the furthest that an entry of a group has moved from each round's codebook to the last one's.

    ``by_rounds`` adds up the moves of the rounds in between instead (the usual, looser bound), for comparison.
    """
    now, k = history[-1], len(history[-1])
    far = lambda a, b: np.sqrt(((a - b).astype(np.float64) ** 2).sum(axis=1))
    each = [far(now, old) for old in history]
    if by_rounds:
        steps = [far(a, b) for a, b in zip(history, history[1:], strict=False)]
        each = [np.sum(steps[s:], axis=0) if s < len(steps) else np.zeros(k) for s in range(len(history))]
    group = np.arange(k) * groups // k
    return np.array([[d[group == g].max(initial=0.0) for g in range(groups)] for d in each])


def assign(x: np.ndarray, history: Sequence[np.ndarray], code: np.ndarray | None, bound: np.ndarray, stamp: np.ndarray, by_rounds: bool = False) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest entry of each row of ``x`` (n, d) in the last codebook of ``history``, its squared distance, and how
    many distances were computed.  ``bound`` and ``stamp`` (n, groups) are brought up to date in place; without a ``code``
    of the round before everything is scanned.
    """
    entries, now, groups = history[-1], len(history) - 1, bound.shape[1]
    n, k = len(x), len(entries)
    group, rows = np.arange(k) * groups // k, np.arange(n)
    dist, open_ = np.full((n, k), _FAR), np.ones((n, groups), bool)
    low = bound.astype(np.float64)
    count = 0
    if code is not None:
        own = ((x - entries[code]) ** 2).sum(axis=1)
        dist[rows, code], count = own, n
        low = low - moved(history, groups, by_rounds)[stamp, np.arange(groups)]
        open_ = ~(np.sqrt(own.astype(np.float64))[:, None] < low - 1e-9 * (1 + bound))
    for g in range(groups):
        some, of = np.flatnonzero(open_[:, g]), np.flatnonzero(group == g)
        if len(some) and len(of):
            dist[some[:, None], of[None, :]] = distances(x[some], entries[of])
            count += len(some) * len(of)
    best = dist.argmin(axis=1)
    error = dist[rows, best]
    # Bounds leave out a row's own entry. A group that was not scanned has to take in the entry that its row has left.
    other = dist.copy()
    other[rows, best] = _FAR
    for g in range(groups):
        of = np.flatnonzero(group == g)
        near = np.sqrt(other[:, of].min(axis=1, initial=_FAR).astype(np.float64))
        left = np.zeros(n, bool) if code is None else (best != code) & (group[code] == g)
        fresh = open_[:, g] | left
        value = np.where(open_[:, g], near, np.minimum(near, low[:, g]))
        bound[fresh, g] = np.nextafter(np.maximum(value[fresh], 0).astype(np.float32), np.float32(0))
        stamp[fresh, g] = now
    return best, error, count


def _round(rows: DataFrame, history: list[np.ndarray], groups: int, by_rounds: bool, first: bool) -> DataFrame:
    parts, k, d = history[0].shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            take = lambda c, kind: np.frombuffer(b"".join(b.column(c).to_pylist()), kind).copy()  # noqa: B023, E731
            if first:
                raw = b.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, parts, d)
                raw = np.floor(256 * raw)
                if (np.abs(raw) >= LARGEST).any():
                    raise ValueError("a component is too large")
                v, code = raw.astype(np.int64), None
                bound, stamp = np.zeros((n, parts, groups), np.float32), np.zeros((n, parts, groups), np.uint8)
            else:
                v, code = take("v", np.int32).astype(np.int64).reshape(n, parts, d), take("code", np.uint8).reshape(n, parts)
                bound, stamp = take("bound", np.float32).reshape(n, parts, groups), take("stamp", np.uint8).reshape(n, parts, groups)
            best, error = np.empty((n, parts), np.uint8), np.zeros(n, np.int64)
            scanned = 0
            for p in range(parts):
                at, e, c = assign(v[:, p], [h[p] for h in history], None if code is None else code[:, p], bound[:, p], stamp[:, p], by_rounds)
                best[:, p], error, scanned = at, error + e, scanned + c
            as_rows = lambda x: pa.array([r.tobytes() for r in x], pa.binary())
            share = np.full(n, scanned // n)
            share[: scanned % n] += 1
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), as_rows(v.astype(np.int32)), as_rows(best), as_rows(bound), as_rows(stamp), pa.array(share), pa.array(error)], [c.split(" ")[0] for c in _STATE.split(", ")])

    return rows.mapInArrow(run, _STATE)


def _means(state: DataFrame, old: np.ndarray) -> np.ndarray:
    """The codebooks moved to the floored means of the parts assigned to each entry; unused entries stay."""
    parts, k, d = old.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((parts * k, d), np.int64), np.zeros(parts * k, np.int64)
        for b in batches:
            v = np.frombuffer(b"".join(b.column(0).to_pylist()), np.int32).reshape(-1, d).astype(np.int64)
            at = (np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(-1, parts).astype(np.int64) + np.arange(parts) * k).ravel()
            np.add.at(total, at, v)
            n += np.bincount(at, minlength=parts * k)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(used, d)), pa.array(np.tile(np.arange(d), len(used))), pa.array(total[used].ravel()), pa.array(np.repeat(n[used], d))], ["entry", "i", "s", "n"])

    found = state.select("v", "code").mapInArrow(sums, "entry long, i long, s long, n long").groupBy("entry", "i").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).toPandas()
    new = old.reshape(parts * k, d).copy()
    new[found["entry"], found["i"]] = found["s"].to_numpy() // found["n"].to_numpy()
    return new.reshape(parts, k, d)


def train(rows: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, groups: int = 4, by_rounds: bool = False) -> tuple[DataFrame, np.ndarray]:
    """(state, codebooks) of ``rows(vec_id, embedding, label)``: each kept vector's code, error and bounds after the last
    assignment, and the (parts, entries, d) integers that it was made with.  ``scanned``: distances computed in the last
    assignment.  At most 256 entries, as a code has a byte a part.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a codebook has 1 to 256 entries")
    kept = rows.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("string")).filter(whole(F.col("v")))
    start = kept.filter("vec_id is not null").orderBy("vec_id", "v").select("v").limit(1).collect()
    d = len(start[0].v) if start else parts
    if not d or d % parts:
        raise ValueError(f"vectors of {d} components have no {parts} equal parts")
    kept = kept.filter(F.size("v") == d)
    first = kept.filter("vec_id is not null").orderBy("vec_id", "v").select("v").limit(entries).toPandas()["v"]  # at most `entries` rows
    if not len(first):
        return kept.sparkSession.createDataFrame([], _STATE), np.zeros((parts, 0, d // parts), np.int64)
    start = np.floor(256 * np.stack([np.asarray(v, np.float64) for v in first])).astype(np.int64)
    history = [start.reshape(len(start), parts, d // parts).transpose(1, 0, 2).copy()]
    state = cut(_round(kept, history, groups, by_rounds, True))
    for _ in range(rounds):
        history.append(_means(state, history[-1]))
        state = cut(_round(state, history, groups, by_rounds, False))
    return state, history[-1]


def encode(rows: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of ``rows(vec_id, embedding, label)``."""
    state, books = train(rows, parts, entries, rounds)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    out = state.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", F.coalesce(F.concat(F.lit("="), "label"), F.lit("")).alias("_label"))
    sums = cut(out.groupBy("_label").agg(F.sum("error").alias("label_error")))
    return salted_join(out, sums, ["_label"], F.struct("vec_id", "code")).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def decoded(codes: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, embedding): the vectors that codes stand for, at the middle of each integer step."""
    parts, _, d = books.shape

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at = np.array([list(bytes.fromhex(c)) for c in pdf["code"]], np.int64).reshape(-1, parts)
            v = (books[np.arange(parts), at] + 0.5).reshape(len(at), parts * d) / 256
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "embedding": list(v.astype(np.float32))})

    return codes.select("vec_id", "code").mapInPandas(run, "vec_id long, embedding array<float>")
