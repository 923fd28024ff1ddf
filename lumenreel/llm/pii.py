"""Personal data in texts: generous candidate spans, judged by boosted trees at calibrated thresholds.

*Base* patterns find e-mail addresses, IP addresses, card and phone numbers; what they find always stays.  They miss what
is written otherwise or stands next to other numbers (``7536784127813050 4845168114407329`` is one match of 32 digits).
Generators therefore propose many overlapping spans: every run of whole digit groups that could be a card or a phone
number, dotted quads with spaced or bracketed dots, addresses with ``(at)``, ``[dot]`` and the like.  A candidate has
features of its format, in a canonical form (without a phone's prefix, with plain separators; what only the base pattern
demands is no feature), and of its context: neighbouring characters and digits, and cue words before it.

Labels come from the corpus itself.  A candidate that is a base match is positive; one whose number is invalid (wrong check
digit, a part above 255), that cuts or covers base matches, or that sticks to a letter is negative; the others have no
label and are what the model is for.  One model per kind is fitted on *all* candidates with a label: equal ones, by their
features in bins, are counted, and trees need only sums over them.  Scores of models that were fitted without an example's
third of them give the threshold from which on the share of positives is at least ``precision``.  A kind with fewer than
``least`` positives adds nothing.  Of overlapping candidates above their thresholds the best score stays, and none that
overlaps a base match.

Texts are searched whole, by patterns whose work is linear in the text.  Null texts count as empty; rows without ``doc_id``
are searched too; repeated rows give equal results.  An empty table gives an empty result; other columns are ignored.
Spans are in code points, end exclusive.  Nothing is shuffled but counts of features and sums.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenreel.llm.common import cut
from lumenreel.llm.shingles import mix
from lumenreel.llm.trees import Block, BoostedTrees, Passes, binned, grow, precise_threshold

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
Span = tuple[int, int, int]  # kind, start, end

# ---- base patterns

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match begins where a run of digits begins, so that long runs are read once.
_QUAD = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(c), 10)) for c in even)) % 10 == 0


def small(part: str) -> bool:
    """A decimal of at most 255, whatever its leading zeros."""
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def valid(kind: int, canonical: str) -> bool:
    """Whether a span of the base pattern, or the canonical form of a candidate, is one."""
    if kind == CARD:
        d = digits_of(canonical)
        return 12 <= len(d) <= 19 and luhn(d)
    if kind == PHONE:
        return 9 <= len(digits_of(canonical)) <= 15
    if kind == IP:
        return all(map(small, canonical.split(".")))
    return True


def _local_start(text: str, at: int, least: int) -> int:
    while at > least and text[at - 1] in _LOCAL:
        at -= 1
    return at


def base_spans(text: str) -> list[Span]:
    """Matches of the base patterns, by start and kind.  Matches that fail their check are passed over whole."""
    out: list[Span] = []
    end, at = 0, text.find("@")
    while at >= 0:
        start, m = _local_start(text, at, end), _DOMAIN.match(text, at + 1)
        if m and start < at:
            end = m.end()
            out.append((EMAIL, start, end))
        at = text.find("@", max(at + 1, end))
    for kind, pattern in ((IP, _QUAD), (CARD, _CARD), (PHONE, _PHONE)):
        out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if valid(kind, m[0])]
    return sorted(out, key=lambda s: (s[1], s[0]))


# ---- candidates

_REGION = re.compile(r"[0-9]+(?:[\x20()./_+-]{1,3}[0-9]+)*")
_GROUP = re.compile(r"[0-9]+")
_DOT = r"(?:\x20?[\[({<]\x20?(?:dot|\.)\x20?[\])}>]\x20?|\x20\.\x20?|\.)"
_LOOSE_QUAD = re.compile(rf"(?<![0-9])(?=([0-9]{{1,3}}(?:{_DOT}[0-9]{{1,3}}){{3}})(?![0-9]))", re.I)
#: Signs in place of ``@``, and what has to follow; a bare word needs a bare ``dot`` too.
_SIGN = re.compile(r"\x20?[\[({<]\x20?(?:at|@)\x20?[\])}>]\x20?|\x20?[@＠]\x20?|\x20at\x20", re.I)
_SPELT = rf"[A-Za-z0-9-]+(?:(?:{_DOT}|\x20dot\x20)[A-Za-z0-9-]+)+"
_LOOSE_DOMAIN, _WORD_DOMAIN = re.compile(_SPELT, re.I), re.compile(r"[A-Za-z0-9-]+(?:\x20dot\x20[A-Za-z0-9-]+)+", re.I)
_LOOSE_DOT = re.compile(rf"{_DOT}|\x20dot\x20", re.I)

# Words that announce a kind, within CUE_CHARS before a candidate.
CUES = {EMAIL: ("mail", "contact", "write"), IP: ("ip", "host", "server", "client"), CARD: ("card", "visa", "pay", "credit"), PHONE: ("tel", "phone", "call", "mobile", "fax")}
CUE_CHARS = 24
_CUE = {k: re.compile("|".join(w), re.I) for k, w in CUES.items()}


def _numbers(text: str) -> Iterator[tuple[int, int, int, str]]:
    """(kind, start, end, canonical) of the runs of whole digit groups in regions of digits and separators."""
    for region in _REGION.finditer(text):
        groups = [(m.start(), m.end()) for m in _GROUP.finditer(text, region.start(), region.end())]
        for i, (start, _) in enumerate(groups):
            total, seps = 0, set()
            for j in range(i, len(groups)):
                total += groups[j][1] - groups[j][0]
                if j > i:
                    seps.add(text[groups[j - 1][1] : groups[j][0]])
                if total > 19:
                    break
                stop = groups[j][1]
                if total >= 12 and len(seps) <= 1 and all(len(s) == 1 for s in seps):
                    yield CARD, start, stop, " ".join(text[a:b] for a, b in groups[i : j + 1])
                if 9 <= total <= 15:
                    at, own = start, groups[i : j + 1]
                    if at and text[at - 1] == "(":
                        at -= 1
                    if at and text[at - 1] == "+":
                        at -= 1
                    foreign = text[at] == "+" or text.startswith("00", start)
                    if foreign and len(own) > 1 and own[0][1] - own[0][0] <= 4:
                        own = own[1:]
                    yield PHONE, at, stop, " ".join(text[a:b] for a, b in own)


def candidates(text: str) -> list[tuple[int, int, int, str]]:
    """Proposed spans with their canonical forms, overlaps included; every base match is among them or is added later."""
    out = list(_numbers(text)) if any(c in text for c in "0123456789") else []
    out += [(IP, m.start(1), m.end(1), re.sub(r"[^0-9]+", ".", m[1])) for m in _LOOSE_QUAD.finditer(text)] if out or "." in text else []
    for m in _SIGN.finditer(text):
        word = m[0].isspace() or m[0].strip().lower() == "at"
        rest = (_WORD_DOMAIN if word else _LOOSE_DOMAIN).match(text, m.end())
        start = _local_start(text, m.start(), max(0, m.start() - 64))
        if rest and start < m.start():
            out.append((EMAIL, start, rest.end(), f"{text[start : m.start()]}@{_LOOSE_DOT.sub('.', rest[0])}"))
    return out


FEATURES = 24


def _class(c: str) -> int:
    return 0 if not c else 1 if c.isspace() else 2 if c.isalpha() else 3 if c.isdigit() else 4


def features(text: str, kind: int, start: int, end: int, canonical: str) -> list[float]:
    """Format features of the canonical form, and features of what is around the span."""
    digits, groups = digits_of(canonical), [len(g) for g in _GROUP.findall(canonical)] or [0]
    local, _, domain = canonical.partition("@") if kind == EMAIL else ("", "", "")
    labels = domain.split(".")
    before, left, right = text[max(0, start - CUE_CHARS) : start], text[start - 1 : start] if start else "", text[end : end + 1]
    return [
        len(canonical), len(digits), len(groups), max(groups), min(groups), groups[0], groups[-1], len(set(digits)),
        float(digits[0]) if digits else -1.0, float(valid(kind, canonical)), len(local), len(labels), len(labels[-1]), float(labels[-1].isalpha()),
        _class(left), _class(right), float(bool(_CUE[kind].search(before))), float(any(_CUE[k].search(before) for k in CUES if k != kind)),
        len(digits_of(text[max(0, start - 12) : start])), len(digits_of(text[end : end + 12])), float(text[end : end + 3].strip()[:1].isdigit()),
        float(before.rstrip()[-1:].isdigit()), sum(c.isupper() for c in canonical), float(groups == sorted(groups)),
    ]


class Overlaps:
    """Whether a span touches any of a few spans that do not grow in number with its own length."""

    def __init__(self, spans: list[tuple[int, int]]) -> None:
        merged: list[list[int]] = []
        for a, b in sorted(spans):
            if merged and a < merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        self.starts, self.ends = [a for a, _ in merged], [b for _, b in merged]

    def __call__(self, start: int, end: int) -> bool:
        i = bisect.bisect_right(self.ends, start)
        return i < len(self.starts) and self.starts[i] < end


def proposed(text: str) -> tuple[list[Span], np.ndarray, np.ndarray]:
    """(base spans, (kind, start, end, label) of the candidates, their features); label: 1, 0, or -1 for none."""
    base = base_spans(text)
    known, taken = set(base), Overlaps([(a, b) for _, a, b in base])
    found: dict[Span, str] = {}
    for kind, a, b, canonical in candidates(text):
        found.setdefault((kind, a, b), canonical)
    spans, rows = [], []
    for (kind, a, b), canonical in found.items():
        x = features(text, kind, a, b, canonical)
        glued = 2 in (x[14], x[15])
        label = (-1 if glued else 1) if (kind, a, b) in known else 0 if glued or not valid(kind, canonical) or taken(a, b) else -1
        spans.append((kind, a, b, label))
        rows.append(x)
    return base, np.array(spans, np.int64).reshape(-1, 4), np.array(rows, np.float32).reshape(-1, FEATURES)


# ---- model and selection

Model = dict[int, tuple[BoostedTrees, float]]


#: Scores are counted in so many cells when a threshold is chosen.
CELLS = 1 << 14


def _sizes_of(block: Block) -> np.ndarray:
    """Weights by kind, fold and label."""
    out = np.zeros((len(KINDS), 3, 2))
    kind, _, y, n, fold = block
    np.add.at(out[kind], (fold, y), n)
    return out


def _scores_of(block: Block, models: dict[tuple[int, int], BoostedTrees]) -> np.ndarray:
    """Weights by kind, label and cell of the score that a model gives which has not seen the row's fold."""
    out = np.zeros((len(KINDS), 2, CELLS + 1))
    kind, bins, y, n, fold = block
    for i in range(3):
        if (kind, i) in models:
            at = fold == i
            np.add.at(out[kind], (y[at], np.rint(models[kind, i].of_bins(bins[:, at]) * CELLS).astype(int)), n[at])
    return out


def fit(passes: Passes, precision: float = 0.98, least: int = 8) -> Model:
    """A classifier and a threshold for each kind that has enough examples; ``passes``: see ``trees.grow``."""
    by = passes(_sizes_of)
    sizes = {(k, i): (s.sum(), s[:, 1].sum()) for k in range(len(KINDS)) if by[k, :, 1].sum() >= least for i in range(4) for s in [by[k][np.arange(3) != i]]}
    if not sizes:
        return {}
    models = grow(passes, sizes)
    counts, out = passes(partial(_scores_of, models=models)), {}
    for k in {k for k, _ in sizes}:
        y, cell = np.nonzero(counts[k])  # negatives first: of equal scores the positives come last
        limit = precise_threshold(cell / CELLS, y.astype(np.float64), precision, least, counts[k][y, cell])
        if np.isfinite(limit):
            out[k] = models[k, 3], limit
    return out


def chosen(base: list[Span], spans: np.ndarray, x: np.ndarray, model: Model) -> list[tuple[int, int, int, float | None]]:
    """Base spans and those that the model adds, with their scores, by start and kind."""
    score = np.full(len(spans), -1.0)
    for k, (trees, limit) in model.items():
        at = np.flatnonzero(spans[:, 0] == k)
        if len(at):
            p = trees.predict(x[at])
            score[at] = np.where((p >= limit) & (x[at, 9] > 0), p, -1.0)  # the ninth feature: a valid number
    free = Overlaps([(a, b) for _, a, b in base])
    picked: list[tuple[int, int]] = []
    out: list[tuple[int, int, int, float | None]] = [(*s, None) for s in base]
    for i in sorted(np.flatnonzero(score >= 0), key=lambda i: (-score[i], spans[i, 1] - spans[i, 2], *spans[i, :3])):
        k, a, b = (int(v) for v in spans[i, :3])
        near = bisect.bisect_left(picked, (a, b))
        clash = any(p < b and a < q for p, q in picked[max(0, near - 1) : near + 1])
        if not clash and not free(a, b):
            bisect.insort(picked, (a, b))
            out.append((k, a, b, float(score[i])))
    return sorted(out, key=lambda s: (s[1], s[0], s[2]))


_FOUND = "doc_id long, base binary, spans binary, features binary"


def _proposals(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base, spans, rows = [], [], []
            for text in b.column(1):
                s, c, x = proposed(text.as_py() or "")
                base.append(np.array(s, np.int64).tobytes()), spans.append(c.tobytes()), rows.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(v, pa.binary()) for v in (base, spans, rows))], ["doc_id", "base", "spans", "features"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _FOUND)


def _unpacked(b: pa.RecordBatch) -> Iterator[tuple[int | None, list[Span], np.ndarray, np.ndarray]]:
    for i, base, spans, x in zip(*(c.to_pylist() for c in b.columns), strict=True):
        yield i, [tuple(s) for s in np.frombuffer(base, np.int64).reshape(-1, 3).tolist()], np.frombuffer(spans, np.int64).reshape(-1, 4), np.frombuffer(x, np.float32).reshape(-1, FEATURES)


#: Different labelled rows up to which the passes of a fit are no work for Spark (26 bytes each), and beyond, rows a task.
FEW_ROWS = 20_000
TASK_ROWS = 200_000


def weighted(found: DataFrame) -> DataFrame:
    """(kind, label, x, n): every candidate with a label, by its features in bins, and how many there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [np.column_stack([spans[at][:, [0, 3]].astype(np.uint8), binned(x[at])]) for _, _, spans, x in _unpacked(b) for at in [spans[:, 3] >= 0] if at.any()]
            if rows:
                v, n = np.unique(np.concatenate(rows), axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(v[:, 0], pa.int64()), pa.array(v[:, 1], pa.int64()), pa.array([r.tobytes() for r in v[:, 2:]], pa.binary()), pa.array(n, pa.int64())], ["kind", "label", "x", "n"])

    return found.mapInArrow(run, "kind long, label long, x binary, n long").groupBy("kind", "label", "x").agg(F.sum("n").alias("n"))


def _packed(rows: DataFrame) -> DataFrame:
    """(kind, x, label, n): rows of one kind as blocks of bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kind, label, n = (b.column(c).to_numpy() for c in ("kind", "label", "n"))
            x = np.frombuffer(b"".join(b.column("x").to_pylist()), np.uint8).reshape(-1, FEATURES)
            for k in np.unique(kind):
                at = kind == k
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), *(pa.array([v.tobytes()], pa.binary()) for v in (x[at].T, label[at], n[at]))], ["kind", "x", "label", "n"])

    return rows.mapInArrow(run, "kind long, x binary, label binary, n binary")


def block(row: tuple[int, bytes, bytes, bytes]) -> Block:
    """A block of ``_packed``; copies of a row are in one fold, by a hash of its features."""
    label, n = (np.frombuffer(v, np.int64) for v in row[2:])
    x = np.frombuffer(row[1], np.uint8).reshape(FEATURES, -1)
    h = np.full(len(n), row[0] + 1, np.uint64)
    for f in x:
        h = mix(h * np.uint64(0xD6E8FEB86659FD93) + f)
    return row[0], x, label, n, (h % np.uint64(3)).astype(int)


def learn(found: DataFrame, precision: float = 0.98, least: int = 8) -> Model:
    """The model of a table of proposals, from all candidates that have a label; sums by bin reach the driver."""
    rows = cut(weighted(found))
    n = rows.count()
    if not n:
        return {}
    blocks = cut(_packed(rows.coalesce(-(-n // TASK_ROWS))))
    if n <= FEW_ROWS:
        here = [block(tuple(r)) for r in blocks.collect()]
        return fit(lambda f: reduce(np.add, map(f, here)), precision, least)
    there = blocks.rdd
    return fit(lambda f: there.map(lambda r: f(block(tuple(r)))).treeReduce(np.add), precision, least)


_SPAN = "struct<kind:string,start:long,end:long,score:double>"


def find(docs: DataFrame, precision: float = 0.98) -> DataFrame:
    """(doc_id, spans): all spans of ``docs(doc_id, text)`` by start and kind; ``score`` is null for base matches."""
    found = cut(_proposals(docs))
    model = docs.sparkSession.sparkContext.broadcast(learn(found, precision))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, [{"kind": KINDS[k], "start": s, "end": e, "score": p} for k, s, e, p in chosen(base, spans, x, model.value)]) for i, base, spans, x in _unpacked(b)]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([s for _, s in rows], kind)], ["doc_id", "spans"])

    return found.mapInArrow(run, f"doc_id long, spans array<{_SPAN}>")


def redact(docs: DataFrame, precision: float = 0.98) -> DataFrame:
    """(doc_id, text, n_redacted): texts with ``[EMAIL]`` and the like in place of spans; overlapping spans become one mark."""
    model = docs.sparkSession.sparkContext.broadcast(learn(cut(_proposals(docs)), precision))

    def clean(text: str) -> tuple[str, int]:
        parts, at, n = [], 0, 0
        for k, a, b, _ in chosen(*proposed(text), model.value):
            if a >= at:
                parts += [text[at:a], f"[{KINDS[k].upper()}]"]
            at, n = max(at, b), n + 1
        return "".join([*parts, text[at:]]), n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(None, 0) if t is None else clean(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t for t, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], ["doc_id", "text", "n_redacted"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, text string, n_redacted long")
