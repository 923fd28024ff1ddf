"""Fill-in-middle examples from texts in seekable compressed frames.

A text is stored as independent zstandard frames of ``frame_bytes`` bytes at most, with cumulative counts of units, code
points and bytes at each frame's start.  A unit is a word with the white space before it, or the white space at the end.
Everything is then done frame by frame:

* how many units a text has, and where cuts fall, follows from the counts; only the *cut frames* are decompressed to find
  the byte and the code point of a cut;
* an example is the same text in another order, written as frames again; whole plain texts are handed on as they are;
* digests, and the way back from an example to its text, stream the frames in order, so that a task never holds more of a
  text uncompressed than one frame.  The way back reads the example and its form alone.

Cuts come from a keyed hash: ``h1`` to ``h4`` are the first four 32-bit numbers of sha256(``seed:doc_id``).  The prefix ends
after the smaller of ``h1 % (n + 1)`` and ``h2 % (n + 1)`` units, the middle after the larger.  ``h3`` decides whether a
text is transformed, ``h4`` which part comes first: prefix-suffix-middle (``psm``) or suffix-prefix-middle (``spm``).

Null and empty texts, and texts that hold a marker, stay ``plain``.  Very long texts and words are cut into frames wherever
``frame_bytes`` fall, but never inside a code point.  Repeated rows give equal results; a null ``doc_id`` is hashed as
``seed:`` alone.  An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most bytes of text in a frame.
FRAME_BYTES = 1 << 16
#: Compressed bytes after which a task hands its rows on.
BATCH_BYTES = 16_000_000
STORE = "doc_id long, n long, frames array<binary>, units array<long>, chars array<long>, bytes array<long>"
EXAMPLE = "doc_id long, n long, form string, prefix_chars long, middle_chars long, frames array<binary>, bytes array<long>"
#: prefix, suffix and middle markers.
MARKERS = ("<P>", "<S>", "<M>")
#: Which parts (prefix 0, suffix 1, middle 2) an example has, in its order.
ORDERS = {"psm": (0, 1, 2), "spm": (1, 0, 2)}
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


class Writer:
    """Bytes in, independent frames out."""

    def __init__(self, frame_bytes: int, level: int) -> None:
        self.most, self.zstd = frame_bytes, zstandard.ZstdCompressor(level=level)
        self.frames: list[bytes] = []
        self.ends = [0]
        self.open = bytearray()

    def add(self, data: bytes) -> None:
        self.open += data
        while len(self.open) >= self.most:
            self._close(self.most)

    def _close(self, n: int) -> None:
        self.frames.append(self.zstd.compress(bytes(self.open[:n])))
        self.ends.append(self.ends[-1] + n)
        del self.open[:n]

    def finish(self) -> tuple[list[bytes], list[int]]:
        if self.open:
            self._close(len(self.open))
        return self.frames, self.ends


def _unit_ends(frame: np.ndarray, following: int | None) -> np.ndarray:
    """Where words end in a frame: offsets behind their last byte. ``following``: the first byte of the next frame."""
    word = ~_SPACE[frame]
    after = np.append(word[1:], following is not None and not _SPACE[following])
    return np.flatnonzero(word & ~after) + 1


def framed(text: bytes, frame_bytes: int = FRAME_BYTES, level: int = 3) -> tuple[int, list[bytes], list[int], list[int], list[int]]:
    """(units in all, frames, and the words ended, code points and bytes before each frame and at the end)."""
    data, zstd = np.frombuffer(text, np.uint8), zstandard.ZstdCompressor(level=level)
    frames, units, chars, ends = [], [0], [0], [0]
    while ends[-1] < len(data):
        a, b = ends[-1], min(ends[-1] + frame_bytes, len(data))
        while b < len(data) and a < b - 1 and data[b] & 0xC0 == 0x80:
            b -= 1
        part = data[a:b]
        frames.append(zstd.compress(part.tobytes()))
        units.append(units[-1] + len(_unit_ends(part, data[b] if b < len(data) else None)))
        chars.append(chars[-1] + int(np.count_nonzero(part & 0xC0 != 0x80)))
        ends.append(b)
    return units[-1] + bool(len(data) and _SPACE[data[-1]]), frames, units, chars, ends


def read(frames: Sequence[bytes], ends: Sequence[int], start: int = 0, stop: int | None = None) -> Iterator[bytes]:
    """The bytes from ``start`` to ``stop``, frame by frame; no other frame is decompressed."""
    stop = ends[-1] if stop is None else stop
    zstd = zstandard.ZstdDecompressor()
    k = int(np.searchsorted(ends, start, "right")) - 1
    while start < stop:
        raw = zstd.decompress(frames[k])
        yield raw[start - ends[k] : stop - ends[k]]
        k, start = k + 1, ends[k + 1]


def position(k: int, n: int, frames: Sequence[bytes], units: Sequence[int], chars: Sequence[int], ends: Sequence[int]) -> tuple[int, int]:
    """(byte, code point) behind the first ``k`` of ``n`` units: one frame is decompressed, or none."""
    if k <= 0:
        return 0, 0
    if k >= n:
        return ends[-1], chars[-1]
    f = int(np.searchsorted(units, k, "left")) - 1
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(frames[f]), np.uint8)
    inner = _unit_ends(raw, None)  # a word may go on behind the frame's last byte, but then its end is not counted here
    at = int(inner[k - units[f] - 1])
    return ends[f] + at, chars[f] + int(np.count_nonzero(raw[:at] & 0xC0 != 0x80))


def marks(chunks: Iterable[bytes], markers: Sequence[bytes]) -> list[int | None]:
    """Where each marker stands first in a stream of chunks, or None."""
    found: list[int | None] = [None] * len(markers)
    keep, tail, at = max(map(len, markers)) - 1, b"", 0
    for chunk in chunks:
        data = tail + chunk
        for i, m in enumerate(markers):
            if found[i] is None and (p := data.find(m)) >= 0:
                found[i] = at - len(tail) + p
        at, tail = at + len(chunk), data[-keep:] if keep else b""
    return found


def restored(frames: Sequence[bytes], ends: Sequence[int], form: str, markers: Sequence[bytes]) -> Iterator[bytes]:
    """The text that an example of ``form`` was made of, in order."""
    if form == "plain":
        yield from read(frames, ends)
        return
    at, order = marks(read(frames, ends), markers), ORDERS[form]
    stops = [at[i] for i in order[1:]] + [ends[-1]]
    parts = {i: (at[i] + len(markers[i]), stop) for i, stop in zip(order, stops, strict=True)}
    for i in (0, 2, 1):
        yield from read(frames, ends, *parts[i])


def _batches(rows: Iterator[tuple[int, tuple]], schema: str) -> Iterator[pa.RecordBatch]:
    """``rows`` of (bytes, values) as Arrow batches of bounded size."""
    kinds = {"long": pa.int64(), "string": pa.string(), "array<binary>": pa.list_(pa.binary()), "array<long>": pa.list_(pa.int64())}
    fields = [x.split(" ") for x in schema.split(", ")]
    held, size = [], 0

    def out() -> pa.RecordBatch:
        columns = list(zip(*held, strict=True)) or [()] * len(fields)
        return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [f for f, _ in fields])

    for n, row in rows:
        held.append(row)
        size += n
        if size >= BATCH_BYTES or len(held) >= 10_000:
            yield out()
            held, size = [], 0
    yield out()


def store(docs: DataFrame, frame_bytes: int = FRAME_BYTES, level: int = 3) -> DataFrame:
    """The texts of ``docs(doc_id, text)`` as seekable frames: see STORE."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[int, tuple]]:
            for b in batches:
                for i, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    n, frames, *counts = framed(text.as_buffer().to_pybytes() if text.is_valid else b"", frame_bytes, level)
                    yield sum(map(len, frames)), (i, n, frames, *counts)

        yield from _batches(rows(), STORE)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, STORE)


def examples(stored: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80, markers: Sequence[str] = MARKERS, frame_bytes: int = FRAME_BYTES, level: int = 3) -> DataFrame:
    """Examples of a store, as frames: see EXAMPLE.

    ``rate``: hundredths of the texts that are transformed; ``spm``: hundredths of those that begin with the suffix.
    Counts are null where the form is ``plain``.
    """
    tags = [m.encode() for m in markers]

    def example(i: int | None, n: int, frames: list[bytes], units: list[int], chars: list[int], ends: list[int]) -> tuple:
        digest = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
        h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
        if not frames or h[2] % 100 >= rate or any(x is not None for x in marks(read(frames, ends), tags)):
            return i, n, "plain", None, None, frames, ends
        cuts = [position(k, n, frames, units, chars, ends) for k in sorted((h[0] % (n + 1), h[1] % (n + 1)))]
        (a, to_a), (b, to_b) = cuts
        form, parts, w = "spm" if h[3] % 100 < spm else "psm", ((0, a), (b, ends[-1]), (a, b)), Writer(frame_bytes, level)
        for k in ORDERS[form]:
            w.add(tags[k])
            for chunk in read(frames, ends, *parts[k]):
                w.add(chunk)
        return i, n, form, to_a, to_b - to_a, *w.finish()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[int, tuple]]:
            for b in batches:
                for k in range(b.num_rows):
                    row = example(*(c[k].as_py() for c in b.columns))
                    yield sum(map(len, row[5])), row

        yield from _batches(rows(), EXAMPLE)

    return stored.select("doc_id", "n", "frames", "units", "chars", "bytes").mapInArrow(run, EXAMPLE)


def digests(made: DataFrame, markers: Sequence[str] = MARKERS) -> DataFrame:
    """``made`` with the SHA-256 of each example, and of the text rebuilt from it, in place of the frames."""
    tags = [m.encode() for m in markers]
    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"

    def of(chunks: Iterable[bytes]) -> str:
        h = hashlib.sha256()
        for c in chunks:
            h.update(c)
        return h.hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, back = [], []
            for k in range(b.num_rows):
                form, frames, ends = (b.column(c)[k].as_py() for c in ("form", "frames", "bytes"))
                out.append(of(read(frames, ends)))
                back.append(out[-1] if form == "plain" else of(restored(frames, ends, form, tags)))
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(out, pa.string()), pa.array(back, pa.string())], [x.split(" ")[0] for x in schema.split(", ")])

    return made.select(*(x.split(" ")[0] for x in EXAMPLE.split(", "))).mapInArrow(run, schema)
