"""Packing token pieces into sequences under several limits at once (vector bin packing).

An example asks for tokens, one segment, and loss-bearing tokens; a sequence has limits on all three.  Each task packs
its own rows: a sliding window of waiting examples, from which the open sequence takes the one whose demand has the
largest dot product with what is left of the limits (Panigrahy et al.'s heuristic).  When nothing fits whole, the best
example is cut at the space that is left.  A sequence that closes early, because a limit other than tokens is used up or
the rows end, is cut into sequences whose lengths are powers of two, which need no padding.

Nothing is shuffled: a task holds one batch of rows and a bounded window, so memory does not grow with the table, and a
lost task is packed again alike from the same rows.  Sequence ids carry the task's partition in their upper bits.

Null texts count as empty and give the closing id alone.  Repeated rows are packed separately.  Rows without ``doc_id``
are packed with a null id.  An empty table gives no pieces.  Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parts of texts whose ids a Python worker remembers in each of two generations.
CACHE = 500_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

# The classes of the tokenizer's split pattern for characters up to U+00FF, in lower case.
_LETTER, _NUMBER, _BLANK = r"a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", r"0-9\xb2\xb3\xb9\xbc-\xbe", r"\t\n\v\f\r \x85\xa0"
#: No token spans ASCII white space.
_SPACES = re.compile(r"[\x20\x09-\x0D]+")
_PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_BLANK}{_LETTER}{_NUMBER}]+")


class Memory:
    """A dictionary of bounded size: when the younger generation is full, it replaces the older one."""

    def __init__(self) -> None:
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def missing(self, keys: set[str]) -> list[str]:
        """Those of ``keys`` that are not known; afterwards all others are in the younger generation."""
        if len(self.young) > CACHE:
            self.old, self.young = self.young, {}
        young, old, out = self.young, self.old, []
        for k in keys.difference(young):
            if k in old:
                young[k] = old[k]
            else:
                out.append(k)
        return out


class WordEncoder:
    """Ids of whole texts by a tokenizer with word-end tokens that drops white space.

    Texts of characters up to U+00FF are split here as the tokenizer's pattern does, and each distinct part is encoded
    once; a part ends at its only token with the word-end suffix.  Of other texts, words beyond U+00FF and words with
    special tokens are left to the tokenizer as they are.
    """

    def __init__(self, path: str, suffix: str = "</w>") -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), Memory()
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True

    @staticmethod
    def _plain(text: str) -> bool:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        return "<|" not in text

    def _split(self, text: str, odd: set[str]) -> list[str]:
        if self._plain(text):
            return _PARTS.findall(text.lower())
        parts: list[str] = []
        for w in _SPACES.split(text):
            if self._plain(w):
                parts += _PARTS.findall(w.lower())
            else:
                parts.append(w)
                odd.add(w)
        return parts

    def _learn(self, parts: set[str], odd: set[str]) -> None:
        new = self.known.missing(parts)
        known = self.known.young
        whole = [w for w in new if w in odd]
        for w, e in zip(whole, self.tokenizer.encode_batch_fast(whole, add_special_tokens=False), strict=True):
            known[w] = np.array(e.ids, np.uint32).tobytes()
        new = [w for w in new if w not in odd] if odd else new
        for i in range(0, len(new), 2000):
            some = new[i : i + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.uint32)
            raw, ends = ids.tobytes(), (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()
            known.update(zip(some, map(raw.__getitem__, map(slice, [0, *ends[:-1]], ends)), strict=True))

    def __call__(self, texts: list[str], end: int) -> Iterator[np.ndarray]:
        odd: set[str] = set()
        split = [self._split(t, odd) for t in texts]
        self._learn(set().union(*split), odd)
        known = self.known.young.__getitem__
        close = end.to_bytes(4, "little")
        for parts in split:
            yield np.frombuffer(b"".join([*map(known, parts), close]), np.uint32)


class Packer:
    """The open sequence and the window of waiting examples of one task."""

    def __init__(self, limits: tuple[int, int, int], window: int, first_id: int) -> None:
        self.limits, self.window, self.next_id = np.array(limits, np.int64), window, first_id
        self.need = np.zeros((2 * window, 3), np.int64)
        self.items: list[tuple | None] = [None] * (2 * window)
        self.n = 0
        self.open: list[tuple] = []
        self.left = self.limits.copy()
        self.out: list[tuple] = []

    def add(self, doc: tuple, start: int, ids: np.ndarray, loss: int) -> None:
        """An example: (doc_id, doc_tokens), where its ids start in the document, and how many of them bear loss (the last ones)."""
        while len(ids):
            if self.n >= 2 * self.window:
                self.fill(self.window)
            take = min(len(ids), int(self.limits[0]))
            bears = min(take, max(0, loss - (len(ids) - take)))
            if bears > self.limits[2]:  # the quiet ids before them, and as many that bear loss as there may be
                take, bears = take - bears + int(self.limits[2]), int(self.limits[2])
            self.items[self.n], self.need[self.n] = (doc, start, ids[:take]), (take, 1, bears)
            self.n += 1
            start, ids, loss = start + take, ids[take:], loss - bears

    def fill(self, leave: int) -> None:
        """Place examples until only ``leave`` wait."""
        while self.n > leave:
            need = self.need[: self.n]
            fits = (need <= self.left).all(axis=1)
            score = (need / self.limits) @ (self.left / self.limits)
            if fits.any():
                self.place(int(np.argmax(np.where(fits, score, -1.0))))
            elif self.left[0] > 0 and self.left[1] > 0 and self.left[2] > 0:
                self.cut(int(np.argmax(score)))
            else:
                self.close()
            if not self.left[0]:
                self.close()

    def _drop(self, i: int) -> None:
        self.n -= 1
        self.items[i], self.need[i] = self.items[self.n], self.need[self.n]

    def place(self, i: int) -> None:
        self.open.append(self.items[i])
        self.left = self.left - self.need[i]
        self._drop(i)

    def cut(self, i: int) -> None:
        """The first ids of an example, as many as the limits leave room for; the rest waits on."""
        doc, start, ids = self.items[i]
        tokens, _, loss = (int(x) for x in self.need[i])
        quiet = tokens - loss  # loss-bearing ids come last
        take = min(tokens, int(self.left[0]), quiet + int(self.left[2]))
        self.open.append((doc, start, ids[:take]))
        bears = max(0, take - quiet)
        self.left = self.left - np.array([take, 1, bears])
        if take == tokens:
            self._drop(i)
        else:
            self.items[i], self.need[i] = (doc, start + take, ids[take:]), (tokens - take, 1, loss - bears)

    def close(self) -> None:
        """Emit the open sequence; if it is not full, as sequences whose lengths are powers of two."""
        total = int(self.limits[0] - self.left[0])
        room, at = 0, 0
        for doc, start, ids in self.open:
            while len(ids):
                if not room:
                    room = total if total == self.limits[0] else 1 << (total.bit_length() - 1)
                    total, at, self.next_id = total - room, 0, self.next_id + 1
                part = ids[:room]
                self.out.append((doc[0], start, len(part), zlib.crc32(part.tobytes()), doc[1], self.next_id - 1, at))
                start, ids, room, at = start + len(part), ids[len(part) :], room - len(part), at + len(part)
        self.open, self.left = [], self.limits.copy()

    def rows(self) -> pa.RecordBatch:
        out, self.out = self.out, []
        columns = list(zip(*out, strict=True)) or [[]] * 7
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [x.split(" ")[0] for x in SCHEMA.split(", ")])


def pack(docs: DataFrame, encoder: Callable[[], Callable[[list[str], int], Iterator[np.ndarray]]], max_tokens: int = 2048, max_segments: int = 256, max_loss_tokens: int = 2048, end: int = 1, window: int = 512) -> DataFrame:
    """Pieces of all documents in ``docs(doc_id, text[, loss_tokens])``: see SCHEMA.

    ``encoder()`` is called once a task and gives texts -> ids, closed by ``end``.  ``loss_tokens``, if there is such a
    column, is the number of last ids that bear loss (an answer's, in instruction data); else all ids bear it.
    """
    has_loss = "loss_tokens" in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = encoder(), Packer((max_tokens, max_segments, max_loss_tokens), window, TaskContext.get().partitionId() << 33)
        for b in batches:
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                loss = part.column(2).to_pylist() if has_loss else [None] * part.num_rows
                for doc, ids, bears in zip(part.column(0).to_pylist(), encode(part.column(1).fill_null("").to_pylist(), end), loss, strict=True):
                    packer.add((doc, len(ids)), 0, ids, len(ids) if bears is None else min(max(bears, 0), len(ids)))
                if len(packer.out) > 5_000:
                    yield packer.rows()
        packer.fill(0)
        packer.close()
        yield packer.rows()

    columns = [F.col("doc_id").cast("long"), "text", *(["loss_tokens"] if has_loss else [])]
    return docs.select(*columns).mapInArrow(run, SCHEMA)
