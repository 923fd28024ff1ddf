"""Fill-in-middle examples: frames, cuts and the way back, against plain strings."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenreel.llm import fim

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
TAGS = [m.encode() for m in fim.MARKERS]
texts = st.text(st.sampled_from("ab é\n\t한😀\x0b\x1f <P>"), max_size=80)


@settings(max_examples=150, deadline=None)
@given(texts, st.integers(1, 9), st.data())
def test_frames(text, size, data):
    raw, units = text.encode(), UNIT.findall(text)
    n, frames, *counts = fim.framed(raw, size)
    assert n == len(units) and b"".join(fim.read(frames, counts[2])) == raw
    assert counts[1][-1] == len(text)
    k = data.draw(st.integers(0, n))
    start = "".join(units[:k])
    assert fim.position(k, n, frames, *counts) == (len(start.encode()), len(start))
    a, b = sorted(data.draw(st.tuples(st.integers(0, len(raw)), st.integers(0, len(raw)))))
    assert b"".join(fim.read(frames, counts[2], a, b)) == raw[a:b]
    assert fim.marks(fim.read(frames, counts[2]), TAGS) == [raw.find(t) if t in raw else None for t in TAGS]


def plain(doc_id, text):
    """The contract, on strings."""
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    d = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in fim.MARKERS) or h[2] % 100 >= 50:
        form, out = "plain", text
    elif h[3] % 100 < 80:
        form, out = "spm", f"<S>{s}<P>{p}<M>{m}"
    else:
        form, out = "psm", f"<P>{p}<S>{s}<M>{m}"
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, n, form, None if form == "plain" else len(p), None if form == "plain" else len(m), sha(out), sha(text))


@pytest.mark.parametrize("frame_bytes", [7, fim.FRAME_BYTES])
def test_examples(spark, frame_bytes):
    words = "über 한국어 😀 a  b\tc\n".split(" ")
    rows = [(i, " ".join(words[j % len(words)] * (1 + j % 3) for j in range(i % 23)) + " " * (i % 4)) for i in range(150)]
    rows += [(200, None), (201, ""), (202, " \n "), (203, "x<M>y " * 3), (204, "<"), (None, "no id at all"), (205, "x" * 300_000 + " y"), (5, rows[5][1]), (206, "word " * 60_000)]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, n string, frames int")
    got = fim.digests(fim.examples(fim.store(docs, frame_bytes), frame_bytes=frame_bytes)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((plain(*r) for r in rows), key=repr)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_selection_decompresses_cut_frames_only(spark):
    text = ("word " * 200_000).encode()
    n, frames, *counts = fim.framed(text)
    lame = [f if k == 7 else b"not a frame" for k, f in enumerate(frames)]
    assert fim.position(counts[0][7] + 5, n, lame, *counts)[0] == counts[2][7] + len(text[counts[2][7] :].split(b" ")[0]) + 4 * 5
    assert fim.digests(fim.examples(fim.store(spark.createDataFrame([], "doc_id long, text string")))).count() == 0
