"""Personal data: base patterns against the plain regular expressions, and what the model adds."""

import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenreel.llm import pii
from lumenreel.llm.trees import BoostedTrees, precise_threshold

PLAIN = {
    pii.EMAIL: r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", pii.IP: r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    pii.CARD: r"[0-9]([\x20-]?[0-9])+", pii.PHONE: r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def brute(text):
    """The contract's base, pattern by pattern."""
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {pii.EMAIL: True, pii.IP: all(int(x) <= 255 for x in m[0].split(".")) if kind == pii.IP else True, pii.CARD: 12 <= len(d) <= 19 and luhn(d or "1"), pii.PHONE: 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], s[0]))


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(st.sampled_from("a.@-b9 é"), max_size=40), st.text(st.sampled_from("0123456789 -.+()@x\n"), max_size=60), st.text(st.sampled_from("12."), max_size=30)))
def test_base(text):
    assert pii.base_spans(text) == brute(text)


def test_base_on_long_runs():
    """Runs of a million characters take linear time."""
    for text in ("9" * 1_000_000, "a" * 1_000_000 + "@", "1 " * 500_000, "(" * 1_000_000, "1." * 300_000 + "x", "@" * 200_000, " at " * 200_000):
        assert len(pii.base_spans(text)) <= len(text)
    assert len(pii.candidates("a@" * 100_000)) == 0


def test_trees():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 5)).astype(np.float32)
    y = ((x[:, 1] > 0.3) ^ (x[:, 3] < -0.2)).astype(float)
    model = BoostedTrees().fit(x[:400], y[:400])
    assert ((model.predict(x[400:]) > 0.5) == y[400:]).mean() > 0.95
    assert precise_threshold(np.array([0.9, 0.8, 0.8, 0.6]), np.array([1, 1, 0, 1]), 0.9, 2) == (0.9 + 0.8) / 2
    assert precise_threshold(np.array([0.9, 0.8]), np.array([1, 1]), 0.9, 3) == float("inf")


def card(rng):
    d = "".join(rng.choice("0123456789") for _ in range(15))
    return next(d + c for c in "0123456789" if luhn(d + c))


def corpus():
    """(texts, what a reader would mark as hidden from the base patterns)."""
    rng = random.Random(4)
    words = ["the", "river", "of", "token", "at", "stone", "é", "and", "version 3.0.", "page"]
    fill = lambda n: " ".join(rng.choice(words) for _ in range(n))
    ip = lambda: ".".join(str(rng.randrange(1, 255)) for _ in range(4))
    phone = lambda: f"+1 ({rng.randrange(100, 999)}) 555-{rng.randrange(1000, 9999)}"
    texts = []
    for i in range(400):
        kinds = (card(rng), ip(), phone(), f"user{i}@mail{i % 9}.example.com", str(10**15 + rng.randrange(10**15) * 10 + 1), "a" + str(rng.randrange(10**9, 10**10)), "300.1.2." + str(i), "2024-05-17 10:20")
        texts.append(f"{fill(8)} {kinds[i % 8]} {fill(6)}")
    hidden = []
    for i in range(30):
        a, b = (card(rng), card(rng)) if i % 2 else (phone(), ip())
        texts.append(f"{fill(5)} {a} {b} {fill(5)}")
        hidden += [(len(texts) - 1, a)] + [(len(texts) - 1, b)] * (i % 2)
    texts += [f"write to user{i} (at) mail{i % 5} [dot] example [dot] com {fill(4)}" for i in range(10)]
    hidden += [(len(texts) - 10 + i, f"user{i} (at) mail{i % 5} [dot] example [dot] com") for i in range(10)]
    return [*texts, *[fill(40) for _ in range(100)], None, "", "x"], hidden


def test_find(spark):
    texts, hidden = corpus()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, spans string, kind int")
    docs = docs.union(spark.createDataFrame([(None, texts[3], "x", 1), (3, texts[3], "y", 2)], docs.schema))
    got = pii.find(docs).collect()
    rows = {r.doc_id: r.spans for r in got}
    assert len(got) == len(texts) + 2 and rows[None] == rows[3]
    for i, t in enumerate(texts):
        assert [(pii.KINDS.index(s.kind), s.start, s.end) for s in rows[i] if s.score is None] == brute(t or "")
    added = {(i, texts[i][s.start : s.end]) for i, spans in rows.items() if i is not None for s in spans if s.score is not None}
    assert len(added & set(hidden)) >= 0.85 * len(hidden), set(hidden) - added
    assert len(added - set(hidden)) <= 2, added - set(hidden)
    for spans in rows.values():
        ends = sorted((s.start, s.end) for s in spans if s.score is not None)
        assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:], strict=False))


def test_redact(spark):
    texts, hidden = corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert rows[len(texts) - 3].text is None and rows[len(texts) - 2].text == "" and rows[len(texts) - 4].text == texts[-4]
    assert rows[3].n_redacted == 1 and "[EMAIL]" in rows[3].text and "user3" not in rows[3].text
    i, secret = hidden[1]
    assert secret not in rows[i].text


def test_without_examples(spark):
    """Too few matches to learn from: the base alone."""
    docs = spark.createDataFrame([(1, "call +1 (826) 555-4081 190.137.223.204"), (2, None)], "doc_id long, text string")
    assert {r.doc_id: [tuple(s) for s in r.spans] for r in pii.find(docs).collect()} == {1: [("ip", 23, 38, None)], 2: []}
    assert pii.find(docs.filter("doc_id > 2")).count() == 0
