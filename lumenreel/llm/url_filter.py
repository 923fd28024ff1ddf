"""URL filters: explicit rules, and a classifier on segmented words for URLs that no rule fits.

Rules name a host and a path prefix; a rule fits its host and all subdomains, and the longest fitting rule decides.
Other URLs are judged by their words: runs of letters of host and path are split into words by a unigram Viterbi search
(the split with the largest product of word probabilities), whose probabilities are counted over all words of all
documents.  A multinomial naive Bayes model scores the tokens.

Its labels: ``labelled(url, label)``, where a user has such URLs.  Without it the evidence is split from the decision.  A
URL without a fitting rule is a blocked example if one of its words is in ``seeds``, a few words that name unwanted sites;
it is an allowed one if it has no such word and a part of its host is made of words that the documents use (of LEAST_LETTERS
letters or more, so that a name that only falls into letters is not).  All other URLs have no label: they are learned from
as a mixture, in ``rounds`` of expectation and maximisation, with the model's own probabilities as weights.  The verdict of
a rule whose host has a word is a label too.  A rule of suffix labels alone fits hosts of any words, so its verdict says
nothing of theirs: its URLs are examples only where it blocks a seed word.  The model then decides every URL without a rule
by all of its tokens: the words of host and path, told apart, and for each part of the host whether documents know it.  What
rules look at literally (suffix labels, and runs of letters of their paths but seeds) is not used.

No vocabulary is capped, and nothing but counts reaches the driver: distinct runs are joined with the counts of the words
that occur in them, and each distinct run is split once.  Joins of URLs with their runs' words and with the words' weights
are salted, as one host may have a third of all URLs.

Null URLs and URLs without ``://`` have empty host and path and no tokens; naive Bayes then answers by its prior.
Repeated URLs are judged alike.  Rows without ``page_id`` are judged too.  Without any blocked example all are allowed.
Words of more than LONGEST letters are split.  Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenreel.llm.common import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of unwanted sites.
SEEDS = ("adult", "bet", "bets", "casino", "cheap", "farm", "pills", "porn", "spam", "xxx")
#: Host labels that carry no word.
STOP_LABELS = ("com", "example", "net", "org", "www")
#: Longest word that a split considers, and the shortest whose use in documents speaks for a name.
LONGEST = 24
LEAST_LETTERS = 3
#: Tokens of a host's parts that documents know or do not know.
KNOWN, NEW = "h:#known", "h:#new"
#: Shares of a key in joins.
SALTS = 16
RUN = re.compile(r"[a-z]+|[0-9]+")


def host_path(url: Column) -> tuple[Column, Column]:
    host = F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)
    return host, F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, else nulls.  ``rules``: (``host/path``, verdict)."""
    rule, verdict = None, None
    for text, says in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")
        rule, verdict = (F.when(fits, text), F.when(fits, says)) if rule is None else (rule.when(fits, text), verdict.when(fits, says))
    return (F.lit(None), F.lit(None)) if rule is None else (rule, verdict)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): lower-case ASCII words of all documents."""
    runs = F.explode(F.split(F.lower("text"), r"[^a-z]+"))
    return docs.select(runs.alias("word")).filter("word <> ''").groupBy("word").agg(F.count("*").alias("n"))


def segment(run: str, costs: dict[str, float], unknown: float) -> list[str]:
    """The cheapest split of a run of letters; a single unknown letter costs ``unknown``, neighbours of that kind join."""
    best: list[tuple[float, int, bool]] = [(0.0, 0, True)]
    for j in range(1, len(run) + 1):
        choices = [(best[j - 1][0] + unknown, j - 1, False)]
        for i in range(max(0, j - LONGEST), j):
            c = costs.get(run[i:j])
            if c is not None:
                choices.append((best[i][0] + c, i, True))
        best.append(min(choices))
    out: list[str] = []
    j, joined = len(run), False
    while j:
        _, i, known = best[j]
        if not known and joined:
            out[-1] = run[i:j] + out[-1]
        else:
            out.append(run[i:j])
        joined, j = not known, i
    return out[::-1]


def _runs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"([a-z]+|[0-9]+)"), F.lit(1))


def _salted(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``rows`` (with a ``salt``) joined with one row a key of ``table``, each key in SALTS shares."""
    return rows.join(table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [key, "salt"], "left").drop("salt")


def segmented(runs: DataFrame, docs: DataFrame, seeds: Sequence[str]) -> DataFrame:
    """(run, words, known) of distinct ``runs(run)`` of letters, by the counts of the documents' words; seeds count at least once.

    ``known``: all words are the documents' own, of LEAST_LETTERS letters at least.
    """
    counts = cut(word_counts(docs))
    total = counts.agg(F.sum("n")).first()[0] or 1
    top = max(1.0, math.log(total))  # the cost of a word that occurs once
    at = F.explode(F.sequence(F.lit(1), F.length("run"))).alias("i")
    parts = runs.select("run", at).select("run", "i", F.explode(F.sequence(F.lit(1), F.least(F.lit(LONGEST), F.length("run") - F.col("i") + 1))).alias("k"))
    parts = parts.select("run", "i", "k", F.substring("run", F.col("i"), F.col("k")).alias("word"))
    known = counts.select("word", (math.log(total) - F.log("n")).alias("cost"), F.lit(True).alias("own"))
    extra = runs.sparkSession.createDataFrame([(x, top, False) for x in seeds], "word string, cost double, own boolean")
    known = known.union(extra).groupBy("word").agg(F.min("cost").alias("cost"), F.max("own").alias("own"))
    spans = parts.join(known, "word").groupBy("run").agg(F.collect_list(F.struct("i", "k", "cost", "own")).alias("spans"))  # at most LONGEST times a run's letters
    rows = runs.join(spans, "run", "left").select("run", F.coalesce("spans", F.array().cast("array<struct<i:int,k:int,cost:double,own:boolean>>")).alias("spans"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, own = [], []
            for run, spans in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = {run[x["i"] - 1 : x["i"] - 1 + x["k"]]: x for x in spans}
                out.append(segment(run, {w: x["cost"] for w, x in found.items()}, top + 3.0))
                own.append(all(len(w) >= LEAST_LETTERS and w in found and found[w]["own"] for w in out[-1]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.string())), pa.array(own, pa.bool_())], ["run", "words", "known"])

    return rows.mapInArrow(split, "run string, words array<string>, known boolean")


def tokens(urls: DataFrame, docs: DataFrame, rules: Sequence[tuple[str, str]], seeds: Sequence[str], stop_labels: Sequence[str]) -> DataFrame:
    """(id, token, salt) of ``urls(id, host, path)``: ``h:word`` and ``p:word``; numbers are ``#``.  Runs of rules' paths give none.

    Each run of letters of a host gives KNOWN or NEW besides.
    """
    own = sorted({run for text, _ in rules for run in RUN.findall(text.partition("/")[2].lower())} - set(seeds))
    labels = F.filter(F.split("host", r"\."), lambda x: ~x.isin(list(stop_labels)))
    host = F.transform(_runs(F.array_join(labels, ".")), lambda x: F.struct(F.lit("h").alias("kind"), x.alias("run")))
    path = F.transform(F.filter(_runs(F.lower("path")), lambda x: ~x.isin(own)), lambda x: F.struct(F.lit("p").alias("kind"), x.alias("run")))
    runs = urls.select("id", F.posexplode(F.concat(host, path)).alias("pos", "x")).select("id", "x.*", F.pmod(F.xxhash64("id", "pos"), F.lit(SALTS)).cast("int").alias("salt"))
    runs = cut(runs)
    letters = segmented(runs.filter(F.col("run").rlike("^[a-z]")).select("run").distinct(), docs, seeds)
    rows = _salted(runs, letters, "run")
    words = F.transform(F.coalesce("words", F.array(F.lit("#"))), lambda w: F.concat("kind", F.lit(":"), w))
    told = F.when((F.col("kind") == "h") & F.col("known").isNotNull(), F.array(F.when(F.col("known"), KNOWN).otherwise(NEW))).otherwise(F.array().cast("array<string>"))
    return rows.select("id", F.posexplode(F.concat(words, told)).alias("pos", "token")).select("id", "token", F.pmod(F.xxhash64("id", "pos", "token"), F.lit(SALTS)).cast("int").alias("salt"))


def _scores(of: DataFrame, learn: DataFrame, ids: DataFrame, smoothing: float) -> DataFrame | None:
    """(id, score): log odds of ``block`` for ``ids(id)``, by multinomial naive Bayes from ``learn(id, p)``, ``p`` the
    probability that an example is blocked; None without any weight on blocked ones.  Only sums reach the driver."""
    n_b, n_a = learn.agg(F.sum("p"), F.sum(1 - F.col("p"))).first()
    if not n_b:
        return None
    counts = cut(of.join(learn, "id").groupBy("token").agg(F.sum("p").alias("b"), F.sum(1 - F.col("p")).alias("a")))
    size, b, a = counts.agg(F.count("*"), F.sum("b"), F.sum("a")).first()
    logs = [F.log((F.col(c) + smoothing) / (total + smoothing * size)) for c, total in (("b", b or 0), ("a", a or 0))]
    sums = _salted(of.join(ids, "id", "left_semi"), counts.select("token", (logs[0] - logs[1]).alias("odds")), "token").groupBy("id").agg(F.sum("odds").alias("sum"))
    return ids.join(sums, "id", "left").select("id", (math.log((n_b + smoothing) / (n_a + smoothing)) + F.coalesce("sum", F.lit(0.0))).alias("score"))


def judge_urls(pages: DataFrame, docs: DataFrame, rules: Sequence[tuple[str, str]], seeds: Sequence[str] = SEEDS, labelled: DataFrame | None = None, stop_labels: Sequence[str] = STOP_LABELS, smoothing: float = 1.0, rounds: int = 3) -> DataFrame:
    """One row per page of ``pages(page_id, url)``: page_id, host, path, rule, verdict, score (log odds of ``block``).

    ``labelled(url, label)``: examples to learn from, ``block`` or ``allow``, in place of the pages' own.  ``rounds`` of
    learning from the URLs without a label; with a user's examples there are none.
    """
    host, path = host_path(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long"), host.alias("host"), path.alias("path"), F.lit(None).cast("string").alias("given"))
    if labelled is not None:
        rows = rows.unionByName(labelled.select(F.lit(None).cast("long").alias("page_id"), host.alias("host"), path.alias("path"), F.col("label").alias("given")).filter("given is not null"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = cut(rows.select("*", rule.cast("string").alias("rule"), verdict.cast("string").alias("verdict"), F.monotonically_increasing_id().alias("id")))
    of = cut(tokens(rows, docs, rules, seeds, stop_labels))

    label, free = F.col("given"), F.lit(False)
    if labelled is None:
        seed = F.col("token").isin([f"{k}:{s}" for s in seeds for k in "hp"])
        marks = of.filter(seed | (F.col("token") == KNOWN)).groupBy("id").agg(F.max(seed).alias("seeded"), F.max(F.col("token") == KNOWN).alias("named"))
        rows = cut(rows.join(marks, "id", "left"))
        worded = F.col("rule").isin([text for text, _ in rules if set(text.partition("/")[0].split(".")) - set(stop_labels)])
        label = F.when(F.col("rule").isNull(), F.when(F.col("seeded"), "block").when(F.col("named"), "allow")).when(worded, F.col("verdict")).when(F.col("seeded") & (F.col("verdict") == "block"), "block")
        free = F.col("rule").isNull() & label.isNull()
    known = rows.select("id", F.when(label == "block", 1.0).when(label == "allow", 0.0).alias("p")).filter("p is not null")
    unknown, learn = cut(rows.filter(free).select("id")), known
    if not unknown.isEmpty():
        for _ in range(rounds):
            found = _scores(of, learn, unknown, smoothing)
            if found is None:
                break
            learn = known.union(cut(found.select("id", (1 / (1 + F.exp(-F.col("score")))).alias("p"))))
    found = _scores(of, learn, rows.filter("given is null").select("id"), smoothing)
    rows = rows.filter("given is null")
    rows = rows.withColumn("score", F.lit(-1.0)) if found is None else rows.join(found, "id")
    says = F.coalesce("verdict", F.when(F.col("score") > 0, "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", "rule", says.alias("verdict"), "score")
