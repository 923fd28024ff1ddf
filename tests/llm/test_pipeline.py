"""The pipeline's stages: schemas, decisions and whole results against brute-force versions."""

import collections
import random
import re

from pyspark.sql import functions as F

import corpus_pipeline as P
from lumenreel.llm.jaccard_join import near_duplicates
from lumenreel.llm.line_dedup import remove_boilerplate
from lumenreel.llm.mixing import mix
from lumenreel.llm.quality import group_of, judge
from lumenreel.llm.queries import word_tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus(spark):
    r = random.Random(1)
    text = lambda n: "\n".join(" ".join(f"w{r.randrange(5000)}" for _ in range(12)) for _ in range(n))
    rows, base = [], [text(9) for _ in range(40)]
    for i in range(40):
        rows.append((base[i] + ("\nshared boilerplate of every site" if i % 2 else ""), f"s{i % 11}"))
    rows += [(base[3].replace("w1", "w2", 1), "s1"), (base[4], "s2"), (base[5], None)]
    rows += [("junk### %%% &&& ***$$$ " * 30 + text(1), "s1"), ("short text", "s2"), (None, "s3"), ("", "s3"), ("same line again and again\n" * 60, "s4")]
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, (t, s) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")


def test_stages(spark, tmp_path):
    docs, before = corpus(spark), None
    for k, (name, stage) in enumerate(P.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        was, now = before.collect(), docs.collect()
        assert now
        if k < 4:
            assert docs.columns == COLUMNS and docs.schema == before.schema
        if name == "quality_rules":
            kept = {x.doc_id for x in judge(before).collect() if x.kept}
            assert {x.doc_id for x in now} == kept and kept >= set(range(43)) and not kept & {44, 45, 46, 47}
        elif name == "line_dedup":
            text = {x.row.doc_id: x.text for x in remove_boilerplate(before).collect()}
            assert {x.doc_id: x.text for x in now} == {i: t for i, t in text.items() if WORD.search(t)}
            assert sum("boilerplate" in x.text for x in now) == 1 and all(x.n_chars == len(x.text) for x in now)
        elif name == "ngram_jaccard_join":
            comp = {x.doc_id: x.component_id for x in near_duplicates(before, 5, 80).collect()}
            assert {x.doc_id for x in now} == set(comp.values()) and len(now) == len(set(comp.values())) < len(was)
        elif name == "mixing":
            taken = {x.doc_id: x.taken for x in mix(before).collect()}
            words = collections.Counter()
            for x in now:
                words[x.doc_id] += len(WORD.findall(x.text))
            assert words == {i: n for i, n in taken.items() if n}
            whole = {x.doc_id: x.text for x in was}
            for x in now:
                assert WORD.findall(x.text) == WORD.findall(whole[x.doc_id])[: len(WORD.findall(x.text))]
        else:
            ids = collections.Counter()
            for x, e in zip(was, word_tokenizer()([x.text for x in was], 1), strict=True):
                ids[x.doc_id] += len(e)
            got = collections.Counter()
            for x in now:
                got[x.doc_id] += x.length
            assert got == ids


def test_line_dedup_keeps_short_bodies(spark):
    """A body of its own below a long shared template stays, however small its share; documents without any go."""
    template = "\n".join(f"line {i} of a long template that every site has" for i in range(40))
    rows = [(i, template + (f"\nown body {i} stands nowhere else" if i < 6 else " \n"), "en", f"s{i}", 0) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {x.doc_id: x.text for x in P.line_dedup(spark, docs, "").collect()}
    assert got == {0: rows[0][1]} | {i: f"own body {i} stands nowhere else" for i in range(1, 6)}


def test_quality_rules_judge_each_source(spark):
    """Equal rows but for their source are judged, and kept or dropped, each in its own group."""
    docs = corpus(spark)
    twin = docs.filter("doc_id = 7").withColumn("source", F.lit("elsewhere"))
    both = docs.union(twin)
    want = sorted((x.doc_id, x.grp) for x in judge(both).collect() if x.kept)
    got = P.quality_rules(spark, both, "").select("doc_id", group_of().alias("grp"))
    assert sorted(map(tuple, got.collect())) == want and sum(i == 7 for i, _ in want) >= 1


def test_line_dedup_of_repeated_ids(spark):
    """Two texts under one id lose nothing of each other in the stage either."""
    rows = [(i, f"a line that every site has\nbody {i} of its own", "en", f"s{i}", 0) for i in range(12)]
    rows += [(20, "own start here\na line that every site has", "en", "s1", 0), (20, "the only copy of an important sentence\nsecond line of that other text", "en", "s2", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {(x.doc_id, x.text) for x in P.line_dedup(spark, docs, "").collect()}
    assert got == {(0, rows[0][1])} | {(i, f"body {i} of its own") for i in range(1, 12)} | {(20, "own start here"), (20, rows[-1][1])}


def test_near_duplicates_of_repeated_ids(spark):
    """Different texts under one id all stay; equal ones under one id, and near copies of others, go."""
    r = random.Random(4)
    a, b, c = (" ".join(f"w{r.randrange(9999)}" for _ in range(60)) for _ in range(3))
    rows = [(1, a, "x"), (1, b, "x"), (1, b, "y"), (2, a + " more", "x"), (3, c, "x"), (None, c, "x"), (None, "short", "x"), (None, None, "x")]
    docs = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((x.doc_id, x.text) for x in P.ngram_jaccard_join(spark, docs, "").collect()), key=str)
    assert got == sorted([(1, a), (1, b), (3, c), (None, "short"), (None, None)], key=str)


def test_run(spark, tmp_path):
    corpus(spark).write.parquet(f"{tmp_path}/documents.parquet")
    pieces = P.run(spark, str(tmp_path)).agg(F.sum("length"), F.count("*")).first()
    assert pieces[0] > 0 and pieces[1] > 0


def test_odd_tables(spark, tmp_path):
    """Nulls in every column, repeated rows, extra columns with clashing names, and an empty table go through all stages."""
    text = " ".join(f"v{i}" for i in range(80))
    rows = [(None, None, None, None, None, 1, "g"), (None, text, None, None, None, 1, "g"), (1, text, "en", "s", 5, 2, "h"), (1, text, "en", "s", 5, 2, "h"), (2, "x " * 100_000, "en", "s", 5, 3, "i")]
    rows = [(*x, {"k": i}) for i, x in enumerate(rows)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _n_lines int, row string, m map<string,int>"
    for n, data in enumerate((rows, [])):
        docs = spark.createDataFrame(data, schema)
        for name, stage in P.STAGES:
            stage(spark, docs, "").write.parquet(f"{tmp_path}/{n}-{name}")
            docs = spark.read.parquet(f"{tmp_path}/{n}-{name}")
            if name != "packing":
                assert docs.columns == [c.split(" ")[0] for c in schema.split(", ")]
        assert (docs.count() > 0) == bool(data)
