"""The registered queries of the corpus operators, with production parameters over whole tables.

No query has a filter on ids, a prefix or a row cap.  ``oracle_sql`` has those whose result SQL can express.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenreel.llm import fim, merkle, pii, vector_codes
from lumenreel.llm.common import cut, n_words, table
from lumenreel.llm.exact_dedup import exact_duplicates
from lumenreel.llm.jaccard_join import near_duplicates
from lumenreel.llm.language_id import predict_language
from lumenreel.llm.line_dedup import remove_boilerplate
from lumenreel.llm.mixing import mix
from lumenreel.llm.packing import WordEncoder, pack
from lumenreel.llm.quality import judge
from lumenreel.llm.toxicity import score_toxicity
from lumenreel.llm.url_filter import judge_urls

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


@functools.cache
def word_tokenizer() -> WordEncoder:
    """One per Python worker, whose later tasks find its words known."""
    import public_tokenizers

    return WordEncoder(public_tokenizers.path("word_bpe_49k.json"))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict_language(table(spark, sf_dir, "documents"))


def op2_warc_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as WARC records, and a second replica of them with rotten and lost records, which the audit has to locate.

    The replica is derived by a rule that the oracle repeats: the last byte of some records is changed, others are gone.
    """
    rotten, lost = F.col("page_id") % 97 == 13, F.col("page_id") % 389 == 7
    other = F.when(rotten, F.concat(F.expr("substring(body, 1, length(body) - 1)"), F.lit("?"))).otherwise(F.col("body"))
    rows = merkle.warc_bodies(table(spark, sf_dir, "pages"))
    rows = rows.select("page_id", "file", F.octet_length("body").alias("length"), merkle.digest(F.col("body")).alias("a"), merkle.digest(other).alias("b"), lost.alias("lost"))
    rows = cut(merkle.with_offsets(rows, "page_id"))
    a, b = rows.select("file", "offset", F.col("a").alias("hash")), rows.filter("not lost").select("file", "offset", F.col("b").alias("hash"))
    return merkle.audit(a, b, span=1 << 16, fanout=8, hash_column="hash")


OP2_SQL = """
WITH r AS (
  SELECT page_id, page_id // 500 AS file,
    'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '')
    || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10) || 'Content-Length: '
    || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS body
  FROM pages),
o AS (SELECT *, CAST(coalesce(sum(strlen(body)) OVER (PARTITION BY file ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM r)
SELECT file, "offset", CASE WHEN page_id % 389 = 7 THEN 'missing_in_b' ELSE 'differs' END AS status, sha256(body) AS hash_a,
  CASE WHEN page_id % 389 = 7 THEN NULL ELSE sha256(left(body, length(body) - 1) || '?') END AS hash_b
FROM o WHERE page_id % 97 = 13 OR page_id % 389 = 7
"""


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=90)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"), RULES)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), percent=150, max_epochs=2)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = remove_boilerplate(table(spark, sf_dir, "documents"), min_sites=8, min_words=3)
    return rows.select("row.doc_id", "n_lines", "n_removed", n_words(F.col("text")).alias("kept_words"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


OP6_SQL = r"""
WITH l AS (
  SELECT doc_id, text AS whole, coalesce('=' || source, '') AS site, unnest(string_split(text, chr(10))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents),
n AS (SELECT *, trim(regexp_replace(line, '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ') AS norm FROM l),
f AS (SELECT doc_id, whole, site, pos, norm, length(norm) - length(replace(norm, ' ', '')) + 1 AS words FROM n WHERE norm <> ''),
p AS (
  SELECT *, lead(norm) OVER w AS norm2, lead(pos) OVER w AS pos2, lead(words) OVER w AS words2, lead(norm, 2) OVER w AS norm3, lead(pos, 2) OVER w AS pos3, lead(words, 2) OVER w AS words3,
    lag(norm) OVER w AS norm0, lag(pos) OVER w AS pos0, lag(words) OVER w AS words0, lag(norm, 2) OVER w AS norm00, lag(pos, 2) OVER w AS pos00, lag(words, 2) OVER w AS words00
  FROM f WINDOW w AS (PARTITION BY doc_id, whole, site ORDER BY pos)),
u AS (
  SELECT doc_id, whole, site, pos, [pos] AS places, norm AS unit FROM p WHERE words >= 3
  UNION ALL SELECT doc_id, whole, site, pos, [CASE WHEN words < 3 THEN pos END, CASE WHEN words2 < 3 THEN pos2 END], norm || chr(10) || norm2
  FROM p WHERE (words < 3 OR words2 < 3) AND words + words2 >= 3
  UNION ALL SELECT doc_id, whole, site, pos, [pos, pos2, CASE WHEN words3 < 3 THEN pos3 END], norm || chr(10) || norm2 || chr(10) || norm3
  FROM p WHERE words + words2 < 3 AND norm3 IS NOT NULL
  UNION ALL SELECT doc_id, whole, site, pos, [pos], norm || chr(10) FROM p WHERE norm2 IS NULL AND words < 3 AND norm0 IS NULL
  UNION ALL SELECT doc_id, whole, site, pos0, [CASE WHEN words0 < 3 THEN pos0 END, pos], norm0 || chr(10) || norm FROM p WHERE norm2 IS NULL AND words < 3 AND words0 + words >= 3
  UNION ALL SELECT doc_id, whole, site, pos0, [pos0, pos], norm0 || chr(10) || norm || chr(10) FROM p WHERE norm2 IS NULL AND words0 + words < 3 AND norm00 IS NULL
  UNION ALL SELECT doc_id, whole, site, pos00, [CASE WHEN words00 < 3 THEN pos00 END, pos0, pos], norm00 || chr(10) || norm0 || chr(10) || norm
  FROM p WHERE norm2 IS NULL AND words0 + words < 3 AND norm00 IS NOT NULL),
c AS (SELECT unit, min({'d': doc_id, 'p': pos}) AS first FROM u GROUP BY unit HAVING count(DISTINCT site) >= 8),
g AS (SELECT DISTINCT u.doc_id, u.whole, unnest(places) AS pos FROM u JOIN c USING (unit) WHERE {'d': u.doc_id, 'p': u.pos} > c.first),
k AS (SELECT l.doc_id, l.whole, l.pos, line, g.pos IS NOT NULL AS gone FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.whole = g.whole AND l.pos = g.pos),
d AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
    coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text
  FROM k GROUP BY doc_id, whole)
SELECT doc_id, n_lines, n_removed, CAST(len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')) AS BIGINT) AS kept_words, md5(text) AS text_md5 FROM d
UNION ALL SELECT doc_id, 0, 0, 0, NULL FROM documents WHERE text IS NULL
"""


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").drop("loss_tokens"), word_tokenizer, max_tokens=2048, max_segments=256, max_loss_tokens=2048, end=1)


#: Limits of an instruction sequence: tokens, turns, and tokens that bear loss.
INSTRUCTION_LIMITS = (2048, 12, 900)


def instruction_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns of all conversations, of which assistants' bear loss, under three limits at once; pieces name conversation and turn."""
    turns = table(spark, sf_dir, "conversations")
    place = F.col("conv_id").cast("long") * 65_536 + F.col("turn")
    loss = F.when(F.col("role") == "assistant", F.lit((1 << 31) - 1)).otherwise(0)
    tokens, segments, bearing = INSTRUCTION_LIMITS
    rows = pack(turns.select(place.alias("doc_id"), "text", loss.alias("loss_tokens")), word_tokenizer, max_tokens=tokens, max_segments=segments, max_loss_tokens=bearing, end=1)
    return rows.select(F.shiftright("doc_id", 16).alias("conv_id"), F.col("doc_id").bitwiseAND(F.lit(65_535)).alias("turn"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]+', ' ', 'g') AS norm FROM documents),
w AS (SELECT doc_id, norm, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM w
"""


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = cut(fim.store(table(spark, sf_dir, "documents")))
    return fim.digests(fim.examples(stored, seed=42, rate=50, spm=80))


OP11_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[ \t\n\x0B\f\r]*[^ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+') AS u,
    sha256('42:' || doc_id) AS d
  FROM documents),
h AS (SELECT *, len(u) AS n, ('0x' || d[1:8])::UBIGINT AS h1, ('0x' || d[9:16])::UBIGINT AS h2, ('0x' || d[17:24])::UBIGINT AS h3, ('0x' || d[25:32])::UBIGINT AS h4 FROM t),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1))::BIGINT AS a, greatest(h1 % (n + 1), h2 % (n + 1))::BIGINT AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM h),
p AS (SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:n], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pii.find(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["score"].isNull())
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.select("doc_id", *map(count, pii.KINDS), F.sha2(told(base).cast("binary"), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.encode(table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2)


_NEAREST = "(SELECT x.vec_id, x.part, min({{'d': (x.x0 - c.x0) * (x.x0 - c.x0) + (x.x1 - c.x1) * (x.x1 - c.x1) + (x.x2 - c.x2) * (x.x2 - c.x2) + (x.x3 - c.x3) * (x.x3 - c.x3), 'k': c.k}}) AS m FROM x JOIN {c} c USING (part) GROUP BY ALL)"
_MOVED = """(SELECT c.part, c.k, coalesce(m.x0, c.x0) AS x0, coalesce(m.x1, c.x1) AS x1, coalesce(m.x2, c.x2) AS x2, coalesce(m.x3, c.x3) AS x3
  FROM {c} c LEFT JOIN (SELECT a.part, a.m.k AS k, floor(sum(x0)::DOUBLE / count(*))::BIGINT AS x0, floor(sum(x1)::DOUBLE / count(*))::BIGINT AS x1,
    floor(sum(x2)::DOUBLE / count(*))::BIGINT AS x2, floor(sum(x3)::DOUBLE / count(*))::BIGINT AS x3 FROM {a} a JOIN x USING (vec_id, part) GROUP BY ALL) m USING (part, k))"""
OP13_SQL = f"""
WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT vec_id, part, v[4 * part + 1] AS x0, v[4 * part + 2] AS x1, v[4 * part + 3] AS x2, v[4 * part + 4] AS x3 FROM e, range(16) t(part)),
c0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS k, x0, x1, x2, x3 FROM x WHERE vec_id IN (SELECT vec_id FROM e ORDER BY vec_id LIMIT 64)),
a0 AS MATERIALIZED {_NEAREST.format(c='c0')}, c1 AS MATERIALIZED {_MOVED.format(c='c0', a='a0')},
a1 AS MATERIALIZED {_NEAREST.format(c='c1')}, c2 AS MATERIALIZED {_MOVED.format(c='c1', a='a1')},
a2 AS MATERIALIZED {_NEAREST.format(c='c2')},
r AS (SELECT vec_id, string_agg(printf('%02x', m.k), '' ORDER BY part) AS code, sum(m.d)::BIGINT AS error FROM a2 GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(x0 || ',' || x1 || ',' || x2 || ',' || x3, ',' ORDER BY part, k)) FROM c2) AS codebooks_sha256
FROM r JOIN e USING (vec_id)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    all_ = (op1_language_id, op2_warc_merkle_audit, op3_ngram_jaccard_join, op4_url_filter, op5_mixing, op6_line_dedup, op7_packing, op8_quality_rules, op9_exact_dedup, op10_toxicity, op11_fill_in_middle, op12_personal_data, op13_vector_codes, instruction_packing)
    return {f.__name__: f for f in all_}


def oracle_sql() -> dict[str, str]:
    return {"op2_warc_merkle_audit": OP2_SQL, "op6_line_dedup": OP6_SQL, "op9_exact_dedup": OP9_SQL, "op11_fill_in_middle": OP11_SQL, "op13_vector_codes": OP13_SQL}
