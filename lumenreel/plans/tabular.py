"""Keyed-table operators: reconciliation, deletes, upserts, duplicates, set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenreel.functions import scores as S
from lumenreel.functions.text import SEASONS
from lumenreel.operators import segments as G
from lumenreel.operators import tables as T
from lumenreel.plans import query
from lumenreel.plans.common import table
from lumenreel.streaming import incremental


@query("reconcile_keys", "SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN d.doc_id IS NULL THEN 'missing_in_a' ELSE 'missing_in_b' END AS side FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id WHERE d.doc_id IS NULL OR l.doc_id IS NULL")
def reconcile_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.reconcile(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@query("disagreements", "SELECT o_orderkey, o_orderstatus AS value_a, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN 'X' END AS value_b FROM orders WHERE o_orderkey % 7 = 0 OR (o_orderkey % 5 = 0 AND o_orderstatus <> 'X')")
def disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    other = o.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 7 == 0, F.lit(None)).when(F.col("o_orderkey") % 5 == 0, "X").otherwise(F.col("o_orderstatus")))
    return T.disagreements(o, other, "o_orderkey", "o_orderstatus")


@query("stale_delete", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def stale_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").filter("c_acctbal > 0").withColumnRenamed("c_custkey", "o_custkey")
    return T.only(table(spark, sf_dir, "orders"), c, "o_custkey").select("o_orderkey", "o_custkey")


@query("cascade_delete", "WITH c AS (SELECT c_custkey FROM customer WHERE c_nationkey < 20), o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (FROM c)) SELECT 'customer' AS \"table\", count(*) AS rows FROM c UNION ALL SELECT 'orders', count(*) FROM o UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey IN (FROM o)")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {
        "customer": table(spark, sf_dir, "customer").filter("c_nationkey < 20").select(F.col("c_custkey").alias("cust")),
        "orders": table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("cust"), F.col("o_orderkey").alias("ord")),
        "lineitem": table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("ord")),
    }
    return T.cardinalities(T.cascade(tables, [("orders", "customer", "cust"), ("lineitem", "orders", "ord")]))


@query("null_lost_keys", "SELECT s_suppkey, CASE WHEN s_nationkey < 12 THEN s_nationkey END AS s_nationkey FROM supplier")
def null_lost_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").filter("n_nationkey < 12").withColumnRenamed("n_nationkey", "s_nationkey")
    return T.null_lost(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), n, "s_nationkey")


@query("missing_assets", "SELECT 'missing' AS kind, doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT page_id FROM pages) UNION ALL SELECT 'unreferenced', page_id FROM pages WHERE page_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0)")
def missing_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = lambda c: F.concat(F.lit("keyframes/"), F.col(c), F.lit(".jpg")).alias("path")
    items = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), path("doc_id"))
    files = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), path("page_id"))
    missing = T.without(items, files, "path").select(F.lit("missing").alias("kind"), "id")
    return missing.unionByName(T.without(files, items.filter("id % 3 <> 0"), "path").select(F.lit("unreferenced").alias("kind"), "id"))


@query("place_enrichment", "SELECT s_suppkey AS segment_id, CASE WHEN s_nationkey < 20 THEN 1000 + s_nationkey END AS spot_id FROM supplier")
def place_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    spots = table(spark, sf_dir, "nation").filter("n_nationkey < 20").select(F.concat(F.lit("P"), "n_nationkey").alias("place_id"), (F.col("n_nationkey") + 1000).alias("spot_id"))
    segments = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("segment_id"), F.concat(F.lit("P"), "s_nationkey").alias("place_id"))
    return G.with_places(segments, spots).select("segment_id", "spot_id")


@query("resume_pending", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'")
def resume_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    done = o.select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "completed").otherwise("failed").alias("status"))
    return incremental.pending(o.select("o_orderkey"), done, "o_orderkey")


@query("incremental_run", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'old' ELSE 'new' END AS run, CASE WHEN o_orderstatus = 'F' OR o_totalprice < 400000 THEN 'completed' ELSE 'failed' END AS status FROM orders")
def incremental_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    before = o.filter("o_orderstatus <> 'P'").select("o_orderkey", F.lit("old").alias("run"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("failed").alias("status"))
    work = lambda x: x.select("o_orderkey", F.lit("new").alias("run"), F.when(F.col("o_totalprice") < 400000, "completed").otherwise("failed").alias("status"))
    return incremental.run_batch(o.select("o_orderkey", "o_totalprice"), before, "o_orderkey", work)


@query("duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS count FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.duplicate_keys(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@query("validation_total", "SELECT (SELECT count(*) FROM lineitem WHERE l_quantity > 40) + (SELECT count(*) FROM lineitem WHERE l_discount > 0.05) + (SELECT count(*) FROM (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) > 1)) AS errors")
def validation_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    report = T.error_report(li, "l_orderkey", T.errors_of([(F.col("l_quantity") <= 40, "quantity"), (F.col("l_discount") <= 0.05, "discount")]))
    return T.error_total(report, T.duplicate_keys(li, "l_orderkey"))


@query("table_cardinalities", "SELECT 'orders' AS \"table\", count(*) AS rows FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'pages', count(*) FROM pages")
def table_cardinalities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.cardinalities({n: table(spark, sf_dir, n) for n in ("orders", "lineitem", "customer", "events", "pages")})


@query("distinct_places", "SELECT lang, count(DISTINCT source) AS places, count(*) AS items FROM documents GROUP BY lang")
def distinct_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.countDistinct("source").alias("places"), F.count("*").alias("items"))


_OLD = "old AS (SELECT o_orderkey, o_orderstatus, o_totalprice, 'first' AS created_at FROM orders WHERE o_orderkey % 3 <> 0)"
_NEW = "new AS (SELECT o_orderkey, 'N' AS o_orderstatus, o_totalprice + 1 AS o_totalprice, 'second' AS created_at FROM orders WHERE o_orderkey % 2 = 0)"


@query("keyed_upsert", f"WITH {_OLD}, {_NEW} SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, coalesce(n.o_orderstatus, o.o_orderstatus) AS o_orderstatus, coalesce(o.o_totalprice, n.o_totalprice) AS o_totalprice, coalesce(o.created_at, n.created_at) AS created_at FROM old o FULL JOIN new n ON o.o_orderkey = n.o_orderkey")
def keyed_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    old = o.filter("o_orderkey % 3 <> 0").select("o_orderkey", "o_orderstatus", "o_totalprice", F.lit("first").alias("created_at"))
    new = o.filter("o_orderkey % 2 = 0").select("o_orderkey", F.lit("N").alias("o_orderstatus"), (F.col("o_totalprice") + 1).alias("o_totalprice"), F.lit("second").alias("created_at"))
    return T.upsert(old, new, "o_orderkey", ["o_orderstatus"])


@query("forced_replace", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'new' ELSE 'old' END AS run, CASE WHEN o_orderkey % 4 = 0 THEN o_orderpriority END AS note FROM orders")
def forced_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return T.replace_keys(o.select("o_orderkey", F.lit("old").alias("run")), o.filter("o_orderkey % 4 = 0").select("o_orderkey", F.lit("new").alias("run"), F.col("o_orderpriority").alias("note")), "o_orderkey")


@query("appended_results", "SELECT n_name AS name, n_regionkey::BIGINT AS n_regionkey FROM nation UNION ALL SELECT r_name, NULL FROM region")
def appended_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.append(table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").cast("long")), table(spark, sf_dir, "region").select(F.col("r_name").alias("name")))


@query("schema_evolution", "SELECT c_custkey, c_mktsegment, NULL::VARCHAR AS region, NULL::DOUBLE AS latitude FROM customer")
def schema_evolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.evolved(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), {"c_mktsegment": "string", "region": "string", "latitude": "double"})


@query("key_differences", "SELECT 'only_orders' AS side, k FROM (SELECT o_custkey AS k FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) UNION ALL SELECT 'only_customers', k FROM (SELECT c_custkey AS k FROM customer WHERE c_custkey % 2 = 0 EXCEPT SELECT o_custkey FROM orders)")
def key_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))
    b = table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"))
    return a.subtract(b).select(F.lit("only_orders").alias("side"), "k").union(b.subtract(a).select(F.lit("only_customers").alias("side"), "k"))


@query("season_sets", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '봄' WHEN 1 THEN '여름,겨울' ELSE '' END AS inside, CASE doc_id % 3 WHEN 0 THEN '여름,가을,겨울' WHEN 1 THEN '봄,가을' ELSE '봄,여름,가을,겨울' END AS outside FROM documents")
def season_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("doc_id") % 3
    expected = F.when(m == 0, F.array(F.lit(SEASONS[0]), F.lit("spring"))).when(m == 1, F.array(F.lit(SEASONS[1]), F.lit(SEASONS[3]))).otherwise(F.array().cast("array<string>"))
    inside, outside = S.season_sets(expected)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(inside, ",").alias("inside"), F.array_join(outside, ",").alias("outside"))


@query("status_routing", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'needs_time_fix' ELSE 'processed' END AS status, CASE WHEN o_orderstatus <> 'P' THEN round(o_totalprice, 2) END AS result FROM orders")
def status_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    skip = o.filter("o_orderstatus = 'P'").select("o_orderkey", F.lit("needs_time_fix").alias("status"))
    return T.append(o.filter("o_orderstatus <> 'P'").select("o_orderkey", F.lit("processed").alias("status"), F.round("o_totalprice", 2).alias("result")), skip)


@query("packed_items", "SELECT l_orderkey, '[' || string_agg('{\"l_linenumber\":' || l_linenumber || ',\"l_partkey\":' || l_partkey || '}', ',' ORDER BY l_linenumber, l_partkey) || ']' AS items FROM lineitem WHERE l_orderkey IS NOT NULL GROUP BY l_orderkey")
def packed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = T.grouped_items(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", ["l_partkey"])
    return g.select("l_orderkey", F.to_json("items").alias("items"))


@query("run_stamp", "SELECT count(*) AS rows, true AS stamped FROM region")
def run_stamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "region").withColumn("created_at", F.current_timestamp()).withColumn("generated_at", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ssXXX"))
    return r.agg(F.count("*").alias("rows"), F.bool_and(F.col("generated_at").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(Z|[+-]\d\d:\d\d)$") & F.col("created_at").isNotNull()).alias("stamped"))


@query("first_records", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' AND o_orderkey % 10 <> 0 ORDER BY o_orderkey LIMIT 25")
def first_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenreel.sources.io import read_manifest

    o = table(spark, sf_dir, "orders").withColumn("youtube_id", F.when(F.col("o_orderkey") % 10 == 0, " ").otherwise(F.concat(F.lit("y"), "o_orderkey")))
    return read_manifest(o, True, {"o_orderstatus": "F", "o_orderpriority": "1-URGENT"}, 25, "o_orderkey").select("o_orderkey", "o_orderpriority")
