"""Queries of links over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from statewake.functions import scores
from statewake.operators import graph, links
from statewake.plans.machine import initial_states, table, transitions
from statewake.plans.registry import _WALK, query


@query("SELECT o_orderkey, CASE WHEN EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey + 100) THEN 'c' || (o_custkey + 100) || '@v1' END AS resolved FROM orders")
def claim_references(spark, d):
    refs = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("ns::c"), (F.col("o_custkey") + 100).cast("string"), F.lit("@old")).alias("ref"))
    current = table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit("@v1")).alias("claim"))
    return links.resolve_claims(refs, current, "ref", "claim").select("o_orderkey", "resolved")


@query("WITH c AS (SELECT l_partkey, l_suppkey, count(*)::BIGINT AS strength FROM lineitem GROUP BY 1, 2), m AS (SELECT l_partkey, max(strength) AS strength FROM c GROUP BY 1) SELECT l_partkey, min(l_suppkey) AS l_suppkey, strength, count(*) > 1 AS ambiguous FROM c JOIN m USING (l_partkey, strength) GROUP BY l_partkey, strength")
def candidate_ambiguity(spark, d):
    c = table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("strength"))
    return links.best_candidates(c, "l_partkey", "l_suppkey", "strength")


@query("WITH k AS (SELECT DISTINCT o_custkey AS p FROM orders), f AS (SELECT p_partkey, pos, p_partkey - pos * 7 AS p FROM part, (VALUES (0), (1), (2)) v(pos)), h AS (SELECT p_partkey, min(pos) AS pos FROM f WHERE p IN (SELECT p FROM k) GROUP BY 1) SELECT part.p_partkey, part.p_partkey - h.pos * 7 AS p, h.pos::INT AS pos FROM part LEFT JOIN h ON h.p_partkey = part.p_partkey")
def first_form_wins(spark, d):
    known = table(spark, d, "orders").select(F.col("o_custkey").alias("p"))
    return links.first_form(table(spark, d, "part"), [F.col("p_partkey") - i * 7 for i in range(3)], known, "p_partkey", "p")


@query("SELECT coalesce(l.k, r.k) AS k, CASE WHEN l.k IS NULL THEN 'right-only' WHEN r.k IS NULL THEN 'left-only' ELSE 'both' END AS presence FROM (SELECT doc_id AS k FROM documents) l FULL JOIN (SELECT DISTINCT o_custkey AS k FROM orders) r ON l.k = r.k")
def keyed_union(spark, d):
    return links.keyed_union(table(spark, d, "documents").withColumnRenamed("doc_id", "k"), table(spark, d, "orders").withColumnRenamed("o_custkey", "k"), "k")


_LINKS = "ln AS (SELECT DISTINCT l_suppkey AS ui_id, l_partkey * 3 // 2 + CASE WHEN l_linenumber = 7 THEN 1000000 ELSE 0 END AS api_id, l_linestatus = 'F' AS confirmed FROM lineitem)"


def _links(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("ui_id"), (F.expr("l_partkey * 3 div 2") + F.when(F.col("l_linenumber") == 7, 1000000).otherwise(0)).alias("api_id"), (F.col("l_linestatus") == "F").alias("confirmed")).distinct()


@query(f"WITH {_LINKS} SELECT 'api-only' AS kind, p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT api_id FROM ln) UNION ALL SELECT DISTINCT 'dangling', api_id FROM ln WHERE ui_id IN (SELECT s_suppkey FROM supplier) AND api_id NOT IN (SELECT p_partkey FROM part)")
def divergence(spark, d):
    return links.divergence(table(spark, d, "part").withColumnRenamed("p_partkey", "id"), table(spark, d, "supplier").withColumnRenamed("s_suppkey", "id"), _links(spark, d))


@query(f"WITH {_LINKS}, cv AS (SELECT c_custkey AS id FROM customer) SELECT api_id, min(ui_id) AS through FROM ln WHERE confirmed AND ui_id IN (SELECT id FROM cv) AND api_id NOT IN (SELECT id FROM cv) GROUP BY 1")
def indirect_credit(spark, d):
    return links.indirect_credit(table(spark, d, "customer").withColumnRenamed("c_custkey", "id"), _links(spark, d))


@query("SELECT o_orderkey, (SELECT count(*) FROM orders) > 100 AS truncated FROM (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100)")
def row_cap(spark, d):
    return links.capped(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"], 100).select("o_orderkey", "truncated")


@query("SELECT url, CASE WHEN r = '' THEN '/' ELSE r END AS resource, sha256(url)[1:12] AS short_id FROM (SELECT url, regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', '') || '/{id}', '/\\{.*$', ''), '/+$', '') AS r FROM pages)")
def route_resource(spark, d):
    route = F.concat(F.regexp_replace("url", "^[a-z]+://[^/]*", ""), F.lit("/{id}"))
    return table(spark, d, "pages").select("url", scores.resource_of(route).alias("resource"), scores.content_id(F.col("url"), 12).alias("short_id"))


@query(f"{_WALK} SELECT depth AS setup_length, count(*)::BIGINT AS cases, count(DISTINCT model_id)::BIGINT AS models FROM dep WHERE depth >= 1 GROUP BY 1")
def setup_histogram(spark, d):
    paths = graph.setup_paths(transitions(spark, d).where("status = 'implemented'"), initial_states(spark, d)).where("depth > 0")
    return paths.groupBy(F.col("depth").alias("setup_length")).agg(F.count("*").alias("cases"), F.count_distinct("model_id").alias("models"))
