"""Queries of the read tools and reports over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from statewake.operators import coverage, generate, reports, surfaces, validation
from statewake.plans import registry
from statewake.plans.machine import SQL as M
from statewake.plans.machine import initial_states, table, transitions
from statewake.plans.model_plans import _GWALK, _OUT, GM, _setups, guarded
from statewake.plans.registry import _LEDGER, _ledger, query


@query("SELECT DISTINCT p_type AS journey, p_brand AS surface FROM part UNION SELECT DISTINCT 'all', p_brand FROM part")
def available_models(spark, d):
    return reports.available(table(spark, d, "part").select(F.array("p_type", F.lit("all"), F.lit(None)).alias("areas"), F.col("p_brand").alias("surface")))


@query(f"""WITH {GM}, {_LEDGER}, sm AS (SELECT model_id, count(*)::BIGINT AS total, count(*) FILTER (mechanism IN ('direct', 'indirect'))::BIGINT AS covered, count(*) FILTER (mechanism IS NULL)::BIGINT AS uncovered FROM led GROUP BY 1), dj AS (SELECT model_id, count(*) AS n FROM gm WHERE status = 'implemented' AND lo % 8 = 6 GROUP BY 1), cl AS (SELECT model_id, count(*) AS n FROM gm WHERE status = 'implemented' AND verb <> 'GET' AND n_inputs = 0 GROUP BY 1),
un AS (SELECT model_id, string_agg(DISTINCT "trigger", ',' ORDER BY "trigger") AS u FROM gm WHERE outcome_status IS NULL AND n > 1 GROUP BY 1), x AS (SELECT sm.*, 0::BIGINT AS blocking, coalesce(cl.n, 0)::BIGINT AS unverifiable, coalesce(dj.n, 0)::BIGINT AS gaps, coalesce(u, '') AS unmeasured FROM sm LEFT JOIN dj ON dj.model_id = sm.model_id LEFT JOIN cl ON cl.model_id = sm.model_id LEFT JOIN un ON un.model_id = sm.model_id)
SELECT *, CASE WHEN unmeasured <> '' THEN 'unmeasured' WHEN unverifiable > 0 THEN 'unverifiable' WHEN uncovered > 0 OR gaps > 0 THEN 'incomplete' ELSE 'complete' END AS verdict FROM x""")
def coverage_report(spark, d):
    t = guarded(spark, d)
    gate = validation.gate(t, validation.atomicity(t).unionAll(validation.callability(t)))
    gaps = validation.atomicity(t).groupBy("model_id").agg(F.count("*").alias("gaps"))
    unmeasured = t.where("outcome_status is null and n > 1").select("model_id", F.col("trigger").alias("item"))
    return reports.coverage_report(coverage.ledger_summary(t, _ledger(t)), gate, gaps, unmeasured)


@query("SELECT c_custkey AS case_id, o AS \"order\", l AS line, p AS part, CASE WHEN o IS NULL THEN 'order' WHEN l IS NULL THEN 'line' WHEN p IS NULL THEN 'part' ELSE '' END AS broken FROM (SELECT c_custkey, o, l, CASE WHEN p_type = 'SMALL' THEN p_partkey END AS p FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS o FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) a ON o_custkey = c_custkey LEFT JOIN (SELECT l_orderkey, min(l_partkey) AS l FROM lineitem GROUP BY 1) b ON l_orderkey = o LEFT JOIN part ON p_partkey = l)")
def case_trace(spark, d):
    """A case's order, line and part, each with the predicate of its own hop."""
    hops = [("order", table(spark, d, "orders").where("o_orderstatus = 'F'"), "o_custkey", "o_orderkey"), ("line", table(spark, d, "lineitem"), "l_orderkey", "l_partkey"), ("part", table(spark, d, "part").where("p_type = 'SMALL'").withColumn("to", F.col("p_partkey")), "p_partkey", "to")]
    return reports.trace(table(spark, d, "customer").select(F.col("c_custkey").alias("case_id"), F.col("c_custkey").alias("at")), hops)


_GRADE = "gr AS (SELECT t.model_id, t.id, CASE WHEN mechanism = 'direct' THEN 'covered' WHEN mechanism IS NOT NULL THEN 'endpoint-only' ELSE 'uncovered' END AS grade, t.hi FROM t LEFT JOIN led ON led.model_id = t.model_id AND led.id = t.id)"


def _grades(spark, d):
    t = transitions(spark, d)
    grade = F.when(F.col("mechanism") == "direct", "covered").when(F.col("mechanism").isNotNull(), "endpoint-only").otherwise("uncovered")
    return t.join(_ledger(t), ["model_id", "id"], "left").select("model_id", "id", grade.alias("grade"), "hi")


@query(f"WITH {M}, {_LEDGER}, {_GRADE} SELECT model_id, id, CASE WHEN hi > 90 THEN 'split-requested' WHEN grade = 'covered' THEN 'continue-as-is' WHEN grade = 'endpoint-only' THEN 'improvement-needed' ELSE 'generate' END AS verdict FROM gr")
def fidelity(spark, d):
    g = _grades(spark, d)
    return reports.fidelity(g, g.where("hi > 90").select("model_id", "id", F.lit("too long").alias("reason")))


@query(f"WITH {M}, {_LEDGER}, {_GRADE} SELECT model_id, count(*)::BIGINT AS transitions, count(*) FILTER (grade = 'covered')::BIGINT AS covered, count(*) FILTER (grade = 'endpoint-only')::BIGINT AS reached, count(*) FILTER (grade = 'uncovered')::BIGINT AS to_generate FROM gr GROUP BY 1")
def coverage_gaps(spark, d):
    return reports.gap_report(_grades(spark, d))


_VIABLE = "vb AS (SELECT model_id, id, CASE WHEN lo % 8 = 6 THEN 'defer' WHEN n = 1 AND hi < 20 THEN 'manual-only' WHEN hi % 10 = 0 THEN 'manual-only' WHEN \"trigger\" <> 'view' AND n_inputs = 0 AND verb <> 'GET' THEN 'defer' WHEN \"trigger\" = 'view' THEN 'manual-only' ELSE 'automate' END AS verdict FROM gm)"


def _viable(spark, d):
    t = guarded(spark, d)
    trigger = F.when(F.col("trigger") == "view", "open page").otherwise(F.concat(F.upper("verb"), F.lit(" /"), "trigger"))
    return reports.viability(t.withColumn("trigger", trigger).withColumns({"unverifiable": F.col("lo") % 8 == 6, "source_unresolved": (F.col("n") == 1) & (F.col("hi") < 20), "anchored": F.col("hi") % 10 != 0}))


@query(f"WITH {GM}, {_VIABLE} SELECT * FROM vb")
def viability(spark, d):
    return _viable(spark, d)


@query(f"WITH {GM}, {_VIABLE} SELECT verdict, count(*)::BIGINT AS n FROM vb GROUP BY 1")
def verdict_counts(spark, d):
    return reports.verdict_counts(_viable(spark, d))


@query("WITH x AS (SELECT o_orderkey % 40 AS model_id, o_orderkey AS id FROM orders WHERE o_orderstatus <> 'P'), s AS (SELECT l_orderkey AS id FROM lineitem SEMI JOIN x ON id = l_orderkey WHERE l_orderkey % 40 < 20 AND (l_linenumber = 2 AND l_partkey % 5 = 0 OR l_linenumber = 6 AND l_suppkey % 2 = 0 OR l_linenumber = 3 AND l_partkey % 3 = 0) GROUP BY 1), a AS (SELECT DISTINCT model_id FROM x WHERE id IN (SELECT id FROM s)) SELECT model_id, id, CASE WHEN model_id NOT IN (SELECT model_id FROM a) THEN 'no-basis' WHEN id IN (SELECT id FROM s) THEN 'candidate' ELSE 'functional-only' END AS verdict FROM x")
def performance_verdicts(spark, d):
    o = table(spark, d, "orders").select((F.col("o_orderkey") % 40).alias("model_id"), F.col("o_orderkey").alias("id"))
    low = F.col("l_orderkey") % 40 < 20
    name = F.when(low & (F.col("l_linenumber") == 2) & (F.col("l_partkey") % 5 == 0), "theLimit").when(low & (F.col("l_linenumber") == 3) & (F.col("l_partkey") % 3 == 0), "nextCursor").otherwise("pagename")
    kind = F.when(low & (F.col("l_linenumber") == 6) & (F.col("l_suppkey") % 2 == 0), "Set<Item>").when(F.col("l_linenumber") == 1, "Asset").otherwise("RoadMapPage")
    inputs = table(spark, d, "lineitem").select((F.col("l_orderkey") % 40).alias("model_id"), F.col("l_orderkey").alias("id"), name.alias("name"), kind.alias("type_name"))
    viable = table(spark, d, "orders").select((F.col("o_orderkey") % 40).alias("model_id"), F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "P", "defer").otherwise("automate").alias("verdict"))
    return reports.performance(inputs, o, viable)


@query(f"""{_GWALK}, c AS (SELECT *, CASE lo % 8 WHEN 0 THEN 0 WHEN 3 THEN 2 WHEN 4 THEN 2 WHEN 7 THEN 2 ELSE 1 END AS nc, (SELECT min(x.id) FROM gm x WHERE x.generatable AND x.model_id = gm.model_id AND x.source = gm.source AND x."trigger" = gm."trigger" AND x.id <> gm.id) AS other FROM gm WHERE generatable),
tg AS (SELECT model_id, id, greatest(nc, 1) AS k FROM c UNION ALL SELECT model_id, other, nc FROM c WHERE other IS NOT NULL AND nc > 0), pr AS (SELECT tg.model_id, tg.id, sum(k) AS targets FROM tg GROUP BY 1, 2),
x AS (SELECT c.model_id, c.id, c.guard, targets, {_OUT.replace("reason IS NOT NULL", "false").replace("n IS NULL", "dep.depth IS NULL").replace("n > 3", "dep.depth > 3")} AS o FROM c JOIN pr ON pr.model_id = c.model_id AND pr.id = c.id LEFT JOIN dep ON dep.model_id = c.model_id AND dep.state = c.source)
SELECT model_id, id, targets::BIGINT AS branches, CASE WHEN guard <> '' AND targets < 2 THEN 'positive-only' ELSE 'full' END AS verdict FROM x WHERE o = 'generated'""")
def depth_verdicts(spark, d):
    t = guarded(spark, d)
    setups = _setups(spark, d, t)
    return reports.depth(generate.paths(generate.all_transitions(t), t, setups, cap=3), generate.paths(generate.guard_conditions(t), t, setups, cap=3), t)


@query("SELECT count(DISTINCT l_partkey)::BIGINT AS overridden, count(DISTINCT l_partkey) FILTER (l_returnflag = 'A')::BIGINT AS \"A\", count(DISTINCT l_partkey) FILTER (l_returnflag = 'R')::BIGINT AS \"R\", (SELECT count(*) FROM part)::BIGINT AS total FROM (SELECT l_partkey * 2 AS l_partkey, l_returnflag FROM lineitem) WHERE l_partkey IN (SELECT p_partkey FROM part)")
def override_density(spark, d):
    log = table(spark, d, "lineitem").select((F.col("l_partkey") * 2).alias("element_id"), F.col("l_returnflag").alias("classification"))
    return reports.override_density(table(spark, d, "part").select(F.col("p_partkey").alias("element_id")), log, ("A", "R"))


@query("WITH m AS (SELECT l_orderkey AS owner, CAST(l_quantity AS INT) - 25 AS c, l_linenumber AS s FROM lineitem) SELECT o_orderkey AS owner, mc AS max_complexity, sc::BIGINT AS sum_complexity, ss::BIGINT AS sum_size, n::BIGINT AS methods FROM orders LEFT JOIN (SELECT owner, max(c) AS mc, sum(c) AS sc, sum(s) AS ss, count(*) AS n FROM m WHERE c > 0 GROUP BY 1) ON owner = o_orderkey")
def type_metrics(spark, d):
    methods = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("owner"), (F.col("l_quantity").cast("int") - 25).alias("complexity"), F.col("l_linenumber").alias("size"))
    return reports.type_metrics(table(spark, d, "orders").select(F.col("o_orderkey").alias("owner")), methods)


_CHAIN = "ck AS (SELECT DISTINCT l_orderkey AS endpoint, l_partkey AS id, l_linenumber AS place FROM lineitem)"


def _chain(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("endpoint"), F.col("l_partkey").alias("id"), F.col("l_linenumber").alias("place")).distinct()


@query(f"WITH {_CHAIN} SELECT endpoint, place, string_agg(id::VARCHAR, ',' ORDER BY id::VARCHAR) AS ids FROM ck GROUP BY 1, 2 HAVING count(*) > 1")
def chain_problems(spark, d):
    return reports.chain_problems(_chain(spark, d))


@query(f"WITH {_CHAIN}, ok AS (SELECT * FROM ck WHERE endpoint NOT IN (SELECT endpoint FROM ck GROUP BY endpoint, place HAVING count(*) > 1)) SELECT endpoint, id::VARCHAR AS id, coalesce(string_agg(id::VARCHAR, ',') OVER (PARTITION BY endpoint ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS held, coalesce(string_agg(id::VARCHAR, ',') OVER (PARTITION BY endpoint ORDER BY place ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS not_varied FROM ok")
def variation_scope(spark, d):
    return reports.variation_scope(_chain(spark, d))


@query("SELECT p_partkey, CASE WHEN p_name LIKE '%red%' OR p_name LIKE '%all wi%' THEN 'first' WHEN p_name LIKE '%ring%' THEN 'second' END AS class FROM part")
def dimension_class(spark, d):
    return table(spark, d, "part").select("p_partkey", reports.dimension_class(F.upper("p_name"), [("first", ("red", "allwi")), ("second", ("ring",))]).alias("class"))


@query("WITH c AS (SELECT o_orderkey AS id, o_orderstatus AS k FROM orders), t AS (SELECT id, CASE WHEN k IN ('F', 'O') THEN k ELSE 'none' END AS kind FROM c) SELECT kind, count(DISTINCT id)::BIGINT AS n FROM t GROUP BY 1")
def consumer_counts(spark, d):
    return reports.consumers(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.array("o_orderstatus", F.lit("x")).alias("consumers")), ("F", "O"))


@query(f"WITH {GM} SELECT model_id, source AS state, count(*)::BIGINT AS moves, count(*) FILTER (outcome_status >= 400)::BIGINT AS failures, string_agg(DISTINCT target, ',' ORDER BY target) AS leads_to FROM gm GROUP BY 1, 2")
def journey_walkthrough(spark, d):
    return reports.walkthrough(guarded(spark, d))


@query("WITH i AS (SELECT doc_id AS id, CASE WHEN doc_id > 0 THEN doc_id // 3 END AS parent, CASE WHEN doc_id % 2 = 0 THEN 'refines' ELSE 'splits' END AS relation FROM documents), d AS (SELECT parent, string_agg(relation || ':' || id, ',' ORDER BY relation || ':' || id) AS c FROM i WHERE parent IS NOT NULL GROUP BY 1) SELECT id, relation || ':' || i.parent AS above, coalesce(c, '') AS children FROM i LEFT JOIN d ON d.parent = i.id")
def anchor_hierarchy(spark, d):
    i = F.col("doc_id")
    return reports.hierarchy(table(spark, d, "documents").select(i.alias("id"), F.expr("case when doc_id > 0 then doc_id div 3 end").alias("parent"), F.when(i % 2 == 0, "refines").otherwise("splits").alias("relation")))


@query("WITH t AS (SELECT DISTINCT l_suppkey AS ty, 'f' || l_linenumber AS f, l_partkey % 3 AS o FROM lineitem), a AS (SELECT ty AS root, f AS path, o FROM t), b AS (SELECT root, path || '.' || f AS path, t.o FROM a JOIN t ON t.ty = a.o) SELECT root, path, o AS of_type FROM a UNION ALL SELECT * FROM b")
def payload_members(spark, d):
    types = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("type_id"), F.concat(F.lit("f"), F.col("l_linenumber").cast("string")).alias("field"), (F.col("l_partkey") % 3).alias("of_type")).distinct()
    return reports.payload(types, types.select("type_id").distinct(), depth=2)


@query("WITH g AS (SELECT l_partkey AS e, string_agg(DISTINCT 's' || l_suppkey, ',' ORDER BY 's' || l_suppkey) AS f, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS o FROM lineitem GROUP BY 1) SELECT p_partkey AS endpoint, 'GET' AS verb, '/' || p_brand AS route, coalesce(f, '') AS fields, coalesce(o, '') AS outcomes, CASE WHEN p_size > 40 THEN 'token' ELSE '' END AS security FROM part LEFT JOIN g ON e = p_partkey")
def call_recipes(spark, d):
    p, li = table(spark, d, "part"), table(spark, d, "lineitem").withColumnRenamed("l_partkey", "endpoint")
    endpoints = p.select(F.col("p_partkey").alias("endpoint"), F.lit("GET").alias("verb"), F.concat(F.lit("/"), "p_brand").alias("route"))
    return reports.call_recipes(endpoints, li.select("endpoint", F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("name")), li.select("endpoint", F.col("l_returnflag").alias("name")), p.where("p_size > 40").select(F.col("p_partkey").alias("endpoint"), F.lit("token").alias("name")))


@query(f"WITH {registry._CLAIMS}, c AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY valid_to DESC, valid_from DESC, text DESC) AS r FROM cl WHERE valid_to IS NOT NULL) SELECT cl.user_id, cl.text, c.text AS before FROM cl LEFT JOIN c ON c.user_id = cl.user_id AND r = 1 WHERE cl.valid_to IS NULL")
def closed_predecessor(spark, d):
    return reports.predecessor(registry._claims(spark, d), "user_id")


@query("WITH f AS (SELECT o_custkey AS q, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders), b AS (SELECT q, o_orderkey // 100 AS parent, max(o_totalprice) AS score FROM f WHERE r <= 6 GROUP BY 1, 2) SELECT q, parent, rank FROM (SELECT q, parent, row_number() OVER (PARTITION BY q ORDER BY score DESC, parent) AS rank FROM b) WHERE rank <= 2")
def rolled_up_hits(spark, d):
    o = table(spark, d, "orders")
    hits = o.select(F.col("o_custkey").alias("q"), F.col("o_orderkey").alias("passage"), F.col("o_totalprice").alias("score"))
    return reports.rolled_up(hits, o.select(F.col("o_orderkey").alias("passage"), F.expr("o_orderkey div 100").alias("parent")), 2).select("q", "parent", "rank")


@query(f"WITH {GM}, tr AS (SELECT DISTINCT model_id, \"trigger\" FROM gm) SELECT init.model_id, 'Home::press::' || gm.id AS id, 'press' AS \"trigger\", 'page ' || outcome_status AS target, gm.id AS api_id, CASE gm.\"trigger\" WHEN 'click' THEN 'visible' ELSE '' END AS guard FROM init JOIN gm ON gm.model_id = init.model_id AND gm.source = init.state WHERE gm.status = 'implemented' AND outcome_status IS NOT NULL AND gm.\"trigger\" IN ('click', 'purchase')")
def planned_ui(spark, d):
    t = guarded(spark, d)
    wanted = initial_states(spark, d).select("model_id", F.lit("Home").alias("ui_source"), F.lit("press").alias("ui_trigger"), F.col("state").alias("api_source"), F.explode(F.array(F.lit("click"), F.lit("purchase"))).alias("api_trigger")).withColumn("local_guard", F.when(F.col("api_trigger") == "click", "visible"))
    targets = t.where("outcome_status is not null").select("model_id", F.col("id").alias("api_id"), F.concat(F.lit("page "), F.col("outcome_status").cast("string")).alias("ui_target"))
    return surfaces.planned(t, wanted, targets).select("model_id", "id", "trigger", "target", "api_id", "guard")
