"""Further queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from statewake.operators import delta, design, graph, guards
from statewake.plans.machine import SQL as M
from statewake.plans.machine import initial_states, steps, table, transitions
from statewake.plans.registry import _BAND, _HOLDS, _LEDGER, _MIXED, _PI, _WALK, _WHY, _ledger, _mixed_guards, _risks, query


@query(f"WITH {M}, v AS (SELECT unnest([-1, 0, 1]) AS off) SELECT model_id, id, lo + off AS value FROM t, v UNION ALL SELECT model_id, id, hi + off FROM t, v WHERE hi <> lo")
def cov_boundary(spark, d):
    t = transitions(spark, d)
    bounds = t.select("model_id", "id", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("bound"))
    return guards.boundary_points(bounds, "bound").select("model_id", "id", "value")


@query(f"""WITH {_MIXED}, why AS (SELECT *, CASE WHEN members < 2 THEN 'one member' ELSE {_WHY.format(6, 6)} END AS reason FROM grp), rows_ AS (SELECT l_orderkey, atoms, unnest(range(0, 1 << len(atoms))) AS r FROM why WHERE reason IS NULL)
SELECT l_orderkey, r::INT AS "row", (SELECT min(l_linenumber) FROM gl g WHERE g.l_orderkey = rows_.l_orderkey AND {_HOLDS}) AS covering, NULL AS reason FROM rows_ UNION ALL SELECT l_orderkey, NULL, NULL, reason FROM why WHERE reason IS NOT NULL""")
def decision_rows(spark, d):
    return design.decision_rows(_mixed_guards(spark, d), ["l_orderkey"], "guard", "l_linenumber")


@query("WITH x AS (SELECT p_brand, p_type, greatest(count(DISTINCT p_size), 2) AS n FROM part GROUP BY 1, 2) SELECT p_brand, (sum(n - 1) + 1)::BIGINT AS bounded, round(log10(product(n)), 6) AS product_digits FROM x GROUP BY 1")
def dimension_cost(spark, d):
    dims = table(spark, d, "part").groupBy("p_brand", "p_type").agg(F.count_distinct("p_size").alias("n"))
    return design.dimension_cost(dims, "p_brand", "n").select("p_brand", "bounded", F.round(F.log10("product"), 6).alias("product_digits"))


@query(f"WITH {M}, {_LEDGER}, j AS (SELECT t.model_id, t.source, mechanism, t.lo % 2 = 0 AS oracle_, CASE WHEN t.hi % 5 = 0 THEN 'passed' WHEN t.hi % 5 = 1 THEN 'failed' END AS outcome FROM t LEFT JOIN led ON led.model_id = t.model_id AND led.id = t.id) SELECT model_id || '/' || source AS key, min(CASE WHEN outcome IS NOT NULL THEN 1 WHEN mechanism = 'direct' AND oracle_ THEN 2 WHEN mechanism = 'indirect' THEN 3 WHEN mechanism = 'direct' THEN 4 ELSE 5 END)::INT AS detection, bool_or(coalesce(outcome = 'failed', false)) AS failing FROM j GROUP BY 1")
def detectability(spark, d):
    t = transitions(spark, d)
    r = t.join(_ledger(t), ["model_id", "id"], "left").select(F.concat_ws("/", F.col("model_id").cast("string"), "source").alias("key"), "mechanism", (F.col("lo") % 2 == 0).alias("oracle"), F.when(F.col("hi") % 5 == 0, "passed").when(F.col("hi") % 5 == 1, "failed").alias("outcome"))
    return design.detectability(r, "key")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'unknown' WHEN c = 0 THEN 'estimated' WHEN o_orderpriority LIKE '5%' OR c = 1 THEN 'inferred' ELSE 'confirmed' END AS confidence, CASE WHEN o_orderstatus = 'P' THEN 'No-Go' WHEN c = 0 THEN 'Conditional,No-Go' ELSE 'Go,Conditional,No-Go' END AS permitted FROM (SELECT o_orderkey, o_orderstatus, o_orderpriority, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS c FROM orders)")
def verdict(spark, d):
    runs = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("runs"))
    o = table(spark, d, "orders").join(runs, "o_orderkey", "left").withColumn("confidence", design.confidence(F.col("o_orderstatus") != "P", F.coalesce("runs", F.lit(0)), F.col("o_orderpriority").startswith("5")))
    return o.select("o_orderkey", "confidence", design.permitted(F.col("confidence")).alias("permitted"))


@query("""WITH r AS (SELECT l_orderkey || '-' || l_linenumber AS id, 1 + CAST(l_quantity AS INT) % 6 AS p, 1 + CAST(l_linenumber AS INT) % 5 AS i, CASE WHEN l_linenumber <> 6 THEN CAST(l_suppkey AS INT) % 10 END AS sc, CASE WHEN l_linenumber = 3 THEN ' ' ELSE l_returnflag END AS owner,
CASE l_linestatus WHEN 'O' THEN 'Opportunity' ELSE NULL END AS polarity, CASE l_returnflag WHEN 'A' THEN 'Avoid' WHEN 'N' THEN 'exploit' ELSE 'ACCEPT' END AS response, CASE l_linenumber WHEN 2 THEN 'closed' WHEN 4 THEN 'Shut' END AS status, CASE l_linenumber WHEN 5 THEN 'model' WHEN 7 THEN 'guess' END AS derived_from FROM lineitem)
SELECT id, 'scale' AS rule FROM r WHERE p > 5 UNION ALL SELECT id, 'score-stale' FROM r WHERE p <= 5 AND sc <> p * i UNION ALL SELECT id, 'no-owner' FROM r WHERE trim(owner) = '' UNION ALL SELECT id, 'response-polarity' FROM r WHERE (polarity IS NULL AND response = 'exploit') OR (polarity IS NOT NULL AND response = 'Avoid')
UNION ALL SELECT id, 'status' FROM r WHERE status = 'Shut' UNION ALL SELECT id, 'derivation' FROM r WHERE derived_from = 'guess' UNION ALL SELECT id, 'derivation-source' FROM r WHERE derived_from = 'model' UNION ALL SELECT id, 'duplicate-id' FROM r GROUP BY id HAVING count(*) > 1""")
def register_lint(spark, d):
    line, flag = F.col("l_linenumber"), F.col("l_returnflag")
    r = table(spark, d, "lineitem").select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), line.cast("string")).alias("id"), (1 + F.col("l_quantity").cast("int") % 6).alias("probability"), (1 + line.cast("int") % 5).alias("impact"), F.when(line != 6, F.col("l_suppkey").cast("int") % 10).alias("score"),
        F.when(line == 3, " ").otherwise(flag).alias("owner"), F.when(flag == "A", "Avoid").when(flag == "N", "exploit").otherwise("ACCEPT").alias("response"), F.when(F.col("l_linestatus") == "O", "Opportunity").alias("polarity"),
        F.when(line == 2, "closed").when(line == 4, "Shut").alias("status"), F.when(line == 5, "model").when(line == 7, "guess").alias("derived_from"), F.lit("").alias("derived_by"),
    )
    return design.register_lint(r)


@query(f"WITH {_PI} SELECT coalesce({_BAND}, 'unprofiled') AS band, count(*)::BIGINT AS total, count(*) FILTER (l_returnflag = 'N')::BIGINT AS uncovered, count(*) FILTER (l_returnflag = 'R')::BIGINT AS failing FROM pi GROUP BY 1")
def weighted_coverage(spark, d):
    return _risks(spark, d).groupBy("band").agg(F.count("*").alias("total"), F.count_if(F.col("l_returnflag") == "N").alias("uncovered"), F.count_if(F.col("l_returnflag") == "R").alias("failing"))


@query(f"WITH {_PI} SELECT coalesce({_BAND}, '?') AS band, l_returnflag, count(*)::BIGINT AS n FROM pi GROUP BY ROLLUP (1, 2)".replace("coalesce(", "(").replace(", '?')", ")"))
def band_rollup(spark, d):
    return _risks(spark, d).rollup("band", "l_returnflag").agg(F.count("*").alias("n"))


@query("""WITH a AS (SELECT DISTINCT user_id, date_trunc('hour', ts) AS h FROM events WHERE event_id <= (SELECT max(event_id) // 2 FROM events)), b AS (SELECT DISTINCT user_id, date_trunc('hour', ts) AS h FROM events WHERE event_id > (SELECT max(event_id) // 2 FROM events)), x AS (SELECT user_id, extract(hour FROM h)::INT AS h, 'a' AS s FROM a UNION SELECT user_id, extract(hour FROM h)::INT, 'b' FROM b)
SELECT user_id, h AS hour, CASE min(s) WHEN 'b' THEN 'added' ELSE 'removed' END AS side FROM x GROUP BY 1, 2 HAVING count(*) = 1""")
def membership_diff(spark, d):
    e = table(spark, d, "events").crossJoin(F.broadcast(table(spark, d, "events").agg(F.expr("max(event_id) div 2").alias("h"))))
    member = lambda c: e.where(c).select("user_id", F.hour("ts").alias("hour"))
    return delta.membership(member("event_id <= h"), member("event_id > h"), ["user_id", "hour"])


@query(f"""WITH {M}, h AS (SELECT max(event_id) // 2 AS h FROM events), o AS (SELECT DISTINCT model_id, state AS source, trigger_ AS tr, target FROM steps, h WHERE target IS NOT NULL AND event_id <= h), n AS (SELECT DISTINCT model_id, state AS source, trigger_ AS tr, target FROM steps, h WHERE target IS NOT NULL AND event_id > h),
c AS ((SELECT * FROM o EXCEPT SELECT * FROM n) UNION (SELECT * FROM n EXCEPT SELECT * FROM o)), g AS (SELECT DISTINCT model_id, source, tr FROM c) SELECT n.model_id, n.source, n.tr AS "trigger", n.target FROM n JOIN g ON g.model_id = n.model_id AND g.source = n.source AND g.tr = n.tr""")
def disturbed_groups(spark, d):
    s = steps(spark, d).where("target is not null").crossJoin(F.broadcast(table(spark, d, "events").agg(F.expr("max(event_id) div 2").alias("h"))))
    keys = ["model_id", "source", "trigger", "target"]
    sides = s.withColumnRenamed("state", "source").groupBy(*keys).agg(F.bool_or(F.col("event_id") <= F.col("h")).alias("o"), F.bool_or(F.col("event_id") > F.col("h")).alias("n"))
    changed = sides.where("o <> n").select(*keys[:3]).distinct()
    return sides.where("n").join(changed, keys[:3], "left_semi").select(*keys)


@query("""WITH c AS (SELECT l_orderkey AS sha, l_linenumber IN (1, 3, 5, 6) AS fix, l_shipdate AS ts, l_partkey AS file FROM lineitem) SELECT 'p' || file AS file, count(DISTINCT sha)::BIGINT AS repairs FROM c WHERE fix AND ts > TIMESTAMP '1994-01-01' AND ts <= TIMESTAMP '1996-01-01' GROUP BY 1""")
def window_repairs(spark, d):
    subjects = ["fix: part", "fix typo in part", "it fixes a typo-tolerant format", "add a prefix, correct it", "Revert part", "hotfix of lint rules", "fixes imports"]
    c = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("sha"), F.get(F.array(*map(F.lit, subjects)), F.col("l_linenumber") - 1).alias("subject"), F.col("l_shipdate").cast("timestamp").alias("ts"), F.array(F.concat(F.lit("p"), F.col("l_partkey").cast("string"))).alias("files"))
    return design.repaired_files(c, "1994-01-01", "1996-01-01")


@query("SELECT r_name, count(n_nationkey)::BIGINT AS nations, count(n_nationkey) FILTER (n_name LIKE 'NATION_1%' OR n_name LIKE 'A%')::BIGINT AS chosen FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
def category_distribution(spark, d):
    n = table(spark, d, "nation").withColumn("hit", F.col("n_name").startswith("A") | F.col("n_name").rlike("^NATION.1"))
    return table(spark, d, "region").join(n, F.col("r_regionkey") == F.col("n_regionkey"), "left").groupBy("r_name").agg(F.count("n_nationkey").alias("nations"), F.count_if(F.col("hit")).alias("chosen"))


@query(f"{_WALK}, s AS (SELECT model_id, source AS state FROM t UNION SELECT model_id, target FROM t UNION SELECT model_id, state FROM init) SELECT s.model_id, coalesce(dep.depth, -1) AS depth, count(*)::BIGINT AS states FROM s LEFT JOIN dep ON dep.model_id = s.model_id AND dep.state = s.state GROUP BY 1, 2")
def layering(spark, d):
    """States by depth; those that no walk reaches are in the column -1."""
    found = graph.reachability(transitions(spark, d), initial_states(spark, d))
    return found.groupBy("model_id", F.coalesce("depth", F.lit(-1)).alias("depth")).agg(F.count("*").alias("states"))


@query("SELECT c_custkey, CASE WHEN o IS NULL THEN 'no order' WHEN l IS NULL THEN 'no line' WHEN p IS NULL THEN 'no part' ELSE '' END AS broken FROM (SELECT c_custkey, min(o_orderkey) AS o, min(l_orderkey) AS l, min(p_partkey) AS p FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l_partkey GROUP BY 1)")
def trace_broken_hop(spark, d):
    c, o, li, p = (table(spark, d, x) for x in ("customer", "orders", "lineitem", "part"))
    hops = c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left").join(p, F.col("l_partkey") == F.col("p_partkey"), "left")
    best = hops.groupBy("c_custkey").agg(*(F.max(F.col(k).isNotNull()).alias(k) for k in ("o_orderkey", "l_orderkey", "p_partkey")))
    return best.select("c_custkey", F.when(~F.col("o_orderkey"), "no order").when(~F.col("l_orderkey"), "no line").when(~F.col("p_partkey"), "no part").otherwise("").alias("broken"))


@query("SELECT event_id, CAST(props->>'$.k' AS INT) AS k, CAST(props->>'$.k' AS INT) >= 50 AS high FROM events")
def json_decode(spark, d):
    e = table(spark, d, "events").select("event_id", F.from_json("props", "k int").alias("p"))
    return e.select("event_id", F.col("p.k").alias("k"), (F.col("p.k") >= 50).alias("high"))


@query("SELECT l_partkey, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS statuses, count(DISTINCT l_returnflag) > 1 AS conflict FROM lineitem GROUP BY 1")
def status_conflicts(spark, d):
    s = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.array_sort(F.collect_set("l_returnflag")).alias("s"))
    return s.select("l_partkey", F.array_join("s", ",").alias("statuses"), (F.size("s") > 1).alias("conflict"))


@query("SELECT p_type, CASE WHEN count(*) = 1 THEN min(p_partkey) END AS p_partkey FROM part GROUP BY 1")
def type_resolution(spark, d):
    return table(spark, d, "part").groupBy("p_type").agg(F.when(F.count("*") == 1, F.min("p_partkey")).alias("p_partkey"))


@query("WITH e AS (SELECT o_custkey AS f, o_orderkey AS s, CASE WHEN o_orderpriority < '3' THEN 1 ELSE 2 END AS prio, o_orderstatus AS kind FROM orders) SELECT f, s, kind FROM (SELECT *, row_number() OVER (PARTITION BY f ORDER BY prio, s) AS r FROM e) WHERE r = 1")
def feature_evidence(spark, d):
    prio = F.when(F.col("o_orderpriority") < "3", 1).otherwise(2)
    best = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("f")).agg(F.min(F.struct(prio.alias("prio"), F.col("o_orderkey").alias("s"), F.col("o_orderstatus").alias("kind"))).alias("b"))
    return best.select("f", "b.s", "b.kind")
