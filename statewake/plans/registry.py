"""Queries over the driver tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from statewake.functions import scores
from statewake.operators import coverage, delta, graph, guards, patterns, retrieval, temporal
from statewake.plans import machine
from statewake.plans.machine import SQL as M
from statewake.plans.machine import initial_states, steps, table, transitions

_QUERIES, _SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return put


def queries():
    from statewake.plans import link_plans, model_plans, more, report_plans, rule_plans, synthesis_plans, text_plans  # noqa: F401  they register further queries

    return dict(_QUERIES)


def oracle_sql():
    from statewake.plans import link_plans, model_plans, more, report_plans, rule_plans, synthesis_plans, text_plans  # noqa: F401

    return dict(_SQL)


def flagship(spark, sf_dir):
    return ledger_coverage(spark, sf_dir)


def _ledger(t):
    """Stand-in for a run's ledger: transitions seen often are direct, some indirect, some only initiated."""
    mechanism = F.when(F.col("n") >= 2, "direct").when(F.col("lo") % 4 == 0, "indirect").when(F.col("lo") % 4 == 1, "initiated")
    return t.withColumn("mechanism", mechanism).where("mechanism is not null").select("model_id", "id", "mechanism")


_LEDGER = "led AS (SELECT model_id, id, CASE WHEN n >= 2 THEN 'direct' WHEN lo % 4 = 0 THEN 'indirect' WHEN lo % 4 = 1 THEN 'initiated' END AS mechanism FROM t)"


@query(f"WITH {M}, {_LEDGER} SELECT model_id, count(*)::BIGINT AS total, count(*) FILTER (mechanism IN ('direct','indirect'))::BIGINT AS covered, count(*) FILTER (mechanism = 'indirect')::BIGINT AS indirect_only, count(*) FILTER (mechanism = 'initiated')::BIGINT AS initiated_only, count(*) FILTER (mechanism IS NULL)::BIGINT AS uncovered FROM led GROUP BY 1")
def ledger_coverage(spark, d):
    t = transitions(spark, d)
    observed = t.where("n < 2").select("model_id", "id", F.lit("observed").alias("mechanism"))  # no mechanism that covers
    return coverage.ledger_summary(t.select("model_id", "id"), _ledger(t).select("model_id", "id", "mechanism").unionByName(observed))


@query(f"WITH {M} SELECT * FROM t")
def machine_transitions(spark, d):
    return transitions(spark, d)


@query(f"WITH {M} SELECT a.model_id, a.id AS first_id, b.id AS second_id, a.target AS state FROM t a JOIN t b ON a.model_id = b.model_id AND a.target = b.source")
def two_hop_pairs(spark, d):
    return patterns.consecutive_pairs(transitions(spark, d))


@query(f"WITH {M} SELECT a.model_id, a.source, a.\"trigger\", a.id AS a_id, a.lo AS a_lo, a.hi AS a_hi, b.id AS b_id, b.lo AS b_lo, b.hi AS b_hi, a.lo <= b.hi AND b.lo <= a.hi AS conflict FROM t a JOIN t b ON a.model_id = b.model_id AND a.source = b.source AND a.\"trigger\" = b.\"trigger\" AND a.id < b.id")
def sibling_pairs(spark, d):
    closed = lambda x: F.struct(F.col(f"{x}_lo").alias("lo"), F.lit(True).alias("lo_in"), F.col(f"{x}_hi").alias("hi"), F.lit(True).alias("hi_in"))
    return patterns.sibling_pairs(transitions(spark, d)).withColumn("conflict", guards.overlaps(closed("a"), closed("b")))


@query(f"WITH {M}, s AS (SELECT model_id, source AS state FROM t UNION SELECT model_id, target FROM t), g AS (SELECT DISTINCT model_id, \"trigger\" FROM t) SELECT s.model_id, s.state, g.\"trigger\" FROM s JOIN g ON s.model_id = g.model_id WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.model_id = s.model_id AND t.source = s.state AND t.\"trigger\" = g.\"trigger\")")
def cross_completeness(spark, d):
    return patterns.vocabulary_gaps(transitions(spark, d))


@query(f"WITH {M}, {_LEDGER} SELECT model_id, id FROM led WHERE mechanism IS NULL")
def anti_uncovered(spark, d):
    t = transitions(spark, d)
    return patterns.not_covered(t, _ledger(t)).select("model_id", "id")


@query(f"WITH {M}, {_LEDGER} SELECT model_id, id FROM led WHERE mechanism IS NOT NULL")
def semi_covered(spark, d):
    t = transitions(spark, d)
    return patterns.covered(t, _ledger(t)).select("model_id", "id")


@query("WITH r AS (SELECT DISTINCT l_suppkey AS m, l_partkey AS p FROM lineitem) SELECT x.m AS a, y.m AS b, count(*)::BIGINT AS shared FROM r x JOIN r y ON x.p = y.p AND x.m < y.m GROUP BY 1, 2")
def co_membership(spark, d):
    return patterns.co_members(table(spark, d, "lineitem"), "l_suppkey", "l_partkey")


@query("""SELECT n_nationkey, n_name, coalesce((SELECT string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) FROM customer WHERE c_nationkey = n_nationkey), '') AS segments, (SELECT count(c_mktsegment) FROM customer WHERE c_nationkey = n_nationkey)::BIGINT AS n_segments,
coalesce((SELECT string_agg(DISTINCT s_name, ',' ORDER BY s_name) FROM supplier WHERE s_nationkey = n_nationkey), '') AS suppliers, (SELECT count(s_name) FROM supplier WHERE s_nationkey = n_nationkey)::BIGINT AS n_suppliers FROM nation""")
def optional_enrich(spark, d):
    c = table(spark, d, "customer").withColumnRenamed("c_nationkey", "n_nationkey")
    s = table(spark, d, "supplier").withColumnRenamed("s_nationkey", "n_nationkey")
    return patterns.optional_enrich(table(spark, d, "nation").select("n_nationkey", "n_name"), "n_nationkey", [("segments", c, "c_mktsegment"), ("suppliers", s, "s_name")])


#: A breadth-first walk that keeps the states seen, since plain recursion repeats them.
_WALK = f"""WITH RECURSIVE {M}, tm AS MATERIALIZED (SELECT DISTINCT model_id, source, target FROM t WHERE status = 'implemented'),
w AS (SELECT model_id, list([state]) AS seen, [state] AS front, 0 AS depth FROM init GROUP BY model_id, state
  UNION ALL SELECT model_id, list_append(seen, nxt), nxt, depth + 1 FROM (SELECT w.model_id, w.seen, w.depth, list(DISTINCT tm.target) AS nxt FROM w JOIN tm ON tm.model_id = w.model_id AND list_contains(w.front, tm.source) WHERE NOT list_contains(flatten(w.seen), tm.target) GROUP BY w.model_id, w.seen, w.depth)),
dep AS (SELECT model_id, unnest(front) AS state, depth FROM w)"""


@query(f"{_WALK}, s AS (SELECT model_id, source AS state FROM t UNION SELECT model_id, target FROM t UNION SELECT model_id, state FROM init) SELECT s.model_id, s.state, dep.depth, NOT EXISTS (SELECT 1 FROM t WHERE t.model_id = s.model_id AND t.source = s.state) AS terminal FROM s LEFT JOIN dep ON dep.model_id = s.model_id AND dep.state = s.state")
def reachable_states(spark, d):
    return graph.reachability(transitions(spark, d), initial_states(spark, d))


@query(f"{_WALK} SELECT model_id, state, depth, depth AS path_length FROM dep")
def shortest_setup(spark, d):
    return graph.setup_paths(transitions(spark, d).where("status = 'implemented'"), initial_states(spark, d)).select("model_id", "state", "depth", F.size("path").alias("path_length"))


@query(f"WITH {M} SELECT model_id, state, sum(i)::BIGINT AS fan_in, sum(o)::BIGINT AS fan_out FROM (SELECT model_id, source AS state, 1 AS o, 0 AS i FROM t UNION ALL SELECT model_id, target, 0, 1 FROM t) GROUP BY 1, 2")
def degree(spark, d):
    return graph.degrees(transitions(spark, d))


@query(f"""WITH {M}, e AS (SELECT DISTINCT model_id, source, target FROM t), h0 AS (SELECT model_id, state AS start, state AS node, 0 AS hops FROM init), h1 AS (SELECT DISTINCT h0.model_id, start, target AS node, 1 AS hops FROM h0 JOIN e ON e.model_id = h0.model_id AND e.source = h0.node),
h2 AS (SELECT DISTINCT h1.model_id, start, target AS node, 2 AS hops FROM h1 JOIN e ON e.model_id = h1.model_id AND e.source = h1.node), h3 AS (SELECT DISTINCT h2.model_id, start, target AS node, 3 AS hops FROM h2 JOIN e ON e.model_id = h2.model_id AND e.source = h2.node)
SELECT model_id, start, node, min(hops) AS hops FROM (SELECT * FROM h0 UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2 UNION ALL SELECT * FROM h3) GROUP BY 1, 2, 3""")
def bounded_impact_3hop(spark, d):
    return patterns.within_hops(transitions(spark, d), initial_states(spark, d), 3)


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND doc_id NOT IN (SELECT page_id FROM pages)")
def isolated_nodes(spark, d):
    return graph.isolated(table(spark, d, "documents").select("doc_id"), "doc_id", table(spark, d, "labels").select("doc_id"), table(spark, d, "pages").select("page_id"))


@query("WITH e AS (SELECT user_id, event_type, CAST(props->>'$.k' AS INT) AS k FROM events) SELECT event_type, count(*)::BIGINT AS ran, count(*) FILTER (k < 80)::BIGINT AS passed, count(*) FILTER (k < 80) || '/' || count(*) AS summary FROM e GROUP BY 1")
def outcome_summary(spark, d):
    s = steps(spark, d).groupBy("event_type").agg(F.count("*").alias("ran"), F.count_if(F.col("k") < 80).alias("passed"))
    return s.withColumn("summary", F.concat_ws("/", F.col("passed").cast("string"), F.col("ran").cast("string")))


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1")
def last_write_wins(spark, d):
    return temporal.last_write(table(spark, d, "events"), "user_id", "event_type", "ts", "event_id")


_PI = "pi AS (SELECT l_orderkey, l_linenumber, l_returnflag, 1 + CAST(l_quantity AS INT) % 6 AS p, 1 + CAST(floor(l_discount * 100) AS INT) % 5 AS i FROM lineitem)"
_BAND = "CASE WHEN p NOT BETWEEN 1 AND 5 OR i NOT BETWEEN 1 AND 5 THEN 'refused' WHEN p * i <= 5 THEN 'Low' WHEN p * i <= 11 THEN 'Medium' WHEN p * i <= 19 THEN 'High' ELSE 'Very High' END"


def _risks(spark, d):
    r = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", (1 + F.col("l_quantity").cast("int") % 6).alias("p"), (1 + F.floor(F.col("l_discount") * 100).cast("int") % 5).alias("i"))
    return r.withColumn("score", scores.exposure(F.col("p"), F.col("i"))).withColumn("band", scores.band(F.col("score")))


@query(f"WITH {_PI} SELECT {_BAND} AS band, count(*) FILTER (l_returnflag = 'A')::BIGINT AS a, count(*) FILTER (l_returnflag = 'N')::BIGINT AS n, count(*) FILTER (l_returnflag = 'R')::BIGINT AS r FROM pi GROUP BY 1")
def band_pivot(spark, d):
    p = _risks(spark, d).groupBy("band").pivot("l_returnflag", ["A", "N", "R"]).count().na.fill(0)
    return p.toDF("band", "a", "n", "r")


@query(f"WITH {_PI} SELECT {_BAND} AS band, count(*)::BIGINT AS n, CASE WHEN {_BAND} = 'refused' THEN NULL ELSE sum(p * i) END::BIGINT AS exposure FROM pi GROUP BY 1")
def exposure_bands(spark, d):
    return _risks(spark, d).groupBy("band").agg(F.count("*").alias("n"), F.sum("score").cast("long").alias("exposure"))


@query("SELECT p_partkey, round((p_size + 4 * p_retailprice + 3 * p_retailprice) / 6, 2) AS expected, round((3 * p_retailprice - p_size) / 6, 2) AS sigma FROM part")
def emv_pert(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(scores.pert(F.col("p_size"), F.col("p_retailprice"), 3 * F.col("p_retailprice")), 2).alias("expected"), F.round(scores.pert_sigma(F.col("p_size"), 3 * F.col("p_retailprice")), 2).alias("sigma"))


_FAN = "deg AS (SELECT model_id, state, sum(i)::BIGINT AS fan_in, sum(o)::BIGINT AS fan_out FROM (SELECT model_id, source AS state, 1 AS o, 0 AS i FROM t UNION ALL SELECT model_id, target, 0, 1 FROM t) GROUP BY 1, 2)"


@query(f"WITH {M}, {_FAN} SELECT model_id, state, 1 + (fan_in >= 2)::INT + (fan_in >= 4)::INT + (fan_in >= 7)::INT + (fan_in >= 11)::INT AS fan_rating, 1 + (fan_out >= 1)::INT + (fan_out >= 2)::INT + (fan_out >= 4)::INT + (fan_out >= 6)::INT AS branching_rating FROM deg")
def technical_profile(spark, d):
    return graph.degrees(transitions(spark, d)).select("model_id", "state", scores.rating(F.col("fan_in"), "fan").alias("fan_rating"), scores.rating(F.col("fan_out"), "branching").alias("branching_rating"))


@query(f"WITH {M}, {_LEDGER} SELECT model_id, round(count(*) FILTER (mechanism = 'direct') / nullif(count(*) FILTER (s.status = 'implemented'), 0), 3) AS ratio, bool_and(coalesce(mechanism = 'direct', false)) AS all_direct FROM led JOIN (SELECT model_id AS m, id AS i, status FROM t) s ON s.m = led.model_id AND s.i = led.id GROUP BY 1")
def dq_ratio(spark, d):
    t = transitions(spark, d)
    r = t.join(_ledger(t), ["model_id", "id"], "left")
    direct = F.coalesce(F.col("mechanism") == "direct", F.lit(False))
    n = F.count_if(F.col("status") == "implemented")
    return r.groupBy("model_id").agg(F.round(F.count_if(direct) / F.when(n > 0, n), 3).alias("ratio"), F.bool_and(direct).alias("all_direct"))


@query("SELECT sha256(coalesce(text, ''))[1:16] AS body, count(*)::BIGINT AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def dup_signature(spark, d):
    return table(spark, d, "documents").groupBy(scores.content_id(F.coalesce("text", F.lit(""))).alias("body")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query("SELECT 'unspecified' AS gap, doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'unimplemented', vec_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def reconcile_gaps(spark, d):
    labels = table(spark, d, "labels")
    a = table(spark, d, "documents").join(labels, "doc_id", "left_anti").select(F.lit("unspecified").alias("gap"), F.col("doc_id").alias("id"))
    b = table(spark, d, "embeddings").join(labels.where("quality = 1"), F.col("vec_id") == F.col("doc_id"), "left_anti").select(F.lit("unimplemented").alias("gap"), F.col("vec_id").alias("id"))
    return a.unionAll(b)


@query("SELECT p_brand, p_type, string_agg(DISTINCT p_size, ',' ORDER BY p_size) AS sizes, count(DISTINCT p_size)::BIGINT AS n, count(DISTINCT p_size) = 1 AS singleton FROM part GROUP BY 1, 2")
def equiv_classes(spark, d):
    p = table(spark, d, "part").groupBy("p_brand", "p_type").agg(F.array_sort(F.collect_set("p_size")).alias("s"))
    return p.select("p_brand", "p_type", F.array_join(F.col("s").cast("array<string>"), ",").alias("sizes"), F.size("s").cast("long").alias("n"), (F.size("s") == 1).alias("singleton"))


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders) WHERE r = 1")
def latest_per_group(spark, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey")
    return table(spark, d, "orders").withColumn("r", F.row_number().over(w)).where("r = 1").select("o_custkey", "o_orderkey")


@query("SELECT l_orderkey, l_linenumber, coalesce(string_agg(l_returnflag, '') OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS context FROM lineitem")
def prefix_context(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey").rowsBetween(Window.unboundedPreceding, -1)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(F.collect_list("l_returnflag").over(w), "").alias("context"))


@query(f"WITH {M} SELECT event_id, lag(state) OVER (PARTITION BY model_id ORDER BY ts, event_id) AS predecessor FROM st")
def predecessor_lag(spark, d):
    return steps(spark, d).select("event_id", F.lag("state").over(Window.partitionBy("model_id").orderBy("ts", "event_id")).alias("predecessor"))


@query("SELECT o_orderpriority, o_orderkey, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 10")
def ranked_topk(spark, d):
    return retrieval.top(table(spark, d, "orders"), ["o_orderpriority"], "o_orderkey", 10, "o_totalprice").select("o_orderpriority", "o_orderkey", "rank")


@query("SELECT user_id, event_type, min(event_id) AS first_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) WHERE r = 1 GROUP BY 1, 2")
def first_occurrence(spark, d):
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("first_id"))


_GUARD = "CASE WHEN l_linenumber % 4 = 0 THEN '' WHEN l_linenumber % 4 = 1 THEN 'qty < ' || CAST(l_quantity AS INT) WHEN l_linenumber % 4 = 2 THEN 'flag' || l_returnflag || ' AND NOT (open' || l_linestatus || ')' ELSE 'a OR b' END"


def _guards(spark, d):
    li = table(spark, d, "lineitem")
    q, m = F.col("l_quantity").cast("int").cast("string"), F.col("l_linenumber") % 4
    g = F.when(m == 0, "").when(m == 1, F.concat(F.lit("qty < "), q)).when(m == 2, F.concat(F.lit("flag"), "l_returnflag", F.lit(" AND NOT (open"), "l_linestatus", F.lit(")"))).otherwise("a OR b")
    return li.select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", F.col("l_quantity").cast("int").alias("q"), g.alias("guard"))


@query(f"SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 4 = 0 THEN '' WHEN l_linenumber % 4 = 3 THEN NULL WHEN l_linenumber % 4 = 1 THEN {_GUARD} ELSE 'flag' || l_returnflag || ';!open' || l_linestatus END AS parts FROM lineitem")
def conjunct_split(spark, d):
    lits = F.transform(guards.conjuncts(F.col("guard")), guards.literal)
    shown = F.transform(lits, lambda x: F.concat(F.when(x.negated, "!").otherwise(""), x.atom))
    return _guards(spark, d).select("l_orderkey", "l_linenumber", F.array_join(shown, ";").alias("parts"))


@query("SELECT l_orderkey, l_linenumber, 'qty' AS name, '<' AS op, CAST(CAST(l_quantity AS INT) AS DOUBLE) AS bound FROM lineitem WHERE l_linenumber % 4 = 1")
def threshold_parse(spark, d):
    return _guards(spark, d).select("l_orderkey", "l_linenumber", guards.threshold(F.col("guard")).alias("t")).where("t is not null").select("l_orderkey", "l_linenumber", "t.*")


@query("SELECT l_orderkey, l_linenumber, kind, (CAST(l_quantity AS INT) + off)::DOUBLE AS value FROM lineitem, (VALUES ('below', -1), ('at', 0), ('above', 1)) v(kind, off) WHERE l_linenumber % 4 = 1")
def boundary_points(spark, d):
    t = _guards(spark, d).select("l_orderkey", "l_linenumber", guards.threshold(F.col("guard")).alias("t")).where("t is not null").select("l_orderkey", "l_linenumber", "t.bound")
    return guards.boundary_points(t, "bound").select("l_orderkey", "l_linenumber", "kind", "value")


@query("WITH r AS (SELECT l_partkey, CAST(l_quantity AS INT) AS lo, CAST(l_quantity AS INT) + l_linenumber AS hi FROM lineitem), s AS (SELECT *, max(hi) OVER (PARTITION BY l_partkey ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM r) SELECT l_partkey, far + 1 AS gap_lo, lo - 1 AS gap_hi FROM s WHERE lo > far + 1")
def interval_gap_sweep(spark, d):
    r = table(spark, d, "lineitem").select("l_partkey", F.col("l_quantity").cast("int").alias("lo"), (F.col("l_quantity").cast("int") + F.col("l_linenumber")).alias("hi"))
    return guards.interval_gaps(r, ["l_partkey"])


#: Guards of orders' lines: boolean ones, some with an OR, a threshold, or up to 14 atoms in a group.
_MIXED = """gl AS (SELECT l_orderkey, l_linenumber, l_orderkey % 5 AS kind, CASE l_orderkey % 5 WHEN 3 THEN ['p' || l_linenumber, '!q' || l_linenumber] WHEN 4 THEN CASE WHEN l_linenumber % 2 = 0 THEN ['flagA'] ELSE ['!flagA'] END ELSE ['flag' || l_returnflag, '!open' || l_linestatus] END AS lits FROM lineitem),
grp AS (SELECT l_orderkey, list_sort(list_distinct(flatten(list(list_transform(lits, lambda x: ltrim(x, '!')))))) AS atoms, count(*) AS members, bool_or(kind = 1 AND l_linenumber = 2) AS has_or, bool_or(kind = 2 AND l_linenumber = 1) AS has_threshold FROM gl GROUP BY 1)"""
_HOLDS = """list_bool_and(list_transform(g.lits, lambda x: ((r >> (list_position(atoms, ltrim(x, '!')) - 1)) & 1 = 1) <> (x[1:1] = '!')))"""


def _mixed_guards(spark, d):
    li, kind = table(spark, d, "lineitem"), F.col("l_orderkey") % 5
    flags = F.concat(F.lit("flag"), "l_returnflag", F.lit(" AND NOT (open"), "l_linestatus", F.lit(")"))
    n = F.col("l_linenumber").cast("string")
    guard = (
        F.when((kind == 1) & (F.col("l_linenumber") == 2), "a OR b").when((kind == 2) & (F.col("l_linenumber") == 1), "qty < 5")
        .when(kind == 3, F.concat(F.lit("p"), n, F.lit(" AND (NOT q"), n, F.lit(")"))).when(kind == 4, F.when(F.col("l_linenumber") % 2 == 0, "(flagA)").otherwise("NOT (flagA)")).otherwise(flags)
    )
    return li.select("l_orderkey", "l_linenumber", guard.alias("guard"))


_WHY = "CASE WHEN has_or THEN 'a disjunction or no guard' WHEN has_threshold THEN 'a threshold, which is an interval' WHEN len(atoms) > {} THEN 'more than {} atoms' END"


@query(f"""WITH {_MIXED}, why AS (SELECT *, {_WHY.format(10, 10)} AS reason FROM grp), rows_ AS (SELECT l_orderkey, atoms, unnest(range(0, (1 << len(atoms)))) AS r FROM why WHERE reason IS NULL),
free AS (SELECT l_orderkey, r FROM rows_ WHERE NOT EXISTS (SELECT 1 FROM gl g WHERE g.l_orderkey = rows_.l_orderkey AND {_HOLDS})), f AS (SELECT l_orderkey, count(*) AS uncovered, min(r) AS first_uncovered FROM free GROUP BY 1)
SELECT why.l_orderkey, CASE WHEN reason IS NULL THEN len(atoms)::INT END AS n_atoms, CASE WHEN reason IS NULL THEN coalesce(uncovered, 0)::INT END AS uncovered, first_uncovered::INT AS first_uncovered, reason FROM why LEFT JOIN f ON f.l_orderkey = why.l_orderkey""")
def truth_table(spark, d):
    return guards.truth_table(_mixed_guards(spark, d), ["l_orderkey"], "guard")


@query(f"WITH {M}, m AS (SELECT a.model_id, a.id, min(b.id) AS sib FROM t a LEFT JOIN t b ON a.model_id = b.model_id AND a.source = b.source AND a.\"trigger\" = b.\"trigger\" AND a.id <> b.id GROUP BY 1, 2) SELECT model_id, id, 'true' AS polarity, id AS validates, NULL AS reason FROM m UNION ALL SELECT model_id, id, 'false', sib, CASE WHEN sib IS NULL THEN 'no sibling' END FROM m")
def cov_guard(spark, d):
    return coverage.guard_targets(transitions(spark, d))


@query(f"WITH {M} SELECT model_id, id, CASE WHEN status = 'planned' THEN 'excluded_planned' WHEN lo % 7 = 0 THEN 'excluded_disputed' WHEN lo % 7 = 1 THEN 'excluded_rejected' WHEN lo % 7 = 2 THEN 'excluded_unapproved' END AS reason FROM t")
def exclusions(spark, d):
    life = F.when(F.col("lo") % 7 == 0, "Disputed").when(F.col("lo") % 7 == 1, "Rejected").when(F.col("lo") % 7 == 2, "Quarantine").otherwise("Approved")
    return transitions(spark, d).select("model_id", "id", coverage.exclusion(F.col("status"), life).alias("reason"))


@query(f"WITH {M}, g AS (SELECT model_id, state || '->' || target AS id, bool_or(k < 50) AS a FROM steps WHERE target IS NOT NULL AND event_type <> 'signup' GROUP BY 1, 2) SELECT t.model_id, t.id, CASE WHEN a THEN 'covered' WHEN a IS NOT NULL THEN 'endpoint-only' ELSE 'uncovered' END AS grade FROM t LEFT JOIN g ON g.model_id = t.model_id AND g.id = t.id")
def grade_targets(spark, d):
    tests = steps(spark, d).where("target is not null and event_type <> 'signup'").select("model_id", F.concat_ws("->", "state", "target").alias("id"), (F.col("k") < 50).alias("asserts"))
    return coverage.grade(transitions(spark, d), tests).select("model_id", "id", "grade")


def _criteria(spark, d):
    s, m, later = steps(spark, d), F.col("event_id") % 5, F.col("event_id") % 10 >= 5
    fails = F.concat(F.lit("  If "), "event_type", F.lit(" fails, then the system shall be fast etc"), F.when(later, " TBD ").otherwise(""))
    text = F.when(m == 0, F.concat(F.lit("When "), "event_type", F.lit(" occurs, the system shall record "), F.col("k").cast("string"))).when(m == 1, fails).when(m == 2, F.concat(F.lit("It should work and/or stop"), F.when(later, " faster").otherwise(""))).when(m == 3, F.concat(F.lit("The system shall log "), "event_type", F.lit("."))).otherwise(F.when(later, "it's honoured; and handled").otherwise("  "))
    return s.select("event_id", text.alias("text"))


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'EventDriven' WHEN 1 THEN 'UnwantedBehavior' WHEN 3 THEN 'Ubiquitous' END AS kind FROM events")
def ears_check(spark, d):
    return _criteria(spark, d).select("event_id", retrieval.ears_kind(F.col("text")).alias("kind"))


@query("SELECT event_id, CASE event_id % 10 WHEN 1 THEN 'vague,open-ended' WHEN 6 THEN 'placeholder,vague,open-ended' WHEN 2 THEN 'weak-modal,and-or,pronoun-start' WHEN 7 THEN 'weak-modal,and-or,pronoun-start,unquantified-change' WHEN 4 THEN 'empty' WHEN 9 THEN 'non-observable,pronoun-start,multi-assert,too-short' ELSE '' END AS rules FROM events")
def ac_lint(spark, d):
    return _criteria(spark, d).select("event_id", F.array_join(retrieval.lint(F.col("text")), ",").alias("rules"))


_BM25 = """q AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS term FROM benchmark), dt AS (SELECT doc_id, unnest(ts) AS term, len(ts) AS len FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS ts FROM documents)),
sz AS (SELECT count(*) AS n, avg(len(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'))) AS a FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf, any_value(len) AS len FROM dt WHERE term IN (SELECT term FROM q) GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
w AS (SELECT doc_id, term, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / a)) AS w FROM tf JOIN df USING (term), sz), sc AS (SELECT item_id, doc_id, sum(w) AS score FROM q JOIN w USING (term) GROUP BY 1, 2),
bm AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM sc)"""


def _bm25(spark, d):
    return retrieval.bm25(table(spark, d, "documents"), table(spark, d, "benchmark"), "doc_id", "item_id", 5)


@query(f"WITH {_BM25} SELECT item_id, doc_id, rank, round(score, 1) AS score FROM bm WHERE rank <= 5")
def bm25_topk(spark, d):
    return _bm25(spark, d).select("item_id", "doc_id", "rank", F.round("score", 1).alias("score"))


@query("""WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), q AS (SELECT vec_id AS q_id, v AS qv FROM e WHERE vec_id % 50 = 0),
s AS (SELECT q_id, label, vec_id, round(list_dot_product(qv, v) / sqrt(list_dot_product(qv, qv) * list_dot_product(v, v)), 6) AS score FROM q, e WHERE vec_id <> q_id), k AS (SELECT *, row_number() OVER (PARTITION BY q_id, label ORDER BY score DESC, vec_id) AS r FROM s)
SELECT q_id, vec_id, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, vec_id) AS rank FROM k WHERE r <= 5""")
def cosine_topk(spark, d):
    """Every vector whose id is divisible by 50 against all: five of each label, merged by score."""
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q"))
    s = retrieval.nearest(e, q, k=5, index="label")
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc("score"), "vec_id"))).select("q_id", "vec_id", "rank")


@query("""WITH a AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders), b AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rank FROM orders),
u AS (SELECT * FROM a WHERE rank <= 5 UNION ALL SELECT * FROM b WHERE rank <= 5) SELECT o_custkey, o_orderkey, round(sum(1.0 / (60 + rank)), 6) AS score, count(*)::BIGINT AS sources FROM u GROUP BY 1, 2""")
def rrf_fuse(spark, d):
    o = table(spark, d, "orders")
    r = retrieval.fuse([retrieval.top(o, ["o_custkey"], "o_orderkey", 5, c) for c in ("o_totalprice", "o_orderdate")], ["o_custkey"], "o_orderkey")
    return r.withColumn("score", F.round("score", 6))


def _claims(spark, d):
    # a sign-up says nothing: its text is null, and several in a row are one revision
    said = F.when(F.col("event_type") != "signup", F.col("event_type")).alias("event_type")
    return temporal.revisions(table(spark, d, "events").select("user_id", said, "ts", "event_id"), "user_id", "event_type", "ts", "event_id")


_CLAIMS = "ev AS (SELECT user_id, ts, event_id, CASE WHEN event_type <> 'signup' THEN event_type END AS txt FROM events), ch AS (SELECT *, lag(txt) OVER o AS old, row_number() OVER o AS k FROM ev WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)), cl AS (SELECT user_id, txt AS text, row_number() OVER w AS revision, ts AS valid_from, lead(ts) OVER w AS valid_to FROM ch WHERE k = 1 OR old IS DISTINCT FROM txt WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"


@query(f"WITH {_CLAIMS} SELECT user_id, text, revision FROM cl WHERE valid_to IS NULL")
def scd2_current(spark, d):
    return temporal.current(_claims(spark, d)).select("user_id", "text", "revision")


@query(f"WITH {_CLAIMS}, mid AS (SELECT user_id, min(ts) + (max(ts) - min(ts)) / 2 AS at_ FROM events GROUP BY 1), x AS (SELECT max(valid_from) AS at_ FROM cl WHERE revision = 2) SELECT user_id, text, revision FROM cl, x WHERE valid_from <= at_ AND (valid_to IS NULL OR valid_to > at_)")
def asof_state(spark, d):
    claims = _claims(spark, d)
    at = claims.where("revision = 2").agg(F.max("valid_from").alias("at"))
    return claims.crossJoin(F.broadcast(at)).where(temporal.valid_at(F.col("at"))).select("user_id", "text", "revision")


_HALVES = "mx AS (SELECT max(event_id) // 2 AS h FROM events), oldm AS (SELECT user_id, event_type, count(*)::BIGINT AS n, min(CAST(props->>'$.k' AS INT)) AS k FROM events, mx WHERE event_id <= h GROUP BY 1, 2), newm AS (SELECT user_id, event_type, count(*)::BIGINT AS n, min(CAST(props->>'$.k' AS INT)) AS k FROM events, mx WHERE event_id > h GROUP BY 1, 2)"


def _halves(spark, d):
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int")).crossJoin(F.broadcast(table(spark, d, "events").agg(F.expr("max(event_id) div 2").alias("h"))))
    fold = lambda c: e.where(c).groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("k").alias("k"))
    return fold("event_id <= h"), fold("event_id > h")


@query(f"WITH {_HALVES} SELECT user_id, event_type, o.n AS old_n, n.n AS new_n, o.k AS old_k, n.k AS new_k, CASE WHEN o.n IS NULL THEN 'ADDED' WHEN n.n IS NULL THEN 'REMOVED' WHEN o.n = n.n AND o.k IS NOT DISTINCT FROM n.k THEN 'UNCHANGED' ELSE 'MODIFIED' END AS change FROM oldm o FULL JOIN newm n USING (user_id, event_type)")
def model_diff(spark, d):
    return delta.keyed_diff(*_halves(spark, d), ["user_id", "event_type"], ["n", "k"])


@query("""WITH l AS (SELECT l_orderkey * 10 + l_linenumber AS case_id, CASE WHEN l_linenumber <> 5 THEN CAST(l_quantity AS INT) % 3 END AS l, CASE WHEN l_linenumber NOT IN (5, 6) THEN CAST(l_partkey AS INT) % 3 END AS p, CASE WHEN l_linenumber <> 4 THEN CAST(l_suppkey AS INT) % 3 END AS n FROM (SELECT l_orderkey, l_linenumber, min(l_quantity) AS l_quantity, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY 1, 2))
SELECT case_id, CASE WHEN n IS NULL THEN CASE WHEN p IS NOT NULL THEN 'OBSOLETE' ELSE 'GONE' END WHEN l IS NULL AND p IS NULL THEN 'NEW' WHEN p IS DISTINCT FROM l THEN 'MANUALLY_EDITED' WHEN l <> n THEN 'CHANGED' ELSE 'UNCHANGED' END AS drift FROM l WHERE l IS NOT NULL OR p IS NOT NULL OR n IS NOT NULL""")
def drift_3way(spark, d):
    one = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*(F.min(c).alias(c) for c in ("l_quantity", "l_partkey", "l_suppkey")))
    li = one.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("case_id"), "l_linenumber", "l_quantity", "l_partkey", "l_suppkey")
    side = lambda c, where: li.where(where).select("case_id", (F.col(c).cast("int") % 3).alias("hash"))
    return delta.drift(side("l_quantity", "l_linenumber <> 5"), side("l_partkey", "l_linenumber not in (5, 6)"), side("l_suppkey", "l_linenumber <> 4"), "case_id")


@query("""WITH e AS (SELECT user_id, event_type AS prop, event_id AS seq, CAST(props->>'$.k' AS INT) AS k FROM events), s AS (SELECT user_id, prop, CASE WHEN min(k) > 0 THEN min(k) END AS value FROM e GROUP BY 1, 2),
o AS (SELECT user_id, prop, arg_max(struct_pack(new_value := CASE WHEN k % 5 > 0 THEN k END, previous_value := k // 2), seq) AS o FROM e WHERE k % 2 = 1 GROUP BY 1, 2)
SELECT s.user_id, s.prop, CASE WHEN o.o IS NULL THEN s.value ELSE o.o.new_value END AS value, o.o IS NOT NULL AS overridden, o.o IS NOT NULL AND o.o.previous_value IS DISTINCT FROM s.value AS stale FROM s LEFT JOIN o ON s.user_id = o.user_id AND s.prop = o.prop""")
def override_fold(spark, d):
    """Every event is a value said of its user's type; odd ones are overrides too, some of them to null."""
    e = table(spark, d, "events").select("user_id", F.col("event_type").alias("prop"), F.col("event_id").alias("seq"), F.get_json_object("props", "$.k").cast("int").alias("k"))
    log = e.where("k % 2 = 1").selectExpr("user_id", "prop", "seq", "cast(k div 2 as int) as previous_value", "if(k % 5 > 0, k, null) as new_value")
    return delta.override_fold(log, e.groupBy("user_id", "prop").agg(F.expr("if(min(k) > 0, min(k), null)").alias("value")), "user_id")


@query(f"WITH {_HALVES}, a AS (SELECT user_id, event_type, n FROM oldm), b AS (SELECT user_id, event_type, n FROM newm) SELECT user_id, coalesce(a.event_type, b.event_type) AS event_type, coalesce(a.n, b.n) AS n FROM a FULL JOIN b USING (user_id, event_type)".replace("user_id, coalesce(a.event_type, b.event_type) AS event_type", "user_id, event_type"))
def table_merge(spark, d):
    old, new = _halves(spark, d)
    key = F.concat_ws("|", F.col("user_id").cast("string"), "event_type").alias("key")
    m = delta.upsert(old.select(key, "user_id", "event_type", "n"), new.select(key, "user_id", "event_type", "n"), "key", ["user_id", "event_type", "n"], [])
    return m.drop("key")


@query(f"WITH {_HALVES} SELECT n.user_id, n.event_type, CASE WHEN o.n IS NULL THEN 'first-seen' WHEN o.n = n.n THEN 'unchanged' ELSE 'superseded' END AS outcome, CASE WHEN o.n IS NULL OR o.n = n.n THEN 1 ELSE 2 END AS revision FROM newm n LEFT JOIN oldm o ON o.user_id = n.user_id AND o.event_type = n.event_type")
def supersession_plan(spark, d):
    old, new = _halves(spark, d)
    key = F.concat_ws("|", F.col("user_id").cast("string"), "event_type").alias("key")
    p = temporal.supersession(old.select(key, F.col("n").alias("text"), F.lit(1).alias("revision")), new.select(key, F.col("n").alias("text")), "key")
    parts = F.split("key", r"\|")
    return p.select(F.get(parts, F.lit(0)).cast("long").alias("user_id"), F.get(parts, F.lit(1)).alias("event_type"), "outcome", "revision")


@query("""WITH RECURSIVE p AS (SELECT doc_id AS node, CASE WHEN doc_id % 7 <> 3 THEN doc_id // 3 END AS parent FROM documents WHERE doc_id > 0), w AS (SELECT 0::BIGINT AS node, 0::BIGINT AS root, 0 AS hops UNION ALL SELECT p.node, w.root, hops + 1 FROM w JOIN p ON p.parent = w.node)
SELECT d.doc_id AS node, w.root, w.hops FROM documents d LEFT JOIN w ON w.node = d.doc_id""")
def root_climb(spark, d):
    """Documents below their parent (id div 3); some have none, and what is below them reaches no top."""
    docs = table(spark, d, "documents")
    parents = docs.where("doc_id > 0").select(F.col("doc_id").alias("node"), F.expr("case when doc_id % 7 <> 3 then doc_id div 3 end").alias("parent"))
    return graph.climb(parents, docs.where("doc_id = 0").select(F.col("doc_id").alias("node"))).select("node", F.col("root").cast("long").alias("root"), "hops")
