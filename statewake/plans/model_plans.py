"""Queries of generation and validation over the driver tables' machines, which get guards of every form."""

from __future__ import annotations

from pyspark.sql import functions as F

from statewake.operators import coverage, generate, graph, guards, validation
from statewake.plans.machine import SQL as M
from statewake.plans.machine import initial_states, transitions
from statewake.plans.registry import _LEDGER, _ledger, query

#: The machines' transitions with guards, lifecycle, verbs and outcomes made from their smallest and largest k.
GM = f"""{M}, gm AS (SELECT *, CASE lo % 8 WHEN 0 THEN '' WHEN 1 THEN 'k < ' || hi WHEN 2 THEN 'k >= ' || hi WHEN 3 THEN 'ok AND NOT (late)' WHEN 4 THEN 'ok AND late' WHEN 5 THEN 'NOT (ok)' WHEN 6 THEN 'ok OR late' ELSE '(late AND ok)' END AS guard,
CASE lo % 8 WHEN 3 THEN ['ok', '!late'] WHEN 4 THEN ['ok', 'late'] WHEN 5 THEN ['!ok'] WHEN 7 THEN ['ok', 'late'] WHEN 1 THEN ['k < ' || hi] WHEN 2 THEN ['k >= ' || hi] END AS lits,
status <> 'planned' AND lo % 7 > 2 AS generatable, CASE hi % 4 WHEN 0 THEN 200 WHEN 1 THEN 404 WHEN 2 THEN 500 END AS outcome_status, CASE "trigger" WHEN 'purchase' THEN 'post' WHEN 'click' THEN 'PUT' ELSE 'GET' END AS verb, lo % 3 AS n_inputs FROM t)"""
_PAIR = """pr AS (SELECT a.model_id, a.source, a."trigger", a.id AS a, b.id AS b, a.guard AS ga, b.guard AS gb, a.lo % 8 AS ka, b.lo % 8 AS kb, a.hi AS ha, b.hi AS hb, a.lits AS la, b.lits AS lb, list_filter(a.lits, lambda x: NOT list_contains(b.lits, x)) AS oa, list_filter(b.lits, lambda x: NOT list_contains(a.lits, x)) AS ob,
list_filter(a.lits, lambda x: list_contains(b.lits, CASE WHEN x[1:1] = '!' THEN x[2:] ELSE '!' || x END)) AS op FROM gm a JOIN gm b ON a.model_id = b.model_id AND a.source = b.source AND a."trigger" = b."trigger" AND a.id < b.id WHERE a.status = 'implemented' AND b.status = 'implemented'),
rel AS (SELECT *, CASE WHEN la IS NULL OR lb IS NULL THEN NULL WHEN len(oa) = 0 AND len(ob) = 0 THEN 'identical' WHEN len(oa) = 1 AND len(ob) = 1 AND len(op) = 1 THEN 'complementary' WHEN len(op) > 0 THEN 'exclusive' END AS relation FROM pr)"""


def guarded(spark, d):
    lo, hi, m = F.col("lo"), F.col("hi"), F.col("lo") % 8
    guard = (
        F.when(m == 0, "").when(m == 1, F.concat(F.lit("k < "), hi.cast("string"))).when(m == 2, F.concat(F.lit("k >= "), hi.cast("string"))).when(m == 3, "ok AND NOT (late)").when(m == 4, "ok AND late").when(m == 5, "NOT (ok)").when(m == 6, "ok OR late").otherwise("(late AND ok)")
    )
    life = F.when(lo % 7 == 0, "Disputed").when(lo % 7 == 1, "Rejected").when(lo % 7 == 2, "Quarantine").otherwise("Approved")
    return transitions(spark, d).withColumns({
        "guard": guard, "generatable": coverage.exclusion(F.col("status"), life).isNull(), "outcome_status": F.when(hi % 4 == 0, 200).when(hi % 4 == 1, 404).when(hi % 4 == 2, 500),
        "verb": F.when(F.col("trigger") == "purchase", "post").when(F.col("trigger") == "click", "PUT").otherwise("GET"), "n_inputs": lo % 3,
    })


@query(f"WITH {GM} SELECT model_id, id AS key, id AS validates, NULL AS via, NULL AS reason FROM gm WHERE generatable")
def cov_all_transitions(spark, d):
    return generate.all_transitions(guarded(spark, d))


@query(f"""WITH {GM}, sx AS (SELECT model_id, source AS state FROM gm UNION SELECT model_id, target FROM gm) SELECT sx.model_id, sx.state, min(id) AS validates, CASE WHEN min(id) IS NULL THEN 'no generatable arrival' END AS reason FROM sx LEFT JOIN gm ON gm.model_id = sx.model_id AND gm.target = sx.state AND generatable
WHERE NOT EXISTS (SELECT 1 FROM init WHERE init.model_id = sx.model_id AND init.state = sx.state) GROUP BY 1, 2""")
def cov_all_states(spark, d):
    return coverage.all_states(guarded(spark, d), initial_states(spark, d))


_PAIRS = """tp AS (SELECT a.model_id, CASE WHEN b.id IS NULL THEN a.id ELSE a.id || '->' || b.id END AS key, b.id AS validates, CASE WHEN b.id IS NOT NULL THEN a.id END AS via, CASE WHEN b.id IS NULL THEN 'terminal: nothing to pair with' END AS reason FROM gm a LEFT JOIN gm b ON b.model_id = a.model_id AND b.source = a.target AND b.generatable WHERE a.generatable)"""


@query(f"WITH {GM}, {_PAIRS} SELECT * FROM tp")
def cov_transition_pairs(spark, d):
    return generate.transition_pairs(guarded(spark, d))


@query(f"""WITH {GM}, g AS (SELECT *, CASE lo % 8 WHEN 0 THEN [] WHEN 3 THEN ['ok', 'NOT (late)'] WHEN 4 THEN ['ok', 'late'] WHEN 7 THEN ['(late', 'ok)'] ELSE [guard] END AS cs FROM gm WHERE generatable), c AS (SELECT model_id, id, source, "trigger", unnest(cs) AS c FROM g),
s AS (SELECT c.*, (SELECT min(x.id) FROM g x WHERE x.model_id = c.model_id AND x.source = c.source AND x."trigger" = c."trigger" AND x.id <> c.id) AS other FROM c)
SELECT model_id, id || '::<unguarded>' AS key, id AS validates, NULL AS via, NULL AS reason FROM g WHERE len(cs) = 0 UNION ALL SELECT model_id, id || '::' || c || '::true', id, NULL, NULL FROM s UNION ALL SELECT model_id, id || '::' || c || '::false', other, NULL, CASE WHEN other IS NULL THEN 'no alternative exercises the complement' END FROM s""")
def cov_guard_conditions(spark, d):
    return generate.guard_conditions(guarded(spark, d))


_GWALK = f"""WITH RECURSIVE {GM}, tm AS MATERIALIZED (SELECT DISTINCT model_id, source, target FROM gm WHERE generatable),
w AS (SELECT model_id, list([state]) AS seen, [state] AS front, 0 AS depth FROM init GROUP BY model_id, state
  UNION ALL SELECT model_id, list_append(seen, nxt), nxt, depth + 1 FROM (SELECT w.model_id, w.seen, w.depth, list(DISTINCT tm.target) AS nxt FROM w JOIN tm ON tm.model_id = w.model_id AND list_contains(w.front, tm.source) WHERE NOT list_contains(flatten(w.seen), tm.target) GROUP BY w.model_id, w.seen, w.depth)),
dep AS (SELECT model_id, unnest(front) AS state, depth FROM w), {_PAIRS}"""
_OUT = "CASE WHEN reason IS NOT NULL THEN 'unsatisfiable' WHEN n IS NULL THEN 'unreachable' WHEN n > 3 THEN 'exceeds-cap' ELSE 'generated' END"
_GEN = f"""ga AS (SELECT g.model_id, g.id AS key, g.id AS validates, dep.depth AS n, NULL AS reason FROM gm g LEFT JOIN dep ON dep.model_id = g.model_id AND dep.state = g.source WHERE generatable),
gp AS (SELECT tp.model_id, key, validates, dep.depth + 1 AS n, reason FROM tp LEFT JOIN gm v ON v.model_id = tp.model_id AND v.id = tp.via LEFT JOIN dep ON dep.model_id = tp.model_id AND dep.state = v.source)"""


def _setups(spark, d, t):
    return graph.setup_paths(generate.generatable(t), initial_states(spark, d))


@query(f"{_GWALK}, {_GEN} SELECT model_id, key, validates, CASE WHEN reason IS NULL THEN n END AS setup_length, {_OUT} AS outcome FROM ga")
def generated_paths(spark, d):
    """One path for each transition, of at most three steps of setup, and what has none."""
    t = guarded(spark, d)
    return generate.paths(generate.all_transitions(t), t, _setups(spark, d, t), cap=3).select("model_id", "key", "validates", F.when(F.col("setup").isNotNull(), F.size("setup")).alias("setup_length"), "outcome")


@query(f"{_GWALK}, {_GEN} SELECT model_id, key, validates, CASE WHEN reason IS NULL THEN n END AS setup_length, {_OUT} AS outcome FROM gp")
def generated_pairs(spark, d):
    t = guarded(spark, d)
    return generate.paths(generate.transition_pairs(t), t, _setups(spark, d, t), cap=3).select("model_id", "key", "validates", F.when(F.col("setup").isNotNull(), F.size("setup")).alias("setup_length"), "outcome")


@query(f"{_GWALK}, {_GEN} SELECT model_id, part, count(*)::BIGINT AS n FROM (SELECT model_id, {_OUT} AS part FROM gp UNION ALL SELECT model_id, 'excluded' FROM gm WHERE NOT generatable) GROUP BY 1, 2")
def target_partition(spark, d):
    t = guarded(spark, d)
    return generate.partition(generate.paths(generate.transition_pairs(t), t, _setups(spark, d, t), cap=3), t)


@query(f"{_GWALK}, {_GEN}, c AS (SELECT sha256(model_id || '|' || key)[1:16] AS case_id, n FROM ga WHERE reason IS NULL AND n <= 3) SELECT case_id, unnest(range(0, n + 1))::INT AS sequence, unnest(range(0, n + 1)) = n AS is_validated FROM c")
def case_steps(spark, d):
    t = guarded(spark, d)
    _, steps = generate.persist_plan(generate.paths(generate.all_transitions(t), t, _setups(spark, d, t), cap=3))
    return steps.select("case_id", "sequence", "is_validated")


@query(f"WITH {GM}, {_LEDGER} SELECT g.model_id, g.id AS key, g.id AS validates, CASE WHEN mechanism = 'direct' THEN 'already covered by T-' || g.id END AS reason FROM gm g LEFT JOIN led ON led.model_id = g.model_id AND led.id = g.id WHERE generatable")
def drop_covered(spark, d):
    t = guarded(spark, d)
    grades = _ledger(t).select("model_id", "id", F.when(F.col("mechanism") == "direct", "covered").otherwise("endpoint-only").alias("grade"), F.concat(F.lit("T-"), "id").alias("test"))
    return generate.drop_covered(generate.all_transitions(t), grades).select("model_id", "key", "validates", "reason")


@query(f"WITH {GM}, {_PAIR} SELECT model_id, a, b, relation FROM rel")
def guard_relation(spark, d):
    g = validation._implemented(guarded(spark, d)).select("model_id", "source", "trigger", "id", guards.literals(F.col("guard")).alias("l"))
    pairs = g.withColumnsRenamed({"id": "a", "l": "la"}).join(g.withColumnsRenamed({"id": "b", "l": "lb"}), ["model_id", "source", "trigger"]).where("a < b")
    return pairs.select("model_id", "a", "b", guards.relation(F.col("la"), F.col("lb")).alias("relation"))


_FIND = f"""{_PAIR},
det AS (SELECT model_id, 'determinism' AS "check", CASE WHEN detail IN ('not a simple threshold') THEN 'unverifiable' ELSE 'blocking' END AS severity, a || ',' || b AS elements, detail FROM (SELECT *, CASE WHEN ga = '' OR gb = '' THEN 'unguarded sibling' WHEN relation = 'identical' THEN 'same condition' WHEN relation IS NOT NULL THEN NULL
  WHEN ka NOT IN (1, 2) OR kb NOT IN (1, 2) THEN 'not a simple threshold' WHEN ka = kb OR (ka = 1 AND hb < ha) OR (ka = 2 AND ha < hb) THEN 'overlapping ranges' END AS detail FROM rel) WHERE detail IS NOT NULL),
gg AS (SELECT model_id, source, "trigger", string_agg(id, ',' ORDER BY id) AS ids, count(*) AS n, list(DISTINCT lo % 8) AS ks, max(hi) FILTER (lo % 8 = 1) AS h1, min(hi) FILTER (lo % 8 = 2) AS h2 FROM gm WHERE status = 'implemented' GROUP BY 1, 2, 3 HAVING count(*) >= 2),
com AS (SELECT model_id, 'guard-completeness' AS "check", CASE WHEN detail = 'gap between thresholds' THEN 'blocking' ELSE 'unverifiable' END AS severity, ids AS elements, detail FROM (SELECT *, CASE WHEN list_contains(ks, 0) OR n = 2 AND EXISTS (SELECT 1 FROM rel WHERE relation = 'complementary' AND rel.model_id = gg.model_id AND rel.source = gg.source AND rel."trigger" = gg."trigger") THEN NULL
  WHEN list_has_all([3, 4, 5, 7], ks) THEN CASE WHEN NOT (list_contains(ks, 5) AND list_contains(ks, 3) AND list_has_any(ks, [4, 7])) THEN 'a combination without a guard' END WHEN NOT list_has_all([1, 2], ks) THEN 'not simple thresholds' WHEN h1 IS NULL OR h2 IS NULL OR h2 > h1 THEN 'gap between thresholds' END AS detail FROM gg) WHERE detail IS NOT NULL),
one AS (SELECT model_id, 'atomicity' AS "check", 'advisory' AS severity, id AS elements, 'a disjunction' AS detail FROM gm WHERE status = 'implemented' AND lo % 8 = 6
  UNION ALL SELECT model_id, 'callability', 'unverifiable', id, 'takes a body, and no input is known' FROM gm WHERE status = 'implemented' AND verb <> 'GET' AND n_inputs = 0)"""


@query(f"WITH {GM}, {_FIND} SELECT * FROM det")
def check_determinism(spark, d):
    return validation.determinism(guarded(spark, d))


@query(f"WITH {GM}, {_FIND} SELECT * FROM com")
def check_completeness(spark, d):
    return validation.guard_completeness(guarded(spark, d))


@query(f"WITH {GM}, {_FIND} SELECT * FROM one")
def check_transitions(spark, d):
    t = guarded(spark, d)
    return validation.atomicity(t).unionAll(validation.callability(t))


@query("""WITH g AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'NOT (E is thrown)' WHEN 1 THEN 'E is thrown' ELSE '' END AS guard, CASE o_orderstatus WHEN 'F' THEN 422 WHEN 'O' THEN 200 END AS s FROM orders) SELECT o_orderkey FROM g WHERE guard LIKE 'NOT%' AND s >= 400""")
def check_polarity(spark, d):
    from statewake.plans.machine import table

    k = F.col("o_orderkey") % 3
    t = table(spark, d, "orders").select(F.lit(1).alias("model_id"), F.col("o_orderkey").alias("id"), F.lit("implemented").alias("status"), F.when(k == 0, "NOT (E is thrown)").when(k == 1, "E is thrown").otherwise("").alias("guard"), F.when(F.col("o_orderstatus") == "F", 422).when(F.col("o_orderstatus") == "O", 200).alias("outcome_status"))
    return validation.polarity(t).select(F.col("elements").cast("long").alias("o_orderkey"))


def _states(spark, d):
    """The machines' states with names, some of them blank or shared."""
    t = transitions(spark, d)
    s = t.select("model_id", F.col("source").alias("state")).union(t.select("model_id", "target")).union(initial_states(spark, d)).distinct()
    kind, low = F.split_part("state", F.lit("|"), F.lit(1)), F.split_part("state", F.lit("|"), F.lit(2)).cast("int")
    return s.select("model_id", "state", F.when((kind == "error") & (low == 0), " ").when(low <= 1, F.upper(kind)).otherwise(F.concat(F.lit(" "), "state")).alias("name"), F.when(kind == "view", "ui").otherwise("api").alias("surface"))


_STATES = """, ss AS (SELECT model_id, source AS state FROM t UNION SELECT model_id, target FROM t UNION SELECT model_id, state FROM init), sn AS (SELECT model_id, state, split_part(state, '|', 1) AS kind, CAST(split_part(state, '|', 2) AS INT) AS low FROM ss),
obs AS (SELECT model_id, 'observability' AS "check", 'blocking' AS severity, string_agg(state, ',' ORDER BY state) AS elements, CASE WHEN n = '' THEN 'no name' ELSE 'states that present alike' END AS detail FROM (SELECT model_id, state, CASE kind WHEN 'view' THEN 'ui' ELSE 'api' END AS surface, CASE WHEN kind = 'error' AND low = 0 THEN '' WHEN low <= 1 THEN kind ELSE state END AS n FROM sn) GROUP BY model_id, surface, n HAVING n = '' OR count(*) > 1)"""
_REACH = """, rch AS (SELECT s.model_id, 'reachability' AS "check", CASE WHEN dep.depth IS NULL THEN 'blocking' ELSE 'advisory' END AS severity, s.state AS elements, CASE WHEN dep.depth IS NULL THEN 'unreachable' ELSE 'terminal' END AS detail FROM ss s LEFT JOIN dep ON dep.model_id = s.model_id AND dep.state = s.state
WHERE dep.depth IS NULL OR NOT EXISTS (SELECT 1 FROM t WHERE t.model_id = s.model_id AND t.source = s.state AND t.status = 'implemented'))"""
_IWALK = _GWALK.replace("FROM gm WHERE generatable)", "FROM gm WHERE status = 'implemented')").replace(f", {_PAIRS}", "")


@query(f"WITH {M}{_STATES} SELECT * FROM obs")
def check_observability(spark, d):
    return validation.observability(_states(spark, d))


def _reached(spark, d, t):
    return graph.reachability(t.where("status = 'implemented'"), initial_states(spark, d))


@query(f"{_IWALK}{_STATES}{_REACH} SELECT * FROM rch")
def check_reachability(spark, d):
    return validation.reachability(_states(spark, d), _reached(spark, d, guarded(spark, d)))


_ALL = f"""{_IWALK}, {_FIND}{_STATES}{_REACH}, {_LEDGER}, al AS (SELECT 1 AS check_no, * FROM obs UNION ALL SELECT 2, * FROM det UNION ALL SELECT 3, * FROM com UNION ALL SELECT CASE "check" WHEN 'callability' THEN 4 ELSE 6 END, * FROM one UNION ALL SELECT 7, * FROM rch
UNION ALL SELECT 8, model_id, 'ac-coverage', 'advisory', id, 'nothing validates it' FROM gm WHERE status = 'implemented' AND (model_id, id) NOT IN (SELECT (model_id, id) FROM led WHERE mechanism = 'direct'))"""


def _findings(spark, d):
    t = guarded(spark, d)
    return validation.validate(t, _states(spark, d), _reached(spark, d, t), _ledger(t).where("mechanism = 'direct'"))


@query(f'{_ALL} SELECT model_id, check_no, "check", severity, elements, detail FROM al')
def validation_findings(spark, d):
    return _findings(spark, d)


@query(f"{_ALL}, c AS (SELECT model_id, count(*) FILTER (severity = 'blocking') AS blocking, count(*) FILTER (severity = 'unverifiable') AS unverifiable, count(*) FILTER (severity = 'advisory') AS advisory FROM al GROUP BY 1) SELECT DISTINCT t.model_id, coalesce(blocking, 0)::BIGINT AS blocking, coalesce(unverifiable, 0)::BIGINT AS unverifiable, coalesce(advisory, 0)::BIGINT AS advisory, coalesce(blocking, 0) = 0 AND coalesce(unverifiable, 0) = 0 AS valid FROM t LEFT JOIN c ON c.model_id = t.model_id")
def validation_gate(spark, d):
    return validation.gate(transitions(spark, d), _findings(spark, d))
