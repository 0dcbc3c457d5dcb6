"""Queries of chains, synthesis, unfolding, evidence and techniques: customers stand for services, orders for endpoints, line items for checks and outcomes."""

from __future__ import annotations

from pyspark.sql import functions as F

from statewake.operators import carry, evidence, graph, overrides, synthesis, techniques
from statewake.plans.machine import table
from statewake.plans.model_plans import GM, guarded
from statewake.plans.registry import query
from statewake.sources import captured

#: The facts, in SQL that both engines read. Endpoints on one route of a service create and read one
#: resource; line numbers that repeat within an order are ties, and some lines want to come before the one above.
FACTS = {
    "endpoints": """SELECT 'c' || o_custkey AS service, 'C' || (o_orderkey % 3) || '.m' || o_orderkey AS handler, CASE o_orderkey % 4 WHEN 0 THEN 'POST' WHEN 1 THEN 'PUT' ELSE 'GET' END AS verb,
      '/' || lower(o_orderstatus) || '/run-' || (o_orderkey % 2) || CASE WHEN o_orderkey % 5 > 2 THEN '/{{id}}' ELSE '' END AS path, 'C' || (o_orderkey % 3) AS handler_type, o_orderpriority < '4' AS validated,
      CASE WHEN o_orderkey % 4 < 2 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'x.T9' ELSE 'x.T' || (o_custkey % 6) END END AS body_type, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE 'Page<T' || (o_custkey % 6) || '>' END AS response_body FROM {orders}""",
    "checks": """SELECT DISTINCT 'c' || o_custkey AS service, 'C' || (o_orderkey % 3) || '.m' || o_orderkey || '::' || CASE o_orderkey % 4 WHEN 0 THEN 'POST' WHEN 1 THEN 'PUT' ELSE 'GET' END AS endpoint_id,
      l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id, CASE l_suppkey % 6 WHEN 0 THEN 't.isEmpty()' WHEN 1 THEN 'x.isPresent()' WHEN 2 THEN 'NOT (t.isEmpty())' ELSE 'p' || l_partkey || ' > ' || (l_suppkey % 9) END AS expression,
      CASE WHEN l_suppkey % 50 > 0 THEN l_linenumber END AS place FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey""",
    "precedence": """SELECT DISTINCT 'c' || o_custkey AS service, 'C' || (o_orderkey % 3) || '.m' || o_orderkey || '::' || CASE o_orderkey % 4 WHEN 0 THEN 'POST' WHEN 1 THEN 'PUT' ELSE 'GET' END AS endpoint_id,
      a.l_orderkey || '-' || a.l_linenumber || '-' || a.l_partkey || '-' || a.l_suppkey AS first, b.l_orderkey || '-' || b.l_linenumber || '-' || b.l_partkey || '-' || b.l_suppkey AS later
      FROM {lineitem} a JOIN {lineitem} b ON a.l_orderkey = b.l_orderkey AND (a.l_suppkey % 10 = 3 AND b.l_linenumber = a.l_linenumber - 1 OR a.l_linenumber = b.l_linenumber AND a.l_partkey < b.l_partkey AND a.l_suppkey % 2 = 0) JOIN {orders} ON o_orderkey = a.l_orderkey""",
    "outcomes": """SELECT 'c' || o_custkey AS service, row_number() OVER (PARTITION BY o_custkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_discount, l_tax) AS seq,
      CASE WHEN l_suppkey % 40 = 7 THEN 'Lost.m' || l_linenumber || '::GET' ELSE 'C' || (o_orderkey % 3) || '.m' || o_orderkey || '::' || CASE o_orderkey % 4 WHEN 0 THEN 'POST' WHEN 1 THEN 'PUT' ELSE 'GET' END END AS endpoint_id,
      CAST(CASE l_partkey % 7 WHEN 0 THEN 201 WHEN 1 THEN 204 WHEN 2 THEN 400 WHEN 3 THEN 404 WHEN 4 THEN 409 WHEN 5 THEN 200 END AS INT) AS status, CASE WHEN l_returnflag = 'R' THEN 'declared' WHEN l_returnflag = 'A' THEN 'no content' END AS discriminator,
      l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS chk, CASE WHEN l_linestatus = 'O' THEN '!' ELSE '' END AS sense FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey""",
    "members": """SELECT 'c' || c_custkey AS service, 'T' || (c_custkey % 6) AS type_name, 'a' AS name, CASE WHEN c_nationkey % 3 = 0 THEN '' ELSE '@Size(max=' || c_nationkey || ')' END AS c1, '@NotNull' AS c2, 'x.T' || (c_custkey % 6) AS owner, c_nationkey % 5 = 0 AS owner_is_enum, 'java.util.List' AS type, 'T8' AS element_type FROM {customer}
      UNION ALL SELECT 'c' || c_custkey, 'T9', 'b', '', '', 'x.T9', false, 'x.T' || (c_custkey % 6), '' FROM {customer} UNION ALL SELECT 'c' || c_custkey, 'T8', 'd', '', '', 'y.T8', false, 'long', '' FROM {customer}
      UNION ALL SELECT 'c' || c_custkey, 'T8', 'd', '', '', 'z.T8', false, 'long', '' FROM {customer} WHERE c_nationkey % 2 = 0""",
    "mappings": """SELECT 'c' || c_custkey AS service, 'MethodArgumentNotValidException' AS exception, 400 AS status, 'Advice' AS advice, 'E' AS response_body FROM {customer} WHERE c_nationkey % 4 > 0
      UNION ALL SELECT 'c' || c_custkey, 'MethodArgumentNotValidException', 404, 'Other', 'E' FROM {customer} WHERE c_nationkey % 5 = 1 UNION ALL SELECT 'c' || c_custkey, 'Conflict', 409, 'C' || (c_custkey % 4), 'E' || (c_custkey % 2) FROM {customer}
      UNION ALL SELECT 'c' || c_custkey, 'Gone', 404, 'C' || (c_custkey % 2), 'E1' FROM {customer} WHERE c_nationkey % 3 = 0""",
    "security": """SELECT 'c' || o_custkey AS service, 'C' || (o_orderkey % 3) || '.m' || o_orderkey AS handler, CASE WHEN o_orderkey % 9 = 0 THEN 'DELETE' WHEN o_orderkey % 4 = 0 THEN 'POST' WHEN o_orderkey % 4 = 1 THEN 'PUT' ELSE 'GET' END AS verb,
      CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'role' END AS scheme, o_orderpriority AS expression, 'b' AS r1, 'a' || (o_orderkey % 2) AS r2 FROM {orders}""",
}


#: The same number by order: an order is of one service, so its key, then the place within it, is the same sequence without a second shuffle of all lines. Only the sequence counts.
_SEQ = ("row_number() OVER (PARTITION BY o_custkey ORDER BY l_orderkey, ", "l_orderkey * 1048576 + row_number() OVER (PARTITION BY o_custkey, l_orderkey ORDER BY ")


def facts(spark, d, *names, repeated=False):
    """The facts as tables; repeated: checks may stand there more than once."""
    tables = {t: table(spark, d, t) for t in ("orders", "lineitem", "customer")}
    made = {}
    for n in names:
        used = {t: df for t, df in tables.items() if f"{{{t}}}" in FACTS[n]}
        text = FACTS[n].replace(*_SEQ) if n == "outcomes" else FACTS[n]
        df = spark.sql(text.replace("SELECT DISTINCT", "SELECT") if repeated else text, **used)
        if n == "outcomes":
            df = df.withColumn("checks", F.array("chk")).drop("chk")
        if n == "members":
            df = df.withColumn("constraints", F.filter(F.array("c1", "c2"), lambda c: c != "")).drop("c1", "c2")
        if n == "security":
            df = df.withColumn("roles", F.array("r1", "r2")).drop("r1", "r2")
        made[n] = df
    return [made[n] for n in names]


def _cte(*names):
    text = {n: FACTS[n].format(orders="orders", lineitem="lineitem", customer="customer") for n in names}
    if "members" in text:
        text["members"] = f"SELECT *, list_filter([c1, c2], lambda x: x <> '') AS constraints FROM ({text['members']})"
    return ",\n".join(f"{n} AS MATERIALIZED ({t})" for n, t in text.items())


# chains
_ORDER = f"""WITH RECURSIVE {_cte("checks", "precedence")},
before AS MATERIALIZED (SELECT a.service, a.endpoint_id, a.id AS x, b.id AS y FROM checks a JOIN checks b USING (service, endpoint_id) WHERE a.place < b.place
  UNION SELECT p.service, p.endpoint_id, p.first, p.later FROM precedence p JOIN checks a ON a.service = p.service AND a.endpoint_id = p.endpoint_id AND a.id = p.first JOIN checks b ON b.service = p.service AND b.endpoint_id = p.endpoint_id AND b.id = p.later),
tc AS (SELECT * FROM before UNION SELECT tc.service, tc.endpoint_id, tc.x, b.y FROM tc JOIN before b ON b.service = tc.service AND b.endpoint_id = tc.endpoint_id AND b.x = tc.y),
cyc AS (SELECT DISTINCT service, endpoint_id, x FROM tc WHERE x = y),
stay AS (SELECT service, endpoint_id, x FROM cyc UNION SELECT tc.service, tc.endpoint_id, tc.y FROM tc JOIN cyc USING (service, endpoint_id, x)),
walk AS (SELECT service, endpoint_id, id, 0 AS layer FROM checks WHERE (service, endpoint_id) NOT IN (SELECT service, endpoint_id FROM cyc) UNION SELECT w.service, w.endpoint_id, b.y, layer + 1 FROM walk w JOIN before b ON b.service = w.service AND b.endpoint_id = w.endpoint_id AND b.x = w.id),
layers AS (SELECT service, endpoint_id, id, max(layer) AS layer FROM walk GROUP BY ALL),
tied AS (SELECT service, endpoint_id, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT *, count(*) OVER (PARTITION BY service, endpoint_id, layer) AS n FROM layers) WHERE n > 1 GROUP BY ALL),
ordered AS (SELECT service, endpoint_id, string_agg(l.id, ',' ORDER BY layer) AS ids, list(expression ORDER BY layer) AS words, list(l.id ORDER BY layer) AS chain FROM layers l JOIN checks c USING (service, endpoint_id, id) GROUP BY ALL),
result AS (SELECT e.service, e.endpoint_id, CASE WHEN s.ids IS NOT NULL THEN 'cycle' WHEN t.ids IS NOT NULL THEN 'tie' END AS reason, coalesce(s.ids, t.ids, '') AS unordered, o.words, o.chain FROM (SELECT DISTINCT service, endpoint_id FROM checks) e
  LEFT JOIN (SELECT service, endpoint_id, string_agg(x, ',' ORDER BY x) AS ids FROM stay GROUP BY ALL) s USING (service, endpoint_id) LEFT JOIN tied t USING (service, endpoint_id) LEFT JOIN ordered o USING (service, endpoint_id))"""


@query(f"{_ORDER} SELECT service, endpoint_id, CASE WHEN reason IS NULL THEN array_to_string(chain, ',') END AS ids, reason, unordered FROM result")
def check_chains(spark, d):
    checks, precedence = facts(spark, d, "checks", "precedence")
    ids = F.array_join(F.transform("chain", lambda x: x["id"]), ",")
    return synthesis.chains(checks, precedence).select("service", "endpoint_id", F.when(F.col("reason").isNull(), ids).alias("ids"), "reason", "unordered")


@query(f"""{_ORDER}, k AS (SELECT service, endpoint_id, words, chain, unnest(range(1, len(chain) + 2)) AS i FROM result WHERE reason IS NULL)
SELECT service, endpoint_id, chain[i] AS id, array_to_string(list_concat(words[:i - 1], CASE WHEN i <= len(chain) THEN ['NOT (' || words[i] || ')'] ELSE [] END), ' AND ') AS guard FROM k""")
def chain_guards(spark, d):
    return synthesis.chain_guards(synthesis.chains(*facts(spark, d, "checks", "precedence")))


_VARIANTS = "SELECT service, endpoint_id, id, CAST(length(expression) % 6 AS INT) AS n FROM {checks} WHERE place IS NULL OR place <> 2"


@query(f"""{_ORDER}, v AS (SELECT c.service, c.endpoint_id, greatest(coalesce(n, 2), 2)::DOUBLE AS n FROM checks c LEFT JOIN ({_VARIANTS.format(checks="checks")}) USING (service, endpoint_id, id))
SELECT service, endpoint_id, CASE WHEN reason IS NULL THEN sum(n - 1) + 1 ELSE product(n) END AS bounded, product(n) AS product, reason IS NOT NULL AS exploded, reason FROM v JOIN result USING (service, endpoint_id) GROUP BY service, endpoint_id, reason""")
def chain_costs(spark, d):
    """Unresolved orders cost the product of all variants."""
    checks, precedence = facts(spark, d, "checks", "precedence")
    return synthesis.chain_cost(synthesis.chains(checks, precedence), spark.sql(_VARIANTS, checks=checks))


# synthesis
_LABEL = "list_aggregate(list_transform(list_filter(regexp_split_to_array({}, '{}'), lambda p: p <> ''), lambda p: upper(p[1]) || p[2:]), 'string_agg', '')"
_RES = "CASE WHEN regexp_replace(regexp_replace({0}, '/\\{{.*', ''), '/+$', '') = '' THEN '/' ELSE regexp_replace(regexp_replace({0}, '/\\{{.*', ''), '/+$', '') END"
_STATE = f"coalesce({_LABEL.format('coalesce(lower(verb) || chr(32) || path, discriminator, chr(32))', '[^A-Za-z0-9]+')}, 'Outcome') || coalesce(status, 0)"
_MODEL = f"""{_cte("endpoints", "checks", "outcomes", "members", "mappings")},
oc AS (SELECT *, regexp_replace(endpoint_id, '::[^:]*$', '') AS handler FROM outcomes), eps AS (SELECT DISTINCT service, endpoint_id, handler FROM oc),
es AS (SELECT service, exception, CASE WHEN min(status) = max(status) THEN min(status) END AS status FROM mappings GROUP BY ALL),
con AS (SELECT service, type_name, count(*) AS n FROM members WHERE len(constraints) > 0 GROUP BY ALL),
pv AS (SELECT e.service, e.handler, es.status AS raised, CASE WHEN NOT validated THEN 'not validated' WHEN coalesce(body_type, '') = '' THEN 'no body' WHEN con.n IS NULL THEN 'no constraints' WHEN es.status IS NULL THEN 'no status of the exception' END AS why FROM endpoints e
  LEFT JOIN con ON con.service = e.service AND con.type_name = split_part(body_type, '.', 2) LEFT JOIN es ON es.service = e.service AND es.exception = 'MethodArgumentNotValidException'),
sc AS (SELECT m.*, eps.endpoint_id FROM mappings m JOIN endpoints e ON e.service = m.service AND e.handler_type = m.advice JOIN eps ON eps.service = e.service AND eps.handler = e.handler WHERE m.status NOT BETWEEN 200 AND 299),
de AS (SELECT service, endpoint_id, status FROM oc WHERE discriminator = 'declared' AND status IS NOT NULL UNION SELECT service, endpoint_id, status FROM sc),
bu AS (SELECT DISTINCT service, endpoint_id, status FROM oc WHERE status IS NOT NULL AND discriminator IS DISTINCT FROM 'declared'),
op AS (SELECT service, endpoint_id, min(status) AS status, string_agg(status, ',' ORDER BY status::VARCHAR) AS all_, count(*) AS n FROM (SELECT * FROM de WHERE status NOT BETWEEN 200 AND 299 EXCEPT SELECT * FROM bu) GROUP BY ALL),
ca AS (SELECT service, endpoint_id, list_sort(list_distinct(list(exception) FILTER (exception <> 'MethodArgumentNotValidException'))) AS cs, list_distinct(list(response_body) FILTER (response_body <> '')) AS bs FROM sc GROUP BY ALL),
rj0 AS (SELECT op.*, eps.handler, e.verb, e.path, e.service IS NOT NULL AS known, coalesce(pv.why IS NULL AND pv.raised = op.status, false) AS valid, pv.why, pv.raised, coalesce(len(ca.cs), 0) AS nc, ca.cs, CASE WHEN len(bs) = 1 THEN bs[1] ELSE '' END AS body
  FROM op JOIN eps USING (service, endpoint_id) LEFT JOIN endpoints e ON e.service = op.service AND e.handler = eps.handler LEFT JOIN pv ON pv.service = op.service AND pv.handler = eps.handler LEFT JOIN ca ON ca.service = op.service AND ca.endpoint_id = op.endpoint_id),
rj AS (SELECT *, 'rejected' AS discriminator, CASE WHEN valid THEN 'payload_valid' WHEN nc = 1 THEN 'NOT (' || cs[1] || ' is thrown)' ELSE 'request_accepted' END AS yes, CASE WHEN valid THEN 'NOT (payload_valid)' WHEN nc = 1 THEN cs[1] || ' is thrown' ELSE 'NOT (request_accepted)' END AS no, CASE WHEN valid THEN 'derived-validation' WHEN nc = 1 THEN 'advice-scope' ELSE 'declared' END AS claim FROM rj0 WHERE known),
bt AS (SELECT o.service, o.seq, o.endpoint_id, o.status, {_STATE.replace("discriminator", "o.discriminator").replace("status", "o.status")} AS target, CASE WHEN path IS NULL THEN split_part(o.endpoint_id, '::', 2) ELSE verb || ' ' || path END AS trigger_,
  concat_ws(' AND ', rj.yes, CASE WHEN sense = '!' THEN 'NOT (' || expression || ')' ELSE expression END) AS guard, 'constructed' AS claim, CASE WHEN o.status IN (204, 304) THEN '' ELSE coalesce(e.response_body, '') END AS body
  FROM oc o LEFT JOIN (SELECT service, handler, verb, path, response_body FROM endpoints) e USING (service, handler) LEFT JOIN (SELECT DISTINCT service, id, expression FROM checks) c ON c.service = o.service AND c.id = o.chk LEFT JOIN (SELECT service, endpoint_id, yes FROM rj) rj ON rj.service = o.service AND rj.endpoint_id = o.endpoint_id WHERE o.discriminator IS DISTINCT FROM 'declared'),
al AS (SELECT * FROM bt UNION ALL SELECT service, 4611686018427387904, endpoint_id, status, {_STATE}, verb || ' ' || path, no, claim, body FROM rj),
m0 AS (SELECT service, endpoint_id || '->' || target AS id, endpoint_id, trigger_, target, guard, status AS outcome_status, claim, body AS response_body, regexp_extract(trigger_, '^\\S* (.*)$', 1) AS path FROM (SELECT *, row_number() OVER (PARTITION BY service, endpoint_id, target ORDER BY seq DESC) AS k FROM al) WHERE k = 1),
m AS MATERIALIZED (SELECT *, CASE WHEN path <> '' THEN {_RES.format("path")} END AS r, CASE WHEN path = '' THEN 'Ready' ELSE {_LABEL.format(_RES.format("path"), "[/_-]")} END AS source FROM m0)"""


def _model(spark, d):
    return synthesis.synthesise(*facts(spark, d, "endpoints", "outcomes", "checks", "members", "mappings", repeated=True))


@query(f"""WITH {_MODEL} SELECT service, id, source, trigger_ AS "trigger", target, guard, outcome_status, claim, response_body FROM m""")
def synthesised_transitions(spark, d):
    return _model(spark, d)[1].select("service", "id", "source", "trigger", "target", "guard", "outcome_status", "claim", "response_body")


@query(f"""WITH {_MODEL} SELECT service, endpoint_id AS subject, 'several-rejections' AS kind, all_ AS detail FROM rj0 WHERE n > 1 UNION ALL SELECT service, endpoint_id, 'endpoint-unknown', status::VARCHAR FROM rj0 WHERE NOT known
UNION ALL SELECT service, endpoint_id, 'no-validation', coalesce(why, 'the exception has status ' || raised) FROM rj0 WHERE known AND NOT valid UNION ALL SELECT service, endpoint_id, 'several-causes', array_to_string(cs, ',') FROM rj0 WHERE known AND NOT valid AND nc > 1
UNION ALL SELECT DISTINCT m.service, exception, 'estate-wide', status || ' ' || advice FROM mappings m WHERE status NOT BETWEEN 200 AND 299 AND NOT EXISTS (SELECT 1 FROM endpoints e WHERE e.service = m.service AND e.handler_type = m.advice)
UNION ALL SELECT service, exception, 'contested', '' FROM es WHERE status IS NULL UNION ALL SELECT DISTINCT service, handler, 'nothing-derived', 'no outcome was recovered' FROM endpoints e WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.service = e.service AND regexp_replace(m.endpoint_id, '::[^:]*$', '') = e.handler)
UNION ALL SELECT service, id, 'unguarded', '' FROM m WHERE guard = ''""")
def synthesis_findings(spark, d):
    return _model(spark, d)[2]


_UNFOLDED = f"""{_MODEL},
atoms AS (SELECT *, list_filter(list_transform(regexp_split_to_array(guard, '\\s+AND\\s+'), lambda a: trim(a)), lambda a: a <> '') AS atoms FROM m),
ps AS (SELECT *, list_filter(atoms, lambda a: regexp_matches(a, '^(?:NOT\\s*\\()?\\s*[A-Za-z_][\\w.]*\\.(isEmpty|isPresent)\\(\\)\\s*\\)?$'))[1] AS atom, trigger_ LIKE 'P%' AND outcome_status BETWEEN 200 AND 299 AND r IS NOT NULL AS creates FROM atoms),
pr AS (SELECT *, CASE WHEN atom IS NOT NULL THEN (atom LIKE 'NOT%') = (atom LIKE '%isEmpty%') END AS present FROM ps),
rs AS (SELECT service, r FROM pr WHERE r IS NOT NULL GROUP BY ALL HAVING bool_or(coalesce(creates, false)) AND bool_or(coalesce(present, false))),
u0 AS (SELECT pr.*, rs.r IS NOT NULL AS open_, {_LABEL.format("pr.r", "[/_-]")} AS label, array_to_string(list_filter(atoms, lambda a: a <> atom), ' AND ') AS rest FROM pr LEFT JOIN rs ON rs.service = pr.service AND rs.r = pr.r),
un AS MATERIALIZED (SELECT service, id, r, trigger_, outcome_status, coalesce(present, false) AND NOT open_ AS stuck, coalesce(NOT present, false) AND open_ AND source = label AS own, CASE WHEN present AND open_ THEN label || 'Present' ELSE source END AS source, CASE WHEN creates AND open_ THEN label || 'Present' ELSE target END AS target,
  CASE WHEN open_ AND (present OR NOT present AND source = label) THEN rest ELSE guard END AS guard FROM u0)"""


@query(f"""WITH {_UNFOLDED} SELECT service, id, source, trigger_ AS "trigger", target, guard, outcome_status, stuck AS source_unresolved FROM un""")
def unfolded_transitions(spark, d):
    return synthesis.unfold(None, _model(spark, d)[1])[1].select("service", "id", "source", "trigger", "target", "guard", "outcome_status", "source_unresolved")


@query(f"""WITH {_UNFOLDED}, names AS (SELECT service, source AS state FROM un UNION SELECT service, target FROM un UNION SELECT service, source FROM m), said AS (SELECT service, source AS state, min('no ' || list_aggregate(list_filter(regexp_split_to_array(lower(r), '[/_-]'), lambda p: p <> ''), 'string_agg', ' ') || ' exists') AS condition FROM un WHERE own GROUP BY ALL)
SELECT service, state, EXISTS (SELECT 1 FROM m WHERE m.service = names.service AND m.source = names.state) AS is_initial, coalesce(condition, '') AS condition FROM names LEFT JOIN said USING (service, state)""")
def unfolded_states(spark, d):
    return synthesis.unfold(None, _model(spark, d)[1])[0]


# evidence
_ID = lambda prefix, *parts: f"'{prefix}:' || sha256(concat_ws('|', {', '.join(f'coalesce(({p})::VARCHAR, {chr(39)}{chr(39)})' for p in parts)}))[:16]"
_EVIDENCE = f"""{_cte("endpoints", "security", "checks", "outcomes", "members", "mappings")},
ep AS (SELECT *, {_ID("ep", "service", "verb", "path")} AS eid, handler || '::' || verb AS endpoint_id FROM endpoints), bi AS (SELECT service, endpoint_id, min(eid) AS e FROM ep GROUP BY ALL),
se AS (SELECT s.service, s.handler || '::' || s.verb AS endpoint_id, e, {_ID("sec", "s.service", "coalesce(e, s.handler || '::' || s.verb)", "scheme", "expression")} AS sid FROM security s LEFT JOIN bi ON bi.service = s.service AND bi.endpoint_id = s.handler || '::' || s.verb WHERE scheme <> ''),
cl AS (SELECT DISTINCT service, owner, split_part(owner, '.', 2) AS simple, {_ID("cls", "service", "owner")} AS cid, CASE WHEN owner_is_enum THEN 'Enum' ELSE 'Class' END AS label FROM members),
si AS (SELECT service, simple, min(owner) AS owner FROM cl GROUP BY ALL HAVING count(*) = 1),
fi AS (SELECT DISTINCT m.service, c.cid, c.label, m.type, m.element_type, coalesce(a.cid, b.cid) AS tid, coalesce(a.label, b.label) AS tlabel FROM members m JOIN cl c ON c.service = m.service AND c.owner = m.owner LEFT JOIN cl a ON a.service = m.service AND a.owner = m.type LEFT JOIN si ON si.service = m.service AND si.simple = m.element_type LEFT JOIN cl b ON b.service = m.service AND b.owner = si.owner),
pa AS (SELECT DISTINCT service, eid, w FROM (SELECT service, eid, unnest(list_concat(regexp_extract_all(coalesce(body_type, ''), '[A-Za-z_][A-Za-z0-9_.]*'), regexp_extract_all(coalesce(response_body, ''), '[A-Za-z_][A-Za-z0-9_.]*'))) AS w FROM ep)),
ck AS (SELECT *, {_ID("chk", "service", "id", "expression")} AS kid FROM checks),
oc AS (SELECT o.*, e, {_ID("out", "o.service", "o.endpoint_id", "status", "discriminator", "chk", "sense")} AS oid FROM outcomes o LEFT JOIN bi USING (service, endpoint_id)),
us AS (SELECT DISTINCT oc.service, oid, chk, kid FROM oc LEFT JOIN ck ON ck.service = oc.service AND ck.id = oc.chk),
lo AS (SELECT ck.service, kid, endpoint_id, e FROM ck LEFT JOIN bi USING (service, endpoint_id) WHERE NOT EXISTS (SELECT 1 FROM us WHERE us.service = ck.service AND us.chk = ck.id))"""


def _references(spark, d):
    return evidence.references(*facts(spark, d, "endpoints", "security", "members", "checks", "outcomes", repeated=True))


@query(f"""WITH {_EVIDENCE} SELECT DISTINCT * FROM (SELECT service, e AS src, 'Endpoint' AS src_label, 'SECURED_BY' AS rel_type, sid AS dst, 'SecurityScheme' AS dst_label FROM se WHERE e IS NOT NULL UNION ALL SELECT service, cid, label, 'OF_TYPE', tid, tlabel FROM fi WHERE tid <> cid
UNION ALL SELECT service, e, 'Endpoint', 'DECLARES', oid, 'DeclaredOutcome' FROM oc WHERE e IS NOT NULL UNION ALL SELECT service, oid, 'DeclaredOutcome', 'GUARDED_BY', kid, 'Check' FROM us WHERE kid IS NOT NULL UNION ALL SELECT service, e, 'Endpoint', 'CONSTRAINED_BY', kid, 'Check' FROM lo WHERE e IS NOT NULL)""")
def evidence_edges(spark, d):
    return _references(spark, d)[0]


@query(f"""WITH {_EVIDENCE} SELECT service, id, label, min(name) AS name FROM (SELECT service, eid AS id, 'Endpoint' AS label, verb || ' ' || path AS name FROM ep UNION ALL SELECT service, sid, 'SecurityScheme', 'role' FROM se UNION ALL SELECT service, cid, label, simple FROM cl
UNION ALL SELECT service, {_ID("exm", "service", "exception", "advice")}, 'ExceptionMapping', exception || ' ' || status FROM mappings UNION ALL SELECT service, kid, 'Check', expression FROM ck UNION ALL SELECT service, oid, 'DeclaredOutcome', concat_ws(' ', endpoint_id, status) FROM oc) GROUP BY ALL""")
def evidence_nodes(spark, d):
    return evidence.fact_nodes(*facts(spark, d, "endpoints", "security", "members", "mappings", "checks", "outcomes")).drop("props")


@query(f"""WITH {_EVIDENCE} SELECT DISTINCT * FROM (SELECT service, sid AS id, 'SECURED_BY' AS rel_type, endpoint_id AS wanted, 'no such endpoint' AS reason FROM se WHERE e IS NULL UNION ALL SELECT service, cid, 'OF_TYPE', CASE WHEN element_type <> '' THEN element_type ELSE type END, 'not one declared type' FROM fi WHERE tid IS NULL
UNION ALL SELECT pa.service, eid, 'PAYLOAD', w, 'not one declared type' FROM pa WHERE NOT EXISTS (SELECT 1 FROM cl WHERE cl.service = pa.service AND cl.owner = w) AND NOT EXISTS (SELECT 1 FROM si WHERE si.service = pa.service AND si.simple = split_part(w, '.', -1))
UNION ALL SELECT service, oid, 'DECLARES', endpoint_id, 'no such endpoint' FROM oc WHERE e IS NULL UNION ALL SELECT service, oid, 'GUARDED_BY', chk, 'no such check' FROM us WHERE kid IS NULL UNION ALL SELECT service, kid, 'CONSTRAINED_BY', endpoint_id, 'no such endpoint' FROM lo WHERE e IS NULL)""")
def evidence_unresolved(spark, d):
    """References to what was not extracted: none is dropped."""
    return _references(spark, d)[1]


# techniques
_CONSTRAINT = "CASE hi % 5 WHEN 0 THEN '@Size(max=' || lo || ')' WHEN 1 THEN '@NotNull' WHEN 2 THEN '@Min(' || lo || ')' WHEN 3 THEN '@Digits(integer=' || lo || ', fraction=2)' ELSE 'unreadable ' || lo END"


@query(f"""WITH {GM}, g AS (SELECT model_id, id, guard, lo, hi, {_CONSTRAINT} AS con, CASE lo % 8 WHEN 3 THEN ['ok', 'late'] WHEN 4 THEN ['ok', 'late'] WHEN 5 THEN ['ok'] WHEN 6 THEN ['ok OR late'] WHEN 7 THEN ['(late', 'ok)'] ELSE [] END AS plain, CASE lo % 8 WHEN 3 THEN ['ok', 'NOT (late)'] WHEN 5 THEN ['NOT (ok)'] WHEN 4 THEN ['ok', 'late'] WHEN 6 THEN ['ok OR late'] WHEN 7 THEN ['(late', 'ok)'] ELSE [] END AS parts FROM gm WHERE generatable),
p AS (SELECT *, unnest(plain) AS x, unnest(parts) AS raw FROM g), off(d) AS (VALUES (-1), (0), (1))
SELECT model_id, id, 'boundary' AS kind, id || '::<unguarded>' AS key, NULL AS reason FROM g WHERE guard = '' UNION SELECT model_id, id, 'boundary', id || '::k = ' || (hi + d), NULL FROM g, off WHERE lo % 8 IN (1, 2)
UNION SELECT model_id, id, 'partition', id || '::partition::k ' || s || ' ' || hi, NULL FROM g, (VALUES ('<'), ('>=')) v(s) WHERE lo % 8 IN (1, 2) UNION SELECT model_id, id, 'partition', id || '::partition::' || x, NULL FROM p UNION SELECT model_id, id, 'partition', id || '::partition::NOT (' || x || ')', NULL FROM p
UNION SELECT model_id, id, 'boundary', id || '::' || raw || '::boundary', 'not a numeric threshold' FROM p UNION SELECT model_id, id, 'partition', id || '::constraint::' || s || ' ' || CASE WHEN con LIKE '@%' THEN string_split(con, '(')[1] ELSE con END, NULL FROM g, (VALUES ('satisfies'), ('violates')) v(s) WHERE guard <> ''
UNION SELECT model_id, id, 'boundary', id || '::constraint::' || CASE hi % 5 WHEN 0 THEN 'length' ELSE 'value' END || ' = ' || (lo + d), NULL FROM g, off WHERE guard <> '' AND hi % 5 IN (0, 2)""")
def boundary_targets(spark, d):
    """Values and partitions of guards and of what inputs declare; parts without a boundary stay with the reason."""
    lo, k = F.col("lo").cast("string"), F.col("hi") % 5
    con = F.when(k == 0, F.concat(F.lit("@Size(max="), lo, F.lit(")"))).when(k == 1, "@NotNull").when(k == 2, F.concat(F.lit("@Min("), lo, F.lit(")"))).when(k == 3, F.concat(F.lit("@Digits(integer="), lo, F.lit(", fraction=2)"))).otherwise(F.concat(F.lit("unreadable "), lo))
    return techniques.boundary_targets(guarded(spark, d).where("generatable").withColumn("constraints", F.array(con, con)))


_INPUTS = "SELECT l_orderkey AS k, l_linenumber AS place, min(l_returnflag) <> 'N' AS required, CASE WHEN min(l_linestatus) = 'F' THEN '@Max(' || max(l_suppkey) || ')' ELSE '' END AS con FROM {lineitem} GROUP BY l_orderkey, l_linenumber"


def _factors(spark, d):
    rows = spark.sql(_INPUTS, lineitem=table(spark, d, "lineitem"))
    return techniques.factors(rows.select("k", "place", F.concat(F.lit("in"), F.col("place").cast("string")).alias("name"), "required", F.array("con").alias("constraints")), ["k"])


@query(f"""WITH RECURSIVE inp AS ({_INPUTS.format(lineitem="lineitem")}), f AS (SELECT k, place, 'in' || place AS name, CASE WHEN required AND con <> '' THEN ['satisfies ' || con, 'violates ' || con] ELSE ['supplied', 'omitted'] END AS levels, row_number() OVER (PARTITION BY k ORDER BY place) - 1 AS i FROM inp),
n AS (SELECT k, count(*) AS n FROM f GROUP BY k), shapes AS (SELECT DISTINCT n FROM n WHERE n > 1),
pairs AS (SELECT s.n, list(struct_pack(a := 2 * i + x, b := 2 * j + y) ORDER BY i, j, x, y) AS l FROM shapes s, range(13) r(i), range(13) q(j), range(2) u(x), range(2) v(y) WHERE i < j AND j < s.n GROUP BY s.n),
w AS (SELECT n, l AS open_, list_transform(range(n), lambda p: CASE p WHEN l[1].a // 2 THEN l[1].a WHEN l[1].b // 2 THEN l[1].b ELSE -1 END) AS c, 0::BIGINT AS i, 0 AS case_no, false AS done FROM pairs
  UNION ALL SELECT n, CASE WHEN full_ THEN rest ELSE open_ END, CASE WHEN full_ THEN list_transform(range(n), lambda p: CASE p WHEN rest[1].a // 2 THEN rest[1].a WHEN rest[1].b // 2 THEN rest[1].b ELSE -1 END) ELSE nxt END, CASE WHEN full_ THEN 0 ELSE i + 1 END, CASE WHEN full_ THEN case_no + 1 ELSE case_no END, full_
  FROM (SELECT *, i = n AS full_, list_filter(open_, lambda p: NOT (list_contains(c, p.a) AND list_contains(c, p.b))) AS rest, CASE WHEN i < n AND c[i + 1] < 0 THEN list_transform(range(n), lambda q: CASE WHEN q = i THEN 2 * i + CASE WHEN len(list_filter(open_, lambda p: p.a = 2 * i + 1 AND list_contains(c, p.b) OR p.b = 2 * i + 1 AND list_contains(c, p.a))) > len(list_filter(open_, lambda p: p.a = 2 * i AND list_contains(c, p.b) OR p.b = 2 * i AND list_contains(c, p.a))) THEN 1 ELSE 0 END ELSE c[q + 1] END) ELSE c END AS nxt FROM w WHERE len(open_) > 0)),
cs AS (SELECT n, case_no, c FROM w WHERE i = n AND len(open_) > 0)
SELECT f.k, cs.case_no::INT AS case_no, f.name, f.levels[c[f.i + 1] % 2 + 1] AS level FROM f JOIN n USING (k) JOIN cs ON cs.n = n.n UNION ALL SELECT f.k, x::INT, name, levels[x + 1] FROM f JOIN n ON n.k = f.k AND n.n = 1, range(2) r(x)""")
def pairwise_cases(spark, d):
    """All pairs of the levels of each order's inputs: one input for each of its line numbers."""
    return techniques.pairwise(_factors(spark, d), ["k"])


# captured sources
@query("""SELECT source AS folder, sum(1 + length(x) - length(replace(x, chr(10), '')))::BIGINT AS lines, sum(strlen(x) + 1)::BIGINT AS bytes FROM (SELECT source, coalesce(text, '') AS x FROM documents) WHERE source LIKE 'src1%' GROUP BY 1""")
def checkout_lines(spark, d):
    """The documents written as the files of a checkout, a folder a source, and read back by folder."""
    captured.register(spark)
    root = graph.scratch(table(spark, d, "documents"))
    table(spark, d, "documents").select("source", F.coalesce("text", F.lit("")).alias("value")).write.partitionBy("source").option("maxRecordsPerFile", 500).text(root)
    files = spark.read.format("checkout").option("path", root).load().where(F.col("folder").startswith("source=src1") & (F.col("extension") == "txt"))
    n = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    return files.groupBy(F.substr("folder", F.lit(8)).alias("folder")).agg(F.sum(n).cast("long").alias("lines"), F.sum("size").alias("bytes"))


_TYPE = ["Story", "Bug", "New Feature", "Spike", "sub-task"]
_STATE = ["To Do", "In Review", "Awaiting Signoff", "Done", "On Hold", ""]
_PRIO = ["P0", "Trivial", "moderate", "soon", ""]


def _pick(key, values):
    return f"CASE {key} % {len(values)} {' '.join(f'WHEN {i} THEN {chr(39)}{v}{chr(39)}' for i, v in enumerate(values))} END"


@query(f"""SELECT lang || ':D-' || doc_id AS id, CASE doc_id % 5 WHEN 0 THEN 'story' WHEN 1 THEN 'defect' WHEN 2 THEN 'feature' ELSE 'task' END AS primary_type, CASE doc_id % 6 WHEN 0 THEN 'draft' WHEN 1 THEN 'active' WHEN 3 THEN 'completed' WHEN 4 THEN 'deferred' END AS summary_status,
CASE (doc_id // 7) % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'optional' WHEN 2 THEN 'medium' END AS priority, CASE WHEN doc_id % 6 < 5 THEN {_pick("doc_id", _STATE)} END AS observed, source AS labels, length(text)::INT AS description FROM documents WHERE lang IN ('de', 'fr')""")
def tracker_intake(spark, d):
    """Documents as captured tracker pages of fifty items, a system a language; two systems are read, as intake documents."""
    captured.register(spark)
    docs = table(spark, d, "documents")
    pick = lambda key, values: F.get(F.array(*map(F.lit, values)), F.expr(f"cast({key} % {len(values)} as int)"))
    named = lambda c: F.struct(c.alias("name"))
    fields = F.struct(F.col("source").alias("summary"), F.col("text").alias("description"), named(pick("doc_id", _TYPE)).alias("issuetype"), named(pick("doc_id", _STATE)).alias("status"), named(pick("(doc_id div 7)", _PRIO)).alias("priority"), F.array("source", "source").alias("labels"))
    pages = docs.groupBy(F.col("lang").alias("system"), F.expr("doc_id div 50").alias("page")).agg(F.collect_list(F.struct(F.concat(F.lit("D-"), F.col("doc_id").cast("string")).alias("key"), fields.alias("fields"))).alias("issues"))
    root = graph.scratch(docs)
    pages.select("system", "issues").write.partitionBy("system").json(root)
    items = spark.read.format("tracker_pages").option("path", root).load().where(F.col("system").isin("de", "fr"))
    out = captured.intake_documents(items, "2024-01-01T00:00:00Z")
    return out.select("id", "scope.primary_type", "metadata.status.summary_status", "metadata.priority", F.get("facts", F.lit(0))["value"].alias("observed"), F.array_join("metadata.labels", ",").alias("labels"), F.length("metadata.description").alias("description"))


# history
@query("""WITH k AS (SELECT l_orderkey % 200 AS model_id, l_partkey % 40 AS key, l_linestatus = 'F' AS is_old, l_orderkey * 100 + l_linenumber * 10 + l_suppkey % 10 AS id, 'S' || (l_partkey % 4) AS source, 't' || (l_partkey % 8) AS tr, CASE WHEN l_suppkey % 3 = 0 THEN 'Rejected' ELSE 'Approved' END AS life, 'g' || (l_quantity > 2) AS guard, l_returnflag AS name FROM lineitem),
u AS (SELECT model_id, key, is_old, source, tr, min(id) AS id FROM k GROUP BY ALL), v AS (SELECT u.*, max(life) AS life, max(guard) AS guard, max(name) AS name FROM u JOIN k USING (model_id, key, is_old, id) GROUP BY ALL),
d AS (SELECT coalesce(o.model_id, n.model_id) AS model_id, coalesce(o.key, n.key) AS key, o.key IS NOT NULL AND n.key IS NOT NULL AS both_, o.key IS NULL OR n.key IS NULL OR o.guard <> n.guard OR o.name <> n.name AS changed, o.guard <> n.guard AS loud, o.life FROM (SELECT * FROM v WHERE is_old) o FULL JOIN (SELECT * FROM v WHERE NOT is_old) n ON o.model_id = n.model_id AND o.key = n.key),
gr AS (SELECT DISTINCT v.model_id, source, tr FROM v JOIN d ON d.model_id = v.model_id AND d.key = v.key AND changed)
SELECT v.model_id, v.key, CASE WHEN NOT both_ THEN 'Quarantine' WHEN d.life = 'Approved' AND (loud OR gr.tr IS NOT NULL) THEN 'Quarantine' ELSE d.life END AS lifecycle, both_ AS carried, CASE WHEN both_ AND d.life = 'Approved' THEN CASE WHEN loud THEN 'behaviour changed' WHEN gr.tr IS NOT NULL THEN 'group was disturbed' END END AS revoked
FROM v JOIN d ON d.model_id = v.model_id AND d.key = v.key LEFT JOIN gr ON gr.model_id = v.model_id AND gr.source = v.source AND gr.tr = v.tr WHERE NOT is_old""")
def carried_facts(spark, d):
    """Shipped lines stand for an earlier model, open ones for what was extracted anew."""
    rows = table(spark, d, "lineitem").select((F.col("l_orderkey") % 200).alias("model_id"), (F.col("l_partkey") % 40).alias("key"), (F.col("l_orderkey") * 100 + F.col("l_linenumber") * 10 + F.col("l_suppkey") % 10).alias("id"), F.concat(F.lit("S"), (F.col("l_partkey") % 4).cast("string")).alias("source"), F.concat(F.lit("t"), (F.col("l_partkey") % 8).cast("string")).alias("trigger"),
                                              F.when(F.col("l_suppkey") % 3 == 0, "Rejected").otherwise("Approved").alias("lifecycle"), F.concat(F.lit("g"), (F.col("l_quantity") > 2).cast("string")).alias("guard"), F.col("l_returnflag").alias("name"), (F.col("l_linestatus") == "F").alias("old"))
    same = ["model_id", "key", "old", "source", "trigger"]
    one = rows.join(rows.groupBy(*same).agg(F.min("id").alias("id")), [*same, "id"]).groupBy(*same, "id").agg(*(F.max(c).alias(c) for c in ("lifecycle", "guard", "name")))
    new = one.where("not old").drop("old").withColumn("lifecycle", F.lit("Quarantine"))
    return carry.transitions(one.where("old").drop("old"), new, ["guard", "name"]).select("model_id", "key", "lifecycle", "carried", "revoked")


@query("""WITH RECURSIVE e AS (SELECT user_id AS m, event_type AS id, event_id AS seq, CAST(props->>'$.k' AS INT) AS k FROM events), l AS (SELECT *, CASE WHEN k % 4 = 0 THEN 'add' WHEN k % 4 = 1 THEN 'remove' ELSE 'modify' END AS op, CASE WHEN k % 3 = 0 THEN 'source' ELSE 'guard' END AS prop, CASE WHEN k % 5 > 0 THEN 'v' || (k % 7) END AS val, row_number() OVER (PARTITION BY m, id ORDER BY seq) AS n FROM e),
s AS (SELECT DISTINCT m, id, (m + length(id)) % 2 = 0 AS there, CASE WHEN (m + length(id)) % 2 = 0 THEN 'v1' END AS src, CASE WHEN (m + length(id)) % 2 = 0 THEN 'v2' END AS grd FROM e),
w AS (SELECT m, id, 0::BIGINT AS n, there, src, grd, false AS touched FROM s UNION ALL SELECT w.m, w.id, l.n, CASE op WHEN 'add' THEN true WHEN 'remove' THEN false ELSE there END, CASE WHEN op = 'add' AND NOT there THEN val WHEN op = 'modify' AND there AND prop = 'source' THEN val ELSE src END,
  CASE WHEN op = 'add' AND NOT there THEN NULL WHEN op = 'modify' AND there AND prop = 'guard' THEN val ELSE grd END, touched OR (op = 'add') <> there FROM w JOIN l ON l.m = w.m AND l.id = w.id AND l.n = w.n + 1)
SELECT m AS model_id, id, CASE WHEN touched THEN 'Quarantine' ELSE 'Approved' END AS lifecycle, src AS "source", grd AS guard FROM w WHERE there AND n = (SELECT max(x.n) FROM w x WHERE x.m = w.m AND x.id = w.id)""")
def override_replay(spark, d):
    """Every event is an edit of its user's element of that type; half of the elements are in the source."""
    k = F.col("k")
    e = table(spark, d, "events").select(F.col("user_id").alias("model_id"), F.lit("transition").alias("kind"), F.col("event_type").alias("id"), F.col("event_id").alias("seq"), F.get_json_object("props", "$.k").cast("int").alias("k"))
    value = F.when(k % 5 > 0, F.concat(F.lit("v"), (k % 7).cast("string")))
    log = e.select("model_id", "kind", "id", "seq", F.when(k % 4 == 0, "add").when(k % 4 == 1, "remove").otherwise("modify").alias("operation"), F.when(k % 3 == 0, "source").otherwise("guard").alias("prop"), F.lit("v1").alias("previous_value"), value.alias("new_value"), F.create_map(F.lit("source"), value).alias("payload"), F.lit("ann").alias("author"))
    there = e.select("model_id", "kind", "id").distinct().where((F.col("model_id") + F.length("id")) % 2 == 0)
    elements = there.select("*", F.lit("Approved").alias("lifecycle"), F.create_map(F.lit("source"), F.lit("v1"), F.lit("guard"), F.lit("v2")).alias("props"))
    return overrides.replay(elements, log).select("model_id", "id", "lifecycle", F.try_element_at("props", F.lit("source")).alias("source"), F.try_element_at("props", F.lit("guard")).alias("guard"))
