"""Queries of filters, text functions, risk, workflow, surfaces and intake over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from statewake.functions import texts
from statewake.operators import filters, matching, risk, surfaces, workflow
from statewake.plans.machine import steps, table
from statewake.plans.registry import query
from statewake.sources import intake


def _cases(key: str, values: list):
    """A column of one of several values by a key, over all rows."""
    return F.get(F.array(*map(F.lit, values)), (F.col(key) % len(values)).cast("int"))


def _sql(key: str, values: list) -> str:
    quote = lambda v: "NULL" if v is None else "'" + str(v).replace("'", "''") + "'"
    return f"CASE {key} % {len(values)} {' '.join(f'WHEN {i} THEN {quote(v)}' for i, v in enumerate(values))} END"


# filters
@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def scope_filter(spark, d):
    return table(spark, d, "orders").where(filters.in_scope(F.array("o_orderstatus", F.lit("all")), "F", F.col("o_orderpriority"), "1-URGENT")).select("o_orderkey")


@query("SELECT p_partkey, p_type IN ('PROMO', 'ECONOMY', 'STANDARD') AS is_promo FROM part")
def label_specialisations(spark, d):
    return table(spark, d, "part").select("p_partkey", filters.has_label(F.col("p_type"), "PROMO", {"ECONOMY": "PROMO", "STANDARD": "ECONOMY", "SMALL": "LARGE"}).alias("is_promo"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' OR o_orderpriority < '3'")
def windowed_validity(spark, d):
    end = F.when(F.col("o_orderpriority") < "3", "").otherwise("2020-01-01")
    return table(spark, d, "orders").where(filters.valid_where_it_applies(F.col("o_orderstatus"), end, ("F", "O"))).select("o_orderkey")


@query("SELECT 'state' AS kind, c_custkey AS id FROM customer WHERE c_mktsegment <> 'BUILDING' UNION ALL SELECT 'transition', o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority <> '5-LOW'")
def unapproved_elements(spark, d):
    life = lambda c, yes: F.when(c == yes, "Approved")
    s = table(spark, d, "customer").select(F.lit(1).alias("model_id"), F.col("c_custkey").alias("id"), life(F.col("c_mktsegment"), "BUILDING").alias("lifecycle"))
    t = table(spark, d, "orders").select(F.lit(1).alias("model_id"), F.col("o_orderkey").alias("id"), F.coalesce(life(F.col("o_orderstatus"), "F"), F.when(F.col("o_orderstatus") == "O", "Rejected")).alias("lifecycle"), F.when(F.col("o_orderpriority") == "5-LOW", "planned").otherwise("implemented").alias("status"))
    return filters.unapproved(s, t).select("kind", "id")


@query("SELECT page_id, doc_id::VARCHAR AS suffix FROM pages JOIN documents ON split_part(url, '/', -1) = doc_id::VARCHAR")
def path_suffixes(spark, d):
    ids = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("suffix"))
    return filters.by_suffix(table(spark, d, "pages").select("page_id", "url"), ids, "url", "suffix").select("page_id", "suffix")


@query("SELECT p_partkey, CASE WHEN path LIKE 'src/red/%' THEN 'a' WHEN regexp_matches(path, '^src/[^/]*/widget.py$') OR regexp_matches(path, '^src/s[^/]*/[^/]*$') THEN 'b' END AS owner FROM (SELECT p_partkey, 'src/' || replace(p_name, ' ', '/') || '.py' AS path FROM part)")
def file_owner(spark, d):
    path = F.concat(F.lit("src/"), F.replace("p_name", F.lit(" "), F.lit("/")), F.lit(".py"))
    return table(spark, d, "part").select("p_partkey", filters.owner(path, [("a", ["src/red/**"]), ("b", ["src/*/widget.py", "src/s*/*"])]).alias("owner"))


@query("SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN 'missing:name' || CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY') THEN ',value:segment' ELSE '' END WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY') THEN 'value:segment' ELSE '' END AS errors FROM customer")
def property_rejects(spark, d):
    row = {"name": F.when(F.col("c_nationkey") != 3, F.col("c_name")), "segment": F.col("c_mktsegment")}
    return table(spark, d, "customer").select("c_custkey", F.array_join(filters.property_errors(row, ("name", "segment"), {"segment": ("BUILDING", "MACHINERY")}), ",").alias("errors"))


@query(r"""SELECT event_id, '{"k": ' || (props->>'$.k') || ', "b": {}, "ok": false, "t": "x, \\"n\\": null", "f": {"g": {"h": {"i": {"j": {"l": {"m": {"o": {"p": {}}}}}}}}}, "q": [{}, null, {"s": 1}]}' AS payload, props->>'$.k' AS k FROM events""".replace("\\\\", "\\"))
def pruned_payload(spark, d):
    raw = F.concat(F.lit('{"a": null, "k": '), F.col("k").cast("string"), F.lit(r', "b": {"c": false, "d": ""}, "e": [], "ok": false, "t": "x, \"n\": null", "f": {"g": {"h": {"i": {"j": {"l": {"m": {"o": {"p": {"z": null}}}}}}}}}, "q": [{"r": ""}, null, {"s": 1}], "u": false}'))
    return steps(spark, d).select("event_id", filters.pruned(raw).alias("payload"), texts.dig(raw, "k").alias("k"))


@query("SELECT c_custkey, count(o_orderkey)::INT AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' GROUP BY 1")
def outer_collect(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"), F.struct(F.col("o_orderkey").alias("id")).alias("o"))
    rows = table(spark, d, "customer").join(o, "c_custkey", "left").groupBy("c_custkey").agg(F.collect_list(F.coalesce("o", F.struct(F.lit(None).cast("long").alias("id")))).alias("os"))
    return rows.select("c_custkey", F.size(filters.without_empty(F.col("os"))).alias("orders"))


# texts
@query("SELECT doc_id, strip_accents(text) AS folded FROM documents")
def folded_text(spark, d):
    return table(spark, d, "documents").select("doc_id", texts.fold("text").alias("folded"))


@query("SELECT event_id, event_type || ',id,' || event_type || ',k' || (props->>'$.k') AS parts FROM events")
def identifier_parts(spark, d):
    text = F.concat(F.lit("see "), "event_type", F.lit("_id and "), "event_type", F.lit("_k"), F.col("k").cast("string"), F.lit(" of a__b"))
    return steps(spark, d).select("event_id", F.array_join(texts.identifier_parts(text), ",").alias("parts"))


_TYPES = [("List<Order>", "Order"), ("Optional<List<com.x.Order>>", "com.x.Order"), ("Map<String, Item>", "Item"), ("Order[]", "Order"), ("int", "int"), (" Set< ? extends Base > ", "Base")]
_EXPRESSIONS = [("new com.x.Order(Item.of(a))", "Order,Item"), ("a + b", ""), ("throw new NotFound()", "NotFound"), ("Foo.Foo", "Foo")]
_METHODS = [("findByNameAndAgeGreaterThan", "name:Equals,age:GreaterThan"), ("findAllByStatusInOrOwnerIsNull", "status:In,Or owner:IsNull"), ("countByActiveTrue", "active:True"), ("save", None), ("findByLastNameOrderByAgeDesc", "lastName:Equals"), ("existsByAndroidId", "androidId:Equals")]
_ATOMS = [("t.isEmpty()", "no t exists"), ("user_name != null", "user name is given"), ("attempts >= 5", "attempts is at least 5"), ("Timeout is thrown", "Timeout happens"), ("ready", "ready"), ("x == 3", "x is 3")]


@query(f"SELECT p_partkey, {_sql('p_partkey', [y for _, y in _TYPES])} AS inner_type, {_sql('p_partkey', [y for _, y in _EXPRESSIONS])} AS names, {_sql('p_partkey', [y for _, y in _METHODS])} AS predicates FROM part")
def code_names(spark, d):
    at = lambda xs: _cases("p_partkey", [x for x, _ in xs])
    return table(spark, d, "part").select("p_partkey", texts.unwrap_generic(at(_TYPES)).alias("inner_type"), F.array_join(texts.type_names(at(_EXPRESSIONS)), ",").alias("names"), F.array_join(texts.derived_predicates(at(_METHODS)), ",").alias("predicates"))


@query(f"""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'it is not so that ' ELSE '' END || {_sql('p_partkey', [y for _, y in _ATOMS])} AS wording, 'Given the system is in ' || p_type || CASE WHEN p_size > 25 THEN ' and ready' ELSE '' END || ', when it opens and size is ' || p_size || ', then the system is in ' || p_brand AS criterion,
regexp_replace(p_brand, '[^A-Za-z0-9_]+', '_', 'g') AS diagram_id, 'a ' || p_brand || ' #quot;b#quot;' AS label FROM part""")
def worded_guards(spark, d):
    size = F.concat(F.lit("size is "), F.col("p_size").cast("string"))
    conditions = F.when(F.col("p_size") > 25, F.array(F.lit("ready"), size)).otherwise(F.array(size))
    return table(spark, d, "part").select("p_partkey", texts.worded(_cases("p_partkey", [x for x, _ in _ATOMS]), F.col("p_size") % 2 == 0).alias("wording"), texts.drafted(F.col("p_type"), conditions, F.lit("it opens"), F.col("p_brand")).alias("criterion"), texts.diagram_id(F.col("p_brand")).alias("diagram_id"), texts.diagram_label(F.concat(F.lit(" a\n"), "p_brand", F.lit('  "b"'))).alias("label"))


# matching
def _versions(spark, d):
    e = table(spark, d, "events").crossJoin(F.broadcast(table(spark, d, "events").agg(F.expr("max(event_id) div 2").alias("h"))))
    rows = e.select(F.col("user_id").alias("model_id"), F.concat_ws("|", "event_type", F.date_format("ts", "HH")).alias("key"), F.col("event_id").alias("id"), F.concat(F.lit("(k < "), F.get_json_object("props", "$.k"), F.lit(")")).alias("guard"), (F.col("event_id") > F.col("h")).alias("new"))
    return rows.where("not new").drop("new"), rows.where("new").drop("new")


@query()
def paired_elements(spark, d):
    """Several elements of one key are paired by difflib, which SQL lacks; see tests/test_rules.py for brute force."""
    return matching.pair_by_guard(*_versions(spark, d), ["model_id", "key"])


@query()
def rename_proposals(spark, d):
    old, new = (v.select("model_id", "key").distinct() for v in _versions(spark, d))
    changes = old.join(new, ["model_id", "key"], "left_anti").withColumn("change", F.lit("REMOVED")).unionAll(new.join(old, ["model_id", "key"], "left_anti").withColumn("change", F.lit("ADDED")))
    return matching.rename_proposals(changes, ["model_id"])


_AC = ["POST /orders/{id} returns 422 when the order is cancelled", "the order is cancelled and nothing ships", "GET it", None, "/partsummary is listed together, by area", "a 422x is no status, 4220 neither; 422 is, and 109"]


@query(f"""WITH ac AS (SELECT c_custkey AS ac_id, c_custkey % 6 AS m, c_mktsegment AS area FROM customer), tr AS (SELECT n_nationkey + 100 AS id, n_regionkey AS r, CASE WHEN n_nationkey < 5 THEN 'BUILDING' ELSE 'none' END AS area FROM nation),
p AS (SELECT ac_id, id, concat_ws(',', CASE WHEN m = 0 AND r = 0 OR m = 4 AND r = 1 THEN 'path' END, CASE WHEN m = 0 AND r = 0 OR m IN (2, 4) AND r = 1 THEN 'verb' END, CASE WHEN m IN (0, 5) AND r = 0 OR m = 5 AND id = 109 THEN 'status' END, CASE WHEN m IN (0, 1) AND r = 0 THEN 'state' END, CASE WHEN ac.area = tr.area THEN 'area' END, CASE WHEN m = 0 AND r = 0 THEN 'trigger-words' END) AS signals FROM ac, tr)
SELECT ac_id, id, signals, len(string_split(signals, ','))::INT AS strength FROM p WHERE signals <> ''""")
def evidence_candidates(spark, d):
    ac = table(spark, d, "customer").select(F.col("c_custkey").alias("ac_id"), _cases("c_custkey", _AC).alias("text"), F.array("c_mktsegment").alias("areas"))
    r, pick = F.col("n_regionkey"), lambda a, b, c: F.when(F.col("n_regionkey") == 0, a).when(F.col("n_regionkey") == 1, b).otherwise(c)
    tr = table(spark, d, "nation").select((F.col("n_nationkey") + 100).alias("id"), pick("POST /orders/{id}", "GET /parts", "X").alias("trigger"), pick("/orders/{id}", "/parts", None).alias("route"), F.when(r == 0, "state4221").otherwise("S::none").alias("target"), pick("Order cancelled", "Parts shown", "").alias("target_name"), F.array(F.when(F.col("n_nationkey") < 5, "BUILDING").otherwise("none")).alias("areas"))
    return matching.evidence(ac, tr)


@query("WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders), w AS (SELECT c_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS want FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1), x AS (SELECT rank FROM w LEFT JOIN r ON o_custkey = c_custkey AND o_orderkey = want AND rank <= 5) SELECT count(*)::BIGINT AS total, count(*) FILTER (rank = 1)::BIGINT AS top1, count(*) FILTER (rank <= 3)::BIGINT AS top3, count(*) FILTER (rank IS NULL)::BIGINT AS absent FROM x")
def retrieval_benchmark(spark, d):
    o = table(spark, d, "orders")
    ranks = o.withColumn("rank", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))).where("rank <= 5").select(F.col("o_custkey").alias("question"), F.col("o_orderkey").alias("item"), "rank")
    last = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("want"))
    return matching.benchmark(ranks, table(spark, d, "customer").join(last, "c_custkey", "left").select(F.col("c_custkey").alias("question"), "want"))


@query("""WITH c AS (SELECT s_suppkey AS call_id, CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE 'NATION_' || s_nationkey END AS screen, CASE WHEN s_suppkey % 5 = 0 THEN '/none/' ELSE '/' || s_suppkey || '/' END AS endpoint FROM supplier), u AS (SELECT n_nationkey AS ui_id, 'open ' || n_name || ' list' AS text FROM nation), a AS (SELECT p_partkey AS api_id, '/parts/' || p_partkey AS route FROM part),
x AS (SELECT call_id, screen, endpoint, ui_id, api_id FROM c LEFT JOIN u ON screen <> '' AND contains(text, screen) LEFT JOIN a ON ends_with(route, rtrim(endpoint, '/'))) SELECT call_id, ui_id, api_id, concat_ws(',', CASE WHEN screen <> '' AND ui_id IS NULL THEN 'screen' END, CASE WHEN api_id IS NULL THEN 'endpoint' END) AS unmatched FROM x""")
def link_proposals(spark, d):
    s = F.col("s_suppkey")
    calls = table(spark, d, "supplier").select(s.alias("call_id"), F.when(s % 4 != 0, F.concat(F.lit("NATION_"), F.col("s_nationkey").cast("string"))).alias("screen"), F.when(s % 5 == 0, "/none/").otherwise(F.concat(F.lit("/"), s.cast("string"), F.lit("/"))).alias("endpoint"))
    ui = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.concat(F.lit("open "), "n_name", F.lit(" list")).alias("text"))
    api = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("/parts/"), F.col("p_partkey").cast("string")).alias("route"))
    return matching.link_proposals(ui, api, calls)


# risk
_RISK = "rk AS (SELECT l_orderkey AS model_id, l_linenumber || '-' || l_partkey AS id, 1 + l_partkey % 5 AS detection, CASE WHEN l_linenumber <> 2 THEN l_suppkey % 7 END AS technical, CASE l_returnflag WHEN 'A' THEN 'High' WHEN 'N' THEN 'Very High' ELSE 'Low' END AS band, l_linestatus = 'F' AND l_tax > 0.05 AS failing FROM lineitem)"


def _risk(spark, d):
    li = table(spark, d, "lineitem")
    return li.select(F.col("l_orderkey").alias("model_id"), F.concat_ws("-", F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string")).alias("id"), (1 + F.col("l_partkey") % 5).alias("detection"), F.when(F.col("l_linenumber") != 2, F.col("l_suppkey") % 7).alias("technical"), F.when(F.col("l_returnflag") == "A", "High").when(F.col("l_returnflag") == "N", "Very High").otherwise("Low").alias("band"), ((F.col("l_linestatus") == "F") & (F.col("l_tax") > 0.05)).alias("failing"))


@query(f"WITH {_RISK} SELECT model_id, id, detection, technical, row_number() OVER (PARTITION BY model_id ORDER BY detection DESC, coalesce(technical, 0) DESC, id) AS rank FROM rk")
def risk_order(spark, d):
    return risk.order(_risk(spark, d), ["model_id"]).select("model_id", "id", "detection", "technical", "rank")


@query(f"WITH {_RISK} SELECT model_id, id, band, 'unnoticed' AS part FROM rk WHERE detection = 5 AND band <> 'Low' UNION ALL SELECT model_id, id, band, 'failing' FROM rk WHERE failing")
def risk_residual(spark, d):
    return risk.residual(_risk(spark, d), ["model_id"])


@query(f"WITH {_RISK}, c AS (SELECT model_id, count(*) FILTER (detection = 5 AND band <> 'Low') AS unnoticed, count(*) FILTER (failing) AS failing FROM rk GROUP BY 1) SELECT o_orderkey AS model_id, coalesce(unnoticed, 0)::BIGINT AS unnoticed, coalesce(failing, 0)::BIGINT AS failing, coalesce(unnoticed, 0) <= 1 AND coalesce(failing, 0) <= 0 AS within FROM orders LEFT JOIN c ON model_id = o_orderkey")
def exit_criteria(spark, d):
    return risk.exit_criteria(risk.residual(_risk(spark, d), ["model_id"]), table(spark, d, "orders").select(F.col("o_orderkey").alias("model_id")), ["model_id"], {"unnoticed": 1, "failing": 0})


@query("SELECT p_partkey AS id, 'High' AS band, CASE WHEN p_size < 10 THEN 'partial' ELSE 'positive-only' END AS verdict FROM part WHERE p_type = 'SMALL' AND p_size < 20")
def depth_gaps(spark, d):
    p = table(spark, d, "part").withColumnRenamed("p_partkey", "id")
    return risk.depth_gaps(p.select("id", F.when(F.col("p_type") == "SMALL", "High").otherwise("Low").alias("band")), p.select("id", F.when(F.col("p_size") < 10, "partial").when(F.col("p_size") < 20, "positive-only").otherwise("full").alias("verdict")))


_CHANGE = """ch AS (SELECT p_partkey::VARCHAR AS subject, 'critical' AS severity, 'nothing validates it' AS what FROM part WHERE p_partkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority < '3')
UNION ALL SELECT p_partkey::VARCHAR, 'minor', 'criteria from the code alone' FROM part WHERE p_partkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority < '3' AND o_orderstatus = 'F') UNION ALL SELECT p_partkey::VARCHAR, 'major', 'the positive path alone' FROM part WHERE p_size < 20 AND p_partkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority < '3')
UNION ALL SELECT n_name, 'question', 'no behaviour matches the file' FROM nation)"""


def _change(spark, d):
    p = table(spark, d, "part").withColumnRenamed("p_partkey", "id")
    criteria = table(spark, d, "orders").where("o_orderpriority < '3'").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "code_derived").otherwise("authored").alias("provenance"))
    return risk.change_findings(p, criteria, p.select("id", F.when(F.col("p_size") < 20, "positive-only").otherwise("full").alias("verdict")), table(spark, d, "nation").select(F.col("n_name").alias("file")))


@query(f"WITH {_CHANGE} SELECT *, CASE severity WHEN 'critical' THEN 1 WHEN 'major' THEN 2 WHEN 'minor' THEN 3 ELSE 4 END AS place FROM ch")
def change_findings(spark, d):
    return _change(spark, d)


@query(f"WITH {_CHANGE} SELECT subject AS id, severity || ': ' || what AS description, 'change-review' AS derived_by, 'model' AS derived_from FROM ch WHERE severity <> 'question' UNION ALL SELECT r_name, 'not measured', 'unmeasured', 'model' FROM region")
def risk_candidates(spark, d):
    return risk.candidates(_change(spark, d), table(spark, d, "region").select(F.col("r_name").alias("id")))


@query("SELECT n_regionkey AS section, n_name AS name, CASE WHEN EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 8000) THEN 'gathered' WHEN EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 9900) THEN 'answered' WHEN n_regionkey < 3 THEN 'missing' ELSE 'open' END AS state FROM nation")
def input_completeness(spark, d):
    n = table(spark, d, "nation")
    asked = n.select(F.col("n_regionkey").alias("section"), F.col("n_name").alias("name"), (F.col("n_regionkey") < 3).alias("required"))
    of = lambda df, key: n.join(df, F.col("n_nationkey") == F.col(key)).select(F.col("n_regionkey").alias("section"), F.col("n_name").alias("name"))
    return risk.completeness(asked, of(table(spark, d, "supplier").where("s_acctbal > 8000"), "s_nationkey"), of(table(spark, d, "customer").where("c_acctbal > 9900"), "c_nationkey"))


@query("WITH g AS (SELECT c_nationkey AS s, count(*) FILTER (c_mktsegment = 'BUILDING' AND c_acctbal < 0) AS a, count(*) FILTER (c_mktsegment = 'MACHINERY' AND c_acctbal < 0) AS b FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY 1), k AS (SELECT c_nationkey AS s, bool_or(c_mktsegment = 'BUILDING') AS ka, bool_or(c_mktsegment = 'MACHINERY') AS kb FROM customer GROUP BY 1) SELECT n_nationkey AS subject, CASE WHEN ka THEN a END::BIGINT AS intent, CASE WHEN kb THEN b END::BIGINT AS wording, CASE WHEN ka AND kb THEN a = 0 AND b = 0 END AS ready FROM nation LEFT JOIN k ON k.s = n_nationkey LEFT JOIN g ON g.s = n_nationkey")
def intent_readiness(spark, d):
    kind = F.when(F.col("c_mktsegment") == "BUILDING", "intent").when(F.col("c_mktsegment") == "MACHINERY", "wording")
    gaps = table(spark, d, "customer").select(F.col("c_nationkey").alias("subject"), kind.alias("kind"), F.when(F.col("c_acctbal") < 0, 1).otherwise(0).alias("n")).where("kind is not null")
    return risk.readiness(gaps, table(spark, d, "nation").select(F.col("n_nationkey").alias("subject")), ("intent", "wording"))


# workflow: five stages of one workflow, and runs of it by customers
_STAGES = [("w", "1-URGENT", 1, [], True), ("w", "2-HIGH", 2, ["1-URGENT"], True), ("w", "3-MEDIUM", 3, ["1-URGENT", "2-HIGH"], False), ("w", "4-NOT SPECIFIED", 4, ["3-MEDIUM"], True), ("w", "5-LOW", 5, [], False)]
_RUNS = "ru AS (SELECT o_custkey AS run_id, o_orderpriority AS stage, o_orderdate AS ended, CASE o_orderstatus WHEN 'F' THEN 'ok' WHEN 'O' THEN 'failed' ELSE 'waiting' END AS outcome, 'f' || (o_orderkey % 2) AS fp FROM orders), la AS (SELECT run_id, stage, max((ended, outcome, fp)) AS m FROM ru GROUP BY 1, 2), lt AS (SELECT run_id, stage, struct_extract_at(m, 1) AS ended, struct_extract_at(m, 2) AS outcome, struct_extract_at(m, 3) AS fp FROM la)"
_DEF = "df AS (SELECT * FROM (VALUES ('1-URGENT', 1, true, NULL), ('2-HIGH', 2, true, '1-URGENT'), ('3-MEDIUM', 3, false, '1-URGENT'), ('3-MEDIUM', 3, false, '2-HIGH'), ('4-NOT SPECIFIED', 4, true, '3-MEDIUM'), ('5-LOW', 5, false, NULL)) v(stage, place, blocking, required))"


def _workflow(spark, d):
    stages = spark.createDataFrame(_STAGES, "workflow string, stage string, place int, requires array<string>, blocking boolean")
    outcome = F.when(F.col("o_orderstatus") == "F", "ok").when(F.col("o_orderstatus") == "O", "failed").otherwise("waiting")
    runs = table(spark, d, "orders").select(F.col("o_custkey").alias("run_id"), F.lit("w").alias("workflow"), F.col("o_orderpriority").alias("stage"), outcome.alias("outcome"), F.concat(F.lit("f"), (F.col("o_orderkey") % 2).cast("string")).alias("fingerprint"), F.col("o_orderdate").alias("ended"))
    return stages, runs


@query(f"WITH {_RUNS}, {_DEF}, cu AS (SELECT DISTINCT run_id FROM ru), x AS (SELECT cu.run_id, df.stage, CASE WHEN required IS NULL THEN NULL WHEN outcome IS NULL THEN 'missing:' || required WHEN outcome <> 'ok' THEN 'not-ok:' || required WHEN fp <> 'f0' THEN 'stale:' || required END AS why FROM cu CROSS JOIN df LEFT JOIN lt ON lt.run_id = cu.run_id AND lt.stage = df.required) SELECT run_id, stage, coalesce(string_agg(DISTINCT why, ',' ORDER BY why), '') AS reasons, count(why) = 0 AS may_begin FROM x GROUP BY 1, 2")
def stage_eligibility(spark, d):
    stages, runs = _workflow(spark, d)
    current = runs.select("run_id", "workflow").distinct().withColumn("fingerprint", F.lit("f0"))
    return workflow.eligibility(stages, runs, current).select("run_id", "stage", "reasons", "may_begin")


@query(f"WITH {_RUNS}, st AS (SELECT DISTINCT stage, place, blocking FROM (SELECT * FROM (VALUES ('1-URGENT', 1, true), ('2-HIGH', 2, true), ('3-MEDIUM', 3, false), ('4-NOT SPECIFIED', 4, true), ('5-LOW', 5, false)) v(stage, place, blocking))), x AS (SELECT c.run_id, st.stage, place, blocking, outcome FROM (SELECT DISTINCT run_id FROM ru) c CROSS JOIN st LEFT JOIN lt ON lt.run_id = c.run_id AND lt.stage = st.stage WHERE outcome IS NULL OR outcome <> 'ok') SELECT run_id, arg_min(stage, place) AS stage, coalesce(arg_min(outcome = 'failed' AND blocking, place) FILTER (outcome IS NOT NULL AND place = (SELECT min(y.place) FROM x y WHERE y.run_id = x.run_id)), false) AS stopped FROM x GROUP BY 1")
def next_stage(spark, d):
    stages, runs = _workflow(spark, d)
    return workflow.next_stage(stages, runs).select("run_id", "stage", "stopped")


@query(f"WITH {_RUNS}, w AS (SELECT * FROM lt WHERE outcome = 'waiting') SELECT row_number() OVER (ORDER BY ended, run_id, stage) AS place, run_id, stage, (SELECT count(*) FROM w)::BIGINT AS waiting FROM (SELECT * FROM w ORDER BY ended, run_id, stage LIMIT 20)")
def decision_queue(spark, d):
    return workflow.decision_queue(_workflow(spark, d)[1], 20)


@query("""WITH RECURSIVE s AS (SELECT l_orderkey AS workflow, l_linenumber AS stage, max(l_partkey % 5) AS place, min(l_suppkey) % 12 AS k FROM lineitem GROUP BY 1, 2), r AS (SELECT DISTINCT l_orderkey AS workflow, l_linenumber AS stage, l_suppkey % 8 AS required FROM lineitem WHERE l_suppkey % 8 > 0),
e AS (SELECT r.workflow, r.stage, r.required, a.place AS p, b.place AS q FROM r JOIN s a USING (workflow, stage) LEFT JOIN s b ON b.workflow = r.workflow AND b.stage = r.required),
tc AS (SELECT workflow, stage AS x, required AS y FROM e WHERE q IS NOT NULL UNION SELECT tc.workflow, tc.x, e.required FROM tc JOIN e ON e.workflow = tc.workflow AND e.stage = tc.y WHERE q IS NOT NULL)
SELECT workflow, stage, 'unknown-stage' AS rule FROM e WHERE q IS NULL UNION SELECT workflow, stage, 'not-before' FROM e WHERE q >= p UNION SELECT workflow, stage, 'unknown-check' FROM s WHERE k BETWEEN 5 AND 9 UNION SELECT workflow, x, 'circle' FROM tc WHERE x = y""")
def workflow_lint(spark, d):
    """Orders stand for workflows, line numbers for stages, suppliers for what they require and regions for checks."""
    required = F.array_except(F.collect_set(F.col("l_suppkey") % 8), F.array(F.lit(0).cast("long")))
    stages = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("workflow"), F.col("l_linenumber").alias("stage")).agg(F.max(F.col("l_partkey") % 5).alias("place"), required.cast("array<int>").alias("requires"), (F.min("l_suppkey") % 12).alias("k"))
    stages = stages.withColumn("check", F.when(F.col("k") < 10, F.col("k").cast("string"))).drop("k")
    return workflow.lint(stages, table(spark, d, "region").select(F.col("r_regionkey").cast("string").alias("check")))


@query("SELECT o_orderkey AS seq, CASE WHEN n_regionkey IS NULL OR o_orderstatus = 'P' OR n_regionkey > 2 AND o_orderstatus = 'O' THEN 'no capability' WHEN c_custkey % 10 = 1 THEN 'own proposal' ELSE 'stands' END AS verdict FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey")
def decision_audit(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    roles = c.select(F.col("c_name").alias("reviewer"), workflow.capability(F.when(F.col("n_regionkey") > 2, "reader").otherwise("editor"), {"reader": ("F",), "editor": ("F", "O")}).alias("capabilities"))
    name = F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"))
    audit = table(spark, d, "orders").select(F.col("o_orderkey").alias("seq"), name.alias("reviewer"), F.col("o_orderstatus").alias("capability"), F.when(F.col("o_custkey") % 10 == 1, F.upper(name)).alias("proposed_by"))
    return workflow.decisions(audit, roles)


# surfaces
@query("WITH b AS (SELECT l_suppkey, arg_min('g' || p_size, l_partkey) AS borrowed FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_linestatus = 'F' AND p_type <> 'SMALL' GROUP BY 1) SELECT s_suppkey AS id, CASE WHEN s_nationkey < 12 THEN CASE WHEN borrowed IS NULL THEN 'own' ELSE 'own AND ' || borrowed END ELSE coalesce(borrowed, '') END AS guard FROM supplier LEFT JOIN b ON l_suppkey = s_suppkey")
def inherited_guards(spark, d):
    from statewake.operators import validation

    one = F.lit(1).alias("model_id")
    links = table(spark, d, "lineitem").select(one, F.col("l_suppkey").alias("ui_id"), F.col("l_partkey").alias("api_id"), (F.col("l_linestatus") == "F").alias("confirmed")).distinct()
    api = table(spark, d, "part").select(one, F.col("p_partkey").alias("id"), F.when(F.col("p_type") == "SMALL", " ").otherwise(F.concat(F.lit("g"), F.col("p_size").cast("string"))).alias("guard"))
    ui = table(spark, d, "supplier").select(one, F.col("s_suppkey").alias("id"), F.when(F.col("s_nationkey") < 12, "own").alias("guard"))
    return validation.effective_guard(ui, surfaces.inherited_guards(links, api)).select("id", "guard")


@query("WITH ln AS (SELECT DISTINCT l_suppkey AS u, l_partkey + CASE WHEN l_linenumber = 7 THEN 1000000 ELSE 0 END AS a, CASE WHEN l_returnflag = 'R' THEN 'triggers' ELSE 'invokes' END AS k FROM lineitem WHERE true), ap AS (SELECT p_partkey * 2 AS a FROM part WHERE p_type <> 'PROMO'), kn AS (SELECT p_partkey * 2 AS a FROM part) SELECT 'api-only' AS kind, a AS id FROM ap WHERE a NOT IN (SELECT a FROM ln) UNION ALL SELECT DISTINCT 'dangling', a FROM ln WHERE a NOT IN (SELECT a FROM kn) UNION ALL SELECT 'unhandled-outcome', a FROM ap WHERE a IN (SELECT a FROM ln WHERE k = 'triggers') AND a NOT IN (SELECT a FROM ln WHERE k = 'invokes') UNION ALL SELECT DISTINCT 'restated-guard', u FROM ln JOIN part ON p_partkey * 2 = a JOIN supplier ON s_suppkey = u WHERE k = 'invokes' AND p_size > 20 AND s_nationkey = p_size % 25")
def surface_divergences(spark, d):
    api = table(spark, d, "part").select((F.col("p_partkey") * 2).alias("id"), F.when(F.col("p_type") == "PROMO", "planned").otherwise("implemented").alias("status"), F.when(F.col("p_size") > 20, F.concat(F.lit(" size "), (F.col("p_size") % 25).cast("string"), F.lit("; "))).otherwise(" ").alias("guard"))
    links = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("ui_id"), (F.col("l_partkey") + F.when(F.col("l_linenumber") == 7, 1000000).otherwise(0)).alias("api_id"), F.when(F.col("l_returnflag") == "R", "triggers").otherwise("invokes").alias("kind")).distinct()
    guard = F.concat(F.lit("shown AND size "), F.col("s_nationkey").cast("string"), F.lit("; ok"))
    return surfaces.divergences(table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), guard.alias("guard")), api, links)


@query("WITH t AS (SELECT p_partkey AS id, CASE WHEN p_size > 25 THEN 'POST' ELSE 'GET' END AS verb, p_type AS service, unnest(list_distinct(['/a/' || p_brand, '/b/' || (p_partkey % 50)])) AS path FROM part), x AS (SELECT s_suppkey AS test, CASE WHEN s_nationkey % 2 = 0 THEN 'POST' ELSE 'GET' END AS verb, CASE WHEN s_nationkey < 12 THEN '/a/Brand#' || s_nationkey ELSE '/b/' || s_nationkey END AS path, CASE WHEN s_nationkey % 3 = 0 THEN 'SMALL' END AS service FROM supplier) SELECT DISTINCT id, test FROM t JOIN x ON t.verb = x.verb AND t.path = x.path AND (x.service IS NULL OR x.service = t.service)")
def existing_tests(spark, d):
    p, n = F.col("p_partkey"), F.col("s_nationkey")
    t = table(spark, d, "part").select(p.alias("id"), F.when(F.col("p_size") > 25, "post").otherwise("GET").alias("verb"), F.array(F.concat(F.lit("/a/"), "p_brand"), F.concat(F.lit("/b/"), (p % 50).cast("string"))).alias("paths"), F.col("p_type").alias("service"))
    path = F.when(n < 12, F.concat(F.lit("/a/Brand#"), n.cast("string"))).otherwise(F.concat(F.lit("/b/"), n.cast("string")))
    tests = table(spark, d, "supplier").select(F.col("s_suppkey").alias("test"), F.when(n % 2 == 0, "POST").otherwise("get").alias("verb"), path.alias("path"), F.when(n % 3 == 0, "SMALL").alias("service"))
    return surfaces.existing_tests(t, tests)


@query("WITH o AS (SELECT l_suppkey AS ui_id, l_partkey AS api_id, l_returnflag = 'A' AS confirmed, 'run-' || l_returnflag AS by_, l_linestatus = 'O' AS new FROM lineitem) SELECT ui_id, api_id, bool_or(confirmed) AS confirmed, arg_max(by_, (new, by_)) AS proposed_by FROM o GROUP BY 1, 2")
def link_upsert(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("ui_id"), F.col("l_partkey").alias("api_id"), (F.col("l_returnflag") == "A").alias("confirmed"), F.concat(F.lit("run-"), "l_returnflag").alias("proposed_by"), F.col("l_linestatus").alias("s"))
    return surfaces.upsert_links(li.where("s <> 'O'").drop("s"), li.where("s = 'O'").drop("s"))


@query("""WITH RECURSIVE p AS (SELECT doc_id AS node, CASE WHEN doc_id % 7 <> 3 THEN doc_id // 3 END AS parent FROM documents WHERE doc_id > 0), w AS (SELECT 0::BIGINT AS node UNION ALL SELECT p.node FROM w JOIN p ON p.parent = w.node) SELECT doc_id AS node FROM documents WHERE doc_id NOT IN (SELECT node FROM w)""")
def unreachable_surface(spark, d):
    docs = table(spark, d, "documents").withColumnRenamed("doc_id", "node")
    edges = docs.where("node > 0").select(F.col("node").alias("src"), F.expr("case when node % 7 <> 3 then node div 3 end").alias("dst")).where("dst is not null")
    return surfaces.unreachable_surface(docs, edges, docs.where("node = 0"))


# intake
@query("SELECT 'c' || o_custkey AS case_id, lower(o) AS outcome, CASE WHEN o_custkey % 50 = 0 THEN 'no case_id' WHEN lower(o) NOT IN ('passed', 'failed', 'skipped', 'errored', 'not_run') THEN 'outcome ''' || lower(o) || ''' is not known' END AS reason FROM (SELECT o_custkey, CASE o_orderkey % 8 WHEN 0 THEN 'Passed' WHEN 1 THEN 'failed' WHEN 2 THEN 'errored' WHEN 3 THEN 'error' WHEN 4 THEN 'Not_Run' WHEN 5 THEN 'blocked' WHEN 6 THEN 'skipped' ELSE 'Flaky' END AS o FROM orders)".replace("'c' || o_custkey AS case_id", "CASE WHEN o_custkey % 50 = 0 THEN '' ELSE 'c' || o_custkey END AS case_id"))
def execution_intake(spark, d):
    o = table(spark, d, "orders").select(F.when(F.col("o_custkey") % 50 == 0, " ").otherwise(F.concat(F.lit("c"), F.col("o_custkey").cast("string"))).alias("case_id"), _cases("o_orderkey", [" Passed", "failed", "errored", "error", "Not_Run ", "blocked", "skipped", "Flaky"]).alias("outcome"), F.col("o_orderdate").cast("string").alias("observed_at"), F.lit(5).alias("duration_ms"), F.lit("x").alias("detail"))
    good, bad = intake.executions(o)
    return good.select("case_id", "outcome", F.lit(None).cast("string").alias("reason")).unionAll(bad)


@query("SELECT p_partkey, CASE WHEN p_size < 10 AND p_partkey % 3 = 0 THEN 'reviewed' WHEN p_size < 20 THEN 'override' ELSE p_name END AS name, p_size < 10 AND p_partkey % 3 <> 0 AS stale FROM part")
def layered_model(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("name"), "p_size")
    over = p.where("p_size < 20").select("p_partkey", F.lit("override").alias("name"))
    review = p.where("p_size < 10").select("p_partkey", F.lit("reviewed").alias("name"), F.when(F.col("p_partkey") % 3 == 0, "now").otherwise("before").alias("fingerprint"))
    return intake.layered(p, over, review, F.lit("now"), ["p_partkey"], ["name"]).select("p_partkey", "name", "stale")


@query("""SELECT n_regionkey, sha256(string_agg(line, chr(10) ORDER BY line))[1:16] AS fingerprint FROM (SELECT n_regionkey, '["' || n_nationkey || '","' || n_name || '"]' AS line FROM nation) GROUP BY 1""")
def model_fingerprint(spark, d):
    return intake.fingerprint(table(spark, d, "nation"), ["n_regionkey"], ["n_nationkey", "n_name"])


@query("SELECT p_partkey, CASE WHEN l IS NULL THEN 'new' WHEN p_size <= 25 THEN 'already' ELSE 'contradicting' END AS verdict FROM part LEFT JOIN (SELECT DISTINCT o_custkey AS l FROM orders) ON l = p_partkey")
def knowledge_compare(spark, d):
    known = table(spark, d, "orders").select(F.col("o_custkey").alias("p_partkey")).distinct().withColumn("text", F.lit("small"))
    return intake.compared(known, table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") <= 25, "small").otherwise("large").alias("text")), "p_partkey", "text")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN '' WHEN o_orderstatus = 'F' THEN 'AB-' || o_custkey WHEN o_orderkey % 2 = 0 THEN 'AB-' || o_custkey || ',C2-7' ELSE 'AB-1' END AS tickets FROM orders")
def commit_tickets(spark, d):
    key = F.concat(F.lit("AB-"), F.col("o_custkey").cast("string"))
    s = F.when(F.col("o_orderstatus") == "P", "no key here a-1").when(F.col("o_orderstatus") == "F", F.concat(key, F.lit(": fix "), key)).when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("["), key, F.lit("] C2-7 done"))).otherwise("UTF-8, SHA-256 and ABCDEFGHIJK-5 are none, AB-1 and X-1 aside")
    return table(spark, d, "orders").select("o_orderkey", F.array_join(intake.tickets(s), ",").alias("tickets"))


@query("SELECT p_partkey, CASE WHEN p_type IN ('SMALL', 'LARGE') THEN 'LAST_NAME' ELSE 'UNRESOLVED' END AS \"column\", CASE WHEN p_type NOT IN ('SMALL', 'LARGE') THEN 'no column last_name in ' || p_type END AS reason FROM part")
def confirmed_columns(spark, d):
    predicates = table(spark, d, "part").select("p_partkey", F.col("p_partkey").cast("string").alias("method"), F.col("p_type").alias("table"), F.lit("lastName").alias("property"))
    columns = spark.createDataFrame([("SMALL", "LAST_NAME"), ("LARGE", "LAST_NAME"), ("PROMO", "FIRST_NAME")], "table string, column string")
    return intake.confirmed_columns(predicates, columns).select(F.col("method").cast("long").alias("p_partkey"), "column", "reason")


@query("WITH f AS (SELECT event_id AS run_id, user_id AS pod, ts AS a, ts + INTERVAL 30 SECOND AS b FROM events WHERE event_type = 'error') SELECT f.run_id, e.event_id FROM f JOIN events e ON e.user_id = f.pod AND e.ts BETWEEN f.a - INTERVAL 600 SECOND AND f.b + INTERVAL 5 SECOND")
def around_failures(spark, d):
    e = table(spark, d, "events")
    failures = e.where("event_type = 'error'").select(F.col("event_id").alias("run_id"), F.col("user_id").alias("pod"), F.col("ts").alias("started"), (F.col("ts") + F.expr("interval 30 seconds")).alias("ended"))
    return intake.around_failures(e.select(F.col("user_id").alias("pod"), "ts", F.col("event_id").alias("line")), failures, before=600).select("run_id", F.col("line").alias("event_id"))
