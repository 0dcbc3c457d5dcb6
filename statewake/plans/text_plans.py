"""Queries of the text rules over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from statewake.operators import retrieval, search, textrules
from statewake.plans.machine import steps, table
from statewake.plans.registry import query


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_type WHEN 1 THEN event_type END AS given, CASE WHEN event_id % 3 < 2 THEN 'k is ' || (props->>'$.k') END AS \"when\", CASE event_id % 3 WHEN 0 THEN 'stop' WHEN 1 THEN 'go on' END AS \"then\", CASE WHEN event_id % 3 = 2 THEN 'unparseable' END AS blocked FROM events")
def gwt_mine(spark, d):
    k, m = F.col("k").cast("string"), F.col("event_id") % 3
    text = F.when(m == 0, F.concat(F.lit("While "), "event_type", F.lit(", when k is "), k, F.lit(", then stop."))).when(m == 1, F.concat(F.lit("Given "), "event_type", F.lit(" when k is "), k, F.lit(" then go on"))).otherwise("no form at all")
    return steps(spark, d).select("event_id", textrules.mine_criterion(text).alias("c")).select("event_id", "c.*")


@query("WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS w FROM documents) SELECT doc_id, name_id FROM w JOIN (SELECT p_partkey AS name_id, lower(unnest(string_split(p_name, ' '))) AS w FROM part UNION ALL SELECT item_id + 1000000, lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) FROM benchmark) b USING (w) GROUP BY ALL")
def entity_mentions(spark, d):
    own = table(spark, d, "part").select(F.col("p_partkey").alias("name_id"), F.explode(F.split("p_name", " ")).alias("name"))
    more = table(spark, d, "benchmark").select((F.col("item_id") + 1000000).alias("name_id"), F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("name"))
    return textrules.mentions(table(spark, d, "documents"), own.unionAll(more), "doc_id", "text", "name_id", "name")


#: Statements and the rules that each breaks.
_STATEMENTS = (
    ("SELECT * FROM t WHERE a LIKE '%x'", "select-star,leading-wildcard"), ("select a from t where upper(a) = 'X' and b not in (1, 2)", "function-on-column,not-in"), ("select a, (select max(b) from u) from t, u limit 1", "scalar-subquery,cross-join"),
    ("SELECT top 5 a FROM t", "row-limit-dialect,unfiltered"), ("  select a\n from t  ", "unfiltered"), ("select a from t where b = 1", ""), ("delete from t", ""),
)


@query(f"SELECT o_orderkey, CASE o_orderkey % 8 {' '.join(f'WHEN {i} THEN {chr(39)}{r}{chr(39)}' for i, (_, r) in enumerate(_STATEMENTS))} END AS rules FROM orders")
def sql_lint(spark, d):
    s = F.get(F.array(*(F.lit(x) for x, _ in _STATEMENTS)), (F.col("o_orderkey") % 8).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", F.array_join(textrules.sql_review(s), ",").alias("rules"))


#: Evidence, with its class where no status is given and where expected and actual statuses are.
_EVIDENCE = [("connect: Connection refused", "unavailable", "unavailable"), ("gateway answered 503 at a.B(C.java:1)", "unavailable", "unavailable"), ("schema of the page", "unclassified", None), ("Cannot deserialize value", "schema", "schema"), ("500 at a.B.c(D.java:12)", "server-error", "server-error"), ("500 and no trace", "unclassified", None), ("NullPointerException in beforeEach", "test-data", "test-data"),
             ("NullPointerException in the test", "unclassified", None), ("expected: 200, but the actual: 404", "url-change", None), ("Expected 201 and Actual 200", "status-change", None), ("AssertionError: 3", "assertion", None), ("expected a but was b", "assertion", None), ("", "unclassified", None), (None, "unclassified", None)]


def _dealt(values):
    return f"CASE CAST(props->>'$.k' AS INT) % {len(values)} {' '.join(f'WHEN {i} THEN {chr(39)}{v}{chr(39)}' for i, v in enumerate(values) if v)} END"


@query(f"SELECT event_id, CASE event_type WHEN 'click' THEN coalesce({_dealt([g for *_, g in _EVIDENCE])}, 'url-change') WHEN 'view' THEN coalesce({_dealt([g for *_, g in _EVIDENCE])}, 'status-change') ELSE {_dealt([n for _, n, _ in _EVIDENCE])} END AS class FROM events")
def failure_classes(spark, d):
    """A click has the statuses 200 and 404, a view 200 and 403, other events none."""
    actual = F.when(F.col("event_type") == "click", "404").when(F.col("event_type") == "view", "403")
    evidence = F.get(F.array(*(F.lit(e) for e, *_ in _EVIDENCE)), F.col("k") % len(_EVIDENCE))
    return steps(spark, d).select("event_id", textrules.failure_class(evidence, F.when(actual.isNotNull(), "200"), actual).alias("class"))


@query("""WITH k AS (SELECT DISTINCT item_id, lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS keyword FROM benchmark), w AS (SELECT DISTINCT conv_id, turn, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS keyword FROM conversations), h AS (SELECT conv_id, turn, item_id, count(*) AS hits FROM w JOIN k USING (keyword) GROUP BY 1, 2, 3),
b AS (SELECT conv_id, turn, max(hits) AS hits FROM h GROUP BY 1, 2), t AS (SELECT conv_id, turn, CASE WHEN count(*) = 1 THEN min(item_id) END AS workflow FROM h JOIN b USING (conv_id, turn, hits) GROUP BY 1, 2) SELECT c.conv_id || '/' || c.turn AS request, workflow FROM conversations c LEFT JOIN t USING (conv_id, turn)""")
def routing(spark, d):
    keywords = table(spark, d, "benchmark").select(F.col("item_id").alias("workflow"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))).alias("keyword"))
    requests = table(spark, d, "conversations").select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("request"), "text")
    return textrules.route(requests, keywords, "request", "text")


@query("SELECT p_partkey, CASE p_type WHEN 'SMALL' THEN 'Small' WHEN 'STANDARD' THEN 'Standard' END AS name, CASE WHEN p_type NOT IN ('SMALL', 'STANDARD') THEN CASE lower(p_type[1:3]) WHEN 'eco' THEN 'Economic' WHEN 'sta' THEN 'Standard' END END AS hint FROM part")
def category_check(spark, d):
    p = table(spark, d, "part").select("p_partkey", textrules.category(F.col("p_type"), ["Small", "Standard", "Economic"]).alias("c"))
    return p.select("p_partkey", "c.name", "c.hint")


@query("WITH p AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS pos FROM documents) SELECT doc_id, arg_max(pos, (length(x), -pos))::INT AS pos FROM p GROUP BY 1")
def passage_rollup(spark, d):
    p = table(spark, d, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "x"))
    return p.groupBy("doc_id").agg(F.max_by("pos", F.struct(F.length("x"), -F.col("pos"))).alias("pos"))


@query("SELECT label, count(*)::BIGINT AS n, min(len(embedding))::INT AS width, count(DISTINCT len(embedding)) = 1 AS one_width FROM embeddings GROUP BY 1")
def model_guard(spark, d):
    safe = F.forall("embedding", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    return table(spark, d, "embeddings").where(safe).groupBy("label").agg(F.count("*").alias("n"), F.min(F.size("embedding")).alias("width"), (F.count_distinct(F.size("embedding")) == 1).alias("one_width"))


@query("""WITH q AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS term FROM benchmark), tf AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark),
df AS (SELECT term, count(DISTINCT item_id) AS df FROM tf GROUP BY 1) SELECT term, df::BIGINT AS df, round(ln(1 + ((SELECT count(*) FROM benchmark) - df + 0.5) / (df + 0.5)), 4) AS idf FROM df""")
def token_idf(spark, d):
    b = table(spark, d, "benchmark")
    df = b.select("item_id", F.explode(F.array_distinct(retrieval.tokens(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    n = F.broadcast(b.agg(F.count("*").alias("n")))
    return df.crossJoin(n).select("term", "df", F.round(F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), 4).alias("idf"))


@query("""WITH co AS (SELECT conv_id * 1000 + turn AS item, conv_id AS parent, role AS label, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS ts FROM conversations), qu AS (SELECT item_id AS q_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS ts FROM benchmark), q AS (SELECT q_id, unnest(list_distinct(ts)) AS term FROM qu),
sz AS (SELECT count(*) AS n, avg(len(ts)) AS a FROM co), tf AS (SELECT item, term, count(*) AS tf, any_value(l) AS len FROM (SELECT item, unnest(ts) AS term, len(ts) AS l FROM co) GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
sc AS (SELECT q_id, item, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / a))), 6) AS score FROM q JOIN tf USING (term) JOIN df USING (term), sz GROUP BY 1, 2), kw AS (SELECT q_id, item, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, item) AS rank FROM sc),
cv AS (SELECT item, label, p, count(*)::DOUBLE AS c FROM (SELECT item, label, ('0x' || md5(unnest(ts))[1:8])::BIGINT % 256 AS p FROM co) GROUP BY ALL), qv AS (SELECT q_id, p, count(*)::DOUBLE AS c FROM (SELECT q_id, ('0x' || md5(unnest(ts))[1:8])::BIGINT % 256 AS p FROM qu) GROUP BY ALL),
dot AS (SELECT q_id, item, label, sum(qv.c * cv.c) AS d FROM qv JOIN cv USING (p) GROUP BY ALL), cn AS (SELECT item, label, sum(c * c) AS s FROM cv GROUP BY ALL), qn AS (SELECT q_id, sum(c * c) AS s FROM qv GROUP BY ALL),
al AS (SELECT q_id, item, label, round(coalesce(d, 0) / sqrt(qn.s * cn.s), 6) AS score FROM qn CROSS JOIN cn LEFT JOIN dot USING (q_id, item, label)), kl AS (SELECT *, row_number() OVER (PARTITION BY q_id, label ORDER BY score DESC, item) AS r FROM al), ve AS (SELECT q_id, item, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, label, item) AS rank FROM kl WHERE r <= 15),
fu AS (SELECT q_id, item, round(sum(1 / (60 + rank)::DOUBLE), 9) AS score, string_agg(s, '+' ORDER BY s) AS sources FROM (SELECT *, 'keyword' AS s FROM kw WHERE rank <= 15 UNION ALL SELECT *, 'vector' FROM ve WHERE rank <= 15) GROUP BY 1, 2),
be AS (SELECT q_id, parent, max(score) AS score, arg_max(sources, (score, -item)) AS sources FROM fu JOIN co USING (item) GROUP BY 1, 2), ra AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, parent) AS rank FROM be) SELECT q_id, parent, rank, score, sources FROM ra WHERE rank <= 5""")
def search_conversations(spark, d):
    """Keywords and vectors over all turns, fused and rolled up to conversations; every benchmark item is a query."""
    turns = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("item"), F.col("conv_id").alias("parent"), F.col("role").alias("label"), "text")
    corpus, _ = search.embed(turns, search.hashed_features, "hashed-256")
    return search.search(corpus, table(spark, d, "benchmark").select(F.col("item_id").alias("q_id"), "text"), search.hashed_features, "hashed-256")
