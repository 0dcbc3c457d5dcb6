"""Cases that once gave wrong rows."""

import json
import random

import pytest
from pyspark.sql import functions as F

from statewake.operators import coverage, delta, design, filters, graph, guards, matching, reports, surfaces, temporal, textrules, validation, workflow
from statewake.sources import intake


def tuples(df, *cols):
    return sorted((tuple(r) for r in df.select(*(cols or df.columns)).collect()), key=repr)


def test_order_of_checks():
    assert validation.CHECKS == ("observability", "determinism", "guard-completeness", "callability", "polarity", "atomicity", "reachability", "ac-coverage")


def test_a_model_without_an_initial_state_is_one_finding(spark):
    states = spark.createDataFrame([("a", "s"), ("a", "t"), ("b", "s"), ("b", "t"), ("b", "u")], "model_id string, state string")
    reached = spark.createDataFrame([("a", "s", None, False), ("a", "t", None, True), ("b", "s", 0, False), ("b", "t", 1, True), ("b", "u", None, False)], "model_id string, state string, depth int, terminal boolean")
    assert tuples(validation.reachability(states, reached), "model_id", "severity", "elements", "detail") == [("a", "blocking", "a", "no initial state"), ("b", "advisory", "t", "terminal"), ("b", "blocking", "u", "unreachable")]


def test_unknown_mechanisms_cover_nothing(spark):
    t = spark.createDataFrame([("m", x) for x in "abcd"], "model_id string, id string")
    ledger = spark.createDataFrame([("m", "a", "direct"), ("m", "b", "observed"), ("m", "c", "Direct"), ("m", "c", "initiated"), ("m", "d", None)], "model_id string, id string, mechanism string")
    assert tuples(coverage.ledger_summary(t, ledger)) == [("m", 4, 1, 0, 1, 2)]


def test_all_states_take_generatable_arrivals(spark):
    t = spark.createDataFrame([("m", "1", "s", "t", False), ("m", "2", "s", "t", True), ("m", "3", "t", "u", False), ("m", "4", "v", "s", True)], "model_id string, id string, source string, target string, generatable boolean")
    initial = spark.createDataFrame([("m", "s")], "model_id string, state string")
    assert tuples(coverage.all_states(t, initial), "state", "validates") == [("t", "2"), ("u", None), ("v", None)]


def test_evidence_is_literal_occurrence(spark):
    ac = spark.createDataFrame([(1, "see /ordersummary together", None), (2, "422 or 1234", ["x"]), (3, None, ["x", "x"]), (4, "orders are now paid", [])], "ac_id int, text string, areas array<string>")
    t = spark.createDataFrame([("t-422-x", "GET /orders", "/orders", "ok", "", ["x"]), ("u", "POST  /a", None, "state4221", "Orders paid", None), ("v", "X", "", None, None, [])], "id string, trigger string, route string, target string, target_name string, areas array<string>")
    assert tuples(matching.evidence(ac, t)) == sorted([(1, "t-422-x", "path,verb", 2), (2, "t-422-x", "status,area", 2), (2, "u", "status", 1), (3, "t-422-x", "area", 1), (4, "u", "state", 1)], key=repr)


def test_occurrences_like_contains(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("ab/") for _ in range(n))
    texts, needles = [(i, word(rng.randint(0, 30))) for i in range(60)], list({word(rng.randint(1, 8)) for _ in range(40)})
    got = matching.occurrences(spark.createDataFrame(texts, "k int, text string"), spark.createDataFrame([(n,) for n in needles], "needle string"), "k")
    assert tuples(got) == sorted(((k, n) for k, t in texts for n in needles if n in t), key=repr)


def test_outcomes_of_executions(spark):
    rows = spark.createDataFrame([("c", o, "t", 1, None) for o in ("passed", "FAILED", "skipped", " errored", "not_run", "error", "blocked", None)], "case_id string, outcome string, observed_at string, duration_ms int, detail string")
    good, bad = intake.executions(rows)
    assert sorted(r.outcome for r in good.collect()) == ["errored", "failed", "not_run", "passed", "skipped"] and sorted(r.outcome for r in bad.collect()) == ["", "blocked", "error"]


def test_performance_signals(spark):
    inputs = [("cursor", "int"), ("per_page", ""), ("topmost", ""), ("maxCount", ""), ("x", "Asset"), ("x", "Roadmap"), ("x", "Set<A>"), ("x", "int[]"), ("x", "Iterable<A>"), ("x", "Page<A>")]
    i = spark.createDataFrame([("m", str(k), *x) for k, x in enumerate(inputs)] + [("n", "0", "size", "")], "model_id string, id string, name string, type_name string")
    t = i.select("model_id", "id")
    assert [r.id for r in reports.performance(i, t).where("model_id = 'm' and verdict = 'candidate'").orderBy("id").collect()] == ["0", "1", "3", "6", "7", "8"]
    viable = t.withColumn("verdict", F.when(F.col("model_id") == "m", "automate").otherwise("defer"))
    assert {r.model_id for r in reports.performance(i, t, viable).collect()} == {"m"}


def test_depth_knows_boundary_gaps(spark):
    t = spark.createDataFrame([("m", "a", "x > 1"), ("m", "b", "")], "model_id string, id string, guard string")
    paths = lambda rows: spark.createDataFrame(rows, "model_id string, key string, validates string, outcome string")
    shallow, guard = paths([("m", "a", "a", "generated"), ("m", "b", "b", "generated")]), paths([("m", "a::t", "a", "generated"), ("m", "a::f", "a", "generated"), ("m", "b", "b", "generated")])
    assert tuples(reports.depth(shallow, guard, t), "id", "verdict") == [("a", "full"), ("b", "full")]
    assert tuples(reports.depth(shallow, guard, t, paths([("m", "a::1", "a", "unreachable"), ("m", "a::2", "a", "generated")])), "id", "verdict") == [("a", "partial"), ("b", "full")]


def plain_prune(v):
    if isinstance(v, dict):
        return {k: plain_prune(x) for k, x in v.items() if k in filters.KEPT or (x is not None and x != "" and x != [] and x is not False)}
    return [plain_prune(x) for x in v] if isinstance(v, list) else v


def test_pruning_like_plain_recursion(spark):
    rng = random.Random(7)

    def value(depth):
        kind = rng.randint(0, 9)
        if depth and kind < 3:
            return {rng.choice(["a", "b", "ok", "valid", 'q"r', "e: null,", "\\"]) + str(i) * (i > 0): value(depth - 1) for i in range(rng.randint(0, 4))}
        if depth and kind < 5:
            return [value(depth - 1) for _ in range(rng.randint(0, 3))]
        return rng.choice([None, False, True, "", "x", 'y, "n": null', 0, 1.5, [], {}, "\\", '\\"'])

    docs = [{"r": value(12), "ok": False, "s": value(3)} for _ in range(300)] + [json.loads('{"a":' * 50 + '{"z": null}' + "}" * 50)]
    for dump in (json.dumps, lambda x: json.dumps(x, indent=1), lambda x: json.dumps(x, separators=(",", ":"))):
        df = spark.createDataFrame([(i, dump(x)) for i, x in enumerate(docs)], "i int, t string").select("i", filters.pruned(F.col("t")).alias("t"))
        assert {r.i: json.loads(r.t) for r in df.collect()} == {i: plain_prune(x) for i, x in enumerate(docs)}


def test_restated_guards_and_local_guards(spark):
    ui = spark.createDataFrame([(1, "shown AND balance > 0"), (2, "shown"), (3, None)], "id int, guard string")
    api = spark.createDataFrame([(10, "implemented", " balance > 0 "), (11, "implemented", ""), (12, "planned", None)], "id int, status string, guard string")
    links = spark.createDataFrame([(1, 10, "invokes"), (2, 10, "invokes"), (2, 11, "invokes"), (3, 12, "invokes"), (1, 99, "invokes")], "ui_id int, api_id int, kind string")
    assert tuples(surfaces.divergences(ui, api, links)) == [("dangling", 99), ("restated-guard", 1)]
    t = spark.createDataFrame([("m", "a", "S", "POST /x", "implemented"), ("m", "b", "S", "POST /x", "implemented")], "model_id string, id string, source string, trigger string, status string")
    wanted = spark.createDataFrame([("m", "Home", "press", "S", "POST /x", " form valid ")], "model_id string, ui_source string, ui_trigger string, api_source string, api_trigger string, local_guard string")
    targets = spark.createDataFrame([("m", "a", "Done"), ("m", "b", "Failed")], "model_id string, api_id string, ui_target string")
    assert tuples(surfaces.planned(t, wanted, targets), "target", "guard") == [("Done", "form valid"), ("Failed", "form valid")]


def test_null_texts_and_overrides_to_null(spark):
    rows = [("k", t, i, i) for i, t in enumerate([None, None, "a", "a", None, None, "b"])]
    assert tuples(temporal.revisions(spark.createDataFrame(rows, "k string, t string, at int, n int"), "k", "t", "at", "n"), "revision", "text", "valid_from", "valid_to") == [(1, None, 0, 2), (2, "a", 2, 4), (3, None, 4, 6), (4, "b", 6, None)]
    log = spark.createDataFrame([("e", "p", 1, "x", None)], "e string, prop string, seq int, previous_value string, new_value string")
    assert tuples(delta.override_fold(log, spark.createDataFrame([("e", "p", "x"), ("e", "q", "y")], "e string, prop string, value string"), "e")) == [("e", "p", None, True, False), ("e", "q", "y", False, False)]


@pytest.mark.parametrize("statement", [
    "select * from information_schema.columns, users", "select * from information_schema.tables t join users u on true", "select * from user_passwords", "select * from all_customer_rows", "select 1", "select * from sys.sql_logins",
    "select * from (select * from users) x", "with c as (select * from users) select * from c", "select * from pg_catalog.pg_class where exists (select 1 from users)", "select * from information_schema.tables union select * from secrets", "select * from (information_schema.tables join users on true)",
])
def test_catalogue_guard_refuses(statement):
    with pytest.raises(ValueError):
        intake.assert_catalogue_only(statement)


@pytest.mark.parametrize("statement", [
    "select table_name from information_schema.columns c, information_schema.tables as t where c.table_name = t.table_name", "SELECT * FROM All_Tab_Columns", "select * from user_tables where comments = 'from users'", "with c as (select * from pg_catalog.pg_class) select * from c join sys.tables on true order by 1",
    "select * from (select * from information_schema.tables) x left join lateral (select * from pg_catalog.pg_attribute) y on true",
])
def test_catalogue_guard_accepts(statement):
    intake.assert_catalogue_only(statement)


@pytest.mark.parametrize("statement", ["select nextval('s')", "select pg_terminate_backend(1)", "SELECT load_extension('x')", "select pg_sleep (9)"])
def test_functions_that_act_are_no_reads(statement):
    with pytest.raises(ValueError):
        intake.assert_read_only(statement)


def test_tickets_and_repairs(spark):
    df = spark.createDataFrame([("UTF-8 and SHA-256, AB-1 AB-1 ABCDEFGHIJK-2 A-1 C2-3",)], "s string")
    assert df.select(intake.tickets(F.col("s"))).first()[0] == ["AB-1", "C2-3"]
    subjects = ["fix: lint of x", "fixes a format", "fix typo", "Fixed   imports", "prefix", "hotfix", "revert it", "we revert", "correct it", "fix(core)!: a"]
    rows = spark.createDataFrame([(str(i), s, "2024-01-02", ["f"]) for i, s in enumerate(subjects)], "sha string, subject string, ts string, files array<string>").withColumn("ts", F.to_timestamp("ts"))
    assert tuples(design.repaired_files(rows, "2024-01-01", "2024-01-03")) == [("f", 5)]


def test_fingerprints_of_fields_with_bars(spark):
    of = lambda rows: intake.fingerprint(spark.createDataFrame(rows, "m int, a string, b string"), ["m"], ["a", "b"]).first().fingerprint
    assert of([(1, "a|b", "c")]) != of([(1, "a", "b|c")]) and of([(1, None, "")]) != of([(1, "", None)]) and of([(1, "x", "y"), (1, "z", None)]) == of([(1, "z", None), (1, "x", "y")])


def test_roots_with_signs(spark):
    parents = spark.createDataFrame([("b", "a<1"), ("c", "b"), ("d", "zz")], "node string, parent string")
    assert tuples(graph.climb(parents, spark.createDataFrame([("a<1",)], "node string"))) == sorted([("a<1", "a<1", 0), ("b", "a<1", 1), ("c", "a<1", 2), ("d", None, None)], key=repr)


def test_failure_classes_in_order(spark):
    cases = [("500 at a.B.c(D.java:1)", None, None, None, "server-error"), ("NullPointerException", None, None, "setup", "test-data"), ("NullPointerException", None, None, "test", "unclassified"), ("", "200", "503", None, "unavailable"), ("x", "200", "404", None, "url-change"), (None, "a", "b", None, "status-change"), ("schema", None, None, None, "unclassified"), (None, None, None, None, "unclassified")]
    df = spark.createDataFrame([c[:4] for c in cases], "e string, w string, g string, p string")
    assert [r[0] for r in df.select(textrules.failure_class(*map(F.col, "ewgp"))).collect()] == [c[4] for c in cases]


def test_parentheses_to_the_end(spark):
    texts = ["(" * 9 + "a" + ")" * 9, "((a) OR (b))", "(a) AND (b)", "( ( (a b) ) )", "", "((", ")("]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(guards.strip_parens(F.col("t"))).collect()] == ["a", "(a) OR (b)", "(a) AND (b)", "a b", "", "((", ")("]


def test_circles_stay_in_their_workflow(spark):
    rows = [("a/b", "c", 1, ["d"], None), ("a/b", "d", 2, ["c"], None), ("a", "b/c", 1, ["d"], None), ("a", "d", 2, [], None), ("w", "self", 1, ["self"], None)]
    stages = spark.createDataFrame(rows, "workflow string, stage string, place int, requires array<string>, check string")
    df = workflow.lint(stages, spark.createDataFrame([], "check string"))
    assert tuples(df.where("rule = 'circle'"), "workflow", "stage") == [("a/b", "c"), ("a/b", "d"), ("w", "self")]
    assert "CartesianProduct" not in df._jdf.queryExecution().toString() and "BroadcastNestedLoopJoin" not in df._jdf.queryExecution().toString()
