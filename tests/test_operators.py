"""Operators on small graphs with known answers."""

import random
import time

import pytest

from pyspark.sql import functions as F

from statewake.functions import scores
from statewake.operators import coverage, delta, design, generate, graph, guards, retrieval, temporal

EDGES = [("m", "t1", "A", "B"), ("m", "t2", "A", "C"), ("m", "t3", "B", "D"), ("m", "t0", "C", "D"), ("m", "t4", "E", "A")]


def edges(spark):
    return spark.createDataFrame([(*e, "x", 1, "implemented") for e in EDGES], "model_id string, id string, source string, target string, trigger string, n int, status string")


def test_shortest_path_keeps_the_smallest_ids(spark):
    start = spark.createDataFrame([("m", "A")], "model_id string, state string")
    got = {r.state: list(r.path) for r in graph.setup_paths(edges(spark), start).collect()}
    assert got == {"A": [], "B": ["t1"], "C": ["t2"], "D": ["t1", "t3"]}
    reach = {r.state: (r.depth, r.terminal) for r in graph.reachability(edges(spark), start).collect()}
    assert reach["D"] == (2, True) and reach["E"] == (None, False)


def test_guards(spark):
    rows = ["a AND NOT (b)", "a && b", "a OR b", "", None, "x <= -2.5"]
    df = spark.createDataFrame([(g,) for g in rows], "g string")
    got = [r[0] and [tuple(x) for x in r[0]] if r[0] is not None else None for r in df.select(F.transform(guards.conjuncts(F.col("g")), guards.literal)).collect()]
    assert got == [[("a", False), ("b", True)], [("a", False), ("b", False)], None, [], [], [("x <= -2.5", False)]]
    t = df.select(guards.threshold(F.col("g")).alias("t")).where("t is not null").first().t
    assert (t.name, t.op, t.bound) == ("x", "<=", -2.5)


def test_interval_overlap(spark):
    df = spark.createDataFrame([("<", 5.0, ">=", 5.0), ("<", 5.0, "<=", 5.0), (">", 5.0, "<", 5.0), ("<=", 5.0, ">=", 5.0), ("==", 3.0, "<", 4.0)], "o1 string, b1 double, o2 string, b2 double")
    got = [r[0] for r in df.select(guards.overlaps(guards.interval(F.col("o1"), F.col("b1")), guards.interval(F.col("o2"), F.col("b2")))).collect()]
    assert got == [False, True, False, True, True]


def test_truth_table(spark):
    rows = [("g", "p AND q"), ("g", "NOT p"), ("h", "(p)"), ("h", "NOT (p)"), ("or", "a"), ("or", "b OR c"), ("num", "x < 5"), ("num", "x >= 5"), ("bare", ""), ("none", None), *(("many", f"a{i}") for i in range(11))]
    df = spark.createDataFrame(rows, "k string, guard string")
    got = {r.k: (r.n_atoms, r.uncovered, r.first_uncovered, r.reason) for r in guards.truth_table(df, ["k"], "guard").collect()}
    bare = "a disjunction or no guard"
    assert got == {"g": (2, 1, 1, None), "h": (1, 0, None, None), "or": (None, None, None, bare), "num": (None, None, None, "a threshold, which is an interval"), "bare": (None, None, None, bare), "none": (None, None, None, bare), "many": (None, None, None, "more than 10 atoms")}
    assert guards.truth_table(df.limit(0), ["k"], "guard").count() == 0


def test_decision_rows_give_reasons(spark):
    df = spark.createDataFrame([("g", 2, "a"), ("g", 1, "a AND NOT b"), ("one", 1, "a"), ("or", 1, "a OR b"), ("or", 2, "c"), *(("many", i, f"a{i}") for i in range(7))], "k string, n int, guard string")
    got = {(r.k, r.row): (r.covering, r.reason) for r in design.decision_rows(df, ["k"], "guard", "n").collect()}
    assert got == {("g", 0): (None, None), ("g", 1): (1, None), ("g", 2): (None, None), ("g", 3): (2, None), ("one", None): (None, "one member"), ("or", None): (None, "a disjunction or no guard"), ("many", None): (None, "more than 6 atoms")}


def test_conjuncts_outside_parentheses(spark):
    df = spark.createDataFrame([("((a AND b))",), ("(a) AND (b AND c)",), ("NOT (a AND b)",), ("NOT x",), ("a OR b",), ("",), (None,), ("f(x) AND g(y)",), ("a AND a",)], "g string")
    got = [r[0] and [("!" if x.negated else "") + x.atom for x in r[0]] for r in df.select(guards.literals(F.col("g"))).collect()]
    assert got == [["a", "b"], ["a", "b AND c"], ["!a AND b"], ["!x"], None, None, None, ["f(x)", "g(y)"], ["a"]]
    pairs = spark.createDataFrame([("a AND b", "b AND a"), ("a AND b", "a AND NOT (b)"), ("a AND b", "NOT a AND NOT b"), ("a", "b"), ("a OR b", "a")], "x string, y string")
    assert [r[0] for r in pairs.select(guards.relation(guards.literals(F.col("x")), guards.literals(F.col("y")))).collect()] == ["identical", "complementary", "exclusive", None, None]


MACHINE = [("m", "t1", "S", "in", "A", "ok", True), ("m", "t2", "S", "in", "B", "NOT (ok)", True), ("m", "t3", "A", "go", "C", "", True), ("m", "t4", "C", "go", "D", "", False), ("m", "t5", "X", "go", "Y", "", True), ("m", "t6", "B", "up", "A", "", True)]


def test_one_path_for_each_target(spark):
    t = spark.createDataFrame(MACHINE, "model_id string, id string, source string, trigger string, target string, guard string, generatable boolean")
    setups = graph.setup_paths(generate.generatable(t), spark.createDataFrame([("m", "S")], "model_id string, state string"))
    got = {r.key: (r.outcome, r.setup, r.detail) for r in generate.paths(generate.all_transitions(t), t, setups, cap=0).collect()}
    assert got == {"t1": ("generated", [], None), "t2": ("generated", [], None), "t3": ("exceeds-cap", ["t1"], "requires 1 steps, cap is 0"), "t5": ("unreachable", None, "no route from an initial state"), "t6": ("exceeds-cap", ["t2"], "requires 1 steps, cap is 0")}
    pairs = {r.key: (r.outcome, r.setup) for r in generate.paths(generate.transition_pairs(t), t, setups).collect()}
    assert pairs == {"t1->t3": ("generated", ["t1"]), "t2->t6": ("generated", ["t2"]), "t3": ("unsatisfiable", None), "t5": ("unsatisfiable", None), "t6->t3": ("generated", ["t2", "t6"])}
    conditions = {r.key: (r.validates, r.reason) for r in generate.guard_conditions(t).collect()}
    assert conditions["t1::ok::false"] == ("t2", None) and conditions["t3::<unguarded>"] == ("t3", None) and len(conditions) == 7
    assert {r.part: r.n for r in generate.partition(generate.paths(generate.all_transitions(t), t, setups), t).collect()} == {"generated": 4, "unreachable": 1, "excluded": 1}


def test_setup_without_a_limit_and_labels(spark):
    n = 15
    chain = spark.createDataFrame([(1, f"e{i:02}", f"s{i}", f"s{i + 1}") for i in range(n)] * 2, "model_id long, id string, source string, target string")
    start = spark.createDataFrame([(1, "s0"), (1, "s0")], "model_id long, state string")
    assert sorted(r.depth for r in graph.setup_paths(chain, start).collect()) == list(range(n + 1))
    assert graph.setup_paths(chain.limit(0), start.limit(0)).count() == 0


def test_register_lint_in_any_case(spark):
    rows = [("a", "d", "c", "o", None, 2, 3, None, "Avoid"), ("b", "d", "c", "o", "opportunity", 2, 3, 6, "avoid"), ("c", "d", "c", "o", "Threat", 2, 3, 5, "EXPLOIT"), ("d", " ", "x", None, "sideways", 9, 1, 1, "Accept"), ("d", "d", "c", "o", None, None, 1, 1, None)]
    df = spark.createDataFrame(rows, "id string, description string, category string, owner string, polarity string, probability int, impact int, score int, response string")
    got = sorted((r.id, r.rule) for r in design.register_lint(df, ("C",)).collect())
    assert got == [("b", "response-polarity"), ("c", "response-polarity"), ("c", "score-stale"), ("d", "category"), ("d", "duplicate-id"), ("d", "no-description"), ("d", "no-owner"), ("d", "polarity"), ("d", "scale")]


def test_drift_and_upsert(spark):
    side = lambda d: spark.createDataFrame(list(d.items()), "case_id string, hash string")
    got = dict(map(tuple, delta.drift(side({"a": "1", "b": "1", "c": "1", "e": "1"}), side({"a": "1", "b": "2", "c": "1", "e": "1"}), side({"a": "1", "b": "3", "c": "2", "d": "1"}), "case_id").collect()))
    assert got == {"a": "UNCHANGED", "b": "MANUALLY_EDITED", "c": "CHANGED", "d": "NEW", "e": "OBSOLETE"}
    old = spark.createDataFrame([("a", "named", 1), ("b", None, 1)], "id string, name string, n int")
    new = spark.createDataFrame([("a", "other", 2), ("b", "other", 2), ("c", "c", 3)], "id string, name string, n int")
    assert sorted(map(tuple, delta.upsert(old, new, "id", ["name"], ["n"]).collect())) == [("a", "named", 2), ("b", "other", 2), ("c", "c", 3)]


def test_claims(spark):
    rows = spark.createDataFrame([("k", "x", 1, 1), ("k", "x", 2, 2), ("k", "y", 3, 3), ("k", "x", 4, 4)], "key string, text string, at int, tie int")
    claims = temporal.revisions(rows, "key", "text", "at", "tie")
    assert sorted(map(tuple, claims.select("revision", "text", "valid_from", "valid_to").collect())) == [(1, "x", 1, 3), (2, "y", 3, 4), (3, "x", 4, None)]
    assert [r.text for r in claims.where(temporal.valid_at(F.lit(3))).collect()] == ["y"] and temporal.current(claims).first().revision == 3


def test_scores_and_rules(spark):
    df = spark.createDataFrame([(5, 4), (6, 1), (1, 1)], "p int, i int")
    assert [r[0] for r in df.select(scores.band(scores.exposure(F.col("p"), F.col("i")))).collect()] == ["Very High", "refused", "Low"]
    kinds = spark.createDataFrame([("When x, the system shall y.",), ("the system shall y",)], "t string").select(retrieval.ears_kind(F.col("t")), scores.slug(F.col("t"))).collect()
    assert [tuple(k) for k in kinds] == [("EventDriven", "when-x-the-system-shall-y"), (None, "the-system-shall-y")]


def test_exclusion_order(spark):
    rows = spark.createDataFrame([("planned", "Disputed"), ("implemented", "Disputed"), ("implemented", "Rejected"), ("implemented", None), ("implemented", "Approved")], "s string, l string")
    assert [r[0] for r in rows.select(coverage.exclusion(F.col("s"), F.col("l"))).collect()] == ["excluded_planned", "excluded_disputed", "excluded_rejected", "excluded_unapproved", None]


def test_reachability_of_a_long_chain(spark):
    n = 67
    edges = spark.createDataFrame([(1, f"e{i:03}", f"s{i}", f"s{i + 1}", "implemented") for i in range(n)], "model_id long, id string, source string, target string, status string").coalesce(1)
    got = graph.reachability(edges, spark.createDataFrame([(1, "s0")], "model_id long, state string")).collect()
    assert {r.state: r.depth for r in got} == {f"s{i}": i for i in range(n + 1)} and [r.state for r in got if r.terminal] == [f"s{n}"]


@pytest.mark.parametrize("small", [2000, 3, 0])
def test_small_and_large_models_are_walked_alike(spark, monkeypatch, small):
    monkeypatch.setattr(graph, "SMALL", small)
    rng, rows, starts, want = random.Random(6), [], [], {}
    for m in range(12):
        n = rng.randint(1, 7)
        steps = [(rng.choice(["a", "b", "c"]) + str(i % 3), f"s{rng.randint(0, n)}", f"s{rng.randint(0, n)}") for i in range(rng.randint(0, 14))]
        begun = {f"s{rng.randint(0, n)}" for _ in range(rng.randint(0, 2))}
        rows += [(m, *s) for s in steps] + [(m, "z", None, "s0"), (m, "z", "s0", None)]
        starts += [(m, s) for s in begun]
        ways = {s: () for s in begun}
        front = dict(ways)
        while front:
            met = {}
            for s, way in front.items():
                for i, a, b in steps:
                    if a == s and b not in ways:
                        met[b] = min(met.get(b, (*way, i)), (*way, i))
            ways |= met
            front = met
        want |= {(m, s): list(w) for s, w in ways.items()}
    for cap in (None, 2):
        got = graph.setup_paths(spark.createDataFrame(rows, "model_id int, id string, source string, target string"), spark.createDataFrame(starts, "model_id int, state string"), cap).collect()
        assert {(r.model_id, r.state): r.path for r in got} == {k: w for k, w in want.items() if cap is None or len(w) <= cap} and all(r.depth == len(r.path) for r in got) and len(got) == len({(r.model_id, r.state) for r in got})


def test_a_chain_of_a_thousand_states(spark):
    n = 1000
    chain = spark.createDataFrame([(1, f"e{i:04}", f"s{i}", f"s{i + 1}") for i in range(n)], "model_id long, id string, source string, target string")
    began = time.time()
    got = graph.setup_paths(chain, spark.createDataFrame([(1, "s0")], "model_id long, state string"))
    assert sorted(r.depth for r in got.select("depth").collect()) == list(range(n + 1)) and time.time() - began < 60
