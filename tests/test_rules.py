"""Filters, text functions, matching, workflow, surfaces and intake on small tables: nulls, ties, repeated rows, empty tables."""

import json
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from statewake.functions import texts
from statewake.operators import filters, matching, reports, retrieval, risk, surfaces, validation, workflow
from statewake.sources import intake


def one(df, *cols):
    return [tuple(r) if len(cols) > 1 else r[0] for r in df.select(*cols).collect()]


def test_globs_and_labels(spark):
    df = spark.createDataFrame([("src/a/b/c.py",), ("src/c.py",), ("lib/x.js",), (None,)], "p string")
    assert one(df, filters.owner(F.col("p"), [("deep", ["src/**/c.py"]), ("any", ["**"])])) == ["deep", "deep", "any", None]
    assert one(df, filters.owner(F.col("p"), [("flat", ["src/*.py"]), ("one", ["lib/?.js"])])) == [None, "flat", "one", None]
    labels = spark.createDataFrame([("A",), ("B",), ("C",), (None,)], "l string")
    assert one(labels, filters.has_label(F.col("l"), "A", {"B": "A", "C": "B"})) == [True, True, True, None]


def test_pruned(spark):
    df = spark.createDataFrame([('{"a":{"b":[],"c":null},"d":0,"e":"x, y"}',), ('{"a":false}',), (None,)], "j string")
    assert one(df, filters.pruned(F.col("j"))) == ['{"a":{},"d":0,"e":"x, y"}', "{}", None]


def test_texts(spark):
    df = spark.createDataFrame([("Ünïcode ﬁ é",), ("plain",), (None,)], "t string")
    assert one(df, texts.fold("t")) == ["Unicode fi e", "plain", None]
    assert one(df.limit(1), texts.lucene_escape(F.lit('a+b (c) "d"/e'))) == ['a\\+b \\(c\\) \\"d\\"\\/e']
    assert one(df.limit(1), texts.search_text(F.lit("get_user"), F.lit("x"))) == ["get_user x get user"]
    props = spark.createDataFrame([({"f_user_name": "n", "f_user_name_min": "3", "f_user_id": "7", "other": "o"},)], "p map<string,string>")
    assert one(props, texts.nested_fields(F.col("p"), ["user", "user_name", "none"])) == [{"user": {"name": "n", "id": "7"}, "user_name": {"min": "3"}}]
    payload = spark.createDataFrame([('{"a":{"b":[{"c":5}]}}',), ("no json",), (None,)], "j string")
    assert one(payload, texts.dig(F.col("j"), "a.b.0.c")) == ["5", None, None]
    assert one(df.limit(1), texts.diagram_id(F.lit("9 lives!"))) == ["n_9_lives_"]


def _pairs(old, new):
    rows, left = [], list(new)
    for i, g in old:
        best = max(left, key=lambda x: SequenceMatcher(None, g, x[1]).ratio(), default=None)
        if best:
            left.remove(best)
        rows.append((i, best and best[0], "REMOVED" if not best else "UNCHANGED" if best[1] == g else "MODIFIED"))
    return rows + [(None, i, "ADDED") for i, _ in left]


def test_pairs_by_guard(spark):
    rng = random.Random(3)
    side = lambda base: [(rng.choice("kl"), rng.choice("mn"), base + i, " ".join(rng.choice(["ok", "late", "x < 5"]) for _ in range(rng.randint(0, 3)))) for i in range(12)]
    old, new = side(0), [*side(100), ("z", "z", 200, None)]
    kind = "key string, sub string, id long, guard string"
    got = matching.pair_by_guard(spark.createDataFrame(old, kind), spark.createDataFrame(new, kind), ["key", "sub"]).collect()
    want = []
    for key in {r[:2] for r in old + new}:
        of = lambda rows, key=key: sorted((i, " ".join((g or "").split())) for a, b, i, g in rows if (a, b) == key)
        want += [(*key, *r) for r in _pairs(of(old), of(new))]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    empty = spark.createDataFrame([], kind)
    assert matching.pair_by_guard(empty, empty, ["key", "sub"]).count() == 0


def test_renames_are_proposed_once(spark):
    rows = [("m", "state|open_order", "REMOVED"), ("m", "state|open", "REMOVED"), ("m", "state|opened_order", "ADDED"), ("m", "zzz", "ADDED"), ("m", "same", "UNCHANGED"), ("n", "state|open", "ADDED")]
    got = matching.rename_proposals(spark.createDataFrame(rows, "model_id string, key string, change string"), ["model_id"]).collect()
    first = SequenceMatcher(None, "state|open", "state|opened_order").ratio()
    assert [(r.removed_key, r.added_key) for r in got] == ([("state|open", "state|opened_order")] if first >= 0.6 else [("state|open_order", "state|opened_order")])


def test_keys(spark):
    df = spark.createDataFrame([("m", "api", "m::A"), ("m", None, "B")], "m string, s string, i string")
    assert one(df, matching.state_key(F.col("m"), F.col("s"), F.col("i"))) == ["m|api|A", "m|?|B"]
    assert one(df.limit(1), matching.transition_key(F.lit("a"), F.lit("go"), F.lit("b"))) == ["a=[go]=>b"]
    assert one(df.limit(1), matching.normal_guard(F.lit(" ( (a  AND\n b) ) "))) == ["a AND b"]


def test_nearest_is_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, [float(rng.randint(-3, 3)) for _ in range(3)], rng.randint(0, 2)) for i in range(60)] + [(100, None, 0), (101, [0.0, 0.0, 0.0], 1), (102, [float("nan"), 1.0, 1.0], 1), (103, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    q = df.where("vec_id % 10 = 0").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q"))
    got = {}
    for r in retrieval.nearest(df.repartition(5), q, k=3, index="label", block=2).collect():
        got.setdefault((r.q_id, r.label), []).append((-r.score, r.vec_id))
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
    want = {}
    for i, v, _ in rows:
        if i % 10 or v is None or not any(v):
            continue
        for label in range(3):
            best = sorted((-round(cos(v, u), 6), j) for j, u, g in rows if u is not None and g == label and j != i and len(u) == len(v) and any(u) and all(x == x for x in u))[:3]
            if best:
                want[i, label] = best
    assert {k: [(s + 0.0, j) for s, j in sorted(v)] for k, v in got.items()} == {k: [(s + 0.0, j) for s, j in v] for k, v in want.items()}
    assert retrieval.nearest(df, q.limit(0), k=3).count() == 0


def test_evidence_of_odd_rows(spark):
    ac = spark.createDataFrame([(1, None, None), (2, "", []), (3, "PUT the thing, see 404", ["a"])], "ac_id long, text string, areas array<string>")
    t = spark.createDataFrame([(9, "put", None, "s404", None, ["a"]), (8, None, None, None, None, None)], "id long, trigger string, route string, target string, target_name string, areas array<string>")
    assert [tuple(r) for r in matching.evidence(ac, t).collect()] == [(3, 9, "verb,status,area", 3)]


def test_order_and_severity(spark):
    rows = spark.createDataFrame([("m", "b", 5, None), ("m", "a", 5, 0), ("m", "c", 5, 3), ("m", "d", 1, 9)], "m string, id string, detection int, technical int")
    assert [r.id for r in risk.order(rows, ["m"]).orderBy("rank").collect()] == ["c", "a", "b", "d"]
    assert one(spark.createDataFrame([("minor",), ("critical",), ("odd",), (None,)], "s string"), risk.by_severity(F.col("s"))) == [3, 1, 5, 5]


def test_no_threshold_decides_nothing(spark):
    left = spark.createDataFrame([("m", "x", "High", "unnoticed")], "model_id string, id string, band string, part string")
    models = spark.createDataFrame([("m",), ("n",), ("n",)], "model_id string")
    assert {r.model_id: (r.unnoticed, r.within) for r in risk.exit_criteria(left, models, ["model_id"]).collect()} == {"m": (1, None), "n": (0, None)}
    assert {r.model_id: r.within for r in risk.exit_criteria(left, models, ["model_id"], {"unnoticed": 0}).collect()} == {"m": False, "n": True}


def test_links_keep_their_confirmation(spark):
    kind = "ui_id string, api_id string, confirmed boolean, proposed_by string"
    old = spark.createDataFrame([("u", "a", True, "one"), ("u", "b", False, "one")], kind)
    new = spark.createDataFrame([("u", "a", False, "two"), ("v", "a", False, "two"), ("v", "a", False, "two")], kind)
    assert sorted(map(tuple, surfaces.upsert_links(old, new).collect())) == [("u", "a", True, "two"), ("u", "b", False, "one"), ("v", "a", False, "two")]


def test_executions_are_refused_with_a_reason(spark):
    rows = spark.createDataFrame([(" c ", "PASSED", "t", None, None), (None, "passed", None, 1, None), ("d", None, None, 1, None), ("d", "flaky", None, 1, "x")], "case_id string, outcome string, observed_at string, duration_ms int, detail string")
    good, bad = intake.executions(rows)
    assert [tuple(r) for r in good.select("id", "duration_ms", "detail").collect()] == [("c::t::passed", 0, "")]
    assert sorted(r.reason for r in bad.collect()) == ["no case_id", "outcome '' is not known", "outcome 'flaky' is not known"]


def test_guards_on_sources():
    for good in ("select 1", "WITH a AS (SELECT 1) SELECT * FROM a;", "select 'delete from t' as x", "explain select 1"):
        intake.assert_read_only(good)
    for bad in ("delete from t", "select 1; drop table t", "explain analyze select 1", "with a as (delete from t returning 1) select * from a", "select * into x from t", ""):
        with pytest.raises(ValueError):
            intake.assert_read_only(bad)
    intake.assert_catalogue_only("select * from information_schema.columns")
    with pytest.raises(ValueError):
        intake.assert_catalogue_only("select * from customers")
    intake.assert_allowed(["https://h.example/x"], ("h.example",))
    for bad in ("http://h.example", "https://other.example"):
        with pytest.raises(ValueError):
            intake.assert_allowed([bad], ("h.example",))


def test_documents_and_history(spark, tmp_path):
    put = lambda n, t: (tmp_path / n).write_text(t) and str(tmp_path / n)
    doc = {"knowledge_version": "1", "area": "a", "entities": [{"id": "e", "name": "E", "rules": ["r1", "r2"]}, {"id": "f", "name": "F"}]}
    assert sorted((r.id, r.rule) for r in intake.knowledge(spark, put("k.json", json.dumps(doc))).collect() if r.rule) == [("e", "r1"), ("e", "r2")]
    with pytest.raises(Exception, match="not known"):
        intake.knowledge(spark, put("k2.json", json.dumps({**doc, "knowledge_version": "9"}))).collect()
    log = "\x01abc\x022024-01-02T03:04:05+00:00\x02fix AB-1: x\n\nsrc/a.py\nsrc/b.py\n\x01def\x022024-01-03T00:00:00+00:00\x02docs\n"
    got = intake.history(spark, put("log.txt", log)).collect()
    assert [(r.sha, r.subject, r.files) for r in got] == [("abc", "fix AB-1: x", ["src/a.py", "src/b.py"]), ("def", "docs", [])]
    inventory = {"tests": [{"test": "T", "verb": "get", "paths": ["/a", "/b"], "statuses": [200]}, {"test": "U", "verb": "get", "paths": ["/a"]}]}
    assert sorted((r.test, r.path, r.asserts) for r in intake.test_inventory(spark, put("t.json", json.dumps(inventory))).collect()) == [("T", "/a", True), ("T", "/b", True), ("U", "/a", False)]
    rows, more, out = intake.bounded(spark.createDataFrame([(i, "x", "y") for i in range(5)], "id int, email string, last_name string"), 3)
    assert rows.count() == 3 and more and out == ["email", "last_name"]
    good, bad = intake.intakes(spark, put("i.json", json.dumps({"intakes": [{"id": "a", "status": "available"}, {"id": "", "status": "planned"}, {"id": "c", "status": "?"}]})))
    assert good.count() == 1 and sorted(r.reason for r in bad.collect()) == ["no id", "status is not known"]


def test_findings_of_a_model(spark):
    t = spark.createDataFrame(
        [("m", "t1", "S", "go", "A", "implemented", "", "GET", 0, 200), ("m", "t2", "S", "go", "B", "implemented", "x < 5", "POST", 0, 404), ("m", "t3", "A", "in", "B", "implemented", "x < 5", "GET", 0, 404), ("m", "t4", "A", "in", "C", "implemented", "x > 5", "GET", 0, 404), ("m", "t5", "B", "in", "C", "planned", "a OR b", "PUT", 0, 404), ("m", "t6", "C", "up", "S", "implemented", "NOT (E is thrown)", "GET", None, 422)],
        "model_id string, id string, source string, trigger string, target string, status string, guard string, verb string, n_inputs int, outcome_status int",
    )
    states = spark.createDataFrame([("m", s, n, "api") for s, n in (("S", "s"), ("A", "same"), ("B", "Same "), ("C", None), ("X", "x"))], "model_id string, state string, name string, surface string")
    reached = spark.createDataFrame([("m", "S", 0, False), ("m", "A", 1, False), ("m", "B", 1, True), ("m", "C", 2, False)], "model_id string, state string, depth int, terminal boolean")
    found = sorted((r.check_no, r.severity, r.elements, r.detail) for r in validation.validate(t, states, reached).collect())
    assert found == sorted([
        (1, "blocking", "A,B", "states that present alike"), (1, "blocking", "C", "no name"), (2, "blocking", "t1,t2", "unguarded sibling"), (3, "blocking", "t3,t4", "gap between thresholds"), (4, "unverifiable", "t2", "takes a body, and no input is known"),
        (5, "blocking", "t6", "a rejection on an exception not thrown"), (7, "advisory", "B", "terminal"), (7, "blocking", "X", "unreachable"),
    ])
    empty = validation.validate(t.limit(0), states.limit(0), reached.limit(0), t.limit(0))
    assert empty.count() == 0
    gate = validation.gate(spark.createDataFrame([("m",), ("clean",)], "model_id string"), validation.validate(t, states, reached)).collect()
    assert {r.model_id: r.valid for r in gate} == {"m": False, "clean": True}


def test_workflow_of_repeated_runs(spark):
    stages = spark.createDataFrame([("w", "a", 1, [], True), ("w", "b", 2, ["a"], False)], "workflow string, stage string, place int, requires array<string>, blocking boolean")
    runs = spark.createDataFrame([(1, "w", "a", "failed", "f", 1), (1, "w", "a", "ok", "f", 2), (1, "w", "a", "ok", "f", 2), (2, "w", "a", "failed", "f", 1)], "run_id long, workflow string, stage string, outcome string, fingerprint string, ended int")
    current = spark.createDataFrame([(1, "w", "f"), (2, "w", "f")], "run_id long, workflow string, fingerprint string")
    assert {(r.run_id, r.stage): r.reasons for r in workflow.eligibility(stages, runs, current).collect()} == {(1, "a"): "", (1, "b"): "", (2, "a"): "", (2, "b"): "not-ok:a"}
    assert {r.run_id: (r.stage, r.stopped) for r in workflow.next_stage(stages, runs).collect()} == {1: ("b", False), 2: ("a", True)}


def test_nothing_measured_is_no_zero(spark):
    types = spark.createDataFrame([("A",), ("B",)], "owner string")
    got = {r.owner: (r.max_complexity, r.methods) for r in reports.type_metrics(types, spark.createDataFrame([("A", 0, 5), ("B", 2, 1), ("B", 3, 1)], "owner string, complexity int, size int")).collect()}
    assert got == {"A": (None, None), "B": (3, 2)}
