"""Steps whose work must not outgrow their input: the same results as brute force, and plans without what grew."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re

from statewake.operators import evidence, graph, matching, patterns, retrieval, surfaces, synthesis, textrules, workflow


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_existing_tests_are_not_shuffled(spark):
    rng = random.Random(5)
    t = [(i, rng.choice(["get", "POST", None]), [rng.choice("abc") for _ in range(rng.randint(0, 3))], rng.choice([None, "", "s", "r"])) for i in range(20) for _ in range(2)]
    tests = [(i, rng.choice(["GET", "post", None]), rng.choice(["a", "b", "c", None]), rng.choice([None, "s", "q"])) for i in range(15) for _ in range(3)]
    df = surfaces.existing_tests(spark.createDataFrame(t, "id long, verb string, paths array<string>, service string"), spark.createDataFrame(tests, "test long, verb string, path string, service string"))
    want = {(i, x) for i, v, ps, s in t for x, w, p, o in tests if v and w and v.upper() == w.upper() and p in ps and (not s or not o or s == o)}
    assert sorted(map(tuple, df.collect())) == sorted(want)
    # no aggregate or exchange above the join of routes
    assert "Aggregate" not in re.split(r"\w*Join", plan(df))[0] and "Exchange" not in re.split(r"\w*Join", plan(df))[0].replace("AdaptiveSparkPlan", "")


def test_tests_of_a_route_meet_its_transitions_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(surfaces, "BLOCK", 7, raising=False)
    kinds = "id long, verb string, paths array<string>, service string", "test string, verb string, path string, service string"
    rng = random.Random(12)
    t = [(rng.choice([*range(40), None]), rng.choice(["get", "POST"]), [rng.choice("abc") for _ in range(rng.randint(0, 3))], rng.choice([None, "", "s", "r"])) for _ in range(90)]
    tests = [(rng.choice([*map(str, range(40)), None]), rng.choice(["GET", "post"]), rng.choice("abc"), rng.choice([None, "s", "q"])) for _ in range(90)]
    want = {(i, x) for i, v, ps, s in t for x, w, p, o in tests if v.upper() == w.upper() and p in ps and (not s or not o or s == o)}
    for broadcast in ("10m", "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
        try:
            df = surfaces.existing_tests(spark.createDataFrame(t, kinds[0]), spark.createDataFrame(tests, kinds[1]))
            assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want))
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # transitions of a block have the same run of tests in turn, in order
    names = sorted(f"t{i}" for i in range(50))
    df = surfaces.existing_tests(spark.createDataFrame([(i, "GET", ["/a"], "s") for i in range(60)], kinds[0]), spark.createDataFrame([(x, "GET", "/a", None) for x in names], kinds[1]))
    runs = [[r.test for r in g] for _, g in itertools.groupby(df.collect(), key=lambda r: r.id)]
    assert sum(map(len, runs)) == 3_000 and {tuple(r) for r in runs} == {tuple(names[i : i + 7]) for i in range(0, 50, 7)}


def test_circles_of_small_workflows_are_not_walked(spark, monkeypatch):
    rng = random.Random(6)
    stages = [(w, s, rng.randint(0, 3), sorted({rng.randint(0, 6) for _ in range(rng.randint(0, 3))}), None) for w in range(60) for s in range(5)]
    kind = "workflow int, stage int, place int, requires array<int>, check string"
    df, none = spark.createDataFrame(stages, kind), spark.createDataFrame([], "check string")
    want = set()
    for w, s, *_ in stages:
        seen, front = set(), {s}
        while front:
            front = {r for a, x, _, rs, _ in stages if a == w and x in front for r in rs if r < 5} - seen
            seen |= front
        want |= {(w, s)} if s in seen else set()
    circles = lambda: {(r.workflow, r.stage) for r in workflow.lint(df, none).where("rule = 'circle'").collect()}
    monkeypatch.setattr(graph, "SMALL", 3)
    assert circles() == want
    monkeypatch.undo()
    monkeypatch.setattr(graph, "setup_paths", None)
    assert circles() == want


def test_keys_of_several_elements_are_one_stream(spark):
    kind = "key int, id long, guard string"
    old, new = ([(k, b + i, f"k < {(i * s) % 7}") for k in range(40) for i in range(9)] for b, s in ((0, 3), (100, 5)))
    df = matching.pair_by_guard(spark.createDataFrame(old, kind), spark.createDataFrame(new, kind), ["key"])
    assert "MapInArrow" in plan(df) and "FlatMapGroups" not in plan(df)
    got, want = {(r.key, r.old_id, r.new_id) for r in df.collect()}, set()
    for k in range(40):
        left = [r for r in new if r[0] == k]
        for _, i, guard in (r for r in old if r[0] == k):
            best = max(left, key=lambda r: matching.ratio(guard, r[2]))
            left.remove(best)
            want.add((k, i, best[1]))
    assert got == want


def test_edges_of_repeated_facts_need_no_shuffle_to_be_distinct(spark):
    df = lambda rows, kind: spark.createDataFrame(rows, kind)
    endpoints = df([("s", "h", "GET", "/a", "C", True, None, None)] * 2, "service string, handler string, verb string, path string, handler_type string, validated boolean, body_type string, response_body string")
    checks = df([("s", "h::GET", "c1", "x", 1), ("s", "h::GET", "c1", "x", 2), ("s", "h::GET", "c2", "y", 1), ("s", "lost::GET", "c3", "z", 1)], "service string, endpoint_id string, id string, expression string, place int")
    outcomes = df([("s", n, "h::GET", 200, None, ["c1", "c1", "c9"], "") for n in (1, 2)] + [("s", 3, "gone::GET", 200, None, [], "")], "service string, seq long, endpoint_id string, status int, discriminator string, checks array<string>, sense string")
    security = df([], "service string, handler string, verb string, scheme string, expression string, roles array<string>")
    members = df([], "service string, owner string, owner_is_enum boolean, name string, type string, element_type string")
    edges, missing = evidence.references(endpoints, security, members, checks, outcomes)
    assert sorted(r.rel_type for r in edges.collect()) == ["CONSTRAINED_BY", "DECLARES", "GUARDED_BY"]
    assert sorted((r.rel_type, r.wanted) for r in missing.collect()) == [("CONSTRAINED_BY", "lost::GET"), ("DECLARES", "gone::GET"), ("GUARDED_BY", "c9")]
    assert edges._jdf.queryExecution().optimizedPlan().nodeName() == "Union"


def test_references_are_found_where_facts_are_dealt_once(spark, monkeypatch):
    monkeypatch.setattr(graph, "_written", None)
    df = lambda rows, kind: spark.createDataFrame(rows, kind)
    rng = random.Random(11)
    some = lambda *of: rng.choice(of)
    ends = [(some("s", "r", None), f"h{rng.randint(0, 4)}", "GET", f"/{rng.randint(0, 2)}", "C", True, None, None) for _ in range(8)]
    cks = [(some("s", "r", None), f"h{rng.randint(0, 6)}::GET", some("a", "b", "c", "d", "", None), some("x", "y", None), 1) for _ in range(40)]
    # equal ids of unlike facts: no endpoint and an empty one, no checks and none known, a check without a name
    outs = [(some("s", "r", None), i, some("h0::GET", "h1::GET", "h6::GET", "", None), some(200, None), None, some(["a"], ["a", None], ["b", "a", "b"], ["z"], [""], [], None), "") for i in range(60)]
    endpoints = df(ends, "service string, handler string, verb string, path string, handler_type string, validated boolean, body_type string, response_body string")
    checks, outcomes = df(cks, "service string, endpoint_id string, id string, expression string, place int"), df(outs, "service string, seq long, endpoint_id string, status int, discriminator string, checks array<string>, sense string")
    security = df([], "service string, handler string, verb string, scheme string, expression string, roles array<string>")
    members = df([], "service string, owner string, owner_is_enum boolean, name string, type string, element_type string")

    def digest(prefix, *parts):
        return f"{prefix}:{hashlib.sha256('|'.join('' if x is None else str(x) for x in parts).encode()).hexdigest()[:16]}"

    at, edges, missing = {}, set(), set()
    for s, h, v, path, *_ in ends:
        if s is not None:
            at[s, f"{h}::{v}"] = min(at.get((s, f"{h}::{v}"), "~"), digest("ep", s, v, path))
    named, used = [(s, i, e, digest("chk", s, i, x)) for s, e, i, x, _ in cks], set()
    for s, _, e, status, _, refs, sense in outs:
        oid = digest("out", s, e, status, None, ",".join(x for x in refs or [] if x is not None), sense)
        (edges.add((s, at[s, e], "DECLARES", oid)) if (s, e) in at else missing.add((s, oid, "DECLARES", e or "")))
        for r in refs or []:
            found = {k for t, i, _, k in named if (t, i) == (s, r) and None not in (s, r)}
            used |= {(s, r)} if found else set()
            edges |= {(s, oid, "GUARDED_BY", k) for k in found}
            missing |= set() if found else {(s, oid, "GUARDED_BY", r or "")}
    for s, i, e, k in named:
        if (s, i) not in used:
            (edges.add((s, at[s, e], "CONSTRAINED_BY", k)) if (s, e) in at else missing.add((s, k, "CONSTRAINED_BY", e)))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = evidence.references(endpoints, security, members, checks, outcomes)
        dealt = [re.findall(r"Exchange (\w+\([^)]*\))", plan(x)) for x in got]
        assert all(d and all(re.fullmatch(r"hashpartitioning\(service#\d+, \d+\)", x) for x in d) for d in dealt), dealt
        key = lambda rows: sorted(rows, key=repr)
        assert key((r.service, r.src, r.rel_type, r.dst) for r in got[0].collect()) == key(edges)
        assert key((r.service, r.id, r.rel_type, r.wanted) for r in got[1].collect()) == key(missing)
        assert {r.rel_type for r in got[0].collect()} == {r.rel_type for r in got[1].collect()} == {"DECLARES", "GUARDED_BY", "CONSTRAINED_BY"}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_facts_of_a_service_are_shuffled_once(spark):
    df = lambda rows, kind: spark.createDataFrame(rows, kind)
    n = range(12)
    endpoints = df([(f"s{i % 3}", f"h{i}", "POST" if i % 2 else "GET", f"/runs/{{id}}/x{i % 4}" if i % 4 else "/runs", "C", True, "T", "B") for i in n], "service string, handler string, verb string, path string, handler_type string, validated boolean, body_type string, response_body string")
    checks = df([(f"s{i % 3}", f"c{i}", ["r.isPresent()", "NOT (r.isPresent())", "p > 1"][i % 5 % 3], 1) for i in n] * 2, "service string, id string, expression string, place int")
    outcomes = df([(f"s{i % 3}", 100 * i + k, f"h{i}::{'POST' if i % 2 else 'GET'}", 200 + k, None, [f"c{i}", f"c{(i + 3 * k) % 12}"], "!" if k else "") for i in n for k in range(3)] + [(f"s{i % 3}", 9_000 + i, f"h{i}::{'POST' if i % 2 else 'GET'}", 404, "declared", [], "") for i in n], "service string, seq long, endpoint_id string, status int, discriminator string, checks array<string>, sense string")
    members = df([("s1", "T", "a", ["@NotNull"])], "service string, type_name string, name string, constraints array<string>")
    mappings = df([("s1", "Gone", 410, "C", "E")], "service string, exception string, status int, advice string, response_body string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        states, t, findings = synthesis.synthesise(endpoints, outcomes, checks, members, mappings)
        unfolded = synthesis.unfold(None, t)
        for each in (t, *unfolded[:2]):
            dealt = re.findall(r"Exchange (\w+\([^)]*\))", plan(each))
            assert dealt and all(re.fullmatch(r"hashpartitioning\(service#\d+, \d+\)", x) for x in dealt), dealt
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    rows = lambda x: sorted(map(repr, x.collect()))
    for a, b in zip(unfolded, synthesis.unfold(states, t), strict=True):
        assert rows(a) == rows(b)
    assert t.count() == 36 + 12 and {r.kind for r in findings.collect()} >= {"no-validation"} and unfolded[2].count()


def test_pairs_of_members_are_counted_by_tasks_of_a_size(spark, monkeypatch):
    rng = random.Random(8)
    monkeypatch.setattr(patterns, "BLOCK", 4)
    monkeypatch.setattr(patterns, "PAIRS_EACH", 50)
    rows = [(rng.choice([*range(30), None]), rng.choice([1, 1, 1, 2, 3, 4, None])) for _ in range(200)]
    df = patterns.co_members(spark.createDataFrame(rows, "m int, t int"), "m", "t")
    of = {t: sorted({m for m, x in rows if x == t and m is not None}) for t in (1, 2, 3, 4)}
    want = {}
    for ms in of.values():
        for i, a in enumerate(ms):
            for b in ms[i + 1 :]:
                want[a, b] = want.get((a, b), 0) + 1
    assert {(r.a, r.b): r.shared for r in df.collect()} == want
    n = -(-sum(len(ms) * (len(ms) - 1) // 2 for ms in of.values()) // 50)
    assert n > 1 and re.search(rf"Exchange hashpartitioning\(a#\d+, {n}\), REPARTITION_BY_NUM", plan(df))


def test_pairs_of_queries_and_documents_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "PIECE", 40)
    rng = random.Random(9)
    text = lambda n: " ".join(rng.choice("a b c d e f g h".split()) for _ in range(n))
    docs = [(i, text(rng.randint(1, 12))) for i in range(60)] + [(7, "a a b"), (None, "a h"), (None, "b"), (61, None), (62, "zz")] + [(i, "a b c") for i in range(70, 90)]
    queries = [(i, text(3)) for i in range(11)] + [(3, "a H"), (20, None), (21, "unknown")]
    df = retrieval.bm25(spark.createDataFrame(docs, "d long, text string"), spark.createDataFrame(queries, "q long, text string"), "d", "q", 4, block=5)
    tf, lens, want = {}, [len((t or "").split()) for _, t in docs], {}
    for i, t in docs:
        ws = (t or "").lower().split()
        for w in set(ws):
            tf.setdefault((i, len(ws)), {}).setdefault(w, 0)
            tf[i, len(ws)][w] += ws.count(w)
    asked = {w for _, t in queries for w in (t or "").lower().split()}
    n, avg = len(docs), sum(lens) / len(lens)
    for q, t in queries:
        for w in set((t or "").lower().split()):
            n_w = sum(w in x for x in tf.values())
            for (i, size), x in tf.items():
                if w in x and w in asked:
                    s = math.log(1 + (n - n_w + 0.5) / (n_w + 0.5)) * x[w] * 2.2 / (x[w] + 1.2 * (0.25 + 0.75 * size / avg))
                    want.setdefault(q, {}).setdefault(i, []).append(s)
    rows = {(q, i, r + 1, s) for q, of in want.items() for r, (s, i) in enumerate(sorted(((round(sum(v), 6), i) for i, v in of.items()), key=lambda x: (-x[0], x[1] is not None, x[1] or 0))[:4])}
    assert {(r.q, r.d, r.rank, r.score) for r in df.collect()} == rows
    # what is above the scores is one window over the best of each task
    above = plan(df).split("MapInArrow")[0]
    assert "MapInArrow" in plan(df) and "Aggregate" not in above and "WindowGroupLimit" in above


def test_mentions_are_made_distinct_by_tasks_of_a_size(spark, monkeypatch):
    monkeypatch.setattr(textrules, "BLOCK", 4, raising=False)
    monkeypatch.setattr(textrules, "PAIRS_EACH", 50, raising=False)
    rng = random.Random(10)
    docs = [(rng.choice([*range(20), None]), " ".join(rng.choice(["a", "B", "c", "d", "zz"]) for _ in range(4))) for _ in range(40)] + [(90, None)]
    names = [(rng.choice([*range(30), None]), rng.choice(["A", "b", "c", "q", None])) for _ in range(80)]
    df = textrules.mentions(spark.createDataFrame(docs, "d long, text string"), spark.createDataFrame(names, "n long, name string"), "d", "text", "n", "name")
    want = {(d, n) for d, t in docs for n, x in names if t and x and x.lower() in t.lower().split()}
    got = [(r.d, r.n) for r in df.collect()]
    assert len(got) == len(set(got)) and set(got) == want and df.columns == ["d", "n"]
    assert (m := re.search(r"Exchange hashpartitioning\(d#\d+L, _b#\d+L?, (\d+)\), REPARTITION_BY_NUM", plan(df))) and int(m[1]) > 1 and plan(df).split("Generate")[0].count("Exchange") == 0
