"""Chains, synthesis, unfolding and the evidence layer against plain Python on random facts."""

import itertools
import json
import random
import re

import pytest

from statewake.operators import evidence, synthesis
from statewake.sources import extraction

CHECKS = "service string, endpoint_id string, id string, expression string, place int"
ENDPOINTS = "service string, handler string, verb string, path string, handler_type string, validated boolean, body_type string, response_body string"
OUTCOMES = "service string, seq long, endpoint_id string, status int, discriminator string, checks array<string>, sense string"
MEMBERS = "service string, type_name string, name string, constraints array<string>"
MAPPINGS = "service string, exception string, status int, advice string, response_body string"
STATES = "service string, state string, is_initial boolean, condition string"
T = "service string, id string, source string, trigger string, target string, guard string, outcome_status int, source_unresolved boolean"


def tuples(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


# chains
def plain_chain(checks, edges):
    """All orders that the facts allow, by trying every permutation."""
    ids = [c[0] for c in checks]
    place = dict(checks)
    before = {(a, b) for a in ids for b in ids if place[a] is not None and place[b] is not None and place[a] < place[b]} | {e for e in edges if e[0] in place and e[1] in place}
    orders = [p for p in itertools.permutations(ids) if all(p.index(a) < p.index(b) for a, b in before if a != b)] if not any(a == b for a, b in before) else []
    return ("cycle", None) if not orders else ("tie", None) if len(orders) > 1 else (None, list(orders[0]))


def test_chains_like_all_permutations(spark):
    rng = random.Random(1)
    checks, edges, want = [], [], {}
    for k in range(150):
        n = rng.randint(1, 5)
        mine = [(f"c{i}", rng.choice([None, 1, 2, 3, 4, i + 1, i + 1])) for i in range(n)]
        more = [tuple(rng.sample([c for c, _ in mine], 2)) for _ in range(rng.randint(0, 4))] if n > 1 else []
        checks += [("s", f"e{k}", c, f"x{c}", p) for c, p in mine]
        edges += [("s", f"e{k}", *e) for e in more]
        want[f"e{k}"] = plain_chain(mine, set(more))
    df = synthesis.chains(spark.createDataFrame(checks, CHECKS), spark.createDataFrame(edges, "service string, endpoint_id string, first string, later string"))
    rows = {r.endpoint_id: r for r in df.collect()}
    assert {k: (r.reason, [x.id for x in r.chain] if r.reason is None else None) for k, r in rows.items()} == want
    assert {"cycle", "tie", None} == {w[0] for w in want.values()} and all((r.unordered != "") == (r.reason is not None) for r in rows.values())


def test_guards_and_cost_of_a_chain(spark):
    checks = [("s", "e", "auth", "isAuthenticated", 1), ("s", "e", "authz", "hasRole", 2), ("s", "e", "body", "valid", 3), ("s", "f", "a", "x", 1), ("s", "f", "b", "y", 1)]
    chain = synthesis.chains(spark.createDataFrame(checks, CHECKS))
    assert dict((r.id, r.guard) for r in synthesis.chain_guards(chain).collect()) == {
        "auth": "NOT (isAuthenticated)", "authz": "isAuthenticated AND NOT (hasRole)", "body": "isAuthenticated AND hasRole AND NOT (valid)", None: "isAuthenticated AND hasRole AND valid"
    }
    variants = spark.createDataFrame([("s", "e", "auth", 3), ("s", "e", "authz", 2), ("s", "e", "body", 10), ("s", "e", "body", 10), ("s", "f", "a", 0)], "service string, endpoint_id string, id string, n int")
    cost = {r.endpoint_id: (r.bounded, r.product, r.exploded, r.reason) for r in synthesis.chain_cost(chain, variants).collect()}
    assert cost == {"e": (13.0, 60.0, False, None), "f": (4.0, 4.0, True, "tie")}
    assert synthesis.chains(spark.createDataFrame([], CHECKS)).collect() == []


# synthesis
def label(text, pattern):
    return "".join(p[:1].upper() + p[1:] for p in re.split(pattern, text) if p)


def resource(path):
    return re.sub(r"/\{.*", "", path).rstrip("/") or "/"


def plain_model(endpoints, outcomes, checks, members, mappings):
    """Transitions as {id: (source, trigger, target, guard, status, claim, body)}."""
    by_handler, words = {e[1]: e for e in endpoints}, {c[2]: c[3] for c in checks}
    declared, built, causes, bodies = {}, {}, {}, {}
    for _, _, ep, status, kind, *_ in outcomes:
        if status is not None:
            (declared if kind == "declared" else built).setdefault(ep, set()).add(status)
    for ep in {o[2] for o in outcomes}:
        e = by_handler.get(ep.rsplit("::", 1)[0])
        for _, exc, status, advice, body in mappings:
            if e and e[4] == advice and not 200 <= status < 300:
                declared.setdefault(ep, set()).add(status)
                causes.setdefault(ep, set()).add(exc)
                bodies.setdefault(ep, set()).add(body)
    statuses = {}
    for _, exc, status, _, _ in mappings:
        statuses.setdefault(exc, set()).add(status)
    rejections = {}
    for ep, found in declared.items():
        e, open_ = by_handler.get(ep.rsplit("::", 1)[0]), sorted(s for s in found - built.get(ep, set()) if not 200 <= s < 300)
        if not open_ or e is None:
            continue
        constrained = any(m[1].split(".")[-1] == (e[6] or "").split(".")[-1] and m[3] for m in members)
        valid = e[5] and e[6] and constrained and statuses.get(synthesis.VALIDATION_EXCEPTION) == {open_[0]}
        cause = causes.get(ep, set()) - {synthesis.VALIDATION_EXCEPTION}
        real = bodies.get(ep, set()) - {""}
        body = real.pop() if len(real) == 1 else ""
        if valid:
            rejections[ep] = (open_[0], "payload_valid", "NOT (payload_valid)", "derived-validation", body)
        elif len(cause) == 1:
            (c,) = cause
            rejections[ep] = (open_[0], f"NOT ({c} is thrown)", f"{c} is thrown", "advice-scope", body)
        else:
            rejections[ep] = (open_[0], "request_accepted", "NOT (request_accepted)", "declared", body)
    out = {}
    start = lambda trigger: (lambda p: "Ready" if not p or resource(p) == "/" else label(resource(p), "[/_-]"))(trigger.partition(" ")[2].strip())
    state = lambda e, status, kind: (label(f"{e[2].lower()} {e[3]}" if e else kind or "", "[^A-Za-z0-9]+") or "Outcome") + str(status or 0)
    for _, _, ep, status, kind, guards, sense in sorted(outcomes, key=lambda o: o[1]):
        if kind == "declared":
            continue
        e = by_handler.get(ep.rsplit("::", 1)[0])
        trigger = f"{e[2]} {e[3]}" if e else ep.rsplit("::", 1)[-1]
        parts = [f"NOT ({words[g]})" if sense == "!" else words[g] for g in guards if g in words]
        if ep in rejections:
            parts.insert(0, rejections[ep][1])
        body = "" if status in (204, 304) or 100 <= (status or 0) < 200 else (e[7] or "") if e else ""
        target = state(e, status, kind)
        out[f"{ep}->{target}"] = (start(trigger), trigger, target, " AND ".join(parts), status, "constructed", body)
    for ep, (status, _, guard, claim, body) in rejections.items():
        e = by_handler[ep.rsplit("::", 1)[0]]
        trigger, target = f"{e[2]} {e[3]}", state(e, status, "rejected")
        out[f"{ep}->{target}"] = (start(trigger), trigger, target, guard, status, claim, body)
    return out


def random_facts(rng):
    s, endpoints, outcomes, checks, mappings = "svc", [], [], [], []
    for i in range(rng.randint(1, 8)):
        path = rng.choice(["/metric", "/metric/{id}", "/tms/execution", "/tms/execution/{id}/x", "/a-b_c", "/", "/project/all"])
        endpoints.append((s, f"C{i % 3}.m{i}", rng.choice(["GET", "POST", "PUT"]), path, f"C{i % 3}", rng.random() < 0.5, rng.choice([None, "", "x.Dto", "Dto", "Other"]), rng.choice(["", "Dto"])))
    ids = [f"{e[1]}::{e[2]}" for e in endpoints] + ["Lost.m::GET", "bare"]
    for i in range(6):
        checks.append((s, None, f"chk-{i}", rng.choice(["t.isEmpty()", "x.isPresent()", "a > 1", "ok"]), i))
    for seq in range(rng.randint(0, 25)):
        outcomes.append((s, seq, rng.choice(ids), rng.choice([200, 201, 204, 400, 404, 409, None]), rng.choice(["declared", "ok", "noContent", None]), rng.sample([f"chk-{i}" for i in range(8)], rng.randint(0, 2)), rng.choice(["", "!"])))
    members = [(s, "x.Dto", "f", ["@NotNull"]), (s, "Other", "g", []), (s, "Dto", "h", ["@Size(min=1)", "@NotNull"])][: rng.randint(0, 3)]
    for exc in rng.sample([synthesis.VALIDATION_EXCEPTION, "Gone", "Conflict", "Denied"], rng.randint(0, 4)):
        for _ in range(rng.randint(1, 2)):
            mappings.append((s, exc, rng.choice([400, 404, 409]), rng.choice(["C0", "C1", "Global"]), rng.choice(["", "ErrorDto"])))
    return endpoints, outcomes, checks, members, mappings


def frames(spark, facts):
    return [spark.createDataFrame(x, k) for x, k in zip(facts, (ENDPOINTS, OUTCOMES, CHECKS, MEMBERS, MAPPINGS))]


def merged(many):
    """Facts of several services in one set of tables."""
    return [[(f"s{k}", *row[1:]) for k, facts in enumerate(many) for row in facts[i]] for i in range(5)]


def test_synthesis_like_plain_python(spark):
    rng = random.Random(5)
    many = [random_facts(rng) for _ in range(60)]
    states, t, findings = synthesis.synthesise(*frames(spark, merged(many)))
    got = {(r.service, r.id): (r.source, r.trigger, r.target, r.guard, r.outcome_status, r.claim, r.response_body) for r in t.collect()}
    want = {(f"s{k}", i): v for k, facts in enumerate(many) for i, v in plain_model(*facts).items()}
    assert got == want and {v[5] for v in want.values()} == {"constructed", "derived-validation", "advice-scope", "declared"}
    names = {(k, s) for (k, _), v in want.items() for s in (v[0], v[2])}
    assert {(r.service, r.state) for r in states.collect()} == names
    silent = {(f"s{k}", e[1]) for k, facts in enumerate(many) for e in facts[0]} - {(k, i.rsplit("->", 1)[0].rsplit("::", 1)[0]) for k, i in want}
    assert {(r.service, r.subject) for r in findings.where("kind = 'nothing-derived'").collect()} == silent and silent


def test_synthesis_of_nothing(spark):
    empty = [spark.createDataFrame([], k) for k in (ENDPOINTS, OUTCOMES, CHECKS, MEMBERS, MAPPINGS)]
    assert [df.collect() for df in synthesis.synthesise(*empty)] == [[], [], []]
    facts = [[("s", "C.m", "GET", "/x", "C", False, None, None)], [], [], [], []]
    states, t, findings = synthesis.synthesise(*frames(spark, facts))
    assert states.collect() == t.collect() == [] and tuples(findings, "kind", "subject") == [("nothing-derived", "C.m")]


# unfolding
PRESENCE = re.compile(r"^(?:NOT\s*\()?\s*([A-Za-z_][\w.]*)\.(isEmpty|isPresent)\(\)\s*\)?$")


def plain_unfold(states, t):
    atoms = lambda g: [a.strip() for a in re.split(r"\s+AND\s+", g or "", flags=re.I) if a.strip()]
    drop = lambda g, a: " AND ".join(x for x in atoms(g) if x != a)
    states, out = {s: list(v) for s, v in states.items()}, {i: list(v) for i, v in t.items()}
    creators, readers, absent, stuck = {}, [], [], set()
    for i, (_, trigger, _, guard, status) in t.items():
        verb, _, path = trigger.partition(" ")
        if path and verb.upper() in ("POST", "PUT") and 200 <= (status or 0) < 300:
            creators.setdefault(resource(path), []).append(i)
        for a in atoms(guard):
            if m := PRESENCE.match(a):
                present = (m[2] == "isPresent") != bool(re.match(r"^NOT\s*\(", a))
                (readers if present else absent).append((i, a, resource(path) if path else None))
                break
    done = set()
    for i, a, r in readers:
        if r is None or r not in creators:
            stuck.add(i)
            continue
        name = label(r, "[/_-]") or "Resource"
        done.add(r)
        states.setdefault(f"{name}Present", [False, ""])
        out[i][0], out[i][3] = f"{name}Present", drop(out[i][3], a)
        for c in creators[r]:
            out[c][2] = f"{name}Present"
    for i, a, r in absent:
        if r in done and out[i][0] == (label(r, "[/_-]") or "Resource"):
            out[i][3] = drop(out[i][3], a)
            if not states[out[i][0]][1]:
                states[out[i][0]][1] = "no " + " ".join(w.lower() for w in re.split("[/_-]", r) if w) + " exists"
    used = {s for v in out.values() for s in (v[0], v[2])}
    return {s: tuple(v) for s, v in states.items() if s in used or v[0]}, {i: tuple(v) for i, v in out.items()}, stuck


def test_unfolding_like_plain_python(spark):
    rng = random.Random(9)
    rows, names, want = [], [], []
    for k in range(80):
        t = {}
        for i in range(rng.randint(1, 9)):
            path = rng.choice(["/metric", "/metric/{id}", "/tms/run", "/tms/run/{id}", "/other/{x}", ""])
            verb = rng.choice(["GET", "POST", "put", "DELETE"])
            guard = " AND ".join(rng.sample(["t.isEmpty()", "NOT (t.isEmpty())", "x.isPresent()", "NOT (a.b.isPresent())", "n > 3", "ok"], rng.randint(0, 3)))
            r = resource(path) if path else ""
            t[f"t{i}"] = (label(r, "[/_-]") if rng.random() < 0.8 and r not in ("", "/") else "Ready", f"{verb} {path}" if path else verb, f"S{rng.randint(0, 4)}", guard, rng.choice([200, 201, 204, 404, None]))
        states = {}
        for v in t.values():
            states[v[0]] = (True, "")
            states.setdefault(v[2], (False, ""))
        states["Unused"] = (False, "")
        states["Idle"] = (True, "kept")
        want.append(plain_unfold(states, t))
        rows += [(f"s{k}", i, v[0], v[1], v[2], v[3], v[4], False) for i, v in t.items()]
        names += [(f"s{k}", s, *v) for s, v in states.items()]
    states, t, findings = synthesis.unfold(spark.createDataFrame(names, STATES), spark.createDataFrame(rows, T))
    got_t = {(r.service, r.id): (r.source, r.trigger, r.target, r.guard, r.outcome_status) for r in t.collect()}
    assert got_t == {(f"s{k}", i): v for k, w in enumerate(want) for i, v in w[1].items()}
    assert {(r.service, r.state): (r.is_initial, r.condition) for r in states.collect()} == {(f"s{k}", s): v for k, w in enumerate(want) for s, v in w[0].items()}
    stuck = {(f"s{k}", i) for k, w in enumerate(want) for i in w[2]}
    assert {(r.service, r.id) for r in t.where("source_unresolved").collect()} == stuck == {(r.service, r.subject) for r in findings.where("kind = 'source-unresolved'").collect()} and stuck
    moved = [w for w in want if any(s.endswith("Present") for s in w[0])]
    assert moved and any(v[1] for w in want for v in w[0].values() if v[1] != "kept")


# reports and evidence
REPORT = {
    "contract_version": "1", "repo": "demo",
    "endpoints": [
        {"http_method": "POST", "path": "/metric", "handler_method_id": "M.save", "handler_type": "M", "validated": True, "response_body": "", "anchor": {"file": "metrics/M.java", "line": 1, "commit": "c"}, "parameters": [{"name": "b", "location": "body", "type_name": "x.Dto"}], "security": [{"scheme": "role", "expression": "ADMIN", "roles": ["b", "a"]}, {"scheme": "", "expression": "", "roles": []}]},
        {"http_method": "GET", "path": "/metric/{id}", "handler_method_id": "M.get", "handler_type": "M", "validated": False, "response_body": "Page<Dto>", "anchor": {"file": "metrics/M.java", "line": 9, "commit": "c"}, "parameters": [], "security": []},
        {"http_method": "GET", "path": "/other", "handler_method_id": "O.get", "handler_type": "O", "validated": False, "response_body": "Long", "anchor": {"file": "others/O.java", "line": 9, "commit": "c"}},
    ],
    "checks": [{"id": "c1", "expression": "t.isEmpty()", "order": 1, "endpoint_id": "M.get::GET"}, {"id": "c2", "expression": "free", "order": 1, "endpoint_id": "O.get::GET"}, {"id": "c3", "expression": "lost", "order": 1, "endpoint_id": "X::GET"}],
    "outcomes": [
        {"endpoint_id": "M.save::POST", "status": 201, "discriminator": "created", "guarding_check_ids": []}, {"endpoint_id": "M.save::POST", "status": 400, "discriminator": "declared", "guarding_check_ids": []},
        {"endpoint_id": "M.get::GET", "status": 200, "discriminator": "ok", "guarding_check_ids": ["c1"], "guard_sense": "!"}, {"endpoint_id": "M.get::GET", "status": 204, "discriminator": "noContent", "guarding_check_ids": ["c1", "c9"]},
        {"endpoint_id": "Y::GET", "status": 200, "discriminator": "ok", "guarding_check_ids": []},
    ],
    "members": [{"type_name": "Dto", "owner_full_name": "x.Dto", "name": "kind", "type_full_name": "x.Kind", "constraints": ["@NotNull"]}, {"type_name": "Kind", "owner_full_name": "x.Kind", "owner_is_enum": True, "name": "A", "type_full_name": "java.lang.String", "constraints": []}, {"type_name": "Dto", "owner_full_name": "x.Dto", "name": "next", "type_full_name": "java.util.List", "element_type": "Kind", "constraints": []}],
    "exception_mappings": [{"exception_type": "MethodArgumentNotValidException", "status": 400, "advice_type": "Advice", "response_body": "ErrorDto"}],
}


@pytest.fixture
def facts(spark, tmp_path):
    (tmp_path / "report.json").write_text(json.dumps(REPORT))
    return lambda **k: extraction.extraction_report(spark, str(tmp_path / "report.json"), **k)


def test_report_to_model(spark, facts):
    f = facts()
    states, t, findings = synthesis.synthesise(f["endpoints"], f["outcomes"], f["checks"], f["members"], f["mappings"])
    states, t, more = synthesis.unfold(states, t)
    assert tuples(t, "source", "trigger", "target", "guard", "outcome_status") == sorted([
        ("Metric", "POST /metric", "MetricPresent", "payload_valid", 201), ("Metric", "POST /metric", "PostMetric400", "NOT (payload_valid)", 400),
        ("MetricPresent", "GET /metric/{id}", "GetMetricId200", "", 200), ("Metric", "GET /metric/{id}", "GetMetricId204", "", 204), ("Ready", "GET", "Ok200", "", 200),
    ], key=repr)
    assert dict(tuples(states, "state", "condition"))["Metric"] == "no metric exists" and dict(tuples(states, "state", "is_initial"))["Metric"]
    assert tuples(findings.where("kind = 'nothing-derived'"), "subject") == [("O.get",)]
    checks = synthesis.recovered_checks(f["endpoints"], f["checks"], f["members"], f["mappings"])
    assert tuples(checks.where("endpoint_id = 'M.save::POST'"), "id", "expression", "place") == [("dim-validation", "payload_valid", 0)]


def test_report_of_one_service_and_version(spark, facts, tmp_path):
    f = facts(service="others")
    assert tuples(f["endpoints"], "path") == [("/other",)] and tuples(f["checks"], "id") == [("c2",)] and f["outcomes"].count() == 0
    (tmp_path / "report.json").write_text(json.dumps(REPORT | {"contract_version": "7"}))
    with pytest.raises(Exception, match="contract_version 7 is not known"):
        facts()["endpoints"].collect()
    (tmp_path / "report.json").write_text(json.dumps({"contract_version": "1"}))
    assert all(df.count() == 0 for df in facts().values())


def test_evidence_layer(spark, facts):
    f = facts()
    nodes, edges, missing = evidence.evidence_layer(*(f[k] for k in ("endpoints", "security", "members", "mappings", "checks", "outcomes")))
    count = lambda df, c: {r[c]: r["count"] for r in df.groupBy(c).count().collect()}
    assert count(nodes, "label") == {"Endpoint": 3, "SecurityScheme": 1, "Class": 1, "Enum": 1, "ExceptionMapping": 1, "Check": 3, "DeclaredOutcome": 5}
    assert count(edges, "rel_type") == {"SECURED_BY": 1, "OF_TYPE": 1, "DECLARES": 4, "GUARDED_BY": 2, "CONSTRAINED_BY": 1}
    assert tuples(missing, "rel_type", "wanted") == [("CONSTRAINED_BY", "X::GET"), ("DECLARES", "Y::GET"), ("GUARDED_BY", "c9"), ("OF_TYPE", "java.lang.String"), ("PAYLOAD", "Long"), ("PAYLOAD", "Page")]
    assert evidence.illegal_edges(edges).count() == 0
    known = {r.id for r in nodes.collect()}
    assert all(r.src in known and r.dst in known for r in edges.collect())
    again = evidence.evidence_layer(*(f[k].union(f[k]) for k in ("endpoints", "security", "members", "mappings", "checks", "outcomes")))
    assert [tuples(a, *a.columns) for a in again] == [tuples(a, *a.columns) for a in (nodes, edges, missing)]
    assert json.loads(nodes.where("label = 'SecurityScheme'").first().props) == {"scheme": "role", "expression": "ADMIN", "roles": "a,b"}


def test_illegal_edges_know_specialisations(spark):
    rows = [("Enum", "OF_TYPE", "Class"), ("Class", "OF_TYPE", "Enum"), ("Class", "DECLARES", "Enum"), ("Other", "OF_TYPE", "Class"), (None, "OF_TYPE", "Class")]
    df = spark.createDataFrame(rows, "src_label string, rel_type string, dst_label string")
    assert tuples(evidence.illegal_edges(df), "src_label", "rel_type") == sorted([("Class", "DECLARES"), ("Other", "OF_TYPE"), (None, "OF_TYPE")], key=repr)
    up = dict.fromkeys("abc")
    assert evidence.ancestors(["a"], {"a": "b", "b": "c", "c": "a"}) == [("a", x) for x in up]
