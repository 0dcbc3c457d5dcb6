"""Override logs and versioned claims against plain replays."""

import random

import pytest

from statewake.operators import overrides
from statewake.sources.claims_table import ClaimsTable

ELEMENTS = "model_id string, kind string, id string, lifecycle string, props map<string,string>"
LOG = "model_id string, kind string, id string, seq long, operation string, prop string, previous_value string, new_value string, payload map<string,string>, author string"


def plain_replay(elements, log):
    held = {(m, k, i): (life, dict(p), None) for m, k, i, life, p in elements}
    source = {k: dict(v[1]) for k, v in held.items()}
    out, groups = [], set()
    group = lambda key, p: groups.add((key[0], p.get("source"), p.get("trigger"))) if key[1] == "transition" else None
    for m, k, i, seq, op, prop, previous, new, payload, author in sorted(log, key=lambda r: r[3]):
        key, there = (m, k, i), (m, k, i) in held
        stale = op == "modify" and source.get(key, {}).get(prop) != previous
        if op == "add" and not there:
            held[key] = ("Quarantine", dict(payload or {}), author)
            group(key, held[key][1])
        elif op == "remove" and there:
            group(key, held[key][1])
            del held[key]
        elif op == "modify" and there:
            group(key, held[key][1])
            held[key] = ("Quarantine", held[key][1] | {prop: new}, author)
            group(key, held[key][1])
        else:
            out.append((*key, seq, "no-op", stale))
            continue
        out.append((*key, seq, "applied", stale))
    return {k: (v[0], v[1], v[2]) for k, v in held.items()}, sorted(out), groups


def test_replay_like_plain_python(spark):
    rng = random.Random(2)
    props = ["source", "trigger", "target", "guard"]
    value = lambda: rng.choice([None, "a", "b", "c"])
    bag = lambda: {p: value() for p in rng.sample(props, rng.randint(0, 4))}
    keys = [(f"m{rng.randint(0, 3)}", rng.choice(["state", "transition"]), f"e{i}") for i in range(40)]
    elements = [(*k, "Approved", bag()) for k in keys if rng.random() < 0.6]
    log = [(*rng.choice(keys), seq, rng.choice(["add", "remove", "modify", "modify", "other"]), rng.choice(props), value(), value(), rng.choice([bag(), None]), rng.choice(["ann", "bob", None])) for seq in range(400)]
    want, entries, groups = plain_replay(elements, log)
    e, lo = spark.createDataFrame(elements, ELEMENTS), spark.createDataFrame(log, LOG).repartition(5)
    got = {(r.model_id, r.kind, r.id): (r.lifecycle, r.props, r.author) for r in overrides.replay(e, lo).collect()}
    assert {k: v[:2] for k, v in got.items()} == {k: v[:2] for k, v in want.items()}
    assert sorted((r.model_id, r.kind, r.id, r.seq, r.outcome, r.stale) for r in overrides.entries(e, lo).collect()) == entries
    assert {tuple(r) for r in overrides.touched_groups(e, lo).collect()} == groups
    assert {x[4] for x in entries} == {"applied", "no-op"} and {x[5] for x in entries} == {True, False}


def test_replay_of_nothing(spark):
    e, none = spark.createDataFrame([("m", "state", "s", "Approved", {"name": "x"}), ("m", "state", "t", "Approved", {})], ELEMENTS), spark.createDataFrame([], LOG)
    assert sorted((r.id, r.lifecycle, r.props, r.author) for r in overrides.replay(e, none).collect()) == [("s", "Approved", {"name": "x"}, None), ("t", "Approved", {}, None)]
    assert overrides.replay(spark.createDataFrame([], ELEMENTS), none).collect() == []
    edit = spark.createDataFrame([("m", "state", "s", 1, "modify", "name", "x", None, None, "ann"), ("m", "state", "q", 2, "modify", "name", None, "y", None, "ann")], LOG)
    assert [(r.id, r.props, r.author) for r in overrides.replay(e, edit).collect() if r.id != "t"] == [("s", {"name": None}, "ann")]
    assert [(r.id, r.outcome, r.stale) for r in overrides.entries(e, edit).orderBy("seq").collect()] == [("s", "applied", False), ("q", "no-op", False)]


# claims
def rows(table, *cols):
    return sorted((tuple(r) for r in table.read().select(*cols).collect()), key=repr)


def incoming(spark, claims, at):
    return spark.createDataFrame([(k, t, at) for k, t in claims], "key string, text string, valid_from string")


def test_claims_are_superseded_and_reopened(spark, tmp_path):
    t = ClaimsTable(spark, str(tmp_path / "claims"), buckets=4)
    assert t.version() == 0 and t.read().count() == 0 and t.land(incoming(spark, [], "2020")) == 0
    assert t.land(incoming(spark, [("a", "one"), ("b", "x"), ("c", None)], "2020")) == 1
    assert t.land(incoming(spark, [("a", "one"), ("c", None)], "2021")) == 1  # nothing new: no version
    assert t.land(incoming(spark, [("a", "two"), ("d", "y")], "2022")) == 2
    assert rows(t, "key", "text", "revision", "valid_from", "valid_to") == sorted([("a", "one", 1, "2020", "2022"), ("a", "two", 2, "2022", None), ("b", "x", 1, "2020", None), ("c", None, 1, "2020", None), ("d", "y", 1, "2022", None)], key=repr)
    t.land(incoming(spark, [("a", "one")], "2023"))
    assert [r for r in rows(t, "key", "text", "revision", "valid_from", "valid_to") if r[0] == "a"] == [("a", "one", 3, "2020", None), ("a", "two", 2, "2022", "2023")]
    assert sorted(r.text for r in t.as_of("2021").collect() if r.text) == ["one", "x"] and t.read(1).count() == 3 and t.tables.versions() == [1, 2, 3]
    # half-open: at the instant of change the new claim holds alone
    assert sorted(r.text for r in t.as_of("2022").where("key = 'a'").collect()) == ["one", "two"] and t.read(2).where("key = 'a' and valid_from <= '2022' and (valid_to is null or valid_to > '2022')").count() == 1


def test_close_and_backfill_are_idempotent(spark, tmp_path):
    t = ClaimsTable(spark, str(tmp_path / "claims"))
    legacy = spark.createDataFrame([("k", "k", "old", 1, None, None, "Approved"), ("m", "m@1", "x", 1, "2019", None, "Approved")], "key string, id string, text string, revision long, valid_from string, valid_to string, lifecycle string")
    t.load(legacy)
    assert t.backfill("2018") == {"written": 1, "still_missing": 0} and t.backfill("2000") == {"written": 0, "still_missing": 0} and t.version() == 2
    ids = spark.createDataFrame([("k",), ("k",), ("nope",), (None,)], "id string")
    assert t.close(ids, "2021") == {"closed": 1, "already_closed": 0, "missing": 1}
    before = rows(t, "id", "valid_from", "valid_to", "lifecycle")
    assert before == [("k", "2018", "2021", "Approved"), ("m@1", "2019", None, "Approved")]
    assert t.close(ids, "2024") == {"closed": 0, "already_closed": 1, "missing": 1} and rows(t, "id", "valid_from", "valid_to", "lifecycle") == before and t.version() == 3
    for call in (lambda: t.close(ids, " "), lambda: t.backfill(""), lambda: t.land(incoming(spark, [("a", "1"), ("a", "2")], "2020")), lambda: t.land(incoming(spark, [(None, "1")], "2020"))):
        with pytest.raises(ValueError):
            call()


def test_a_broken_write_leaves_the_old_version(spark, tmp_path, monkeypatch):
    t = ClaimsTable(spark, str(tmp_path / "claims"), buckets=2)
    t.land(incoming(spark, [("a", "one"), ("b", "x")], "2020"))
    before = rows(t, "key", "text", "valid_to")
    # broken off before the manifest
    with monkeypatch.context() as m:
        m.setattr(t.tables, "_publish", lambda *a: (_ for _ in ()).throw(RuntimeError("gone")))
        with pytest.raises(RuntimeError):
            t.land(incoming(spark, [("a", "two")], "2021"))
    assert rows(t, "key", "text", "valid_to") == before and t.version() == 1
    # a second writer of one version fails
    with pytest.raises(Exception, match="exist"):
        t.tables._publish(1, "{}")
    assert t.version() == 1
    # a manifest that is not whole
    (tmp_path / "claims/manifests/2").write_text('{"version": 2, "buck')
    fresh = ClaimsTable(spark, str(tmp_path / "claims"))
    assert rows(fresh, "key", "text", "valid_to") == before and fresh.version() == 1 and fresh.tables.buckets == 2
    # two open rows of a key are refused before the switch
    two = spark.createDataFrame([("z", "z@1", "p", 1, "2020", None, "A"), ("z", "z@2", "q", 2, "2020", None, "A")], "key string, id string, text string, revision long, valid_from string, valid_to string, lifecycle string")
    with pytest.raises(ValueError, match="two open claims"):
        fresh.load(two)
    assert rows(fresh, "key", "text", "valid_to") == before
    assert fresh.land(incoming(spark, [("a", "two")], "2021")) == 3 and fresh.read().count() == 3


# human facts
def test_human_facts_survive(spark):
    from statewake.operators import carry, delta

    t = "model_id string, key string, id string, source string, trigger string, lifecycle string, guard string, name string"
    old = [("m", "same", "1", "S", "a", "Approved", "g", "n"), ("m", "named", "2", "S", "b", "Approved", "g", "old"), ("m", "guarded", "3", "S", "c", "Approved", "g", "n"), ("m", "sibling", "4", "S", "c", "Approved", "g", "n"), ("m", "gone", "5", "S", "d", "Approved", "g", "n"), ("m", "beside", "6", "S", "d", "Approved", "g", "n"), ("m", "bad", "7", "S", "e", "Rejected", "g", "n"), ("m", "null", "8", "S", "f", "Approved", None, "n"), ("m", "null", "9", "S", "f", "Rejected", "z", "n"), ("o", "same", "1", "S", "c", "Approved", "g", "n")]
    new = [("m", "same", "a", "S", "a", "Quarantine", "g", "n"), ("m", "named", "b", "S", "b", "Quarantine", "g", "new"), ("m", "guarded", "c", "S", "c", "Quarantine", "h", "n"), ("m", "sibling", "d", "S", "c", "Quarantine", "g", "n"), ("m", "beside", "e", "S", "d", "Quarantine", "g", "n"), ("m", "bad", "f", "S", "e", "Quarantine", "h", "n"), ("m", "null", "g", "S", "f", "Quarantine", None, "n"), ("m", "fresh", "h", "S", "z", "Quarantine", "g", "n"), ("o", "same", "a", "S", "c", "Quarantine", "g", "n")]
    p, c = spark.createDataFrame(old, t), spark.createDataFrame(new, t)
    got = {(r.model_id, r.key): (r.lifecycle, r.carried, r.revoked) for r in carry.transitions(p, c, ["guard", "name"]).collect()}
    assert got == {
        ("m", "same"): ("Approved", True, None), ("m", "named"): ("Quarantine", True, "group was disturbed"), ("m", "guarded"): ("Quarantine", True, "behaviour changed"), ("m", "sibling"): ("Quarantine", True, "group was disturbed"),
        ("m", "beside"): ("Quarantine", True, "group was disturbed"), ("m", "bad"): ("Rejected", True, None), ("m", "null"): ("Approved", True, None), ("m", "fresh"): ("Quarantine", False, None), ("o", "same"): ("Approved", True, None),
    }
    d = {r.key: (r.change, r.invalidates) for r in delta.keyed_diff(p.where("model_id = 'm' and id < '8'"), c.where("model_id = 'm' and key <> 'null'"), ["model_id", "key"], ["guard", "name"], ["name"]).collect()}
    assert d["named"] == ("MODIFIED", False) and d["guarded"] == ("MODIFIED", True) and d["gone"] == ("REMOVED", False) and d["fresh"] == ("ADDED", False)
    s = "model_id string, key string, id string, name string, lifecycle string, name_tier string, surface string"
    ps, cs = spark.createDataFrame([("m", "k", "1", "Paid", "Approved", "human", "api"), ("m", "l", "1", "L", "Approved", "", "api")], s), spark.createDataFrame([("m", "k", "x", "PAID200", "Quarantine", "code", "ui"), ("m", "l", "y", "l2", "Quarantine", "code", "ui"), ("m", "n", "z", "N", "Quarantine", "code", "ui")], s)
    assert sorted((r.key, r.name, r.lifecycle, r.name_tier, r.surface, r.carried) for r in carry.states(ps, cs).collect()) == [("k", "Paid", "Approved", "human", "ui", True), ("l", "L", "Approved", "code", "ui", True), ("n", "N", "Quarantine", "code", "ui", False)]
    assert carry.transitions(p.limit(0), c.limit(0), ["guard"]).collect() == []
