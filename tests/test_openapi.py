"""Members of OpenAPI schemas against plain recursion."""

import json
import random

from statewake.sources import openapi


def plain_parts(value):
    if not isinstance(value, dict) or "$ref" in value:
        return []
    out = [value]
    for x in value.get("allOf", []) if isinstance(value.get("allOf"), list) else []:
        out += plain_parts(x)
    return out


def plain_parents(value):
    out = []
    for part in plain_parts(value):
        out += [x["$ref"].rsplit("/", 1)[1] for x in part.get("allOf", []) if "$ref" in x]
    return out


def plain_members(schemas, name):
    hops, front, k = {name: 0}, [name], 0
    while front:
        k += 1
        more = {p for s in front if s in schemas for p in (plain_parents(schemas[s]) if "$ref" not in schemas[s] else [schemas[s]["$ref"].rsplit("/", 1)[1]])} - set(hops)
        hops |= dict.fromkeys(more, k)
        front = sorted(more)
    out, required = {}, set()
    for s, _ in sorted(hops.items(), key=lambda x: (x[1], x[0])):
        for part in plain_parts(schemas[s]) if s in schemas else []:
            required |= set(part.get("required", []))
            for p, v in part.get("properties", {}).items():
                out.setdefault(p, (s, v))
    return out, required, sorted(s for s in hops if s not in schemas)


def ref_of(v):
    r = v.get("$ref") or v.get("items", {}).get("$ref")
    return r.rsplit("/", 1)[1] if r else None


def plain_expand(schemas, root):
    out = []

    def go(schema, path, seen):
        props, required, lost = plain_members(schemas, schema)
        for name, (_, v) in props.items():
            here = (f"{path}." if path else "") + name + ("[]" if v.get("type") == "array" else "")
            ref, reason = ref_of(v), None
            if ref:
                reason = "cycle" if ref in seen else "dangling" if ref not in solid else None
            out.append((here, v.get("type"), name in required, reason))
            if ref and not reason:
                go(ref, here, [*seen, ref])
        for s in lost:
            out.append(((f"{path}." if path else "") + "<allOf>", None, False, "cycle" if s in seen else "dangling"))

    # a schema without any member is as good as none to follow
    solid = {s for s in schemas if any(plain_members(schemas, s)[i] for i in (0, 2))}
    go(root, "", [root])
    return sorted(out, key=repr)


def made(rng):
    names = [f"S{i}" for i in range(rng.randint(1, 6))]
    ref = lambda: {"$ref": "#/components/schemas/" + rng.choice([*names, "Gone"] if rng.random() < 0.2 else names)}

    def prop():
        return rng.choice([{"type": "string", "maxLength": 3}, {"type": "integer", "minimum": 0.5}, ref(), {"type": "array", "items": ref()}, {"type": "array", "items": {"type": "string"}}])

    def schema(depth=2):
        s = {"type": "object", "properties": {f"p{i}": prop() for i in rng.sample(range(5), rng.randint(0, 2))}, "required": rng.sample(["p0", "p1", "p2"], rng.randint(0, 2))}
        if depth and rng.random() < 0.4:
            s["allOf"] = [rng.choice([ref(), schema(depth - 1)]) for _ in range(rng.randint(1, 2))]
        return s

    return {n: schema() for n in names}


def test_like_plain_recursion(spark, tmp_path):
    rng = random.Random(8)
    docs = {f"d{i}.json": made(rng) for i in range(25)}
    for name, schemas in docs.items():
        (tmp_path / name).write_text(json.dumps({"openapi": "3.0.0", "components": {"schemas": schemas}}))
    (tmp_path / "broken.json").write_text("{not json")
    (tmp_path / "bare.json").write_text("{}")
    found = openapi.members(openapi.documents(spark, str(tmp_path))).cache()
    got = {(r.doc, r.schema, r.name): (r.said_by, r.type, r.ref, r.required) for r in found.where("name is not null").collect()}
    want = {}
    for d, schemas in docs.items():
        for s in schemas:
            props, required, _ = plain_members(schemas, s)
            want |= {(d, s, p): (by, v.get("type"), ref_of(v), p in required) for p, (by, v) in props.items()}
    assert got == want and any(k[1] != v[0] for k, v in got.items())
    assert {tuple(r.constraints) for r in found.collect()} == {(), ("maxLength=3",), ("minimum=0.5",)}
    roots = found.select("doc", "schema").distinct()
    rows = {}
    for r in openapi.expanded(found, roots).collect():
        rows.setdefault((r.doc, r.root), []).append((r.path, r.type, r.required, r.reason))
    for (d, s), have in rows.items():
        assert sorted(have, key=repr) == plain_expand(docs[d], s), (d, s)
    assert {x[3] for v in rows.values() for x in v} == {None, "cycle", "dangling"}
