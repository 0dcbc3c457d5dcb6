"""Techniques against plain Python."""

import random
import re

from pyspark.sql import functions as F

from statewake.operators import techniques

T = "model_id string, id string, guard string, constraints array<string>"


def tuples(df, *cols):
    return sorted((tuple(r) for r in df.select(*(cols or df.columns)).collect()), key=repr)


def fmt(x):
    return str(int(x)) if float(x).is_integer() else str(float(x))


def plain_constraint(text):
    text = (text or "").strip()
    if not text:
        return []
    m = re.match(r"@(\w+)\s*(?:\((.*)\))?\s*$", text, re.DOTALL)
    name, args = (m[1], m[2] or "") if m else ("", "")
    called = f"@{name}" if m else text
    out = [("partition", f"satisfies {called}"), ("partition", f"violates {called}")]
    found = [float(x) for x in re.findall(r"\b(?:min|max|value)\s*=\s*(-?\d+(?:\.\d+)?)", args, re.I)] or [float(x) for x in re.findall(r"^\s*(-?\d+(?:\.\d+)?)\s*$", args)]
    if not m or name in techniques.PRESENCE + techniques.SHAPE or not found:
        return [*out, ("unanalysable", None)]
    subject = techniques.SUBJECTS.get(name, name)
    return out + [("boundary", f"{subject} = {fmt(b + d)}") for b in found for d in (-1, 0, 1)]


def test_constraints_like_plain_python(spark):
    texts = ["@Size(max=64)", "@Size(min=3, max = 40)", "@Length( min=0 )", "@Min(5)", "@Max(value=-7)", "@DecimalMin(\"0.5\")", "@DecimalMax(value=2.5)", "@Digits(integer=3, fraction=2)", "@Digits(8)", "@NotNull", "@NotBlank(message=\"min=3\")",
             "@Pattern(regexp=\"a\")", "@Positive", "@Valid", "@Range(min=1,max=2)", "@Other", "@Size", "not one", " @Email ", "", None, "@Min(0.25)"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", F.explode(techniques.constraint_conditions(F.col("t"))).alias("c"))
    want = sorted(((i, *x) for i, t in enumerate(texts) for x in plain_constraint(t)), key=repr)
    assert sorted(((r.i, r.c.kind, None if r.c.kind == "unanalysable" else r.c.condition) for r in df.collect()), key=repr) == want


def test_boundary_targets(spark):
    rows = [("m", "a", "attempts >= 5", ["@Size(max=2)", "@NotNull", "@Size(max=2)"]), ("m", "b", "", ["@Min(1)"]), ("m", "c", "(x == 0.5) AND NOT (locked) and NOT (locked)", None), ("m", "d", "ok OR late", []), ("m", "e", None, None), ("m", "f", "x < 3 AND y <= 4", [None])]
    got = tuples(techniques.boundary_targets(spark.createDataFrame(rows, T)), "id", "kind", "key", "reason")
    want = [("a", "boundary", f"a::attempts = {n}", None) for n in (4, 5, 6)] + [("a", "partition", "a::partition::attempts < 5", None), ("a", "partition", "a::partition::attempts >= 5", None)]
    want += [("a", "boundary", f"a::constraint::length = {n}", None) for n in (1, 2, 3)] + [("a", "partition", f"a::constraint::{v} @{n}", None) for v in ("satisfies", "violates") for n in ("Size", "NotNull")]
    want += [("b", "boundary", "b::<unguarded>", None), ("e", "boundary", "e::<unguarded>", None)]
    want += [("c", "boundary", f"c::x = {n}", None) for n in ("-0.5", "0.5", "1.5")] + [("c", "partition", f"c::partition::{c}", None) for c in ("x == 0.5", "x != 0.5", "locked", "NOT (locked)")] + [("c", "boundary", "c::NOT (locked)::boundary", "not a numeric threshold")]
    want += [("d", "partition", "d::partition::ok OR late", None), ("d", "partition", "d::partition::NOT (ok OR late)", None), ("d", "boundary", "d::ok OR late::boundary", "not a numeric threshold")]
    want += [("f", "boundary", f"f::{v} = {n}", None) for v, b in (("x", 3), ("y", 4)) for n in (b - 1, b, b + 1)] + [("f", "partition", f"f::partition::{c}", None) for c in ("x < 3", "x >= 3", "y <= 4", "y > 4")]
    assert got == sorted(want, key=repr)
    assert techniques.boundary_targets(spark.createDataFrame([], T)).collect() == []


def all_pairs(factors):
    """Greedy: from the first pair left, by factors and then levels, each factor in order takes the level that covers most."""
    names = list(factors)
    if len(names) < 2:
        return [{n: level} for n in names for level in factors[n]]
    left = [(a, x, b, y) for i, a in enumerate(names) for b in names[i + 1 :] for x in factors[a] for y in factors[b]]
    cases = []
    while left:
        a, x, b, y = left[0]
        case = {a: x, b: y}
        for n in names:
            if n not in case:
                gain = [sum((m, v, n, level) in left or (n, level, m, v) in left for m, v in case.items()) for level in factors[n]]
                case[n] = factors[n][gain.index(max(gain))]
        left = [p for p in left if case[p[0]] != p[1] or case[p[2]] != p[3]]
        cases.append({n: case[n] for n in names})
    return cases


def test_pairwise_like_plain_greedy(spark):
    rng = random.Random(4)
    keyed = {k: {f"n{i}": [f"v{j}" for j in range(rng.randint(1, 4))] for i in range(rng.randint(1, 6))} for k in range(25)} | {99: {f"n{i}": ["x", "y"] for i in range(7)}}
    rows = [(k, i, n, levels) for k, fs in keyed.items() for i, (n, levels) in enumerate(fs.items())]
    got = {}
    for r in techniques.pairwise(spark.createDataFrame(rows, "k int, place int, name string, levels array<string>"), ["k"]).collect():
        got.setdefault((r.k, r.case_no), {})[r.name] = r.level
    want = {(k, i): c for k, fs in keyed.items() for i, c in enumerate(all_pairs(fs))}
    assert got == want and sum(k == 99 for k, _ in want) == 8  # of 128 combinations


def test_factors(spark):
    rows = [(1, 0, "a", False, ["@NotNull"]), (1, 1, "b", True, ["", "@Size(max=3)", "@NotNull"]), (1, 2, "c", None, None), (1, 3, "", True, None), (1, 4, None, True, None), (2, 0, "one", None, ["@Min(1)"])]
    f = techniques.factors(spark.createDataFrame(rows, "k int, place int, name string, required boolean, constraints array<string>"), ["k"])
    assert tuples(f) == [(1, 0, "a", ["supplied", "omitted"]), (1, 1, "b", ["satisfies @Size(max=3)", "violates @Size(max=3)"]), (1, 2, "c", ["supplied", "omitted"]), (2, 0, "one", ["satisfies @Min(1)", "violates @Min(1)"])]
    assert tuples(techniques.pairwise(f.where("k = 2"), ["k"])) == [(2, 0, "one", "satisfies @Min(1)"), (2, 1, "one", "violates @Min(1)")]
    assert techniques.pairwise(f.limit(0), ["k"]).collect() == []
