"""Test techniques: partitions and boundaries of guards and declared constraints, factor levels of inputs, and all-pairs cover.

What comes out are conditions on data, never values. A part that has no boundary stays as a row with
the reason. Repeated conditions of a transition count once; null guards and constraints say nothing;
empty tables give empty results. A guard's parts and an input's constraints are arrays that code bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statewake.operators import guards

MODEL = "model_id"

# What annotations constrain, and those that have no order and so no boundary
SUBJECTS = {"Size": "length", "Length": "length", "Min": "value", "Max": "value", "DecimalMin": "value", "DecimalMax": "value", "Digits": "digits"}
PRESENCE = ("NotNull", "NotBlank", "NotEmpty", "Null")
SHAPE = ("Pattern", "Email", "URL", "Past", "Future", "PastOrPresent", "FutureOrPresent", "Positive", "Negative", "PositiveOrZero", "NegativeOrZero", "AssertTrue", "AssertFalse", "Valid")
ANNOTATION, NUMBER = r"(?s)^@(\w+)\s*(?:\((.*)\))?\s*$", r"-?\d+(?:\.\d+)?"
POINTS = (("below", -1), ("at", 0), ("above", 1))


def number(value: Column) -> Column:
    """A number as it is written in a condition: without a fraction of zero."""
    return F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(value.cast("string"))


def _said(kind: str, position: Column, condition: Column, of: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), position.cast("string").alias("position"), condition.alias("condition"), of.alias("of"))


def _points(subject: Column, bound: Column, of: Column) -> list[Column]:
    return [_said("boundary", F.lit(name), F.concat(subject, F.lit(" = "), number(bound + off)), of) for name, off in POINTS]


def _none(kind: str, condition: Column, of: Column) -> Column:
    return _said(kind, F.lit(None), condition, of)


def guard_conditions(guard: Column) -> Column:
    """Every partition, boundary point and part without a boundary of a guard: array of struct(kind, position, condition, of)."""
    parts = F.filter(F.transform(F.split(F.trim(F.coalesce(guard, F.lit(""))), r"(?i)\s+AND\s+"), guards.strip_parens), lambda p: p != "")

    def of(part):
        t, bare = guards.threshold(part), guards.literal(part).atom
        n = F.concat(t["name"], F.lit(" {} "), number(t.bound))
        side = lambda op: F.replace(n, F.lit("{}"), op if isinstance(op, Column) else F.lit(op))
        low = F.when(t.op.isin(">", ">="), side("<")).otherwise(side(t.op))
        high = F.when(t.op.isin(">", ">="), side(t.op)).when(t.op == "<", side(">=")).when(t.op == "<=", side(">")).otherwise(side("!="))
        known = F.array(_none("partition", low, part), _none("partition", high, part), *_points(t["name"], t.bound, part))
        plain = F.array(_none("partition", bare, part), _none("partition", F.concat(F.lit("NOT ("), bare, F.lit(")")), part), _none("unanalysable", F.lit("not a numeric threshold"), part))
        return F.when(t.isNotNull(), known).otherwise(plain)

    return F.flatten(F.transform(parts, of))


def constraint_conditions(constraint: Column) -> Column:
    """The same for one declared constraint: satisfied or violated, and three points for each bound that it states."""
    text = F.trim(F.coalesce(constraint, F.lit("")))
    name, args = F.regexp_extract(text, ANNOTATION, 1), F.regexp_extract(text, ANNOTATION, 2)
    called = F.when(name != "", F.concat(F.lit("@"), name)).otherwise(text)
    subject = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in SUBJECTS.items() for x in pair)), name), name)
    both = F.array(_none("partition", F.concat(F.lit("satisfies "), called), text), _none("partition", F.concat(F.lit("violates "), called), text))
    named = F.regexp_extract_all(args, F.lit(rf"(?i)\b(?:min|max|value)\s*=\s*({NUMBER})"), F.lit(1))
    bare = F.regexp_extract(args, rf"^\s*({NUMBER})\s*$", 1)
    bounds = F.transform(F.when(F.size(named) > 0, named).when(bare != "", F.array(bare)).otherwise(F.array().cast("array<string>")), lambda b: b.cast("double"))
    why = F.when(name == "", "not an annotation").when(name.isin(*PRESENCE), "presence has no order").when(name.isin(*SHAPE), "a shape has no order").when(F.size(bounds) == 0, "no bound")
    points = F.flatten(F.transform(bounds, lambda b: F.array(*_points(subject, b, text))))
    return F.when(text == "", F.array().cast("array<struct<kind:string,position:string,condition:string,of:string>>")).when(why.isNotNull(), F.concat(both, F.array(_none("unanalysable", why, text)))).otherwise(F.concat(both, points))


def boundary_targets(t: DataFrame) -> DataFrame:
    """Targets of boundary coverage: model_id, id, kind, key and reason (a part without a boundary; else null).

    t(model_id, id, guard, constraints array), generatable ones. A guard's values come before its partitions
    and the declared constraints'. A transition without a guard has one target, and no constraint of it is read.
    """
    own = F.transform(guard_conditions(F.col("guard")), lambda c: F.struct(c.kind.alias("kind"), F.lit("").alias("part"), c.condition.alias("condition"), c.of.alias("of")))
    listed = F.coalesce("constraints", F.array().cast("array<string>"))
    declared = F.filter(F.flatten(F.transform(listed, constraint_conditions)), lambda c: c.kind != "unanalysable")
    more = F.transform(declared, lambda c: F.struct(c.kind.alias("kind"), F.lit("constraint::").alias("part"), c.condition.alias("condition"), c.of.alias("of")))
    bare = F.trim(F.coalesce("guard", F.lit(""))) == ""
    alone = F.array(F.struct(F.lit("unguarded").alias("kind"), F.lit("").alias("part"), F.lit("<unguarded>").alias("condition"), F.lit("").alias("of")))
    rows = t.select(MODEL, "id", F.explode(F.array_distinct(F.when(bare, alone).otherwise(F.concat(own, more)))).alias("c"))
    lost = F.col("c.kind") == "unanalysable"
    key = F.when(lost, F.concat_ws("::", "id", "c.of", F.lit("boundary"))).when((F.col("c.kind") == "partition") & (F.col("c.part") == ""), F.concat(F.col("id"), F.lit("::partition::"), F.col("c.condition"))).otherwise(F.concat(F.col("id"), F.lit("::"), F.col("c.part"), F.col("c.condition")))
    return rows.select(MODEL, "id", F.when(lost | (F.col("c.kind") == "unguarded"), "boundary").otherwise(F.col("c.kind")).alias("kind"), key.alias("key"), F.when(lost, F.col("c.condition")).alias("reason")).distinct()


def factors(inputs: DataFrame, keys: list[str]) -> DataFrame:
    """What can vary about each input: keys, place, name, levels (array of two). inputs(keys, place, name, required, constraints array); nameless inputs are none, and an input that says nothing is required."""
    first = F.get(F.filter(F.coalesce("constraints", F.array().cast("array<string>")), lambda c: F.trim(c) != ""), F.lit(0))
    stated = F.coalesce("required", F.lit(True)) & first.isNotNull()
    levels = F.when(stated, F.array(F.concat(F.lit("satisfies "), first), F.concat(F.lit("violates "), first))).otherwise(F.array(F.lit("supplied"), F.lit("omitted")))
    return inputs.where("name <> ''").select(*keys, "place", "name", levels.alias("levels"))


#: One greedy case: from the first pair that is left, each further factor in order takes the level that covers most of what is left, the earlier one on a tie.
_START = "transform(_sizes, (n, i) -> if(i = s.left[0].a div 64, s.left[0].a, if(i = s.left[0].b div 64, s.left[0].b, -1)))"
_GAIN = "size(filter(s.left, p -> (p.a = i * 64 + j and array_contains(c, p.b)) or (p.b = i * 64 + j and array_contains(c, p.a))))"
_BEST = f"i * 64 - array_max(transform(sequence(0, _sizes[i] - 1), j -> struct({_GAIN} as gain, -j as late))).late"
_CASE = f"aggregate(sequence(0, size(_sizes) - 1), {_START}, (c, i) -> if(c[i] >= 0, c, transform(c, (x, k) -> if(k = i, cast({_BEST} as int), x))))"
_STEP = f"if(size(s.left) = 0, s, transform(array({_CASE}), c -> struct(filter(s.left, p -> not (array_contains(c, p.a) and array_contains(c, p.b))) as left, array_append(s.cases, c) as cases))[0])"
_PAIRS = "flatten(flatten(transform(_sizes, (n, i) -> transform(slice(_sizes, i + 2, size(_sizes)), (m, d) -> flatten(transform(sequence(0, n - 1), x -> transform(sequence(0, m - 1), y -> struct(i * 64 + x as a, (i + 1 + d) * 64 + y as b))))))))"


def pairwise(rows: DataFrame, keys: list[str]) -> DataFrame:
    """All-pairs cases of each key's factors(keys, place, name, levels): keys, case_no, name, level.

    Which levels go together depends on the numbers of levels alone, so the cover is made once for each
    distinct list of them. One factor gives a case a level. At most 64 levels a factor.
    """
    per = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("place", "name", "levels"))).alias("_f"))
    per = per.withColumn("_sizes", F.transform("_f", lambda f: F.size(f.levels)))
    shapes = per.select("_sizes").distinct().withColumn("_pairs", F.expr(_PAIRS))
    none = "cast(array() as array<array<int>>)"
    greedy = F.expr(f"aggregate(sequence(1, greatest(size(_pairs), 1)), struct(_pairs as left, {none} as cases), (s, r) -> {_STEP}).cases")
    alone = F.expr("transform(sequence(0, _sizes[0] - 1), j -> array(j))")
    shapes = shapes.select("_sizes", F.when(F.size("_sizes") == 1, alone).otherwise(greedy).alias("_cases"))
    cases = per.join(shapes, "_sizes").select(*keys, "_f", F.posexplode("_cases").alias("case_no", "_case"))
    return cases.select(*keys, "case_no", F.explode(F.transform("_case", lambda c, i: F.struct(F.get("_f", i)["name"].alias("name"), F.get(F.get("_f", i).levels, c % 64).alias("level")))).alias("v")).select(*keys, "case_no", "v.*")
