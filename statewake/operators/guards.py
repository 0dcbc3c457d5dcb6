"""Guards: conjuncts, thresholds, intervals, truth tables, boundary points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def conjuncts(guard: Column) -> Column:
    """The parts of a guard between AND or &&; null where it has an OR, empty where it has nothing."""
    g = F.trim(F.coalesce(guard, F.lit("")))
    parts = F.transform(F.split(g, r"(?i)\s+AND\s+|\s*&&\s*"), lambda x: F.trim(x))
    return F.when(g.rlike(r"(?i)\bOR\b"), F.lit(None)).when(g == "", F.array().cast("array<string>")).otherwise(parts)


def let(value: Column, use) -> Column:
    """use(value) with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip_parens(text: Column) -> Column:
    """The text without the parentheses that surround the whole of it, however many."""
    depth = lambda t, i: F.length(F.replace(F.substring(t, F.lit(1), i), F.lit(")"), F.lit(""))) - F.length(F.replace(F.substring(t, F.lit(1), i), F.lit("("), F.lit("")))

    def inside(t):
        closes_last = F.forall(F.sequence(F.lit(1), F.greatest(F.length(t) - 1, F.lit(1))), lambda i: depth(t, i) > 0)
        return F.when(t.startswith("(") & t.endswith(")") & (F.length(t) > 1) & closes_last, F.trim(t.substr(F.lit(2), F.length(t) - 2))).otherwise(t)

    # as many rounds as there are parentheses in front, and one for a text without any
    pairs = lambda t: F.sequence(F.lit(1), F.greatest(F.length(F.regexp_extract(t, r"^[(\s]*", 0)), F.lit(1)))
    return let(F.trim(text), lambda t: F.when(t.startswith("("), F.aggregate(pairs(t), t, lambda a, _: inside(a))).otherwise(t))


def top_conjuncts(guard: Column) -> Column:
    """The parts between ANDs that stand outside parentheses, in order; null where the guard has an OR or nothing."""
    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(None).cast("string").alias("now"), F.lit(0).alias("depth"))
    level = lambda t: F.length(F.replace(t, F.lit(")"), F.lit(""))) - F.length(F.replace(t, F.lit("("), F.lit("")))

    def step(a, t):
        ends = (a.depth == 0) & a.now.isNotNull()
        parts = F.when(ends, F.array_append(a.parts, F.trim(a.now))).otherwise(a.parts)
        now = F.when(a.now.isNull() | ends, t).otherwise(F.concat(a.now, F.lit("AND"), t))
        return F.struct(parts.alias("parts"), now.alias("now"), (a.depth + level(t)).alias("depth"))

    split = lambda g: F.filter(F.aggregate(F.split(g, r"(?i)\bAND\b"), start, step, lambda a: F.array_append(a.parts, F.trim(a.now))), lambda x: x != "")
    return let(strip_parens(F.coalesce(guard, F.lit(""))), lambda g: F.when(~g.rlike(r"(?i)\bOR\b") & (g != ""), split(g)))


def literals(guard: Column) -> Column:
    """The distinct struct(atom, negated) of a guard in order; null where it has an OR or nothing, which decides nothing."""
    named = lambda y: F.struct(strip_parens(y.atom).alias("atom"), y.negated.alias("negated"))
    return F.array_sort(F.array_distinct(F.transform(top_conjuncts(guard), lambda x: let(let(strip_parens(x), literal), named))))


def relation(a: Column, b: Column) -> Column:
    """identical, complementary (one literal apart, which is negated), exclusive (some literal is negated) or null, of two guards' literals."""
    opposed = F.array_intersect(a, F.transform(b, lambda x: F.struct(x.atom.alias("atom"), (~x.negated).alias("negated"))))
    only_a, only_b = F.array_except(a, b), F.array_except(b, a)
    return (
        F.when(a.isNull() | b.isNull(), F.lit(None).cast("string"))
        .when((F.size(only_a) == 0) & (F.size(only_b) == 0), "identical")
        .when((F.size(only_a) == 1) & (F.size(only_b) == 1) & (F.size(opposed) == 1), "complementary")
        .when(F.size(opposed) > 0, "exclusive")
    )


def conflict(a: Column, b: Column, la: Column, lb: Column) -> Column:
    """struct(conflict, certain, reason) of two guards that are not empty, and their literals. What is not shown to be exclusive counts as a conflict that is not certain."""
    made = lambda c, s, r: F.struct(F.lit(c).alias("conflict"), F.lit(s).alias("certain"), F.lit(r).alias("reason"))

    def decide(x):
        over = overlaps(interval(x.ta.op, x.ta.bound), interval(x.tb.op, x.tb.bound))
        return (
            F.when(x.rel == "identical", made(True, True, "same condition"))
            .when(x.rel.isNotNull(), made(False, True, "opposed literals"))
            .when(x.ta.isNull() | x.tb.isNull(), made(True, False, "not a simple threshold"))
            .when(x.ta["name"] != x.tb["name"], made(True, False, "different variables"))
            .when(over, made(True, True, "overlapping ranges"))
            .otherwise(made(False, True, "separate ranges"))
        )

    return let(F.struct(relation(la, lb).alias("rel"), threshold(a).alias("ta"), threshold(b).alias("tb")), decide)


def literal(part: Column) -> Column:
    """struct(atom, negated) of a conjunct: NOT x and NOT (x) are negated."""
    negated = part.rlike(r"(?i)^NOT\b")
    bare = F.trim(F.regexp_replace(part, r"(?i)^NOT\b\s*", ""))
    atom = F.when(negated & bare.rlike(r"^\(.*\)$"), F.trim(bare.substr(F.lit(2), F.length(bare) - 2))).otherwise(bare)
    return F.struct(F.when(negated, atom).otherwise(part).alias("atom"), negated.alias("negated"))


def threshold(part: Column) -> Column:
    """struct(name, op, bound) of ``name op number``; null for other atoms."""
    pattern = r"^\s*([A-Za-z_][\w.]*)\s*(<=|>=|==|<|>)\s*(-?\d+(?:\.\d+)?)\s*$"
    return F.when(part.rlike(pattern), F.struct(F.regexp_extract(part, pattern, 1).alias("name"), F.regexp_extract(part, pattern, 2).alias("op"), F.regexp_extract(part, pattern, 3).cast("double").alias("bound")))


def interval(op: Column, bound: Column) -> Column:
    """struct(lo, lo_in, hi, hi_in) of a threshold; open ends are infinite."""
    far = F.lit(float("inf"))
    lo = F.when(op.isin(">", ">=", "=="), bound).otherwise(-far)
    hi = F.when(op.isin("<", "<=", "=="), bound).otherwise(far)
    return F.struct(lo.alias("lo"), op.isin(">=", "==").alias("lo_in"), hi.alias("hi"), op.isin("<=", "==").alias("hi_in"))


def overlaps(a: Column, b: Column) -> Column:
    """Whether two intervals have a point in common."""
    lo, hi = F.greatest(a.lo, b.lo), F.least(a.hi, b.hi)
    ends_in = F.when(a.lo == lo, a.lo_in).otherwise(True) & F.when(b.lo == lo, b.lo_in).otherwise(True) & F.when(a.hi == hi, a.hi_in).otherwise(True) & F.when(b.hi == hi, b.hi_in).otherwise(True)
    return (lo < hi) | ((lo == hi) & ends_in)


def interval_gaps(ranges: DataFrame, keys: list[str], lo="lo", hi="hi") -> DataFrame:
    """Gaps between closed integer ranges of each key: one sweep by lower end, against the furthest upper end so far."""
    before = Window.partitionBy(*keys).orderBy(lo, hi).rowsBetween(Window.unboundedPreceding, -1)
    swept = ranges.withColumn("_far", F.max(hi).over(before))
    return swept.where(F.col(lo) > F.col("_far") + 1).select(*keys, (F.col("_far") + 1).alias("gap_lo"), (F.col(lo) - 1).alias("gap_hi"))


def boundary_points(df: DataFrame, bound: str) -> DataFrame:
    """Three rows for each bound: just below, at, and just above."""
    return df.withColumn("point", F.explode(F.array(*(F.struct(F.lit(n).alias("kind"), (F.col(bound) + d).alias("value")) for n, d in (("below", -1), ("at", 0), ("above", 1)))))).select("*", "point.kind", "point.value").drop("point")


def undecided(clauses: Column, any_open: Column, most_atoms: int) -> Column:
    """Why a group's guards cannot be tabulated; null where they can. clauses: arrays of literals; any_open: some guard has an OR or nothing."""
    atoms = F.flatten(F.transform(clauses, lambda c: F.transform(c, lambda x: x.atom)))
    return (
        F.when(any_open, "a disjunction or no guard")
        .when(F.exists(atoms, lambda x: threshold(x).isNotNull()), "a threshold, which is an interval")
        .when(F.size(F.array_distinct(atoms)) > most_atoms, f"more than {most_atoms} atoms")
    )


def atom_names(clauses: Column) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.transform(clauses, lambda c: F.transform(c, lambda x: x.atom)))))


def mask(clause: str, atoms: str, positive: bool) -> str:
    chosen = f"filter({clause}, x -> not x.negated)" if positive else clause
    return f"aggregate(transform({chosen}, x -> shiftleft(1, cast(array_position({atoms}, x.atom) as int) - 1)), 0, (p, q) -> p | q)"


def truth_table(rows: DataFrame, keys: list[str], guard: str, most_atoms: int = 10) -> DataFrame:
    """For each key how many assignments of its atoms no guard holds for, and the first of them; or the reason why that is undecided.

    Bit i of a row number is the i-th atom in order. A guard with an OR, none, a threshold or too many
    atoms leave the group undecided: its counts are null, never zero. Groups with the same guards share one
    table: each distinct guard is parsed once, and each distinct set of guards tabulated once.
    """
    # no guard and an empty one are the same
    sets = rows.select(*keys, F.coalesce(guard, F.lit("")).alias("_g")).groupBy(*keys).agg(F.array_sort(F.collect_set("_g")).alias("_set"))
    sets = sets.withColumn("_id", F.sha2(F.to_json("_set"), 256))
    met = sets.groupBy("_id").agg(F.first("_set").alias("_set")).select("_id", F.explode("_set").alias("_g"))
    lits = met.join(met.select("_g").distinct().withColumn("_l", literals(F.col("_g"))), "_g")
    g = lits.groupBy("_id").agg(F.bool_or(F.col("_l").isNull()).alias("_open"), F.collect_set("_l").alias("_c"))
    g = g.select("_id", "_c", atom_names(F.col("_c")).alias("_atoms"), undecided(F.col("_c"), F.col("_open"), most_atoms).alias("reason"))
    masks = F.expr(f"transform(_c, c -> struct({mask('c', '_atoms', False)} as care, {mask('c', '_atoms', True)} as want))")
    g = g.withColumn("_m", F.when(F.col("reason").isNull(), masks))
    free = F.expr("filter(sequence(0, shiftleft(1, size(_atoms)) - 1), r -> not exists(_m, m -> (r & m.care) = m.want))")
    g = g.withColumn("_free", F.when(F.col("reason").isNull(), free))
    g = sets.select(*keys, "_id").join(g, "_id")
    return g.select(*keys, F.when(F.col("reason").isNull(), F.size("_atoms")).alias("n_atoms"), F.when(F.col("reason").isNull(), F.size("_free")).alias("uncovered"), F.get("_free", F.lit(0)).alias("first_uncovered"), "reason")
