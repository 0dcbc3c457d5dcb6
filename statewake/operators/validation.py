"""Model validation: findings(model_id, check, severity, elements, detail) in a fixed order of checks.

Severities: blocking (shown to be wrong), unverifiable (not shown to be right; it stops the gate unless
that is allowed), advisory. Input: t(model_id, id, source, trigger, target, status, guard, verb,
n_inputs, outcome_status), of which the implemented transitions count; states(model_id, state, name,
surface). A null guard is none. elements joins ids by a comma, in order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statewake.operators import guards

MODEL = "model_id"
# fixed values: the order of the checks
CHECKS = ("observability", "determinism", "guard-completeness", "callability", "polarity", "atomicity", "reachability", "ac-coverage")
GROUP = [MODEL, "source", "trigger"]


def _finding(df: DataFrame, check: str, severity, elements: Column, detail) -> DataFrame:
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    return df.select(MODEL, F.lit(check).alias("check"), as_column(severity).alias("severity"), elements.alias("elements"), as_column(detail).alias("detail"))


def _implemented(t: DataFrame) -> DataFrame:
    return t.where("status = 'implemented'").withColumn("guard", F.trim(F.coalesce("guard", F.lit(""))))


def effective_guard(t: DataFrame, inherited: DataFrame) -> DataFrame:
    """Transitions whose guard is joined by AND with what they inherit over confirmed links; inherited(model_id, id, borrowed), one row a transition."""
    local, borrowed = F.nullif(F.trim(F.coalesce("guard", F.lit(""))), F.lit("")), F.nullif(F.trim(F.col("borrowed")), F.lit(""))
    return t.join(inherited, [MODEL, "id"], "left").withColumn("guard", F.concat_ws(" AND ", local, borrowed)).drop("borrowed")


def determinism(t: DataFrame) -> DataFrame:
    """Pairs of one (state, trigger) group that can both match."""
    g = _implemented(t).select(*GROUP, "id", "guard", guards.literals(F.col("guard")).alias("l"))
    pairs = g.withColumnsRenamed({"id": "a", "guard": "ga", "l": "la"}).join(g.withColumnsRenamed({"id": "b", "guard": "gb", "l": "lb"}), GROUP).where("a < b")
    c = guards.conflict(F.col("ga"), F.col("gb"), F.col("la"), F.col("lb"))
    bare = (F.col("ga") == "") | (F.col("gb") == "")
    found = pairs.withColumns({"_bare": bare, "_c": c}).where("_bare or _c.conflict")
    severity = F.when(F.col("_bare") | F.col("_c.certain"), "blocking").otherwise("unverifiable")
    return _finding(found, "determinism", severity, F.concat_ws(",", "a", "b"), F.when(F.col("_bare"), "unguarded sibling").otherwise(F.col("_c.reason")))


def _sweep(intervals: Column) -> Column:
    """Whether intervals leave a gap on the line: one pass by lower end against the furthest upper end so far."""
    key = F.transform(intervals, lambda i: F.struct(i.lo.alias("lo"), (~i.lo_in).alias("open"), i.hi.alias("hi"), i.hi_in.alias("hi_in")))
    start = F.struct(F.lit(float("-inf")).alias("far"), F.lit(True).alias("far_in"), F.lit(False).alias("gap"))

    def step(a, i):
        gap = a.gap | (i.lo > a.far) | ((i.lo == a.far) & ~a.far_in & i.open)
        further = (i.hi > a.far) | ((i.hi == a.far) & i.hi_in & ~a.far_in)
        return F.struct(F.when(further, i.hi).otherwise(a.far).alias("far"), F.when(further, i.hi_in).otherwise(a.far_in).alias("far_in"), gap.alias("gap"))

    return F.aggregate(F.array_sort(key), start, step, lambda a: a.gap | (a.far < float("inf")))


def guard_completeness(t: DataFrame, most_atoms: int = 10) -> DataFrame:
    """(state, trigger) groups of two or more guarded transitions that do not cover every case. Boolean cases that no guard holds for are unverifiable, since they may be impossible; gaps between thresholds are blocking."""
    g = _implemented(t).withColumns({"_l": guards.literals(F.col("guard")), "_t": guards.threshold(F.col("guard"))})
    member = F.struct("id", "guard", "_l", "_t")
    per = g.groupBy(*GROUP).agg(F.array_sort(F.collect_list(F.col("id"))).alias("ids"), F.collect_list(member).alias("_m"), F.bool_or(F.col("guard") == "").alias("_bare"), F.bool_or(F.col("_l").isNull()).alias("_open"), F.bool_and(F.col("_t").isNotNull()).alias("_all_t"))
    per = per.where((F.size("ids") >= 2) & ~F.col("_bare")).withColumn("_c", F.filter(F.transform("_m", lambda m: m._l), lambda x: x.isNotNull()))
    per = per.withColumns({"_atoms": guards.atom_names(F.col("_c")), "_why": guards.undecided(F.col("_c"), F.col("_open"), most_atoms)})
    masks = F.expr(f"transform(_c, c -> struct({guards.mask('c', '_atoms', False)} as care, {guards.mask('c', '_atoms', True)} as want))")
    per = per.withColumn("_k", F.when(F.col("_why").isNull(), masks))
    holes = F.expr("exists(sequence(0, shiftleft(1, size(_atoms)) - 1), r -> not exists(_k, m -> (r & m.care) = m.want))")
    paired = (F.size("ids") == 2) & F.coalesce(guards.relation(F.get("_c", F.lit(0)), F.get("_c", F.lit(1))) == "complementary", F.lit(False))
    names = F.array_distinct(F.transform("_m", lambda m: m._t["name"]))
    gap = _sweep(F.transform("_m", lambda m: guards.interval(m._t.op, m._t.bound)))
    kind = (
        F.when(paired, F.lit(None).cast("string"))
        .when(F.col("_why").isNull(), F.when(holes, "a combination without a guard"))
        .when(~F.col("_all_t"), "not simple thresholds")
        .when(F.size(names) > 1, "different variables")
        .when(gap, "gap between thresholds")
    )
    return _finding(per.withColumn("_kind", kind).where("_kind is not null"), "guard-completeness", F.when(F.col("_kind") == "gap between thresholds", "blocking").otherwise("unverifiable"), F.array_join("ids", ","), F.col("_kind"))


def reachability(states: DataFrame, reached: DataFrame) -> DataFrame:
    """reached(model_id, state, depth, terminal) as graph.reachability gives it. A model without an initial state is one finding, of the model."""
    begun = reached.where("depth = 0").select(MODEL).distinct().withColumn("_begun", F.lit(True))
    rows = states.select(MODEL, "state").join(reached, [MODEL, "state"], "left").join(begun, MODEL, "left")
    lost = F.col("depth").isNull()
    found = _finding(rows.where(F.col("_begun") & (lost | F.coalesce("terminal", F.lit(True)))), "reachability", F.when(lost, "blocking").otherwise("advisory"), F.col("state"), F.when(lost, "unreachable").otherwise("terminal"))
    none = states.select(MODEL).distinct().join(begun, MODEL, "left_anti")
    return found.unionAll(_finding(none, "reachability", "blocking", F.col(MODEL).cast("string"), "no initial state"))


def observability(states: DataFrame) -> DataFrame:
    """States without a name, and states of one surface that present alike."""
    g = states.groupBy(MODEL, "surface", F.lower(F.trim(F.coalesce("name", F.lit("")))).alias("_n")).agg(F.array_join(F.array_sort(F.collect_set("state")), ",").alias("_ids"), F.count_distinct("state").alias("_c"))
    return _finding(g.where("_n = '' or _c > 1"), "observability", "blocking", F.col("_ids"), F.when(F.col("_n") == "", "no name").otherwise("states that present alike"))


def atomicity(t: DataFrame) -> DataFrame:
    g = _implemented(t).where((F.col("guard") != "") & guards.top_conjuncts(F.col("guard")).isNull())
    return _finding(g, "atomicity", "advisory", F.col("id"), "a disjunction")


def is_callable(verb: Column, n_inputs: Column) -> Column:
    """Whether a call can be made: what takes a body needs an input."""
    return ~F.upper(F.coalesce(verb, F.lit(""))).isin("POST", "PUT", "PATCH") | (F.coalesce(n_inputs, F.lit(0)) > 0)


def callability(t: DataFrame) -> DataFrame:
    return _finding(_implemented(t).where(~is_callable(F.col("verb"), F.col("n_inputs"))), "callability", "unverifiable", F.col("id"), "takes a body, and no input is known")


def polarity(t: DataFrame) -> DataFrame:
    """Rejections guarded on an exception that is not thrown."""
    wrong = F.col("guard").contains("is thrown") & F.upper("guard").startswith("NOT (") & (F.col("outcome_status") >= 400)
    return _finding(_implemented(t).where(wrong), "polarity", "blocking", F.col("id"), "a rejection on an exception not thrown")


def ac_coverage(t: DataFrame, validated: DataFrame) -> DataFrame:
    """Transitions that no confirmed criterion validates; validated(model_id, id)."""
    return _finding(_implemented(t).join(validated.select(MODEL, "id"), [MODEL, "id"], "left_anti"), "ac-coverage", "advisory", F.col("id"), "nothing validates it")


def validate(t: DataFrame, states: DataFrame, reached: DataFrame, validated: DataFrame | None = None) -> DataFrame:
    """All findings, with the place of their check in the fixed order."""
    found = [observability(states), determinism(t), guard_completeness(t), callability(t), polarity(t), atomicity(t), reachability(states, reached)]
    if validated is not None:
        found.append(ac_coverage(t, validated))
    return reduce(DataFrame.unionAll, found).withColumn("check_no", F.array_position(F.array(*map(F.lit, CHECKS)), F.col("check")).cast("int"))


def gate(models: DataFrame, findings: DataFrame, allow_unverifiable: bool = False) -> DataFrame:
    """For each model its findings by severity, and whether it may go on."""
    counts = findings.groupBy(MODEL).agg(*(F.count_if(F.col("severity") == s).alias(s) for s in ("blocking", "unverifiable", "advisory")))
    rows = models.select(MODEL).distinct().join(counts, MODEL, "left").na.fill(0)
    return rows.withColumn("valid", (F.col("blocking") == 0) & (F.lit(allow_unverifiable) | (F.col("unverifiable") == 0)))
