"""Coverage targets and one generated path for each of them. Nothing is dropped: a target that has no path stays with its outcome and reason.

t: transitions(model_id, id, source, trigger, target, guard, generatable boolean). Targets are
(model_id, key, validates, via, reason): validates is the transition that the test asserts, via the one
that it has to arrive by; reason says why there is none to validate. Empty tables give empty targets;
ids are unique within a model.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODEL = "model_id"


def _targets(df: DataFrame, key: Column, validates: Column, via: Column | None = None, reason: Column | None = None) -> DataFrame:
    text = lambda c: F.lit(None).cast("string") if c is None else c
    return df.select(MODEL, key.alias("key"), validates.alias("validates"), text(via).alias("via"), text(reason).alias("reason"))


def generatable(t: DataFrame) -> DataFrame:
    return t.where("generatable")


def all_transitions(t: DataFrame) -> DataFrame:
    return _targets(generatable(t), F.col("id"), F.col("id"))


def transition_pairs(t: DataFrame) -> DataFrame:
    """Every two generatable transitions that follow one another; the second is validated. One that leads to a state without any has no pair."""
    g = generatable(t)
    after = g.select(MODEL, F.col("source").alias("target"), F.col("id").alias("second"))
    pairs = g.select(MODEL, "id", "target").join(after, [MODEL, "target"], "left")
    ends = F.col("second").isNull()
    return _targets(pairs, F.when(ends, F.col("id")).otherwise(F.concat_ws("->", "id", "second")), F.col("second"), F.when(~ends, F.col("id")), F.when(ends, "terminal: nothing to pair with"))


def atomic_conditions(guard: Column) -> Column:
    """The parts of a guard between AND or &&, as they stand; a guard with an OR is one part."""
    return F.filter(F.transform(F.split(F.trim(F.coalesce(guard, F.lit(""))), r"(?i)\s+AND\s+|\s*&&\s*"), lambda x: F.trim(x)), lambda x: x != "")


def guard_conditions(t: DataFrame) -> DataFrame:
    """A target for each condition and polarity of a guard; the false one is validated by the first other generatable transition of its (state, trigger) group."""
    g = generatable(t)
    group = [MODEL, "source", "trigger"]
    rows = g.join(g.groupBy(*group).agg(F.array_sort(F.collect_set("id")).alias("_ids")), group).withColumn("_c", atomic_conditions(F.col("guard")))
    bare = _targets(rows.where(F.size("_c") == 0), F.concat("id", F.lit("::<unguarded>")), F.col("id"))
    rows = rows.withColumn("_c", F.explode("_c")).withColumn("_p", F.explode(F.array(F.lit("true"), F.lit("false"))))
    other = F.get(F.filter("_ids", lambda x: x != F.col("id")), F.lit(0))
    validates = F.when(F.col("_p") == "true", F.col("id")).otherwise(other)
    return bare.unionAll(_targets(rows, F.concat_ws("::", "id", "_c", "_p"), validates, None, F.when(validates.isNull(), "no alternative exercises the complement"))).distinct()


def drop_covered(targets: DataFrame, grades: DataFrame) -> DataFrame:
    """Targets whose transition an existing test covers get the reason, which names the test; grades(model_id, id, grade, test), one row a transition."""
    covered = grades.where("grade = 'covered'").select(MODEL, F.col("id").alias("validates"), "test")
    rows = targets.join(covered, [MODEL, "validates"], "left")
    return rows.select(MODEL, "key", "validates", "via", F.coalesce("reason", F.when(F.col("test").isNotNull(), F.concat(F.lit("already covered by "), "test"))).alias("reason"))


def paths(targets: DataFrame, t: DataFrame, setups: DataFrame, cap: int = 10) -> DataFrame:
    """For each target its outcome (generated, unsatisfiable, unreachable, exceeds-cap), setup and its length; setups(model_id, state, path) of the generatable transitions, without a cap."""
    g = generatable(t)
    validated = g.select(MODEL, F.col("id").alias("validates"), F.col("source").alias("_goal"))
    via = g.select(MODEL, F.col("id").alias("via"), F.col("source").alias("_from"), F.col("target").alias("_to"))
    rows = targets.join(validated, [MODEL, "validates"], "left").join(via, [MODEL, "via"], "left")
    rows = rows.withColumn("state", F.when(F.col("via").isNull(), F.col("_goal")).when(F.col("_to") == F.col("_goal"), F.col("_from")))
    rows = rows.join(setups.select(MODEL, "state", "path"), [MODEL, "state"], "left")
    setup = F.when(F.col("via").isNull(), F.col("path")).otherwise(F.array_append("path", F.col("via")))
    outcome = F.when(F.col("reason").isNotNull(), "unsatisfiable").when(F.col("path").isNull(), "unreachable").when(F.size(setup) > cap, "exceeds-cap").otherwise("generated")
    detail = F.coalesce("reason", F.when(F.col("_goal").isNull(), "validated transition is absent or excluded").when(F.col("path").isNull(), "no route from an initial state").when(F.size(setup) > cap, F.concat(F.lit("requires "), F.size(setup).cast("string"), F.lit(f" steps, cap is {cap}"))))
    return rows.select(MODEL, "key", "validates", F.when(F.col("path").isNotNull() & F.col("reason").isNull(), setup).alias("setup"), outcome.alias("outcome"), detail.alias("detail"))


def persist_plan(generated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cases(case_id, model_id, key, group) of generated paths, and what they cover: (case_id, transition, sequence, is_validated); setup comes first, the validated transition last."""
    done = generated.where("outcome = 'generated'").withColumn("case_id", F.substring(F.sha2(F.concat_ws("|", F.col(MODEL).cast("string"), "key"), 256), 1, 16))
    steps = done.select("case_id", F.posexplode(F.array_append("setup", F.col("validates"))).alias("sequence", "transition"), F.size("setup").alias("_n"))
    return done.select("case_id", MODEL, "key", F.array_join("setup", ">").alias("group")), steps.select("case_id", "transition", "sequence", (F.col("sequence") == F.col("_n")).alias("is_validated"))


def partition(generated: DataFrame, t: DataFrame) -> DataFrame:
    """Counts of each model's targets by outcome, beside the transitions that are excluded: parts that are disjoint and add up."""
    parts = generated.groupBy(MODEL, F.col("outcome").alias("part")).agg(F.count("*").alias("n"))
    return parts.unionByName(t.where(~F.col("generatable")).groupBy(MODEL).agg(F.lit("excluded").alias("part"), F.count("*").alias("n")))
