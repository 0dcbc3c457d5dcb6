"""Coverage criteria, the ledger, and grades. A dropped target stays in the result with a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODEL = "model_id"


def exclusion(status: Column, lifecycle: Column) -> Column:
    """Why a transition is not generatable, null if it is; the order of the reasons is fixed."""
    return (
        F.when(status == "planned", "excluded_planned")
        .when(lifecycle == "Disputed", "excluded_disputed")
        .when(lifecycle == "Rejected", "excluded_rejected")
        .when(lifecycle.isNull() | (lifecycle != "Approved"), "excluded_unapproved")
    )


def all_states(t: DataFrame, initial: DataFrame) -> DataFrame:
    """For each state but the initial ones the generatable arrival of the lowest id; unsatisfiable where there is none. t(model_id, id, source, target, generatable)."""
    arrivals = t.groupBy(MODEL, F.col("target").alias("state")).agg(F.min(F.when(F.col("generatable"), F.col("id"))).alias("validates"))
    states = t.select(MODEL, F.col("source").alias("state")).union(t.select(MODEL, "target")).distinct().join(initial, [MODEL, "state"], "left_anti")
    return states.join(arrivals, [MODEL, "state"], "left").withColumn("reason", F.when(F.col("validates").isNull(), "no generatable arrival"))


def guard_targets(t: DataFrame) -> DataFrame:
    """Each transition with its guard true, and false: the false case is validated by the lowest other member of its (state, trigger) group."""
    members = t.groupBy(MODEL, "source", "trigger").agg(F.array_sort(F.collect_set("id")).alias("_ids"))
    rows = t.join(members, [MODEL, "source", "trigger"])
    sibling = F.get(F.filter("_ids", lambda x: x != F.col("id")), F.lit(0))
    both = F.array(F.struct(F.lit("true").alias("polarity"), F.col("id").alias("validates")), F.struct(F.lit("false").alias("polarity"), sibling.alias("validates")))
    return rows.withColumn("_t", F.explode(both)).select(MODEL, "id", "_t.polarity", "_t.validates", F.when(F.col("_t.validates").isNull(), "no sibling").alias("reason"))


def ledger_summary(t: DataFrame, ledger: DataFrame) -> DataFrame:
    """Transitions of each model by best mechanism: direct, indirect, initiated (which never counts), or uncovered; an unknown mechanism covers nothing."""
    rank = F.nullif(F.array_position(F.array(*map(F.lit, ("direct", "indirect", "initiated"))), F.col("mechanism")), F.lit(0))
    best = ledger.groupBy(MODEL, "id").agg(F.min(rank).alias("best"))
    rows = t.join(best, [MODEL, "id"], "left")
    count = lambda c: F.coalesce(F.sum(F.when(c, 1)), F.lit(0)).cast("long")
    return rows.groupBy(MODEL).agg(F.count("*").alias("total"), count(F.col("best") <= 2).alias("covered"), count(F.col("best") == 2).alias("indirect_only"), count(F.col("best") == 3).alias("initiated_only"), count(F.col("best").isNull()).alias("uncovered"))


def grade(t: DataFrame, tests: DataFrame) -> DataFrame:
    """covered: a test reaches the transition and asserts its outcome; endpoint-only: it reaches it; else uncovered. tests(model_id, id, asserts boolean)."""
    best = tests.groupBy(MODEL, "id").agg(F.bool_or("asserts").alias("_a"))
    return t.join(best, [MODEL, "id"], "left").withColumn("grade", F.when(F.col("_a"), "covered").when(F.col("_a").isNotNull(), "endpoint-only").otherwise("uncovered")).drop("_a")
