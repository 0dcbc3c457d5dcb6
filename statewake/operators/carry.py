"""Human facts carried from a model onto what was extracted anew.

Decisions and names are people's, all else is the extraction's. An approval ends where the behaviour
changed, and where anything else in its (source, trigger) group did: determinism and completeness are
properties of the group. Tables are keyed by (model_id, key); of several rows of the earlier model with one
key the lowest id counts. Keys are not null; what is new carries nothing; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statewake.operators import delta

KEY = ["model_id", "key"]
GROUP = ["model_id", "source", "trigger"]
APPROVED, QUARANTINE = "Approved", "Quarantine"


def _first(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.groupBy(*KEY).agg(F.min_by(F.struct(*columns), "id").alias("_p"))


def states(previous: DataFrame, candidate: DataFrame) -> DataFrame:
    """The candidate's states with the name, lifecycle and name_tier of the earlier ones; both (model_id, key, id, name, lifecycle, name_tier, ...)."""
    rows = candidate.join(_first(previous, ["name", "lifecycle", "name_tier"]), KEY, "left")
    known = F.col("_p").isNotNull()
    human = {"name": F.col("_p.name"), "lifecycle": F.col("_p.lifecycle"), "name_tier": F.coalesce(F.nullif("_p.name_tier", F.lit("")), F.col("name_tier"))}
    return rows.select(*(F.when(known, human[c]).otherwise(F.col(c)).alias(c) if c in human else F.col(c) for c in candidate.columns), known.alias("carried"))


def transitions(previous: DataFrame, candidate: DataFrame, fields: list[str], quiet: tuple[str, ...] = ("name",)) -> DataFrame:
    """The candidate's transitions with the lifecycle of the earlier ones, carried, and why an approval was revoked (null: it was not).

    Both (model_id, key, id, source, trigger, lifecycle, ...fields); fields are compared, and quiet ones do not end an approval.
    """
    p = previous.groupBy(*KEY).agg(F.min_by(F.struct("source", "trigger", "lifecycle", *fields), "id").alias("_v")).select(*KEY, "_v.*")
    c = candidate.groupBy(*KEY).agg(F.min_by(F.struct(*fields), "id").alias("_v")).select(*KEY, "_v.*")
    changes = delta.keyed_diff(p, c, KEY, fields, list(quiet)).select(*KEY, "change", "invalidates")
    # a group is disturbed by every change of one that is or was in it
    ends = previous.select(*KEY, *GROUP[1:]).union(candidate.select(*KEY, *GROUP[1:]))
    disturbed = ends.join(changes.where("change <> 'UNCHANGED'"), KEY, "left_semi").select(*GROUP).distinct().withColumn("_disturbed", F.lit(True))
    rows = candidate.join(p.select(*KEY, F.col("lifecycle").alias("_old")), KEY, "left").join(changes, KEY, "left").join(disturbed, GROUP, "left")
    known = F.col("change").isin("MODIFIED", "UNCHANGED")
    why = F.when(known & (F.col("_old") == APPROVED), F.when(F.col("invalidates"), "behaviour changed").when(F.col("_disturbed"), "group was disturbed"))
    lifecycle = F.when(why.isNotNull(), QUARANTINE).when(known, F.col("_old")).otherwise(F.col("lifecycle"))
    return rows.select(*(lifecycle.alias(x) if x == "lifecycle" else F.col(x) for x in candidate.columns), F.coalesce(known, F.lit(False)).alias("carried"), why.alias("revoked"))
