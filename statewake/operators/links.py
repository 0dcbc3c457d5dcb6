"""Links between two sides: evidence, references, candidates, divergence, credit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bare_key(claim: Column) -> Column:
    """The logical key of a claim id ``key@digest``, without a namespace ``x::``."""
    return F.regexp_replace(F.split_part(claim, F.lit("@"), F.lit(1)), "^.*::", "")


def resolve_claims(references: DataFrame, claims: DataFrame, ref: str, claim_id: str) -> DataFrame:
    """Each reference with the claim of its logical key; null where no claim has it. claims: one current claim a key."""
    keyed = claims.select(F.col(claim_id).alias("resolved"), bare_key(F.col(claim_id)).alias("_key"))
    return references.withColumn("_key", bare_key(F.col(ref))).join(keyed, "_key", "left").drop("_key")


def best_candidates(candidates: DataFrame, by: str, item: str, strength: str) -> DataFrame:
    """The strongest candidate of each key (ties to the lower id) and whether the top is shared."""
    top = candidates.groupBy(by).agg(F.max(strength).alias(strength))
    tied = candidates.join(top, [by, strength]).groupBy(by, strength).agg(F.min(item).alias(item), (F.count("*") > 1).alias("ambiguous"))
    return tied.select(by, item, strength, "ambiguous")


def first_form(rows: DataFrame, forms: list[Column], known: DataFrame, row_id: str, form: str) -> DataFrame:
    """For each row the first of several spellings that the known table has, and its place in the list; null for none."""
    spread = rows.select(row_id, F.posexplode(F.array(*forms)).alias("pos", form))
    hit = spread.join(known.select(form).distinct(), form, "left_semi").groupBy(row_id).agg(F.min(F.struct("pos", form)).alias("_h"))
    return rows.select(row_id).join(hit, row_id, "left").select(row_id, F.col(f"_h.{form}").alias(form), F.col("_h.pos").alias("pos"))


def keyed_union(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Every key of either side with where it stands: both, left-only or right-only."""
    sides = left.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionAll(right.select(key, F.lit(0), F.lit(1)))
    at = sides.groupBy(key).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return at.select(key, F.when((F.col("l") == 1) & (F.col("r") == 1), "both").when(F.col("l") == 1, "left-only").otherwise("right-only").alias("presence"))


def divergence(api: DataFrame, ui: DataFrame, links: DataFrame) -> DataFrame:
    """api-only: an API element that nothing links to; dangling: a link to an API element that is not there. links(ui_id, api_id)."""
    known = api.select(F.col("id").alias("api_id"))
    only = known.join(links.select("api_id").distinct(), "api_id", "left_anti").select(F.lit("api-only").alias("kind"), F.col("api_id").alias("id"))
    dangling = links.join(ui.select(F.col("id").alias("ui_id")), "ui_id", "left_semi").join(known, "api_id", "left_anti").select(F.lit("dangling").alias("kind"), F.col("api_id").alias("id")).distinct()
    return only.unionAll(dangling)


def indirect_credit(covered: DataFrame, links: DataFrame) -> DataFrame:
    """API elements that covered UI elements invoke and that are not covered themselves, by their lowest UI element. covered(id), links(ui_id, api_id, confirmed)."""
    used = links.where("confirmed").join(covered.select(F.col("id").alias("ui_id")), "ui_id", "left_semi").join(covered.select(F.col("id").alias("api_id")), "api_id", "left_anti")
    return used.groupBy("api_id").agg(F.min("ui_id").alias("through"))


def capped(rows: DataFrame, order: list, limit: int) -> DataFrame:
    """At most so many rows in order, with a flag whether more were there. This limit is the feature."""
    seen = rows.orderBy(*order).limit(limit + 1)
    n = seen.agg((F.count("*") > limit).alias("truncated"))
    return seen.orderBy(*order).limit(limit).crossJoin(F.broadcast(n))
