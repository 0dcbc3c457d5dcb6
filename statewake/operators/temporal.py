"""Claims with half-open validity windows [valid_from, valid_to); null valid_to is open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def valid_at(at: Column | str) -> Column:
    at = F.lit(at) if isinstance(at, str) else at
    return (F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at))


def revisions(changes: DataFrame, key: str, text: str, at: str, tie: str) -> DataFrame:
    """Change rows folded to claims: a new revision where the text differs from the one before; each closes where the next opens."""
    order = Window.partitionBy(key).orderBy(at, tie)
    kept = changes.withColumns({"_old": F.lag(text).over(order), "_first": F.row_number().over(order) == 1}).where(F.col("_first") | ~F.col("_old").eqNullSafe(F.col(text)))
    return kept.select(key, F.col(text).alias("text"), F.row_number().over(order).alias("revision"), F.col(at).alias("valid_from"), F.lead(at).over(order).alias("valid_to"))


def current(claims: DataFrame) -> DataFrame:
    return claims.where(F.col("valid_to").isNull())


def supersession(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """first-seen, unchanged or superseded for each incoming claim (key, text), with its revision; existing(key, text, revision) is current."""
    old = existing.select(key, F.col("text").alias("old_text"), F.col("revision").alias("old_revision"))
    both = incoming.join(old, key, "left")
    state = F.when(F.col("old_revision").isNull(), "first-seen").when(F.col("text").eqNullSafe(F.col("old_text")), "unchanged").otherwise("superseded")
    return both.select(key, "text", state.alias("outcome"), F.when(state == "first-seen", 1).when(state == "unchanged", F.col("old_revision")).otherwise(F.col("old_revision") + 1).alias("revision"))


def last_write(df: DataFrame, key: str, value: str, at: str, tie: str) -> DataFrame:
    """The value of the last row of each key, by one aggregation."""
    return df.groupBy(key).agg(F.max_by(value, F.struct(at, tie)).alias(value))
