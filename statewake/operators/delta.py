"""Comparisons of keyed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keyed_diff(old: DataFrame, new: DataFrame, keys: list[str], fields: list[str], quiet: list[str] | None = None) -> DataFrame:
    """ADDED, REMOVED, MODIFIED or UNCHANGED for each key of either table, by one full outer join.

    With quiet, the fields that say nothing about behaviour (a name), invalidates tells whether another one
    was modified, which ends an approval. Keys are not null and stand once on a side.
    """
    a = old.select(*keys, F.lit(True).alias("_a"), *(F.col(c).alias(f"old_{c}") for c in fields))
    b = new.select(*keys, F.lit(True).alias("_b"), *(F.col(c).alias(f"new_{c}") for c in fields))
    same = F.lit(True)
    for c in fields:
        same = same & F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}"))
    change = F.when(F.col("_a").isNull(), "ADDED").when(F.col("_b").isNull(), "REMOVED").when(same, "UNCHANGED").otherwise("MODIFIED")
    rows = a.join(b, keys, "full_outer").withColumn("change", change)
    if quiet is not None:
        loud = F.lit(False)
        for c in fields:
            loud = loud if c in quiet else loud | ~F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}"))
        rows = rows.withColumn("invalidates", (F.col("change") == "MODIFIED") & loud)
    return rows.drop("_a", "_b")


def drift(last: DataFrame, published: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """NEW, MANUALLY_EDITED (tested before change), CHANGED, UNCHANGED or OBSOLETE of cases with (key, hash)."""
    named = [x.select(key, F.col("hash").alias(n)) for x, n in ((last, "l"), (published, "p"), (new, "n"))]
    rows = named[0].join(named[1], key, "full_outer").join(named[2], key, "full_outer")
    state = (
        F.when(F.col("n").isNull(), F.when(F.col("p").isNotNull(), "OBSOLETE").otherwise("GONE"))
        .when(F.col("l").isNull() & F.col("p").isNull(), "NEW")
        .when(~F.col("p").eqNullSafe(F.col("l")), "MANUALLY_EDITED")
        .when(F.col("l") != F.col("n"), "CHANGED")
        .otherwise("UNCHANGED")
    )
    return rows.select(key, state.alias("drift"))


def override_fold(log: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """The last override of each element and property over its source value; stale where it was made against another value.

    log(key, prop, seq, previous_value, new_value), source(key, prop, value). A stale override is applied all the same, and one to null holds; for adding and removing see ``overrides``.
    """
    last = log.groupBy(key, "prop").agg(F.max_by(F.struct("previous_value", "new_value"), "seq").alias("o"))
    rows = source.join(last, [key, "prop"], "left")
    return rows.select(key, "prop", F.when(F.col("o").isNotNull(), F.col("o.new_value")).otherwise(F.col("value")).alias("value"), F.col("o").isNotNull().alias("overridden"), (F.col("o").isNotNull() & ~F.col("o.previous_value").eqNullSafe(F.col("value"))).alias("stale"))


def upsert(existing: DataFrame, incoming: DataFrame, key: str, human: list[str], machine: list[str]) -> DataFrame:
    """Merge on the key: human columns keep what exists, machine columns take what comes."""
    a, b = existing.select(key, *(F.col(c).alias(f"_a_{c}") for c in human + machine)), incoming.select(key, F.lit(True).alias("_in"), *(F.col(c).alias(f"_b_{c}") for c in human + machine))
    rows = a.join(b, key, "full_outer")
    return rows.select(key, *(F.coalesce(f"_a_{c}", f"_b_{c}").alias(c) for c in human), *(F.when(F.col("_in"), F.col(f"_b_{c}")).otherwise(F.col(f"_a_{c}")).alias(c) for c in machine))


def membership(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of one version alone: added or removed; repeated rows count once."""
    sides = old.select(*keys, F.lit(1).alias("o"), F.lit(0).alias("n")).unionAll(new.select(*keys, F.lit(0), F.lit(1))).groupBy(*keys).agg(F.max("o").alias("o"), F.max("n").alias("n"))
    return sides.where("o <> n").select(*keys, F.when(F.col("n") == 1, "added").otherwise("removed").alias("side"))
