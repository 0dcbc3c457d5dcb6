"""Claims with validity windows as a versioned table (see ``versions``).

A claim is (key, id, text, revision, valid_from, valid_to, lifecycle); an open window has a null valid_to.
Before a version is switched to, no key may have two open rows. Nothing is deleted. Null keys and ids are
refused; an empty change makes no version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statewake.sources.versions import Change, VersionedTables

SCHEMA = "key string, id string, text string, revision long, valid_from string, valid_to string, lifecycle string"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


def claim_id(key: str = "key", text: str = "text"):
    """A claim's id: its key and a digest of what it says."""
    return F.concat(F.col(key), F.lit("@"), F.substring(F.sha2(F.coalesce(F.col(text), F.lit("")), 256), 1, 8))


class ClaimsTable:
    """The table in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.tables = VersionedTables(spark, path, buckets)

    def version(self) -> int:
        return self.tables.version()

    def read(self, version: int | None = None) -> DataFrame:
        return self.tables.read("claims", SCHEMA, version)

    def as_of(self, at: str) -> DataFrame:
        """The claims that hold at an instant, in half-open windows."""
        return self.read().where((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at)))

    # changes
    def _commit(self, keys: DataFrame, change) -> int:
        def one_open(_: str, rows: DataFrame) -> None:
            if two := rows.where("valid_to is null").groupBy("key").count().where("count > 1").select("key").limit(1).collect():
                raise ValueError(f"two open claims of one key: {two[0].key}")

        return self.tables.commit({"claims": Change(SCHEMA, "key", keys, change)}, one_open)

    def land(self, incoming: DataFrame) -> int:
        """Take in claims(key, text, valid_from), one a key, those that say what is current being left alone.

        A claim that says something else closes the current one at its own valid_from and is the next
        revision, at Quarantine; the old one keeps its lifecycle. If it says what an earlier revision
        said, that row is opened again, as the next revision, with the valid_from of its first time.
        """
        inc = incoming.select("key", claim_id().alias("id"), "text", "valid_from")
        bad = F.col("key").isNull() | F.col("valid_from").isNull()
        checked = inc.agg(F.count_if(bad).alias("bad"), F.count("*").alias("n"), F.count_distinct("key").alias("keys")).first()
        if checked.bad or checked.n != checked["keys"]:
            raise ValueError("a claim needs a key and valid_from, and a key comes once")
        held = self.read().where("valid_to is null").select("key", F.col("id").alias("_now"), F.col("revision").alias("_revision"))
        plan = inc.join(held, "key", "left").where("_now is null or _now <> id")

        def change(rows: DataFrame) -> DataFrame:
            new = plan.select("key", F.col("id").alias("_id"), F.col("text").alias("_text"), F.col("valid_from").alias("_from"), "_now", F.coalesce(F.col("_revision") + 1, F.lit(1)).alias("_next"))
            both = rows.join(new, "key", "left")
            opened, closed = F.coalesce(F.col("id") == F.col("_id"), F.lit(False)), F.coalesce(F.col("id") == F.col("_now"), F.lit(False))
            last = rows.groupBy("key").agg(F.max("revision").alias("_most"))
            kept = both.join(last, "key", "left").select(
                "key", "id", "text", F.when(opened, F.greatest("_next", F.col("_most") + 1)).otherwise(F.col("revision")).alias("revision"), "valid_from",
                F.when(opened, None).when(closed, F.col("_from")).otherwise(F.col("valid_to")).alias("valid_to"), F.when(opened, "Quarantine").otherwise(F.col("lifecycle")).alias("lifecycle"),
            )
            fresh = new.join(rows.select("key", F.col("id").alias("_id")), ["key", "_id"], "left_anti").join(last, "key", "left")
            added = fresh.select("key", F.col("_id").alias("id"), F.col("_text").alias("text"), F.greatest("_next", F.coalesce(F.col("_most") + 1, F.lit(1))).alias("revision"), F.col("_from").alias("valid_from"), F.lit(None).cast("string").alias("valid_to"), F.lit("Quarantine").alias("lifecycle"))
            return kept.unionByName(added)

        return self._commit(plan.select("key"), change)

    def close(self, ids: DataFrame, at: str) -> dict[str, int]:
        """Close the open windows of ids(id) at an instant. Closed ones stay as they are, so a second call changes nothing: closed, already_closed and missing."""
        if not (at or "").strip():
            raise ValueError("closing needs the instant at which the fact stopped being true")
        wanted = ids.select("id").where("id is not null").distinct()
        found = wanted.join(self.read().select("id", "key", F.col("valid_to").isNull().alias("_open")), "id", "left")
        n = found.agg(F.count_if("_open").alias("closed"), F.count_if(~F.col("_open")).alias("already_closed"), F.count_if(F.col("key").isNull()).alias("missing")).first()
        if n.closed:
            mine = wanted.withColumn("_c", F.lit(True))
            self._commit(found.where("_open").select("key"), lambda rows: rows.join(mine, "id", "left").withColumn("valid_to", F.when(F.col("valid_to").isNull() & F.col("_c"), at).otherwise(F.col("valid_to"))))
        return n.asDict()

    def backfill(self, at: str) -> dict[str, int]:
        """Give rows without valid_from the one that the caller states; those that have one stay: written and still_missing."""
        if not (at or "").strip():
            raise ValueError("backfilling needs the instant from which the facts were believed")
        bare = self.read().where("valid_from is null")
        if n := bare.count():
            self._commit(bare.select("key"), lambda rows: rows.withColumn("valid_from", F.coalesce("valid_from", F.lit(at))))
        return {"written": n, "still_missing": self.read().where("valid_from is null").count()}

    def load(self, rows: DataFrame) -> int:
        """Take in claims as they are, such as rows from before windows were kept; all of a key's rows come together."""
        keys = rows.select("key").distinct()
        return self._commit(keys, lambda old: old.join(keys, "key", "left_anti").unionByName(rows.select(*COLUMNS)))
