"""An append-only log of human edits, replayed in its order over what the source says.

elements(model_id, kind, id, lifecycle, props map<string,string>); log(model_id, kind, id, seq, operation,
prop, previous_value, new_value, payload map<string,string>, author) with the operations add, remove and
modify. What an entry does depends on whether its element is there at that point: adding what is there,
and removing or changing what is not, are no-ops. That is decided by the last add or remove before the
entry, so the replay is a window over each element's entries and two aggregations, and no list of
entries is gathered. An entry made against another source value is stale, and applies all the same.

Keys and seq are not null, and seq is unique within an element. Null values are values: an edit to null
holds. Other operations are no-ops. Elements without entries come back as they are; an empty log changes
nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["model_id", "kind", "id"]
ADD, REMOVE, MODIFY = "add", "remove", "modify"
#: Properties that a transition's natural key is made of: a change of one is a rename.
IDENTITY = ("source", "trigger", "target")


def entries(elements: DataFrame, log: DataFrame) -> DataFrame:
    """The log with what each entry did: outcome (applied, no-op), stale, now_extracted and moves_identity beside its columns."""
    source = elements.select(*KEY, F.lit(True).alias("_in"), F.col("props").alias("_props"))
    rows = log.join(source, KEY, "left").withColumn("_in", F.coalesce("_in", F.lit(False)))
    before = Window.partitionBy(*KEY).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("operation").isin(ADD, REMOVE), F.col("operation")), ignorenulls=True).over(before)
    there = F.when(last == ADD, True).when(last == REMOVE, False).otherwise(F.col("_in"))
    does = F.when(F.col("operation") == ADD, ~there).when(F.col("operation").isin(REMOVE, MODIFY), there).otherwise(False)
    changes = F.col("operation") == MODIFY
    now = F.when(changes, F.try_element_at("_props", F.col("prop")))
    return rows.withColumn("_there", there).select(
        *log.columns, F.when(does, "applied").otherwise("no-op").alias("outcome"), F.coalesce(changes & ~now.eqNullSafe(F.col("previous_value")), F.lit(False)).alias("stale"), now.alias("now_extracted"),
        F.coalesce(changes & (F.col("kind") == "transition") & F.col("prop").isin(*IDENTITY), F.lit(False)).alias("moves_identity"),
    )


def replay(elements: DataFrame, log: DataFrame) -> DataFrame:
    """The elements after the log: model_id, kind, id, lifecycle, props and author (null: nobody touched it). What was touched is at Quarantine."""
    done = entries(elements, log).where("outcome = 'applied'")
    per = done.groupBy(*KEY).agg(
        F.max_by("operation", F.when(F.col("operation").isin(ADD, REMOVE), F.col("seq"))).alias("_last"), F.max(F.when(F.col("operation") == ADD, F.col("seq"))).alias("_added"), F.max_by("author", "seq").alias("author")
    )
    base = elements.select(*KEY, "lifecycle", F.lit(True).alias("_in")).join(per, KEY, "full_outer")
    kept = base.where(F.coalesce(F.col("_last") == ADD, "_in"))
    event = lambda df, seq: df.select(*KEY, seq.alias("seq"), "prop", "value")
    said = event(elements.select(*KEY, F.explode("props").alias("prop", "value")), F.lit(None).cast("long"))
    made = event(done.where(F.col("operation") == ADD).select(*KEY, "seq", F.explode("payload").alias("prop", "value")), F.col("seq").cast("long"))
    changed = event(done.where(F.col("operation") == MODIFY).select(*KEY, "seq", "prop", F.col("new_value").alias("value")), F.col("seq").cast("long"))
    # what was said before an element was added anew is gone with the element it was said of
    live = said.unionByName(made).unionByName(changed).join(kept.select(*KEY, "_added"), KEY).where("_added is null or seq >= _added")
    values = live.groupBy(*KEY, "prop").agg(F.max_by(F.struct("value"), F.coalesce("seq", F.lit(-(1 << 62)))).alias("v"))
    props = values.groupBy(*KEY).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("prop", F.col("v.value").alias("value"))))).alias("props"))
    touched = F.col("author").isNotNull() | F.col("_added").isNotNull() | F.col("_t")
    rows = kept.join(props, KEY, "left").join(done.select(*KEY).distinct().withColumn("_t", F.lit(True)), KEY, "left").withColumn("_t", F.coalesce("_t", F.lit(False)))
    return rows.select(*KEY, F.when(touched, "Quarantine").otherwise(F.col("lifecycle")).alias("lifecycle"), F.coalesce("props", F.create_map().cast("map<string,string>")).alias("props"), "author")


def touched_groups(elements: DataFrame, log: DataFrame) -> DataFrame:
    """(model_id, source, trigger) of every group that an applied edit of a transition left or joined: their determinism and completeness have to be shown again."""
    rows = entries(elements, log).where("kind = 'transition' and outcome = 'applied'").join(elements.select(*KEY, F.col("props").alias("_p")), KEY, "left")
    order = Window.partitionBy(*KEY).orderBy("seq")

    def at(prop: str, frame) -> Column:
        # a struct, so that a value that was set to null is still the last one
        said = F.when(F.col("operation") == ADD, F.struct(F.try_element_at("payload", F.lit(prop)).alias("v"))).when((F.col("operation") == MODIFY) & (F.col("prop") == prop), F.struct(F.col("new_value").alias("v")))
        last = F.last(said, ignorenulls=True).over(frame)
        return F.when(last.isNotNull(), last.v).otherwise(F.try_element_at("_p", F.lit(prop)))

    before, upto = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    pair = lambda frame: F.struct(at("source", frame).alias("source"), at("trigger", frame).alias("trigger"))
    rows = rows.select("model_id", "operation", pair(before).alias("_b"), pair(upto).alias("_a"))
    groups = F.when(F.col("operation") == ADD, F.array("_a")).when(F.col("operation") == REMOVE, F.array("_b")).otherwise(F.array("_b", "_a"))
    return rows.select("model_id", F.explode(groups).alias("g")).select("model_id", "g.*").distinct()
