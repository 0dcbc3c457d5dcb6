"""Graph pattern joins over transitions(model_id, id, source, trigger, target, status)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from statewake.operators import graph

MODEL = "model_id"


def consecutive_pairs(t: DataFrame) -> DataFrame:
    """Every two transitions that follow one another, named t1->t2; a shuffle on the state between."""
    first = t.select(MODEL, F.col("id").alias("first_id"), F.col("target").alias("state"))
    second = t.select(MODEL, F.col("id").alias("second_id"), F.col("source").alias("state"))
    return first.join(second, [MODEL, "state"])


def sibling_pairs(t: DataFrame) -> DataFrame:
    """Pairs of transitions that one state has for one trigger, each pair once."""
    keys = [MODEL, "source", "trigger"]
    a = t.select(*keys, F.col("id").alias("a_id"), F.col("lo").alias("a_lo"), F.col("hi").alias("a_hi"))
    b = t.select(*keys, F.col("id").alias("b_id"), F.col("lo").alias("b_lo"), F.col("hi").alias("b_hi"))
    return a.join(b, keys).where("a_id < b_id")


def vocabulary_gaps(t: DataFrame) -> DataFrame:
    """State and trigger pairs of a model that no transition has: the model's states by its triggers, less what exists."""
    states = t.select(MODEL, F.col("source").alias("state")).union(t.select(MODEL, "target")).distinct()
    triggers = t.select(MODEL, "trigger").distinct()
    return states.join(triggers, MODEL).join(t.select(MODEL, F.col("source").alias("state"), "trigger"), [MODEL, "state", "trigger"], "left_anti")


def not_covered(t: DataFrame, covering: DataFrame) -> DataFrame:
    return t.join(covering, [MODEL, "id"], "left_anti")


def covered(t: DataFrame, covering: DataFrame) -> DataFrame:
    return t.join(covering, [MODEL, "id"], "left_semi")


#: Members of a topic go in blocks of so many, and a task counts about so many pairs.
BLOCK, PAIRS_EACH = 1_000, 1 << 20


def co_members(rows: DataFrame, member: str, topic: str) -> DataFrame:
    """How many topics every two members share; each pair once.

    A member of a topic meets the blocks of those that follow it there; its pairs stay arrays until they
    are with the task that counts them. There are as many of these tasks as the number of pairs asks for.
    """
    r = rows.select(F.col(member).alias("a"), F.col(topic).alias("_t")).where("a is not null and _t is not null").distinct()
    place = F.row_number().over(Window.partitionBy("_t").orderBy("a")) - 1
    r = graph._written(r.withColumn("_i", place).withColumn("_b", F.floor(F.col("_i") / BLOCK).cast("int")), graph.scratch(rows), "members")
    # the places of a topic add up to its pairs
    pairs = r.agg(F.sum("_i")).first()[0] or 0
    # what a task joins is dealt by pairs too, since the arrays are many times the rows
    r = r.repartition(-(-pairs // (8 * PAIRS_EACH)) or 1, "_t")
    blocks = r.groupBy("_t", "_b").agg(F.sort_array(F.collect_list("a")).alias("_m"))
    met = r.withColumnRenamed("_b", "_own").join(blocks, "_t").where("_b >= _own")
    later = F.when(F.col("_b") == F.col("_own"), F.slice("_m", F.col("_i") % BLOCK + 2, F.lit(BLOCK))).otherwise(F.col("_m"))
    met = met.select("a", later.alias("_m")).where(F.size("_m") > 0).repartition(-(-pairs // PAIRS_EACH) or 1, "a")
    return met.select("a", F.explode("_m").alias("b")).groupBy("a", "b").agg(F.count("*").alias("shared"))


def within_hops(edges: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """Nodes within so many hops of each start, with the least number of hops; edges(model_id, source, target), start(model_id, state)."""
    e = edges.select(MODEL, "source", "target").distinct()
    found = frontier = start.select(MODEL, F.col("state").alias("start"), F.col("state").alias("node"), F.lit(0).alias("hops"))
    for k in range(1, hops + 1):
        frontier = frontier.join(e, (frontier[MODEL] == e[MODEL]) & (frontier["node"] == e["source"])).select(frontier[MODEL], "start", F.col("target").alias("node"), F.lit(k).alias("hops")).distinct()
        found = found.unionAll(frontier)
    return found.groupBy(MODEL, "start", "node").agg(F.min("hops").alias("hops"))


def optional_enrich(parents: DataFrame, key: str, branches: list[tuple[str, DataFrame, str]]) -> DataFrame:
    """Left joins of several branches, each gathered to one row a key first, so that branches do not multiply each other: (name, rows with the key, column to list)."""
    for name, rows, column in branches:
        parents = parents.join(rows.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(column)), ",").alias(name), F.count(column).alias(f"n_{name}")), key, "left")
        parents = parents.withColumns({name: F.coalesce(name, F.lit("")), f"n_{name}": F.coalesce(f"n_{name}", F.lit(0))})
    return parents
