"""Graph walks. Small models are walked as a whole, each in one group; larger ones by rounds of joins, each written to the shared folder to cut lineage."""

from __future__ import annotations

import itertools
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

MODEL = "model_id"
#: A model of at most so many edges and initial states is small.
SMALL = 2_000


def _written(df: DataFrame, root: str, name: str) -> DataFrame:
    df.write.parquet(f"{root}/{name}")
    return df.sparkSession.read.parquet(f"{root}/{name}")


def scratch(df: DataFrame) -> str:
    spark = df.sparkSession
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="statewake-"))
        named = spark.sparkContext.getCheckpointDir()
    return f"{named}/walk-{uuid.uuid4().hex}"


def shortest_ways(starts: list, steps: list[tuple], cap: int | None = None) -> list[tuple[object, int, list]]:
    """(state, depth, path) of every state that steps(id, source, target) lead to from starts; of the shortest paths that with the smallest ids from the first step on."""
    after: dict = {}
    for name, source, target in steps:
        after.setdefault(source, []).append((name, target))
    ways = {s: [] for s in starts}
    depth, front = {s: 0 for s in starts}, {s: 0 for s in starts}
    while front and (cap is None or max(depth.values()) < cap):
        met: dict = {}
        for state, place in front.items():
            for name, target in after.get(state, ()):
                if target not in ways:
                    way = (place, name is not None, name or "", state)
                    met[target] = min(met.get(target, way), way, key=lambda w: w[:3])
        # paths of one length compare as the places of their beginnings and the last step do
        places = {key: i for i, key in enumerate(sorted({w[:3] for w in met.values()}))}
        for target, (_, known, name, state) in met.items():
            ways[target], depth[target] = [*ways[state], name if known else None], depth[state] + 1
        front = {target: places[w[:3]] for target, w in met.items()}
    return [(s, depth[s], way) for s, way in ways.items()]


def _walked(rows: DataFrame, cap: int | None) -> DataFrame:
    """setup_paths of small models: rows(model_id, id, source, target), an initial state being a row without a target."""
    kind = f"{MODEL} {rows.schema[MODEL].dataType.simpleString()}, state {rows.schema['source'].dataType.simpleString()}, depth int, path array<string>"
    schema = to_arrow_schema(rows.sparkSession.createDataFrame([], kind).schema)

    def run(model: pa.Table) -> pa.Table:
        steps = list(zip(*(model.column(c).to_pylist() for c in ("id", "source", "target")), strict=True))
        ways = shortest_ways([s for _, s, t in steps if t is None], [x for x in steps if x[2] is not None], cap)
        values = [[model.column(MODEL)[0].as_py()] * len(ways), *(list(c) for c in zip(*ways, strict=True))] if ways else [[]] * 4
        return pa.Table.from_arrays([pa.array(v, f.type) for v, f in zip(values, schema, strict=True)], schema=schema)

    return rows.groupBy(MODEL).applyInArrow(run, kind)


def setup_paths(edges: DataFrame, initial: DataFrame, cap: int | None = None) -> DataFrame:
    """Shortest setup path of every reachable state: model_id, state, depth, path (ids of transitions).

    Of the paths of one length that with the smallest ids, compared from the first step, is kept.
    edges(model_id, id, source, target), initial(model_id, state). A small model is one group. Large
    ones go together; a round is a join on (model, state), and states seen before drop out. The walk
    ends with an empty round; beyond cap steps, where one is given, states count as not looked for. Repeated edges and initial
    states change nothing, null ends lead nowhere, and no initial state gives no row.
    """
    root, spark = scratch(edges), edges.sparkSession
    steps = edges.select(MODEL, F.col("id").cast("string").alias("id"), "source", "target").where("source is not null and target is not null")
    begun = initial.select(MODEL, F.lit(None).cast("string").alias("id"), F.col("state").alias("source"), F.lit(None).cast(steps.schema["target"].dataType).alias("target")).where("source is not null")
    rows = _written(steps.unionByName(begun).distinct(), root, "rows")
    large = rows.groupBy(MODEL).agg(F.count("*").alias("n")).where(F.col("n") > SMALL).select(MODEL)
    if not large.limit(1).count():
        return _written(_walked(rows, cap), root, "small")
    large = _written(large, root, "large")
    small = _written(_walked(rows.join(large, MODEL, "left_anti"), cap), root, "small")
    rows = rows.join(large, MODEL, "left_semi")
    e = _written(rows.where("target is not null"), root, "edges")
    seen = _written(rows.where("target is null").select(MODEL, F.col("source").alias("state"), F.lit(0).alias("depth"), F.array().cast("array<string>").alias("path")), root, "0")
    frontier = seen
    for k in itertools.count(1) if cap is None else range(1, cap + 1):
        step = frontier.select(MODEL, F.col("state").alias("source"), "path").join(e, [MODEL, "source"]).select(MODEL, F.col("target").alias("state"), F.array_append("path", F.col("id")).alias("path"))
        best = step.groupBy(MODEL, "state").agg(F.min("path").alias("path")).join(seen.select(MODEL, "state"), [MODEL, "state"], "left_anti")
        # the round's size is counted while it is written
        size = Observation()
        _written(best.select(MODEL, "state", F.lit(k).alias("depth"), "path").observe(size, F.count("*").alias("n")), root, str(k))
        if not size.get["n"]:
            break
        frontier = spark.read.schema(seen.schema).parquet(f"{root}/{k}")
        # one scan of all rounds, so that plans do not grow with the walk
        seen = spark.read.schema(seen.schema).parquet(*(f"{root}/{i}" for i in range(k + 1)))
    return seen.unionByName(small)


def reachability(edges: DataFrame, initial: DataFrame, cap: int | None = None) -> DataFrame:
    """Every state of every model with its depth (null: unreachable) and whether it is terminal."""
    states = edges.select(MODEL, F.col("source").alias("state")).union(edges.select(MODEL, "target")).union(initial.select(MODEL, "state")).distinct()
    outgoing = edges.select(MODEL, F.col("source").alias("state"), F.lit(True).alias("_out")).distinct()
    found = setup_paths(edges.where("status = 'implemented'"), initial, cap).select(MODEL, "state", "depth")
    return states.join(found, [MODEL, "state"], "left").join(outgoing, [MODEL, "state"], "left").select(MODEL, "state", "depth", F.col("_out").isNull().alias("terminal"))


def degrees(edges: DataFrame) -> DataFrame:
    """Fan-in and fan-out of each state by one aggregation."""
    ends = edges.select(MODEL, F.col("source").alias("state"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(edges.select(MODEL, "target", F.lit(0), F.lit(1)))
    return ends.groupBy(MODEL, "state").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))


def connected(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that a walk over edges in either direction reaches from the seeds: node; seeds(node), edges(src, dst)."""
    root, spark = scratch(edges), edges.sparkSession
    both = _written(edges.select(F.col("src").alias("node"), F.col("dst").alias("next")).unionAll(edges.select("dst", "src")).distinct(), root, "edges")
    seen = frontier = _written(seeds.select("node").distinct(), root, "0")
    for k in itertools.count(1):
        size = Observation()
        step = frontier.join(both, "node").select(F.col("next").alias("node")).distinct().join(seen, "node", "left_anti")
        _written(step.observe(size, F.count("*").alias("n")), root, str(k))
        if not size.get["n"]:
            return seen
        frontier = spark.read.schema(seen.schema).parquet(f"{root}/{k}")
        seen = spark.read.schema(seen.schema).parquet(*(f"{root}/{i}" for i in range(k + 1)))


def climb(parents: DataFrame, tops: DataFrame) -> DataFrame:
    """For each node the top that its parents lead to, however far: node, root (null where none is reached) and hops; parents(node, parent), tops(node)."""
    e = parents.select(F.lit(0).alias(MODEL), F.concat_ws("<", F.hex(F.col("parent").cast("string")), F.hex(F.col("node").cast("string"))).alias("id"), F.col("parent").alias("source"), F.col("node").alias("target"))
    ways = setup_paths(e, tops.select(F.lit(0).alias(MODEL), F.col("node").alias("state"))).select(F.col("state").alias("node"), F.col("depth").alias("hops"), F.coalesce(F.unhex(F.split_part(F.get("path", F.lit(0)), F.lit("<"), F.lit(1))).cast("string"), F.col("state").cast("string")).alias("root"))
    nodes = parents.select("node").union(tops.select("node")).distinct()
    return nodes.join(ways, "node", "left").select("node", "root", "hops")


def isolated(nodes: DataFrame, key: str, *ends: DataFrame) -> DataFrame:
    """Nodes that no edge table has at its one column."""
    for e in ends:
        nodes = nodes.join(e.toDF(key).distinct(), key, "left_anti")
    return nodes
