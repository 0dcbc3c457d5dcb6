"""Workflow runs as tables: which stages may begin, what waits for a decision, what is wrong with a definition, who may decide.

stages(workflow, stage, place, requires array, gate boolean, blocking boolean); runs(run_id, workflow, stage, outcome, fingerprint, ended).
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from statewake.operators import graph


def latest(runs: DataFrame) -> DataFrame:
    """The last outcome of each stage of a run; ties to the greater outcome."""
    return runs.groupBy("run_id", "workflow", "stage").agg(F.max(F.struct("ended", "outcome", "fingerprint")).alias("_r")).select("run_id", "workflow", "stage", "_r.outcome", "_r.fingerprint", "_r.ended")


def eligibility(stages: DataFrame, runs: DataFrame, current: DataFrame) -> DataFrame:
    """For each run and stage whether it may begin, else why: a required stage is missing, not ok, or was of another fingerprint. current(run_id, workflow, fingerprint)."""
    done = latest(runs).select("run_id", "workflow", F.col("stage").alias("required"), "outcome", F.col("fingerprint").alias("of"))
    need = current.join(stages, "workflow").select("run_id", "workflow", "stage", "fingerprint", F.explode_outer("requires").alias("required"))
    rows = need.join(done, ["run_id", "workflow", "required"], "left")
    why = F.when(F.col("required").isNull(), F.lit(None)).when(F.col("outcome").isNull(), F.concat(F.lit("missing:"), "required")).when(F.col("outcome") != "ok", F.concat(F.lit("not-ok:"), "required")).when(~F.col("of").eqNullSafe(F.col("fingerprint")), F.concat(F.lit("stale:"), "required"))
    return rows.groupBy("run_id", "workflow", "stage").agg(F.array_join(F.array_sort(F.collect_set(why)), ",").alias("reasons")).withColumn("may_begin", F.col("reasons") == "")


def next_stage(stages: DataFrame, runs: DataFrame) -> DataFrame:
    """The first stage, by place, of each run that is not ok yet, and whether a blocking failure stops the run there."""
    began = runs.select("run_id", "workflow").distinct()
    rows = began.join(stages.select("workflow", "stage", "place", "blocking"), "workflow").join(latest(runs).select("run_id", "workflow", "stage", "outcome"), ["run_id", "workflow", "stage"], "left")
    left = rows.where(~F.coalesce(F.col("outcome") == "ok", F.lit(False)))
    return left.groupBy("run_id", "workflow").agg(F.min(F.struct("place", "stage", "outcome", "blocking")).alias("n")).select("run_id", "workflow", F.col("n.stage").alias("stage"), F.coalesce((F.col("n.outcome") == "failed") & F.col("n.blocking"), F.lit(False)).alias("stopped"))


def decision_queue(runs: DataFrame, limit: int) -> DataFrame:
    """What waits for a decision over all runs, oldest first, with its place; the limit is the feature, and left says how many there are in all."""
    waiting = latest(runs).where("outcome = 'waiting'")
    first = waiting.orderBy("ended", "run_id", "stage").limit(limit)
    n = waiting.agg(F.count("*").alias("waiting"))
    return first.withColumn("place", F.row_number().over(Window.orderBy("ended", "run_id", "stage"))).crossJoin(F.broadcast(n)).select("place", "run_id", "stage", "waiting")


def on_circles(edges: list[tuple]) -> list:
    """The nodes that a walk over edges(source, target) leads back to."""
    place = {x: i for i, x in enumerate(dict.fromkeys(x for e in edges for x in e))}
    reach = [0] * len(place)
    for source, target in edges:
        reach[place[source]] |= 1 << place[target]
    for k in range(len(reach)):
        reach = [r | reach[k] if r >> k & 1 else r for r in reach]
    return [x for x, i in place.items() if reach[i] >> i & 1]


def _circles(e: DataFrame) -> DataFrame:
    """workflow and stage of the stages on circles of e(workflow, source, target), a workflow's edges being one row."""
    kind = f"workflow {e.schema['workflow'].dataType.simpleString()}, stage {e.schema['source'].dataType.simpleString()}"
    schema = to_arrow_schema(e.sparkSession.createDataFrame([], kind).schema)

    def run(batches):
        for b in batches:
            lists, workflows, out = b.column(1), b.column(0).to_pylist(), ([], [])
            sources, targets = (lists.flatten().field(i).to_pylist() for i in (0, 1))
            ends = lists.value_lengths().to_pylist()
            at = 0
            for w, n in zip(workflows, ends, strict=True):
                for stage in on_circles(list(zip(sources[at : at + n], targets[at : at + n], strict=True))):
                    out[0].append(w)
                    out[1].append(stage)
                at += n
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(out, schema, strict=True)], schema=schema)

    return e.groupBy("workflow").agg(F.collect_set(F.struct("source", "target")).alias("_e")).mapInArrow(run, kind)


def lint(stages: DataFrame, checks: DataFrame) -> DataFrame:
    """workflow, stage and rule: a required stage that is not defined, one that does not come before, a check that is not registered, and stages that require themselves in a circle. stages also has check; checks(check).

    Only workflows with an edge that does not lead to an earlier place can have a circle. Those of at most
    ``graph.SMALL`` edges are looked at whole, larger ones are walked from each stage by rounds.
    """
    root = graph.scratch(stages)
    need = stages.select("workflow", "stage", "place", F.explode("requires").alias("required"))
    known = stages.select("workflow", F.col("stage").alias("required"), F.col("place").alias("_p"))
    rows = graph._written(need.join(known, ["workflow", "required"], "left"), root, "requires")
    unknown = rows.where("_p is null").select("workflow", "stage", F.lit("unknown-stage").alias("rule"))
    late = rows.where("_p >= place").select("workflow", "stage", F.lit("not-before").alias("rule"))
    unchecked = stages.where("check is not null").join(checks.select("check").distinct(), "check", "left_anti").select("workflow", "stage", F.lit("unknown-check").alias("rule"))
    # a stage is in a circle where a walk from what it requires leads back to it
    e = rows.where("_p is not null").select("workflow", F.col("stage").alias("source"), F.col("required").alias("target"), F.coalesce(F.expr("_p >= place"), F.lit(True)).alias("_back"))
    sizes = graph._written(e.groupBy("workflow").agg(F.count("*").alias("n"), F.bool_or("_back").alias("_back")).where("_back").select("workflow", "n"), root, "sizes")
    e = e.drop("_back")
    back = _circles(e.join(sizes.where(F.col("n") <= graph.SMALL).select("workflow"), "workflow", "left_semi"))
    large = sizes.where(F.col("n") > graph.SMALL).select("workflow")
    if large.limit(1).count():
        back = back.unionAll(_walked_circles(e.join(large, "workflow", "left_semi").distinct()))
    circle = back.select("workflow", "stage", F.lit("circle").alias("rule"))
    return unknown.unionAll(late).unionAll(unchecked).unionAll(circle).distinct()


def _walked_circles(e: DataFrame) -> DataFrame:
    """The same by walks; each start walks the edges of its own workflow."""
    name = lambda stage: F.to_json(F.array(F.col("workflow").cast("string"), F.col(stage).cast("string"))).alias("model_id")
    walk = e.join(e.select("workflow", F.col("source").alias("_start")).distinct(), "workflow").select(name("_start"), F.concat_ws(">", "source", "target").alias("id"), "source", "target")
    begun = e.select(name("source"), F.col("target").alias("state")).distinct()
    back = graph.setup_paths(walk, begun).select("model_id", F.col("state").alias("stage")).distinct()
    return e.select("workflow", F.col("source").alias("stage")).distinct().withColumn("model_id", name("stage")).join(back, ["model_id", "stage"], "left_semi").select("workflow", "stage")


def decisions(audit: DataFrame, roles: DataFrame, allow_self: bool = False) -> DataFrame:
    """Each recorded decision and whether it stands: the reviewer's role has the capability, and it is not of their own proposal. audit(seq, reviewer, capability, proposed_by), roles(reviewer, capabilities)."""
    rows = audit.join(roles, "reviewer", "left")
    able = F.coalesce(F.array_contains("capabilities", F.col("capability")), F.lit(False))
    own = F.coalesce(F.lower("reviewer") == F.lower("proposed_by"), F.lit(False)) & F.lit(not allow_self)
    return rows.select("seq", F.when(~able, "no capability").when(own, "own proposal").otherwise("stands").alias("verdict"))


def capability(role: Column, granted: dict[str, tuple[str, ...]]) -> Column:
    """The capabilities of a role; none for an unknown one."""
    none = F.array().cast("array<string>")
    return F.coalesce(*(F.when(role == r, F.array(*map(F.lit, c)) if c else none) for r, c in granted.items()), none)
