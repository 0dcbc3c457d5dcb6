"""Two surfaces of one behaviour: inherited guards, planned transitions, divergences, existing tests, links and their upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MODEL = "model_id"


def inherited_guards(links: DataFrame, api: DataFrame, confirmed_only: bool = True) -> DataFrame:
    """The guard that each UI transition borrows over its links, of several the lowest API transition's; links(model_id, ui_id, api_id, confirmed), api(model_id, id, guard)."""
    kept = links.where("confirmed") if confirmed_only else links
    rows = kept.join(api.select(MODEL, F.col("id").alias("api_id"), "guard"), [MODEL, "api_id"]).where("trim(guard) <> ''")
    return rows.groupBy(MODEL, F.col("ui_id").alias("id")).agg(F.min_by("guard", "api_id").alias("borrowed"))


def planned(api: DataFrame, wanted: DataFrame, targets: DataFrame) -> DataFrame:
    """One UI transition for each implemented outcome of an API trigger that has a target: id, source, trigger, target, api_id, guard.

    wanted(model_id, ui_source, ui_trigger, api_source, api_trigger, local_guard), targets(model_id, api_id, ui_target).
    The local guard is what the UI checks before any call, so all branches have it alike; the API's own is inherited.
    """
    outcomes = api.where("status = 'implemented'").select(MODEL, F.col("source").alias("api_source"), F.col("trigger").alias("api_trigger"), F.col("id").alias("api_id"))
    rows = wanted.join(outcomes, [MODEL, "api_source", "api_trigger"]).join(targets, [MODEL, "api_id"])
    return rows.select(MODEL, F.concat_ws("::", "ui_source", "ui_trigger", "api_id").alias("id"), F.col("ui_source").alias("source"), F.col("ui_trigger").alias("trigger"), F.col("ui_target").alias("target"), "api_id", F.trim(F.coalesce("local_guard", F.lit(""))).alias("guard"))


def divergences(ui: DataFrame, api: DataFrame, links: DataFrame) -> DataFrame:
    """kind and id: api-only (nothing invokes or starts it), dangling (a link to what is not there), unhandled-outcome (the UI starts its trigger and has no transition for it), restated-guard (the UI's guard has the text of the API's, which it should inherit).

    ui(id, guard), api(id, status, guard), links(ui_id, api_id, kind: invokes or triggers), all of them confirmed.
    A UI transition without a link is no finding.
    """
    known = api.select(F.col("id").alias("api_id"), "status")
    invokes = links.where("kind = 'invokes'").select("ui_id", "api_id").distinct()
    starts = links.where("kind = 'triggers'").select("api_id").distinct()
    linked = invokes.select("api_id").union(starts).distinct()
    open_ = known.where("status = 'implemented'").select("api_id")
    only = open_.join(linked, "api_id", "left_anti").select(F.lit("api-only").alias("kind"), F.col("api_id").alias("id"))
    dangling = links.join(known, "api_id", "left_anti").select(F.lit("dangling").alias("kind"), F.col("api_id").alias("id")).distinct()
    unhandled = open_.join(starts, "api_id", "left_semi").join(invokes.select("api_id").distinct(), "api_id", "left_anti").select(F.lit("unhandled-outcome").alias("kind"), F.col("api_id").alias("id"))
    own, borrowed = F.coalesce("_ui", F.lit("")), F.trim(F.coalesce("_api", F.lit("")))
    both = invokes.join(ui.select(F.col("id").alias("ui_id"), F.col("guard").alias("_ui")), "ui_id").join(api.select(F.col("id").alias("api_id"), F.col("guard").alias("_api")), "api_id")
    restated = both.where((borrowed != "") & F.contains(own, borrowed)).select(F.lit("restated-guard").alias("kind"), F.col("ui_id").alias("id")).distinct()
    return only.unionAll(dangling).unionAll(unhandled).unionAll(restated)


#: A route's transitions are dealt over so many tasks, each with all of the route's tests.
DEALT = 16
#: Transitions and tests of a route that name the same services meet in blocks of so many.
BLOCK = 1_000


def existing_tests(t: DataFrame, tests: DataFrame) -> DataFrame:
    """Tests that reach each transition: by verb and any of its mounted paths, in the same service unless either names none; t(id, verb, paths array, service), tests(test, verb, path, service).

    A pair that shares several routes is kept at the least of them, so pairs, which may be as many as
    transitions times tests, are never shuffled to become distinct. What the pairs of two blocks have in
    common is looked at once, and each transition of a block has the same run of tests, which files keep short.
    """
    routes = t.select("id", F.upper("verb").alias("verb"), F.explode(F.array_distinct("paths")).alias("path"), F.coalesce("service", F.lit("")).alias("_in"))
    have = tests.select("test", F.upper("verb").alias("verb"), "path", F.coalesce("service", F.lit("")).alias("_in"))

    def routed(rows: DataFrame, key: str, services: str, every: str) -> DataFrame:
        one = rows.where("verb is not null and path is not null").groupBy(key, "verb", "path").agg(F.collect_set("_in").alias("_in"))
        all_ = one.groupBy(key).agg(F.collect_list(F.struct("verb", "path", "_in")).alias(every)).select(key, every, F.explode(every).alias("_r"))
        return all_.select(key, "_r.verb", "_r.path", F.col("_r._in").alias(services), F.when(F.size(every) > 1, F.col(every)).alias(every))

    def blocks(rows: DataFrame, key: str, every: str, *same: str) -> DataFrame:
        """Rows that are alike but for the key, in blocks: all of several routes, or all of one."""
        alike = [*same, F.col(every).isNotNull().alias("_several")]
        rows = rows.withColumn("_block", F.floor((F.row_number().over(Window.partitionBy(*alike).orderBy(key)) - 1) / BLOCK))
        return rows.groupBy(*alike, "_block").agg(F.sort_array(F.collect_list(F.struct(key, every))).alias("_rows")).drop("_block", "_several")

    left = routed(routes, "id", "_s", "_routes").withColumns({"_deal": F.pmod(F.xxhash64("id"), F.lit(DEALT)).cast("int"), "_s": F.array_sort("_s")}).repartition("verb", "path", "_deal")
    right = blocks(routed(have, "test", "_o", "_tests").withColumn("_o", F.array_sort("_o")), "test", "_tests", "verb", "path", "_o").select("verb", "path", "_o", F.col("_rows.test").alias("_all"), F.col("_rows._tests").alias("_their")).withColumn("_deal", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))))
    met = lambda x, y: F.array_contains(x, F.lit("")) | F.array_contains(y, F.lit("")) | F.arrays_overlap(x, y)
    place = lambda x: F.struct(x["verb"], x["path"])
    here = F.struct("verb", "path")
    lesser = lambda tests: F.exists("_routes", lambda x: (place(x) < here) & F.exists(tests, lambda y: (place(y) == place(x)) & met(x["_in"], y["_in"])))
    hit = blocks(left, "id", "_routes", "verb", "path", "_deal", "_s").join(right, ["verb", "path", "_deal"]).where(met(F.col("_s"), F.col("_o")))
    hit = hit.select("verb", "path", F.inline("_rows"), "_all", "_their")
    # only what both have several routes can meet at a lesser one
    kept = F.when(F.col("_routes").isNull() | F.get("_their", F.lit(0)).isNull(), F.col("_all")).otherwise(F.filter("_all", lambda _, i: ~lesser(F.get("_their", i))))
    return hit.select("id", kept.alias("_kept")).select("id", F.explode("_kept").alias("test"))


def upsert_links(old: DataFrame, new: DataFrame) -> DataFrame:
    """Links of both runs; one that was confirmed stays so, whatever a later run proposes. Both (ui_id, api_id, confirmed, proposed_by); repeated links count once."""
    both = old.withColumn("_n", F.lit(0)).unionByName(new.withColumn("_n", F.lit(1)))
    return both.groupBy("ui_id", "api_id").agg(F.bool_or("confirmed").alias("confirmed"), F.max_by("proposed_by", F.struct("_n", "proposed_by")).alias("proposed_by"))


def unreachable_surface(nodes: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Nodes that no walk from the model's nodes reaches, edges taken either way; nodes(node), edges(src, dst), seeds(node)."""
    from statewake.operators import graph

    return nodes.select("node").join(graph.connected(seeds, edges), "node", "left_anti")
