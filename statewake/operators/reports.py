"""Read tools over models, cases and evidence as DataFrames: coverage reports, traces, verdicts, metrics, densities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MODEL = "model_id"


def available(elements: DataFrame) -> DataFrame:
    """Distinct (journey, surface) that some element stands in; elements(areas array, surface)."""
    return elements.select(F.explode("areas").alias("journey"), "surface").where("journey is not null and surface is not null").distinct()


def coverage_report(summary: DataFrame, gate: DataFrame, gaps: DataFrame, unmeasured: DataFrame) -> DataFrame:
    """One row a model: its ledger summary, findings, reconciliation gaps, what was not measured, and the verdict.

    summary(model_id, total, covered, uncovered), gate(model_id, blocking, unverifiable), gaps(model_id, gaps),
    unmeasured(model_id, item). The verdict is capped in this order: blocked (a blocking finding), unmeasured,
    unverifiable, incomplete, complete; coverage alone never says that behaviour is right.
    """
    items = unmeasured.groupBy(MODEL).agg(F.array_join(F.array_sort(F.collect_set("item")), ",").alias("unmeasured"))
    rows = summary.join(gate.select(MODEL, "blocking", "unverifiable"), MODEL, "left").join(gaps.select(MODEL, "gaps"), MODEL, "left").join(items, MODEL, "left")
    rows = rows.na.fill(0, ["blocking", "unverifiable", "gaps"]).na.fill("", ["unmeasured"])
    verdict = F.when(F.col("blocking") > 0, "blocked").when(F.col("unmeasured") != "", "unmeasured").when(F.col("unverifiable") > 0, "unverifiable").when((F.col("uncovered") > 0) | (F.col("gaps") > 0), "incomplete").otherwise("complete")
    return rows.select(MODEL, "total", "covered", "uncovered", "blocking", "unverifiable", "gaps", "unmeasured", verdict.alias("verdict"))


def trace(cases: DataFrame, hops: list[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """Each case with what it leads to, hop by hop, and the first hop that is broken.

    hops: (name, table, key it is met by, column it leads to). A hop of several rows takes the lowest; the
    predicate of a hop belongs into its table, so that a case is never lost by it. cases(case_id, at).
    """
    rows, broken = cases.select("case_id", F.col("at").alias("_at")), F.lit("")
    for name, table, key, to in hops:
        step = table.groupBy(F.col(key).alias("_at")).agg(F.min(to).alias(name))
        rows = rows.join(step, "_at", "left").withColumn("_at", F.col(name))
    broken = F.coalesce(*(F.when(F.col(name).isNull(), name) for name, *_ in hops), F.lit(""))
    return rows.select("case_id", *(name for name, *_ in hops), broken.alias("broken"))


def fidelity(grades: DataFrame, splits: DataFrame) -> DataFrame:
    """What to do with each graded transition: a requested split comes first, then its grade decides; grades(model_id, id, grade), splits(model_id, id, reason)."""
    rows = grades.join(splits.groupBy(MODEL, "id").agg(F.min("reason").alias("reason")), [MODEL, "id"], "left")
    verdict = F.when(F.col("reason").isNotNull(), "split-requested").when(F.col("grade") == "covered", "continue-as-is").when(F.col("grade") == "endpoint-only", "improvement-needed").otherwise("generate")
    return rows.select(MODEL, "id", verdict.alias("verdict"))


def gap_report(grades: DataFrame) -> DataFrame:
    """For each model how many transitions existing tests cover, reach alone, or leave to be generated."""
    count = lambda g: F.count_if(F.col("grade") == g)
    return grades.groupBy(MODEL).agg(F.count("*").alias("transitions"), count("covered").alias("covered"), count("endpoint-only").alias("reached"), count("uncovered").alias("to_generate"))


def viability(t: DataFrame) -> DataFrame:
    """Whether a transition's test can be automated: the first rule that holds. t(model_id, id, trigger, n_inputs, unverifiable, source_unresolved, anchored)."""
    verb, api = F.split_part("trigger", F.lit(" "), F.lit(1)), F.col("trigger").rlike(r"^[A-Z]+ \S")
    verdict = (
        F.when(F.col("unverifiable"), "defer").when(F.col("source_unresolved"), "manual-only").when(~F.col("anchored"), "manual-only")
        .when(api & (F.coalesce("n_inputs", F.lit(0)) == 0) & ~verb.isin("GET", "DELETE"), "defer").when(~api, "manual-only").otherwise("automate")
    )
    return t.select(MODEL, "id", verdict.alias("verdict"))


# fixed values: names and types of inputs whose size a call's cost may follow
PAGING = ("page", "size", "limit", "offset", "cursor", "per_page", "pagesize", "top", "skip", "count", "max")
BULK = ("list", "array", "collection", "[]", "set<", "iterable")


def performance(inputs: DataFrame, transitions: DataFrame, viable: DataFrame | None = None) -> DataFrame:
    """candidate where an input is a paging parameter or a collection, else functional-only; a model without any such input gives no basis for either.

    inputs(model_id, id, name, type_name), transitions(model_id, id). With the verdicts of ``viability`` only
    what can be automated is considered, for the basis too.
    """
    if viable is not None:
        transitions = transitions.join(viable.where("verdict = 'automate'").select(MODEL, "id"), [MODEL, "id"], "left_semi")
    name, kind = F.lower(F.coalesce("name", F.lit(""))), F.lower(F.coalesce("type_name", F.lit("")))
    any_of = lambda tests: F.greatest(*tests)
    signal = any_of([name.endswith(p) for p in PAGING] + [kind.contains(b) for b in BULK])
    found = inputs.groupBy(MODEL, "id").agg(F.bool_or(signal).alias("_s"))
    rows = transitions.select(MODEL, "id").join(found, [MODEL, "id"], "left").withColumn("_s", F.coalesce("_s", F.lit(False)))
    some = rows.groupBy(MODEL).agg(F.bool_or("_s").alias("_any"))
    return rows.join(some, MODEL).select(MODEL, "id", F.when(~F.col("_any"), "no-basis").when(F.col("_s"), "candidate").otherwise("functional-only").alias("verdict"))


def depth(shallow: DataFrame, guard: DataFrame, t: DataFrame, boundary: DataFrame | None = None) -> DataFrame:
    """How deep the generated cases of each transition go: partial (a target of it, or a boundary, has none), positive-only (a guard with one branch), full. shallow, guard and boundary: generated paths (see generate.paths)."""
    done = shallow.where("outcome = 'generated'").select(MODEL, F.col("validates").alias("id")).distinct()
    per = guard.where("validates is not null").groupBy(MODEL, F.col("validates").alias("id")).agg(F.count_if(F.col("outcome") == "generated").alias("branches"), F.count_if(F.col("outcome") != "generated").alias("gaps"))
    rows = done.join(t.select(MODEL, "id", F.coalesce("guard", F.lit("")).alias("guard")), [MODEL, "id"]).join(per, [MODEL, "id"], "left").na.fill(0, ["branches", "gaps"])
    if boundary is not None:
        missed = boundary.where("validates is not null and outcome <> 'generated'").groupBy(MODEL, F.col("validates").alias("id")).agg(F.count("*").alias("_b"))
        rows = rows.join(missed, [MODEL, "id"], "left").withColumn("gaps", F.col("gaps") + F.coalesce("_b", F.lit(0)))
    return rows.select(MODEL, "id", "branches", F.when(F.col("gaps") > 0, "partial").when((F.col("guard") != "") & (F.col("branches") < 2), "positive-only").otherwise("full").alias("verdict"))


def verdict_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("verdict").agg(F.count("*").alias("n"))


def override_density(elements: DataFrame, log: DataFrame, classes: tuple[str, ...]) -> DataFrame:
    """Overridden elements that are still there, of all, in one row, and by classification; elements(element_id), log(element_id, classification)."""
    there = log.join(elements.select("element_id").distinct(), "element_id", "left_semi")
    n = F.broadcast(elements.agg(F.count_distinct("element_id").alias("total")))
    return there.agg(F.count_distinct("element_id").alias("overridden"), *(F.count_distinct(F.when(F.col("classification") == c, F.col("element_id"))).alias(c) for c in classes)).crossJoin(n)


def type_metrics(types: DataFrame, methods: DataFrame) -> DataFrame:
    """For each type the largest and summed complexity, summed size and count of its measured methods; where none was measured they stay null. types(owner), methods(owner, complexity, size)."""
    measured = methods.where("complexity > 0").groupBy("owner").agg(F.max("complexity").alias("max_complexity"), F.sum("complexity").alias("sum_complexity"), F.sum("size").alias("sum_size"), F.count("*").alias("methods"))
    return types.select("owner").distinct().join(measured, "owner", "left")


def chain_problems(checks: DataFrame) -> DataFrame:
    """Chains whose checks share an evaluation order, which nothing else decides: endpoint, place, ids; checks(endpoint, id, place)."""
    g = checks.groupBy("endpoint", "place").agg(F.array_join(F.array_sort(F.collect_set(F.col("id").cast("string"))), ",").alias("ids"), F.count_distinct("id").alias("_n"))
    return g.where("_n > 1").select("endpoint", "place", "ids")


def variation_scope(checks: DataFrame) -> DataFrame:
    """For each check of a chain that is in order what is held before it and what is not varied after it: endpoint, id, held, not_varied (joined ids)."""
    bad = chain_problems(checks).select("endpoint").distinct()
    ordered = checks.join(bad, "endpoint", "left_anti").groupBy("endpoint").agg(F.array_sort(F.collect_set(F.struct("place", F.col("id").cast("string").alias("id")))).alias("_c"))
    rows = ordered.select("endpoint", F.col("_c.id").alias("_ids"), F.posexplode("_c").alias("_k", "_x"))
    join = lambda a: F.array_join(a, ",")
    return rows.select("endpoint", F.col("_x.id").alias("id"), join(F.slice("_ids", 1, F.col("_k"))).alias("held"), join(F.slice("_ids", F.col("_k") + 2, F.size("_ids"))).alias("not_varied"))


def dimension_class(expression: Column, classes: list[tuple[str, tuple[str, ...]]]) -> Column:
    """The first class, in the order declared, one of whose words stands in the expression's letters and digits; null for none."""
    low = F.regexp_replace(F.lower(F.coalesce(expression, F.lit(""))), "[^a-z0-9]", "")
    return F.coalesce(*(F.when(F.greatest(*(low.contains(w) for w in words)) if len(words) > 1 else low.contains(words[0]), name) for name, words in classes), F.lit(None).cast("string"))


def consumers(rows: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """How many elements have a consumer of each kind, and none at all; rows(id, consumers array)."""
    tagged = rows.select("id", F.explode(F.when(F.size(F.array_intersect("consumers", F.array(*map(F.lit, kinds)))) > 0, F.array_intersect("consumers", F.array(*map(F.lit, kinds)))).otherwise(F.array(F.lit("none")))).alias("kind"))
    return tagged.groupBy("kind").agg(F.count_distinct("id").alias("n"))


def walkthrough(t: DataFrame) -> DataFrame:
    """A model state by state: how many moves leave it, how many of these fail (status of 400 or more), and where they lead."""
    return t.groupBy(MODEL, F.col("source").alias("state")).agg(F.count("*").alias("moves"), F.count_if(F.coalesce(F.col("outcome_status") >= 400, F.lit(False))).alias("failures"), F.array_join(F.array_sort(F.collect_set("target")), ",").alias("leads_to"))


def hierarchy(items: DataFrame) -> DataFrame:
    """Each anchor with its parent and children, both kept apart by relation; items(id, parent, relation)."""
    down = items.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(":", "relation", F.col("id").cast("string")))), ",").alias("children"))
    rows = items.select("id", F.when(F.col("parent").isNotNull(), F.concat_ws(":", "relation", F.col("parent").cast("string"))).alias("above"))
    return rows.join(down, "id", "left").select("id", "above", F.coalesce("children", F.lit("")).alias("children"))


def payload(types: DataFrame, root: DataFrame, depth: int = 3) -> DataFrame:
    """The members of a type and of the types of its members, by dotted path, to a depth that is the feature; types(type_id, field, of_type), root(type_id)."""
    rows = found = root.join(types, "type_id").select(F.col("type_id").alias("root"), F.col("field").alias("path"), "of_type")
    for _ in range(depth - 1):
        rows = rows.join(types.select(F.col("type_id").alias("of_type"), "field", F.col("of_type").alias("_next")), "of_type").select("root", F.concat_ws(".", "path", "field").alias("path"), F.col("_next").alias("of_type"))
        found = found.unionAll(rows)
    return found


def call_recipes(endpoints: DataFrame, fields: DataFrame, outcomes: DataFrame, security: DataFrame) -> DataFrame:
    """One row an endpoint with its fields, outcomes and security, each gathered before it is joined; the others are (endpoint, name)."""
    rows = endpoints.select("endpoint", "verb", "route")
    for name, part in (("fields", fields), ("outcomes", outcomes), ("security", security)):
        rows = rows.join(part.groupBy("endpoint").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias(name)), "endpoint", "left")
    return rows.na.fill("", ["fields", "outcomes", "security"])


def predecessor(claims: DataFrame, key: str) -> DataFrame:
    """For each current claim the one of its key that was closed last; claims(key, text, valid_from, valid_to)."""
    closed = claims.where("valid_to is not null").groupBy(key).agg(F.max_by("text", F.struct("valid_to", "valid_from", "text")).alias("before"))
    return claims.where("valid_to is null").select(key, "text").join(closed, key, "left")


def rolled_up(hits: DataFrame, parents: DataFrame, k: int, factor: int = 3) -> DataFrame:
    """The k best parents of each query, from the best k * factor passages: a parent has the rank of its best passage. hits(q, passage, score), parents(passage, parent)."""
    first = hits.withColumn("_r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "passage"))).where(F.col("_r") <= k * factor)
    best = first.join(parents, "passage").groupBy("q", "parent").agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "parent"))).where(F.col("rank") <= k)
