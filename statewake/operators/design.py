"""Test design: decision rows, dimension cost, detectability, verdicts."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statewake.operators import guards


def decision_rows(members: DataFrame, keys: list[str], guard: str, ordinal: str, most_atoms: int = 6) -> DataFrame:
    """Every assignment of a group's atoms with the first member (by ordinal) whose guard holds; bit i of row is the i-th atom in order.

    A group that cannot be tabulated (one member, an OR, no guard, a threshold, too many atoms) has one row with the reason.
    """
    per = members.select(*keys, ordinal, guards.literals(F.col(guard)).alias("lits")).groupBy(*keys, "lits").agg(F.min(ordinal).alias("ordinal"), F.count("*").alias("n"))
    g = per.groupBy(*keys).agg(F.sum("n").alias("_n"), F.bool_or(F.col("lits").isNull()).alias("_open"), F.collect_list(F.when(F.col("lits").isNotNull(), F.struct("ordinal", "lits"))).alias("_m"))
    clauses = F.transform("_m", lambda m: m.lits)
    g = g.select(*keys, "_m", guards.atom_names(clauses).alias("_atoms"), F.when(F.col("_n") < 2, "one member").otherwise(guards.undecided(clauses, F.col("_open"), most_atoms)).alias("reason"))
    rows = g.withColumn("row", F.explode(F.when(F.col("reason").isNull(), F.expr("sequence(0, shiftleft(1, size(_atoms)) - 1)")).otherwise(F.array(F.lit(None).cast("int")))))
    holding = F.expr("filter(_m, m -> forall(m.lits, x -> ((shiftright(row, cast(array_position(_atoms, x.atom) as int) - 1) & 1) = 1) <> x.negated))")
    return rows.select(*keys, "row", F.array_min(F.transform(holding, lambda m: m.ordinal)).alias("covering"), "reason")


def dimension_cost(dims: DataFrame, key: str, n: str) -> DataFrame:
    """Bounded cost (one varied at a time) and product of each key's dimensions, which is a double since it outgrows integers; fewer than two levels count as two."""
    levels = F.greatest(F.col(n), F.lit(2)).cast("long")
    return dims.withColumn("_n", levels).groupBy(key).agg((F.sum(F.col("_n") - 1) + 1).alias("bounded"), F.product(F.col("_n").cast("double")).alias("product"))


def detectability(rows: DataFrame, key: str) -> DataFrame:
    """Best (lowest) of 1 caught, 2 tested but unobserved, 3 indirect only, 4 without oracle, 5 unnoticed over rows(key, mechanism, oracle, outcome), and whether any run failed."""
    floor = F.when(F.col("outcome").isin("passed", "failed"), 1).when((F.col("mechanism") == "direct") & F.col("oracle"), 2).when(F.col("mechanism") == "indirect", 3).when(F.col("mechanism") == "direct", 4).otherwise(5)
    return rows.groupBy(key).agg(F.min(floor).alias("detection"), F.bool_or(F.coalesce(F.col("outcome") == "failed", F.lit(False))).alias("failing"))


def confidence(measurable: Column, runs: Column, stale: Column) -> Column:
    return F.when(~measurable, "unknown").when(runs == 0, "estimated").when(stale | (runs == 1), "inferred").otherwise("confirmed")


def permitted(conf: Column) -> Column:
    """The recommendations that a confidence permits."""
    return F.when(conf.isin("confirmed", "inferred"), "Go,Conditional,No-Go").when(conf == "estimated", "Conditional,No-Go").otherwise("No-Go")


# fixed values: the responses to risks of either polarity, statuses and origins of a register
THREAT_RESPONSES = ("Avoid", "Mitigate", "Transfer", "Accept", "Escalate")
OPPORTUNITY_RESPONSES = ("Exploit", "Enhance", "Share", "Accept", "Escalate")
STATUSES, DERIVATIONS = ("Open", "Closed"), ("authored", "model")


def register_lint(register: DataFrame, categories: tuple[str, ...] = ()) -> DataFrame:
    """One row for each rule that a register row breaks. Columns that the register lacks count as null; repeated ids are one finding each.

    register(id, description, category, owner, polarity, probability, impact, score, response, status, derived_from, derived_by).
    Words are compared in any case; a score that is not stated is not stale; no polarity means a threat.
    """
    col = lambda c: F.col(c) if c in register.columns else F.lit(None).cast("string")
    blank = lambda c: F.trim(F.coalesce(col(c).cast("string"), F.lit(""))) == ""
    fold = lambda c, default="": F.lower(F.trim(F.coalesce(col(c), F.lit(default))))
    low = lambda names: [n.lower() for n in names]
    p, i, polarity = col("probability").cast("int"), col("impact").cast("int"), fold("polarity", "threat")
    both, scaled = p.isNotNull() & i.isNotNull(), p.between(1, 5) & i.between(1, 5)
    response, derived = fold("response"), F.coalesce(col("derived_from"), F.lit("authored"))
    known = response.isin(low(THREAT_RESPONSES + OPPORTUNITY_RESPONSES))
    allowed = F.when(polarity == "opportunity", response.isin(low(OPPORTUNITY_RESPONSES))).otherwise(response.isin(low(THREAT_RESPONSES)))
    rules = [(blank(c), f"no-{c}") for c in ("description", "category", "owner") if c in register.columns]
    if categories:
        rules.append((~blank("category") & ~fold("category").isin(low(categories)), "category"))
    rules += [
        (~polarity.isin("threat", "opportunity"), "polarity"), (both & ~scaled, "scale"), (both & scaled & col("score").isNotNull() & (col("score").cast("int") != p * i), "score-stale"),
        (known & ~allowed, "response-polarity"), (~fold("status", "open").isin(low(STATUSES)), "status"), (~derived.isin(list(DERIVATIONS)), "derivation"), ((derived == "model") & blank("derived_by"), "derivation-source"),
    ]
    found = register.select("id", F.explode(F.array_compact(F.array(*(F.when(c, n) for c, n in rules)))).alias("rule"))
    repeated = register.where(~blank("id")).groupBy("id").count().where("count > 1").select("id", F.lit("duplicate-id").alias("rule"))
    return found.unionAll(repeated)


# fixed values: subjects of repairs, and of repairs that are not the product's
FIX = r"(?i)^\s*fix(\([^)]*\))?!?:|\b(?:fix(?:e[sd])?|bugfix|hotfix|repair(?:ed)?)\b|^\s*revert\b"
NO_PRODUCT_FIX = r"(?i)\bfix(?:e[sd])?\s+(?:typo|typos|lint|linting|formatting|whitespace|indentation|spelling|comment|comments|test\s+name|import|imports)\b"


def repaired_files(commits: DataFrame, since: str, until: str) -> DataFrame:
    """Distinct fixing commits for each file in (since, until]; commits(sha, subject, ts, files)."""
    fix = F.col("subject").rlike(FIX) & ~F.col("subject").rlike(NO_PRODUCT_FIX)
    window = (F.col("ts") > F.lit(since).cast("timestamp")) & (F.col("ts") <= F.lit(until).cast("timestamp"))
    return commits.where(fix & window).select("sha", F.explode("files").alias("file")).groupBy("file").agg(F.count_distinct("sha").alias("repairs"))


def illegal_edges(edges: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Edges whose (src_label, rel_type, dst_label) the closed catalogue does not have."""
    return edges.join(catalogue, ["src_label", "rel_type", "dst_label"], "left_anti")


def batches(rows: DataFrame, size: int) -> Iterator[list]:
    """Rows in driver-side batches, for writers that take so many at a time."""
    held: list = []
    for r in rows.toLocalIterator():
        held.append(r)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held
