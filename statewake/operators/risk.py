"""Risk order, residual, exit criteria, change findings, candidates and completeness of inputs. What was not measured stays apart and is never zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Detection of what nothing would notice (see design.detectability), and bands that need attention.
UNNOTICED, ATTENTION = 5, ("High", "Very High")
SEVERITIES = ("critical", "major", "minor", "question")


def by_severity(severity: Column) -> Column:
    """The place of a severity in the fixed order; unknown ones come last."""
    place = F.array_position(F.array(*map(F.lit, SEVERITIES)), severity)
    return F.when(place > 0, place).otherwise(len(SEVERITIES) + 1).cast("int")


def order(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rank within each model: what is noticed least comes first, then the higher technical score, then the lower id; rows(by..., id, detection, technical)."""
    w = Window.partitionBy(*by).orderBy(F.desc("detection"), F.desc(F.coalesce("technical", F.lit(0))), "id")
    return rows.withColumn("rank", F.row_number().over(w))


def residual(rows: DataFrame, by: list[str]) -> DataFrame:
    """What is left to do: unnoticed rows of an attention band need a test, failing ones a fix; a row can be both. rows(by..., id, detection, band, failing)."""
    needs = F.array_compact(F.array(F.when((F.col("detection") == UNNOTICED) & F.col("band").isin(*ATTENTION), "unnoticed"), F.when(F.col("failing"), "failing")))
    return rows.select(*by, "id", "band", F.explode(needs).alias("part"))


def exit_criteria(left: DataFrame, models: DataFrame, by: list[str], limits: dict[str, int] | None = None) -> DataFrame:
    """For each model the counts of unnoticed and failing rows, and whether they are within the limits; null where no limit is set, since nothing can decide then."""
    counts = left.groupBy(*by).agg(*(F.count_if(F.col("part") == p).alias(p) for p in ("unnoticed", "failing")))
    rows = models.select(*by).distinct().join(counts, by, "left").na.fill(0, ["unnoticed", "failing"])
    if not limits:
        return rows.withColumn("within", F.lit(None).cast("boolean"))
    within = F.lit(True)
    for part, most in limits.items():
        within = within & (F.col(part) <= most)
    return rows.withColumn("within", within)


def depth_gaps(warranted: DataFrame, achievable: DataFrame) -> DataFrame:
    """Ids of a high band that the model can only test in part; warranted(id, band), achievable(id, verdict)."""
    return warranted.where(F.col("band").isin(*ATTENTION)).join(achievable.where("verdict in ('partial', 'positive-only')"), "id").select("id", "band", "verdict")


def change_findings(impacted: DataFrame, criteria: DataFrame, depth: DataFrame, files: DataFrame) -> DataFrame:
    """Findings on a change, with the place of their severity: subject, severity, what.

    impacted(id); criteria(id, provenance), any number a transition; depth(id, verdict); files(file) that
    matched no behaviour. A transition without criteria is critical and nothing more is said of it.
    """
    grades = criteria.groupBy("id").agg(F.bool_and(F.col("provenance") == "code_derived").alias("_only"))
    rows = impacted.select("id").distinct().join(grades.withColumn("_has", F.lit(True)), "id", "left").join(depth.select("id", "verdict"), "id", "left")
    made = lambda s, w: F.struct(F.lit(s).alias("severity"), F.lit(w).alias("what"))
    found = F.when(F.col("_has").isNull(), F.array(made("critical", "nothing validates it"))).otherwise(F.array_compact(F.array(F.when(F.coalesce("_only", F.lit(False)), made("minor", "criteria from the code alone")), F.when(F.col("verdict") == "positive-only", made("major", "the positive path alone")))))
    rows = rows.select(F.col("id").cast("string").alias("subject"), F.explode(found).alias("f")).select("subject", "f.*")
    rows = rows.unionAll(files.select(F.col("file").cast("string"), F.lit("question"), F.lit("no behaviour matches the file")))
    return rows.withColumn("place", by_severity(F.col("severity")))


def candidates(findings: DataFrame, unmeasured: DataFrame) -> DataFrame:
    """Register candidates, from the model and without a probability: change findings but questions, and what was not measured (id)."""
    a = findings.where("severity <> 'question'").select(F.col("subject").alias("id"), F.concat_ws(": ", "severity", "what").alias("description"), F.lit("change-review").alias("derived_by"))
    b = unmeasured.select(F.col("id").cast("string"), F.lit("not measured").alias("description"), F.lit("unmeasured").alias("derived_by"))
    return a.unionAll(b).withColumn("derived_from", F.lit("model"))


def completeness(asked: DataFrame, gathered: DataFrame, answers: DataFrame) -> DataFrame:
    """Every input asked for, and where it stands: gathered, answered, missing (required) or open; asked(section, name, required), the others (section, name)."""
    has = lambda df, c: df.select("section", "name").distinct().withColumn(c, F.lit(True))
    rows = asked.join(has(gathered, "_g"), ["section", "name"], "left").join(has(answers, "_a"), ["section", "name"], "left")
    state = F.when(F.col("_g"), "gathered").when(F.col("_a"), "answered").when(F.col("required"), "missing").otherwise("open")
    return rows.select("section", "name", state.alias("state"))


def readiness(gaps: DataFrame, subjects: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """For each subject its gaps of each kind, and whether none is left; gaps(subject, kind, n), where a null n says that the kind was not looked at."""
    by = gaps.groupBy("subject").agg(*(F.sum(F.when(F.col("kind") == k, F.coalesce("n", F.lit(0)))).alias(k) for k in kinds), F.bool_or(F.col("n").isNull()).alias("_unknown"))
    rows = subjects.select("subject").distinct().join(by, "subject", "left")
    all_known = F.lit(True)
    for k in kinds:
        all_known = all_known & F.col(k).isNotNull()
    none = F.lit(True)
    for k in kinds:
        none = none & (F.col(k) == 0)
    return rows.select("subject", *kinds, F.when(all_known & ~F.coalesce("_unknown", F.lit(True)), none).alias("ready"))
