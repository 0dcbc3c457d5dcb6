"""Readers of model files, question sets, Markdown tables, criteria, feature files, OpenAPI documents and trackers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MODEL = "id string, states array<struct<id: string, name: string, surface: string, is_initial: boolean>>, transitions array<struct<id: string, source: string, trigger: string, target: string, guard: string, implementation_status: string>>"
QUARANTINE = "Quarantine"


def model_file(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """states, transitions and rejects of model files. All land at Quarantine; a transition with an unknown end is rejected with the reason."""
    models = spark.read.schema(MODEL).json(path, multiLine=True).withColumnRenamed("id", "model_id")
    states = models.select("model_id", F.explode("states").alias("s")).select("model_id", "s.*").withColumn("lifecycle_state", F.lit(QUARANTINE))
    moves = models.select("model_id", F.explode("transitions").alias("t")).select("model_id", "t.*").withColumn("implementation_status", F.coalesce("implementation_status", F.lit("implemented"))).withColumn("lifecycle_state", F.lit(QUARANTINE))
    known = states.select("model_id", F.col("id").alias("state"), F.lit(True).alias("known"))
    for end in ("source", "target"):
        moves = moves.join(known.withColumnsRenamed({"state": end, "known": f"_{end}"}), ["model_id", end], "left")
    reason = F.when(F.col("_source").isNull(), F.concat(F.lit("source state "), "source", F.lit(" is not in this model"))).when(F.col("_target").isNull(), F.concat(F.lit("target state "), "target", F.lit(" is not in this model")))
    moves = moves.withColumn("reason", reason).drop("_source", "_target")
    return states, moves.where("reason is null").drop("reason"), moves.where("reason is not null")


def questions(spark: SparkSession, path: str) -> DataFrame:
    """question and expected id of a tab-separated file with # comments; a line of another form is an error."""
    lines = spark.read.text(path).where("trim(value) <> '' and not startswith(ltrim(value), '#')").select(F.split("value", "\t").alias("p"))
    bad = F.raise_error(F.concat(F.lit("not question<TAB>id: "), F.array_join("p", "\t")))
    return lines.select(F.when((F.size("p") == 2) & (F.trim(F.get("p", F.lit(1))) != ""), F.col("p")).otherwise(F.array(bad)).alias("p")).select(F.trim(F.col("p")[0]).alias("question"), F.trim(F.col("p")[1]).alias("expected_id"))


def markdown_table(spark: SparkSession, path: str, heading: str, columns: list[str], id_pattern: str = r"^[A-Z]+-\d+$") -> tuple[DataFrame, DataFrame]:
    """Rows of the first table under a heading, and the rows whose id cannot be read."""
    text = spark.read.text(path, wholetext=True)
    body = F.regexp_extract("value", rf"(?ms)^#+ {re.escape(heading)}\s*$(.*?)(?=^#|\z)", 1)
    lines = text.select(F.explode(F.split(body, "\n")).alias("line")).where(r"line rlike '^\\s*\\|' and not line rlike '^[\\s|:-]+$'")
    cells = F.transform(F.split(F.regexp_replace(F.trim("line"), r"^\||\|$", ""), r"(?<!\\)\|"), lambda c: F.trim(F.replace(c, F.lit("\\|"), F.lit("|"))))
    rows = lines.select(cells.alias("c"), "line").where(F.lower(F.get("c", F.lit(0))) != columns[0].lower())
    good = F.get("c", F.lit(0)).rlike(id_pattern) & (F.size("c") == len(columns))
    return rows.where(good).select(*(F.get("c", F.lit(i)).alias(n) for i, n in enumerate(columns))), rows.where(~good).select("line")


def acceptance_criteria(spark: SparkSession, path: str) -> DataFrame:
    """file, number and text of the ``### AC-n:`` blocks of specifications, in order."""
    parts = F.regexp_extract_all(F.col("value"), F.lit(r"(?ms)^### (AC-\d+:.*?)(?=^#{1,3} |\z)"), F.lit(1))
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(parts).alias("pos", "block"))
    return rows.select("file", "pos", F.regexp_extract("block", r"^AC-(\d+):", 1).cast("int").alias("number"), F.trim(F.regexp_replace(F.regexp_replace("block", r"^AC-\d+:", ""), r"\s+", " ")).alias("text"))


def passages(spark: SparkSession, path: str) -> DataFrame:
    """file, position and text of the ## sections of Markdown documents; a heading stays with its body."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", r"(?m)^(?=## )")).alias("pos", "text")).where("trim(text) <> ''")


def feature_steps(spark: SparkSession, path: str) -> DataFrame:
    """file, scenario and steps (keyword, text) of feature files, in order."""
    scenario = F.regexp_extract_all(F.col("value"), F.lit(r"(?ms)^\s*Scenario:(.*?)(?=^\s*Scenario:|\z)"), F.lit(1))
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(scenario).alias("scenario_no", "body"))
    lines = rows.select("file", "scenario_no", F.trim(F.split("body", "\n")[0]).alias("scenario"), F.posexplode(F.split("body", "\n")).alias("line_no", "line"))
    step = r"^\s*(Given|When|Then|And|But)\s+(.*\S)\s*$"
    return lines.where(F.col("line").rlike(step)).select("file", "scenario_no", "scenario", "line_no", F.regexp_extract("line", step, 1).alias("keyword"), F.regexp_extract("line", step, 2).alias("text"))


OPERATION = "map<string, map<string, struct<operationId: string, summary: string, responses: map<string, struct<description: string>>, parameters: array<struct<name: string, `in`: string, required: boolean>>>>>"


def openapi_endpoints(spark: SparkSession, path: str) -> DataFrame:
    """verb, route, operation, parameters and status codes of OpenAPI documents."""
    paths = spark.read.schema(f"paths {OPERATION}").json(path, multiLine=True).select(F.explode("paths").alias("route", "verbs")).select("route", F.explode("verbs").alias("verb", "op"))
    return paths.where("verb in ('get', 'put', 'post', 'patch', 'delete', 'head', 'options')").select(F.upper("verb").alias("verb"), "route", F.col("op.operationId").alias("operation"), F.col("op.parameters").alias("parameters"), F.array_sort(F.map_keys("op.responses")).alias("statuses"))


# fixed values: spellings of a tracker's priorities
PRIORITY = {"blocker": "critical", "highest": "critical", "critical": "critical", "high": "high", "major": "high", "medium": "medium", "normal": "medium", "low": "low", "minor": "low", "lowest": "low", "trivial": "low"}


def normal_priority(raw: Column) -> Column:
    """The priority's own word; null where it is unknown or missing (see unmapped)."""
    return F.create_map(*(F.lit(x) for kv in PRIORITY.items() for x in kv))[F.lower(F.trim(raw))]


def unmapped(raw: Column, field: str = "priority") -> Column:
    """Why a field's value was left out; null where it was not."""
    return F.when(F.trim(F.coalesce(raw, F.lit(""))) == "", F.lit(f"no {field}")).when(normal_priority(raw).isNull(), F.concat(F.lit(f"{field} '"), F.trim(raw), F.lit("' has no mapping")))


def plain_text(markup: Column) -> Column:
    """Text of simple markup: breaks and block ends become spaces, other tags go, common references are decoded."""
    text = F.regexp_replace(F.regexp_replace(markup, r"(?i)<br\s*/?>|</(p|div|li|h\d|tr)>", " "), r"<[^>]*>", "")
    for ref, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        text = F.replace(text, F.lit(ref), F.lit(char))
    return F.trim(F.regexp_replace(text, r"\s+", " "))
