"""Captured extraction reports (JSON) as tables of facts; running the extraction itself is not part of this."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statewake.sources.intake import versioned

ANCHOR = "struct<file: string, line: int, commit: string>"
REPORT = f"""repo string,
endpoints array<struct<http_method: string, path: string, handler_method_id: string, handler_type: string, validated: boolean, response_body: string, anchor: {ANCHOR},
  parameters: array<struct<name: string, location: string, type_name: string>>, security: array<struct<scheme: string, expression: string, roles: array<string>>>>>,
checks array<struct<id: string, expression: string, `order`: int, endpoint_id: string>>,
outcomes array<struct<endpoint_id: string, status: int, discriminator: string, guarding_check_ids: array<string>, guard_sense: string>>,
members array<struct<type_name: string, name: string, type_full_name: string, owner_full_name: string, owner_is_enum: boolean, element_type: string, constraints: array<string>>>,
exception_mappings array<struct<exception_type: string, status: int, advice_type: string, response_body: string>>"""
FACTS = ("endpoints", "security", "checks", "outcomes", "members", "mappings")


def extraction_report(spark: SparkSession, path: str, versions: tuple[str, ...] = ("1",), service: str | None = None) -> dict[str, DataFrame]:
    """The facts of reports, one table a kind, as ``operators.synthesis`` and ``operators.evidence`` take them.

    The service is the report's repo. A report of another contract version is an error. With service
    given, only endpoints under that folder and what belongs to them are read. Lists that a report
    lacks are empty. Outcomes keep their place in the report as seq.
    """
    doc = versioned(spark, path, REPORT, "contract_version", versions).where("contract_version is not null")
    doc = doc.withColumn("service", F.coalesce("repo", F.lit("repo")))
    rows = lambda field: doc.select("service", F.posexplode(field).alias("seq", "x"))
    ends = rows("endpoints")
    if service is not None:
        ends = ends.where(F.startswith("x.anchor.file", F.lit(f"{service}/")))
    body = F.get(F.filter("x.parameters", lambda p: p.location == "body"), F.lit(0)).type_name
    ends = ends.withColumn("_b", body)
    found = {
        "endpoints": ends.select("service", F.col("x.handler_method_id").alias("handler"), F.col("x.http_method").alias("verb"), "x.path", "x.handler_type", F.coalesce("x.validated", F.lit(False)).alias("validated"), F.col("_b").alias("body_type"), F.coalesce("x.response_body", F.lit("")).alias("response_body")),
        "security": ends.select("service", F.col("x.handler_method_id").alias("handler"), F.col("x.http_method").alias("verb"), F.explode("x.security").alias("s")).select("service", "handler", "verb", "s.*"),
        "checks": rows("checks").select("service", "x.id", "x.expression", F.col("x.order").alias("place"), "x.endpoint_id"),
        "outcomes": rows("outcomes").select("service", "seq", "x.endpoint_id", "x.status", "x.discriminator", F.coalesce("x.guarding_check_ids", F.array().cast("array<string>")).alias("checks"), F.coalesce("x.guard_sense", F.lit("")).alias("sense")),
        "members": rows("members").select("service", "x.type_name", "x.name", F.coalesce("x.constraints", F.array().cast("array<string>")).alias("constraints"), F.coalesce("x.owner_full_name", "x.type_name").alias("owner"), F.coalesce("x.owner_is_enum", F.lit(False)).alias("owner_is_enum"), F.col("x.type_full_name").alias("type"), "x.element_type"),
        "mappings": rows("exception_mappings").select("service", F.col("x.exception_type").alias("exception"), "x.status", F.col("x.advice_type").alias("advice"), F.coalesce("x.response_body", F.lit("")).alias("response_body")),
    }
    if service is not None:
        mine = found["endpoints"].select("service", F.concat_ws("::", "handler", "verb").alias("endpoint_id")).distinct()
        for name in ("checks", "outcomes"):
            found[name] = found[name].join(mine, ["service", "endpoint_id"], "left_semi")
    return found
