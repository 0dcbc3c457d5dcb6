"""Snapshots, Markdown rows and feature files."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def export_snapshot(nodes: DataFrame, edges: DataFrame, path: str, *, commit: str = "") -> None:
    """nodes by label, edges by type, and last a manifest with counts and schema hashes."""
    nodes.write.partitionBy("label").parquet(f"{path}/nodes")
    edges.write.partitionBy("rel_type").parquet(f"{path}/edges")
    spark = nodes.sparkSession
    rows = [(name, json.dumps(back.schema.jsonValue(), sort_keys=True), back.count()) for name, back in ((n, spark.read.parquet(f"{path}/{n}")) for n in ("nodes", "edges"))]
    spark.createDataFrame(rows, "name string, kind string, n long").withColumn("commit", F.lit(commit)).withColumn("kind_sha256", F.sha2("kind", 256)).coalesce(1).write.json(f"{path}/manifest")


def restore_snapshot(spark: SparkSession, path: str, *, commit: str | None = None) -> tuple[DataFrame, DataFrame]:
    """nodes and edges of a snapshot whose counts and schemas are those of its manifest; another is refused."""
    found = {}
    for r in spark.read.json(f"{path}/manifest").collect():
        df = spark.read.parquet(f"{path}/{r['name']}")
        if json.dumps(df.schema.jsonValue(), sort_keys=True) != r["kind"] or df.count() != r["n"]:
            raise ValueError(f"{r['name']} is not what the manifest says")
        if commit is not None and r["commit"] != commit:
            raise ValueError(f"the snapshot is of commit {r['commit']}")
        found[r["name"]] = df
    return found["nodes"], found["edges"]


def markdown_row(*cells: Column) -> Column:
    """One table row; pipes in cells are escaped and line ends become spaces."""
    clean = [F.replace(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"\s+", " "), F.lit("|"), F.lit("\\|")) for c in cells]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *clean), F.lit(" |"))


def scenarios(paths: DataFrame) -> DataFrame:
    """Feature text of each case from paths(case_id, steps array of struct(keyword, text))."""
    lines = F.transform("steps", lambda s: F.concat(F.lit("  "), s.keyword, F.lit(" "), s.text))
    return paths.select("case_id", F.concat(F.lit("Scenario: "), "case_id", F.lit("\n"), F.array_join(lines, "\n")).alias("text"))
