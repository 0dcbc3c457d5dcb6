"""Nodes, edges, findings and rendered documents, written all together or not at all.

A write plan is checked as a whole before anything is written: nodes need an id and a known label, edges
two nodes that are stored or planned with the labels that they name, and a triple of the catalogue, findings a
node. One row that fails refuses the plan, and every failing row is told with its reason. Repeated rows
count once; a planned node replaces the stored one of its id; an empty plan makes no version.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statewake.functions.scores import content_id
from statewake.operators import evidence
from statewake.sources.versions import Change, VersionedTables

NODES, EDGES, FINDINGS = "id string, label string, name string, props string", "src string, src_label string, rel_type string, dst string, dst_label string", "id string, subject string, kind string, detail string"
DOCUMENTS = "path string, hash string, text string, rendered_at string"
#: Lines that say when a document was made are no part of its content.
MADE_AT = r"(?im)^.*\b(generated|rendered|produced)[ _-](at|on)\b.*$"


class GraphStore:
    def __init__(self, spark: SparkSession, path: str, labels: Sequence[str], catalogue=evidence.CATALOGUE, parents=evidence.PARENTS):
        self.spark, self.tables, self.labels, self.catalogue, self.parents = spark, VersionedTables(spark, path), list(labels), catalogue, parents

    def read(self, table: str, version: int | None = None) -> DataFrame:
        return self.tables.read(table, {"nodes": NODES, "edges": EDGES, "findings": FINDINGS}[table], version)

    def rejects(self, nodes: DataFrame, edges: DataFrame, findings: DataFrame) -> DataFrame:
        """What of a plan can't be written: kind, id and reason."""
        blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
        n = nodes.select(F.lit("node").alias("kind"), F.col("id"), F.when(blank(F.col("id")), "no id").when(~F.coalesce(F.col("label").isin(self.labels), F.lit(False)), "unknown label").alias("reason"))
        two = nodes.select("id", "label").distinct().groupBy("id").count().where("count > 1").select(F.lit("node"), "id", F.lit("two labels"))
        there = self.read("nodes").select("id", "label").join(nodes.select("id"), "id", "left_anti").union(nodes.select("id", "label")).distinct()
        rows = edges.distinct()
        for side in ("src", "dst"):
            rows = rows.join(there.select(F.col("id").alias(side), F.col("label").alias(f"_{side}")), side, "left")
        illegal = evidence.illegal_edges(edges.distinct(), self.catalogue, self.parents).withColumn("_illegal", F.lit(True))
        rows = rows.join(illegal, [c.split()[0] for c in EDGES.split(", ")], "left")
        missing = F.when(F.col("_src").isNull(), "no source").when(F.col("_dst").isNull(), "no target").when((F.col("_src") != F.col("src_label")) | (F.col("_dst") != F.col("dst_label")), "another label").when(F.col("_illegal"), "not in the catalogue")
        e = rows.select(F.lit("edge"), F.concat_ws(" ", "src", "rel_type", "dst"), missing)
        f = findings.join(there.select(F.col("id").alias("subject"), F.lit(True).alias("_t")), "subject", "left").select(F.lit("finding"), "id", F.when(blank(F.col("id")), "no id").when(F.col("_t").isNull(), "no subject"))
        return n.unionAll(two).unionAll(e).unionAll(f).where("reason is not null").distinct()

    def write(self, nodes: DataFrame, edges: DataFrame, findings: DataFrame | None = None) -> dict:
        """version, nodes, edges and findings (planned), and rejected; with a rejected row nothing is written."""
        findings = self.spark.createDataFrame([], FINDINGS) if findings is None else findings
        bad = self.rejects(nodes, edges, findings).count()
        counts = {"nodes": nodes.select("id").distinct().count(), "edges": edges.distinct().count(), "findings": findings.select("id").distinct().count(), "rejected": bad}
        if bad:
            return {"version": self.tables.version(), **counts}

        def replaced(new: DataFrame, key: str, columns: str):
            one = new.groupBy(key).agg(F.min(F.struct(*(c.split()[0] for c in columns.split(", ")))).alias("r")).select("r.*")
            return lambda old: old.join(one.select(key), key, "left_anti").unionByName(one)

        version = self.tables.commit({
            "nodes": Change(NODES, "id", nodes.select("id"), replaced(nodes, "id", NODES)), "edges": Change(EDGES, "src", edges.select("src"), lambda old: old.unionByName(edges).distinct()),
            "findings": Change(FINDINGS, "id", findings.select("id"), replaced(findings, "id", FINDINGS)),
        })
        return {"version": version, **counts}


def content_hash(text: Column) -> Column:
    """The digest of a document without the lines that say when it was made."""
    return content_id(F.regexp_replace(F.coalesce(text, F.lit("")), MADE_AT, ""), 64)


class RenderedDocuments:
    """Documents by path, kept with the hash of their content: what only differs in its time is not written again."""

    def __init__(self, spark: SparkSession, path: str):
        self.tables = VersionedTables(spark, path)

    def read(self, version: int | None = None) -> DataFrame:
        return self.tables.read("documents", DOCUMENTS, version)

    def render(self, documents: DataFrame, at: str) -> dict[str, int]:
        """Take in documents(path, text): new, changed and unchanged; of rows of one path the smallest text counts, and null paths are left out."""
        one = documents.where("path is not null").groupBy("path").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).withColumn("hash", content_hash(F.col("text")))
        rows = one.join(self.read().select("path", F.col("hash").alias("_old")), "path", "left")
        n = rows.agg(F.count_if(F.col("_old").isNull()).alias("new"), F.count_if(F.col("_old") != F.col("hash")).alias("changed"), F.count_if(F.col("_old") == F.col("hash")).alias("unchanged")).first()
        fresh = rows.where("_old is null or _old <> hash").select("path", "hash", "text", F.lit(at).alias("rendered_at"))
        self.tables.commit({"documents": Change(DOCUMENTS, "path", fresh.select("path"), lambda old: old.join(fresh.select("path"), "path", "left_anti").unionByName(fresh))})
        return n.asDict()
