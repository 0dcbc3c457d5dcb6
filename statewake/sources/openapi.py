"""Members of the schemas of OpenAPI documents: references followed, allOf merged, constraints carried.

Documents are read as VARIANT, whatever they hold. A document that is no JSON, or lacks schemas, gives no
rows. A reference that leads back to where it came from, or nowhere, ends with that reason: no member is
lost and no walk goes on for ever. Rounds are written to the shared folder; there are as many as references
follow one another.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statewake.operators import graph

#: What a property may say about its values, in the order that it is told.
CONSTRAINTS = ("minLength", "maxLength", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "minItems", "maxItems", "pattern", "format")


def documents(spark: SparkSession, path: str) -> DataFrame:
    """doc (the file's name) and body (VARIANT) of the documents under a path."""
    rows = spark.read.text(path, wholetext=True)
    return rows.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("doc"), F.try_parse_json("value").alias("body")).where("body is not null")


def _at(value: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(value, path, kind)


def _reference(value: Column) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(_at(value, "$['$ref']", "string"), F.lit("")), r"^#/components/schemas/(.+)$", 1), F.lit(""))


def schema_parts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """part(doc, schema, place, value): each schema and what allOf adds to it in place, however deep; parent(doc, schema, ref): what allOf refers to."""
    named = docs.select("doc", F.array().cast("array<int>").alias("place"), F.explode(_at(F.col("body"), "$.components.schemas", "map<string,variant>")).alias("schema", "value"))
    root, spark = graph.scratch(docs), docs.sparkSession
    rounds = []
    open_ = named.withColumn("ref", _reference(F.col("value")))
    for k in itertools.count():
        rounds.append(graph._written(open_, root, f"part-{k}"))
        more = rounds[-1].where("ref is null").select("doc", "schema", "place", F.posexplode(_at(F.col("value"), "$.allOf", "array<variant>")).alias("_k", "value")).select("doc", F.array_append("place", F.col("_k")).alias("place"), "schema", "value")
        if not more.limit(1).count():
            break
        open_ = more.withColumn("ref", _reference(F.col("value")))
    parts = spark.read.schema(rounds[0].schema).parquet(*(f"{root}/part-{k}" for k in range(len(rounds))))
    return parts.where("ref is null").select("doc", "schema", "place", "value"), parts.where("ref is not null").select("doc", "schema", "ref").distinct()


def _closure(parents: DataFrame) -> DataFrame:
    """(doc, schema, ancestor, hops) of all that allOf leads to, however far, by the fewest hops; a circle adds nothing."""
    root, spark = graph.scratch(parents), parents.sparkSession
    one = graph._written(parents.select("doc", "schema", F.col("ref").alias("ancestor"), F.lit(1).alias("hops")), root, "0")
    seen = front = one
    for k in itertools.count(1):
        step = front.join(one.select("doc", F.col("schema").alias("ancestor"), F.col("ancestor").alias("_next")), ["doc", "ancestor"]).select("doc", "schema", F.col("_next").alias("ancestor"), F.lit(k + 1).alias("hops")).distinct()
        front = graph._written(step.join(seen.select("doc", "schema", "ancestor"), ["doc", "schema", "ancestor"], "left_anti"), root, str(k))
        if not front.limit(1).count():
            return seen
        seen = spark.read.schema(one.schema).parquet(*(f"{root}/{i}" for i in range(k + 1)))


def members(docs: DataFrame) -> DataFrame:
    """doc, schema, name, type, ref (of the property or of its items), many, required, constraints and said_by of every member, inherited ones included.

    Of a name that several schemas say, the nearest one's counts, then the lowest; within one, the first from outside in. An allOf that refers to
    what is not there is a member without a name, with the reference.
    """
    parts, parents = schema_parts(docs)
    up = _closure(parents)
    owners = parts.select("doc", "schema", F.col("schema").alias("ancestor"), F.lit(0).alias("hops")).distinct().unionByName(up.where("schema <> ancestor"))
    said = parts.select("doc", F.col("schema").alias("ancestor"), "place", F.explode(_at(F.col("value"), "$.properties", "map<string,variant>")).alias("name", "p"))
    needed = parts.select("doc", F.col("schema").alias("ancestor"), F.explode(_at(F.col("value"), "$.required", "array<string>")).alias("name"))
    own = F.coalesce(_reference(F.col("p")), _reference(_at(F.col("p"), "$.items", "variant")))
    rules = F.array_compact(F.array(*(F.when(_at(F.col("p"), f"$.{c}", "string").isNotNull(), F.concat(F.lit(f"{c}="), _at(F.col("p"), f"$.{c}", "string"))) for c in CONSTRAINTS)))
    said = said.select("doc", "ancestor", "place", "name", _at(F.col("p"), "$.type", "string").alias("type"), own.alias("ref"), (F.coalesce(_at(F.col("p"), "$.type", "string"), F.lit("")) == "array").alias("many"), rules.alias("constraints"))
    rows = owners.join(said, ["doc", "ancestor"])
    best = rows.groupBy("doc", "schema", "name").agg(F.min(F.struct("hops", F.col("ancestor").alias("said_by"), "place", "type", "ref", "many", "constraints")).alias("m"))
    required = owners.join(needed, ["doc", "ancestor"]).select("doc", "schema", "name", F.lit(True).alias("required")).distinct()
    found = best.select("doc", "schema", "name", "m.type", "m.ref", "m.many", "m.constraints", "m.said_by").join(required, ["doc", "schema", "name"], "left").withColumn("required", F.coalesce("required", F.lit(False)))
    lost = up.join(parts.select("doc", F.col("schema").alias("ancestor")).distinct(), ["doc", "ancestor"], "left_anti")
    none = lost.select("doc", "schema", F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("type"), F.col("ancestor").alias("ref"), F.lit(False).alias("many"), F.array().cast("array<string>").alias("constraints"), F.col("schema").alias("said_by"), F.lit(False).alias("required"))
    return found.unionByName(none).select("doc", "schema", "name", "type", "ref", "many", "required", "constraints", "said_by")


def expanded(found: DataFrame, roots: DataFrame) -> DataFrame:
    """Every member below each of roots(doc, schema) by dotted path: doc, root, path, type, required, constraints and reason (cycle or dangling, where a reference is not followed).

    found is what ``members`` gives. A list's members have ``[]`` in their path.
    """
    root, spark = graph.scratch(found), found.sparkSession
    m = graph._written(found, root, "members")
    known = m.select("doc", F.col("schema").alias("ref"), F.lit(True).alias("_known")).distinct()
    at = roots.select("doc", F.col("schema").alias("root"), "schema", F.lit("").alias("_path"), F.array("schema").alias("_seen")).distinct()
    for k in itertools.count():
        rows = at.join(m, ["doc", "schema"]).join(known, ["doc", "ref"], "left")
        name = F.concat(F.coalesce("name", F.lit("<allOf>")), F.when(F.col("many"), "[]").otherwise(""))
        path = F.when(F.col("_path") == "", name).otherwise(F.concat_ws(".", "_path", name))
        reason = F.when(F.col("ref").isNull(), None).when(F.array_contains("_seen", F.col("ref")), "cycle").when(F.col("_known").isNull(), "dangling")
        step = graph._written(rows.select("doc", "root", path.alias("path"), "type", "ref", "required", "constraints", reason.alias("reason"), "_seen"), root, str(k))
        if not step.limit(1).count():
            break
        at = step.where("ref is not null and reason is null").select("doc", "root", F.col("ref").alias("schema"), F.col("path").alias("_path"), F.array_append("_seen", F.col("ref")).alias("_seen"))
    return spark.read.schema(step.schema).parquet(*(f"{root}/{i}" for i in range(k + 1))).select("doc", "root", "path", "type", "required", "constraints", "reason")
