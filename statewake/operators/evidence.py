"""The evidence layer of a service: extracted facts as typed nodes and edges with content ids.

Nodes are (service, id, label, name, props), edges (service, src, src_label, rel_type, dst, dst_label).
An id is a label's prefix and a digest of what the fact says, so a second run gives the same rows and
facts told twice are one node. A reference to what was not extracted is no edge: it stays as a row of
unresolved(service, id, rel_type, wanted, reason), so no reference is lost. Nulls in a fact are absent
properties; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from statewake.functions.scores import content_id
from statewake.operators.synthesis import DEALT, SERVICE

# The edges that the layer may have, and labels with the one that they specialise
CATALOGUE = (("Endpoint", "SECURED_BY", "SecurityScheme"), ("Endpoint", "DECLARES", "DeclaredOutcome"), ("DeclaredOutcome", "GUARDED_BY", "Check"), ("Endpoint", "CONSTRAINED_BY", "Check"), ("Class", "OF_TYPE", "Class"))
PARENTS = {"Enum": "Class", "ApiCall": "Transition"}
#: The edges of outcomes and checks: relation, label of the source and prefix of its id, the same of the target.
TOLD = (("DECLARES", "Endpoint", "ep:", "DeclaredOutcome", "out:"), ("GUARDED_BY", "DeclaredOutcome", "out:", "Check", "chk:"), ("CONSTRAINED_BY", "Endpoint", "ep:", "Check", "chk:"))
#: References of theirs that lead nowhere: relation, prefix of the id, reason.
LOST = (("DECLARES", "out:", "no such endpoint"), ("GUARDED_BY", "out:", "no such check"), ("CONSTRAINED_BY", "chk:", "no such endpoint"))


def fact_id(prefix: str, *parts: str | Column) -> Column:
    """The id of a fact by its content; null parts count as empty."""
    return F.concat(F.lit(f"{prefix}:"), content_id(F.concat_ws("|", *(F.coalesce(F.col(p).cast("string") if isinstance(p, str) else p, F.lit("")) for p in parts))))


def _nodes(df: DataFrame, label: str | Column, node: Column, name: str | Column, props: dict[str, Column | str]) -> DataFrame:
    values = {k: F.col(v) if isinstance(v, str) else v for k, v in props.items()}
    given = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, values)), F.array(*(v.cast("string") for v in values.values()))), lambda k, v: v.isNotNull() & (v != "")) if values else F.create_map().cast("map<string,string>")
    return df.select(SERVICE, node.alias("id"), (F.lit(label) if isinstance(label, str) else label).alias("label"), (F.col(name) if isinstance(name, str) else name).alias("name"), F.to_json(given).alias("props"))


def _edges(df: DataFrame, src: str, src_label: str | Column, rel: str, dst: str, dst_label: str | Column) -> DataFrame:
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    return df.select(SERVICE, F.col(src).alias("src"), as_column(src_label).alias("src_label"), F.lit(rel).alias("rel_type"), F.col(dst).alias("dst"), as_column(dst_label).alias("dst_label"))


def type_names(expression: Column) -> Column:
    """The type names that an expression mentions, in order, once each."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(expression, F.lit("")), F.lit(r"[A-Za-z_][A-Za-z0-9_.]*"), F.lit(0)))


def evidence_layer(endpoints: DataFrame, security: DataFrame, members: DataFrame, mappings: DataFrame, checks: DataFrame, outcomes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and unresolved references of the facts.

    endpoints, mappings and outcomes as in ``synthesis``; security(service, handler, verb, scheme, expression,
    roles array), members(service, owner, owner_is_enum, name, type, element_type), checks(service, id,
    expression, place, endpoint_id). A type is a node with its fields; a field of another declared type is an edge.
    """
    return fact_nodes(endpoints, security, members, mappings, checks, outcomes), *references(endpoints, security, members, checks, outcomes)


def _endpoints(endpoints: DataFrame) -> tuple[DataFrame, DataFrame]:
    ep = endpoints.select("*", fact_id("ep", SERVICE, "verb", "path").alias("_id"), F.concat_ws("::", "handler", "verb").alias("endpoint_id"))
    return ep, ep.groupBy(SERVICE, "endpoint_id").agg(F.min("_id").alias("_ep"))


def _secured(security: DataFrame, by_id: DataFrame) -> DataFrame:
    sec = security.where("scheme <> ''").withColumn("endpoint_id", F.concat_ws("::", "handler", "verb")).join(by_id, [SERVICE, "endpoint_id"], "left")
    return sec.withColumn("_id", fact_id("sec", SERVICE, F.coalesce("_ep", "endpoint_id"), "scheme", "expression"))


def _members(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    m = members.withColumns({"_id": fact_id("cls", SERVICE, "owner"), "_label": F.when(F.coalesce("owner_is_enum", F.lit(False)), "Enum").otherwise("Class")})
    return m, m.groupBy(SERVICE, "_id", "owner", "_label").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("fields"))


def _checks(checks: DataFrame) -> DataFrame:
    return checks.withColumn("_id", fact_id("chk", SERVICE, "id", "expression"))


def _outcomes(outcomes: DataFrame) -> DataFrame:
    return outcomes.withColumn("_id", fact_id("out", SERVICE, "endpoint_id", "status", "discriminator", F.array_join("checks", ","), "sense"))


def fact_nodes(endpoints: DataFrame, security: DataFrame, members: DataFrame, mappings: DataFrame, checks: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The nodes of ``evidence_layer``."""
    ep, by_id = _endpoints(endpoints)
    nodes = [_nodes(ep, "Endpoint", F.col("_id"), F.concat_ws(" ", "verb", "path"), {"http_method": "verb", "path": "path", "handler_type": "handler_type", "validated": "validated", "response_body": "response_body"})]
    nodes.append(_nodes(_secured(security, by_id), "SecurityScheme", F.col("_id"), "scheme", {"scheme": "scheme", "expression": "expression", "roles": F.array_join(F.array_sort("roles"), ",")}))
    nodes.append(_nodes(_members(members)[1], F.col("_label"), F.col("_id"), F.element_at(F.split("owner", r"\."), -1), {"package": "owner", "fields": "fields"}))
    nodes.append(_nodes(mappings, "ExceptionMapping", fact_id("exm", SERVICE, "exception", "advice"), F.concat_ws(" ", "exception", "status"), {"exception_type": "exception", "status": "status", "advice_type": "advice"}))
    nodes.append(_nodes(_checks(checks), "Check", F.col("_id"), "expression", {"expression": "expression", "order": "place"}))
    nodes.append(_nodes(_outcomes(outcomes), "DeclaredOutcome", F.col("_id"), F.concat_ws(" ", "endpoint_id", "status"), {"status": "status", "discriminator": "discriminator", "guard_sense": "sense", "endpoint_ref": "endpoint_id"}))
    # facts told twice with different properties are one node; the smallest text stays
    return reduce(DataFrame.unionByName, nodes).groupBy(SERVICE, "id", "label").agg(F.min("name").alias("name"), F.min("props").alias("props"))


def references(endpoints: DataFrame, security: DataFrame, members: DataFrame, checks: DataFrame, outcomes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edges and unresolved references of ``evidence_layer``.

    Facts are dealt by service once, as in ``synthesis``: every join is within a service, and so is making its
    rows distinct. Nothing is written.
    """
    outcomes.sparkSession.conf.set(DEALT, "false")
    ep, by_id = _endpoints(endpoints.repartition(SERVICE))
    sec = _secured(security.repartition(SERVICE), by_id)
    edges = [_edges(sec.where("_ep is not null"), "_ep", "Endpoint", "SECURED_BY", "_id", "SecurityScheme")]
    missing = [_missing(sec.where("_ep is null"), "SECURED_BY", "endpoint_id", "no such endpoint")]

    m, types = _members(members.repartition(SERVICE))
    whole = types.select(SERVICE, F.col("owner").alias("_whole"), F.col("_id").alias("_to"), F.col("_label").alias("_to_label"))
    # a simple name that several types have resolves to none of them
    simple = types.groupBy(SERVICE, F.element_at(F.split("owner", r"\."), -1).alias("_simple")).agg(F.min("owner").alias("_owner"), F.count("*").alias("_n")).where("_n = 1").drop("_n")
    wanted = m.select(SERVICE, "_id", "owner", "_label", F.coalesce("type", F.lit("")).alias("type"), F.coalesce("element_type", F.lit("")).alias("element_type")).distinct()
    direct = wanted.join(whole.withColumnRenamed("_whole", "type"), [SERVICE, "type"], "left")
    inner = direct.where("_to is null").drop("_to", "_to_label").join(simple.withColumnRenamed("_simple", "element_type"), [SERVICE, "element_type"], "left").join(whole.withColumnRenamed("_whole", "_owner"), [SERVICE, "_owner"], "left")
    nested = direct.where("_to is not null").select(SERVICE, "_id", "_label", "_to", "_to_label").unionByName(inner.where("_to is not null").select(SERVICE, "_id", "_label", "_to", "_to_label")).where("_id <> _to").distinct()
    edges.append(_edges(nested, "_id", F.col("_label"), "OF_TYPE", "_to", F.col("_to_label")))
    outside = inner.where("_to is null").withColumn("_want", F.when(F.col("element_type") != "", F.col("element_type")).otherwise(F.col("type"))).where("_want <> ''")
    missing.append(_missing(outside, "OF_TYPE", "_want", "not one declared type"))

    # a payload that names a type which is not declared, or more than one
    payload = ep.select(SERVICE, "_id", F.explode(F.array_union(type_names(F.col("body_type")), type_names(F.col("response_body")))).alias("_want")).withColumn("_simple", F.element_at(F.split("_want", r"\."), -1))
    payload = payload.join(whole.select(SERVICE, F.col("_whole").alias("_want"), F.lit(True).alias("_w")), [SERVICE, "_want"], "left").join(simple.select(SERVICE, "_simple", F.lit(True).alias("_s")), [SERVICE, "_simple"], "left")
    missing.append(_missing(payload.where("_w is null and _s is null"), "PAYLOAD", "_want", "not one declared type"))

    told, lost = _told(by_id, checks, outcomes)
    # relations differ, so each is distinct by itself
    return reduce(DataFrame.unionByName, (*(e.distinct() for e in edges), told)), reduce(DataFrame.unionByName, (*(x.distinct() for x in missing), lost))


def _told(by_id: DataFrame, checks: DataFrame, outcomes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edges that outcomes and checks make, and their references that lead nowhere, in one pass over both.

    An outcome has a row for each of its checks, and a check finds there whether any outcome refers to it.
    Ids go without prefix, as bytes, until the rows are distinct.
    """
    short = lambda x: F.unhex(F.substring(x, -16, 16))
    oc = _outcomes(outcomes).select(SERVICE, "endpoint_id", short("_id").alias("_id"), F.posexplode_outer(F.array_distinct("checks")).alias("_k", "id"))
    ck = _checks(checks).select(SERVICE, "endpoint_id", short("_id").alias("_id"), F.lit(-1).alias("_k"), "id")
    both = oc.withColumn("id", F.col("id").cast("string")).unionByName(ck.withColumn("id", F.col("id").cast("string"))).repartition(SERVICE)
    rows = both.join(by_id.withColumn("_ep", short("_ep")), [SERVICE, "endpoint_id"], "left")

    # a null service or id is nobody's
    same, named = Window.partitionBy(SERVICE, "id"), F.col(SERVICE).isNotNull() & F.col("id").isNotNull()
    check, first, refers = F.coalesce("_k", F.lit(0)) < 0, F.coalesce("_k", F.lit(0)) == 0, F.coalesce(F.col("_k") >= 0, F.lit(False))
    rows = rows.withColumns({"_cks": F.collect_set(F.when(check, F.col("_id"))).over(same), "_used": F.max(refers).over(same)})
    cks, alone, placed = F.when(named, F.col("_cks")), check & ~(named & F.col("_used")), F.col("_ep").isNotNull()

    def made(kind: str, *of: Column) -> DataFrame:
        return rows.select(SERVICE, F.inline(F.concat(*(F.coalesce(x, F.array().cast(kind)) for x in of)))).distinct()

    row = lambda rel, a, b: F.struct(F.lit(rel).alias("_rel"), F.col(a).alias("_a"), (F.col(b) if isinstance(b, str) else b).alias("_b"))
    edges = made("array<struct<_rel:int,_a:binary,_b:binary>>", F.when(first & placed, F.array(row(0, "_ep", "_id"))), F.when(refers, F.transform(cks, lambda c: row(1, "_id", c))), F.when(alone & placed, F.array(row(2, "_ep", "_id"))))
    lost = made("array<struct<_rel:int,_a:binary,_b:string>>", F.when(first & ~placed, F.array(row(0, "_id", "endpoint_id"))), F.when(refers & (F.size(F.coalesce(cks, F.array().cast("array<binary>"))) == 0), F.array(row(1, "_id", "id"))), F.when(alone & ~placed, F.array(row(2, "_id", "endpoint_id"))))
    of = lambda table, place: F.get(F.array(*(F.lit(x[place]) for x in table)), F.col("_rel"))
    long = lambda prefix, x: F.concat(prefix, F.lower(F.hex(x)))
    edges = edges.select(SERVICE, long(of(TOLD, 2), "_a").alias("src"), of(TOLD, 1).alias("src_label"), of(TOLD, 0).alias("rel_type"), long(of(TOLD, 4), "_b").alias("dst"), of(TOLD, 3).alias("dst_label"))
    # a null and an empty name are wanted alike
    lost = lost.select(SERVICE, long(of(LOST, 1), "_a").alias("id"), of(LOST, 0).alias("rel_type"), F.coalesce("_b", F.lit("")).alias("wanted"), of(LOST, 2).alias("reason")).distinct()
    return edges, lost


def _missing(df: DataFrame, rel: str, wanted: str, reason: str) -> DataFrame:
    return df.select(SERVICE, F.col("_id").alias("id"), F.lit(rel).alias("rel_type"), F.coalesce(F.col(wanted).cast("string"), F.lit("")).alias("wanted"), F.lit(reason).alias("reason"))


def ancestors(labels: Sequence[str], parents: dict[str, str]) -> list[tuple[str, str]]:
    """(label, itself or a label that it specialises, however far); a cycle among parents ends where it closes."""
    out = []
    for label in labels:
        now, seen = label, set()
        while now is not None and now not in seen:
            out.append((label, now))
            seen.add(now)
            now = parents.get(now)
    return out


def illegal_edges(edges: DataFrame, catalogue: Sequence[tuple[str, str, str]] = CATALOGUE, parents: dict[str, str] = PARENTS) -> DataFrame:
    """Edges that no triple of the closed catalogue allows, for the labels or any that they specialise. Null labels are not allowed."""
    labels = sorted({x for a, _, b in catalogue for x in (a, b)} | set(parents) | set(parents.values()))
    up = ancestors(labels, parents)
    allowed = {(a, r, b) for x, r, y in catalogue for a, over_a in up if over_a == x for b, over_b in up if over_b == y}
    key = F.struct("src_label", "rel_type", "dst_label")
    legal = key.isin(*(F.struct(*map(F.lit, t)) for t in sorted(allowed)))
    return edges.where(~F.coalesce(legal, F.lit(False)))
