"""Ordered text rules: criteria mining, mentions, SQL review, routing, failure classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statewake.operators.retrieval import _kept, tokens

WHILE_WHEN = r"(?i)^while (.+?), when (.+?), (?:then )?(.+?)[.!?]?$"
GIVEN_WHEN = r"(?i)^given (.+?),? when (.+?),? then (.+?)[.!?]?$"


def mine_criterion(text: Column) -> Column:
    """struct(given, when, then, blocked) of a criterion; the while form is tried first."""
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    part = lambda i: F.when(t.rlike(WHILE_WHEN), F.regexp_extract(t, WHILE_WHEN, i)).when(t.rlike(GIVEN_WHEN), F.regexp_extract(t, GIVEN_WHEN, i))
    return F.struct(part(1).alias("given"), part(2).alias("when"), part(3).alias("then"), F.when(part(1).isNull(), "unparseable").alias("blocked"))


#: Names in a block, and pairs in a task.
BLOCK, PAIRS_EACH = 1_000, 1 << 20


def mentions(docs: DataFrame, names: DataFrame, doc_id: str, text: str, name_id: str, name: str) -> DataFrame:
    """(document, name) pairs where a one-word name stands as a whole word, in any case: an equi-join on tokens.

    A word meets its names as arrays, which stay arrays until a task of about PAIRS_EACH pairs of its documents
    and blocks of names makes them distinct; the documents' words that are names are written once.
    """
    known = names.select(name_id, F.lower(name).alias("_w")).where("_w is not null").distinct()
    words = docs.select(doc_id, F.explode(F.array_distinct(tokens(F.col(text)))).alias("_w"))
    words = _kept(words.join(known.select("_w").distinct(), "_w", "left_semi"))
    per = known.groupBy("_w").agg(F.count("*").alias("n"))
    pairs = words.groupBy("_w").agg(F.count("*").alias("m")).join(per, "_w").agg(F.sum(F.col("m") * F.col("n"))).first()[0] or 0
    block = F.pmod(F.xxhash64(name_id), F.lit(-(-known.count() // BLOCK) or 1)).alias("_b")
    held = known.groupBy("_w", block).agg(F.sort_array(F.collect_list(F.struct(name_id))).alias("_n"))
    met = words.join(held, "_w").select(doc_id, "_b", "_n").repartition(-(-pairs // PAIRS_EACH) or 1, doc_id, "_b")
    return met.select(doc_id, "_b", F.explode("_n").alias("_n")).select(doc_id, "_b", f"_n.{name_id}").distinct().drop("_b")


# fixed values: SQL anti-patterns and their names, in the order of report
SQL_RULES = (
    ("select-star", r"(?i)\bselect\s+\*"),
    ("function-on-column", r"(?is)\bwhere\b.*?\b(?:upper|lower|trim|cast|coalesce|to_char|substr|substring)\s*\("),
    ("leading-wildcard", r"(?i)\blike\s+'%"),
    ("not-in", r"(?i)\bnot\s+in\s*\("),
    ("scalar-subquery", r"(?i)\bselect\b[^;]*?\(\s*select\b"),
    ("cross-join", r"(?i)\bfrom\s+[\w.]+\s*,\s*[\w.]+"),
    ("row-limit-dialect", r"(?i)\b(?:rownum|top\s+\d+)\b"),
    ("unfiltered", r"(?is)^\s*select\b(?:(?!\bwhere\b|\bjoin\b|\blimit\b|\bfetch\b).)*$"),
)


def sql_review(statement: Column) -> Column:
    """Names of the rules that a statement breaks, in order; null where there is no statement."""
    text = F.trim(F.regexp_replace(statement, r"\s+", " "))
    return F.when(text != "", F.array_compact(F.array(*(F.when(text.rlike(p), n) for n, p in SQL_RULES))))


# fixed values: what the evidence of a failed run looks like
UNAVAILABLE = r"(?i)\b(502|503|504)\b|connection refused|timed? ?out|unknownhost|no route to host"
SCHEMA = r"(?i)unrecognized(?:property|field)|unknown property|missing required (?:creator|property)|cannot deserialize|jsonmappingexception"
TRACE = r"(?i)\bat [\w.$]+\([\w.]+:\d+\)|Traceback \(most recent call"
NULL_VALUE, SETUP = r"(?i)nullpointerexception|AttributeError: .*NoneType", r"(?i)\b(setup|beforeeach|beforeclass|beforemethod|fixture|@before)\b"
STATUS_PAIR = r"(?is)expected[:\s]+(\d{3}).{0,40}?actual[:\s]+(\d{3})"


def failure_class(evidence: Column, expected: Column, actual: Column, phase: Column | None = None) -> Column:
    """The class of a failed run, by the first rule that holds over its evidence, expected and actual values and phase, all of them texts or null; without any, unclassified."""
    said = lambda c: F.nullif(F.trim(F.coalesce(c.cast("string"), F.lit(""))), F.lit(""))
    want, got, phase = said(expected), said(actual), said(phase if phase is not None else F.lit(None))
    text = F.concat_ws(" ", said(evidence), want, got, phase)
    given = want.isNotNull() & got.isNotNull()
    pair = F.when(given, got).otherwise(F.nullif(F.regexp_extract(text, STATUS_PAIR, 2), F.lit("")))
    return (
        F.when(text.rlike(UNAVAILABLE), "unavailable").when(text.rlike(SCHEMA), "schema").when(text.rlike(r"\b5\d{2}\b") & text.rlike(TRACE), "server-error")
        .when(text.rlike(NULL_VALUE) & text.rlike(SETUP), "test-data").when(pair == "404", "url-change").when(pair.isNotNull(), "status-change")
        .when(text.rlike(r"(?i)assert|expected .* but"), "assertion").otherwise("unclassified")
    )


def route(requests: DataFrame, keywords: DataFrame, request_id: str, text: str) -> DataFrame:
    """The workflow whose keywords a request has most of; null for none or a tie. keywords(workflow, keyword)."""
    words = requests.select(request_id, F.explode(F.array_distinct(tokens(F.col(text)))).alias("keyword"))
    hits = words.join(keywords, "keyword").groupBy(request_id, "workflow").agg(F.count("*").alias("hits"))
    best = hits.groupBy(request_id).agg(F.max("hits").alias("hits"))
    top = hits.join(best, [request_id, "hits"]).groupBy(request_id).agg(F.when(F.count("*") == 1, F.min("workflow")).alias("workflow"))
    return requests.select(request_id).join(top, request_id, "left")


def category(wanted: Column, names: list[str]) -> Column:
    """struct(name, hint): the canonical spelling of a category in any case; else a hint by its first three letters."""
    low = F.lower(F.trim(wanted))
    exact = F.coalesce(*(F.when(low == n.lower(), n) for n in names))
    hint = F.coalesce(*(F.when(low.substr(1, 3) == n.lower()[:3], n) for n in names))
    return F.struct(exact.alias("name"), F.when(exact.isNull(), hint).alias("hint"))
