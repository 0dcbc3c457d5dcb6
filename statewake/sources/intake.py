"""Intake of executions, tests, histories, versioned documents and queries, with guards; what is refused stays with its reason."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: outcomes of an execution, functions that act, catalogue views, and what looks like a ticket and is none
OUTCOMES = ("passed", "failed", "skipped", "errored", "not_run")
ACTS = re.compile(r"\b(nextval|setval|set_config|pg_terminate_backend|pg_cancel_backend|pg_reload_conf|pg_rotate_logfile|pg_sleep\w*|pg_read_\w+|pg_write_\w+|pg_ls_\w+|pg_advisory\w*|pg_notify|lo_\w+|dblink\w*|load_extension|load_file|sys_exec|sys_eval|xp_\w+|sp_\w+|openrowset|benchmark|get_lock)\s*\(", re.I)
CATALOGUES = ("information_schema", "pg_catalog")
VIEWS = ("all_tables", "all_views", "all_tab_columns", "all_tab_comments", "all_col_comments", "all_constraints", "all_cons_columns", "all_indexes", "all_ind_columns", "all_sequences", "user_tables", "user_views", "user_tab_columns", "user_constraints", "user_cons_columns", "user_indexes", "user_ind_columns", "sys.tables", "sys.views", "sys.columns", "sys.schemas", "sys.types", "sys.indexes", "sys.index_columns", "sys.foreign_keys", "sys.foreign_key_columns", "sys.key_constraints")
NOT_TICKETS = ("UTF", "HTTP", "HTTPS", "ISO", "IEC", "IEEE", "RFC", "SHA", "MD", "AES", "RSA", "IPV", "TLS", "SSL", "ES", "PEP", "CVE", "JSR", "JEP", "OAUTH")
READ_ONLY = re.compile(r"^\s*(with|select|explain(?!\s+analy[sz]e\b)|show|describe|values)\b", re.I)
WRITES = re.compile(r"\b(insert|update|delete|merge|truncate|drop|alter|create|grant|revoke|call|copy|vacuum|into|for\s+update)\b", re.I)
PII = re.compile(r"(^|_)(e?mail|phone|ssn|passport|birth|dob|address|first_?name|last_?name|full_?name|iban|card)", re.I)


def executions(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Executions with their id, and those refused with the reason; results(case_id, outcome, observed_at, duration_ms, detail), all texts but the duration."""
    case, outcome = F.trim(F.coalesce("case_id", F.lit(""))), F.lower(F.trim(F.coalesce("outcome", F.lit(""))))
    reason = F.when(case == "", "no case_id").when(~outcome.isin(*OUTCOMES), F.concat(F.lit("outcome '"), outcome, F.lit("' is not known")))
    rows = results.select(case.alias("case_id"), outcome.alias("outcome"), "observed_at", F.coalesce("duration_ms", F.lit(0)).alias("duration_ms"), F.substring(F.coalesce("detail", F.lit("")), 1, 2000).alias("detail"), reason.alias("reason"))
    good = rows.where("reason is null").withColumn("id", F.concat_ws("::", "case_id", F.coalesce("observed_at", F.lit("")), "outcome")).drop("reason")
    return good, rows.where("reason is not null").select("case_id", "outcome", "reason")


TESTS = "tests array<struct<test: string, verb: string, paths: array<string>, service: string, statuses: array<int>>>"


def test_inventory(spark: SparkSession, path: str) -> DataFrame:
    """One row for each existing test and route that it reaches: test, verb, path, service, asserts (whether it asserts a status)."""
    rows = spark.read.schema(TESTS).json(path, multiLine=True).select(F.explode("tests").alias("t")).select("t.*")
    return rows.select("test", F.upper("verb").alias("verb"), F.explode("paths").alias("path"), "service", (F.size(F.coalesce("statuses", F.array().cast("array<int>"))) > 0).alias("asserts"))


def layered(source: DataFrame, overrides: DataFrame, review: DataFrame, fingerprint: Column, keys: list[str], columns: list[str]) -> DataFrame:
    """A model's elements with overrides, then review decisions, over what the source says; decisions made on another fingerprint are stale and leave the row as it is.

    overrides and review have keys and columns (null: says nothing); review also has fingerprint, that of the model when the decision was made.
    """
    named = lambda df, x, more=(): df.select(*keys, *(F.col(c).alias(f"_{x}_{c}") for c in [*columns, *more]))
    rows = source.join(named(overrides, "o"), keys, "left").join(named(review, "r", ["fingerprint"]), keys, "left")
    stale = F.col("_r_fingerprint").isNotNull() & (F.col("_r_fingerprint") != fingerprint)
    kept = [c for c in source.columns if c not in columns]
    return rows.select(*kept, *(F.coalesce(F.when(~stale, F.col(f"_r_{c}")), F.col(f"_o_{c}"), F.col(c)).alias(c) for c in columns), stale.alias("stale"))


def fingerprint(elements: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """A digest of all elements of each model, in the order of their text, whatever the order of rows; nulls differ from empty texts."""
    line = F.to_json(F.array(*(F.col(c).cast("string") for c in columns)))
    return elements.groupBy(*by).agg(F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256), 1, 16).alias("fingerprint"))


def versioned(spark: SparkSession, path: str, schema: str, version_field: str, known: tuple[str, ...]) -> DataFrame:
    """A versioned JSON document; an unknown or missing version is an error that says so."""
    doc = spark.read.schema(f"{version_field} string, {schema}").json(path, multiLine=True)
    wrong = F.raise_error(F.concat(F.lit(f"{version_field} "), F.coalesce(version_field, F.lit("(none)")), F.lit(" is not known")))
    return doc.withColumn(version_field, F.when(F.coalesce(F.col(version_field).isin(*known), F.lit(False)), F.col(version_field)).otherwise(wrong))


KNOWLEDGE = "area string, entities array<struct<id: string, name: string, rules: array<string>>>"


def knowledge(spark: SparkSession, path: str) -> DataFrame:
    """id, name and rule of a knowledge file's entities."""
    rows = versioned(spark, path, KNOWLEDGE, "knowledge_version", ("1",)).where("knowledge_version is not null")
    return rows.select("area", F.explode("entities").alias("e")).select("area", "e.id", "e.name", F.explode_outer("e.rules").alias("rule"))


def compared(known: DataFrame, stated: DataFrame, key: str, text: str) -> DataFrame:
    """What a partial source says against what is known: already, contradicting or new. What it leaves out is not a removal; without anything known, nothing is compared."""
    k = known.select(key, F.col(text).alias("_k"))
    rows = stated.join(k, key, "left")
    verdict = F.when(F.col("_k").isNull(), "new").when(F.col("_k") == F.col(text), "already").otherwise("contradicting")
    some = F.broadcast(known.limit(1).agg((F.count("*") > 0).alias("_some")))
    return rows.crossJoin(some).select(key, F.when(F.col("_some"), verdict).otherwise("not-compared").alias("verdict"))


def history(spark: SparkSession, path: str) -> DataFrame:
    """sha, ts, subject and files of ``git log --format='%x01%H%x02%cI%x02%s' --name-only`` written to a file."""
    text = spark.read.text(path, lineSep="\x01").where("trim(value) <> ''")
    head, rest = F.split(F.split_part("value", F.lit("\n"), F.lit(1)), "\x02"), F.split("value", "\n")
    return text.select(head[0].alias("sha"), F.to_timestamp(head[1]).alias("ts"), head[2].alias("subject"), F.filter(F.slice(rest, 2, F.size(rest)), lambda f: F.trim(f) != "").alias("files"))


def tickets(subject: Column) -> Column:
    """Distinct tracker keys in a subject, in order of appearance; names of standards that look like one are none."""
    keys = F.array_distinct(F.regexp_extract_all(F.coalesce(subject, F.lit("")), F.lit(r"\b([A-Z][A-Z0-9]{1,9}-\d+)\b"), F.lit(1)))
    return F.filter(keys, lambda k: ~F.substring_index(k, "-", 1).isin(*NOT_TICKETS))


def _bare(statement: str) -> str:
    """A statement without comments, and with quoted text emptied."""
    return re.sub(r"--[^\n]*|/\*.*?\*/|'(?:[^']|'')*'", " ", statement, flags=re.S).strip().rstrip(";")


def relations(statement: str) -> list[str]:
    """Every relation that a statement names after FROM or JOIN or after a comma there, in small letters; subqueries name theirs, and what WITH defines is none."""
    text = re.sub(r'[`"\[\]]', "", _bare(statement)).lower()
    own = set(re.findall(r"(?:\bwith\s+(?:recursive\s+)?|,\s*)(\w+)(?:\s*\([^()]*\))?\s+as\s+(?:not\s+|materialized\s+)*\(", text))
    found = []
    for start in re.finditer(r"\b(?:from|join)\b", text):
        depth, part = 0, ""
        for token in re.findall(r"[(),]|[^\s(),]+", text[start.end() :]):
            depth += (token == "(") - (token == ")")
            if depth < 0 or depth == 0 and token in ("where", "group", "order", "having", "limit", "offset", "fetch", "union", "intersect", "except", "on", "using", "join", "inner", "left", "right", "full", "cross", "natural", "window"):
                break
            if depth == 0 and token == ",":
                part = ""
            elif not part:
                part = token
                if token not in ("(", "lateral"):
                    found.append(token)
    return [r for r in found if r not in own]


def assert_read_only(statement: str) -> None:
    """Raise unless a statement is one that only reads."""
    bare = _bare(statement)
    if ";" in bare or not READ_ONLY.match(bare) or WRITES.search(bare) or ACTS.search(bare):
        raise ValueError("not a statement that only reads")


def assert_catalogue_only(statement: str) -> None:
    """Raise unless every relation of a statement is a catalogue view that is known by name, and there is one."""
    assert_read_only(statement)
    names = relations(statement)
    if not names or any(n not in VIEWS and not re.fullmatch(rf"({'|'.join(CATALOGUES)})\.\w+", n) for n in names):
        raise ValueError("not a statement that reads the catalogue alone")


def assert_allowed(urls: list[str], hosts: tuple[str, ...]) -> None:
    """Raise unless every URL is https and of an allowed host."""
    for u in urls:
        m = re.match(r"^https://([^/:?#]+)", u)
        if not m or m[1].lower() not in hosts:
            raise ValueError(f"not an allowed source: {u}")


def bounded(rows: DataFrame, limit: int) -> tuple[DataFrame, bool, list[str]]:
    """At most limit rows without columns that name personal data, whether there were more, and the columns left out. The limit is the feature."""
    left_out = [c for c in rows.columns if PII.search(c)]
    kept = rows.drop(*left_out).limit(limit + 1)
    more = kept.count() > limit
    return kept.limit(limit), more, left_out


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """table, column, type and nullable of a captured catalogue (JSON rows)."""
    return spark.read.schema("table string, column string, type string, nullable boolean").json(path, multiLine=True)


def confirmed_columns(predicates: DataFrame, columns: DataFrame) -> DataFrame:
    """Derived query properties with the catalogue's column, or why there is none; predicates(method, table, property), columns(table, column)."""
    snake = F.lower(F.regexp_replace("property", r"(?<=[a-z0-9])(?=[A-Z])", "_"))
    rows = predicates.withColumn("_c", snake).join(columns.select(F.col("table"), F.lower("column").alias("_c"), F.col("column").alias("column")), ["table", "_c"], "left")
    return rows.select("method", "table", "property", F.coalesce("column", F.lit("UNRESOLVED")).alias("column"), F.when(F.col("column").isNull(), F.concat(F.lit("no column "), "_c", F.lit(" in "), "table")).alias("reason"))


def intakes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Declared connectors with a known status, and those refused with the reason."""
    rows = spark.read.schema("intakes array<struct<id: string, system: string, status: string>>").json(path, multiLine=True).select(F.explode("intakes").alias("i")).select("i.*")
    reason = F.when(F.coalesce(F.trim("id"), F.lit("")) == "", "no id").when(~F.coalesce(F.col("status").isin("available", "planned", "retired"), F.lit(False)), "status is not known")
    rows = rows.withColumn("reason", reason)
    return rows.where("reason is null").drop("reason"), rows.where("reason is not null")


def around_failures(logs: DataFrame, failures: DataFrame, before: int = 20, after: int = 5) -> DataFrame:
    """Log rows within so many seconds before a failure's start and after its end: a join on minute buckets, then on the exact range. logs(pod, ts, line), failures(run_id, pod, started, ended)."""
    minute = lambda c: F.floor(F.unix_timestamp(c) / 60)
    span = failures.select("run_id", "pod", (F.col("started") - F.make_dt_interval(secs=F.lit(before))).alias("_a"), (F.col("ended") + F.make_dt_interval(secs=F.lit(after))).alias("_b")).withColumn("_m", F.explode(F.sequence(minute("_a"), minute("_b"))))
    return logs.withColumn("_m", minute("ts")).join(span, ["pod", "_m"]).where("ts between _a and _b").select("run_id", "pod", "ts", "line")
