"""The driver tables as observed state machines (one machine for each user of ``events``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with the state it left and the state it led to, in the order of its machine."""
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("model_id"), "event_id", "ts", "event_type", F.concat_ws("|", "event_type", F.floor(F.coalesce("value", F.lit(0)) / 50).cast("int")).alias("state"), F.get_json_object("props", "$.k").cast("int").alias("k")
    )
    order = Window.partitionBy("model_id").orderBy("ts", "event_id")
    return events.withColumns({"target": F.lead("state").over(order), "trigger": F.lead("event_type").over(order), "pos": F.row_number().over(order)})


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct transitions of every machine; a transition triggered by an error is planned, not implemented."""
    t = steps(spark, sf_dir).where(F.col("target").isNotNull()).groupBy("model_id", F.col("state").alias("source"), "trigger", "target").agg(F.count("*").alias("n"), F.min("k").alias("lo"), F.max("k").alias("hi"))
    return t.withColumns({"id": F.concat_ws("->", "source", "target"), "status": F.when(F.col("trigger") == "error", "planned").otherwise("implemented")})


def initial_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return steps(spark, sf_dir).where("pos = 1").select("model_id", "state")


#: The same tables for the oracle.
SQL = """
st AS (SELECT user_id AS model_id, event_id, ts, event_type, event_type || '|' || CAST(CAST(floor(coalesce(value, 0) / 50) AS INT) AS VARCHAR) AS state, CAST(props->>'$.k' AS INT) AS k FROM events),
steps AS (SELECT *, lead(state) OVER w AS target, lead(event_type) OVER w AS trigger_, row_number() OVER w AS pos FROM st WINDOW w AS (PARTITION BY model_id ORDER BY ts, event_id)),
t AS (SELECT model_id, state AS source, trigger_ AS "trigger", target, count(*)::BIGINT AS n, min(k) AS lo, max(k) AS hi, state || '->' || target AS id, CASE WHEN trigger_ = 'error' THEN 'planned' ELSE 'implemented' END AS status FROM steps WHERE target IS NOT NULL GROUP BY 1, 2, 3, 4),
init AS (SELECT model_id, state FROM steps WHERE pos = 1)
"""
