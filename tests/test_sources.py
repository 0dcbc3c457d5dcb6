"""Readers, writers and streams."""

import json

import pytest
from pyspark.sql import functions as F

from statewake.operators import design
from statewake.sources import readers, writers
from statewake.streaming import claims


def put(path, text):
    path.write_text(text)
    return str(path)


def test_model_file(spark, tmp_path):
    model = {"id": "m", "states": [{"id": "A", "name": "a", "is_initial": True}, {"id": "B", "name": "b"}], "transitions": [{"id": "t1", "source": "A", "trigger": "x", "target": "B"}, {"id": "t2", "source": "A", "trigger": "y", "target": "Z"}]}
    states, moves, rejects = readers.model_file(spark, put(tmp_path / "m.json", json.dumps(model)))
    assert states.count() == 2 and {r.lifecycle_state for r in states.collect()} == {"Quarantine"}
    assert [(r.id, r.implementation_status) for r in moves.collect()] == [("t1", "implemented")]
    assert [r.reason for r in rejects.collect()] == ["target state Z is not in this model"]


def test_questions(spark, tmp_path):
    assert sorted(map(tuple, readers.questions(spark, put(tmp_path / "q.tsv", "# note\n\nwhat is it\tD-1\nwho\tD-2\n")).collect())) == [("what is it", "D-1"), ("who", "D-2")]
    with pytest.raises(Exception, match="not question"):
        readers.questions(spark, put(tmp_path / "b.tsv", "no tab here\n")).collect()


def test_markdown_round_trip(spark, tmp_path):
    row = spark.createDataFrame([("R-1", "a | b\nc")], "id string, text string").select(writers.markdown_row(F.col("id"), F.col("text"))).first()[0]
    good, bad = readers.markdown_table(spark, put(tmp_path / "t.md", f"# Top\n\n## Risks\n\n| id | text |\n|---|---|\n{row}\n| oops | x |\n\n## Other\n| R-9 | no |\n"), "Risks", ["id", "text"])
    assert [tuple(r) for r in good.collect()] == [("R-1", "a | b c")] and bad.count() == 1


def test_text_readers(spark, tmp_path):
    ac = readers.acceptance_criteria(spark, put(tmp_path / "spec.md", "# S\n### AC-1: first\nrule\n### AC-2: second\n## End\nx\n"))
    assert [(r.number, r.text) for r in ac.orderBy("pos").collect()] == [(1, "first rule"), (2, "second")]
    assert [r.text.split("\n")[0] for r in readers.passages(spark, put(tmp_path / "l.md", "intro\n## One\nx\n## Two\ny\n")).orderBy("pos").collect()] == ["intro", "## One", "## Two"]
    steps = readers.feature_steps(spark, put(tmp_path / "f.feature", "Feature: F\n  Scenario: one\n    Given a\n    When b\n  Scenario: two\n    Then c\n"))
    assert [(r.scenario, r.keyword, r.text) for r in steps.orderBy("scenario_no", "line_no").collect()] == [("one", "Given", "a"), ("one", "When", "b"), ("two", "Then", "c")]


def test_openapi_and_tracker(spark, tmp_path):
    doc = {"openapi": "3.0.0", "paths": {"/a/{id}": {"get": {"operationId": "getA", "responses": {"404": {"description": "x"}, "200": {"description": "y"}}, "parameters": [{"name": "id", "in": "path", "required": True}]}}}}
    r = readers.openapi_endpoints(spark, put(tmp_path / "o.json", json.dumps(doc))).first()
    assert (r.verb, r.route, r.operation, r.statuses) == ("GET", "/a/{id}", "getA", ["200", "404"]) and r.parameters[0]["in"] == "path"
    p = spark.createDataFrame([(" Blocker", "<p>a &amp; b</p>c<br>d"), (None, None)], "p string, m string").select(readers.normal_priority(F.col("p")), readers.plain_text(F.col("m"))).collect()
    assert [tuple(x) for x in p] == [("critical", "a & b c d"), (None, None)]


def test_snapshot(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "State", "n"), ("b", "Transition", "m")], "id string, label string, name string")
    edges = spark.createDataFrame([("a", "WHEN", "b")], "src string, rel_type string, dst string")
    writers.export_snapshot(nodes, edges, str(tmp_path / "s"), commit="c1")
    n, e = writers.restore_snapshot(spark, str(tmp_path / "s"), commit="c1")
    assert n.count() == 2 and e.count() == 1
    with pytest.raises(ValueError, match="commit"):
        writers.restore_snapshot(spark, str(tmp_path / "s"), commit="c2")
    legal = spark.createDataFrame([("State", "WHEN", "Transition")], "src_label string, rel_type string, dst_label string")
    rows = spark.createDataFrame([("State", "WHEN", "Transition", 1), ("State", "HAS", "Page", 2)], "src_label string, rel_type string, dst_label string, n int")
    assert [r.n for r in design.illegal_edges(rows, legal).collect()] == [2]


def test_streams(spark, tmp_path):
    rows = [(1, 1, "a", "2024-01-01 00:00:00"), (1, 2, "a", "2024-01-01 00:10:00"), (1, 3, "b", "2024-01-01 02:00:00"), (2, 4, "a", "2024-01-01 00:05:00")]
    spark.createDataFrame(rows, "user_id long, event_id long, event_type string, ts string").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user_id long, event_id long, event_type string, ts timestamp").parquet(str(tmp_path / "in"))
    for name, df, mode in (("rev", claims.revisions(stream), "append"), ("win", claims.outcome_windows(stream), "complete"), ("ses", claims.sessions(stream), "append")):
        df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start().awaitTermination(60)
    assert sorted((r.user_id, r.text, r.revision) for r in spark.table("rev").collect()) == [(1, "a", 1), (1, "b", 2), (2, "a", 1)]
    assert sum(r.n for r in spark.table("win").collect()) == 4
    assert sorted((r.user_id, r.n) for r in spark.table("ses").collect()) == [(1, 2), (2, 1)]
