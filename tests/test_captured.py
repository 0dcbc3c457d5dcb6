"""Captured pages and checkouts as data sources."""

import json

import pytest
from pyspark.sql import functions as F

from statewake.sources import captured


@pytest.fixture
def sources(spark, tmp_path):
    captured.register(spark)
    return lambda kind: spark.read.format(kind).option("path", str(tmp_path)).load()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_checkout(sources, tmp_path):
    for name, text in {"src/a.py": "x = 1\n", "src/deep/b.py": "", "docs/c.md": "ü", "Makefile": "all:", ".git/HEAD": "ref", "src/_tmp/x.py": "no", "bin/d.bin": b"\xff\x00"}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(text if isinstance(text, bytes) else text.encode())
    df = sources("checkout")
    assert sorted((r.path, r.folder, r.extension, r.size) for r in df.collect()) == [("Makefile", "", "", 4), ("bin/d.bin", "bin", "bin", 2), ("docs/c.md", "docs", "md", 2), ("src/a.py", "src", "py", 6), ("src/deep/b.py", "src", "py", 0)]
    some = df.where(F.col("extension").isin("py", "md") & F.col("path").startswith("src/") & (F.col("size") > 0))
    assert [r.path for r in some.collect()] == ["src/a.py"]
    # what the listing decides is no filter of the plan any more
    assert "size" in plan(some) and "StartsWith" not in plan(some).split("PythonDataSource")[0] and "isin" not in plan(some)
    reader = captured.CheckoutReader(str(tmp_path))
    from pyspark.sql.datasource import EqualTo, GreaterThan

    size = GreaterThan(("size",), 0)
    assert list(reader.pushFilters([EqualTo(("folder",), "src"), size])) == [size] and [p for x in reader.partitions() for p in x.paths] == ["src/a.py", "src/deep/b.py"]


def test_partitions_are_bounded(tmp_path, monkeypatch):
    monkeypatch.setattr(captured, "FILES_EACH", 2)
    monkeypatch.setattr(captured, "BYTES_EACH", 10)
    for i, n in enumerate([3, 3, 3, 50, 1, 9, 2]):
        (tmp_path / f"f{i}").write_text("x" * n)
    assert [x.paths for x in captured.CheckoutReader(str(tmp_path)).partitions()] == [["f0", "f1"], ["f2"], ["f3"], ["f4", "f5"], ["f6"]]


def test_lines_of_a_file_are_not_held_together(spark, sources, tmp_path, monkeypatch):
    page = lambda i: json.dumps({"issues": [{"key": f"{i}-{k}", "fields": {"description": "ü" * 1_000, "labels": ["x"]}} for k in range(5)]})
    (tmp_path / "jira").mkdir()
    (tmp_path / "jira/all.json").write_text("\n\n".join(map(page, range(3_000))) + "\r" + page(3_000) + "\n \n")
    df = sources("tracker_pages")
    assert df.select("key").distinct().count() == 5 * 3_001 and df.where("length(description) = 1000 and size(labels) = 1").count() == 5 * 3_001
    import tracemalloc

    monkeypatch.setattr(captured, "SIZE_AT_ONCE", 1 << 20, raising=False)
    reader = captured.TrackerPages({"path": str(tmp_path)}).reader(df.schema)
    (files,) = reader.partitions()
    tracemalloc.start()
    n = sum(getattr(b, "num_rows", 1) for b in reader.read(files))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 5 * 3_001 and peak < (tmp_path / "jira/all.json").stat().st_size / 2


def test_tracker_pages_and_documents(spark, sources, tmp_path):
    jira = {"issues": [{"key": "AB-1", "fields": {"summary": "S", "issuetype": {"name": "Bug"}, "status": {"name": "In Review"}, "priority": {"name": "P4"}, "labels": ["x", "x", 3], "created": "2020", "updated": "2021", "description": {"type": "doc"}}}, {"id": 7, "fields": {"summary": None, "status": "Awaiting Signoff"}}]}
    for name, text in {"jira/1.json": json.dumps(jira, indent=1), "system=confluence/p.json": json.dumps({"results": [{"id": "9", "title": "T", "body": {"storage": {"value": "<p>t</p>"}}}]}) + "\n\n" + json.dumps({"results": []}), "zephyr/z.json": json.dumps({"values": [{"key": "T-1", "name": "N", "objective": "o", "priority": {"name": "Normal"}}]})}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    df = sources("tracker_pages")
    assert {(r.system, r.key, r.item_type) for r in df.collect()} == {("jira", "AB-1", "Bug"), ("jira", "7", None), ("confluence", "9", "page"), ("zephyr", "T-1", "test case")}
    one = df.where("system = 'zephyr'")
    assert [r.key for r in one.collect()] == ["T-1"] and " Filter " not in plan(one)
    docs = {r.id: r for r in captured.intake_documents(df, "now").collect()}
    a, b = docs["jira:AB-1"], docs["jira:7"]
    assert (a.scope.primary_type, a.metadata.priority, a.metadata.status.summary_status, a.metadata.labels, a.scope.created_at) == ("defect", "optional", "active", ["x"], "2020") and json.loads(a.metadata.description) == {"type": "doc"}
    assert (b.scope.primary_type, b.metadata.priority, b.metadata.status.summary_status, b.facts[0].value, b.scope.created_at) == ("task", None, None, "Awaiting Signoff", "now") and docs["confluence:9"].facts == []
