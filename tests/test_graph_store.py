"""All-or-nothing writes, and documents by content."""


from statewake.sources import graph_store
from statewake.sources.graph_store import GraphStore, RenderedDocuments

LABELS = ("Endpoint", "SecurityScheme", "DeclaredOutcome", "Check", "Class", "Enum")


def tuples(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def test_one_illegal_row_leaves_all_tables_as_they_were(spark, tmp_path):
    make = lambda rows, kind: spark.createDataFrame(rows, kind)
    store = GraphStore(spark, str(tmp_path / "g"), LABELS)
    nodes = make([("e1", "Endpoint", "GET /a", "{}"), ("o1", "DeclaredOutcome", "200", "{}"), ("o1", "DeclaredOutcome", "200", "{}"), ("n1", "Enum", "K", "{}")], graph_store.NODES)
    edges = make([("e1", "Endpoint", "DECLARES", "o1", "DeclaredOutcome")] * 2, graph_store.EDGES)
    found = make([("f1", "e1", "unguarded", "")], graph_store.FINDINGS)
    assert store.write(nodes, edges, found) == {"version": 1, "nodes": 3, "edges": 1, "findings": 1, "rejected": 0}
    before = {t: tuples(store.read(t), *store.read(t).columns) for t in ("nodes", "edges", "findings")}
    more = make([("e2", "Endpoint", "GET /b", "{}"), ("c1", "Class", "C", "{}")], graph_store.NODES)
    none = make([], graph_store.FINDINGS)
    bad = {
        "not in the catalogue": (more, make([("e2", "Endpoint", "OF_TYPE", "c1", "Class")], graph_store.EDGES), none), "no target": (more, make([("e2", "Endpoint", "DECLARES", "gone", "DeclaredOutcome")], graph_store.EDGES), none),
        "another label": (more, make([("o1", "Endpoint", "DECLARES", "o1", "DeclaredOutcome")], graph_store.EDGES), none), "unknown label": (make([("x", "Method", "m", None)], graph_store.NODES), make([], graph_store.EDGES), none),
        "no id": (make([(" ", "Check", "m", None)], graph_store.NODES), make([], graph_store.EDGES), none), "two labels": (make([("z", "Check", "m", None), ("z", "Class", "m", None)], graph_store.NODES), make([], graph_store.EDGES), none),
        "no subject": (more, make([], graph_store.EDGES), make([("f2", "gone", "k", "")], graph_store.FINDINGS)),
    }
    for reason, plan in bad.items():
        assert reason in {r.reason for r in store.rejects(*plan).collect()}
        assert store.write(*plan)["rejected"] > 0 and store.tables.version() == 1
        assert {t: tuples(store.read(t), *store.read(t).columns) for t in before} == before
    # an enum may stand where a class may, and stored nodes serve new edges
    good = make([("c1", "Class", "OF_TYPE", "n1", "Enum"), ("e1", "Endpoint", "DECLARES", "o1", "DeclaredOutcome")], graph_store.EDGES)
    assert store.write(more, good) == {"version": 2, "nodes": 2, "edges": 2, "findings": 0, "rejected": 0}
    assert store.read("nodes").count() == 5 and store.read("edges").count() == 2 and store.read("nodes", 1).count() == 3
    renamed = make([("e1", "Endpoint", "GET /new", "{}")], graph_store.NODES)
    store.write(renamed, edges.limit(0))
    assert ("e1", "GET /new") in tuples(store.read("nodes"), "id", "name") and store.read("nodes").count() == 5
    assert store.write(nodes.limit(0), edges.limit(0))["version"] == 3


def test_documents_that_only_differ_in_time_are_not_written(spark, tmp_path):
    docs = RenderedDocuments(spark, str(tmp_path / "d"))
    make = lambda rows: spark.createDataFrame(rows, "path string, text string")
    assert docs.render(make([("a", "# A\nGenerated at 2020\nx"), ("b", None), ("a", "# A\nGenerated at 2019\nx"), (None, "z")]), "t1") == {"new": 2, "changed": 0, "unchanged": 0}
    assert docs.render(make([("a", "# A\nGenerated at 2024\nx")]), "t2") == {"new": 0, "changed": 0, "unchanged": 1} and docs.tables.version() == 1
    assert docs.render(make([("a", "# A\nGenerated at 2024\ny"), ("c", "c")]), "t3") == {"new": 1, "changed": 1, "unchanged": 0}
    assert tuples(docs.read(), "path", "text", "rendered_at") == [("a", "# A\nGenerated at 2024\ny", "t3"), ("b", "", "t1"), ("c", "c", "t3")]
    assert docs.render(make([]), "t4") == {"new": 0, "changed": 0, "unchanged": 0}
