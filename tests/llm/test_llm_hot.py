"""One payload, and one line, on most rows: joins that spread hot keys give the rows of plain ones."""

import hashlib

import duckdb
import pytest

from statewake.llm import common, quality_rules, warc_store
from statewake.llm.common import Scratch, salted_join
from statewake.llm.components import connected_components

PAGES = "page_id long, url string, html string"


@pytest.fixture
def hot(monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    monkeypatch.setattr(common, "HOT_KEYS", 50)


def plan(df):
    return df._jdf.queryExecution().toString()


def test_salted_join(spark, hot):
    rows = spark.createDataFrame([(i, "hot" if i % 5 else f"k{i}") for i in range(200)], "i int, k string")
    keyed = rows.groupBy("k").count().withColumn("v", rows.groupBy("k").count()["k"])
    df = salted_join(rows, keyed, ["k"], "count", ["i"], 200)
    assert sorted((r.i, r.k, r.v) for r in df.collect()) == sorted((r.i, r.k, r.k) for r in rows.collect()) and df.columns == ["k", "i", "v"]
    assert "_parts" in plan(df)


def test_one_payload_on_most_pages(spark, hot):
    html = "<p>" + "same " * 50 + "</p>"
    pages = [(i, f"u{i}", html if i % 4 else ("" if i % 8 else f"<p>{i}</p>" * 20)) for i in range(100)] + [(None, "x", html), (None, "y", html)]
    df = spark.createDataFrame(pages, PAGES)
    headers, payloads = warc_store.write_archive(df, Scratch(spark, "hot"))
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc_store.read_archive(headers, payloads).collect()), key=repr)
    first = {}
    for i, _, h in pages:
        if i is not None:
            first.setdefault(h, i)
    want = []
    for i, _, h in pages:
        again = len(h) >= 100 and i != first[h]
        want.append((i, len(h), hashlib.sha256(h.encode()).hexdigest(), "revisit" if again else "response", first[h] if again else None))
    assert got == sorted(want, key=repr) and payloads.count() == len({h for *_, h in pages})
    assert "_parts" in plan(warc_store.records(headers, payloads))


def test_one_line_on_most_documents(spark, hot, tmp_path):
    texts = [(i, "shared line of the host\n" * (i % 7 > 0) + "\n".join(f"word{i}x{j} and more words of it" for j in range(12)), "en", f"s{i % 2}", 0) for i in range(150)]
    df = spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long")
    df.coalesce(1).write.parquet(str(tmp_path / "documents"))
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{tmp_path}/documents/*.parquet'")
    cur = c.execute(quality_rules.SQL)
    names = [x[0] for x in cur.description]
    got = quality_rules.quality_rules(df).select(*names)
    assert sorted(map(tuple, got.collect())) == sorted(cur.fetchall()) and got.where("removed_words > 0").count() > 100


def test_rounds_end_with_stars(spark, hot):
    class Counted(Scratch):
        def write(self, df, name):
            names.append(name)
            return super().write(df, name)

    kind = "a long, b long"
    stars, chain = [(i, i % 3) for i in range(3, 40)], [(i, i + 1) for i in range(100, 109)]
    for edges, most in (([], 1), (stars, 1), (stars + chain + [(7, 7), (1, 4)], 9)):
        names = []
        got = {(r.node, r.component) for r in connected_components(spark.createDataFrame(edges, kind), Counted(spark, "stars"), "x").collect()}
        want = {(i, i % 3) for i in range(3, 40)} if edges else set()
        want |= {(i, 100) for i in range(101, 110)} if most > 1 else set()
        assert got == want and len(names) <= most, names
