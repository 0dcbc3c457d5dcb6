"""The pipeline on the smallest tables, stage by stage."""

import corpus_pipeline
from statewake.llm import decontaminate, near_dup, quality_rules, source_mix, token_store
from statewake.llm.common import Scratch, table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs, scratch = table(spark, SF, "documents"), Scratch(spark, "test")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, scratch.write(stage(spark, docs, SF), name)
        seen[name] = (before, docs)
        assert name == "tokens" or docs.columns == columns
    ids = lambda df: {r[0] for r in df.select("doc_id").collect()}
    assert ids(seen["quality"][1]) == ids(quality_rules.quality_rules(seen["quality"][0]).where("kept"))
    assert ids(seen["dedup"][1]) == ids(near_dup.near_duplicates(seen["dedup"][0]).where("kept"))
    bench = [decontaminate.folded(r.text) for r in table(spark, SF, "benchmark").collect()]
    clean = {r.doc_id for r in seen["decontaminate"][0].collect() if not any(t in decontaminate.folded(r.text) for t in bench)}
    assert ids(seen["decontaminate"][1]) == clean
    taken = {r.doc_id: r.taken / r.size for r in source_mix.mix_sources(seen["mix"][0]).where("size > 0").collect()}
    copies = {r.doc_id: r["count"] for r in seen["mix"][1].groupBy("doc_id").count().collect()}
    assert all(abs(copies.get(d, 0) - x) < 1 for d, x in taken.items())
    tokens = seen["tokens"][1].collect()
    assert len(tokens) == seen["mix"][1].count() and max(r.start + r.n_tokens for r in tokens) == sum(r.n_tokens for r in tokens)
    encoder = token_store.WordTokenizer(token_store.default_tokenizer())
    texts = {r.doc_id: r.text for r in seen["mix"][1].collect()}
    assert all(r.n_tokens == len(encoder.encode([texts[r.doc_id]])[0]) + 1 for r in tokens)


def test_stages_on_odd_rows(spark, odd_docs, no_docs):
    for rows in (odd_docs, no_docs):
        docs, scratch = rows, Scratch(spark, "test")
        for name, stage in corpus_pipeline.STAGES:
            docs = scratch.write(stage(spark, docs, SF), name)
            assert name == "tokens" or docs.columns == rows.columns
            if name == "quality":  # null, blank and short texts go, repeated rows do not
                assert sorted(str(r.doc_id) for r in docs.collect()) == (sorted(["1", "1", "2", "6", "None", "50"]) if rows is odd_docs else [])
            if name == "dedup":  # one of the para's copies, whatever its case, and the long text
                assert sorted(r.doc_id for r in docs.collect()) == ([1, 6] if rows is odd_docs else [])
        assert set(docs.columns) == {"doc_id", "start", "n_tokens", "ids_crc32"} and (docs.count() > 0) == (rows is odd_docs)
