"""Search, embedding by label and the refusal of other models."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from statewake.operators import search

CORPUS = "item long, parent long, label string, text string"


def made(seed, n=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(30)]
    text = lambda k: " ".join(rng.choices(words, [2**-(i % 9) for i in range(30)], k=k))
    return [(i, i // 3, rng.choice("ab"), text(rng.randint(0, 12)) if i % 17 else None) for i in range(n)], [(i, text(3)) for i in range(8)]


def plain(corpus, queries, k, factor=3):
    docs = {i: re.findall("[a-z0-9]+", (t or "").lower()) for i, _, _, t in corpus}
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    out = []
    for q, text in queries:
        terms = set(re.findall("[a-z0-9]+", text.lower()))
        df = {t: sum(t in d for d in docs.values()) for t in terms}
        score = {i: round(sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * d.count(t) * 2.2 / (d.count(t) + 1.2 * (0.25 + 0.75 * len(d) / avg)) for t in terms if t in d), 6) for i, d in docs.items() if terms & set(d)}
        keyword = sorted(score, key=lambda i: (-score[i], i))[: k * factor]
        vec = dict(zip(docs, search.hashed_features([t or "" for *_, t in corpus])))
        v = search.hashed_features([text])[0]
        near = []
        for label in "ab":
            mine = [(round(float(v @ vec[i] / math.sqrt((v @ v) * (vec[i] @ vec[i]))), 6), i) for i, _, x, _ in corpus if x == label and vec[i].any()]
            near += [(-s, label, i) for s, i in sorted(mine, key=lambda p: (-p[0], p[1]))[: k * factor]]
        vector = [i for *_, i in sorted(near)[: k * factor]]
        fused = {}
        for side in (keyword, vector):
            for pos, i in enumerate(side):
                fused[i] = fused.get(i, 0) + 1 / (61 + pos)
        parent = {}
        for i, s in fused.items():
            parent[i // 3] = max(parent.get(i // 3, 0), round(s, 9))
        out += [(q, p, r, s) for r, (p, s) in enumerate(sorted(parent.items(), key=lambda x: (-x[1], x[0]))[:k], 1)]
    return sorted(out)


def test_search_like_plain_python(spark):
    for seed in (1, 2):
        corpus, queries = made(seed)
        df, left_out = search.embed(spark.createDataFrame(corpus, CORPUS), search.hashed_features, "hashed")
        assert left_out.count() == 0 and df.count() == len(corpus)
        got = search.search(df, spark.createDataFrame(queries, "q_id long, text string"), search.hashed_features, "hashed", k=4)
        assert sorted((r.q_id, r.parent, r.rank, r.score) for r in got.collect()) == plain(corpus, queries, 4)
        assert {r.sources for r in got.collect()} >= {"keyword+vector"}


def test_a_label_is_embedded_whole_or_not(spark):
    rows = spark.createDataFrame([(1, 1, "a", "x"), (2, 2, "a", "bad"), (3, 3, "b", "y"), (4, 4, None, "z")], CORPUS)

    def provider(texts):
        return np.array([[np.nan if t == "bad" else 1.0, 0.0] for t in texts])

    kept, left_out = search.embed(rows, provider, "m", width=2)
    assert sorted(r.item for r in kept.collect()) == [3, 4] and [(r.label, r.reason) for r in left_out.collect()] == [("a", "1 rows without a vector")]
    kept, left_out = search.embed(rows, provider, "m", width=3)
    assert kept.count() == 0 and left_out.count() == 3


def test_other_models_are_refused(spark):
    rows = spark.createDataFrame([(1, 1, "a", "x"), (2, 2, "b", "y")], CORPUS)
    q = spark.createDataFrame([(1, "x")], "q_id long, text string")
    good, _ = search.embed(rows, search.hashed_features, "hashed")
    two = good.withColumn("embedding_model", F.when(F.col("item") == 1, "other").otherwise("hashed"))
    none = good.withColumn("embedding", F.lit(None).cast("array<double>"))
    narrow = good.withColumn("embedding", F.slice("embedding", 1, 5))
    for df, says in ((two, "several"), (none, "no vectors"), (good.withColumn("embedding_model", F.lit("other")), "of model other"), (narrow, "widths")):
        with pytest.raises(ValueError, match=says):
            search.search(df, q, search.hashed_features, "hashed")
    assert search.provider_of("statewake.operators.search:hashed_features") is search.hashed_features
    with pytest.raises(ValueError):
        search.provider_of("statewake.operators.search:nothing")
