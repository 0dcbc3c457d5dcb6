"""Spelling variants against brute force, and on odd rows."""

import collections
import random
import re
import zlib

from statewake.llm import spelling
from statewake.llm.common import Scratch


def distance_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_force(docs, damage=97, min_length=5, min_count=3, ratio=2):
    counts = collections.Counter()
    for doc_id, text in docs:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[a-zÀ-ÿ]+", lower):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % damage == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= min_length and n >= min_count}
    forms, out = {}, []
    for w, n in words.items():
        near = [x for x in words if distance_one(w, x)]
        best = min(near, key=lambda x: (-words[x], x), default=None)
        forms[w] = best if best and words[best] >= ratio * n else None
        out.append((w, n, len(near)))
    def root(w):
        while forms[w]:
            w = forms[w]
        return w
    return sorted((w, forms[w], root(w), n, k, words[forms[w]] if forms[w] else None) for w, n, k in out)


def got(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def made(seed, n_docs=60):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abé") for _ in range(rng.randint(4, 7))) for _ in range(40)] + ["ÀÿØ÷×éè", "Größe", "größe", "x" * 64, "x" * 65, "x" * 66, "x" * 63 + "y", "x" * 64 + "y", "y" * 200, "y" * 199 + "z", "y" * 199]
    weights = [2 ** (i % 8) for i in range(len(stems))]
    text = lambda: " ".join(rng.choices(stems, weights)[0] + rng.choice(["", ".", ",", "1", "日", "😀", "-x"]) for _ in range(120))
    return [(i if i % 7 else None, text() if i % 11 else None) for i in range(n_docs)]


def test_like_brute_force(spark):
    for seed, damage in ((1, 97), (2, 5), (3, 2)):
        docs = made(seed)
        df = spelling.spelling_variants(spark.createDataFrame(docs, "doc_id long, text string"), damage=damage)
        want = brute_force(docs, damage)
        assert got(df) == want
        assert any(w[1] for w in want) and any(len(w[0]) > 64 and w[4] for w in want)


def test_chains_of_forms(spark):
    """A chain of forms longer than a few rounds ends at its root; ties go to the smallest word."""
    chain, text = ["a" * 5 + "b" * i for i in range(12)], []
    for i, w in enumerate(chain):
        text += [w] * (3 * 2**i)
    text += ["zzzzza", "zzzzzb", "zzzzzc"] * 3 + ["zzzzzd", "zzzzze"] * 6
    docs = [(1, " ".join(text))]
    found = got(spelling.spelling_variants(spark.createDataFrame(docs, "doc_id long, text string"), damage=None))
    assert all(r[2] == chain[-1] for r in found if r[0] in chain)
    assert [r[1] for r in found if r[0].startswith("z")] == ["zzzzzd"] * 3 + [None, None]


def test_distinct_deletions_and_single_keys():
    """Every pair at distance one shares exactly one key; equal deletions are made once."""
    import itertools

    import numpy as np

    words = ["".join(w) for n in (2, 3, 4, 5) for w in itertools.product("ab", repeat=n)]
    keys = {}
    for w in words:
        k, distinct = spelling.deletion_keys(np.frombuffer(w.encode(), np.uint8).reshape(1, -1))
        keys[w] = k[distinct].tolist()
        assert len(set(keys[w])) == len(keys[w]) == 1 + len({w[:i] + w[i + 1 :] for i in range(len(w))})
    for a, b in itertools.combinations(words, 2):
        shared = len(set(keys[a]) & set(keys[b]))
        assert shared == 1 if distance_one(a, b) else shared <= 2


def test_long_runs_take_linear_work(spark):
    run = "ab" * 150_000
    docs = [(i, f"{run} {run}c {run[:-1]}") for i in range(3)]
    found = got(spelling.spelling_variants(spark.createDataFrame(docs, "doc_id long, text string"), damage=None))
    assert [(len(r[0]), r[4]) for r in found] == [(299_999, 1), (300_000, 2), (300_001, 1)]


def test_odd_rows(spark, odd_docs, no_docs):
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert got(spelling.spelling_variants(odd_docs)) == brute_force(docs)
    assert got(spelling.spelling_variants(no_docs)) == []
    assert got(spelling.spelling_variants(odd_docs.withColumnRenamed("doc_id", "word").withColumnRenamed("text", "form"), id_col="word", text_col="form")) == brute_force(docs)


def test_roots_of_nothing(spark):
    forms = spark.createDataFrame([], "word string, form string")
    assert spelling.roots(forms, Scratch(spark, "test")).collect() == []
