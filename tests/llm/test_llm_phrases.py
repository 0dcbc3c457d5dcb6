"""Collocations against brute force, and on odd rows."""

import collections
import random
import re

import numpy as np
import pytest

from statewake.llm import collocations


def pieces(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for p in re.split("[.,;:!?\x0a-\x0d]", lower) if (w := re.findall("[^\x20\x09]+", p))]


def occurrences(texts):
    f = collections.Counter()
    for text in texts:
        for words in pieces(text):
            for k in (1, 2, 3):
                f.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    return f


def brute_force(docs, min_count=10, covered=50, top=2000):
    out, by_lang = [], collections.defaultdict(list)
    for lang, text in docs:
        by_lang["und" if lang is None else lang].append(text)
    for lang, texts in by_lang.items():
        f = occurrences(texts)
        n, rows = sum(c for p, c in f.items() if len(p) == 1), []
        frequent = {p: c for p, c in f.items() if len(p) > 1 and c >= min_count}
        for p, a in frequent.items():
            if any(len(q) == 3 and len(p) == 2 and p in (q[:2], q[1:]) and 100 * c >= covered * a for q, c in frequent.items()):
                continue
            score, _, left, right = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def made(seed, n=40, words=None):
    rng = random.Random(seed)
    words = words or ["The", "the", "of", "Ünder", "日本", "x\x00y", "a-b", "'s", "über", *"abcdefgh"]
    glue = [" "] * 12 + ["  ", "\t", ". ", ",", "\n", "\x0b", "; "]
    text = lambda: "".join(rng.choice(words) + rng.choice(glue) for _ in range(rng.randint(0, 200)))
    return [(rng.choice(["en", "de", "und", None]), None if i % 13 == 0 else text()) for i in range(n)]


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("size, words", [(1 << 16, None), (7, None), (1 << 16, ["a"]), (3, ["a", "b"])])
def test_bitmaps_count_like_plain_words(monkeypatch, size, words):
    """Popcounts of extended bitmaps are the phrases' occurrences, whatever the slice."""
    monkeypatch.setattr(collocations, "SLICE", size)
    texts = [t for _, t in made(3, words=words) if t]
    want = occurrences(texts)
    shard = collocations.Shard([t.encode().translate(collocations.PREPARED) for t in texts])
    assert {w.decode(): n for w, n in zip(shard.words, shard.counts().tolist())} == {p[0]: n for p, n in want.items() if len(p) == 1}
    for length in (2, 3, 4):
        found = collections.Counter()
        for cols, counts in shard.phrases(length):
            for *p, n in zip(*cols, counts.tolist()):
                found[tuple(shard.words[i].decode() for i in p)] += n
        plain = collections.Counter()
        for t in texts:
            for ws in pieces(t):
                plain.update(tuple(ws[i : i + length]) for i in range(len(ws) - length + 1))
        assert found == plain


def test_filter_keeps_all_pairs(spark, monkeypatch):
    """No pair of the filter is lost, even when it is far too small."""
    rng = np.random.default_rng(1)
    pairs = spark.createDataFrame([(int(a), int(b)) for a, b in rng.integers(-(1 << 63), 1 << 63, (3000, 2))], "a long, b long")
    for most in (1 << 28, 1 << 10):
        monkeypatch.setattr(collocations, "MOST_FILTER_BITS", most)
        bits = collocations.pair_filter(pairs, 3000)
        assert len(bits) * 64 == min(most, 1 << 16)
        a, b = (np.array([r[i] for r in pairs.collect()]) for i in (0, 1))
        for x, y, all_in in ((a, b, True), (b, a, False)):
            ids, n = np.concatenate([x, y]), len(x)
            held = len(collocations.frequent_pairs(bits, ids)(np.arange(n), np.arange(n) + n))
            assert held == n if all_in or most == 1 << 10 else held < 0.05 * n


@pytest.mark.parametrize("seed, shard_words, top", [(1, 2_000_000, 2000), (2, 150, 5)])
def test_like_brute_force(spark, monkeypatch, seed, shard_words, top):
    docs = made(seed, 300)
    df = spark.createDataFrame(docs, "lang string, text string").repartition(3)
    if top == 5:
        monkeypatch.setattr(collocations, "MOST_FILTER_BITS", 1 << 10)
    want = brute_force(docs, top=top)
    assert got(collocations.collocations(df, shard_words=shard_words, top=top)) == want and len({r[0] for r in want}) == 3 and (top == 5 or any(r[2].count(" ") == 2 for r in want))


def test_products_above_64_bits(spark):
    """A count of 3e12 squared, times a million, has 43 bits more than a long."""
    row = spark.createDataFrame([(3 * 10**12, 4 * 10**12, 5 * 10**12)], "a long, l long, r long").select(collocations._score("a", "l", "r").alias("s")).first()
    assert row.s == 10**6 * (3 * 10**12) ** 2 // (4 * 10**12 * 5 * 10**12)


def test_odd_rows(spark, odd_docs, no_docs):
    docs = [(r.lang, r.text) for r in odd_docs.collect()]
    assert got(collocations.collocations(odd_docs, min_count=2)) == brute_force(docs, min_count=2)
    assert got(collocations.collocations(no_docs)) == []
    renamed = odd_docs.drop("rep", "key").withColumnRenamed("lang", "rep").withColumnRenamed("text", "key")
    assert got(collocations.collocations(renamed, lang_col="rep", text_col="key", min_count=2)) == brute_force(docs, min_count=2)
