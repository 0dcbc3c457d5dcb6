"""License scans against plain containment of all blocks, and on odd rows."""

import random
import re

from statewake.llm import license_scan


def plain_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_force(text, templates=license_scan.TEMPLATES, share=(4, 5), notice=20, window=256):
    words = plain_words(text)
    places = []
    for phrase, label in license_scan.PHRASES:
        p = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    blocks = [(0, w) for line in (text or "").split("\n") if (w := plain_words(line))]
    if words:
        blocks += [(1, words[i : i + window]) for i in range(0, max(len(words) - window // 2, 1), window // 2)]
    labels, score, hits = set(), 0.0, set()
    for k, (is_window, block) in enumerate(blocks):
        good = []
        for label, t in templates:
            t = set(plain_words(t))
            common = len(t & set(block))
            if common * share[1] >= share[0] * len(t) if len(t) >= notice else common == len(t) and not is_window:
                good.append((label, t, common))
        for label, t, common in good:
            if not any(t < other for _, other, _ in good):
                labels.add(label)
                score = max(score, common / len(t))
                hits.add(k)
    at, base = [i for i, _ in places], {x for _, x in places}
    return (len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), score, len(hits))


COLS = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_blocks"]


def got(df, id_col="doc_id"):
    return sorted(((r[id_col], *(r[c] for c in COLS)) for r in df.collect()), key=repr)


def made(seed, n=60):
    rng = random.Random(seed)
    vocabulary = sorted({w for _, t in license_scan.TEMPLATES for w in plain_words(t)}) + ["größe", "日本", "Straße", "x1"]
    out = []
    for _ in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([0, 5, 50, 700]))]
        for _ in range(rng.randint(0, 3)):
            t = rng.choice(license_scan.TEMPLATES)[1].split(" ")
            t = [w for w in t if rng.random() > rng.choice([0, 0.1, 0.25])]
            at = rng.randint(0, len(words))
            words[at:at] = ["\n", *t, "\n"] if rng.random() < 0.5 else t
        out.append("".join(w + rng.choice([" ", " ", " ", ", ", "\n"] if rng.random() < 0.2 else [" "]) for w in words))
    return out


def test_like_brute_force(spark):
    texts = made(1) + ["GNU\nGeneral, Public-License! (mit license) MIT License cc by", None, "", "MIT licenses", "Licensed under CC BY-NC 4.0."]
    df = license_scan.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    want = sorted(((i, *brute_force(t)) for i, t in enumerate(texts)), key=repr)
    assert got(df) == want and sum(bool(w[8]) for w in want) > 20 and any(0.8 <= w[7] < 1 for w in want) and any(w[7] == 0 and w[1] for w in want)


def test_wrapped_passages_and_notices(spark):
    mit = next(t for label, t in license_scan.TEMPLATES if label == "mit" and len(t) > 100)
    wrapped = "\n".join(" ".join(mit.split()[i : i + 9]) for i in range(0, 80, 9))
    texts = [("word " * 3000) + "\n" + wrapped + "\n" + ("word " * 3000), "Released under the MIT License.", "released text, under the big license of mit", "Licensed under CC BY-NC 4.0."]
    rows = {r.doc_id: r for r in license_scan.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert (rows[0].labels, rows[0].base_labels, rows[0].score) == ("mit", "", 1.0)
    assert (rows[1].labels, rows[1].n_base, rows[1].first_word) == ("mit", 1, 3)
    assert rows[2].base_labels == "" and rows[3].labels == "cc-by,cc-by-nc-4.0"


def test_other_templates(spark):
    """Random templates and shares, so that prefixes are long and words tie in frequency."""
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)]
    templates = tuple((f"t{k}", " ".join(rng.sample(vocabulary, rng.randint(3, 40)))) for k in range(30))
    texts = ["\n".join(" ".join(rng.choices(vocabulary, k=rng.randint(1, 60))) for _ in range(rng.randint(1, 30))) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for share in ((1, 2), (7, 10)):
        df = license_scan.scan_licenses(docs, templates=templates, containment=share[0] / share[1], notice=5, window=90)
        assert got(df) == sorted(((i, *brute_force(t, templates, share, 5, 90)) for i, t in enumerate(texts)), key=repr)


def test_odd_rows(spark, odd_docs, no_docs):
    want = sorted(((r.doc_id, *brute_force(r.text)) for r in odd_docs.collect()), key=repr)
    assert got(license_scan.scan_licenses(odd_docs)) == want
    assert got(license_scan.scan_licenses(no_docs)) == []
    renamed = odd_docs.drop("id", "key").withColumnRenamed("doc_id", "id").withColumnRenamed("text", "key")
    assert got(license_scan.scan_licenses(renamed, id_col="id", text_col="key"), "id") == want
