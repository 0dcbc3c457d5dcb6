"""Spelling variants by a symmetric-delete join.

1. Words are counted over all documents. A run whose crc32 with its document's id is divisible by
   ``DAMAGE`` loses one letter first, as the contract has it; ``damage=None`` leaves words whole.
2. Every word emits itself and its distinct single deletions as 64-bit keys. The keys of a word come
   from running sums over its letters, so a word of n letters costs n steps, not n * n.
3. An equi-join on the keys gives the candidates. Words at distance one share one key exactly: the
   shorter word itself, or what is left without the replaced letter. A candidate is verified by its
   exact distance, so two keys that are equal by chance change nothing.
4. Each word's near words are counted, its form (the near word of largest n, at least ``RATIO`` times
   its own) is chosen, and forms are followed to the root by joins that double the step each round.

A key's words differ by one inserted letter, so there are at most 90 * (length + 1) of them, whatever
the size of the corpus. A word above ``LONG`` letters is joined by its number, not carried by each key.

Defined results: null and wordless texts give no words; a null id counts as the empty text in the
checksum; repeated rows count again; words that only differ in letters outside the alphabet's range
are split there; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statewake.llm.common import Scratch

#: Words have code points of Latin-1 only, so a word is one byte a letter. Other bytes part words.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))
DAMAGE, MIN_LENGTH, MIN_COUNT, RATIO = 97, 5, 3, 2
#: Longer words are not carried with each of their keys.
LONG = 64
#: Distinct words that a task holds before it hands on its counts, and words whose keys are made together.
HELD, CHUNK = 300_000, 1 << 16
_RNG = np.random.default_rng(20240311)
_LETTER = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = 0x9E3779B97F4A7C15
_BACK = np.uint64(pow(_STEP, -1, 1 << 64))


def words_of(text: str | None, doc_id: str | None, damage: int | None = DAMAGE) -> dict[bytes, int]:
    """The counts of a document's words (Latin-1 bytes), damaged ones in their damaged form."""
    runs = Counter((text or "").encode("latin-1", "replace").translate(LETTERS).split())
    if not damage:
        return runs
    start, out = zlib.crc32(f"{doc_id or ''}:".encode()), Counter()
    for run, n in runs.items():
        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
        if h % damage == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        out[run] += n
    return out


def count_words(docs: DataFrame, *, id_col="doc_id", text_col="text", damage=DAMAGE, min_length=MIN_LENGTH, min_count=MIN_COUNT) -> DataFrame:
    """word and n of the words that are long and frequent enough."""

    def run(batches):
        held: Counter = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for b in batches:
            for doc_id, text in zip(b.column(0), b.column(1), strict=True):
                for word, n in words_of(text.as_py(), doc_id.as_py(), damage).items():
                    if len(word) >= min_length:
                        held[word] += n
                if len(held) >= HELD:
                    yield flush()
        yield flush()

    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def deletion_keys(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of words of one length (rows of bytes): of each word itself, then of it without each letter; and which are distinct deletions."""
    k, n = letters.shape
    steps = np.cumprod(np.full(n, _STEP, np.uint64), dtype=np.uint64)
    sums = np.zeros((k, n + 1), np.uint64)
    np.cumsum(_LETTER[letters] * steps, axis=1, dtype=np.uint64, out=sums[:, 1:])
    whole = sums[:, -1:]
    keys = np.concatenate([whole, sums[:, :-1] + (whole - sums[:, 1:]) * _BACK], axis=1)
    keys = (keys ^ (keys >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    distinct = np.ones((k, n + 1), bool)
    distinct[:, 2:] = letters[:, 1:] != letters[:, :-1]
    return (keys ^ (keys >> np.uint64(32))).view(np.int64), distinct


def keyed_words(words: DataFrame, carry: bool) -> DataFrame:
    """key, n and ref of every word: the word itself, or its two hashes where words are long."""
    ref = F.col("word") if carry else F.concat_ws(":", F.xxhash64("word"), F.xxhash64(F.lit(1), "word"))

    def run(batches):
        for b in batches:
            lengths = np.fromiter((len(w) for w in b.column(0).to_pylist()), np.int64, b.num_rows)
            for length in np.unique(lengths).tolist():
                rows, most = np.flatnonzero(lengths == length), max(1, CHUNK * 16 // (length + 1))
                for at in range(0, len(rows), most):
                    part = pa.array(rows[at : at + most])
                    text = "".join(b.column(0).take(part).to_pylist()).encode("latin-1")
                    keys, distinct = deletion_keys(np.frombuffer(text, np.uint8).reshape(len(part), length))
                    of = pa.array(np.repeat(np.arange(len(part)), distinct.sum(1)))
                    yield pa.RecordBatch.from_arrays([pa.array(keys[distinct]), b.column(1).take(part).take(of), b.column(2).take(part).take(of)], names=["key", "ref", "n"])

    return words.select("word", ref.alias("ref"), "n").mapInArrow(run, "key long, ref string, n long")


def _candidates(words: DataFrame, carry: bool) -> DataFrame:
    keyed = keyed_words(words, carry)
    left, right = keyed.select("key", F.col("ref").alias("a"), F.col("n").alias("n_a")), keyed.select("key", F.col("ref").alias("b"), F.col("n").alias("n_b"))
    return left.join(right, "key").where("a < b").drop("key")


def distance_one(a: str, b: str) -> bool:
    """Whether two words of nearly one length differ by exactly one code point; the first difference is found by halving."""
    a, b = sorted((a, b), key=len)
    low, high = 0, len(a)
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[low:middle] == b[low:middle] else (low, middle - 1)
    return a != b and (a[low + 1 :] == b[low + 1 :] if len(a) == len(b) else a[low:] == b[low + 1 :])


def _verified(pairs: DataFrame) -> DataFrame:
    """Pairs(a, b, ...) of long words at distance one; the built-in distance takes steps in the square of the length."""

    def run(batches):
        for b in batches:
            yield b.filter(pa.array([distance_one(x.as_py(), y.as_py()) for x, y in zip(b.column("a"), b.column("b"), strict=True)], pa.bool_()))

    return pairs.mapInArrow(run, pairs.schema)


def near_pairs(words: DataFrame) -> DataFrame:
    """a, n_a, b, n_b: the pairs of words(word, n) at a distance of exactly one inserted, deleted or replaced code point, once each."""
    length = F.length("word")
    near = _candidates(words.where(length <= LONG), True)
    # pairs with a word above LONG letters: the other one has at least LONG
    long = _candidates(words.where(length >= LONG), False)
    named = words.where(length >= LONG).select(F.concat_ws(":", F.xxhash64("word"), F.xxhash64(F.lit(1), "word")).alias("ref"), "word")
    for side in "ab":
        long = long.join(named.select(F.col("ref").alias(side), F.col("word").alias(f"word_{side}")), side).drop(side).withColumnRenamed(f"word_{side}", side)
    long = long.where(F.greatest(F.length("a"), F.length("b")) > LONG)
    return near.where(F.levenshtein("a", "b", 1) == 1).unionByName(_verified(long))


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """word and root for words with a form: forms(word, form) is followed to its end. n grows along it, so it has one."""
    now, k = scratch.write(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("open")), "roots-0"), 0
    while now.where("open").limit(1).count():
        then = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = now.where("open").join(then, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("open"))
        k += 1
        now = scratch.write(now.where("not open").unionByName(moved), f"roots-{k}")
        scratch.drop(f"roots-{k - 1}")
    return now.select("word", "root")


def spelling_variants(docs: DataFrame, *, id_col="doc_id", text_col="text", damage=DAMAGE, min_length=MIN_LENGTH, min_count=MIN_COUNT, ratio=RATIO) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of the documents."""
    scratch = Scratch(docs.sparkSession, "spelling")
    words = scratch.write(count_words(docs, id_col=id_col, text_col=text_col, damage=damage, min_length=min_length, min_count=min_count), "words")
    pairs = near_pairs(words)
    sides = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("n_a").alias("n"), F.col("b").alias("near"), F.col("n_b").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("n_b").alias("n"), F.col("a").alias("near"), F.col("n_a").alias("near_n"))))
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("word")))
    near = pairs.select(sides.alias("s")).select("s.*").groupBy("word", "n").agg(F.count("*").alias("n_near"), best.alias("best"))
    taken = -F.col("best.minus") >= ratio * F.col("n")
    near = scratch.write(near.select("word", "n_near", F.when(taken, F.col("best.word")).alias("form"), F.when(taken, -F.col("best.minus")).alias("form_n")), "near")
    found = near.join(roots(near.where("form is not null"), scratch), "word", "left")
    df = words.join(found, "word", "left")
    return df.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


#: Letters above ASCII as one-byte signs that no word has, since SQL's distance counts bytes.
_HIGH = "".join(map(chr, range(0xC0, 0x100)))
_SIGNS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789!#$%&()*+,-./:;<=>?@[]^_`{|}~"[: len(_HIGH)]
SQL = f"""
WITH RECURSIVE polynomial AS (SELECT list(c ORDER BY i) AS crcs FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM range(256) t(i))),
r AS (SELECT doc_id, w, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS w FROM documents) GROUP BY ALL),
h AS (SELECT w, k, xor(list_reduce(list_transform(range(len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT), lambda c, b: xor(crcs[(xor(c, b) & 255) + 1], c >> 8), 4294967295), 4294967295) AS h
  FROM (SELECT w, k, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || w)) AS x, crcs FROM r, polynomial)),
v AS MATERIALIZED (SELECT word, sum(k)::BIGINT AS n, translate(word, '{_HIGH}', '{_SIGNS}') AS b FROM (SELECT CASE WHEN h % {DAMAGE} = 0 THEN left(w, (h % length(w))::BIGINT) || substr(w, (h % length(w) + 2)::BIGINT) ELSE w END AS word, k FROM h)
  WHERE length(word) >= {MIN_LENGTH} GROUP BY word HAVING sum(k) >= {MIN_COUNT}),
p AS (SELECT a.word, a.n, count(*) AS n_near, max(c.n) AS m, arg_min(c.word, (-c.n, c.word)) AS f FROM v a JOIN v c ON length(c.word) BETWEEN length(a.word) - 1 AND length(a.word) + 1 AND levenshtein(a.b, c.b) = 1 GROUP BY ALL),
f AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= {RATIO} * v.n THEN f END AS form, CASE WHEN m >= {RATIO} * v.n THEN m END AS form_n FROM v LEFT JOIN p USING (word)),
up AS (SELECT word, word AS root FROM f UNION ALL SELECT up.word, f.form FROM up JOIN f ON f.word = up.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, up.root, f.n, f.n_near, f.form_n FROM f JOIN up USING (word) JOIN f AS e ON e.word = up.root WHERE e.form IS NULL
"""
