"""Phrase collocations by position bitmaps, in the manner of SPAM.

1. A task cuts its texts into pieces and words and gathers them by language into shards of bounded
   size. In a shard each word has a compressed bitmap of its positions: the blocks of ``BITS``
   positions that hold it, and a mask for each. A piece's end takes up a position of its own, so that
   no phrase crosses it.
2. A phrase's bitmap has the places of its last word. It is extended by a shift of one position and an
   AND with the bitmaps of the words of the same blocks; popcounts give the occurrences. Phrases are
   extended depth first, a slice of prefixes at a time, so memory is bounded by the shard and slice.
3. Popcounts are summed over shards. Words and pairs come first; triples only from places where both
   pairs may be frequent, which a Bloom filter of the frequent pairs tells. It has at most
   ``MOST_FILTER_BITS`` bits and is built by a distributed ``bit_or``. It never loses a frequent pair;
   what else it lets through is summed and falls below the limit, so its size changes no result, and a
   shard never emits more triples than it has positions.
4. Phrases are scored by exact decimal arithmetic; joins with the parts' counts spread frequent parts.

Words go by 64-bit hashes of language and word until they are scored.

Defined results: null and blank texts have no pieces; a null language counts as ``und``, together with
a language of that name; repeated rows count again; ties end with the phrase; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statewake.llm.common import Scratch, spread_join

MIN_COUNT, COVERED, TOP = 10, 50, 2000
BITS = 8
#: Words that a task gathers before it mines them, and bitmap blocks of the prefixes that are extended at once.
SHARD_WORDS, SLICE = 1_000_000, 1 << 16
MOST_FILTER_BITS, FILTER_BITS_EACH = 1 << 28, 12
#: A-Z in lower case; ends of pieces become line feeds and tabs spaces.
PREPARED = bytes(10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))


def _sorted_with(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two arrays of numbers below 2**31, sorted by the first, then the second: as one array of both, which numpy sorts faster than it finds an order."""
    both = np.sort(key.astype(np.int64) << 32 | value)
    return both >> 32, both & (1 << 32) - 1


class Shard:
    """The bitmaps of a shard's words: word, block and mask of each, in order of words, and the same in order of blocks."""

    def __init__(self, texts: list[bytes]):
        text = b"\n".join(texts).replace(b"\n", b" \n ")
        tokens = pc.split_pattern(pa.array([text], pa.large_binary()), b" ").flatten().dictionary_encode()
        # of what spaces part, empty texts are nothing and ends of pieces take up a position
        found, end = tokens.dictionary.to_pylist(), -1
        number = np.cumsum([w not in (b"", b"\n") for w in found], dtype=np.int32) - 1
        self.words = [w for w in found if w not in (b"", b"\n")]
        number[[i for i, w in enumerate(found) if w == b"\n"]] = end
        number[[i for i, w in enumerate(found) if w == b""]] = end - 1
        seq = number[tokens.indices.to_numpy()]
        seq = seq[seq >= end]
        places = np.flatnonzero(seq > end)
        word, places = _sorted_with(seq[places], places)
        block = places // BITS
        first = np.flatnonzero(np.concatenate([[True], (word[1:] != word[:-1]) | (block[1:] != block[:-1])])) if len(word) else np.empty(0, np.int64)
        self.word, self.block = word[first].astype(np.int32), block[first].astype(np.int32)
        self.mask = np.bitwise_or.reduceat((1 << places % BITS).astype(np.uint8), first) if len(first) else np.empty(0, np.uint8)
        _, order = _sorted_with(self.block, np.arange(len(self.block)))
        self.at_word, self.at_mask = self.word[order], self.mask[order]
        self.starts = np.searchsorted(self.block[order], np.arange(len(seq) // BITS + 3)).astype(np.int32)

    def counts(self) -> np.ndarray:
        return np.bincount(self.word, np.bitwise_count(self.mask), len(self.words)).astype(np.int64)

    def extended(self, of: np.ndarray, block: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, ...]:
        """The bitmaps (of, word, block, mask) of phrases of with each word that follows them."""
        wide = mask.astype(np.uint16) << 1
        here, over = (wide & (1 << BITS) - 1).astype(np.uint8), (wide >> BITS).astype(np.uint8)
        stay, pass_on = np.flatnonzero(here), np.flatnonzero(over)
        of, block = np.concatenate([of[stay], of[pass_on]]), np.concatenate([block[stay], block[pass_on] + 1])
        mask = np.concatenate([here[stay], over[pass_on]])
        begin, n = self.starts[block], self.starts[block + 1] - self.starts[block]
        entry = np.arange(n.sum(), dtype=np.int32) + np.repeat((begin - (np.cumsum(n) - n)).astype(np.int32), n)
        both = np.repeat(mask, n) & self.at_mask[entry]
        kept = np.flatnonzero(both)
        row = np.repeat(np.arange(len(block), dtype=np.int32), n)[kept]
        return of[row], self.at_word[entry[kept]], block[row], both[kept]

    def phrases(self, length: int, may_hold: Callable | None = None) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
        """Words (an array for each place) and popcounts of the phrases of a length, some in several parts; may_hold(words, next words) gives the places of the pairs that go on."""
        for at in range(0, len(self.word), SLICE):
            part = slice(at, at + SLICE)
            words, of = np.unique(self.word[part], return_inverse=True)
            yield from self._deeper([words], of, self.block[part], self.mask[part], length, may_hold)

    def _deeper(self, words, of, block, mask, length, may_hold):
        of, word, block, mask = self.extended(of, block, mask)
        if may_hold is not None and len(of):
            go = may_hold(words[-1][of], word)
            of, word, block, mask = of[go], word[go], block[go], mask[go]
        if not len(of):
            return
        key = of * len(self.words) + word
        order = np.argsort(key, kind="stable")
        key, of, word = key[order], of[order], word[order]
        change = np.concatenate([[True], key[1:] != key[:-1]])
        first = np.flatnonzero(change)
        words = [*(w[of[first]] for w in words), word[first]]
        mask = mask[order]
        if len(words) == length:
            yield words, np.add.reduceat(np.bitwise_count(mask).astype(np.int64), first)
            return
        block, of = block[order], np.cumsum(change) - 1
        for at in range(0, len(of), SLICE):
            part = slice(at, at + SLICE)
            low, high = of[at], of[min(at + SLICE, len(of)) - 1]
            yield from self._deeper([w[low : high + 1] for w in words], of[part] - low, block[part], mask[part], length, may_hold)

    def ids(self, lang: str) -> np.ndarray:
        import xxhash

        seed = xxhash.xxh64_intdigest(lang.encode())
        return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in self.words), np.uint64, len(self.words)).view(np.int64)


def shards(batches, shard_words: int) -> Iterator[tuple[str, Shard]]:
    """The shards of batches of lang and text, by language."""
    held: dict[str, list[bytes]] = {}
    n = 0
    for b in batches:
        for lang, text in zip(b.column(0), b.column(1), strict=True):
            if not (prepared := (text.as_py() or "").encode("utf-8", "replace").translate(PREPARED)):
                continue
            held.setdefault(lang.as_py(), []).append(prepared)
            n += prepared.count(b" ") + prepared.count(b"\n") + 1
            if n >= shard_words:
                for x in list(held):
                    yield x, Shard(held.pop(x))
                n = 0
    for x in list(held):
        yield x, Shard(held.pop(x))


def _texts(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))


def words_and_pairs(docs: DataFrame, *, lang_col="lang", text_col="text", min_count=MIN_COUNT, shard_words=SHARD_WORDS) -> DataFrame:
    """a, b, f, lang, word: pairs of word ids with f >= min_count; and all words, with their id in a and null in b."""

    def run(batches):
        for lang, s in shards(batches, shard_words):
            ids, n = s.ids(lang), len(s.words)
            texts = [w.decode("utf-8") for w in s.words]
            yield pa.RecordBatch.from_pydict({"a": ids, "b": pa.nulls(n, pa.int64()), "lang": [lang] * n, "word": texts, "n": s.counts()}, schema=kind)
            for (a, b), counts in s.phrases(2):
                k = len(a)
                yield pa.RecordBatch.from_pydict({"a": ids[a], "b": ids[b], "lang": pa.nulls(k, pa.string()), "word": pa.nulls(k, pa.string()), "n": counts}, schema=kind)

    kind = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])
    rows = _texts(docs, lang_col, text_col).mapInArrow(run, "a long, b long, lang string, word string, n long")
    return rows.groupBy("a", "b", "lang", "word").agg(F.sum("n").alias("f")).where((F.col("f") >= min_count) | F.col("b").isNull())


def _bit_place(a: np.ndarray, b: np.ndarray, bits: int, i: int) -> np.ndarray:
    """The i-th of the three bits of a filter for each pair of ids."""
    h = (a.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ b.view(np.uint64)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return ((h + np.uint64(i) * ((h >> np.uint64(33)) | np.uint64(1))) ^ (h >> np.uint64(29))) & np.uint64(bits - 1)


def frequent_pairs(table: np.ndarray, ids: np.ndarray) -> Callable:
    """may_hold(words, next words): where their ids may be a pair of the filter; the second and third bits are looked up only where those before are set."""

    def may_hold(a, b):
        at = np.arange(len(a))
        for i in range(3):
            place = _bit_place(ids[a[at]], ids[b[at]], len(table) * 64, i)
            at = at[(table[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1]
        return at

    return may_hold


def pair_filter(pairs: DataFrame, n: int) -> np.ndarray:
    """The bits of pairs(a, b), n of them, as 64-bit words: at most MOST_FILTER_BITS."""
    bits = min(MOST_FILTER_BITS, 1 << max(10, (n * FILTER_BITS_EACH).bit_length()))

    def run(batches):
        for b in batches:
            pair = [b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)]
            places = np.concatenate([_bit_place(*pair, bits, i) for i in range(3)])
            yield pa.RecordBatch.from_arrays([pa.array((places >> np.uint64(6)).view(np.int64)), pa.array((np.uint64(1) << (places & np.uint64(63))).view(np.int64))], names=["slot", "bit"])

    found = pairs.select("a", "b").mapInArrow(run, "slot long, bit long").groupBy("slot").agg(F.bit_or("bit").alias("bit")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[found["slot"].to_numpy()] = found["bit"].to_numpy().view(np.uint64)
    return out


def triples(docs: DataFrame, pairs: DataFrame, *, lang_col="lang", text_col="text", min_count=MIN_COUNT, shard_words=SHARD_WORDS) -> DataFrame:
    """a, b, c, f: triples of word ids with f >= min_count; pairs has the frequent pairs."""
    bits = docs.sparkSession.sparkContext.broadcast(pair_filter(pairs, pairs.count()))

    def run(batches):
        table = bits.value
        for lang, s in shards(batches, shard_words):
            ids = s.ids(lang)

            for words, counts in s.phrases(3, frequent_pairs(table, ids)):
                yield pa.RecordBatch.from_arrays([*(pa.array(ids[w]) for w in words), pa.array(counts)], names=["a", "b", "c", "n"])

    rows = _texts(docs, lang_col, text_col).mapInArrow(run, "a long, b long, c long, n long")
    return rows.groupBy("a", "b", "c").agg(F.sum("n").alias("f")).where(F.col("f") >= min_count)


def _beside(rows: DataFrame, keyed: DataFrame, keys: list[str]) -> DataFrame:
    """Written rows joined with a table of one row a key; keys of many rows are spread."""
    per_key = rows.groupBy(*keys).agg(F.count("*").alias("_rows"))
    return spread_join(rows, keyed.join(per_key, keys), keys, "_rows", rows.count())


def _score(a: str, left: str, right: str) -> Column:
    return F.expr(f"(1000000 * cast({a} as decimal(38,0)) * {a}) div (cast({left} as decimal(38,0)) * {right})")


def collocations(docs: DataFrame, *, lang_col="lang", text_col="text", min_count=MIN_COUNT, covered=COVERED, top=TOP, shard_words=SHARD_WORDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the first phrases of each language."""
    scratch, options = Scratch(docs.sparkSession, "phrases"), {"lang_col": lang_col, "text_col": text_col, "min_count": min_count, "shard_words": shard_words}
    counted = scratch.write(words_and_pairs(docs, **options), "words-pairs")
    words = counted.where("b is null")
    frequent = words.where(F.col("f") >= min_count)
    name = lambda side: frequent.select(F.col("a").alias(side), F.col("word").alias(f"w_{side}"), F.col("f").alias(f"f_{side}"))
    pairs = counted.where("b is not null").select("a", "b", "f")
    left = scratch.write(_beside(pairs, name("a").join(frequent.select("a", "lang"), "a"), ["a"]), "left")
    pairs = scratch.write(_beside(left, name("b"), ["b"]), "pairs")
    found = scratch.write(triples(docs, pairs, **options), "triples")
    first = scratch.write(_beside(found, pairs.select("a", "b", "lang", "w_a", "w_b", "f_a", F.col("f").alias("f_ab")), ["a", "b"]), "first")
    both = _beside(first, pairs.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("w_b").alias("w_c"), F.col("f_b").alias("f_c"), F.col("f").alias("f_bc")), ["b", "c"])

    early, late = _score("f", "f_a", "f_bc"), _score("f", "f_ab", "f_c")
    threes = both.select("lang", F.concat_ws(" ", "w_a", "w_b", "w_c").alias("phrase"), F.col("f").alias("a"), F.when(early <= late, F.col("f_a")).otherwise(F.col("f_ab")).alias("l"), F.when(early <= late, F.col("f_bc")).otherwise(F.col("f_c")).alias("r"), F.least(early, late).alias("score"))
    longer = found.select("a", "b", "f").unionByName(found.select(F.col("b").alias("a"), F.col("c").alias("b"), "f")).groupBy("a", "b").agg(F.max("f").alias("longest"))
    twos = pairs.join(longer, ["a", "b"], "left").where(F.col("longest").isNull() | (100 * F.col("longest") < covered * F.col("f")))
    twos = twos.select("lang", F.concat_ws(" ", "w_a", "w_b").alias("phrase"), F.col("f").alias("a"), F.col("f_a").alias("l"), F.col("f_b").alias("r"), _score("f", "f_a", "f_b").alias("score"))
    rows = scratch.write(threes.unionByName(twos), "scored")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the first of each part of a language, then of those the first of the language
    parts = 1 + int((rows.count() / top) ** 0.5)
    rows = rows.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(parts))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("rank") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    return rows.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


SQL = f"""
WITH p AS (SELECT row_number() OVER () AS p, lang, ws FROM (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM
  (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)) WHERE len(ws) > 0),
t AS MATERIALIZED (SELECT lang, w, lead(w) OVER x AS w2, lead(w, 2) OVER x AS w3 FROM (SELECT lang, p, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM p) WINDOW x AS (PARTITION BY p ORDER BY i)),
n AS (SELECT lang, count(*) AS n FROM t GROUP BY lang),
f1 AS MATERIALIZED (SELECT lang, w, count(*) AS f FROM t GROUP BY ALL),
f2 AS MATERIALIZED (SELECT lang, w, w2, count(*) AS f FROM t WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= {MIN_COUNT}),
f3 AS MATERIALIZED (SELECT lang, w, w2, w3, count(*) AS f FROM t WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= {MIN_COUNT}),
s3 AS (SELECT f3.*, x.f AS fa, y.f AS fbc, z.f AS fab, c.f AS fc, 1000000 * f3.f::HUGEINT * f3.f // (x.f::HUGEINT * y.f) AS s1, 1000000 * f3.f::HUGEINT * f3.f // (z.f::HUGEINT * c.f) AS s2
  FROM f3 JOIN f1 x ON x.lang = f3.lang AND x.w = f3.w JOIN f2 y ON y.lang = f3.lang AND y.w = f3.w2 AND y.w2 = f3.w3 JOIN f2 z ON z.lang = f3.lang AND z.w = f3.w AND z.w2 = f3.w2 JOIN f1 c ON c.lang = f3.lang AND c.w = f3.w3),
m AS (SELECT lang, u, v, max(f) AS f FROM (SELECT lang, w AS u, w2 AS v, f FROM f3 UNION ALL SELECT lang, w2, w3, f FROM f3) GROUP BY ALL),
r AS (SELECT lang, w || ' ' || w2 || ' ' || w3 AS phrase, f AS a, CASE WHEN s1 <= s2 THEN fa ELSE fab END AS l, CASE WHEN s1 <= s2 THEN fbc ELSE fc END AS r, least(s1, s2) AS score FROM s3
  UNION ALL SELECT f2.lang, f2.w || ' ' || f2.w2, f2.f, x.f, y.f, 1000000 * f2.f::HUGEINT * f2.f // (x.f::HUGEINT * y.f) FROM f2 JOIN f1 x ON x.lang = f2.lang AND x.w = f2.w JOIN f1 y ON y.lang = f2.lang AND y.w = f2.w2
    LEFT JOIN m ON m.lang = f2.lang AND m.u = f2.w AND m.v = f2.w2 WHERE m.f IS NULL OR 100 * m.f < {COVERED} * f2.f),
k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM r)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM k JOIN n USING (lang) WHERE rank <= {TOP}
"""
