"""Language-model scores by context-tree weighting over bytes.

A byte is eight binary decisions; the decisions so far and the last d bytes name a node of depth d.
Each node has the Krichevsky-Trofimov estimate of its counts, and all depths 0..DEPTH are mixed by
context-tree weighting: Pw = (Pe + product of the children's Pw) / 2. Counts are those of all
training texts, and the mixing weights follow from them; the code length of a byte is minus the
logarithm of the product of its eight mixed probabilities. A text ends with the byte 0, and its
first bytes have zeros before them as context.

Every node is kept, so the model grows with the corpus and no machine holds it whole. A task reads a
chunk of documents and sends on the chunk's distinct grams of DEPTH + 1 bytes with their training
counts (0 for those of held-out texts alone), packed by two-byte context. The counts of a context are
added up, over many chunks in two steps, and written as one row. From such rows the nodes of depth 2
and more are made, twice: first for the sums from which the driver makes depths 1 and 0 (at most
65,536 nodes), then for the logarithms of the grams, which go back to the chunks. There the texts are
scored. What a task holds is a context's distinct grams and their nodes a slice at a time, not the
chunks that have them; a context that many chunks have is dealt over several tasks. A word's rows, one
for each chunk of at least CHUNK_BYTES or CHUNK_WORDS that has it, are counted in one task.

Beside it stands the base model of word counts. Words are numbered within a chunk of a task's
documents, so that only a chunk's distinct words travel to be counted, and not each document's.

Defined results: a null text counts as empty and has the end token alone; a null id is never held
out; repeated rows each give a row and each count; an empty table gives an empty result. n_bytes
counts the end byte; bits_per_byte is the code length (-score in bits) over it.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from statewake.llm.common import Scratch, pieces
from statewake.llm.near_dup import groups

DEPTH = 5
COUNT_BYTES = 4 << 20
#: Distinct words, and bytes of text, after which a task begins a new chunk.
CHUNK_WORDS, CHUNK_BYTES = 400_000, 32 << 20
CACHE_BITS = 21
#: Chunks whose grams of one context are one task's, and grams of a context whose nodes are held together.
SALT_CHUNKS, SLICE = 4096, 1 << 18
LOG2 = float(np.log(2))


def held_out(id_col: Column, folds: int = 7, held: int = 2) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == held, F.lit(False))


def model_bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace").lower()


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The gram of every byte and end of the texts (the byte on top, older context below), and where each text begins."""
    joined = bytes(DEPTH) + bytes(DEPTH + 1).join(texts) + bytes(8)
    lens = np.array([len(t) + 1 for t in texts])
    starts = np.concatenate([[0], np.cumsum(lens)])
    every = np.ndarray((len(joined) - 7,), "<u8", joined, 0, (1,))
    at = np.arange(starts[-1]) + np.repeat(np.arange(len(texts)) * DEPTH, lens)
    return every[at] & np.uint64((1 << 8 * (DEPTH + 1)) - 1), starts


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma by Stirling's series, seven steps up."""
    x = np.asarray(x, np.float64)
    shift = np.log(x)
    for k in range(1, 7):
        shift += np.log(x + k)
    y = x + 7
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov block probability."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1.0) - np.log(np.pi)


def placed_leaves(code: np.ndarray, count: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Leaf nodes (see leaf_nodes), and the place of each gram's eight nodes among them (one row for each decision)."""
    shift = np.uint64(8 * depth)
    symbol, context = (code >> shift).astype(np.int64), code & ((np.uint64(1) << shift) - np.uint64(1))
    keys, ones = [], []
    for k in range(8):
        keys.append(context << np.uint64(8) | ((1 << k) | (symbol >> (8 - k))).astype(np.uint64))
        ones.append((symbol >> (7 - k)) & 1)
    key, where = np.unique(np.concatenate(keys), return_inverse=True)
    bit, n = np.concatenate(ones), np.tile(count, 8)
    return key, np.bincount(where, n * (1 - bit), len(key)), np.bincount(where, n * bit, len(key)), where.reshape(8, len(code))


def leaf_nodes(code: np.ndarray, count: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Node keys (context above the decisions so far) and counts of zeros and ones of grams with a context of depth bytes."""
    return placed_leaves(code, count, depth)[:3]


def parents(key: np.ndarray) -> np.ndarray:
    """The key with its oldest context byte taken off."""
    return key >> np.uint64(16) << np.uint64(8) | key & np.uint64(255)


def weigh(n0: np.ndarray, n1: np.ndarray, below: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Probability of a one, weight of the node's own estimate, and ln Pw; below: the sum of its children's ln Pw."""
    one = (n1 + 0.5) / (n0 + n1 + 1)
    own = log_kt(n0, n1)
    if below is None:
        return one, np.ones(len(one)), own
    return one, 1 / (1 + np.exp(np.clip(below - own, -700, 700))), np.logaddexp(own, below) - LOG2


def merge(key, n0, n1, pw):
    """The parents of nodes: keys, counts, and sums of ln Pw."""
    up, where = np.unique(parents(key), return_inverse=True)
    return up, *(np.bincount(where, x, len(up)) for x in (n0, n1, pw))


def slots(key: np.ndarray, depth: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Slot and check (never 0) of nodes."""
    h = (key + np.uint64((depth + 1) * 0xA24BAED4963EE407 & (1 << 64) - 1)) * np.uint64(0x9FB21C651E98DF25)
    h = (h ^ (h >> np.uint64(35))) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return (h >> np.uint64(64 - bits)).astype(np.int64), (h & np.uint64(0xFFFF)).astype(np.uint16) | np.uint16(1)


class Model:
    """Small models in memory, by slots: check, probability of a one, weight of the own estimate. The operator doesn't use it."""

    def __init__(self, bits: int):
        self.bits = bits
        self.check, self.one, self.own = np.zeros(1 << bits, np.uint16), np.full(1 << bits, 0.5, np.float32), np.ones(1 << bits, np.float32)

    def put(self, slot, check, one, own) -> None:
        self.check[slot], self.one[slot], self.own[slot] = check, one, own

    def log10(self, code: np.ndarray) -> np.ndarray:
        """log10 of the probability of each gram's byte after its context."""
        symbol = (code >> np.uint64(8 * DEPTH)).astype(np.int64)
        total = np.zeros(len(code))
        for k in range(8):
            node, bit = ((1 << k) | (symbol >> (8 - k))).astype(np.uint64), (symbol >> (7 - k)) & 1
            p = np.full(len(code), 0.5)
            for d in range(DEPTH, -1, -1):
                context = (code >> np.uint64(8 * (DEPTH - d))) & np.uint64((1 << 8 * d) - 1)
                slot, check = slots(context << np.uint64(8) | node, d, self.bits)
                seen, own = self.check[slot] == check, self.own[slot]
                p = np.where(seen, own * self.one[slot] + (1 - own) * p, 0.5 if d else p)
            total += np.log10(np.where(bit, p, 1 - p))
        return total


def turned(code: np.ndarray) -> np.ndarray:
    """Grams with the byte below its context, so that grams of a context sort together."""
    return (code & np.uint64((1 << 8 * DEPTH) - 1)) << np.uint64(8) | code >> np.uint64(8 * DEPTH)


class Known:
    """The logarithms of grams, which are turned and sorted."""

    def __init__(self, grams: np.ndarray, value: np.ndarray):
        self.grams, self.value = grams, value

    def log10(self, code: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.grams, code := turned(code))
        assert (self.grams[at] == code).all()
        return self.value[at].astype(np.float64)


class Scorer:
    """A model with a direct-mapped table of the grams it met."""

    def __init__(self, model: Model | Known, bits: int = CACHE_BITS):
        self.model, self.bits, self.key, self.value = model, bits, np.full(1 << bits, (1 << 64) - 1, np.uint64), np.zeros(1 << bits)

    def score(self, texts: list[bytes]) -> np.ndarray:
        """log10 of the probability of each text."""
        out, at = [], 0
        while at < len(texts):
            size, end = 0, at
            while end < len(texts) and (size < 1 << 20 or end == at):
                size += len(texts[end])
                end += 1
            code, starts = grams(texts[at:end])
            place = (code * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)
            value, missing = self.value[place], np.flatnonzero(self.key[place] != code)
            if len(missing):
                new, where = np.unique(code[missing], return_inverse=True)
                got = np.concatenate([self.model.log10(new[i : i + 65536]) for i in range(0, len(new), 65536)])
                value[missing] = got[where]
                kept = (new * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)
                _, last = np.unique(kept, return_index=True)
                self.key[kept[last]], self.value[kept[last]] = new[last], got[last]
            out.append(np.add.reduceat(value, starts[:-1]))
            at = end
        return np.concatenate(out) if out else np.zeros(0)


def gram_counts(texts: list[bytes], train: list[bool]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct grams of texts, turned and sorted, and how often training texts have them."""
    code, starts = grams(texts)
    code = turned(code) << np.uint64(1) | np.repeat(np.array(train, np.uint64), np.diff(starts))
    code, n = np.unique(code, return_counts=True)
    return add_counts([code >> np.uint64(1)], [n * (code & np.uint64(1)).astype(np.int64)])


def add_counts(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    code, where = np.unique(np.concatenate(codes), return_inverse=True)
    return code, np.bincount(where, np.concatenate(counts), len(code)).astype(np.int64)


def climb(code: np.ndarray, n: np.ndarray) -> tuple:
    """Of grams: the probabilities of a one by node, mixed from the leaves to depth 3; where these are among the nodes of depth 2; the grams' places among the leaves; and parts of the nodes of depth 2."""
    key, n0, n1, leaf = placed_leaves(code, n.astype(np.float64), DEPTH)
    # grams that only held-out texts have make nodes without counts, which weigh nothing
    p, at, below = np.zeros(len(key)), np.arange(len(key)), None
    for _ in range(DEPTH, 2, -1):
        one, own, pw = weigh(n0, n1, below)
        p = own[at] * one[at] + (1 - own[at]) * p
        up, where = np.unique(parents(key), return_inverse=True)
        key, n0, n1, below = up, *(np.bincount(where, x, len(up)) for x in (n0, n1, pw))
        at = where[at]
    return p, at, leaf, (key, n0, n1, below)


class Branch:
    """The nodes of depth 2 and more of one two-byte context, from its grams (low: the rest of the turned grams, sorted)."""

    def __init__(self, context: int, low: np.ndarray, n: np.ndarray):
        low = low.astype(np.uint64)
        code = (low & np.uint64(255)) << np.uint64(8 * DEPTH) | np.uint64(context << 8 * (DEPTH - 2)) | low >> np.uint64(8)
        # slices hold all grams of a three-byte context
        ends, cuts = [*(np.flatnonzero(np.diff(low >> np.uint64(24))) + 1).tolist(), len(low)], [0]
        for a, z in zip(ends, [*ends[1:], None], strict=True):
            if z is None or z - cuts[-1] > SLICE:
                cuts.append(a)
        self.slices = [(code[a:z], n[a:z]) for a, z in zip(cuts, cuts[1:], strict=False)]
        self.kept = [climb(*self.slices[0])] if len(self.slices) == 1 else None
        tops = [x[3] for x in self.kept or map(climb, *zip(*self.slices, strict=True))]
        self.key, where = np.unique(np.concatenate([t[0] for t in tops]), return_inverse=True)
        n0, n1, below = (np.bincount(where, np.concatenate([t[i] for t in tops]), len(self.key)) for i in (1, 2, 3))
        self.one, self.own, pw = weigh(n0, n1, below)
        #: parts of the nodes of depth 1
        self.top = merge(self.key, n0, n1, pw)

    def log10(self, shallow: list) -> np.ndarray:
        """log10 of the probability of each gram's byte after its context."""
        out = []
        for i, (code, n) in enumerate(self.slices):
            p, at, leaf, (key, *_) = self.kept[i] if self.kept else climb(code, n)
            k = np.searchsorted(self.key, key)[at]
            p = self.own[k] * self.one[k] + (1 - self.own[k]) * p
            out.append(log10_of(code, p[leaf], shallow))
        return np.concatenate(out)


def log10_of(code: np.ndarray, deep: np.ndarray, shallow: list) -> np.ndarray:
    """log10 of the probability of each gram's byte after its context."""
    symbol, last = (code >> np.uint64(8 * DEPTH)).astype(np.int64), (code >> np.uint64(8 * (DEPTH - 1))).astype(np.int64) & 255
    total = np.zeros(len(code))
    for k in range(8):
        node, bit, p = (1 << k) | (symbol >> (8 - k)), (symbol >> (7 - k)) & 1, deep[k]
        for (one, own), key in zip(shallow, (last << 8 | node, node), strict=True):
            p = own[key] * one[key] + (1 - own[key]) * p
        total += np.log10(np.where(bit, p, 1 - p))
    return total


MERGED, TOPS, VALUES = "lid int, items binary, times binary", "key long, n0 double, n1 double, pw double", "chunk long, lid int, items binary, body binary"


def _merged(batches):
    """One row for each run of rows with equal lid and salt: its grams and their counts in sum."""
    now, codes, sums, held = None, [], [], 0

    def row():
        low, n = add_counts(codes, sums)
        return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([_pack(np.diff(low, prepend=0))], pa.binary()), pa.array([_pack(n, 8)], pa.binary())], names=["lid", "items", "times"])

    for b in batches:
        width = 8 if b.num_rows and b.column("wide")[0].as_py() else 4
        for lid, salt, items, times in zip(*(b.column(c).to_pylist() for c in ("lid", "salt", "items", "times")), strict=True):
            if (lid, salt) != now:
                if codes:
                    yield row()
                now, codes, sums, held = (lid, salt), [], [], 0
            codes.append(np.cumsum(_unpack(items)))
            sums.append(_unpack(times, width))
            held += len(codes[-1])
            if held > 2 * SLICE and held > 2 * len(codes[0]):
                code, n = add_counts(codes, sums)
                codes, sums, held = [code], [n], len(code)
    if codes:
        yield row()


def _tops(batches):
    for b in batches:
        for lid, items, times in zip(*(b.column(c).to_pylist() for c in ("lid", "items", "times")), strict=True):
            top = Branch(lid, np.cumsum(_unpack(items)), _unpack(times, 8)).top
            yield pa.RecordBatch.from_arrays([pa.array(top[0].astype(np.int64)), *map(pa.array, top[1:])], names=["key", "n0", "n1", "pw"])


def _values(shared):
    """The logarithms of chunks' grams; the row of a context's sums comes before those of its chunks."""

    def run(batches):
        now, low, value = None, None, None
        for b in batches:
            out = []
            for lid, salt, chunk, items, times in zip(*(b.column(c).to_pylist() for c in ("lid", "salt", "chunk", "items", "times")), strict=True):
                if chunk < 0:
                    now, low = (lid, salt), np.cumsum(_unpack(items))
                    value = Branch(lid, low, _unpack(times, 8)).log10(shared.value).astype(np.float32)
                    continue
                assert now == (lid, salt)
                out.append((chunk, lid, items, value[np.searchsorted(low, np.cumsum(_unpack(items)))].tobytes()))
                if len(out) == 64:
                    yield _rows(out)
                    out = []
            if out:
                yield _rows(out)

    def _rows(out):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["chunk", "lid", "items", "body"])

    return run


def gram_values(met: DataFrame, scratch: Scratch, n_chunks: int) -> DataFrame:
    """The logarithms, by the whole tree, of the grams of chunks: chunk, lid (a context), items and times (its grams and their counts, packed). A chunk has one row for each context."""
    salts = max(1, -(-n_chunks // SALT_CHUNKS))
    rows = met.withColumn("salt", F.pmod(F.xxhash64("chunk"), F.lit(salts)).cast("int"))
    add = lambda df: df.repartition("lid", "salt").sortWithinPartitions("lid", "salt").mapInArrow(_merged, MERGED)
    merged = add(rows.select("lid", "salt", "items", "times", F.lit(False).alias("wide")))
    if salts > 1:
        merged = add(merged.select("lid", F.lit(0).alias("salt"), "items", "times", F.lit(True).alias("wide")))
    merged = scratch.write(merged, "contexts")
    first = merged.mapInArrow(_tops, TOPS).groupBy("key").agg(*(F.sum(c).alias(c) for c in ("n0", "n1", "pw"))).toArrow()  # at most 65,536 rows
    key, n0, n1, below = (first.column(c).to_numpy() for c in ("key", "n0", "n1", "pw"))
    key, shallow = key.astype(np.uint64), []
    for size in (1 << 16, 1 << 8):
        one, own, pw = weigh(n0, n1, below)
        full = np.full(size, 0.5), np.ones(size)
        full[0][key.astype(np.int64)], full[1][key.astype(np.int64)] = one, own
        shallow.append(full)
        key, n0, n1, below = merge(key, n0, n1, pw)
    heads = merged.select("lid", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(-1).cast("long").alias("chunk"), "items", "times")
    both = heads.unionByName(rows.select("lid", "salt", "chunk", "items", F.lit(None).cast("binary").alias("times")))
    return both.repartition("lid", "salt").sortWithinPartitions("lid", "salt", "chunk").mapInArrow(_values(met.sparkSession.sparkContext.broadcast(shallow)), VALUES)


def _pack(x: np.ndarray, width: int = 4) -> bytes:
    """Integers of so many bytes by byte planes, compressed."""
    return zlib.compress(x.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes(), 1)


def _unpack(data: bytes, width: int = 4) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").ravel().astype(np.int64)


class _Numbers(dict):
    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def _squeeze(data: bytes) -> bytes:
    return len(data).to_bytes(8) + pa.compress(data, codec="zstd", asbytes=True)


def _unsqueeze(data: bytes) -> bytes:
    return pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8]), codec="zstd", asbytes=True) if data[:8] != bytes(8) else b""


WORDS, GRAMS, DOCS = 0, 1, 2
WORK = "chunk long, kind int, lid int, token binary, n long, doc_id long, held_out boolean, n_tokens long, items binary, times binary, size long, body binary"
END = b""


def _work(batches):
    """Rows of chunks' words (number, word, training count), of their grams by context (packed, with training counts), and of documents (their words' numbers in the chunk, and with the first of a batch the texts of all)."""
    from pyspark import TaskContext

    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.binary()]
    names = [x.split()[0] for x in WORK.split(", ")]

    def rows(length: int, kind: int, **cols):
        cols |= {"chunk": [chunk] * length, "kind": [kind] * length}
        return pa.RecordBatch.from_arrays([pa.array(cols[k], t) if k in cols else pa.nulls(length, t) for k, t in zip(names, kinds, strict=True)], names=names)

    chunk = TaskContext.get().partitionId() << 24
    numbers, counted, size, n_docs = _Numbers(), [], 0, 0
    waiting, train, waits, codes, sums = [], [], 0, [], []

    def add():
        code, n = gram_counts(waiting, train)
        codes.append(code)
        sums.append(n)
        waiting.clear()
        train.clear()
        if len(codes) > 3:
            code, n = add_counts(codes, sums)
            codes[:], sums[:] = [code], [n]

    def flush():
        counts = np.bincount(np.concatenate(counted), minlength=len(numbers)) if counted else np.zeros(len(numbers), np.int64)
        tokens = list(numbers)
        for a in range(0, len(tokens), 100_000):
            some = tokens[a : a + 100_000]
            yield rows(len(some), WORDS, lid=range(a, a + len(some)), token=some, n=counts[a : a + len(some)])
        if waiting:
            add()
        code, n = add_counts(codes, sums)
        context, low = (code >> np.uint64(32)).astype(np.int64), (code & np.uint64((1 << 32) - 1)).astype(np.int64)
        cuts = [*np.flatnonzero(np.diff(context, prepend=-1)).tolist(), len(code)]
        for a in range(0, len(cuts) - 1, 1000):
            some = list(zip(cuts[a : a + 1000], cuts[a + 1 : a + 1001], strict=False))
            yield rows(len(some), GRAMS, lid=context[[x for x, _ in some]], items=[_pack(np.diff(low[x:y], prepend=0)) for x, y in some], times=[_pack(n[x:y]) for x, y in some])

    for b in batches:
        for piece in pieces(b, 2, 512, COUNT_BYTES):
            texts = [model_bytes(t) for t in piece.column(2).to_pylist()]
            held, words, times, n_tokens = piece.column(1).to_pylist(), [], [], []
            for t, h in zip(texts, held, strict=True):
                tokens = [*t.split(), END]
                ids = np.fromiter(map(numbers.__getitem__, tokens), np.int64, len(tokens))
                if not h:
                    counted.append(ids)
                w, n = np.unique(ids, return_counts=True)
                words.append(_pack(np.diff(w, prepend=0)))
                times.append(_pack(n))
                n_tokens.append(len(tokens))
                size += len(t)
                waits += len(t)
                waiting.append(t)
                train.append(not h)
                if waits >= COUNT_BYTES:
                    add()
                    waits = 0
            body = [_squeeze(b"".join(texts)), *[None] * (len(texts) - 1)]
            yield rows(len(texts), DOCS, lid=range(n_docs, n_docs + len(texts)), doc_id=piece.column(0), held_out=held, n_tokens=n_tokens, items=words, times=times, size=[len(t) for t in texts], body=body)
            n_docs += len(texts)
            if len(counted) > 64:
                counted[:] = [np.concatenate(counted)]
            if len(numbers) >= CHUNK_WORDS or size >= CHUNK_BYTES:
                yield from flush()
                numbers, counted, size, n_docs, chunk = _Numbers(), [], 0, 0, chunk + 1
                waits, codes, sums = 0, [], []
    if numbers:
        yield from flush()


def _base(total: int, distinct: int, bits: int):
    """Both scores of a chunk's documents, from its word counts and its grams' values, which come first."""
    per = np.log10(total + distinct + 1)
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte"]

    def run(batches):
        now, logs, known, scorer = None, np.zeros(0), np.zeros(0, bool), None
        for g in groups(batches, ("chunk", "kind")):
            chunk, kind = g.column("chunk")[0].as_py(), g.column("kind")[0].as_py()
            if kind == WORDS:
                c = g.column("c").to_numpy()
                now, logs, known, scorer = chunk, np.log10(c + 1), c > 0, None
                continue
            assert now == chunk
            if kind == GRAMS:
                code = [np.cumsum(_unpack(x)) + (c << 32) for c, x in zip(g.column("lid").to_pylist(), g.column("items").to_pylist(), strict=True)]
                scorer = Scorer(Known(np.concatenate(code).astype(np.uint64), np.frombuffer(b"".join(g.column("body").to_pylist()), np.float32)), bits)
                continue
            body, at = b"".join(_unsqueeze(x) for x in g.column("body").to_pylist() if x is not None), 0
            texts, base, n_known = [], [], []
            for w, t, n in zip(g.column("items").to_pylist(), g.column("times").to_pylist(), g.column("size").to_pylist(), strict=True):
                w, t = np.cumsum(_unpack(w)), _unpack(t)
                base.append(float((logs[w] * t).sum() - t.sum() * per))
                n_known.append(int(t[known[w]].sum()))
                texts.append(body[at : at + n])
                at += n
            score, n_bytes = scorer.score(texts), np.array([len(t) + 1 for t in texts])
            table = pa.table([g.column("doc_id"), g.column("held_out"), g.column("n_tokens"), pa.array(n_known, pa.int64()), pa.array([total] * len(base), pa.int64()), pa.array(base, pa.float64()), pa.array(score), pa.array(n_bytes), pa.array(-score / np.log10(2) / n_bytes)], names=names)
            yield from table.to_batches()

    return run


def score_documents(docs: DataFrame, *, id_col="doc_id", text_col="text", folds=7, held=2, bits=CACHE_BITS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes and bits_per_byte of every document; bits (of a task's table of grams met) changes no result."""
    scratch = Scratch(docs.sparkSession, "ctw")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col), folds, held).alias("held_out"), F.col(text_col).alias("text"))
    work = scratch.write(rows.mapInArrow(_work, WORK), "work")
    # a word has one row for each chunk that holds it, so its rows are few beside those of a chunk's words
    by_word = Window.partitionBy("token")
    counts = scratch.write(work.where(f"kind = {WORDS}").select("chunk", "lid", F.sum("n").over(by_word).alias("c"), (F.row_number().over(by_word.orderBy("chunk")) == 1).alias("first")), "counts")
    distinct = counts.agg(F.count_if(F.col("first") & (F.col("c") > 0))).first()[0]
    total, n_chunks = work.where(f"kind = {DOCS}").agg(F.sum(F.when(~F.col("held_out"), F.col("n_tokens"))), F.count_distinct("chunk")).first()
    total = total or 0
    values = gram_values(work.where(f"kind = {GRAMS}").select("chunk", "lid", "items", "times"), scratch, n_chunks)
    bags = work.where(f"kind = {DOCS}").select("chunk", "kind", "lid", F.lit(None).cast("long").alias("c"), "doc_id", "held_out", "n_tokens", "items", "times", "size", "body")
    none = {c: F.lit(None).cast(t).alias(c) for c, t in bags.dtypes}
    words = counts.select(*({**none, "chunk": "chunk", "kind": F.lit(WORDS).alias("kind"), "lid": "lid", "c": "c"}).values())
    found = values.select(*({**none, "chunk": "chunk", "kind": F.lit(GRAMS).alias("kind"), "lid": "lid", "items": "items", "body": "body"}).values())
    both = words.unionAll(found).unionAll(bags)
    out = both.repartition("chunk").sortWithinPartitions("chunk", "kind", "lid").mapInArrow(_base(total, distinct, bits), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double")
    return out.withColumnRenamed("doc_id", id_col)
