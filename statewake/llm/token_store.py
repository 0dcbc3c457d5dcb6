"""Token ids in a directly addressable binary format.

Documents are dealt out by ranges of their id and tokenised in ascending order. The ids go into
segments; a segment's bytes are one file image:

    magic "DAC1", u8 bits of a chunk, u8 levels, u32 documents, u64 ids,
    documents x i64 id (null as the smallest i64), (documents + 1) x u64 first id of each document,
    then for each level: u64 chunks, chunks (u8), continuation bitmap, rank directory (u64 for every 512 bits)

Level 0 has the low 8 bits of each id; a set continuation bit says that the id goes on in the next
level, at the rank of the bit. ``access`` reads any token with one step a level and no block is
decoded. Segments are written as a table in the shared folder (one row, one file image), because on
a cluster only Spark's own writers reach that folder; ``export_files`` puts them into plain files.

Defined results: a null text counts as empty and has the end id alone; null ids come first; rows
with equal ids stay separate, in the order of their texts' hashes, so that reruns agree; an empty
table gives an empty result; only the id (an integer) and the text are read. A document is never
split, so a segment holds ``segment_ids`` ids and at most one document more.
"""

from __future__ import annotations

import os
import struct
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statewake.llm.common import Scratch

MAGIC, BITS, BLOCK = b"DAC1", 8, 512
HEAD = struct.Struct("<4sBBIQ")
NULL_ID = -(1 << 63)
SEGMENT_IDS = 1 << 20
#: Words whose ids a task keeps at hand; the table is emptied when full, which changes no result.
CACHE_WORDS = 1_000_000
#: Marks that end a word as one piece: not the apostrophe, nor what special tokens are written with.
MARKS = b"!\"#$%&()*+,-./:;=?@[\\]^_`{}~"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokenizer:
    """Ids of whole texts. The vocabulary's pre-tokenizer drops white space, so that no piece spans it and a text's ids are those of its words.

    The vocabulary has small letters only, so A-Z are made small beforehand, but where a text may
    name a special token, whose case counts. Ids of words are kept for as long as the worker process
    lives, whatever tasks it runs.
    """

    kept: dict[str, WordTokenizer] = {}

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer, self.ids = Tokenizer.from_file(path), {}
        vocabulary = self.tokenizer.get_vocab()
        #: ids that end a piece
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        # for words of letters alone, made small: nothing is left to normalise or to split but at spaces
        self.small = Tokenizer.from_file(path)
        self.small.normalizer = normalizers.Sequence([])
        self.small.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=False)])
        # letters that stay one piece among others (not so U+0130, which normalisation takes apart)
        latin = [c for c in map(chr, range(0x250)) if c.isalpha()]
        ids = lambda t, texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
        whole, small = ids(self.tokenizer, [f"a{c}a" for c in latin]), ids(self.small, [f"a{c.lower()}a" for c in latin])
        self.plain = {c for c, x, y in zip(latin, whole, small, strict=True) if x == y and self.pieces(x) == 1}

    def pieces(self, ids: list[int]) -> int:
        """How many pieces ids are; 0 where the last one doesn't end."""
        return int(self.ends[ids].sum()) if ids and self.ends[ids[-1]] else 0

    def learn(self, words: list[bytes]) -> None:
        """Tokenise words. Those of plain letters are one piece each, so all go as one text that is cut where pieces end; marks after letters are a piece of their own. Where the cuts are not as many as the words, and for all other words, each is tokenised by itself."""
        ids, letters, marked, tails, rest = self.ids, {}, [], {}, []
        for w in words:
            bare = w.rstrip(MARKS)
            text = bare.decode()
            if text and self.plain.issuperset(text):
                if bare not in ids:
                    letters[bare] = text
                if len(bare) != len(w):
                    marked.append((w, bare, tail := w[len(bare) :]))
                    if tail not in ids:
                        tails[tail] = None
            else:
                rest.append(w)
        if letters:
            got = np.array(self.small.encode_batch_fast([" ".join(letters.values()).lower()], add_special_tokens=False)[0].ids, np.uint32)
            cuts = [0, *((np.flatnonzero(self.ends[got]) + 1) * 4).tolist()]
            if len(cuts) == len(letters) + 1 and cuts[-1] == 4 * len(got):
                data = got.tobytes()
                ids.update((w, data[a:z]) for w, a, z in zip(letters, cuts, cuts[1:], strict=False))
            else:
                rest += letters
        rest = list(dict.fromkeys([*rest, *tails]))
        for w, e in zip(rest, self.tokenizer.encode_batch([w.decode() for w in rest], add_special_tokens=False), strict=True):
            ids[w] = array("I", e.ids).tobytes()
        for w, bare, tail in marked:
            ids[w] = ids[bare] + ids[tail]

    @classmethod
    def of(cls, path: str) -> WordTokenizer:
        if path not in cls.kept:
            cls.kept[path] = cls(path)
        return cls.kept[path]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        data = [(t or "").encode() for t in texts]
        split = [(d if b"<|" in d else d.lower()).split() for d in data]
        if len(self.ids) > CACHE_WORDS:
            self.ids.clear()
        if new := [w for w in set().union(*split) if w not in self.ids]:
            self.learn(new)
        get = self.ids.__getitem__
        return [np.frombuffer(b"".join(map(get, ws)), np.uint32) for ws in split]


def encode_segment(doc_ids: list[int | None], docs: list[np.ndarray]) -> bytes:
    """The file image of documents' token ids."""
    ids = np.concatenate(docs) if docs else np.zeros(0, np.uint32)
    starts = np.zeros(len(docs) + 1, "<u8")
    np.cumsum([len(d) for d in docs], out=starts[1:])
    levels, rest = [], ids.astype(np.uint64)
    while not levels or len(rest):
        more = rest >= 1 << BITS
        bits = np.packbits(more, bitorder="little")
        ones = np.add.reduceat(more, np.arange(0, len(more), BLOCK), dtype=np.uint64) if len(more) else np.zeros(0, np.uint64)
        ranks = np.concatenate([[0], np.cumsum(ones)]).astype("<u8")
        levels.append(struct.pack("<Q", len(rest)) + (rest & ((1 << BITS) - 1)).astype(np.uint8).tobytes() + bits.tobytes() + ranks.tobytes())
        rest = rest[more] >> np.uint64(BITS)
    head = HEAD.pack(MAGIC, BITS, len(levels), len(docs), len(ids))
    return head + np.array([NULL_ID if d is None else d for d in doc_ids], "<i8").tobytes() + starts.tobytes() + b"".join(levels)


class Segment:
    """A file image opened for reading."""

    def __init__(self, data: bytes):
        magic, self.bits, n_levels, n_docs, self.n_ids = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token segment")
        at = HEAD.size
        self.doc_ids = [None if x == NULL_ID else x for x in np.frombuffer(data, "<i8", n_docs, at).tolist()]
        self.starts = np.frombuffer(data, "<u8", n_docs + 1, at := at + 8 * n_docs).astype(np.int64)
        at += 8 * (n_docs + 1)
        self.levels = []
        for _ in range(n_levels):
            (n,) = struct.unpack_from("<Q", data, at)
            chunks = np.frombuffer(data, np.uint8, n, at := at + 8)
            bitmap = np.frombuffer(data, np.uint8, (n + 7) // 8, at := at + n)
            ranks = np.frombuffer(data, "<u8", (n + BLOCK - 1) // BLOCK + 1, at := at + len(bitmap))
            at += 8 * len(ranks)
            self.levels.append((chunks, bitmap, ranks))

    def access(self, i: int) -> int:
        """Token i of the segment."""
        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        value = shift = 0
        for chunks, bitmap, ranks in self.levels:
            value |= int(chunks[i]) << shift
            if not bitmap[i >> 3] >> (i & 7) & 1:
                break
            first = i // BLOCK * BLOCK
            bits = np.unpackbits(bitmap[first >> 3 : (i >> 3) + 1], bitorder="little")
            i = int(ranks[i // BLOCK]) + int(bits[: i - first].sum())
            shift += self.bits
        return value

    def all_ids(self) -> np.ndarray:
        values = None
        for chunks, bitmap, _ in reversed(self.levels):
            more = np.unpackbits(bitmap, count=len(chunks), bitorder="little").astype(bool)
            here = chunks.astype(np.uint32)
            if values is not None:
                here[more] |= values << np.uint32(self.bits)
            values = here
        return values

    def document(self, k: int) -> np.ndarray:
        return self.all_ids()[self.starts[k] : self.starts[k + 1]]


def write_segments(docs: DataFrame, scratch: Scratch, *, id_col="doc_id", text_col="text", tokenizer: str | None = None, end_id=1, segment_ids=SEGMENT_IDS) -> DataFrame:
    """The segments as written and read again: part, seq, part_start (ids of the part before), n_ids, image."""
    path = tokenizer or default_tokenizer()

    def run(batches):
        from pyspark import TaskContext

        part, encoder = TaskContext.get().partitionId(), WordTokenizer.of(path)
        seq = done = held = 0
        doc_ids, arrays = [], []

        def flush():
            row = pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "part_start": [done], "n_ids": [held], "image": [encode_segment(doc_ids, arrays)]}, schema=kind)
            doc_ids.clear()
            arrays.clear()
            return row

        kind = pa.schema([("part", pa.int32()), ("seq", pa.int64()), ("part_start", pa.int64()), ("n_ids", pa.int64()), ("image", pa.binary())])
        for b in batches:
            for at in range(0, b.num_rows, 256):
                piece = b.slice(at, 256)
                for d, ids in zip(piece.column(0).to_pylist(), encoder.encode(piece.column(1).to_pylist()), strict=True):
                    doc_ids.append(d)
                    arrays.append(np.append(ids, np.uint32(end_id)))
                    held += len(ids) + 1
                    if held >= segment_ids:
                        yield flush()
                        seq, done, held = seq + 1, done + held, 0
        if doc_ids:
            yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("hash"))
    rows = rows.repartitionByRange("doc_id", "hash").sortWithinPartitions("doc_id", "hash").select("doc_id", "text")
    return scratch.write(rows.mapInArrow(run, "part int, seq long, part_start long, n_ids long, image binary"), "segments")


def read_documents(segments: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of each stored document."""
    # one row for each task that wrote: its first id among all
    first = segments.groupBy("part").agg(F.sum("n_ids").alias("n")).selectExpr("part", "coalesce(sum(n) over (order by part rows between unbounded preceding and 1 preceding), 0) as before")

    def run(batches):
        for b in batches:
            for before, image in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = Segment(image)
                ids = s.all_ids().astype("<u4")
                lens = np.diff(s.starts)
                crc = [zlib.crc32(ids[a:z]) for a, z in zip(s.starts[:-1].tolist(), s.starts[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(s.doc_ids, pa.int64()), pa.array(s.starts[:-1] + before, pa.int64()), pa.array(lens, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    # as many rows as tasks wrote segments, 16 bytes each, whatever the size of the corpus
    rows = segments.join(F.broadcast(first), "part").select((F.col("before") + F.col("part_start")).alias("before"), "image")
    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def store_tokens(docs: DataFrame, **options) -> DataFrame:
    scratch = Scratch(docs.sparkSession, "tokens")
    return read_documents(write_segments(docs, scratch, **options))


def export_files(segments: DataFrame, folder: str) -> list[str]:
    """Write each segment as a plain file on the driver, one at a time, in order."""
    os.makedirs(folder, exist_ok=True)
    names = []
    for r in segments.orderBy("part", "seq").toLocalIterator():
        names.append(f"{folder}/{r.part:06d}-{r.seq:06d}.dac")
        with open(names[-1], "wb") as f:
            f.write(r.image)
    return names
