"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts are compared in small letters (A-Z only) with white space folded. A document leaks an item
when some window of the item, ``WINDOW`` bytes long (the whole item if shorter), stands in the
document within an edit budget of ``RATE`` of the window. By the q-gram lemma such a window shares
w + 1 - q * (e + 1) q-grams with the document, all on e + 1 neighbouring diagonals. So hits of the
items' q-grams are counted in overlapping bands of diagonals, bands are kept that reach the bound
within one window, and the kept windows are verified by alignment inside the band.

The benchmark is read in blocks of at most ``block_bytes``; only one block's index is with a task
at a time, so its size is bounded whatever the benchmark's, and each block meets all documents. Long
items are indexed in overlapping segments. Where texts and items have more q-grams in common than
``HITS`` (boilerplate, repetitive texts), the pairs are worked off in parts: by texts, then by ranges of
segments, then by overlapping pieces of the text; every window lies whole in some part.

Defined results: null and blank texts leak nothing, null and blank items are leaked by nothing;
items of fewer than q bytes leak where they stand whole between spaces; repeated items each give a
row and repeated documents each give their rows; empty tables give an empty result. Ids of both
tables may be of any type, also null.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

Q, WINDOW, RATE = 10, 100, 0.06
BLOCK_BYTES = 8 << 20
CHUNK = 1 << 20
#: Bytes of a segment of an item, and hits that are sorted at once.
SEGMENT, HITS = 4096, 1 << 20
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def folded(text: str | None) -> bytes:
    return b" ".join((text or "").encode("utf-8", "replace").lower().split())


def grams(data: bytes) -> np.ndarray:
    """A hash of the q-gram at each place (q = 10: two overlapping reads of eight bytes)."""
    n = len(data) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    read = lambda at: np.ndarray((n,), "<u8", data, at, (1,))
    return read(0) * _M1 ^ (read(Q - 8) * _M2 >> np.uint64(7))


def budget(size: int) -> tuple[int, int, int]:
    """Window, edits allowed in it and shared q-grams needed, for an item of so many bytes."""
    w = min(size, WINDOW)
    e = max(0, min(int(RATE * w), (w - Q) // Q))
    return w, e, w + 1 - Q * (e + 1)


def banded_distance(window: bytes, text: bytes, low: int, high: int, most: int | None = None) -> tuple[int, int]:
    """Least edits that turn the window into a piece of text whose alignment stays on diagonals low..high, and where that piece ends; ends early, with a number above it, once over most."""
    w, width = len(window), high - low + 1
    # the text bytes that row k meets on each diagonal; -1, which equals nothing, outside the text
    padded = np.full(w + width - 1, -1, np.int16)
    a, z = max(low, 0), min(low + len(padded), len(text))
    if a < z:
        padded[a - low : z - low] = np.frombuffer(text, np.uint8)[a:z]
    differs = (np.lib.stride_tricks.sliding_window_view(padded, width) != np.frombuffer(window, np.uint8)[:, None]).astype(np.int32)
    steps = np.arange(width, dtype=np.int32)
    row = np.zeros(width, np.int32)
    for k in range(w):
        new = row + differs[k]
        np.minimum(new[:-1], row[1:] + 1, out=new[:-1])  # the item's byte is left out
        row = np.minimum.accumulate(new - steps) + steps  # bytes of the text are left out
        if most is not None and not k & 7 and row.min() > most:
            break
    k = int(row.argmin())
    return int(row[k]), low + w + k


def segments(text: bytes) -> list[tuple[int, bytes]]:
    """First byte and bytes of the pieces of an item; every window is whole in one."""
    step = SEGMENT - WINDOW
    return [(a, text[a : a + SEGMENT]) for a in range(0, max(1, len(text) - WINDOW), step)]


class Index:
    """The q-grams of a block of items, by their segments."""

    def __init__(self, items: list[tuple]):
        self.ids = [i for i, _ in items]
        whole = [t for _, t in items]
        self.short = {t: [k for k, u in enumerate(whole) if u == t] for t in whole if 0 < len(t) < Q}
        parts = [(k, a, t) for k, u in enumerate(whole) for a, t in segments(u)]
        self.owner, self.offset, self.texts = [k for k, _, _ in parts], [a for _, a, _ in parts], [t for _, _, t in parts]
        self.budgets = np.array([budget(len(t)) for t in self.texts], np.int64).reshape(-1, 3)
        codes = [grams(t) for t in self.texts]
        self.codes, rank = np.unique(np.concatenate([np.zeros(0, np.uint64), *codes]), return_inverse=True)
        part = np.repeat(np.arange(len(parts)), [len(c) for c in codes])
        place = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(c)) for c in codes)])
        key = rank * max(1, len(parts)) + part
        order = np.argsort(key, kind="stable")
        #: sorted by q-gram, then segment, then place
        self.key, self.part, self.place = key[order], part[order], place[order]
        self.maybe = np.zeros(1 << 21, bool)
        self.maybe[(self.codes >> np.uint64(43)).astype(np.int64)] = True
        self.step = int(self.budgets[:, 1].max(initial=0)) + 1

    def search(self, data: bytes, starts: np.ndarray) -> dict[int, list[tuple]]:
        """The leaks of each text in data; starts has the texts' first bytes, and the end."""
        out: dict[int, list[tuple]] = {}
        code = grams(data)
        at = np.flatnonzero(self.maybe[(code >> np.uint64(43)).astype(np.int64)]) if len(self.codes) else np.zeros(0, np.int64)
        rank = np.searchsorted(self.codes, code[at])
        rank[rank == len(self.codes)] = 0
        known = self.codes[rank] == code[at] if len(at) else np.zeros(0, bool)
        at, rank = at[known], rank[known]
        text = np.searchsorted(starts, at, "right") - 1
        found: set[tuple[int, int]] = set()
        tried: set[tuple] = set()
        work = [(0, len(at), 0, len(self.texts))]
        while work:
            lo, hi, a, b = work.pop()
            first = np.searchsorted(self.key, rank[lo:hi] * len(self.texts) + a)
            count = np.searchsorted(self.key, rank[lo:hi] * len(self.texts) + b) - first
            total = int(count.sum())
            if not total or b - a == 1 and text[lo] == text[hi - 1] and (int(text[lo]), self.owner[a]) in found:
                continue
            if total > HITS:
                half = (lo + hi) // 2
                overlap = WINDOW + 4 * self.step
                if text[lo] != text[hi - 1]:  # between texts
                    cut = int(np.searchsorted(text[lo:hi], text[half])) + lo
                    cut = cut if cut > lo else int(np.searchsorted(text[lo:hi], text[half], "right")) + lo
                    work += [(cut, hi, a, b), (lo, cut, a, b)]
                    continue
                if b - a > 1:
                    work += [(lo, hi, (a + b) // 2, b), (lo, hi, a, (a + b) // 2)]
                    continue
                if at[hi - 1] - at[lo] > 4 * overlap:  # one text, one segment
                    middle = (at[hi - 1] + at[lo]) // 2
                    work += [(int(np.searchsorted(at[lo:hi], middle)) + lo, hi, a, b), (lo, int(np.searchsorted(at[lo:hi], middle + overlap)) + lo, a, b)]
                    continue
            some = count > 0
            first, count, here = first[some], count[some], np.arange(lo, hi)[some]
            rows = np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(total)
            here = np.repeat(here, count)
            for k, leak in self.leaks(data, starts, text[here], at[here], self.part[rows], self.place[rows], found, tried):
                out.setdefault(k, []).append(leak)
        if self.short:
            for k in range(len(starts) - 1):
                padded = b" " + data[starts[k] : starts[k + 1] - 1] + b" "
                for t, items in self.short.items():
                    if (p := padded.find(b" " + t + b" ")) >= 0:
                        out.setdefault(k, []).extend((self.ids[i], 0, 0, len(t), p, p + len(t)) for i in items)
        return out

    def leaks(self, data, starts, text, at, part, place, found: set, tried: set):
        """Text and leak of each pair with a window that keeps the budget, from hits."""
        band = (at - place) // self.step
        # each diagonal is in two bands of 2 * step diagonals
        text, part, at, place, band = (np.concatenate([x, y]) for x, y in ((text, text), (part, part), (at, at), (place, place), (band, band - 1)))
        order = np.lexsort((place, band, part, text))
        text, part, at, place, band = text[order], part[order], at[order], place[order], band[order]
        w, _, need = self.budgets[part].T
        last = np.arange(len(at)) + need - 1
        inside = last < len(at)
        last[~inside] = 0
        kept = inside & (text[last] == text) & (part[last] == part) & (band[last] == band) & (place[last] - place <= w - Q)
        for j in np.flatnonzero(kept).tolist():
            k, p = int(text[j]), int(part[j])
            if (k, self.owner[p]) in found:
                continue
            begin = int(starts[k])
            if leak := self.verify(k, data[begin : int(starts[k + 1]) - 1], p, int(band[j]) * self.step - begin, int(at[j] - place[j]) - begin, int(place[j]), int(place[last[j]]), tried):
                found.add((k, self.owner[p]))
                yield k, (self.ids[self.owner[p]], *leak)

    def verify(self, text_no: int, text: bytes, part: int, diagonal: int, own: int, first: int, last: int, tried: set) -> tuple | None:
        """edits, item start, item end, text start and text end of a window around places first..last of a segment, if one keeps the budget; own is the diagonal of the first hit."""
        w, e, _ = self.budgets[part].tolist()
        whole, offset = self.texts[part], self.offset[part]
        windows = range(max(0, last + Q - w), min(first, len(whole) - w) + 1)
        for a in windows[:1]:  # most leaks are exact
            if own + a >= 0 and text[own + a : own + a + w] == whole[a : a + w]:
                return 0, offset + a, offset + a + w, own + a, own + a + w
        for a in windows:
            if (key := (text_no, part, diagonal, a)) in tried:
                continue
            tried.add(key)
            low, high = diagonal + a, diagonal + a + 2 * self.step - 1
            origin = max(0, low - 1)
            edits, end = banded_distance(whole[a : a + w], text[origin : high + w + 1], low - origin, high - origin, e)
            if edits <= e:
                return edits, offset + a, offset + a + w, max(0, origin + end - w), origin + end
        return None


def find_leaks(index: Index, texts: list[str | None]) -> list[list[tuple]]:
    """For each text its leaks (item id, edits, item start, item end, text start, text end), in bytes of the folded texts."""
    out: list[list[tuple]] = [[] for _ in texts]
    held: list[bytes] = []
    first = size = 0

    def flush():
        starts = np.concatenate([[0], np.cumsum([len(d) + 1 for d in held])])
        for k, leaks in index.search(b"\n".join(held) + b"\n", starts).items():
            out[first + k] = leaks

    for i, t in enumerate(texts):
        held.append(folded(t))
        size += len(held[-1])
        if size >= CHUNK:
            flush()
            held, first, size = [], i + 1, 0
    if held:
        flush()
    return out


def index_blocks(benchmark: DataFrame, *, item_col="item_id", text_col="text", block_bytes=BLOCK_BYTES):
    """Indexes over the benchmark, a block at a time."""
    held: list[tuple] = []
    size = 0
    for r in benchmark.select(F.col(item_col), F.col(text_col)).toLocalIterator():
        if t := folded(r[1]):
            held.append((r[0], t))
            size += len(t)
        if size >= block_bytes:
            yield Index(held)
            held, size = [], 0
    if held:
        yield Index(held)


LEAK = "edits int, item_start int, item_end int, text_start int, text_end int"


def leaks(docs: DataFrame, benchmark: DataFrame, *, id_col="doc_id", text_col="text", item_col="item_id", **options) -> DataFrame:
    """A row for each document and item that it leaks, with the window found and its place in the folded text, in bytes."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    item_kind = benchmark.schema[item_col].dataType
    kinds = [to_arrow_type(item_kind)] + [pa.int32()] * 5
    names = [id_col, "item_id", *(x.split()[0] for x in LEAK.split(", "))]
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, item_id {item_kind.simpleString()}, {LEAK}"

    def search(shared):
        def run(batches):
            for b in batches:
                found = [(k, *leak) for k, some in enumerate(find_leaks(shared.value, b.column(1).to_pylist())) for leak in some]
                cols = list(zip(*found, strict=True)) or [[]] * len(names)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(cols[0], pa.int64())), *(pa.array(c, k) for c, k in zip(cols[1:], kinds, strict=True))], names=names)

        return run

    parts = [rows.mapInArrow(search(spark.sparkContext.broadcast(index)), schema) for index in index_blocks(benchmark, item_col=item_col, **options)]
    return reduce(DataFrame.unionAll, parts) if parts else spark.createDataFrame([], schema)


def clean_documents(docs: DataFrame, benchmark: DataFrame, *, text_col="text", **options) -> DataFrame:
    """The documents that leak no item, in their own columns; no shuffle."""

    def drop(shared):
        def run(batches):
            for b in batches:
                yield b.filter(pa.array([not x for x in find_leaks(shared.value, b.column(text_col).to_pylist())], pa.bool_()))

        return run

    for index in index_blocks(benchmark, **options):
        docs = docs.mapInArrow(drop(docs.sparkSession.sparkContext.broadcast(index)), docs.schema)
    return docs
