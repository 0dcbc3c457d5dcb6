"""Secret scan with a recursive decoding worklist.

Every whole text is scanned for three kinds of secret. A text with percent escapes, or with backslash
Unicode escapes, is decoded as a whole; runs that look like base64 (also wrapped over lines, and from
each alignment that a '/', '-', '_' or line break begins) are decoded each; gzip, zlib, bzip2 and xz
data is opened wherever it begins in decoded bytes, and deflate data without a header where it is all of
them. Bytes with a zero beside most of them are read as UTF-16 too. Bytes that are no UTF-8 become replacement
characters. All these are layers: each layer is scanned and searched for further runs, and so on until nothing new appears. A
layer text seen before in the document is not opened again, so cycles end. Spans of decoded layers
are mapped back to the code points of the original text that carry them.

Defined results: a null text counts as empty and gives no spans; repeated rows each give a row; an
empty table gives an empty result; extra columns are not read. Compressed data is opened whole, with
all its members, in pieces of ``max_layer`` bytes of which each begins with the half of the one
before; that bounds the memory of a task (a layer's places are arrays of 16 bytes a character). An
encoded run or secret longer than half a piece may be read in parts.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import itertools
import lzma
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# fixed values: the three kinds of secret, in the order that breaks ties
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
KEYWORDS = (b"passw", b"secret", b"token", b"apikey", b"api_key")

ESCAPED_URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ONE_UNICODE = re.compile(r"\\u[Dd][89ABab][0-9A-Fa-f]{2}\\u[Dd][C-Fc-f][0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|\\u\{[0-9A-Fa-f]{1,6}\}|%u[0-9A-Fa-f]{4}")
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{16,}[\x20\t]*\r?\n[\x20\t]*)+[A-Za-z0-9+/_-]+={0,2}")
COMPRESSED = re.compile(rb"\x1f\x8b\x08|BZh[1-9]1AY&SY|\xfd7zXZ\x00|x[\x01\x5e\x9c\xda]")

MAX_LAYER = 16 << 20
REPLACED = re.compile("[\udc80-\udcff]")


def find_secrets(text: str) -> list[tuple[int, int, int]]:
    """(start, index of kind, end) of the secrets that stand in a text as they are."""
    found = []
    low = text.encode("utf-8", "replace").lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


class _Zlib:
    """zlib's decompressor with the interface of the others."""

    def __init__(self, bits: int):
        self.own, self.needs_input = zlib.decompressobj(bits), True

    eof = property(lambda self: self.own.eof)
    unused_data = property(lambda self: self.own.unused_data)

    def decompress(self, data: bytes, limit: int) -> bytes:
        out = self.own.decompress(self.own.unconsumed_tail + data, limit)
        self.needs_input = not self.own.unconsumed_tail and len(out) < limit
        return out


def _decoder(head: bytes):
    """A decompressor for the data that begins so; None if it isn't compressed."""
    if head[:2] == b"\x1f\x8b":
        return _Zlib(31)
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if head[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor()
    if head[:1] == b"\x78" and len(head) > 2 and (head[0] * 256 + head[1]) % 31 == 0:
        return _Zlib(15)
    return None


def _members(chunks: Iterator[bytes], size: int, left: list[int] | None = None) -> Iterator[bytes]:
    """The content of compressed data, member after member, in parts of up to size bytes; left gets the count of bytes after the last whole member."""
    rest = next(chunks, b"")
    while True:
        while len(rest) < 6 and (more := next(chunks, b"")):
            rest += more
        if (d := _decoder(rest)) is None:
            return
        try:
            while not d.eof:
                if out := d.decompress(rest, size):
                    yield out
                rest = b""
                if not d.eof and d.needs_input and not (rest := next(chunks, b"")):
                    return
        except (zlib.error, OSError, lzma.LZMAError, EOFError, ValueError):
            return
        rest = d.unused_data
        if left is not None:
            left[:] = [len(rest)]
        while not (rest := rest.lstrip(b"\0")) and (more := next(chunks, b"")):  # members may be padded
            rest = more


def _recorded(parts: Iterator[bytes], read: list[bytes]) -> Iterator[bytes]:
    """The parts, which read keeps until an empty one is put there."""
    for x in parts:
        if not read or read[-1]:
            read.append(x)
        else:
            read[:] = [b""]
        yield x


def _inflate(data: bytes, limit: int, left: list[int]) -> Iterator[bytes]:
    """Pieces of the content of compressed bytes, of the innermost where one is in another."""
    half, seen = max(limit // 2, 1), set()
    parts = _members(iter([data]), half, left)
    while first := next(parts, b""):
        parts = itertools.chain([first], parts)
        if _decoder(first) is None or first in seen:
            break
        seen.add(first)
        read: list[bytes] = []
        inner = _members(_recorded(parts, read), half)
        if not (begin := next(inner, b"")):
            parts = itertools.chain(read, parts)
            break
        read.append(b"")  # an end: nothing more is kept
        parts = itertools.chain([begin], inner)
    yield from _pieces(parts, half)


def _pieces(parts: Iterator[bytes], half: int) -> Iterator[bytes]:
    """Pieces of twice a size, of which each begins with the second half of the one before."""
    held = b""
    for part in parts:
        held += part
        while len(held) >= 2 * half:
            yield held[: 2 * half]
            held = held[half:]
    if held:
        yield held


class Layer:
    """A decoded text with, for each code point, the original code points that carry it: arrays, or one number for all. None stands for the original text itself."""

    def __init__(self, text: str, starts: np.ndarray | int | None = None, ends: np.ndarray | int | None = None):
        self.text, self.starts, self.ends = text, starts, ends

    def first(self, at):
        """The first original code points of those at some places (a number or an array)."""
        return at if self.starts is None else self.starts if isinstance(self.starts, int) else self.starts[at]

    def end(self, at):
        """The ends of the original code points of those before some places."""
        return at if self.ends is None else self.ends if isinstance(self.ends, int) else self.ends[at - 1]

    def inner(self, text: str, lo: np.ndarray, hi: np.ndarray) -> Layer:
        """A layer whose code point i comes from this one's [lo[i], hi[i])."""
        return Layer(text, self.first(lo), self.end(hi))

    def whole(self, text: str, lo: int, hi: int) -> Layer:
        return Layer(text, int(self.first(lo)), int(self.end(hi)))


def _inflated(layer: Layer, data: bytes, lo: np.ndarray, hi: np.ndarray, limit: int) -> Iterator[Layer]:
    """What is compressed in bytes with their places in a layer, also one in another."""
    end = 0
    for m in COMPRESSED.finditer(data):
        if m.start() >= end:  # not within what was opened
            left: list[int] = []
            for piece in _inflate(data[m.start() :], limit, left):
                yield layer.whole(piece.decode("utf-8", "replace"), int(lo[m.start()]), int(hi[-1]))
            end = len(data) - left[0] if left else end


def _byte_lengths(text: str) -> np.ndarray:
    """How many bytes of UTF-8 each character has; a surrogate stands for one."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return 1 + ((code > 0x7F) & ((code < 0xD800) | (code > 0xDFFF))).astype(np.int64) + ((code > 0x7FF) & ((code < 0xD800) | (code > 0xDFFF))) + (code > 0xFFFF)


def _from_bytes(layer: Layer, data: bytes, lo: np.ndarray, hi: np.ndarray, limit: int) -> Iterator[Layer]:
    """Bytes with their places in a layer, as text with places, and what is compressed in them."""
    # a byte that is no UTF-8 becomes a surrogate of its own, and then a replacement character
    text = data.decode("utf-8", "surrogateescape")
    if text:
        ends = np.cumsum(_byte_lengths(text))
        yield layer.inner(text if data.isascii() else REPLACED.sub("\ufffd", text), lo[np.concatenate([[0], ends[:-1]])], hi[ends - 1])
    for units in _utf16(data):
        at = 2 * np.arange(len(units))
        yield layer.inner(units.astype("<u4").tobytes().decode("utf-32-le", "replace"), lo[at], hi[at + 1])
    yield from _inflated(layer, data, lo, hi, limit)
    if _is_deflate(data, limit):
        for piece in _pieces(_deflated(data, max(limit // 2, 1)), max(limit // 2, 1)):
            yield layer.whole(piece.decode("utf-8", "replace"), int(lo[0]), int(hi[-1]))


def _utf16(data: bytes) -> Iterator[np.ndarray]:
    """The code units of bytes that look like UTF-16: at least three in four have a zero as their high byte."""
    n = len(data) // 2
    if n >= 4:
        for high, kind in ((1, "<u2"), (0, ">u2")):
            if 4 * data[high : 2 * n : 2].count(0) >= 3 * n:
                yield np.frombuffer(data, kind, n)


def _deflated(data: bytes, size: int) -> Iterator[bytes]:
    """The content of deflate data without a header, in parts, and at last whether it was whole and all."""
    d, rest = _Zlib(-15), data
    while not d.eof:
        try:
            out = d.decompress(rest, size)
        except zlib.error:
            return
        rest = b""
        if out:
            yield out
        elif d.needs_input and not d.eof:
            return
    if not d.unused_data:
        yield b""


def _is_deflate(data: bytes, limit: int) -> bool:
    """Whether bytes are deflate data without a header and nothing else; the first piece has to be text."""
    if len(data) < 12 or data[0] & 6 == 6:
        return False
    last = first = None
    for last in _deflated(data, max(limit // 2, 1)):
        if first is None:
            first = last[:4096]
            if first.decode("utf-8", "ignore").isprintable() is False and sum(b < 9 for b in first) * 8 > len(first):
                return False
    return bool(first) and last == b""


def _open_url(layer: Layer, limit: int) -> Iterator[Layer]:
    """The text with its percent escapes decoded."""
    data, lo, hi, at, t = bytearray(), [], [], 0, layer.text

    def plain(end: int):
        if end > at:
            part = t[at:end].encode("utf-8", "surrogatepass")
            data.extend(part)
            # a byte that goes on in a character belongs to the place of its first one
            place = np.arange(at, end) if len(part) == end - at else at - 1 + np.cumsum((np.frombuffer(part, np.uint8) & 0xC0) != 0x80)
            lo.append(place)
            hi.append(place + 1)

    for m in ESCAPED_URL.finditer(t):
        plain(m.start())
        at = m.end()
        data.extend(bytes.fromhex(m.group().replace("%", "")))
        lo.append(np.arange(m.start(), at, 3))
        hi.append(np.arange(m.start() + 3, at + 1, 3))
    if at:
        plain(len(t))
        yield from _from_bytes(layer, bytes(data), np.concatenate(lo), np.concatenate(hi), limit)


def _open_unicode(layer: Layer, limit: int) -> Iterator[Layer]:
    """The text with its backslash escapes decoded; two surrogates are one character, one alone is none."""
    out, lo, hi, at, t = [], [], [], 0, layer.text
    for m in ONE_UNICODE.finditer(t):
        out.append(t[at : m.start()])
        lo.append(np.arange(at, m.start() + 1))
        hi.append(np.append(np.arange(at + 1, m.start() + 1), m.end()))
        e, at = m.group(), m.end()
        code = int(e[2:].strip("{}"), 16) if len(e) != 12 else 0x10000 + (int(e[2:6], 16) - 0xD800 << 10) + int(e[8:], 16) - 0xDC00
        out.append("\ufffd" if code > 0x10FFFF or 0xD800 <= code < 0xE000 else chr(code))
    if at:
        out.append(t[at:])
        lo, hi = np.concatenate([*lo, np.arange(at, len(t))]), np.concatenate([*hi, np.arange(at + 1, len(t) + 1)])
        text = "".join(out)
        yield layer.inner(text, lo, hi)
        # escapes of bytes are characters below 256
        yield from _inflated(layer, text.encode("latin-1", "replace"), lo, hi, limit)


def _open_base64(layer: Layer, m: re.Match, limit: int) -> Iterator[Layer]:
    run, at = m.group(), np.arange(m.start(), m.end())
    starts = [0, *(x.end() for x in re.finditer(r"[/_-]|\s+", run))]
    if m.start() and layer.text[m.start() - 1] == "\\":  # the letter of an escaped line break
        starts.append(1)
    if any(map(str.isspace, run)):
        kept = np.array([not c.isspace() for c in run])
        place = np.cumsum(kept) - 1
        starts = [int(place[i]) for i in starts if i < len(kept) and kept[i]]
        run, at = "".join(run.split()), at[kept]
    run = run.rstrip("=").replace("-", "+").replace("_", "/")
    first: dict[int, int] = {}
    for i in sorted(starts):
        first.setdefault(i % 4, i)
    for a in first.values():
        part = run[a:]
        if len(part) % 4 == 1:
            part = part[:-1]
        if len(part) < 8:
            continue
        data = base64.b64decode(part + "=" * (-len(part) % 4))
        j = np.arange(len(data))
        yield from _from_bytes(layer, data, at[a + j * 8 // 6], at[a + (j * 8 + 7) // 6] + 1, limit)


def _layers(layer: Layer, limit: int) -> Iterator[Layer]:
    """The layers just under one."""
    t = layer.text
    if "%" in t:
        yield from _open_url(layer, limit)
    if "\\" in t or "%u" in t:
        yield from _open_unicode(layer, limit)
    for pattern in (BASE64, WRAPPED):
        for m in pattern.finditer(t):
            yield from _open_base64(layer, m, limit)


def decoded_layers(text: str, limit: int = MAX_LAYER) -> Iterator[Layer]:
    """The layers under a text, to the fixpoint; equal layer texts are opened once for each place."""
    # a layer's own layers come before the next one is made, so that pieces are not held together
    work, seen = [_layers(Layer(text), limit)], set()
    while work:
        if (x := next(work[-1], None)) is None:
            work.pop()
        elif x.text:
            key = hashlib.blake2b(x.text.encode("utf-8", "replace"), digest_size=16).digest() + int(x.first(0)).to_bytes(8) + int(x.end(len(x.text))).to_bytes(8)
            if key not in seen:
                seen.add(key)
                yield x
                work.append(_layers(x, limit))


def scan(text: str | None, limit: int = MAX_LAYER) -> tuple[list, list]:
    """The base spans and all spans (base and decoded) of a text, as sorted (start, kind index, end)."""
    text = text or ""
    base = find_secrets(text)
    more = {(int(x.first(a)), k, int(x.end(b))) for x in decoded_layers(text, limit) for a, k, b in find_secrets(x.text)}
    return base, sorted({*base, *more})


def _join(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


SCHEMA = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_decoded long"


def scan_secrets(docs: DataFrame, *, id_col="doc_id", text_col="text", max_layer=MAX_LAYER) -> DataFrame:
    """For each document: counts of base spans by kind, their digest, all spans, and how many only decoding found."""

    def run(batches):
        for b in batches:
            out = []
            for text in b.column(1).to_pylist():
                base, spans = scan(text, max_layer)
                kinds = [k for _, k, _ in base]
                out.append((kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(_join(base).encode()).hexdigest(), _join(spans), len(spans) - len(base)))
            cols = list(zip(*out, strict=True)) or [[]] * 6
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=[id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_decoded"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, {SCHEMA}")
