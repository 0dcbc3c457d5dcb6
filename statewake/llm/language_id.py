"""Language identification by a byte convolutional network in numpy.

The network reads windows of ``WINDOW`` bytes: filters of several widths over one-hot bytes (so a
filter is a table of weights by place and byte), max pooling over the window, and softmax. It is
trained on windows of a bounded sample: about ``per_lang`` labelled documents of each language (the
``most_langs`` most frequent ones), chosen by the hash of their id and text, and ``windows_each`` windows
of each. The windows are cut out by the executors, so what reaches the driver is bounded whatever the
length of the texts: at most 2 * per_lang * most_langs * windows_each * WINDOW bytes. Prediction covers every whole text: consecutive windows, the last
one drawn back to end with the text, and the mean of the windows' probabilities by their bytes.

Defined results: ``und`` with score 0 where the text is null, has no letter, or nothing was learned;
rows with a null id or language are not learned from; repeated rows each give a row; an empty table
gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statewake.llm.common import pieces

WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 16
#: Bounds of the training sample: labelled documents of each language, windows of each document, and languages.
PER_LANG, WINDOWS_EACH, MOST_LANGS = 800, 3, 256
EPOCHS, BATCH, RATE, SEED = 12, 64, 0.02, 7
UNKNOWN = "und"


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds."""
    return F.crc32(id_col.cast("string").cast("binary")) % folds


class ByteNet:
    """weights: a (width, 256, filters) table for each width; then a linear layer and softmax."""

    def __init__(self, langs: list[str], seed: int = SEED, filters: int = FILTERS):
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.conv = [rng.normal(0, 0.3, (k, 256, filters)).astype(np.float32) for k in WIDTHS]
        self.bias = np.zeros(filters * len(WIDTHS), np.float32)
        self.out = rng.normal(0, 0.1, (filters * len(WIDTHS), len(langs))).astype(np.float32)
        self.out_bias = np.zeros(len(langs), np.float32)

    def params(self) -> list[np.ndarray]:
        return [*self.conv, self.bias, self.out, self.out_bias]

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The filters' largest responses in each window (n, filters), and where they are."""
        tops, places = [], []
        for w in self.conv:
            n = x.shape[1] - len(w) + 1
            h = w[0][x[:, :n]]
            for j in range(1, len(w)):
                h += w[j][x[:, j : j + n]]
            places.append(h.argmax(1))
            tops.append(np.take_along_axis(h, places[-1][:, None], 1)[:, 0])
        return np.concatenate(tops, 1) + self.bias, places

    def probabilities(self, features: np.ndarray) -> np.ndarray:
        z = np.maximum(features, 0) @ self.out + self.out_bias
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        """Of the weighted sum of the windows' log losses, for each of params()."""
        f, places = self.pooled(x)
        g = self.probabilities(f)
        g[np.arange(len(x)), y] -= 1
        g *= weight[:, None]
        back = (g @ self.out.T) * (f > 0)
        grads, width = [], self.conv[0].shape[2]
        rows, cols = np.arange(len(x))[:, None], np.arange(width)[None, :]
        for k, (w, place) in enumerate(zip(self.conv, places, strict=True)):
            dw, part = np.zeros_like(w), back[:, k * width : (k + 1) * width]
            for j in range(len(w)):
                np.add.at(dw[j], (x[rows, place + j], np.broadcast_to(cols, place.shape)), part)
            grads.append(dw)
        return [*grads, back.sum(0), np.maximum(f, 0).T @ g, g.sum(0)]

    def train(self, x: np.ndarray, y: np.ndarray, epochs=EPOCHS, rate=RATE, seed=SEED) -> ByteNet:
        rng, params = np.random.default_rng(seed), self.params()
        m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        share = np.bincount(y, minlength=len(self.langs)).astype(np.float32)
        weight = (len(y) / np.maximum(share, 1) / len(self.langs))[y]
        for epoch in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), BATCH):
                i = order[at : at + BATCH]
                grads = self.gradients(x[i], y[i], weight[i] / len(i))
                t += 1
                step = rate * (1 - epoch / epochs) + 1e-4
                for p, d, a, b in zip(params, grads, m, v, strict=True):
                    a += 0.1 * (d - a)
                    b += 0.01 * (d * d - b)
                    p -= step * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.99**t)) + 1e-6)
        return self


class Predictor:
    """A trained net with its tables for pairs of bytes, which halve the look-ups."""

    def __init__(self, net: ByteNet):
        self.net, self.tables = net, []
        for w in net.conv:
            parts = [(j, (w[j][:, None, :] + w[j + 1][None, :, :]).reshape(65536, -1), True) for j in range(0, len(w) - 1, 2)]
            self.tables.append((len(w), parts + ([(len(w) - 1, w[-1], False)] if len(w) % 2 else [])))

    def features(self, x: np.ndarray) -> np.ndarray:
        pairs = (x[:, :-1].astype(np.int32) << 8) | x[:, 1:]
        tops = []
        for k, parts in self.tables:
            n, h = x.shape[1] - k + 1, None
            for j, table, double in parts:
                part = table.take((pairs if double else x)[:, j : j + n], axis=0)
                h = part if h is None else np.add(h, part, out=h)
            tops.append(h.max(1))
        return np.concatenate(tops, 1) + self.net.bias

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = []
        for at in range(0, len(texts), 64):
            out += self._predict(texts[at : at + 64])
        return out

    def _predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        data = [t.encode("utf-8", "replace").lower() if t and self.net.langs and any(map(str.isalpha, t)) else b"" for t in texts]
        score = np.zeros((len(texts), len(self.net.langs)))
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for i, d in enumerate(data):
            if d:
                w, size = windows(d)
                held.append((w, size, np.full(len(w), i)))
        if held:
            w, size, owner = (np.concatenate(x) for x in zip(*held, strict=True))
            for a in range(0, len(w), 32):
                p = self.net.probabilities(self.features(w[a : a + 32]))
                np.add.at(score, owner[a : a + 32], p * size[a : a + 32, None])
        result = []
        for d, s in zip(data, score, strict=True):
            k = int(s.argmax()) if d else 0
            result.append((self.net.langs[k], min(1.0, float(s[k] / s.sum()))) if d else (UNKNOWN, 0.0))
        return result


def windows(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """All windows of a text, and how many bytes each adds. Short texts are filled up with zeros."""
    x = np.frombuffer(data, np.uint8)
    full = len(x) // WINDOW
    rows, sizes = x[: full * WINDOW].reshape(full, WINDOW), np.full(full, WINDOW)
    if rest := len(x) - full * WINDOW:
        last = x[-WINDOW:] if full else np.pad(x, (0, WINDOW - len(x)))
        rows, sizes = np.concatenate([rows, last[None]]), np.append(sizes, rest)
    return rows, sizes


def learn(docs: DataFrame, *, id_col="doc_id", text_col="text", lang_col="lang", per_lang=PER_LANG, windows_each=WINDOWS_EACH, most_langs=MOST_LANGS) -> ByteNet:
    """A net trained on about per_lang of the given documents in each language."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.xxhash64(F.lit(SEED), id_col, text_col).alias("h"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_langs).collect()}
    langs = sorted(counts)
    if not langs:
        return ByteNet([])
    limit = F.create_map(*(x for s in langs for x in (F.lit(s), F.lit(min(1 << 30, int(per_lang / counts[s] * (1 << 30)))))))

    def cut(batches):
        for b in batches:
            out = []
            for h, lang, text in zip(*(b.column(c).to_pylist() for c in ("h", "lang", "text")), strict=True):
                if any(map(str.isalpha, text)):
                    w, _ = windows(text.encode("utf-8", "replace").lower())
                    chosen = np.random.default_rng([SEED, h % (1 << 63)]).choice(len(w), min(windows_each, len(w)), replace=False)
                    out.append((h, lang, w[chosen].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 3, (pa.int64(), pa.string(), pa.binary()), strict=True)], names=["h", "lang", "windows"])

    chosen = rows.where(F.pmod("h", F.lit(1 << 30)) < limit[F.col("lang")]).mapInArrow(cut, "h long, lang string, windows binary").distinct()
    sample = chosen.orderBy("h", "lang").limit(2 * per_lang * len(langs)).collect()
    xs = [np.frombuffer(r["windows"], np.uint8).reshape(-1, WINDOW) for r in sample]
    ys = [langs.index(r["lang"]) for r, x in zip(sample, xs, strict=True) for _ in x]
    return ByteNet(langs).train(np.concatenate(xs), np.array(ys)) if xs else ByteNet([])


def predict(docs: DataFrame, net: ByteNet, *, id_col="doc_id", text_col="text") -> DataFrame:
    """lang_pred and score beside the other columns given."""
    docs_columns, rest = docs.columns, [c for c in docs.columns if c != text_col]

    def run(batches):
        model = None
        at = docs_columns.index(text_col)
        for whole in batches:
            model = model or Predictor(net)
            # a slice at a time, so that the windows of many long texts are not held together
            for b in pieces(whole, at, 64, 1 << 20):
                got = model.predict(b.column(text_col).to_pylist())
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=[*rest, "lang_pred", "score"])

    kind = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest)
    return docs.mapInArrow(run, f"{kind}, lang_pred string, score double")


def identify(docs: DataFrame, *, id_col="doc_id", text_col="text", lang_col="lang", folds=4, held=2, **options) -> DataFrame:
    """doc_id, held_out, lang_pred and score: learned outside fold ``held``, predicted everywhere."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.coalesce(fold(F.col(id_col), folds) == held, F.lit(False)).alias("held_out"))
    net = learn(rows.where("not held_out"), **options)
    return predict(rows.select("doc_id", "held_out", "text"), net).withColumnRenamed("doc_id", id_col)
