"""Search over a corpus as one operation: keywords, vectors, fusion of both, and passages rolled up to what they belong to.

corpus(item, parent, label, text): items are integers. Vectors are made by a provider, a function from a
list of texts to an array of rows of one width, in Arrow batches; ``hashed_features`` is one that needs
no model file. Null and blank texts have no words: they have a vector of zeros, which is near to nothing.
"""

from __future__ import annotations

import hashlib
import importlib
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from statewake.operators import retrieval

WIDTH = 256
Provider = Callable[[list[str]], np.ndarray]


@lru_cache(maxsize=1 << 18)
def _place(word: str, width: int) -> int:
    return int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % width


def hashed_features(texts: list[str], width: int = WIDTH) -> np.ndarray:
    """Counts of words (runs of ASCII letters and digits in small letters) by a hash of each word, of length one."""
    out = np.zeros((len(texts), width))
    for row, text in zip(out, texts, strict=True):
        for word in re.findall("[a-z0-9]+", text.lower()):
            row[_place(word, width)] += 1
    return out / np.maximum(np.sqrt((out * out).sum(1, keepdims=True)), 1e-300)


def provider_of(name: str) -> Provider:
    """The provider that ``package.module:attribute`` names."""
    module, _, attribute = name.partition(":")
    found = getattr(importlib.import_module(module), attribute, None)
    if not callable(found):
        raise ValueError(f"{name} names no provider")
    return found


def embed(rows: DataFrame, provider: Provider, model: str, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """rows(item, label, text, ...) with embedding and embedding_model, and the labels left out with the reason.

    A label is embedded as a whole or not at all: one row whose vector is missing, of another width or not
    finite leaves the label out. The vectors are written once.
    """

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                texts = [t or "" for t in part.column("text").to_pylist()]
                vectors = np.asarray(provider(texts), np.float64) if texts else np.zeros((0, width))
                good = vectors.ndim == 2 and vectors.shape == (len(texts), width)
                values = [v.tolist() if good and np.isfinite(v).all() else None for v in (vectors if good else [None] * len(texts))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(values, pa.list_(pa.float64()))], names=[*part.schema.names, "embedding"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    made = retrieval._kept(rows.mapInArrow(run, f"{schema}, embedding array<double>"))
    failed = made.groupBy("label").agg(F.count_if(F.col("embedding").isNull()).alias("failed")).where("failed > 0")
    kept = made.join(failed.select("label"), made["label"].eqNullSafe(failed["label"]), "left_anti").withColumn("embedding_model", F.lit(model))
    return kept, failed.select("label", F.concat(F.col("failed").cast("string"), F.lit(" rows without a vector")).alias("reason"))


def require_model(corpus: DataFrame, model: str, width: int) -> None:
    """Raise unless all vectors of a corpus are of one model, the one that the query is made with, and of its width."""
    found = corpus.where("embedding is not null").groupBy("embedding_model").agg(F.min(F.size("embedding")).alias("least"), F.max(F.size("embedding")).alias("most")).limit(2).collect()
    if not found:
        raise ValueError("the corpus has no vectors")
    if len(found) > 1:
        raise ValueError("the corpus has vectors of several models")
    if found[0].embedding_model != model:
        raise ValueError(f"the corpus is of model {found[0].embedding_model}, the query of {model}")
    if {found[0].least, found[0].most} != {width}:
        raise ValueError(f"the corpus has vectors of other widths than {width}")


def _ranked(scored: DataFrame, order: list, k: int) -> DataFrame:
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("q_id").orderBy(*order))).where(F.col("rank") <= k).select("q_id", "item", "rank")


def search(corpus: DataFrame, queries: DataFrame, provider: Provider, model: str, *, k: int = 5, factor: int = 3, width: int = WIDTH) -> DataFrame:
    """The k best parents of each query: q_id, parent, rank, score and sources (keyword, vector or both, of its best passage).

    corpus(item, parent, label, text, embedding, embedding_model), queries(q_id, text), ids integers. Keywords rank by BM25,
    vectors by cosine, k * factor of each label together; both are fused by reciprocal rank, and a parent
    has the score of its best passage. A corpus of another model is refused. Ties go to the lower id.
    """
    require_model(corpus, model, width)
    fetch = k * factor
    keyword = retrieval.bm25(corpus, queries, "item", "q_id", fetch).select("q_id", "item", "rank")
    asked, left_out = embed(queries.select(F.col("q_id").alias("item"), F.lit("q").alias("label"), "text"), provider, model, width)
    if left_out.count():
        raise ValueError("a query has no vector")
    # a query is no row of the corpus: its own item is not left out
    q = asked.select((-1 - F.col("item")).alias("q_id"), F.col("embedding").alias("q"))
    near = retrieval.nearest(corpus.where("embedding is not null"), q, k=fetch, item="item", vector="embedding", index="label").withColumn("q_id", -1 - F.col("q_id"))
    vector = _ranked(near, [F.desc("score"), "label", "item"], fetch)
    sides = [keyword.withColumn("_s", F.lit("keyword")), vector.withColumn("_s", F.lit("vector"))]
    fused = sides[0].unionAll(sides[1]).groupBy("q_id", "item").agg(F.round(F.sum(1 / (60 + F.col("rank"))), 9).alias("score"), F.array_join(F.array_sort(F.collect_set("_s")), "+").alias("sources"))
    best = fused.join(corpus.select("item", "parent"), "item").groupBy("q_id", "parent").agg(F.max("score").alias("score"), F.max_by("sources", F.struct("score", -F.col("item"))).alias("sources"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc("score"), "parent"))).where(F.col("rank") <= k).select("q_id", "parent", "rank", "score", "sources")
