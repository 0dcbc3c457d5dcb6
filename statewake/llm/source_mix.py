"""Mixing sources to target weights by a low-discrepancy schedule.

Within each source the documents are laid end to end in hashed order and cut into blocks of equally
many words. Slot m of the schedule is the golden-ratio point m * phi mod 1; cumulative weights map
it to a source, the slots of a source are ranked, and rank r takes block r mod (blocks), so that
blocks repeat only after all were taken. Prefix sums run in two levels (bucket, then row), so a
source with any share of the rows is spread over many tasks. The order is that of hashes of id and
text, so rows that share an id (or have none) are spread as well; rows equal in both go as one with
their number until their places are known. Reruns agree, whatever the partitions.

Targets share all words by weight; no target exceeds ``cap`` times its source's size, and the
excess is shared again by weight. What comes to the driver is one row for each source.

Defined results: a null or blank text has size 0 and nothing of it is taken; null sources form one
source, last in order; repeated rows are separate rows; a table without words takes nothing. Ids may
be of any type.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from statewake.llm.common import Scratch, n_words

WEIGHTS, CAP = (5, 2, 1), 3
#: Words in a block, and the fewest blocks of a source that has so many words.
BLOCK_WORDS, LEAST_BLOCKS = 4096, 1024
#: Documents in a bucket of the prefix sums, and slots in a chunk of the ranks.
BUCKET_DOCS, CHUNK_BITS = 4_000, 14
#: 2**32 / golden ratio, odd, so that the points of 2**32 slots all differ.
PHI32, ONE = 2654435769, 1 << 32
CELL_BITS = 20
#: A plan of at most so many sources is broadcast; a larger one is joined by shuffle.
BROADCAST_SOURCES = 50_000


def share_targets(sizes: dict[str | None, int], weights=WEIGHTS, cap=CAP) -> dict[str | None, float]:
    """The words to take from each source."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, target, free = float(sum(sizes.values())), {}, order
    while free:
        rest, per = total - sum(target.values()), sum(weight[s] for s in free)
        over = [s for s in free if rest * weight[s] / per > cap * sizes[s]]
        if not over:
            target |= {s: rest * weight[s] / per for s in free}
            break
        target |= {s: float(cap * sizes[s]) for s in over}
        free = [s for s in free if s not in set(over)]
    return target


def plan_sources(sizes: dict, docs: dict, weights=WEIGHTS, cap=CAP, block_words=BLOCK_WORDS) -> list[dict]:
    """For each source its block size, number of blocks, buckets and stretch [lo, hi) of the points."""
    target, rows = share_targets(sizes, weights, cap), []
    for s in sorted(sizes, key=lambda s: (s is None, s or "")):
        n = sizes[s]
        block = max(1, min(block_words, n // LEAST_BLOCKS))
        blocks = -(-n // block)
        rows.append({"source": s, "source_size": n, "target": target[s], "block": block, "blocks": blocks, "slots": target[s] * blocks / n if n else 0.0, "buckets": max(1, math.ceil(docs[s] / BUCKET_DOCS))})
    all_slots, at = sum(r["slots"] for r in rows), 0.0
    for i, r in enumerate(rows):
        r |= {"sid": i, "lo": round(at / all_slots * ONE) if all_slots else 0}
        at += r["slots"]
        r["hi"] = round(at / all_slots * ONE) if all_slots else 0
    return rows


def _small(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_SOURCES else df


def schedule(spark, plan: list[dict]) -> DataFrame:
    """slot, sid, rank, pass and block of every slot."""
    n = round(sum(r["slots"] for r in plan))
    bounds = spark.createDataFrame([(r["sid"], r["lo"], r["hi"], r["blocks"]) for r in plan if r["hi"] > r["lo"]], "sid int, lo long, hi long, blocks long")
    bounds = bounds.withColumn("cell", F.explode(F.expr(f"sequence(lo >> {CELL_BITS}, (hi - 1) >> {CELL_BITS})")))
    point = f"((((id >> 16) & 65535) * {PHI32} & 65535) * 65536 + (id & 65535) * {PHI32}) & {ONE - 1}"
    slots = spark.range(n).selectExpr("id as slot", f"{point} as point").selectExpr("slot", "point", f"point >> {CELL_BITS} as cell", f"slot >> {CHUNK_BITS} as chunk")
    slots = slots.join(_small(bounds, len(plan)), "cell").where("point >= lo and point < hi").select("slot", "sid", "chunk", "blocks")
    before = slots.groupBy("sid", "chunk").count().withColumn("before", F.sum("count").over(Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))).select("sid", "chunk", F.coalesce("before", F.lit(0)).alias("before"))
    ranked = slots.join(before, ["sid", "chunk"]).withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("sid", "chunk").orderBy("slot")) - 1)
    return ranked.selectExpr("slot", "sid", "rank", "rank div blocks as pass", "rank % blocks as block")


def mix_sources(docs: DataFrame, *, id_col="doc_id", text_col="text", source_col="source", weights=WEIGHTS, cap=CAP, block_words=BLOCK_WORDS, seed=0, keys=()) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document; keys: further columns to keep, by name and expression."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "mix")
    names = [k for k, _ in keys]
    hashed = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), n_words(F.col(text_col)).alias("size"), F.xxhash64(F.lit(seed), id_col, text_col).alias("_h1"), F.xxhash64(F.lit(seed + 1), id_col, text_col).alias("_h2"), *(e.alias(k) for k, e in keys))
    sized = scratch.write(hashed.groupBy("_id", "_source", "size", "_h1", "_h2", *names).agg(F.count("*").alias("copies")), "sizes")
    found = sized.groupBy("_source").agg(F.sum(F.col("size") * F.col("copies")).alias("n"), F.count("*").alias("docs")).collect()
    plan = plan_sources({r["_source"]: r["n"] for r in found}, {r["_source"]: r["docs"] for r in found}, weights, cap, block_words)
    keyed = F.coalesce(F.concat(F.lit("="), F.col("_source")), F.lit(""))
    planned = spark.createDataFrame([("" if r["source"] is None else "=" + r["source"], r["sid"], r["source_size"], r["target"], r["block"], r["buckets"]) for r in plan], "_key string, sid int, source_size long, target double, width long, buckets long")
    rows = sized.withColumn("_key", keyed).join(_small(planned, len(plan)), "_key").drop("_key", "_source").withColumn("bucket", F.expr(f"(pmod(_h1, {1 << 40}L) * buckets) >> 40"))
    worded, span = rows.where("size > 0"), F.col("size") * F.col("copies")
    before = worded.groupBy("sid", "bucket").agg(F.sum(span).alias("n")).withColumn("before", F.sum("n").over(Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).select("sid", "bucket", F.coalesce("before", F.lit(0)).alias("before"))
    within = F.sum(span).over(Window.partitionBy("sid", "bucket").orderBy("_h1", "_h2", "size", *names).rowsBetween(Window.unboundedPreceding, 0))
    placed = worded.withColumn("at", within - span).join(before, ["sid", "bucket"]).withColumn("at", F.col("at") + F.col("before")).drop("bucket", "before", "buckets", "_h1", "_h2")
    placed = placed.withColumn("_copy", F.explode(F.expr("sequence(0L, copies - 1)"))).withColumn("at", F.col("at") + F.col("_copy") * F.col("size")).drop("_copy", "copies")
    parts = placed.withColumn("block", F.explode(F.expr("sequence(at div width, (at + size - 1) div width)")))
    uses = schedule(spark, plan).where(F.col("pass") < cap).groupBy("sid", "block").agg(F.count("*").alias("uses"))
    part = F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * F.col("width")) - F.greatest("at", F.col("block") * F.col("width"))
    # a place holds one document
    taken = parts.join(uses, ["sid", "block"], "left").groupBy("sid", "at", "size", "_id", "source_size", "target", *names).agg(F.sum(part * F.coalesce("uses", F.lit(0))).alias("taken"))
    empty = rows.where("size = 0").withColumn("_copy", F.explode(F.expr("sequence(0L, copies - 1)"))).select("_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"), *names)
    return taken.select("_id", "size", "source_size", "target", "taken", *names).unionByName(empty).withColumnRenamed("_id", id_col)


def mixed_documents(docs: DataFrame, *, id_col="doc_id", text_col="text", source_col="source", seed=0, **options) -> DataFrame:
    """The mix as documents in their own columns: each comes as often as its words were taken, the broken part of that number rounded by the hash of its id and text. Rows equal in id, source and text come equally often."""
    parts = {"_k1": F.xxhash64(id_col, source_col, text_col), "_k2": F.xxhash64(F.lit(seed + 2), id_col, source_col, text_col)}
    mix = mix_sources(docs, id_col=id_col, text_col=text_col, source_col=source_col, seed=seed, keys=list(parts.items()), **options)
    unit = F.pmod(F.xxhash64(F.lit(seed + 1), F.col("_k1")), F.lit(1 << 30)) / (1 << 30)
    times = mix.where("size > 0").groupBy("_k1", "_k2").agg(F.avg(F.col("taken") / F.col("size")).alias("_x")).withColumn("_times", F.floor(F.col("_x") + unit).cast("int")).where("_times > 0").drop("_x")
    rows = docs.select(F.struct(*docs.columns).alias("_row"), *(e.alias(k) for k, e in parts.items())).join(times, list(parts))
    return rows.select("_row", F.explode(F.sequence(F.lit(1), F.col("_times"))).alias("_copy")).select("_row.*")
