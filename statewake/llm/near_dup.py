"""Near-duplicate documents by MinHash.

1. Each text becomes its set of distinct word shingles (64-bit hashes). Equal sets form a class at
   once, by a 128-bit digest, and a class goes on as one node.
2. ``ROWS * BANDS`` universal hashes give its minima; each band of ``ROWS`` minima is a bucket key.
   At a similarity of 0.8 all bands differ with probability (1 - 0.8**4)**32 < 1e-7.
3. Each bucket has a hub, and each node is compared, on the full sets, with the hub that it shares
   most bands with. The connected components of these stars are parts: near copies of one text are
   in one part after as many comparisons as there are nodes.
4. What is still unlinked: in buckets with several parts the signatures of nodes of different parts
   are compared. Agreement far below the limit (over five standard deviations) drops a pair; the
   rest are possible links of parts. Their connected components are clusters: no link crosses them.
5. Inside a cluster the nodes of different parts are compared on the full sets, and the connected
   components of parts by confirmed links are the groups.

In steps 4 and 5 nodes of the largest part meet only those of other parts. Buckets and clusters above
a block size are split into pairs of blocks, each a task's work of bounded memory; no pair of
different parts is dropped, so the result does not depend on hubs, blocks or order. Keys that hold
many rows (hubs, copies, parts) are joined by broadcast of their few keys (``spread_join``).

Defined results: null and wordless texts have the empty set and link with nothing; fewer words than
a shingle make one shingle of the whole; repeated rows each give a row; texts that share an id are
linked each by its own set; rows with a null id take the group of the rows they are linked with, and
the null group where all are null; an empty table gives an empty result. Ids are integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statewake.llm.common import Scratch, WORD, spread_join
from statewake.llm.components import connected_components

ROWS, BANDS = 4, 32
BUCKET_BLOCK, CLUSTER_BLOCK, STAR_BLOCK = 1024, 384, 512
#: A set of so many shingles counts as one more row of a block.
LONG_SET = 2000
CACHE_WORDS = 1_000_000
_RNG = np.random.default_rng(20240229)
_MULT = _RNG.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_A = _RNG.integers(0, 1 << 63, ROWS * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, ROWS * BANDS, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class Shingler:
    """Distinct shingle hashes of texts; words keep their case but for A-Z."""

    def __init__(self, size: int):
        self.size, self.seen = size, {}

    def shingles(self, text: str | None) -> np.ndarray:
        import xxhash

        words, seen = (text or "").encode("utf-8", "replace").lower().split(), self.seen
        if len(seen) > CACHE_WORDS:
            seen.clear()
        for w in words:
            if w not in seen:
                seen[w] = xxhash.xxh64_intdigest(w)
        h = np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))
        if not len(h):
            return h
        size = min(self.size, len(h))
        n = len(h) - size + 1
        total = np.full(n, size, np.uint64)
        for j in range(size):
            total += h[j : j + n] * _MULT[j]
        return np.unique(_mix(total))


def minima(shingles: np.ndarray) -> np.ndarray:
    """The signature: for each universal hash the least of the top 32 bits."""
    best = None
    for at in range(0, len(shingles), 2048):
        h = (shingles[at : at + 2048, None] * _A + _B).min(0)
        best = h if best is None else np.minimum(best, h)
    return (best >> np.uint64(32)).astype(np.uint32)


def band_keys(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(BANDS, ROWS).astype(np.uint64)
    return _mix((rows * _MULT[:ROWS]).sum(1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * _MULT[ROWS]).view(np.int64)


def least_agreement(percent: int) -> int:
    """Equal signature bytes below which a pair at the limit would be over five standard deviations off."""
    n, p = ROWS * BANDS, percent / 100
    return max(1, int(n * p - 5.4 * (n * p * (1 - p)) ** 0.5))


def row_keys(id_col: str, text_col: str) -> list:
    """Two hashes of a row's id and text."""
    return [F.xxhash64(id_col, text_col).alias("h1"), F.xxhash64(F.lit(1), id_col, text_col).alias("h2")]


def signatures(docs: DataFrame, *, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """id, h1 and h2 (of the row), n (set size), f1 and f2 (digest of the set), sig (low bytes of the minima) and bands."""

    def run(batches):
        maker = Shingler(shingle)
        kind = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                piece, out, known = b.slice(at, 1000), [], {}
                for text in piece.column(3).to_pylist():
                    s = maker.shingles(text)
                    if not len(s):
                        out.append((0, None, None, None, None))
                        continue
                    digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                    if digest not in known:
                        sig = minima(s)
                        known[digest] = (sig.astype(np.uint8).tobytes(), band_keys(sig))
                    f = np.frombuffer(digest, np.int64)
                    out.append((len(s), int(f[0]), int(f[1]), *known[digest]))
                cols = list(zip(*out, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([*piece.columns[:3], *(pa.array(c, k) for c, k in zip(cols, kind, strict=True))], names=["id", "h1", "h2", "n", "f1", "f2", "sig", "bands"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), *row_keys(id_col, text_col), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, h1 long, h2 long, n long, f1 long, f2 long, sig binary, bands array<long>")


def blocks(df: DataFrame, key: str, size: int) -> DataFrame:
    """Deal rows(key, node, part, main, n_main, n_other) into pairs of blocks, lo and hi; every two rows of a key of which one is not of its main part meet in some pair. blk is the row's own block."""
    small = F.col("n_main") + F.col("n_other") <= size
    is_main = F.col("part") == F.col("main")
    df = df.withColumns({"_no": F.when(small, 1).otherwise(F.ceil(F.col("n_other") / size)).cast("int"), "_nm": F.when(small, 0).otherwise(F.ceil(F.col("n_main") / size)).cast("int")})
    df = df.withColumn("blk", F.when(is_main & ~small, F.col("_no") + F.pmod(F.xxhash64("node"), F.col("_nm"))).otherwise(F.pmod(F.xxhash64("node"), F.col("_no"))).cast("int"))
    df = df.withColumn("_other", F.explode(F.when(is_main & ~small, F.expr("sequence(0, _no - 1)")).otherwise(F.expr("sequence(0, _no + _nm - 1)"))))
    df = df.withColumns({"lo": F.least("blk", "_other"), "hi": F.greatest("blk", "_other")}).drop("_no", "_nm", "_other", "main", "n_main", "n_other")
    return df.repartition(key, "lo", "hi").sortWithinPartitions(key, "lo", "hi")


def groups(batches, keys: tuple[str, ...]) -> Iterator[pa.RecordBatch | pa.Table]:
    """Runs of rows with equal keys from batches sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(b.num_rows - 1, bool)
        for c in cols:
            change |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), b.num_rows]
        for a, z in zip(cuts, cuts[1:], strict=False):
            now = tuple(c[a] for c in cols)
            if now != last and held:
                yield pa.Table.from_batches(held) if len(held) > 1 else held[0]
                held = []
            held.append(b.slice(a, z - a))
            last = now
    if held:
        yield pa.Table.from_batches(held) if len(held) > 1 else held[0]


def cross_links(part: np.ndarray, block: np.ndarray, linked) -> list[tuple[int, int]]:
    """Pairs of parts that some link joins, enough to connect them; linked(i, rest) is a mask of the rows in rest that link with i. Rows of one block are compared where all are of one."""
    names, label = np.unique(part, return_inverse=True)
    if len(names) < 2:
        return []
    one, largest = block.min() == block.max(), np.bincount(label).argmax()
    probes, edges = np.flatnonzero(label != largest), []
    if not one:  # rows of the other block only, from the block with fewer such probes
        sides = [probes[block[probes] == b] for b in (block.min(), block.max())]
        pure = [(label[block == b] == largest).all() for b in (block.min(), block.max())]
        probes = sides[0] if pure[1] else sides[1] if pure[0] else min((np.flatnonzero(block == b) for b in (block.min(), block.max())), key=len)
    now = label.copy()
    for i in probes.tolist():
        rest = np.flatnonzero((now != now[i]) & (one | (block != block[i])))
        if not len(rest):
            continue
        hits = rest[linked(i, rest)]
        for other in np.unique(now[hits]).tolist():
            j = hits[now[hits] == other][0] if len(hits) else i
            edges.append((int(names[label[i]]), int(names[label[j]])))
        if len(hits):
            now[np.isin(now, np.unique(now[hits]))] = now[i]
    return edges


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    e = np.array(pairs, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], names=["a", "b"])


def possible_links(batches, least: int):
    """Pairs of parts (a, b) with nodes in one bucket whose signatures agree enough."""
    for g in groups(batches, ("key", "lo", "hi")):
        sig = np.frombuffer(b"".join(g.column("sig").to_pylist()), np.uint8).reshape(g.num_rows, -1)
        if found := cross_links(g.column("part").to_numpy(), g.column("blk").to_numpy(), lambda i, rest, sig=sig: (sig[rest] == sig[i]).sum(1) >= least):
            yield _edges(found)


def confirmed_links(batches, percent: int):
    """Pairs of parts (a, b) with nodes in one cluster whose full sets reach the limit."""
    for g in groups(batches, ("cluster", "lo", "hi")):
        part = g.column("part").to_numpy()
        if part.min() == part.max():
            continue
        sets = [np.frombuffer(x, np.uint64) for x in g.column("set").to_pylist()]
        size = np.array([len(s) for s in sets])
        start = np.concatenate([[0], np.cumsum(size)])
        vocabulary, flat = np.unique(np.concatenate(sets), return_inverse=True)
        mark = np.zeros(len(vocabulary), bool)

        def linked(i, rest, size=size, start=start, flat=flat, mark=mark):
            out = np.zeros(len(rest), bool)
            # sets whose sizes differ too much cannot reach the limit
            near = (100 * np.minimum(size[rest], size[i]) >= percent * np.maximum(size[rest], size[i])).nonzero()[0]
            if len(near):
                mark[flat[start[i] : start[i + 1]]] = True
                picks = rest[near]
                lens = size[picks]
                cuts = np.concatenate([[0], np.cumsum(lens)])
                at = np.arange(cuts[-1]) + np.repeat(start[picks] - cuts[:-1], lens)
                both = np.add.reduceat(mark[flat[at]], cuts[:-1], dtype=np.int64)
                mark[flat[start[i] : start[i + 1]]] = False
                out[near] = 100 * both >= percent * (size[i] + lens - both)
            return out

        if found := cross_links(part, g.column("blk").to_numpy(), linked):
            yield _edges(found)


def star_links(batches, percent: int):
    """Links (a, b) of nodes with their hub, whose set comes first; a group's sets are not held together."""
    now, hub = None, np.zeros(0, np.uint64)
    for b in batches:
        found = []
        for key, salt, node, data in zip(*(b.column(c).to_pylist() for c in ("hub", "salt", "node", "set")), strict=True):
            s = np.frombuffer(data, np.uint64)
            if (key, salt) != now:
                assert node == key
                now, hub = (key, salt), s
            elif 100 * min(len(s), len(hub)) >= percent * max(len(s), len(hub)):
                short, long = (s, hub) if len(s) < len(hub) else (hub, s)
                at = np.searchsorted(long, short)
                both = int((long[np.minimum(at, len(long) - 1)] == short).sum())
                if 100 * both >= percent * (len(s) + len(hub) - both):
                    found.append((node, key))
        yield _edges(found)


def parts_of(rows: DataFrame, key: str, size_col: str) -> DataFrame:
    """rows(key, node, part, weight) of keys with several parts, with main (the part with most of a key), n_main and n_other (in blocks' units)."""
    per = rows.groupBy(key, "part").agg(F.sum(size_col).alias("w"), F.count("*").alias("c"))
    mixed = per.groupBy(key).agg(F.count("*").alias("n_parts"), F.max(F.struct("w", F.col("part").alias("p"))).alias("m"), F.sum("w").alias("w"), F.sum("c").alias("c")).where("n_parts > 1")
    return mixed.select(key, F.col("m.p").alias("main"), F.col("m.w").alias("n_main"), (F.col("w") - F.col("m.w")).alias("n_other"), F.col("c").alias("members"))


def _total(df: DataFrame, col: str) -> int:
    return df.agg(F.sum(col)).first()[0] or 0


def _grouped(docs: DataFrame, scratch: Scratch, *, id_col: str, text_col: str, shingle: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """All rows (id, h1, h2, n, f1, f2), and classes (f1, f2, copies, first and head): first is the class's first row, head that of its group."""
    least = least_agreement(percent)
    all_rows = scratch.write(signatures(docs, id_col=id_col, text_col=text_col, shingle=shingle), "signatures")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h1", "h2")).alias("first")
    classes = all_rows.where("n > 0").groupBy("f1", "f2").agg(first, F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    # numbers of nodes hold once they are written
    classes = scratch.write(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    exploded = classes.select("node", F.explode("bands").alias("key"))
    buckets = exploded.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("members")).where("members > 1")
    members = scratch.write(exploded.join(buckets, "key").select("key", "node", "hub"), "members")
    best = F.max(F.struct("count", (-F.col("hub")).alias("minus"))).alias("best")
    stars = scratch.write(members.where("node <> hub").groupBy("node", "hub").count().groupBy("node").agg(best).select("node", (-F.col("best.minus")).alias("hub")), "stars")

    def full_sets(batches):
        maker = Shingler(shingle)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array([maker.shingles(t).tobytes() for t in b.column("text").to_pylist()], pa.binary())], names=["node", "set"])

    wanted = members.select("node").distinct().join(classes.select("node", "first.h1", "first.h2"), "node")
    texts = docs.select(*row_keys(id_col, text_col), F.col(text_col).alias("text"))
    # by shuffle at any size: what a join of this kind costs then follows the input
    found = wanted.hint("merge").join(texts, ["h1", "h2"]).dropDuplicates(["h1", "h2", "node"]).select("node", "text")
    sets = scratch.write(found.mapInArrow(full_sets, "node long, set binary"), "sets")

    degrees = stars.groupBy("hub").agg(F.count("*").alias("degree")).withColumn("salts", F.ceil(F.col("degree") / STAR_BLOCK).cast("int"))
    spread = spread_join(stars, degrees, ["hub"], "degree", stars.count()).select("hub", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int").alias("salt"), "node")
    centres = degrees.select("hub", F.explode(F.expr("sequence(0, salts - 1)")).alias("salt"), F.col("hub").alias("node"))
    rows = spread.unionByName(centres).join(sets, "node").select("hub", "salt", (F.col("node") != F.col("hub")).alias("rim"), "node", "set")
    links = rows.repartition("hub", "salt").sortWithinPartitions("hub", "salt", "rim").mapInArrow(lambda it: star_links(it, percent), "a long, b long")
    starred = connected_components(links, scratch, "stars-linked")

    part = F.coalesce("component", "node").alias("part")
    nodes = members.select("node").distinct().join(starred, "node", "left").select("node", part)
    nodes = scratch.write(nodes, "parts")
    n_nodes = nodes.count()
    in_buckets = members.select("key", "node").join(nodes, "node").withColumn("one", F.lit(1))
    mixed = scratch.write(parts_of(in_buckets, "key", "one"), "mixed-buckets")
    rows = spread_join(in_buckets.drop("one"), mixed, ["key"], "members", _total(mixed, "members")).join(classes.select("node", "sig"), "node")
    edges = blocks(rows, "key", BUCKET_BLOCK).mapInArrow(lambda it: possible_links(it, least), "a long, b long")
    near_parts = connected_components(edges, scratch, "possible")
    near_parts = near_parts.union(near_parts.select(F.col("component").alias("node"), "component").distinct()).select(F.col("node").alias("part"), F.col("component").alias("cluster"))
    part_sizes = nodes.groupBy("part").agg(F.count("*").alias("size")).join(near_parts, "part")
    in_clusters = spread_join(nodes, part_sizes, ["part"], "size", n_nodes).join(classes.select("node", (1 + F.col("n") / LONG_SET).cast("long").alias("weight")), "node")
    mixed = scratch.write(parts_of(in_clusters, "cluster", "weight"), "mixed-clusters")
    rows = spread_join(in_clusters.drop("weight"), mixed, ["cluster"], "members", _total(mixed, "members")).join(sets, "node")
    links = blocks(rows, "cluster", CLUSTER_BLOCK).mapInArrow(lambda it: confirmed_links(it, percent), "a long, b long")
    merged = connected_components(links, scratch, "confirmed").withColumnsRenamed({"node": "part", "component": "whole"})

    sized = nodes.groupBy("part").agg(F.count("*").alias("size")).join(merged, "part", "left").select("part", "size", F.coalesce("whole", "part").alias("whole"))
    wholes = spread_join(nodes, sized, ["part"], "size", n_nodes).join(classes.select("node", "first"), "node")
    heads = wholes.groupBy("whole").agg(F.min("first").alias("head"), F.count("*").alias("size"))
    headed = spread_join(wholes.select("whole", "node"), heads, ["whole"], "size", n_nodes).select("node", "head")
    named = scratch.write(classes.select("node", "f1", "f2", "copies", "first").join(headed, "node", "left").select("f1", "f2", "copies", "first", F.coalesce("head", "first").alias("head")), "named")
    return all_rows.select("id", "h1", "h2", "n", "f1", "f2"), named


def near_duplicates(docs: DataFrame, *, id_col="doc_id", text_col="text", shingle=5, percent=80) -> DataFrame:
    """id, n_shingles, component_id (smallest id reachable by links) and kept."""
    rows, named = _grouped(docs, Scratch(docs.sparkSession, "neardup"), id_col=id_col, text_col=text_col, shingle=shingle, percent=percent)
    rows = rows.select("id", "n", "f1", "f2")
    linked = spread_join(rows.where("n > 0"), named.select("f1", "f2", "copies", F.col("head.id").alias("component")), ["f1", "f2"], "copies", _total(named, "copies")).select("id", "n", "component")
    out = linked.unionByName(rows.where("n = 0").select("id", "n", F.col("id").alias("component")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id")).withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, *, id_col="doc_id", text_col="text", shingle=5, percent=80) -> DataFrame:
    """One document of each group in the documents' own columns: the first by id (null last), of those with equal ids that with the least hash of id and text, of repeated rows any one. Wordless documents have no group and all stay."""
    _, named = _grouped(docs, Scratch(docs.sparkSession, "neardup"), id_col=id_col, text_col=text_col, shingle=shingle, percent=percent)
    heads = named.where("first = head").select(F.col("head.h1").alias("h1"), F.col("head.h2").alias("h2"))
    whole = F.struct(*docs.columns).alias("row")
    worded = F.coalesce(F.col(text_col).rlike(WORD), F.lit(False))
    kept = docs.where(worded).select(whole, *row_keys(id_col, text_col)).join(heads, ["h1", "h2"]).dropDuplicates(["h1", "h2"])
    return kept.select("row.*").unionByName(docs.where(~worded))


#: The rows of near_duplicates(documents, shingle=4) by comparing all pairs with a shingle in common, for small tables.
SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(list_transform(range(1, greatest(len(ws) - 3, 1) + 1), lambda i: array_to_string(ws[i:i + 3], ' '))) AS g FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
m AS (SELECT a, min(b) AS b FROM r GROUP BY 1)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(m.b, w.doc_id)) AS component_id, w.doc_id <= coalesce(m.b, w.doc_id) AS kept FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN m ON m.a = w.doc_id
"""
