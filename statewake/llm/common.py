"""Helpers shared by the operators: input tables, the shared scratch folder, word patterns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but these six characters.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; one is made only for a session that names none and has no other machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="statewake-"))
    return spark.sparkContext.getCheckpointDir()


class Scratch:
    """Tables written under the shared folder, to cut lineage and to survive lost executors."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        return self.spark.read.parquet(path)

    def drop(self, name: str) -> None:
        """Free a table that no later plan reads."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(hadoop, True)


#: Keys with many rows are joined by broadcast: at most so many, and none of so few rows.
HOT_KEYS, HOT_ROWS = 20_000, 1_000


def spread_join(rows: DataFrame, keyed: DataFrame, keys: list[str], weight: str, total: int, heaviest: int | None = None) -> DataFrame:
    """rows joined with keyed, which has one row a key and in weight the number of rows with it (total in sum or more, heaviest at most where that is known).

    Rows of a key go to one task in a shuffle, however many they are. Keys of more than a share of the
    rows are few (at most HOT_KEYS), so these are broadcast and their rows stay where they are.
    """
    most = max(HOT_ROWS, total // HOT_KEYS)
    if (total if heaviest is None else heaviest) <= most:
        return rows.join(keyed.drop(weight), keys)
    hot = F.broadcast(keyed.where(F.col(weight) > most).drop(weight))
    cold = rows.join(hot.select(*keys), keys, "left_anti").join(keyed.where(F.col(weight) <= most).drop(weight), keys)
    return rows.join(hot, keys).unionByName(cold)


def salted_join(rows: DataFrame, keyed: DataFrame, keys: list[str], weight: str, salt: list[str], total: int) -> DataFrame:
    """spread_join for keyed rows that are too large to broadcast: those of hot keys are repeated instead, and each row takes one by the hash of its columns in salt.

    Of the hot keys only their number of rows is broadcast.
    """
    most = max(HOT_ROWS, total // HOT_KEYS)
    if total <= most:
        return rows.join(keyed.drop(weight), keys)
    parts = F.ceil(F.col(weight) / most).cast("int")
    hot = F.broadcast(keyed.where(F.col(weight) > most).select(*keys, parts.alias("_parts")))
    dealt = rows.join(hot, keys, "left").withColumn("_salt", F.pmod(F.xxhash64(*salt), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    copies = keyed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1))).drop(weight)
    return dealt.join(copies, [*keys, "_salt"]).drop("_salt")


def words(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(batch: pa.RecordBatch, column: int, rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch, in order, of at most so many rows, each ended where its texts in a column reach a size in bytes."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        end = min(at + rows, int(np.searchsorted(ends, before + size)) + 1, batch.num_rows)
        yield batch.slice(at, end - at)
        at = end
