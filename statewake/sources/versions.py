"""Tables in buckets that change together, version by version, in a folder that all executors share.

A change writes the buckets that it touches anew, in a folder of the next version, is checked, and then
puts that version's manifest in place, which names the folder of each bucket of each table. The manifest is
written beside and renamed, so a write that is broken off leaves the version before as it was, and of two
writers of one version the second fails. Old versions stay readable. Only bucket numbers and counts reach
the driver.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Change(NamedTuple):
    """What happens to a table: its key column, the keys whose buckets are read, and the new rows of these buckets from the old ones."""

    schema: str
    key: str
    keys: DataFrame
    rows: Callable[[DataFrame], DataFrame]


class VersionedTables:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.spark, self.path = spark, path.rstrip("/")
        found = self.manifest()
        self.buckets = found["buckets"] if found else buckets

    def _files(self):
        return self._hadoop("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _hadoop(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def versions(self) -> list[int]:
        """The numbers of the versions, whole or not, in order."""
        fs, folder = self._files(), self._hadoop("manifests")
        if not fs.exists(folder):
            return []
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(folder) if s.getPath().getName().isdigit())

    def manifest(self, version: int | None = None) -> dict | None:
        """A version's manifest, or that of the last version that is whole."""
        for v in reversed(self.versions()) if version is None else [version]:
            text = "".join(r.value for r in self.spark.read.text(f"{self.path}/manifests/{v}").collect())
            try:
                return json.loads(text)
            except json.JSONDecodeError:
                continue
        return None

    def version(self) -> int:
        """The version that readers see; 0 for none."""
        found = self.manifest()
        return found["version"] if found else 0

    def read(self, table: str, schema: str, version: int | None = None) -> DataFrame:
        found = self.manifest(version)
        return self._rows(sorted(set(found["tables"].get(table, {}).values())) if found else [], schema)

    def _rows(self, folders: list[str], schema: str) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{f}" for f in folders))

    def commit(self, changes: dict[str, Change], check: Callable[[str, DataFrame], None] | None = None) -> int:
        """Make all changes one new version; the old version's number where nothing is touched. check(table, rows written) raises to stop before the switch."""
        now = self.manifest() or {"version": 0, "tables": {}}
        following = max(self.versions(), default=0) + 1
        tables, folder, touched_any = dict(now["tables"]), f"data/{following}-{uuid.uuid4().hex[:8]}", False
        for name, c in changes.items():
            bucket = F.pmod(F.xxhash64(c.key), F.lit(self.buckets)).cast("int").alias("b")
            touched = sorted(r.b for r in c.keys.select(bucket).distinct().collect())
            if not touched:
                continue
            touched_any, held = True, tables.get(name, {})
            old = [held[str(b)] for b in touched if str(b) in held]
            rows, columns = c.rows(self._rows(old, c.schema)), [x.split()[0] for x in c.schema.split(", ")]
            rows.select(*columns, bucket).repartition("b").write.partitionBy("b").parquet(f"{self.path}/{folder}/{name}")
            written = self.spark.read.schema(f"{c.schema}, b int").parquet(f"{self.path}/{folder}/{name}")
            if check:
                check(name, written)
            made = {r.b for r in written.select("b").distinct().collect()}
            tables[name] = {b: f for b, f in held.items() if int(b) not in touched} | {str(b): f"{folder}/{name}/b={b}" for b in made}
        if not touched_any:
            return now["version"]
        self._publish(following, json.dumps({"version": following, "buckets": self.buckets, "tables": tables}))
        return following

    def _publish(self, version: int, text: str) -> None:
        """Put a manifest in place; an error if the version is there already."""
        beside, fs, jvm = self._hadoop(f"manifests/.{version}-{uuid.uuid4().hex[:8]}"), self._files(), self.spark._jvm
        out = fs.create(beside, False)
        out.write(bytearray(text.encode()))
        out.close()
        plain = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        context.rename(fs.makeQualified(beside), fs.makeQualified(self._hadoop(f"manifests/{version}")), plain)
