"""Captured tracker pages and the files of a checkout as Spark data sources, and tracker items as intake documents.

``register`` makes ``tracker_pages`` and ``checkout`` known to ``spark.read.format``. A folder is listed
once, filters that a listing can decide are pushed down to it, and each partition holds some files; a file is
read by one task, one of JSON lines a line at a time, and rows go on in batches of a size. Paths may be local or of any store that Arrow knows. Nothing is written anywhere.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, StringStartsWith
from pyspark.sql.pandas.types import to_arrow_schema

#: A partition takes files up to so many and so many bytes.
FILES_EACH, BYTES_EACH = 1_000, 64 << 20
#: A batch takes rows up to so many and so many characters.
ROWS_AT_ONCE, SIZE_AT_ONCE = 2_000, 4 << 20


@dataclass
class Files(InputPartition):
    paths: list[str]


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class _FolderReader(DataSourceReader):
    """Lists a folder's files, drops those that pushed filters rule out, and deals the rest."""

    #: Columns that the listing decides, by file.
    listed: tuple[str, ...] = ()

    def __init__(self, path: str, schema=None):
        self.path, self.pushed = path, []
        self.kind = schema and to_arrow_schema(schema)

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith, IsNotNull)) and len(f.attribute) == 1 and f.attribute[0] in self.listed:
                # what the listing says is never null
                self.pushed += [] if isinstance(f, IsNotNull) else [f]
            else:
                yield f

    def facts(self, name: str) -> dict[str, str]:
        """The listed columns of a file by its name under the folder."""
        raise NotImplementedError

    def _kept(self, name: str) -> bool:
        facts = self.facts(name)
        for f in self.pushed:
            value = facts[f.attribute[0]]
            if isinstance(f, EqualTo) and value != f.value or isinstance(f, In) and value not in f.value or isinstance(f, StringStartsWith) and not value.startswith(f.value):
                return False
        return True

    def partitions(self):
        store, root = _store(self.path)
        found = sorted((i.path, i.size) for i in store.get_file_info(fs.FileSelector(root, recursive=True)) if i.is_file)
        parts, size = [Files([])], 0
        for path, n in found:
            name = path[len(root.rstrip("/")) + 1 :]
            if any(p.startswith((".", "_")) for p in name.split("/")) or not self._kept(name):
                continue
            if parts[-1].paths and (len(parts[-1].paths) == FILES_EACH or size + n > BYTES_EACH):
                parts.append(Files([]))
                size = 0
            parts[-1].paths.append(name)
            size += n
        return parts

    def opened(self, partition: Files) -> Iterator[tuple[str, io.BufferedReader]]:
        store, root = _store(self.path)
        for name in partition.paths:
            with io.BufferedReader(store.open_input_stream(f"{root.rstrip('/')}/{name}"), 1 << 20) as f:
                yield name, f

    def rows(self, partition: Files) -> Iterator[tuple]:
        raise NotImplementedError

    def read(self, partition):
        held, size = [], 0
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), self.kind, strict=True)], schema=self.kind)
        for row in self.rows(partition):
            held.append(row)
            size += sum(len(x) for x in row if isinstance(x, str))
            if len(held) >= ROWS_AT_ONCE or size >= SIZE_AT_ONCE:
                yield batch()
                held, size = [], 0
        if held:
            yield batch()


class CheckoutReader(_FolderReader):
    listed = ("path", "folder", "extension")

    def facts(self, name):
        folder, _, base = name.rpartition("/")
        return {"path": name, "folder": folder.split("/")[0], "extension": base.rpartition(".")[2] if "." in base else ""}

    def rows(self, partition):
        for name, f in self.opened(partition):
            facts, data = self.facts(name), f.read()
            yield name, facts["folder"], facts["extension"], len(data), data.decode("utf-8", "replace")


class Checkout(DataSource):
    """The files of a checkout: path, its first folder, extension, size and text (bytes that are no UTF-8 are replaced). Names that begin with a dot or underscore are left out."""

    @classmethod
    def name(cls):
        return "checkout"

    def schema(self):
        return "path string, folder string, extension string, size long, text string"

    def reader(self, schema):
        return CheckoutReader(self.options["path"], schema)


def _named(value) -> str | None:
    """A field that is a text, or an object with a name."""
    return (value.get("name") or value.get("value")) if isinstance(value, dict) else value if isinstance(value, str) else None


def items_of(page: dict) -> Iterator[tuple]:
    """The items of one captured page, whichever system it is of; what a page does not say is null."""
    system = page.get("system")
    for x in page.get("issues") or page.get("results") or page.get("values") or ():
        f = x.get("fields") if isinstance(x.get("fields"), dict) else x
        body = f.get("description") or f.get("objective") or ((f.get("body") or {}).get("storage") or {}).get("value")
        kind = _named(f.get("issuetype") or f.get("type")) or {"confluence": "page", "zephyr": "test case"}.get(system)
        labels = [y for y in f.get("labels") or () if isinstance(y, str)]
        yield system, str(x["key"] if "key" in x else x["id"]) if "key" in x or "id" in x else None, kind, f.get("summary") or f.get("title") or f.get("name"), body if isinstance(body, str) or body is None else json.dumps(body), _named(f.get("status")), _named(f.get("priority")), f.get("created"), f.get("updated"), labels


class TrackerReader(_FolderReader):
    listed = ("system",)

    def facts(self, name):
        return {"system": name.split("/")[0].removeprefix("system=")}

    def pages(self, f: io.BufferedReader) -> Iterator[bytes]:
        """The pages of a file: a line each, or one over several lines."""
        begun = False
        for line in f:
            if not begun and line.strip():
                begun = True
                if line.lstrip() == b"{\n":
                    yield line + f.read()
                    return
            yield from line.splitlines()

    def rows(self, partition):
        for name, f in self.opened(partition):
            for line in self.pages(f):
                if line.strip():
                    page = json.loads(line)
                    for _, *rest in items_of({"system": self.facts(name)["system"]} | page):
                        yield self.facts(name)["system"], *rest


class TrackerPages(DataSource):
    """Items of captured tracker pages, one JSON object a page, in a folder for each system (``jira/`` or ``system=jira/``)."""

    @classmethod
    def name(cls):
        return "tracker_pages"

    def schema(self):
        return "system string, key string, item_type string, title string, description string, status string, priority string, created string, updated string, labels array<string>"

    def reader(self, schema):
        return TrackerReader(self.options["path"], schema)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (TrackerPages, Checkout):
        spark.dataSource.register(source)


# fixed values: a tracker's words for types, states and priorities
TYPES = {"story": "story", "user story": "story", "epic": "epic", "feature": "feature", "new feature": "feature", "task": "task", "sub-task": "task", "subtask": "task", "bug": "defect", "defect": "defect", "page": "page", "test case": "test_case", "testcase": "test_case", "test": "test_case"}
STATES = {
    "backlog": "draft", "draft": "draft", "to do": "draft", "open": "draft", "new": "draft", "in progress": "active", "in review": "active", "active": "active", "in development": "active", "current": "active",
    "done": "completed", "closed": "completed", "resolved": "completed", "complete": "completed", "completed": "completed", "deferred": "deferred", "on hold": "deferred", "blocked": "blocked",
}
PRIORITIES = {
    "blocker": "critical", "critical": "critical", "highest": "critical", "p0": "critical", "high": "high", "major": "high", "p1": "high", "medium": "medium", "normal": "medium", "moderate": "medium", "p2": "medium",
    "low": "low", "minor": "low", "p3": "low", "lowest": "optional", "trivial": "optional", "optional": "optional", "p4": "optional",
}


def spelled(raw: Column, spellings: dict[str, str]) -> Column:
    """The one word for a value, null where it has none: nothing is guessed."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in spellings.items() for x in pair)), F.lower(F.trim(F.coalesce(raw, F.lit("")))))


def intake_documents(items: DataFrame, generated_at: str) -> DataFrame:
    """One intake document an item: id, scope, metadata and facts as structs.

    An unknown type counts as a task, since a document needs one; an unknown state or priority is left out, and the
    tracker's own word for its state stays as an observed fact with its source. Dates that are missing are generated_at.
    """
    status = F.trim(F.coalesce("status", F.lit("")))
    stamp = F.lit(generated_at)
    fact = F.struct(F.concat(F.lit("status-"), "key").alias("id"), F.lit("current_state").alias("type"), status.alias("value"), F.lit("observed").alias("confidence"), F.col("system").alias("source_system"), F.col("key").alias("source_id"), stamp.alias("extracted_at"))
    return items.where("key is not null").select(
        F.concat_ws(":", "system", "key").alias("id"),
        F.struct(F.coalesce(spelled(F.col("item_type"), TYPES), F.lit("task")).alias("primary_type"), F.col("key").alias("primary_id"), F.coalesce("created", stamp).alias("created_at"), F.coalesce("updated", stamp).alias("last_updated_at")).alias("scope"),
        F.struct(F.col("title"), F.col("description"), F.struct(spelled(F.col("status"), STATES).alias("summary_status"), F.col("updated").alias("last_status_update")).alias("status"), spelled(F.col("priority"), PRIORITIES).alias("priority"), F.array_sort(F.array_distinct(F.coalesce("labels", F.array().cast("array<string>")))).alias("labels")).alias("metadata"),
        F.when(status != "", F.array(fact)).otherwise(F.array().cast(f"array<{_FACT}>")).alias("facts"),
    )


_FACT = "struct<id:string,type:string,value:string,confidence:string,source_system:string,source_id:string,extracted_at:string>"
