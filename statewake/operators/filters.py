"""Predicates over elements: scope, labels, validity, approval, paths and required properties. Nulls are no match unless said otherwise."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_scope(areas: Column, area: str, surface: Column, wanted: str) -> Column:
    """Elements of a functional area on a surface."""
    return F.coalesce(F.array_contains(areas, area), F.lit(False)) & F.coalesce(surface == wanted, F.lit(False))


def has_label(label: Column, wanted: str, parents: dict[str, str]) -> Column:
    """Elements with a label or one that specialises it, however far; parents names each label's general one."""
    found = {wanted}
    while more := {child for child, parent in parents.items() if parent in found} - found:
        found |= more
    return label.isin(*sorted(found))


def valid_where_it_applies(label: Column, valid_to: Column, windowed: tuple[str, ...]) -> Column:
    """Current elements; labels without a validity window always are. An empty end is open."""
    return ~label.isin(*windowed) | F.coalesce(valid_to == "", F.lit(True))


def unapproved(states: DataFrame, t: DataFrame) -> DataFrame:
    """kind and id of states and transitions that nobody approved; planned and rejected transitions are not asked for. states(model_id, id, lifecycle), t(model_id, id, lifecycle, status)."""
    open_ = F.coalesce(F.col("lifecycle") != "Approved", F.lit(True))
    s = states.where(open_).select("model_id", F.lit("state").alias("kind"), "id")
    return s.unionAll(t.where(open_ & (F.col("status") != "planned") & F.coalesce(F.col("lifecycle") != "Rejected", F.lit(True))).select("model_id", F.lit("transition"), "id"))


def by_suffix(paths: DataFrame, suffixes: DataFrame, path: str, suffix: str) -> DataFrame:
    """Paths with every suffix that they end with, at a separator: an equi-join on their tails."""
    parts = F.split(path, "/")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    return paths.withColumn(suffix, F.explode(tails)).join(suffixes.select(suffix).where(F.col(suffix) != "").distinct(), suffix)


def glob_pattern(glob: str) -> str:
    """A regular expression for a glob: ** crosses directories, * and ? do not."""
    parts = re.split(r"(\*\*/?|\*|\?)", glob)
    return "^" + "".join({"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(p, re.escape(p)) for p in parts) + "$"


def owner(path: Column, owners: list[tuple[str, list[str]]]) -> Column:
    """The first owner one of whose globs matches a path, in the order given; null for none."""
    return F.coalesce(*(F.when(path.rlike("|".join(glob_pattern(g) for g in globs)), name) for name, globs in owners))


def property_errors(row: dict[str, Column], required: tuple[str, ...], allowed: dict[str, tuple[str, ...]]) -> Column:
    """What is wrong with an element's properties: missing:<name> and value:<name>, in order."""
    blank = lambda c: F.trim(F.coalesce(c.cast("string"), F.lit(""))) == ""
    rules = [F.when(blank(row[n]), f"missing:{n}") for n in required]
    rules += [F.when(~blank(row[n]) & ~row[n].isin(*values), f"value:{n}") for n, values in allowed.items()]
    return F.array_compact(F.array(*rules))


# fixed values: members that stay even where they are false
KEPT = ("ok", "may_author", "may_decide", "may_observe", "may_run", "conforms", "atomic", "valid")


def pruned(payload: Column, kept: tuple[str, ...] = KEPT) -> Column:
    """A JSON text without members that are null, false, an empty text or an empty list, at any depth; objects stay, empty or not, and so do the entries of lists and the members named in kept.

    One pass over the text: it goes from quoted text to quoted text, so what stands inside one is no member.
    """
    quoted = r'"(?:[^"\\]|\\.)*+"'
    member = rf'(?!"(?:{"|".join(kept)})"){quoted}\s*:\s*(?:null|false|""|\[\s*\])(?=\s*[,}}])'
    return F.regexp_replace(payload, rf"\s*,\s*{member}|{member}\s*,\s*|{member}|({quoted})", "$1")


def without_empty(rows: Column) -> Column:
    """An array of structs without those whose id is null, as an outer join leaves them."""
    return F.filter(rows, lambda x: x.id.isNotNull())
