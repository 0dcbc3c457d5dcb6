"""Pairing of elements over versions and of criteria with behaviour: keys, similarity, renames, evidence, scores.

Nulls count as empty texts; ids are unique within their table; empty tables give empty results.
"""

from __future__ import annotations

from collections import deque
from difflib import SequenceMatcher
from functools import lru_cache, reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from statewake.operators.guards import strip_parens

#: Similarity from which a removed and an added element are proposed as one that was renamed.
RENAME = 0.6
# fixed values: words that say nothing about a criterion
STOP = ("the", "and", "for", "with", "when", "then", "given", "that", "this", "from", "into", "are", "is", "was", "has", "have", "not", "shall", "must", "will")


def bare_id(model: Column, element: Column) -> Column:
    """An element's id without its model's prefix ``model::``."""
    prefix = F.concat(model.cast("string"), F.lit("::"))
    return F.when(element.startswith(prefix), F.substr(element, F.length(prefix) + 1)).otherwise(element)


def state_key(model: Column, surface: Column, state: Column) -> Column:
    return F.concat_ws("|", model.cast("string"), F.coalesce(surface, F.lit("?")), bare_id(model, state))


def transition_key(source_key: Column, trigger: Column, target_key: Column) -> Column:
    return F.concat(source_key, F.lit("=["), F.coalesce(trigger, F.lit("")), F.lit("]=>"), target_key)


def normal_guard(guard: Column) -> Column:
    """White space folded and the parentheses around the whole taken off; nothing is reordered or simplified."""
    return strip_parens(F.regexp_replace(F.coalesce(guard, F.lit("")), r"\s+", " "))


@lru_cache(1 << 16)
def ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


def pair_by_guard(previous: DataFrame, candidate: DataFrame, keys: list[str]) -> DataFrame:
    """Elements of both versions with equal keys, paired: keys, old_id, new_id (null: added or removed) and change.

    previous and candidate have keys, id and guard. Keys that stand once on each side are joined; within
    the others each old element, by id, takes the new one of the most similar guard (ties to the lower
    id). Only keys with several elements on a side go to Python, as a sorted stream that holds the new
    side of one key. An old element is compared with the distinct guards that are left.
    """
    side = lambda df, x: df.select(*keys, F.col("id").alias("id"), normal_guard(F.col("guard")).alias("guard"), F.lit(x).alias("side"))
    both = side(previous, "old").unionAll(side(candidate, "new"))
    ends = [F.max(F.when(F.col("side") == s, F.col(c))).alias(f"{s}_{c}") for s in ("old", "new") for c in ("id", "guard")]
    sizes = both.groupBy(*keys).agg(F.count_if(F.col("side") == "old").alias("_o"), F.count_if(F.col("side") == "new").alias("_n"), *ends)
    plain = sizes.where("_o <= 1 and _n <= 1")
    kinds = ", ".join(f"`{k}` {both.schema[k].dataType.simpleString()}" for k in keys)
    kind = both.schema["id"].dataType.simpleString()
    made = f"{kinds}, old_id {kind}, old_guard string, new_id {kind}, new_guard string"
    schema = to_arrow_schema(both.sparkSession.createDataFrame([], made).schema)

    def run(batches):
        # a key's new elements come first: their ids by guard, then each old one takes the best that is left
        now, free, rows = None, {}, []

        def added():
            return [(*now, None, None, i, guard) for guard, ids in free.items() for i in ids]

        for b in batches:
            for *key, i, guard, of in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if key != now:
                    rows += added()
                    now, free = key, {}
                if of == "new":
                    free.setdefault(guard, deque()).append(i)
                    continue
                best = guard if guard in free else min(free, key=lambda g: (-ratio(guard, g), free[g][0]), default=None)
                rows.append((*key, i, guard, free[best].popleft() if best is not None else None, best))
                if best is not None and not free[best]:
                    del free[best]
            yield batch(rows)
            rows = []
        yield batch(added())

    def batch(rows):
        columns = zip(*rows, strict=True) if rows else [()] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(columns, schema, strict=True)], schema=schema)

    # keys are compared as groups are, so a null key is one
    several = sizes.where("_o > 1 or _n > 1").select(*(F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)))
    same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"_k{n}")) for n, k in enumerate(keys)))
    stream = both.join(several, same, "left_semi").repartition(*keys).sortWithinPartitions(*keys, "side", "id").select(*keys, "id", "guard", "side")
    found = plain.select(*keys, "old_id", "old_guard", "new_id", "new_guard").unionAll(stream.mapInArrow(run, made))
    change = F.when(F.col("old_id").isNull(), "ADDED").when(F.col("new_id").isNull(), "REMOVED").when(F.col("old_guard") == F.col("new_guard"), "UNCHANGED").otherwise("MODIFIED")
    return found.select(*keys, "old_id", "new_id", change.alias("change"))


def rename_proposals(changes: DataFrame, by: list[str], least: float = RENAME) -> DataFrame:
    """Removed elements with the added one of the most similar key, from least on, each added one once; never applied.

    changes(by..., key, change); by names a model and a kind, whose changes are one group. Removed keys
    choose in their order, ties go to the lower added key.
    """
    kinds = ", ".join(f"`{k}` {changes.schema[k].dataType.simpleString()}" for k in by)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        added, rows = sorted(pdf[pdf.change == "ADDED"].key), []
        for r in sorted(pdf[pdf.change == "REMOVED"].key):
            best = max(added, key=lambda a: ratio(r, a), default=None)
            if best is not None and (s := ratio(r, best)) >= least:
                added.remove(best)
                rows.append((*pdf[by].iloc[0], r, best, round(s, 3)))
        return pd.DataFrame(rows, columns=[*by, "removed_key", "added_key", "similarity"])

    sides = changes.where("change in ('ADDED', 'REMOVED')").groupBy(*by).applyInPandas(run, f"{kinds}, removed_key string, added_key string, similarity double")
    return sides


def evidence_words(text: Column) -> Column:
    """Distinct words of more than two letters in small letters, without those of STOP."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_except(F.array_distinct(F.filter(words, lambda w: F.length(w) > 2)), F.array(*map(F.lit, STOP)))


def occurrences(texts: DataFrame, needles: DataFrame, key: str) -> DataFrame:
    """Every needle that stands literally in a text, once: key and needle. texts(key, text), needles(needle), none of them empty.

    The places of a text are joined with the distinct first three letters of the needles, and what stands
    there in the lengths that these letters begin with is joined with the needles, so only places that
    begin like a needle are cut out.
    """
    n = needles.select("needle").where("needle <> ''").distinct().withColumn("_head", F.substring("needle", 1, 3))
    heads = n.groupBy("_head").agg(F.collect_set(F.length("needle")).alias("_lengths"))
    # a needle of one or two letters is its own head
    places = texts.select(key, "text", F.explode(F.sequence(F.lit(1), F.length("text"))).alias("_at")).where("text <> ''")
    begins = F.explode(F.array_distinct(F.transform(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda k: F.substring("text", F.col("_at"), k))))
    starts = places.withColumn("_head", begins).join(heads, "_head")
    return starts.select(key, F.explode(F.transform("_lengths", lambda k: F.substring("text", F.col("_at"), k))).alias("needle")).distinct().join(n.select("needle"), "needle").select(key, "needle")


#: The signals in their order.
SIGNALS = ("path", "verb", "status", "state", "area", "trigger-words")
STATUS = r"\b[1-5]\d{2}\b"


def evidence(criteria: DataFrame, t: DataFrame) -> DataFrame:
    """Criteria with the transitions that their text refers to: ac_id, id, signals (in order) and strength; nothing is decided.

    criteria(ac_id, text, areas), t(id, trigger, route, target, target_name, areas). Each signal is an
    equi-join of its own: a route or verb that stands literally in the text, a status of the text that
    stands in the target or id, all words of the target's name, an area, two words of the trigger.
    """
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    texts = criteria.select("ac_id", low(F.col("text")).alias("text"))
    verb = F.lower(F.split_part(F.coalesce("trigger", F.lit("")), F.lit(" "), F.lit(1)))
    parts = t.select("id", low(F.col("route")).alias("route"), F.when(F.length(verb) > 2, verb).otherwise("").alias("verb"))
    found = []

    def add(rows: DataFrame, signal: str) -> None:
        found.append(rows.select("ac_id", "id", F.lit(SIGNALS.index(signal)).alias("_s")))

    said = occurrences(texts, parts.select(F.col("route").alias("needle")).union(parts.select("verb")), "ac_id")
    add(said.join(parts, F.col("needle") == F.col("route")), "path")
    add(said.join(parts, F.col("needle") == F.col("verb")), "verb")
    codes = criteria.select("ac_id", F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(STATUS), F.lit(0)))).alias("_c"))
    place = lambda c: F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda i: F.substring(c, i, F.lit(3))), lambda x: x.rlike("^[1-5][0-9]{2}$"))
    target, ident = F.coalesce("target", F.lit("")), F.col("id").cast("string")
    add(codes.join(t.select("id", F.explode(F.array_union(place(target), place(ident))).alias("_c")), "_c"), "status")
    words = criteria.select("ac_id", F.explode(evidence_words(F.col("text"))).alias("_w"))
    for column, signal, least in (("target_name", "state", F.col("_n")), ("trigger", "trigger-words", F.lit(2))):
        named = t.select("id", evidence_words(F.col(column)).alias("_ws")).select("id", F.size("_ws").alias("_n"), F.explode("_ws").alias("_w"))
        add(words.join(named, "_w").groupBy("ac_id", "id", "_n").agg(F.count("*").alias("_k")).where(F.col("_k") >= least), signal)
    area = lambda df, key: df.select(key, F.explode(F.array_distinct("areas")).alias("_a"))
    add(area(criteria, "ac_id").join(area(t, "id"), "_a"), "area")
    rows = reduce(DataFrame.unionAll, found).groupBy("ac_id", "id").agg(F.array_sort(F.collect_set("_s")).alias("_s"))
    names = F.array(*map(F.lit, SIGNALS))
    return rows.select("ac_id", "id", F.array_join(F.transform("_s", lambda k: F.get(names, k)), ",").alias("signals"), F.size("_s").alias("strength"))


def benchmark(rankings: DataFrame, expected: DataFrame) -> DataFrame:
    """One row: total, top1, top3 and absent of expected(question, want) in rankings(question, item, rank)."""
    ranks = expected.join(rankings.select("question", F.col("item").alias("want"), "rank"), ["question", "want"], "left").groupBy("question", "want").agg(F.min("rank").alias("rank"))
    return ranks.agg(F.count("*").alias("total"), F.count_if(F.col("rank") == 1).alias("top1"), F.count_if(F.col("rank") <= 3).alias("top3"), F.count_if(F.col("rank").isNull()).alias("absent"))


def link_proposals(ui: DataFrame, api: DataFrame, calls: DataFrame) -> DataFrame:
    """Links of UI and API transitions that a recovered call joins, and calls without a side: call_id, ui_id, api_id, unmatched.

    A call's screen stands in the UI transition's text, its endpoint ends the API transition's route.
    calls(call_id, screen, endpoint), ui(id, text), api(id, route). Screens are matched against the
    distinct screens only, by the letters that they begin with, endpoints by the route's tails.
    """
    c = calls.select("call_id", F.coalesce("screen", F.lit("")).alias("screen"), F.rtrim(F.coalesce("endpoint", F.lit("")), F.lit("/")).alias("endpoint"))
    # a text that has a screen has its first three letters somewhere
    text = F.coalesce("text", F.lit(""))
    starts = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda i: F.transform(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda n: F.substring(text, i, n)))))
    screens = c.where("screen <> ''").select("screen").distinct().withColumn("_w", F.substring("screen", 1, 3))
    ui_hit = screens.join(ui.select(F.col("id").alias("ui_id"), "text", F.explode(starts).alias("_w")), "_w").where(F.contains("text", "screen")).select("screen", "ui_id").distinct()
    route = F.rtrim(F.coalesce("route", F.lit("")), F.lit("/"))
    tails = F.transform(F.sequence(F.lit(1), F.greatest(F.length(route), F.lit(1))), lambda i: F.substr(route, i))
    api_hit = api.select(F.col("id").alias("api_id"), F.explode(F.array_distinct(tails)).alias("endpoint")).join(c.where("endpoint <> ''").select("endpoint").distinct(), "endpoint")
    rows = c.join(ui_hit, "screen", "left").join(api_hit, "endpoint", "left")
    unmatched = F.concat_ws(",", F.when((F.col("screen") != "") & F.col("ui_id").isNull(), "screen"), F.when((F.col("endpoint") != "") & F.col("api_id").isNull(), "endpoint"))
    return rows.select("call_id", "ui_id", "api_id", unmatched.alias("unmatched"))
