"""Quality rules by cross-document line frequency (DataFrame functions only).

Lines are normalised and hashed, the distinct documents that hold a line are counted within each
host, lines above the limit are removed, and documents that lose most of their words are rejected.
Equal texts count as one document, so that a group of exact copies does not condemn itself, and the
first document (smallest id) that holds a frequent line keeps it, so no line is lost everywhere. The
lines of distinct texts are split, hashed and written once, and read for the counts and the removal.

Defined results: a null or blank text has no words and fails the base rules; a null host is a host
of its own; repeated rows each get their row; an empty table gives an empty result. Other columns
of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statewake.llm.common import Scratch, ascii_lower, spread_join

SYMBOLS = "#*$%&|<>"
#: A line is frequent in a host when more distinct documents than this hold it.
LINE_LIMIT = 30
#: A document is depleted when less than this share of its words is left.
LEFT_SHARE = 0.3
#: Base rules: fewest words, and the largest percentage of words in repeated windows.
MIN_WORDS, MAX_REPEAT = 50, 50


def _words(text: Column) -> Column:
    """The words of a text; one-character separators are split without a regular expression."""
    return F.array_remove(F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " "), "")


def _repeat_words(df: DataFrame, out: str) -> DataFrame:
    """Words in 3-word windows that occur twice or more, in O(n log n) a text; texts whose windows all differ are done after one pass.

    Window hashes are packed with their position into one long and sorted; neighbours with equal
    full hashes are repeats. The position takes as many bits as the text needs.
    """
    none = F.array().cast("array<long>")
    df = df.withColumn("_bits", F.length(F.bin("n_words")))
    df = df.withColumn("_h", F.when(F.col("n_words") >= 3, F.transform(F.sequence(F.lit(0), (F.col("n_words") - 3).cast("int")), lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)))).otherwise(none))
    df = df.withColumn("_h", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.col("_h")).otherwise(none))
    df = df.withColumn("_k", F.sort_array(F.expr("transform(_h, (h, i) -> shiftleft(h, _bits) | cast(i as bigint))")))
    df = df.withColumn("_k", F.expr("transform(_k, k -> cast(k & (shiftleft(1L, _bits) - 1) as int))"))
    df = df.withColumn("_s", F.sort_array(F.expr("filter(_k, (k, j) -> (j > 0 and _h[k] = _h[_k[j - 1]]) or (j < size(_k) - 1 and _h[k] = _h[_k[j + 1]]))")))
    return df.withColumn(out, F.expr("aggregate(transform(_s, (s, j) -> least(3, coalesce(get(_s, j + 1), s + 3) - s)), 0L, (a, x) -> a + x)")).drop("_bits", "_h", "_k", "_s")


def base_metrics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed beside the columns given."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.withColumn("_words", _words(text)).withColumn("n_words", F.size("_words").cast("long"))
    df = _repeat_words(df, "n_repeat_words").drop("_words")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn("_lines", lines)
    return df.select(
        *docs.columns, "n_words", "n_repeat_words",
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))).alias("base_failed"),
    )


def normal_line(line: Column) -> Column:
    return F.trim(F.regexp_replace(ascii_lower(line), r"[\x20\x09-\x0D]+", " "))


def _text_key(text: Column) -> list[Column]:
    t = F.coalesce(text, F.lit(""))
    return [F.xxhash64(t).alias("_t1"), F.xxhash64(F.lit(1), t).alias("_t2")]


def frequent_lines(docs: DataFrame, *, id_col="doc_id", text_col="text", host_col="source", line_limit=LINE_LIMIT) -> DataFrame:
    """One row for each distinct text and line to remove from it: _host, _t1, _t2, pos (line numbers, array), words."""
    host = F.coalesce(F.concat(F.lit("="), F.col(host_col)), F.lit(""))
    lines = docs.select(host.alias("_host"), F.col(id_col).alias("_id"), *_text_key(F.col(text_col)), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("pos", "line"))
    lines = lines.select("*", normal_line(F.col("line")).alias("_n")).where("_n <> ''")
    lines = lines.select("_host", "_id", "_t1", "_t2", "pos", F.xxhash64("_n").alias("_l1"), F.xxhash64(F.lit(1), "_n").alias("_l2"), (F.length("_n") - F.length(F.translate("_n", " ", "")) + 1).alias("words"))
    # one row for each line of each distinct text, whatever the number of copies
    per_text = lines.groupBy("_host", "_t1", "_t2", "_l1", "_l2").agg(F.min("_id").alias("_id"), F.collect_set("pos").alias("pos"), F.first("words").alias("words"))
    scratch = Scratch(docs.sparkSession, "quality")
    per_text = scratch.write(per_text, "lines")
    counted = per_text.groupBy("_host", "_l1", "_l2").agg(F.count("*").alias("n_docs"), F.min(F.struct(F.col("_id").isNull(), "_id", "_t1", "_t2")).alias("first")).where(F.col("n_docs") > line_limit)
    counted = scratch.write(counted, "frequent")
    return (
        spread_join(per_text, counted, ["_host", "_l1", "_l2"], "n_docs", per_text.count())
        .where((F.col("_t1") != F.col("first._t1")) | (F.col("_t2") != F.col("first._t2")))
        .select("_host", "_t1", "_t2", "pos", (F.size("pos") * F.col("words")).alias("words"))
    )


def quality_rules(docs: DataFrame, *, id_col="doc_id", text_col="text", host_col="source", line_limit=LINE_LIMIT, left_share=LEFT_SHARE) -> DataFrame:
    """The base metrics of each document, removed_words (in lines above the limit) and kept."""
    host = F.coalesce(F.concat(F.lit("="), F.col(host_col)), F.lit("")).alias("_host")
    metrics = base_metrics(docs.select(id_col, F.col(text_col).alias("_text"), host, *_text_key(F.col(text_col))), "_text").drop("_text")
    removed = frequent_lines(docs, id_col=id_col, text_col=text_col, host_col=host_col, line_limit=line_limit).groupBy("_host", "_t1", "_t2").agg(F.sum("words").alias("removed_words"))
    df = metrics.join(removed, ["_host", "_t1", "_t2"], "left").withColumn("removed_words", F.coalesce("removed_words", F.lit(0)).cast("long"))
    left = F.col("n_words") - F.col("removed_words")
    return df.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (F.when(F.col("base_failed"), F.lit(-1)).otherwise(left) >= F.lit(left_share) * F.col("n_words")).alias("kept"), "removed_words")


def filter_documents(docs: DataFrame, *, id_col="doc_id", text_col="text", host_col="source", chars_col="n_chars", line_limit=LINE_LIMIT, left_share=LEFT_SHARE) -> DataFrame:
    """The kept documents in their own columns, with frequent lines cut out of their texts."""
    host = F.coalesce(F.concat(F.lit("="), F.col(host_col)), F.lit("")).alias("_host")
    removed = frequent_lines(docs, id_col=id_col, text_col=text_col, host_col=host_col, line_limit=line_limit).groupBy("_host", "_t1", "_t2").agg(F.sum("words").alias("_gone"), F.flatten(F.collect_list("pos")).alias("_pos"))
    rows = base_metrics(docs.select(F.struct(*docs.columns).alias("_row"), F.col(text_col).alias("_text"), host, *_text_key(F.col(text_col))), "_text").drop("n_repeat_words", "word_chars", "n_symbols", "n_dup_lines")
    # one comparison over both sides of the join: a filter on base_failed alone would be pushed below
    # the projections, where each use of an array column would repeat the whole expression behind it
    left = F.when(F.col("base_failed"), F.lit(-1)).otherwise(F.col("n_words") - F.coalesce("_gone", F.lit(0)))
    df = rows.join(removed, ["_host", "_t1", "_t2"], "left").where(left >= F.lit(left_share) * F.col("n_words"))
    df = df.withColumn("_lines", F.split("_text", "\n"))
    cut = F.expr("array_join(transform(array_except(sequence(0, size(_lines) - 1), _pos), i -> _lines[i]), '\n')")
    df = df.withColumn("_text", F.when(F.col("_pos").isNull(), F.col("_text")).otherwise(cut))
    return df.select(*(F.col("_text").alias(c) if c == text_col else F.when(F.col("_pos").isNull(), F.col(f"_row.`{c}`")).otherwise(F.length("_text")).cast(docs.schema[c].dataType).alias(c) if c == chars_col else F.col(f"_row.`{c}`").alias(c) for c in docs.columns))


SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS host FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM d),
win AS (SELECT doc_id, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
dup AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i+1, i+2]) AS p FROM dup) GROUP BY 1),
m AS (SELECT w.doc_id, host, text, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  (len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]'))) - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))))::BIGINT AS n_dup_lines,
  coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN rep USING (doc_id)),
l AS (SELECT doc_id, host, text, trim(regexp_replace(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' ') AS n
  FROM (SELECT doc_id, host, text, unnest(string_split(text, chr(10))) AS x FROM d)),
pt AS (SELECT host, text, n, min(id) AS id, max(k) AS k FROM (SELECT host, text, n, doc_id, min(doc_id) AS id, count(*) AS k FROM l WHERE n <> '' GROUP BY ALL) GROUP BY host, text, n),
f AS (SELECT host, n, arg_min(text, id) AS first FROM pt GROUP BY host, n HAVING count(*) > {LINE_LIMIT}),
gone AS (SELECT pt.host, pt.text, sum(k * len(string_split(pt.n, ' '))) AS removed_words FROM pt JOIN f ON pt.host = f.host AND pt.n = f.n WHERE pt.text <> f.first GROUP BY 1, 2),
r AS (SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words AS base_failed, coalesce(gone.removed_words, 0)::BIGINT AS removed_words
  FROM m LEFT JOIN gone ON m.host = gone.host AND m.text = gone.text)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND n_words - removed_words >= {LEFT_SHARE}::DOUBLE * n_words AS kept, removed_words FROM r
"""
