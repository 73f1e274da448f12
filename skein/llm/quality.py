"""Quality rules by cross-document line frequency, with DataFrame functions only.

A line that many documents of one host hold is furniture, not content. Lines are trimmed, lower-cased,
stripped of repeated white space and hashed; per host, the *distinct* documents that hold a line are
counted, where copies of one whole text count once. Lines above the limit are removed and a document
that keeps too little is rejected.

Cases. Null text: no words, lines or symbols, so the base rule fails it. Null host: a host of its own.
Repeated rows: each gets its own result row. Blank lines are no lines. Ties do not arise: every decision
is a comparison with a limit. An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.common import ROW, documents, materialise, need, numbered, split_words

#: A line is furniture if more distinct texts of its host hold it than both limits allow.
MIN_TEXTS = 20
MAX_SHARE = 0.01
#: A document is depleted if less than this share of its words is left.
MIN_LEFT = 0.3


def _positions(at: Column) -> Column:
    """Sorted start positions of the windows that have an equal neighbour in hash order."""
    same = F.transform(
        at,
        lambda x, k: F.when(
            (F.get(at, k - 1)["h"] == x["h"]) | (F.get(at, k + 1)["h"] == x["h"]),
            x["i"],
        ),
    )
    return F.array_sort(F.array_compact(same))


def _covered(starts: Column) -> Column:
    """Words that the 3-word windows at the sorted ``starts`` cover."""
    gaps = F.transform(starts, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(starts, k + 1) - p, F.lit(3))))
    return F.aggregate(gaps, F.lit(0), lambda total, x: total + x)


def line_hash(line: Column) -> Column:
    """The hash of a line in lower case, trimmed, with single spaces."""
    return F.xxhash64(F.lower(F.array_join(split_words(line), " ")))


def document_stats(docs: DataFrame) -> DataFrame:
    """Counts of the base rules and the hashed lines of each document: one narrow pass over the text.

    docs: doc_id, text, host. Out: uid, doc_id, host, text_hash, the counts, lines (array of line hash and words).
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    uid = F.col(ROW).alias("uid") if ROW in docs.columns else F.monotonically_increasing_id().alias("uid")
    docs = docs.select(uid, "doc_id", "host", text.alias("text"))
    docs = docs.withColumn("w", split_words(F.col("text")))
    docs = docs.withColumn(
        "line",
        F.filter(F.split("text", "\n"), lambda x: F.translate(x, " \t\n\x0b\f\r", "") != ""),
    )
    docs = docs.withColumn("n_words", F.size("w").cast("long"))
    # one hash a window: the array without its last two entries, which would reach beyond the end
    docs = docs.withColumn(
        "g",
        F.when(
            F.col("n_words") >= 3,
            F.transform(
                F.slice("w", 1, F.greatest(F.size("w") - 2, F.lit(0))),
                lambda x, i: F.xxhash64(x, F.get(F.col("w"), i + 1), F.get(F.col("w"), i + 2)),
            ),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    docs = docs.withColumn("distinct_g", F.size(F.array_distinct("g")))
    docs = docs.withColumn(
        "at",
        F.when(
            F.col("distinct_g") < F.size("g"),
            F.array_sort(F.transform("g", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )
    docs = docs.withColumn("starts", F.when(F.col("at").isNotNull(), _positions(F.col("at"))))
    return docs.select(
        "uid",
        "doc_id",
        "host",
        F.xxhash64("text", F.length("text")).alias("text_hash"),
        "n_words",
        F.length(F.translate("text", " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("line") - F.size(F.array_distinct("line"))).cast("long").alias("n_dup_lines"),
        F.coalesce(_covered(F.col("starts")), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.transform(
            "line", lambda x: F.struct(line_hash(x).alias("h"), F.size(split_words(x)).alias("n"))
        ).alias("lines"),
    )


def furniture_lines(stats: DataFrame, min_texts: int = MIN_TEXTS, max_share: float = MAX_SHARE) -> DataFrame:
    """f_host, f_h: the lines above the limits. stats: from ``document_stats``, materialised.

    Shuffles hashes only, (host, line, text) and (host, line) pre-aggregated. A hot host is spread over its lines; a
    hot line is a few partial counts.
    """
    lines = stats.select("host", "text_hash", F.inline("lines"))
    texts = stats.groupBy("host", "text_hash").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count("*").alias("texts"))
    held = (
        lines.groupBy("host", "h", "text_hash").agg(F.lit(1).alias("one")).groupBy("host", "h").agg(F.count("*").alias("held"))
        .where(F.col("held") > min_texts)
    )
    same_host = held["host"].eqNullSafe(texts["host"])
    above = held.join(texts, same_host).where(F.col("held") > F.greatest(F.lit(float(min_texts)), F.col("texts") * max_share))
    return materialise(above.select(held["host"].alias("f_host"), F.col("h").alias("f_h")), "furniture")


def _verdicts(stats: DataFrame, furniture: DataFrame, min_left: float) -> DataFrame:
    lines = stats.select("uid", "host", F.inline("lines"))
    removed = (
        lines.join(furniture, (F.col("h") == F.col("f_h")) & F.col("host").eqNullSafe(F.col("f_host")))
        .groupBy("uid").agg(F.sum("n").cast("long").alias("removed"), F.count("*").cast("long").alias("removed_lines"))
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        stats.drop("lines").join(removed, "uid", "left")
        .withColumn("base_failed", failed)
        .withColumn("removed_words", F.coalesce("removed", F.lit(0)).cast("long"))
        .withColumn("removed_lines", F.coalesce("removed_lines", F.lit(0)).cast("long"))
        .withColumn("kept", ~F.col("base_failed") & ((F.col("n_words") - F.col("removed_words")) >= min_left * F.col("n_words")))
    )


def line_frequency_verdicts(
    docs: DataFrame, host: str = "source", min_texts: int = MIN_TEXTS, max_share: float = MAX_SHARE, min_left: float = MIN_LEFT
) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, ``host``) with base counts, removed words and the verdict."""
    base = need(docs, doc_id=T.LongType(), text=T.StringType(), **{host: T.StringType()}).withColumnRenamed(host, "host")
    stats = materialise(document_stats(base), "line-stats")
    return _verdicts(stats, furniture_lines(stats, min_texts, max_share), min_left)


def cleaned_texts(
    docs: DataFrame, host: str = "source", min_texts: int = MIN_TEXTS, max_share: float = MAX_SHARE, min_left: float = MIN_LEFT
) -> DataFrame:
    """doc_id and text without furniture lines of the rows that are kept."""
    rows = numbered(need(docs, doc_id=T.LongType(), text=T.StringType(), **{host: T.StringType()}).withColumnRenamed(host, "host"))
    stats = materialise(document_stats(rows), "line-stats")
    furniture = furniture_lines(stats, min_texts, max_share)
    kept = _verdicts(stats, furniture, min_left).where("kept").select(F.col("uid").alias(ROW))
    lines = rows.join(kept, ROW, "left_semi").select(ROW, "doc_id", "host", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("h", line_hash(F.col("line")))
    left = lines.join(furniture, (F.col("h") == F.col("f_h")) & F.col("host").eqNullSafe(F.col("f_host")), "left_anti")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"])
    return left.groupBy(ROW, "doc_id").agg(F.array_join(ordered, "\n").alias("text")).drop(ROW)


def op10_line_frequency(spark, sf_dir: str) -> DataFrame:
    """The verdict on every document, under the production limits."""
    found = line_frequency_verdicts(documents(spark, sf_dir, "doc_id", "text", "source"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words", "removed_lines"
    )


OP10_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS uid, doc_id, source, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, list_filter(string_split(translate(text, chr(9)||chr(10)||chr(11)||chr(12)||chr(13), '     '), ' '), lambda x: x <> '') AS ws,
    list_filter(string_split(text, chr(10)), lambda x: trim(translate(x, chr(9)||chr(11)||chr(12)||chr(13), '    ')) <> '') AS ls
  FROM d
), g AS (
  SELECT uid, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] AS win FROM (SELECT uid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)
), rep AS (
  SELECT uid, count(DISTINCT p) AS n FROM (
    SELECT uid, unnest([i, i+1, i+2]) AS p FROM (SELECT uid, i, count(*) OVER (PARTITION BY uid, win) AS c FROM g) WHERE c > 1
  ) GROUP BY uid
), l AS (
  SELECT uid, source, text,
    lower(array_to_string(list_filter(string_split(translate(x, chr(9)||chr(11)||chr(12)||chr(13), '    '), ' '), lambda y: y <> ''), ' ')) AS line,
    len(list_filter(string_split(translate(x, chr(9)||chr(11)||chr(12)||chr(13), '    '), ' '), lambda y: y <> '')) AS n
  FROM (SELECT uid, source, text, unnest(ls) AS x FROM w)
), texts AS (SELECT source, count(DISTINCT text) AS texts FROM d GROUP BY source
), held AS (SELECT source, line, count(DISTINCT text) AS held FROM l GROUP BY source, line
), furniture AS (
  SELECT h.source, h.line FROM held h JOIN texts t ON h.source IS NOT DISTINCT FROM t.source
  WHERE h.held > greatest(20, 0.01 * t.texts)
), gone AS (
  SELECT uid, sum(n) AS removed, count(*) AS lines FROM l JOIN furniture f ON l.line = f.line AND l.source IS NOT DISTINCT FROM f.source GROUP BY uid
), s AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(translate(text, ' '||chr(9)||chr(10)||chr(11)||chr(12)||chr(13), '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(coalesce(gone.removed, 0) AS BIGINT) AS removed_words, CAST(coalesce(gone.lines, 0) AS BIGINT) AS removed_lines
  FROM w LEFT JOIN rep USING (uid) LEFT JOIN gone USING (uid)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND (n_words - removed_words) >= 0.3 * n_words AS kept,
  removed_words, removed_lines
FROM s
"""
