"""Removal of repeated line runs by a suffix array over line IDs, in DataFrame functions only.

A document is the sequence of its non-blank lines, a line is its 64-bit ID. The suffix array is made by
distributed prefix doubling: the groups of equal lines are sorted over all partitions, and a group's place
in that order is the rank of its suffixes by their first line; the pairs (rank of the first 2**k lines, rank of
the next 2**k) are sorted in the same way into ranks by 2**(k + 1) lines. A suffix whose group has no other
member shares no more lines with any suffix, so it leaves the rounds; so do blocks of lines that are longer than any run that
is asked for. Groups are counted before they are shuffled, so a line that stands in a third of all rows is one row.

Two suffixes have a longest common prefix of at least n lines, 2**k <= n < 2**(k + 1), exactly if the ranks
of their first 2**k lines and those of the 2**k lines that end the prefix are equal; such suffixes are one interval of the suffix
array. The depths at which intervals are looked for are the least that hold ``min_words`` words, counted from a run's first line
and counted back from its last: the repeated runs of so many words are the unions of these prefixes, and overlapping ones
are merged into maximal runs. An interval's first suffix, in the order of doc_id, text hash and line, stays; the runs at all others go.

Words are runs of characters that are neither blanks nor U+0009 to U+000D. Equal lines have equal 64-bit IDs; unequal ones
are taken for equal with a chance of about 2**-64 a pair. Defined results: lines without words are neither compared nor counted and
stay, unless no other line of the document stays; null and word-free texts stay as they are; rows with a
null doc_id stay as they are and are nobody's earlier copy; rows that are repeated with doc_id and text
are one document, all of them treated alike; different texts of one doc_id are documents in the order of their text hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from groundtrace.llm.scratch import attached, discard, materialise

#: Words of a run that is removed when it is repeated.
MIN_WORDS = 50
#: A document; its lines are numbered by ``pos``.
DOC = ["doc_id", "tie"]


def word_count(line: Column) -> Column:
    trimmed = F.trim(line)
    plain = F.length(trimmed) - F.length(F.replace(trimmed, F.lit(" "), F.lit(""))) + 1
    odd = trimmed.rlike("[\\x09-\\x0D]|  ")
    return F.when(trimmed == "", 0).when(odd, F.regexp_count(trimmed, F.lit("[^\\x20\\x09-\\x0D]+"))).otherwise(plain)


def ranked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, rank) of the groups with two rows and more: ``rank`` is increasing in the order of the keys over all partitions."""
    groups = rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
    return materialise(groups.orderBy(*keys).withColumn("rank", F.monotonically_increasing_id()), "ranks")


def numbered_lines(docs: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, tie, pos, h, words, to, since): each line, the end of the shortest run from it and the beginning of the shortest run up to it.

    Only documents of ``min_words`` and more; a line counts ``min_words`` at most, which changes no run. The lines of a document are in one task.
    """
    lines = F.transform(F.split("text", "\n"), lambda line: F.struct(F.xxhash64(line).alias("h"), F.least(word_count(line), F.lit(min_words)).cast("int").alias("words")))
    rows = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("tie"), F.filter(lines, lambda x: x["words"] > 0).alias("lines"))
    rows = rows.filter(F.aggregate("lines", F.lit(0), lambda a, x: F.least(a + x["words"], F.lit(min_words))) >= min_words).dropDuplicates(DOC)
    end = F.array(F.struct(F.lit(None).cast("bigint").alias("h"), F.lit(0).alias("words")))  # a line after the last, which ends its runs
    rows = rows.select(*DOC, F.posexplode(F.concat("lines", end)).alias("pos", "line")).select(*DOC, "pos", "line.*")
    inside = W.partitionBy(*DOC).orderBy("pos")
    rows = rows.withColumn("before", F.coalesce(F.sum("words").over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    by_words = W.partitionBy(*DOC).orderBy("before")
    after = F.min("pos").over(by_words.rangeBetween(min_words, 2 * min_words - 1)) - 1
    behind = F.max("pos").over(by_words.rangeBetween(1 - 2 * min_words, -min_words))
    rows = rows.withColumns({"to": after, "behind": behind}).withColumn("since", F.lead("behind").over(by_words))
    return rows.filter("h IS NOT NULL").select(*DOC, "pos", "h", "words", "to", "since")


def suffix_ranks(lines: DataFrame, min_words: int) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """The repeated lines; (doc_id, tie, pos, k, rank): the rank of each suffix by its first 2**k lines, where another one has the same; the tables that these read."""
    groups = ranked(lines, ["h"])
    first = materialise(attached(lines, groups, ["h"]).drop("h"), "suffixes")
    discard(groups)
    kept = [first]
    active = first.select(*DOC, "pos", "rank", "words", F.col("words").alias("head"), F.col("words").alias("tail"))
    every, k = active.select(*DOC, "pos", F.lit(0).alias("k"), "rank"), 0
    while 2 ** (k + 1) <= min_words:
        beside = W.partitionBy(*DOC).orderBy("pos").rangeBetween(2**k, 2**k)
        pairs = active.withColumn("next", F.max(F.struct("rank", "words", "tail")).over(beside)).filter("next IS NOT NULL")
        pairs = pairs.select(*DOC, "pos", F.col("rank").alias("one"), F.col("next.rank").alias("two"), (F.col("words") + F.col("next.words")).alias("words"), "head", F.col("next.tail").alias("tail"))
        pairs = materialise(pairs.filter(F.col("words") - F.greatest("head", "tail") < min_words), "pairs")  # else longer than any run
        k += 1
        groups = ranked(pairs, ["one", "two"])
        active = materialise(attached(pairs, groups, ["one", "two"]).drop("one", "two"), "suffixes")
        discard(pairs, groups)
        kept.append(active)
        if active.isEmpty():
            break
        every = every.unionByName(active.select(*DOC, "pos", F.lit(k).alias("k"), "rank"))
    return first, every, kept


def lcp_intervals(docs: DataFrame, min_words: int = MIN_WORDS) -> tuple[DataFrame, DataFrame]:
    """The prefixes (doc_id, tie, low, high, lines, one, two) of suffixes, and the intervals (lines, one, two, n, first) of two suffixes and more."""
    lines = materialise(numbered_lines(docs, min_words), "lines")
    first, ranks, kept = suffix_ranks(lines, min_words)
    ends = F.array(F.struct(F.col("pos").alias("low"), F.col("to").alias("high")), F.struct(F.col("since").alias("low"), F.col("pos").alias("high")))
    runs = first.select(*DOC, F.explode(ends).alias("run")).select(*DOC, "run.*").filter("low IS NOT NULL AND high IS NOT NULL")
    runs = runs.withColumn("lines", F.col("high") - F.col("low") + 1).withColumn("k", F.length(F.bin(F.col("lines").cast("long"))) - 1)
    runs = runs.withColumn("last", F.col("high") - F.expr("shiftleft(1, k)") + 1)
    begin = ranks.select(*DOC, F.col("pos").alias("low"), "k", F.col("rank").alias("one"))
    finish = ranks.select(*DOC, F.col("pos").alias("last"), "k", F.col("rank").alias("two"))
    prefixes = materialise(runs.join(begin, [*DOC, "low", "k"]).join(finish, [*DOC, "last", "k"]).select(*DOC, "low", "high", "lines", "one", "two"), "prefixes")
    discard(lines, *kept)
    place = F.struct(*DOC, "low")
    intervals = prefixes.groupBy("lines", "one", "two").agg(F.count("*").alias("n"), F.min(place).alias("first"), F.max(place).alias("at_last"))
    return prefixes, materialise(intervals.filter("first < at_last").drop("at_last"), "intervals")


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, tie, spans): for each document with later copies of runs, these as maximal (low, high) non-blank lines in order."""
    prefixes, intervals = lcp_intervals(docs, min_words)
    later = attached(prefixes, intervals, ["lines", "one", "two"]).filter(F.struct(*DOC, "low") > F.col("first")).select(*DOC, "low", "high")
    inside = W.partitionBy(*DOC).orderBy("low", "high")
    later = later.withColumn("apart", F.col("low") > F.max("high").over(inside.rowsBetween(W.unboundedPreceding, -1)) + 1)
    later = later.withColumn("run", F.count_if("apart").over(inside.rowsBetween(W.unboundedPreceding, 0)))
    runs = later.groupBy(*DOC, "run").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    spans = materialise(runs.groupBy(*DOC).agg(F.array_sort(F.collect_list(F.struct("low", "high"))).alias("spans")), "spans")
    discard(prefixes, intervals)
    return spans


def split_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """struct ``row`` of all columns of ``docs``, ``lines`` and ``kept`` lines of its text (blank ones too), ``n_lines`` and ``n_deleted`` without blank ones."""
    spans = repeated_spans(docs, min_words).withColumnRenamed("doc_id", "own_id").withColumnRenamed("tie", "own_tie")
    both = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    # never by broadcast: where a small table were and a larger one not, figures of the small one would say nothing of the disk that the larger one takes
    both = both.join(spans.hint("merge"), (F.col("row.doc_id") == F.col("own_id")) & (F.xxhash64("row.text") == F.col("own_tie")), "left")
    empty = F.array().cast("array<struct<low: int, high: int>>")
    both = both.select("row", F.coalesce("spans", empty).alias("spans"), F.coalesce(F.split("row.text", "\n"), F.array().cast("array<string>")).alias("lines"))
    both = both.withColumn("filled", F.filter(F.transform("lines", lambda line, i: F.when(line.rlike("[^\\x20\\x09-\\x0D]"), i)), lambda x: x.isNotNull()))
    both = both.withColumn("gone", F.flatten(F.transform("spans", lambda s: F.slice("filled", s["low"] + 1, s["high"] - s["low"] + 1))))
    whole = F.size("gone") == F.size("filled")
    kept = F.when(F.size("gone") == 0, F.col("lines")).when(whole, F.array().cast("array<string>"))
    kept = kept.otherwise(F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone"), lambda i: F.get("lines", i)))
    return both.select("row", "lines", kept.alias("kept"), F.size("filled").cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_deleted"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without later copies of repeated runs; a document none of whose lines stays goes.

    Texts of which nothing is removed stay byte for byte; ``n_chars`` follows a text that changes.
    """
    done = split_lines(docs, min_words).filter("n_deleted = 0 OR n_deleted < n_lines")
    text = F.when(F.col("n_deleted") == 0, F.col("row.text")).otherwise(F.array_join("kept", "\n"))
    out = {c: F.col(f"row.`{c}`") for c in docs.columns} | {"text": text}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(F.col("n_deleted") == 0, F.col("row.n_chars")).otherwise(F.length(text).cast(docs.schema["n_chars"].dataType))
    return done.select([v.alias(c) for c, v in out.items()])


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = split_lines(docs)
    return done.select(
        F.col("row.doc_id").alias("doc_id"), "n_lines", "n_deleted", F.sha2(F.array_join("kept", "\n"), 256).alias("kept_sha256")
    )


OP6_SQL = rf"""
WITH l0 AS (
  SELECT doc_id, line, line_no, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents WHERE text IS NOT NULL)
),
l AS (SELECT doc_id, line, line_no, w, row_number() OVER o - 1 AS p, sum(w) OVER o AS c FROM l0 WHERE w > 0 WINDOW o AS (PARTITION BY doc_id ORDER BY line_no)),
ends AS (
  SELECT a.doc_id, a.p AS low, min(b.p) AS high FROM l a JOIN l b ON a.doc_id = b.doc_id AND b.p >= a.p AND b.p < a.p + {MIN_WORDS} AND b.c - (a.c - a.w) >= {MIN_WORDS} GROUP BY ALL
  UNION
  SELECT b.doc_id, max(a.p) AS low, b.p AS high FROM l a JOIN l b ON a.doc_id = b.doc_id AND b.p >= a.p AND b.p < a.p + {MIN_WORDS} AND b.c - (a.c - a.w) >= {MIN_WORDS} GROUP BY b.doc_id, b.p
),
texts AS (SELECT doc_id, list(line ORDER BY p) AS ls FROM l GROUP BY doc_id),
runs AS (SELECT doc_id, low, high, array_to_string(list_slice(ls, low + 1, high + 1), chr(10)) AS k FROM ends JOIN texts USING (doc_id)),
later AS (SELECT doc_id, low, high FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, low) AS n FROM runs) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(low, high + 1)) AS p FROM later),
marked AS (SELECT l0.doc_id, l0.line_no, l0.line, l0.w, g.p IS NOT NULL AS is_gone FROM l0 LEFT JOIN l ON l.doc_id = l0.doc_id AND l.line_no = l0.line_no LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.p = l.p),
sums AS (
  SELECT doc_id, count(*) FILTER (w > 0) AS n_lines, count(*) FILTER (is_gone) AS n_deleted,
    string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT is_gone) AS kept
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_deleted, 0) AS BIGINT) AS n_deleted,
  sha256(CASE WHEN n_deleted > 0 AND n_deleted = n_lines THEN '' ELSE coalesce(kept, '') END) AS kept_sha256
FROM documents d LEFT JOIN sums s ON s.doc_id = d.doc_id
"""
