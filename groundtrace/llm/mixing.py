"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only.

Every document draws the key -ln(u)/w, u from a hash of its doc_id and w its quality weight; within a
source the documents in the order of their keys are a weighted sample without replacement. A source's
target in words is first met by complete epochs, then by the documents in the order of their keys up to
what remains. The one that reaches the budget gives only the words that are left of it, so that a
source's taken words are its target to the word.

The prefix sums don't need a source in one task: a source is cut into ranges of its key, about
``RANGE_ROWS`` documents each, the ranges' sums are accumulated, and a range's documents after that. The ranges are even, as the
keys' distribution is known: a document of weight w has a key up to k with a chance of 1 - exp(-wk), and the weights are counted.

Sources in the order of their code points, null last, weigh 5, 2, 1 and again. They share 150 % of all
words; a target stops at twice its source's words and the excess goes to the others by weight, which is
one level t with target = min(cap, weight * t): sources are filled in the order of cap / weight.

Defined results: a null or empty text has size 0 and takes 0; a null doc_id draws as an empty one; rows
that are repeated with doc_id are drawn next to each other, and equal sizes share ties; quality labels
of a doc_id that differ count by their mean; without a label the weight is 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from groundtrace.llm.scratch import materialise

WEIGHTS = (5, 2, 1)
#: Quality weights are rounded to so many steps a unit for the distribution of keys (2 at most: 16 numbers a source), not for the keys.
WEIGHT_STEPS = 8
SHARE = 1.5
MOST_EPOCHS = 2
#: Documents of a source whose sizes are accumulated in one window.
RANGE_ROWS = 4096
#: Rows of the table of sources up to which it is broadcast; beyond, it is joined by source, and AQE splits hot ones.
BROADCAST_SOURCES = 100_000


def word_sizes(text: Column | str) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+``: places where a word begins."""
    plain = F.translate(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.regexp_count(plain, F.lit("[^ ]+")).cast("long")


def uniform(doc_id: Column | str) -> Column:
    """Between 0 and 1, from the first 52 bits of the md5 of the id as text."""
    digits = F.substring(F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(2**52)


def quality(labels: DataFrame) -> DataFrame:
    """(doc_id, weight): 2 for good, 0.5 for bad, between for labels that differ."""
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL")
    return known.groupBy(F.col("doc_id").alias("labelled_id")).agg((0.5 + 1.5 * F.avg(F.col("quality").cast("double"))).alias("weight"))


def targets(sources: DataFrame) -> DataFrame:
    """Adds ``target`` to (source, words, rows). One window over the sources, a few numbers each."""
    order = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), ((F.row_number().over(order) - 1) % len(WEIGHTS) + 1).cast("int"))
    known = sources.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("words") * MOST_EPOCHS)
    filled = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = filled.rowsBetween(W.unboundedPreceding, -1)
    after = filled.rowsBetween(W.currentRow, W.unboundedFollowing)
    known = known.withColumn("total", F.sum("words").over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)) * SHARE)
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after)
    known = known.withColumn("level", level)
    open_ = F.col("cap") > F.col("weight") * F.col("level")  # from the first such source on none is capped
    known = known.withColumn("t", F.min(F.when(open_, F.struct((F.col("cap") / F.col("weight")).alias("at"), F.col("level").alias("level")))).over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("weight") * F.col("t.level"), F.col("cap").cast("double")))
    return known.select("source", "words", "rows", target.alias("target"))


def mixed(docs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(doc_id, source, tie, size, source_size, target, taken), a row for each document; ``tie`` hashes its text."""
    drawn = docs.select("doc_id", "source", F.xxhash64("text").alias("tie"), word_sizes("text").alias("size"), uniform("doc_id").alias("u"))
    if labels is None:
        drawn = drawn.withColumn("weight", F.lit(1.0))
    else:
        weights = quality(labels)
        drawn = drawn.join(weights, F.col("doc_id") == F.col("labelled_id"), "left").drop("labelled_id").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    drawn = drawn.withColumns({"key": -F.log("u") / F.col("weight"), "step": F.greatest(F.lit(1), F.round(F.col("weight") * WEIGHT_STEPS).cast("int"))})
    drawn = materialise(drawn.drop("u", "weight"), "drawn")
    steps = drawn.groupBy("source", "step").agg(F.sum("size").alias("words"), F.count("*").alias("rows"))
    sums = steps.groupBy("source").agg(F.sum("words").alias("words"), F.sum("rows").alias("rows"), F.collect_list(F.struct("step", "rows")).alias("steps"))
    sums = targets(sums).join(sums.select(F.col("source").alias("same"), "steps"), F.col("source").eqNullSafe(F.col("same"))).drop("same")
    sources = materialise(sums.withColumnRenamed("source", "of"), "sources")
    small = sources.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    on = F.col("source").eqNullSafe(F.col("of"))
    ranges = F.ceil(F.col("rows") / RANGE_ROWS)
    below = F.aggregate("steps", F.lit(0.0), lambda n, s: n + s["rows"] * (1 - F.exp(-F.col("key") * s["step"] / WEIGHT_STEPS))) / F.col("rows")
    rows = drawn.drop("step").join(F.broadcast(sources) if small else sources, on).withColumn("part", F.floor(ranges * below)).drop("steps")
    before = W.partitionBy("of").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = rows.groupBy("of", "part").agg(F.sum("size").alias("sum")).select("of", "part", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("start"))
    starts = starts.select(F.col("of").alias("in"), F.col("part").alias("at"), "start")
    inside = W.partitionBy("of", "part").orderBy("key", "doc_id", "size", "tie").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(starts, F.col("of").eqNullSafe(F.col("in")) & (F.col("part") == F.col("at")))
    epochs = F.when(F.col("words") > 0, F.floor(F.col("target") / F.col("words"))).otherwise(0)
    budget = F.round(F.col("target")).cast("long") - epochs * F.col("words")
    part = F.greatest(F.lit(0), F.least(F.col("size"), budget - F.col("start") - F.col("before")))
    return rows.select("doc_id", "source", "tie", "size", F.col("words").alias("source_size"), "target", (epochs * F.col("size") + part).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The documents that the mix takes, all their columns, with ``size``, ``source_size``, ``target`` and ``taken``.

    Rows that are repeated with doc_id, source and text share what the mix takes of them evenly, rounded down. Columns of ``docs`` that have these four names are replaced.
    """
    told = mixed(docs, labels).groupBy("doc_id", "source", "tie").agg(F.max("size").alias("size"), F.max("source_size").alias("source_size"), F.max("target").alias("target"), F.floor(F.sum("taken") / F.count("*")).alias("taken"))
    told = told.filter("taken > 0").withColumnsRenamed({"doc_id": "of_id", "source": "of_source", "tie": "of_text"})
    both = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    same = F.col("row.doc_id").eqNullSafe(F.col("of_id")) & F.col("row.source").eqNullSafe(F.col("of_source")) & (F.xxhash64("row.text") == F.col("of_text"))
    added = ["size", "source_size", "target", "taken"]
    return both.join(told, same).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in added], *added)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mixed(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select("doc_id", "size", "source_size", "target", "taken")


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    (CAST(CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 13)) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0 AS u
  FROM documents
),
q AS (SELECT doc_id, 0.5 + 1.5 * avg(CAST(quality AS DOUBLE)) AS weight FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
k AS (SELECT d.*, -ln(u) / coalesce(weight, 1.0) AS key FROM d LEFT JOIN q ON q.doc_id = d.doc_id),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS words, row_number() OVER (ORDER BY source NULLS LAST) AS n FROM d GROUP BY source),
s1 AS (SELECT source, words, 2 * words AS cap, CASE (n - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, (SELECT sum(words) FROM s0) * 1.5 AS total FROM s0),
s2 AS (
  SELECT *, (CAST(total AS DOUBLE) - CAST(coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
      / CAST(sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level, row_number() OVER o AS r
  FROM s1 WINDOW o AS (ORDER BY cap / weight, source NULLS LAST)
),
t AS (SELECT source, words, least(CAST(cap AS DOUBLE), coalesce(weight * (SELECT arg_min(level, r) FROM s2 WHERE cap > weight * level), CAST(cap AS DOUBLE))) AS target FROM s2),
e AS (SELECT source, words, target, CASE WHEN words > 0 THEN CAST(floor(target / words) AS BIGINT) ELSE 0 END AS epochs FROM t),
p AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k)
SELECT p.doc_id, p.size, e.words AS source_size, e.target,
  CAST(e.epochs * p.size + greatest(0, least(p.size, CAST(round(e.target) AS BIGINT) - e.epochs * e.words - p.before)) AS BIGINT) AS taken
FROM p JOIN e ON p.source IS NOT DISTINCT FROM e.source
"""
