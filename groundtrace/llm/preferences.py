"""Preference formatting in DataFrame functions only: chosen and rejected conversations as prompt and paired masked completions.

The longest common prefix of turns (equal role and text) of the two is rendered once, as the prompt; what
follows in each is its completion. A completion's mask lists the character spans that are trained on: the
texts of assistant turns with the end mark that closes them. Marks inside texts are broken up by a
zero-width space, so that no text can open or close a turn; so are the signs of marks inside roles.

Defined results: turns are in the order of (turn, role, text), repeated ones each count; a null role is
rendered as ``user``, a null text as an empty one, and nulls equal nulls; equal conversations have empty
completions; a pair one side of which has no turns has no prompt; pairs with a null id have no turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MARK, BROKEN, END = "<|", "<​|", "<|end|>\n"
TRAINED_ROLE = "assistant"


def _open(turn: Column) -> Column:
    return F.concat(F.lit(MARK), F.coalesce(F.regexp_replace(turn["role"], "([<|>])", "$1\u200b"), F.lit("user")), F.lit("|>\n"))


def _close(turn: Column) -> Column:
    return F.concat(F.replace(F.coalesce(turn["text"], F.lit("")), F.lit(MARK), F.lit(BROKEN)), F.lit(END))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_open(t), _close(t))), "")


def trained_spans(turns: Column) -> Column:
    """``begin:end`` of each assistant text in the rendered turns, comma-joined."""
    lengths = F.transform(turns, lambda t: F.struct(F.length(_open(t)).alias("open"), F.length(_close(t)).alias("close"), t["role"].eqNullSafe(TRAINED_ROLE).alias("trained")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(state: Column, turn: Column) -> Column:
        begin = state["at"] + turn["open"]
        end = begin + turn["close"]
        span = F.concat(begin.cast("string"), F.lit(":"), end.cast("string"))
        spans = F.when(turn["trained"], F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    return F.array_join(F.aggregate(lengths, zero, step, lambda state: state["spans"]), ",")


def common_turns(chosen: Column, rejected: Column) -> Column:
    same = F.zip_with(chosen, rejected, lambda a, b: a.isNotNull() & b.isNotNull() & a["role"].eqNullSafe(b["role"]) & a["text"].eqNullSafe(b["text"]))
    return (F.array_position(F.concat(same, F.array(F.lit(False))), False) - 1).cast("int")


def format_preferences(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """A row for each of ``pairs`` (pair_id, chosen_id, rejected_id; pair_id is unique) from ``turns`` (conv_id, turn, role, text).

    A conversation's turns meet in one row, as its rendered text must; a conversation in many pairs is joined to each.
    """
    sides = F.explode(F.array(F.struct(F.col("chosen_id").alias("side_id"), F.lit(True).alias("is_chosen")), F.struct(F.col("rejected_id").alias("side_id"), F.lit(False).alias("is_chosen"))))
    wanted = pairs.select("pair_id", "chosen_id", "rejected_id", sides.alias("s")).select("pair_id", "chosen_id", "rejected_id", "s.*")
    own = turns.select("conv_id", F.struct("turn", "role", "text").alias("t"))
    rows = wanted.join(own, F.col("side_id") == F.col("conv_id"), "left")
    both = rows.groupBy("pair_id", "chosen_id", "rejected_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("is_chosen"), F.col("t")))).alias("c"), F.array_sort(F.collect_list(F.when(~F.col("is_chosen"), F.col("t")))).alias("r")
    )
    both = both.withColumn("n", common_turns(F.col("c"), F.col("r")))
    rest = {side: F.slice(F.col(side), F.col("n") + 1, F.size(side)) for side in ("c", "r")}
    both = both.withColumns({"p": F.slice("c", F.lit(1), F.col("n")), "c_rest": rest["c"], "r_rest": rest["r"]})
    return both.select(
        "pair_id",
        "chosen_id",
        "rejected_id",
        F.col("n").cast("long").alias("n_common"),
        rendered(F.col("p")).alias("prompt"),
        rendered(F.col("c_rest")).alias("chosen"),
        rendered(F.col("r_rest")).alias("rejected"),
        trained_spans(F.col("c_rest")).alias("chosen_mask"),
        trained_spans(F.col("r_rest")).alias("rejected_mask"),
    )


def op8_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2n (chosen) and 2n + 1 (rejected), where both are there."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    ids = turns.filter("conv_id IS NOT NULL").groupBy(F.shiftright(F.col("conv_id").cast("long"), 1).alias("pair_id"))
    pairs = ids.agg(F.min("conv_id").alias("chosen_id"), F.max("conv_id").alias("rejected_id")).filter("chosen_id < rejected_id")
    return format_preferences(turns, pairs)


OP8_SQL = """
WITH t AS (
  SELECT conv_id, (conv_id - (conv_id % 2 + 2) % 2) // 2 AS pair_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS n,
    '<|' || coalesce(regexp_replace(role, '([<|>])', '\\1' || chr(8203), 'g'), 'user') || '|>' || chr(10) AS head, replace(coalesce(text, ''), '<|', '<' || chr(8203) || '|') || '<|end|>' || chr(10) AS tail
  FROM conversations WHERE conv_id IS NOT NULL
),
p AS (SELECT pair_id, min(conv_id) AS chosen_id, max(conv_id) AS rejected_id FROM t GROUP BY pair_id HAVING min(conv_id) < max(conv_id)),
diff AS (
  SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, min(coalesce(a.n, b.n)) - 1 AS n_common
  FROM (SELECT t.* FROM t JOIN p ON conv_id = chosen_id) a FULL JOIN (SELECT t.* FROM t JOIN p ON conv_id = rejected_id) b ON a.pair_id = b.pair_id AND a.n = b.n
  WHERE a.n IS NULL OR b.n IS NULL OR a.role IS DISTINCT FROM b.role OR a.text IS DISTINCT FROM b.text GROUP BY 1
),
k AS (SELECT p.*, coalesce(n_common, (SELECT count(*) FROM t WHERE conv_id = chosen_id)) AS n_common FROM p LEFT JOIN diff USING (pair_id)),
s AS (
  SELECT k.pair_id, t.conv_id, t.n, t.n <= n_common AS is_prompt, head || tail AS body, role,
    sum(length(head || tail)) OVER (PARTITION BY t.conv_id, t.n <= n_common ORDER BY t.n) AS stop, length(tail) AS size
  FROM k JOIN t ON t.conv_id IN (chosen_id, rejected_id)
),
g AS (
  SELECT conv_id, string_agg(body, '' ORDER BY n) FILTER (is_prompt) AS prompt, string_agg(body, '' ORDER BY n) FILTER (NOT is_prompt) AS rest,
    string_agg(CAST(stop - size AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY n) FILTER (NOT is_prompt AND role = 'assistant') AS mask
  FROM s GROUP BY conv_id
)
SELECT k.pair_id, chosen_id, rejected_id, CAST(n_common AS BIGINT) AS n_common, coalesce(c.prompt, '') AS prompt, coalesce(c.rest, '') AS chosen, coalesce(r.rest, '') AS rejected,
  coalesce(c.mask, '') AS chosen_mask, coalesce(r.mask, '') AS rejected_mask
FROM k JOIN g c ON c.conv_id = chosen_id JOIN g r ON r.conv_id = rejected_id
"""
