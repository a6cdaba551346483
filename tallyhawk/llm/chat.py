"""Preference formatting of paired conversations; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _turns(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """``conv, turns``: each conversation's turns in order (turn, then role, then text)."""
    fields = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return turns.where(F.col(conv_col).isNotNull()).groupBy(F.col(conv_col).alias("conv")).agg(F.array_sort(F.collect_list(fields)).alias("turns"))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit("\n"), t["text"], F.lit(CLOSE + "\n"))), "")


def _masked(turns: Column) -> Column:
    """``start:end`` of what is learnt in a completion: the texts of the assistant's turns with their end marks.

    Offsets are code points from the completion's start. The running length travels along a fold over the turns.
    """
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        start = acc["at"] + len(OPEN) + F.length(t["role"]) + 1
        end = start + F.length(t["text"]) + len(CLOSE)
        span = F.concat(start.cast("string"), F.lit(":"), end.cast("string"))
        spans = F.when(t["role"] == "assistant", F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct((end + 1).alias("at"), spans.alias("spans"))

    return F.array_join(F.aggregate(turns, zero, step)["spans"], ",")


def format_preferences(
    turns: DataFrame, pairs: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``pairs`` (``pair_id, chosen_id, rejected_id``).

    The longest common prefix of turns (role and text) of both conversations is rendered once as ``prompt``;
    what follows in each is its completion, with the spans of the assistant's turns as mask, so a shared
    prompt is never learnt. Turns are put in order by number, ties by role and text, so repeated rows stay
    as turns of their own; null roles and texts count as empty. A conversation that is missing counts as one
    without turns, and then no prefix is shared. Rows with a null conversation are not looked at; an empty
    table gives an empty table. One shuffle gathers conversations (a row per turn), two join them to the pairs.
    """
    conv = _turns(turns, conv_col, turn_col, role_col, text_col)
    none = F.array().cast(conv.schema["turns"].dataType)
    both = (
        pairs.select("pair_id", "chosen_id", "rejected_id")
        .join(conv.select(F.col("conv").alias("chosen_id"), F.col("turns").alias("c")), "chosen_id", "left")
        .join(conv.select(F.col("conv").alias("rejected_id"), F.col("turns").alias("r")), "rejected_id", "left")
        .withColumns({"c": F.coalesce("c", none), "r": F.coalesce("r", none)})
    )
    same = F.zip_with("c", "r", lambda a, b: F.coalesce((a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False)))
    differ = F.array_position(same, F.lit(False))
    both = both.withColumn("n", F.when(differ > 0, differ - 1).otherwise(F.least(F.size("c"), F.size("r"))).cast("int"))
    rest = lambda c: F.slice(c, F.col("n") + 1, F.greatest(F.size(c), F.lit(1)))
    both = both.withColumns({"cr": rest("c"), "rr": rest("r"), "p": F.slice("c", F.lit(1), F.col("n"))})
    return both.select(
        "pair_id", "chosen_id", "rejected_id", F.col("n").cast("long").alias("n_prefix_turns"), _render(F.col("p")).alias("prompt"),
        _render(F.col("cr")).alias("chosen"), _masked(F.col("cr")).alias("chosen_mask"), _render(F.col("rr")).alias("rejected"), _masked(F.col("rr")).alias("rejected_mask"),
    )


def neighbours(turns: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Pairs of conversations 2k (chosen) and 2k+1 (rejected), one pair for each k of which either is there."""
    k = F.floor(F.col(conv_col) / 2).cast("long")
    return turns.where(F.col(conv_col).isNotNull()).select(k.alias("pair_id")).distinct().select("pair_id", (F.col("pair_id") * 2).alias("chosen_id"), (F.col("pair_id") * 2 + 1).alias("rejected_id"))


_TURN = "'<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10)"
#: DuckDB SQL of the query.
ORACLE = f"""
WITH t AS (
  SELECT conv_id // 2 AS pair_id, conv_id % 2 AS side, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(role, ''), coalesce(text, '')) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
p AS (
  SELECT pair_id, least(count(*) FILTER (side = 0), count(*) FILTER (side = 1)) AS both FROM t GROUP BY pair_id),
d AS (
  SELECT a.pair_id, min(a.k) AS k FROM t a JOIN t b ON a.pair_id = b.pair_id AND a.k = b.k AND a.side = 0 AND b.side = 1
  WHERE a.role <> b.role OR a.text <> b.text GROUP BY a.pair_id),
n AS (SELECT p.pair_id, coalesce(d.k - 1, p.both) AS n FROM p LEFT JOIN d USING (pair_id)),
s AS (
  SELECT t.*, n.n, {_TURN} AS body,
         sum(length({_TURN})) OVER (PARTITION BY t.pair_id, t.side, t.k > n.n ORDER BY t.k) AS upto
  FROM t JOIN n USING (pair_id)),
g AS (
  SELECT pair_id, side,
         string_agg(body, '' ORDER BY k) FILTER (k <= n) AS prompt,
         string_agg(body, '' ORDER BY k) FILTER (k > n) AS rest,
         string_agg((upto - length(text) - 11)::BIGINT::VARCHAR || ':' || (upto - 1)::BIGINT::VARCHAR, ',' ORDER BY k) FILTER (k > n AND role = 'assistant') AS mask
  FROM s GROUP BY pair_id, side)
SELECT n.pair_id, n.pair_id * 2 AS chosen_id, n.pair_id * 2 + 1 AS rejected_id, CAST(n.n AS BIGINT) AS n_prefix_turns,
       coalesce(c.prompt, '') AS prompt, coalesce(c.rest, '') AS chosen, coalesce(c.mask, '') AS chosen_mask,
       coalesce(r.rest, '') AS rejected, coalesce(r.mask, '') AS rejected_mask
FROM n LEFT JOIN g c ON c.pair_id = n.pair_id AND c.side = 0 LEFT JOIN g r ON r.pair_id = n.pair_id AND r.side = 1
"""
