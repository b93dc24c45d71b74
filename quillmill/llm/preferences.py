"""Chat formatting of preference pairs.

A pair has a chosen and a rejected conversation. Their longest common prefix of turns is rendered
once, as the prompt; what follows in each is its completion, with a mask of the parts to learn from
(what the assistant says, and the mark that ends its turn). Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: The template: a turn is OPEN, the role, NEXT, the text, CLOSE.
OPEN, NEXT, CLOSE = "<|", "|>\n", "<|end|>\n"
TEACHES = "assistant"


def conversations(turns: DataFrame, key: str) -> DataFrame:
    """key, turns: the turns (role, text) of each conversation in order of turn, ties by role, then text; nulls first."""
    clean = turns.select(F.col(key).alias("_k"), F.struct(F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), C.text_or_empty().alias("text")).alias("t"))
    return clean.groupBy("_k").agg(F.sort_array(F.collect_list("t")).alias("t")).select(F.col("_k").alias(key), F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda x: F.concat(F.lit(OPEN), x["role"], F.lit(NEXT), x["text"], F.lit(CLOSE))), "")


def mask(turns: Column, teaches: str = TEACHES) -> Column:
    """Spans start:end (code points of the rendered turns, comma-joined) of what the teaching role says."""
    close = len(CLOSE)
    start = F.struct(F.lit(0).alias("p"), F.lit("").alias("o"))

    def step(a: Column, x: Column) -> Column:
        begin = a["p"] + len(OPEN) + len(NEXT) + F.length(x["role"])
        end = begin + F.length(x["text"]) + close
        span = F.concat_ws(":", begin.cast("string"), end.cast("string"))
        return F.struct(end.alias("p"), F.when(x["role"] == teaches, F.concat(a["o"], F.when(a["o"] == "", "").otherwise(","), span)).otherwise(a["o"]).alias("o"))

    return F.aggregate(turns, start, step, lambda a: a["o"])


def format_pairs(chosen: DataFrame, rejected: DataFrame, key: str = "pair_id", teaches: str = TEACHES) -> DataFrame:
    """key, n_common, prompt, chosen, rejected, chosen_mask, rejected_mask for every key of either side.

    Both sides have rows key, turn, role, text. A side without rows is a conversation without turns. Turns
    are equal if role and text are (null counts as empty). Null keys never pair; repeated rows are
    repeated turns, ties of turn go by role, then text; empty tables give an empty table. Very long texts are rendered whole: a conversation is the unit that one task holds.
    """
    a = conversations(chosen, key).select(F.col(key).alias("_a"), F.col("turns").alias("c"))
    b = conversations(rejected, key).select(F.col(key).alias("_b"), F.col("turns").alias("r"))
    none = F.array().cast("array<struct<role:string,text:string>>")
    both = a.join(b, F.col("_a") == F.col("_b"), "full").select(F.coalesce("_a", "_b").alias(key), F.coalesce("c", none).alias("c"), F.coalesce("r", none).alias("r"))
    differs = F.zip_with("c", "r", lambda x, y: ~x.eqNullSafe(y))
    shared = F.array_position(differs, True)
    both = both.withColumn("n", F.when(shared == 0, F.size("c")).otherwise(shared - 1).cast("long"))
    tail = lambda c: F.slice(c, F.col("n").cast("int") + 1, F.greatest(F.size(c), F.lit(1)))
    both = both.withColumns({"ct": tail("c"), "rt": tail("r")})
    return both.select(key, F.col("n").alias("n_common"), rendered(F.slice("c", 1, F.col("n").cast("int"))).alias("prompt"), rendered(F.col("ct")).alias("chosen"), rendered(F.col("rt")).alias("rejected"), mask(F.col("ct"), teaches).alias("chosen_mask"), mask(F.col("rt"), teaches).alias("rejected_mask"))


def op1_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation is chosen; the rejected one is the same up to its last assistant turn, in place of
    which it has the last assistant turn of the neighbour (conv_id with its last bit flipped), or none."""
    turns = C.read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    last = turns.where(F.col("role") == TEACHES).groupBy("pair_id").agg(F.max("turn").alias("last"), F.max_by("text", F.struct("turn", "text")).alias("reply"))
    swap = last.select(F.col("pair_id").bitwiseXOR(F.lit(1)).alias("pair_id"), F.col("reply").alias("other"))
    kept = turns.join(last.select("pair_id", "last"), "pair_id", "left").where(F.col("last").isNull() | (F.col("turn") < F.col("last"))).drop("last")
    replies = last.join(swap, "pair_id").select("pair_id", F.col("last").alias("turn"), F.lit(TEACHES).alias("role"), F.col("other").alias("text"))
    return format_pairs(turns, kept.unionByName(replies))


ORACLE = {
    "op1_preferences": """
WITH t AS (SELECT conv_id AS pair_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
l AS (SELECT pair_id, max(turn) AS last FROM t WHERE role = 'assistant' GROUP BY pair_id),
p AS (SELECT t.pair_id, t.turn, max(t.text) AS text FROM t JOIN l ON t.pair_id = l.pair_id AND t.turn = l.last WHERE role = 'assistant' GROUP BY ALL),
r AS (
  SELECT t.* FROM t LEFT JOIN l ON t.pair_id = l.pair_id WHERE l.last IS NULL OR t.turn < l.last
  UNION ALL
  SELECT p.pair_id, p.turn, 'assistant', q.text FROM p JOIN p AS q ON q.pair_id = xor(p.pair_id, 1)
),
c AS (SELECT pair_id, row_number() OVER (PARTITION BY pair_id ORDER BY turn, role, text) AS i, role, text FROM t),
d AS (SELECT pair_id, row_number() OVER (PARTITION BY pair_id ORDER BY turn, role, text) AS i, role, text FROM r),
n AS (
  SELECT coalesce(c.pair_id, d.pair_id) AS pair_id,
    coalesce(min(coalesce(c.i, d.i)) FILTER (WHERE c.role IS DISTINCT FROM d.role OR c.text IS DISTINCT FROM d.text) - 1, count(*)) AS n
  FROM c FULL JOIN d ON c.pair_id = d.pair_id AND c.i = d.i GROUP BY 1
),
x AS (
  SELECT 'c' AS side, c.*, n.n FROM c JOIN n ON c.pair_id = n.pair_id UNION ALL SELECT 'd', d.*, n.n FROM d JOIN n ON d.pair_id = n.pair_id
),
y AS (SELECT *, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS line FROM x),
z AS (SELECT *, sum(length(line)) OVER (PARTITION BY side, pair_id, i > n ORDER BY i) AS e FROM y),
s AS (SELECT *, (e - length(text) - 8) || ':' || e AS span FROM z)
SELECT n.pair_id, n.n AS n_common,
  coalesce(string_agg(line, '' ORDER BY i) FILTER (WHERE side = 'c' AND i <= n.n), '') AS prompt,
  coalesce(string_agg(line, '' ORDER BY i) FILTER (WHERE side = 'c' AND i > n.n), '') AS chosen,
  coalesce(string_agg(line, '' ORDER BY i) FILTER (WHERE side = 'd' AND i > n.n), '') AS rejected,
  coalesce(string_agg(span, ',' ORDER BY i) FILTER (WHERE side = 'c' AND i > n.n AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg(span, ',' ORDER BY i) FILTER (WHERE side = 'd' AND i > n.n AND role = 'assistant'), '') AS rejected_mask
FROM n LEFT JOIN s ON n.pair_id = s.pair_id GROUP BY n.pair_id, n.n
""",
}
