"""Preference pairs of chats: the shared turns once as prompt, the rest as two masked completions.

The prompt is the longest common prefix of turns of the chosen and the rejected conversation, turns
being equal in role and text.  Each completion renders the remaining turns of its side; ``trained``
marks the places (begin, end) of the assistant's words in it, end markers included, and everything
else is masked out of the loss.

Cases: a null conversation has no turns; null roles read ``unknown`` and null texts are empty; equal
sides give empty completions; a null turn number comes first, and turns with equal numbers follow in
order of role and text; a turn without a conversation id is a conversation of its own, equal ones
together, so that no task gathers all of them; texts of any length stay whole; repeated turns stay; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The markers around a turn.
BEGIN, END = "<|im_start|>", "<|im_end|>"
TURN = "struct<turn: bigint, role: string, text: string>"


def conversations(df: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id, turns): each conversation's turns in order."""
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    alone = F.when(F.col(id_col).isNull(), F.xxhash64("t"))
    return df.select(id_col, turn.alias("t")).groupBy(id_col, alone.alias("alone")).agg(F.array_sort(F.collect_list("t")).alias("turns")).drop("alone")


def _rendered(turn: Column) -> Column:
    return F.concat(F.lit(BEGIN), turn["role"], F.lit("\n"), turn["text"], F.lit(END + "\n"))


def _text(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _rendered), "")


def _trained(turns: Column) -> Column:
    """(begin, end) of the assistant's texts with their end markers in the rendered turns."""
    spans = F.lit(None).cast("array<struct<begin: bigint, end: bigint>>")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.coalesce(spans, F.array().cast("array<struct<begin: bigint, end: bigint>>")).alias("spans"))

    def add(acc: Column, turn: Column) -> Column:
        begin = (acc["at"] + len(BEGIN) + F.char_length(turn["role"]) + 1).cast("long")
        end = (begin + F.char_length(turn["text"]) + len(END)).cast("long")
        more = F.concat(acc["spans"], F.array(F.struct(begin.alias("begin"), end.alias("end"))))
        return F.struct((end + 1).cast("long").alias("at"), F.when(turn["role"] == "assistant", more).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, start, add, lambda acc: acc["spans"])


def preferences(pairs: DataFrame, id_col: str = "pair_id") -> DataFrame:
    """(id, n_prompt_turns, prompt, chosen, chosen_trained, rejected, rejected_trained) of (id, chosen, rejected) turn arrays."""
    none = F.array().cast(f"array<{TURN}>")
    df = pairs.select(id_col, F.coalesce("chosen", none).alias("c"), F.coalesce("rejected", none).alias("r"))
    same = F.zip_with("c", "r", lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False)))
    first = F.array_position(same, F.lit(False)).cast("int")
    df = df.withColumn("n", F.when(first > 0, first - 1).otherwise(F.size(same)))
    rest = lambda name: F.slice(name, F.col("n") + 1, F.greatest(F.size(name) - F.col("n"), F.lit(0)))
    df = df.withColumns({"shared": F.slice("c", 1, F.col("n")), "c": rest("c"), "r": rest("r")})
    return df.select(
        id_col,
        F.col("n").cast("long").alias("n_prompt_turns"),
        _text(F.col("shared")).alias("prompt"),
        _text(F.col("c")).alias("chosen"),
        _trained(F.col("c")).alias("chosen_trained"),
        _text(F.col("r")).alias("rejected"),
        _trained(F.col("r")).alias("rejected_trained"),
    )


def swapped_pairs(convs: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(pair_id, chosen, rejected): each conversation against itself with its last turn taken from its neighbour.

    Neighbours are the ids 2k and 2k + 1; without one, the last turn is dropped instead.
    """
    last = F.element_at("turns", -1)
    neighbour = convs.select(F.col(id_col).bitwiseXOR(F.lit(1).cast("long")).alias("its_id"), last.alias("other")).where("its_id IS NOT NULL")
    joined = convs.join(neighbour, F.col(id_col) == F.col("its_id"), "left")
    kept = F.slice("turns", 1, F.size("turns") - 1)
    own = last
    swapped = F.struct(own["turn"].alias("turn"), own["role"].alias("role"), F.col("other")["text"].alias("text"))
    return joined.select(F.col(id_col).alias("pair_id"), F.col("turns").alias("chosen"), F.when(F.col("other").isNotNull(), F.concat(kept, F.array(swapped))).otherwise(kept).alias("rejected"))


def digests(found: DataFrame) -> DataFrame:
    """Counts and digests of what ``preferences`` returns."""
    words = lambda name: F.aggregate(name, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    digest = lambda name: F.sha2(F.col(name).cast("binary"), 256)
    return found.select(
        F.col("pair_id").alias("conv_id"),
        "n_prompt_turns",
        digest("prompt").alias("prompt_sha256"),
        digest("chosen").alias("chosen_sha256"),
        words("chosen_trained").alias("chosen_trained_chars"),
        digest("rejected").alias("rejected_sha256"),
        words("rejected_trained").alias("rejected_trained_chars"),
    )


ORACLE = f"""
WITH conv AS (
  SELECT conv_id, list(struct_pack(turn := turn, role := coalesce(role, 'unknown'), text := coalesce(text, '')) ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) AS t
  FROM conversations GROUP BY conv_id, CASE WHEN conv_id IS NULL THEN struct_pack(turn := turn, role := coalesce(role, 'unknown'), text := coalesce(text, '')) END
), pair AS (
  SELECT a.conv_id, a.t AS c, CASE WHEN b.t IS NULL THEN a.t[:-2]
    ELSE list_concat(a.t[:-2], [struct_pack(turn := a.t[-1].turn, role := a.t[-1].role, text := b.t[-1].text)]) END AS r
  FROM conv a LEFT JOIN conv b ON b.conv_id = xor(a.conv_id, 1)
), cut AS (
  SELECT *, len(list_filter(range(1, least(len(c), len(r)) + 1), lambda k: c[:k] = r[:k])) AS n FROM pair
), side AS (
  SELECT conv_id, n, c[:n] AS p, c[n + 1:] AS c, r[n + 1:] AS r FROM cut
)
SELECT conv_id, cast(n AS BIGINT) AS n_prompt_turns,
  {", ".join(f"sha256(coalesce(list_aggregate(list_transform({s}, lambda x: '{BEGIN}' || x.role || chr(10) || x.text || '{END}' || chr(10)), 'string_agg', ''), '')) AS {name}_sha256" for s, name in (("p", "prompt"), ("c", "chosen"), ("r", "rejected")))},
  {", ".join(f"cast(coalesce(list_sum(list_transform(list_filter({s}, lambda x: x.role = 'assistant'), lambda x: length(x.text) + {len(END)})), 0) AS BIGINT) AS {name}_trained_chars" for s, name in (("c", "chosen"), ("r", "rejected")))}
FROM side
"""
