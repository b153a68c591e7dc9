"""Chat formatting by perspective rotation: every participant in turn is the assistant, the others are named users.

A conversation may be of any length, so a rendering comes in chunks of neighbouring turns. Each chunk has its text,
the spans in it that the assistant wrote (the mask), and its place in the whole rendering.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelloom.llm.common import cut
from labelloom.operators.shared import ranked

CHUNK_TURNS = 64
BLOCK_CHUNKS = 4096
ASSISTANT = "assistant"
OPEN, BETWEEN, CLOSE = "<|", "|>\n", "\n"


def rotated(turns: DataFrame, chunk_turns: int = CHUNK_TURNS) -> DataFrame:
    """Rows (conv_id, perspective, chunk, first_turn, n_turns, offset, text, mask) of (conv_id, turn, role, text).

    perspective is the role that speaks as the assistant; every role of a conversation gets one rendering, 'system'
    too where it speaks. A turn is rendered as a header line with the speaker's name, then the text and a line end;
    mask lists [start, end) of the assistant's texts with their line end, in code points of the chunk's text. The mask
    decides whose text it is: a text may hold what looks like a header line, and stays as it is. offset is the length
    of the rendering before the chunk. Turns go by turn (null first), then role and text, and every ``chunk_turns`` of
    them are a chunk, so that neither a long conversation nor a turn number that repeats makes a long row. A null role
    is the participant 'unknown', a null text is empty, a null conv_id is a conversation of its own; repeated rows are
    turns of their own; an empty table gives an empty result; other columns are ignored.
    """
    conv = [F.col("conv_id").isNull().alias("none"), F.coalesce("conv_id", F.lit(0)).cast("long").alias("conv")]
    clean = turns.select(*conv, F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    numbered = ranked(clean, ["none", "conv"], ["turn", "role", "text"])
    people = cut(clean.select("none", "conv", F.col("role").alias("perspective")).distinct(), "people")
    own = F.col("role") == F.col("perspective")
    named = F.when(own, F.lit(ASSISTANT)).otherwise(F.concat(F.lit("user name="), "role"))
    each = numbered.join(people, ["none", "conv"]).withColumn("chunk", F.floor((F.col("rank") - 1) / chunk_turns)).withColumn("head", F.concat(F.lit(OPEN), named, F.lit(BETWEEN)))
    keys = ["none", "conv", "perspective", "chunk"]
    piece = F.struct("rank", "turn", F.length("head").alias("lead"), own.alias("own"), F.concat("head", "text", F.lit(CLOSE)).alias("rendered"))
    grouped = each.select(*keys, piece.alias("piece")).groupBy(*keys).agg(F.array_sort(F.collect_list("piece")).alias("pieces"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("mask"))

    def step(acc, p):
        end = acc["at"] + F.length(p["rendered"])
        return F.struct(end.alias("at"), F.when(p["own"], F.concat(acc["mask"], F.array(F.array(acc["at"] + p["lead"], end)))).otherwise(acc["mask"]).alias("mask"))

    done = grouped.select(*keys, F.col("pieces")[0]["turn"].alias("first_turn"), F.size("pieces").alias("n_turns"), F.array_join(F.transform("pieces", lambda p: p["rendered"]), "").alias("text"), F.aggregate("pieces", zero, step)["mask"].alias("mask"))
    lengths = each.groupBy(*keys).agg(F.sum(F.length("head") + F.length("text") + len(CLOSE)).alias("length"))
    placed = done.join(_offsets(lengths, keys[:3]), keys)
    return placed.select(F.when(~F.col("none"), F.col("conv")).alias("conv_id"), "perspective", "chunk", "first_turn", "n_turns", "offset", "text", "mask")


def _offsets(lengths: DataFrame, keys: list[str], block: int = BLOCK_CHUNKS) -> DataFrame:
    """Rows (keys, chunk, offset) of (keys, chunk, length): the sum of lengths before the chunk, by blocks of chunks, so
    that no task adds up all chunks of a key."""
    table = cut(lengths.withColumn("block", F.floor(F.col("chunk") / block)), "lengths")
    blocks = table.groupBy(*keys, "block").agg(F.sum("length").alias("sum"))
    before = lambda value, by, order: F.coalesce(F.sum(value).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    based = cut(blocks.select(*keys, "block", before("sum", keys, "block").alias("base")), "bases")
    inside = table.withColumn("inside", before("length", [*keys, "block"], "chunk"))
    return inside.join(based, [*keys, "block"]).select(*keys, "chunk", (F.col("base") + F.col("inside")).alias("offset"))


ORACLE = f"""
WITH clean AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
     numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS nr FROM clean),
     people AS (SELECT DISTINCT conv_id, role AS perspective FROM clean),
     pieces AS (SELECT c.conv_id, perspective, (nr - 1) // {CHUNK_TURNS} AS chunk, nr, turn, text, role = perspective AS own,
                       '{OPEN}' || CASE WHEN role = perspective THEN '{ASSISTANT}' ELSE 'user name=' || role END || '{BETWEEN}' AS head
                FROM numbered c JOIN people p ON c.conv_id IS NOT DISTINCT FROM p.conv_id),
     placed AS (SELECT *, head || text || '{CLOSE}' AS rendered,
                       sum(length(head || text || '{CLOSE}')) OVER (PARTITION BY conv_id, perspective, chunk ORDER BY nr ROWS UNBOUNDED PRECEDING)::BIGINT AS stop FROM pieces),
     done AS (SELECT conv_id, perspective, chunk, CASE WHEN bool_or(turn IS NULL) THEN NULL ELSE min(turn) END AS first_turn, count(*)::INTEGER AS n_turns,
                     string_agg(rendered, '' ORDER BY nr) AS text,
                     coalesce(string_agg((stop - length(text) - {len(CLOSE)}) || ':' || stop, ',' ORDER BY nr) FILTER (own), '') AS mask
              FROM placed GROUP BY ALL)
SELECT conv_id, perspective, chunk, first_turn, n_turns,
       coalesce(sum(length(text)) OVER (PARTITION BY conv_id, perspective ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset", text, mask
FROM done
"""
