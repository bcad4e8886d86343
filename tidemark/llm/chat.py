"""Chat formatting by multi-party perspective rotation, in DataFrame operations only.

Every participant of a conversation gets a rendering with their own turns as the assistant's, the
others' as named users', and a loss mask over what they say themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

#: Messages that a running sum takes at once; the sums of whole blocks are added to it.
BLOCK = 256


def rotate(messages: DataFrame, speaker: str = "role", system: str = "system") -> DataFrame:
    """The segments of every rendering of every conversation.

    ``messages`` has conv_id, turn, text and a column that names the speaker; further columns are
    ignored. Speakers other than ``system`` and null are the participants. Returns one row for each
    message and each participant of its conversation: conv_id, perspective (the participant), turn,
    role (assistant, user or system), name (the speaker, of a user turn), segment (the rendered
    turn), start and end (its place in the rendering, in code points; the segments in the order of
    start are the rendering), train_start and train_end (what the loss is taken on; null except for
    the assistant's turns).

    Messages are in the order of turn, then speaker, then the text's SHA-256; nulls come first. A null
    text reads as empty; a null speaker is a user without a name. Repeated rows are repeated turns. A
    conversation of the system alone has no rendering; rows with a null conv_id are one conversation.
    A conversation's rows are never gathered: they are dealt out by ranges of that order, and places
    come from running sums over blocks of rows, over a partition's blocks, and over partitions.
    """
    said = messages.select(F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), F.col(speaker).cast("string").alias("who"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    people = said.filter(F.col("who").isNotNull() & (F.col("who") != system)).select(F.col("conv").alias("_conv"), F.col("who").alias("perspective")).distinct()
    each = said.join(people, F.col("conv").eqNullSafe(F.col("_conv"))).drop("_conv")
    role = F.when(F.col("who") == system, "system").when(F.col("who") == F.col("perspective"), "assistant").otherwise("user")
    head = F.concat(F.lit("<|im_start|>"), "role", F.coalesce(F.concat(F.lit(" name="), "name"), F.lit("")), F.lit("\n"))
    each = each.withColumn("role", role).withColumn("name", F.when(F.col("role") == "user", F.col("who"))).withColumn("head", head)
    each = each.withColumn("segment", F.concat("head", "text", F.lit("<|im_end|>\n"))).withColumn("size", F.length("segment").cast("long"))

    # Equal rows may be dealt apart, as their order doesn't matter.
    each = each.withColumn("digest", F.sha2("text", 256)).drop("text").withColumn("tie", F.monotonically_increasing_id())
    order = ["conv", "perspective", "turn", "who", "digest", "tie"]
    ranged = each.repartitionByRange(*order).sortWithinPartitions(*order)
    # Staged, as another run of the range partitioning might cut elsewhere.
    ranged = staged(ranged.withColumn("part", F.spark_partition_id()).withColumn("block", F.expr(f"(monotonically_increasing_id() & {(1 << 33) - 1}) div {BLOCK}")), "ranged")

    def earlier(*keys, by):
        return F.coalesce(F.sum("size").over(Window.partitionBy(*keys).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    whose = ["conv", "perspective"]
    blocks = ranged.groupBy(*whose, "part", "block").agg(F.sum("size").alias("size"))
    parts = blocks.groupBy(*whose, "part").agg(F.sum("size").alias("size")).select(F.col("conv").alias("_c"), F.col("perspective").alias("_p"), F.col("part").alias("_part"), earlier(*whose, by=["part"]).alias("before_part"))
    same = F.col("conv").eqNullSafe(F.col("_c")) & (F.col("perspective") == F.col("_p")) & (F.col("part") == F.col("_part"))
    base = blocks.withColumn("before_block", earlier(*whose, "part", by=["block"])).join(parts, same).select("_c", "_p", "_part", F.col("block").alias("_block"), (F.col("before_part") + F.col("before_block")).alias("base"))
    placed = ranged.withColumn("before", earlier(*whose, "part", "block", by=order[2:])).join(base, same & (F.col("block") == F.col("_block")))
    start = F.col("base") + F.col("before")
    mine = F.col("role") == "assistant"
    return placed.select(
        F.col("conv").alias("conv_id"), "perspective", "turn", "role", "name", "segment", start.alias("start"), (start + F.col("size")).alias("end"),
        F.when(mine, start + F.length("head")).alias("train_start"), F.when(mine, start + F.col("size") - 1).alias("train_end"),
    )


ORACLE = r"""
WITH people AS (SELECT DISTINCT conv_id, role AS perspective FROM conversations WHERE role <> 'system'),
each_one AS (
  SELECT m.conv_id, perspective, turn, m.role AS who, coalesce(text, '') AS text,
    CASE WHEN m.role = 'system' THEN 'system' WHEN m.role = perspective THEN 'assistant' ELSE 'user' END AS role
  FROM conversations m JOIN people p ON m.conv_id IS NOT DISTINCT FROM p.conv_id
), named AS (SELECT *, CASE WHEN role = 'user' THEN who END AS name FROM each_one),
headed AS (SELECT *, '<|im_start|>' || role || coalesce(' name=' || name, '') || chr(10) AS head FROM named),
full_text AS (SELECT *, head || text || '<|im_end|>' || chr(10) AS segment FROM headed),
placed AS (
  SELECT *, coalesce(sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, who NULLS FIRST, sha256(text) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chars FROM full_text
)
SELECT conv_id, perspective, turn, role, name, segment, CAST(chars AS BIGINT) AS "start", CAST(chars + length(segment) AS BIGINT) AS "end",
  CAST(CASE WHEN role = 'assistant' THEN chars + length(head) END AS BIGINT) AS train_start,
  CAST(CASE WHEN role = 'assistant' THEN chars + length(segment) - 1 END AS BIGINT) AS train_end
FROM placed
"""
