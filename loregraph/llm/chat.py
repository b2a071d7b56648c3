"""Chat formatting: collapse of cumulative snapshots, then rendering, with DataFrame functions only.

A log often holds a conversation again and again as it grows. Rolling hashes of each conversation's turn prefixes (exclusive
ors of hashes of place, role and text, 128 bits) tell which conversations are a prefix of a longer one; an anti-join keeps
the maximal ones, of equal ones the smallest conv_id, and these are rendered. A conversation is worked on in blocks of BLOCK
turn numbers, so that a very long one is no single task; it is rendered in segments of SEGMENT turns.

Turns are in the order of turn, role, text (nulls first); repeated rows count once. Null role or text is rendered as empty,
but is not equal to an empty one. All rows with a null conv_id are one conversation. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loregraph.llm.common import saved

BLOCK, SEGMENT = 64, 64


def numbered_turns(turns: DataFrame) -> DataFrame:
    """(conv, conv_id, role, text, place, h1, h2): each turn's place from 1 and the hashes of the prefix that it ends."""
    rows = turns.select(F.col("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).distinct()
    rows = rows.withColumn("conv", F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("null"))).withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 60))))
    inside = Window.partitionBy("conv", "block").orderBy("turn", "role", "text")
    placed = saved(rows.withColumn("at", F.row_number().over(inside)))
    earlier = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("conv", "block").agg(F.count("*").alias("n")).withColumn("skip", F.coalesce(F.sum("n").over(earlier), F.lit(0))).select("conv", "block", "skip")
    hashed = placed.join(sizes, ["conv", "block"]).withColumn("place", F.col("skip") + F.col("at"))
    for k in (1, 2):
        hashed = hashed.withColumn(f"t{k}", F.xxhash64(F.lit(k), "place", F.col("role").isNull(), "role", F.col("text").isNull(), "text"))
    so_far = Window.partitionBy("conv", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    hashed = saved(hashed.select("conv", "conv_id", "role", "text", "place", "block", "at", "t1", "t2"))
    totals = hashed.groupBy("conv", "block").agg(F.bit_xor("t1").alias("x1"), F.bit_xor("t2").alias("x2"))
    before = totals.select("conv", "block", *[F.coalesce(F.bit_xor(f"x{k}").over(earlier), F.lit(0)).alias(f"b{k}") for k in (1, 2)])
    own = hashed.select("conv", "conv_id", "role", "text", "place", "block", *[F.bit_xor(f"t{k}").over(so_far).alias(f"p{k}") for k in (1, 2)])
    return own.join(before, ["conv", "block"]).select("conv", "conv_id", "role", "text", "place", *[F.col(f"p{k}").bitwiseXOR(F.col(f"b{k}")).alias(f"h{k}") for k in (1, 2)])


def maximal(numbered: DataFrame) -> DataFrame:
    """(conv, turns) of the conversations that are no prefix of another one."""
    whole = saved(numbered.groupBy("conv").agg(F.max("place").alias("turns"), F.first("conv_id").alias("conv_id")))
    prefixes = numbered.select("conv", "place", "h1", "h2").join(whole, "conv")
    full = prefixes.where("place = turns").groupBy("turns", "h1", "h2").agg(F.min(F.struct("conv_id", "conv")).alias("c")).select("turns", "h1", "h2", "c.conv")
    longer = prefixes.where("place < turns").select(F.col("place").alias("turns"), "h1", "h2").distinct()
    return full.join(longer, ["turns", "h1", "h2"], "left_anti").select("conv", "turns")


def rendered(turns: DataFrame) -> DataFrame:
    """(conv_id, segment, n_turns, text): the maximal conversations as chat text, SEGMENT turns a row, segments from 0."""
    numbered = saved(numbered_turns(turns))
    kept = numbered.join(saved(maximal(numbered)), "conv")
    line = F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("<|end|>\n"))
    rows = kept.select("conv", "conv_id", F.floor((F.col("place") - 1) / SEGMENT).alias("segment"), F.struct("place", line.alias("line")).alias("x"))
    out = rows.groupBy("conv", "segment").agg(F.first("conv_id").alias("conv_id"), F.count("*").alias("n_turns"), F.array_sort(F.collect_list("x")).alias("xs"))
    return out.select("conv_id", "segment", "n_turns", F.array_join(F.col("xs.line"), "").alias("text"))
