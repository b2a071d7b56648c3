"""Mixing sources to target weights by pivotal dependent rounding, with DataFrame functions only.

Every document of a source has the same expected number of copies, target / source size. The whole part is taken; the
fractional parts are rounded in pairs: words move at random from one document of a pair to the other until one of the two
is at a whole copy, so that the words of the source stay as they are and every expectation is kept. Pairs are formed within
chunks of a bounded number of documents; what a chunk leaves over goes to the next level of a reduction tree, until each
source has one remainder, which goes to the nearer side. Random numbers are hashes of the document, so reruns agree.

Null text and text without words have size 0 and are taken as 0 words. A null source is a source, the last. Repeated rows
share their copies evenly. With no words at all every target is 0. Columns other than doc_id, text and source are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loregraph.llm.common import free_names, saved, uniform

#: Documents of a chunk, on average; weights of the sources in order, repeating; most copies of a document.
FAN_IN, WEIGHTS, MOST = 48, (1, 2, 3), 3
#: Rows that are alike are counted out in blocks of so many.
BLOCK = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def let(value: Column, body) -> Column:
    """body(value), with value computed once in higher-order functions."""
    return F.transform(F.array(value), body).getItem(0)


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, units, weight, target) from rows (source, size).

    The total is shared by weight; a target stops at `most` times its source's size and the excess is shared again.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("units"))
    placed = saved(per.orderBy(F.asc_nulls_last("source")).withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id() - F.shiftleft(F.col("part").cast("long"), 33)))
    before = placed.groupBy("part").agg(F.count("*").alias("n")).withColumn("skip", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "skip")
    kinds = F.array(*[F.lit(w) for w in weights])
    state = placed.join(before, "part").select("source", "source_size", "units", kinds[((F.col("skip") + F.col("place")) % len(weights)).cast("int")].alias("weight"), F.lit(False).alias("full"))
    state = saved(state)
    while True:
        now = state.agg(F.sum("source_size").alias("all"), F.sum(F.when(F.col("full"), F.col("source_size") * most).otherwise(0)).alias("fixed"), F.sum(F.when(~F.col("full"), F.col("weight"))).alias("weight"), F.count(F.when(F.col("full"), 1)).alias("full")).first()
        share = F.lit(float((now["all"] or 0) - (now.fixed or 0))) * F.col("weight") / F.lit(float(now.weight or 1))
        top = F.col("source_size") * most
        nxt = saved(state.withColumn("full", F.col("full") | (share > top)))
        if nxt.where("full").count() == now.full:
            return state.withColumn("target", F.when(F.col("full"), top.cast("double")).otherwise(share)).drop("full")
        state = nxt


def _pair(state: Column, x: Column, seed: int) -> Column:
    """One step of a chunk: the document in hand meets the next one."""
    i = state["hand"]

    def step(t):
        up, i_done, j_done = t["up"], t["i_done"], t["j_done"]
        # `up`: the document in hand gains. It gains at most what it lacks and what the other has.
        gain = F.when(up, F.least(i["size"] - i["q"], x["q"])).otherwise(-F.least(i["q"], x["size"] - x["q"]))
        done = lambda d, yes: F.struct(d["doc_id"].alias("doc_id"), d["size"].alias("size"), d["times"].alias("times"), (d["whole"] + F.when(yes, 1).otherwise(0)).alias("copies"))
        none = F.array().cast("array<struct<doc_id:bigint,size:bigint,times:bigint,copies:bigint>>")
        hand = F.when(i_done & j_done, F.lit(None)).when(i_done, x.withField("q", x["q"] - gain)).otherwise(i.withField("q", i["q"] + gain))
        return F.struct(hand.alias("hand"), F.concat(state["out"], F.when(i_done, F.array(done(i, up))).otherwise(none), F.when(j_done, F.array(done(x, ~up))).otherwise(none)).alias("out"))

    room_i, room_j = i["size"] - i["q"], x["size"] - x["q"]
    a, b = F.least(room_i, x["q"]), F.least(i["q"], room_j)
    chance = uniform(i["doc_id"], i["size"], x["doc_id"], x["size"], seed=seed)
    choice = let(
        chance * (a + b) < b,
        lambda up: F.struct(up.alias("up"), F.when(up, room_i <= x["q"]).otherwise(i["q"] <= room_j).alias("i_done"), F.when(up, x["q"] <= room_i).otherwise(room_j <= i["q"]).alias("j_done")),
    )
    return F.when(i.isNull(), F.struct(x.alias("hand"), state["out"].alias("out"))).otherwise(let(choice, step))


def rounded(units: DataFrame, seed: int = 4) -> DataFrame:
    """(source, doc_id, size, times, copies) from units(source, left, doc_id, size, times, whole, q): q of `size` words
    are still open, left is at least the number of units of the source."""
    doc = "struct<doc_id:bigint,size:bigint,times:bigint,whole:bigint,q:double>"
    closed = units.where("q <= 0 or q >= size").select("source", "doc_id", "size", "times", (F.col("whole") + F.when(F.col("q") > 0, 1).otherwise(0)).alias("copies"))
    level = units.where("q > 0 and q < size")
    most = level.agg(F.max("left")).first()[0] or 1
    depth = 0
    while most > 1:
        depth, most = depth + 1, -(-most // FAN_IN)
        group = level.withColumn("left", F.ceil(F.col("left") / FAN_IN)).withColumn("chunk", F.pmod(F.xxhash64(F.lit(seed * 100 + depth), "doc_id", "size"), F.col("left")))
        row = F.struct(F.xxhash64(F.lit(seed), "doc_id", "size").alias("at"), F.struct("doc_id", "size", "times", "whole", "q").cast(doc).alias("d"))
        start = F.struct(F.lit(None).cast(doc).alias("hand"), F.array().cast("array<struct<doc_id:bigint,size:bigint,times:bigint,copies:bigint>>").alias("out"))
        folded = group.groupBy("source", "left", "chunk").agg(F.aggregate(F.array_sort(F.collect_list(row)), start, lambda s, x: _pair(s, x["d"], seed)).alias("f"))
        folded = saved(folded.select("source", "left", "f.hand", "f.out"))
        closed = closed.union(folded.select("source", F.explode("out").alias("o")).select("source", "o.doc_id", "o.size", "o.times", "o.copies"))
        level = folded.where("hand is not null").select("source", "left", "hand.*")
    return closed.union(level.select("source", "doc_id", "size", "times", F.col("whole") + F.when(F.col("q") * 2 >= F.col("size"), 1).otherwise(0)))


def mix_units(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 4) -> DataFrame:
    """(source, doc_id, size, times, copies, source_size, target): times rows are alike, copies are for all of them."""
    alike = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size"))
    alike = saved(alike)
    targets = saved(source_targets(alike, weights, most))
    units = alike.groupBy("source", "doc_id", "size").agg(F.count("*").alias("times"))
    t = targets.select(F.col("source").alias("_s"), "source_size", "units", "target")
    held = units.join(t, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size") * F.col("times")).otherwise(F.lit(0.0))
    held = held.withColumn("w", F.round(wanted, 9)).withColumn("whole", F.floor("w"))
    held = held.select("source", F.col("units").alias("left"), "doc_id", "size", "times", "whole", F.when(F.col("size") == 0, F.lit(0.0)).otherwise((F.col("w") - F.col("whole")) * F.col("size")).alias("q"))
    done = rounded(saved(held), seed)
    return done.join(t, F.col("source").eqNullSafe(F.col("_s"))).select("source", "doc_id", "size", "times", "copies", "source_size", "target")


def _own_copies(place: Column) -> Column:
    """Copies of one of `times` alike rows, by its place from 0."""
    return F.floor(F.col("copies") / F.col("times")) + F.when(place < F.col("copies") % F.col("times"), 1).otherwise(0)


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 4) -> DataFrame:
    """Per row of docs: doc_id, size, source_size, target, taken, source, copies."""
    units = mix_units(docs, weights, most, seed)
    few = units.where(F.col("times") <= BLOCK).withColumn("block", F.lit(0).cast("long"))
    many = units.where(F.col("times") > BLOCK).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / BLOCK))))
    first = F.col("block") * BLOCK
    rows = few.union(many.repartition("source", "doc_id", "size", "block")).withColumn("place", F.explode(F.sequence(first, F.least(first + BLOCK, F.col("times")) - 1)))
    rows = rows.withColumn("copies", _own_copies(F.col("place")))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 4) -> DataFrame:
    """The rows of docs that the mix takes, in all their columns, and in a last one, mix_copies, how many times each."""
    own = docs.columns
    s, d, n, times, copies, at, block, out = free_names(own, "_source", "_doc", "_size", "_times", "_copies", "_at", "_block", "mix_copies")
    k = free_names([*own, s, d, n, times, copies, at, block], *[f"_k{i}" for i in range(6)])
    (place,) = free_names([*own, s, d, n, times, copies, at, block, *k], "_place")
    units = mix_units(docs.select("doc_id", "source", "text"), weights, most, seed).where("copies > 0").select("source", "doc_id", "size", "times", "copies")
    units = saved(units.toDF(s, d, n, times, copies))
    keys = F.col("doc_id").cast("long").eqNullSafe(F.col(d)) & F.col("source").cast("string").eqNullSafe(F.col(s)) & (word_count(F.col("text").cast("string")) == F.col(n))
    once = docs.join(units.where(F.col(times) == 1), keys).select(*own, F.col(copies).alias(out))
    if units.where(F.col(times) > 1).isEmpty():
        return once
    # alike rows are dealt to blocks by a number that is written with them; a row's place is its place in its block after
    # the rows of the blocks before
    often = saved(docs.join(units.where(F.col(times) > 1), keys).withColumn(at, F.monotonically_increasing_id()))
    often = often.withColumn(block, F.pmod(F.xxhash64(at), F.ceil(F.col(times) / BLOCK)))
    sizes = often.groupBy(s, d, n, block).agg(F.count("*").alias(k[4])).toDF(*k[:5])
    before = Window.partitionBy(*k[:3]).orderBy(k[3]).rowsBetween(Window.unboundedPreceding, -1)
    skips = sizes.withColumn(k[5], F.coalesce(F.sum(k[4]).over(before), F.lit(0)))
    same = F.col(s).eqNullSafe(F.col(k[0])) & F.col(d).eqNullSafe(F.col(k[1])) & (F.col(n) == F.col(k[2])) & (F.col(block) == F.col(k[3]))
    numbered = often.withColumn(place, F.row_number().over(Window.partitionBy(s, d, n, block).orderBy(at)) - 1)
    placed = numbered.join(skips, same).withColumn(place, F.col(place) + F.col(k[5]))
    share = F.floor(F.col(copies) / F.col(times)) + F.when(F.col(place) < F.col(copies) % F.col(times), 1).otherwise(0)
    return once.union(placed.select(*own, share.alias(out)).where(F.col(out) > 0))
