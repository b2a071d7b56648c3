"""Breadth-first search of many starts at once over the graph as each may see it.

A search is one start of one question. The searches of a corpus are numbered by their read points, 64 to a word, and the
frontier has one row for each node and word, with a bit for each search that has come there. An edge of the graph has the number of the
first search that may see it (its gate), so the searches that go over it are the frontier's bits from there on. What the search
keeps of its way are the edges that were gone over, with their bits: they are the pointers from a node back to its parents. Order of
discovery and steps are worked out of them for the rows that are asked for alone.

A search can be resumed: `widen` with open hubs or more hops goes over what has not been gone over at that hop, and nothing else.

Of several edges that discover a node the one from the parent found first counts, incoming before outgoing, then run order.
Edges of a node with over SPLIT edges are dealt to several tasks. An edge without a row in nodes has ends that are no hubs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loregraph.functions.tables import numbered, saved
from loregraph.operators.gate import trimmed

#: Searches of a word; edges of a node that one task goes over.
WORD, SPLIT = 64, 4096
_EDGE = ["corpus_id", "src", "relation", "dst"]
_QUESTION = ["corpus_id", "question_id"]
_SPOT = ["corpus_id", "node", "word"]
_BIT = ["corpus_id", "word", "bit"]
_RANK = "array<struct<side:int,ord:struct<pass:string,doc_id:string,tri_pos:bigint>>>"


def _bits() -> Column:
    """The numbers of the set bits."""
    return F.expr(f"filter(sequence(0, {WORD - 1}), b -> (shiftright(bits, b) & 1L) = 1L)")


def _has_bit(bits: str) -> Column:
    return F.expr(f"(shiftright({bits}, bit) & 1L) = 1L")


def score_evidence(df: DataFrame) -> DataFrame:
    """disputed: all visible evidence is; unjudged: none is judged; n_hits: the most passes of one piece."""
    return (
        df.withColumn("disputed", F.forall("evidence", lambda e: e["disputed"].eqNullSafe(F.lit(True))))
        .withColumn("unjudged", F.forall("evidence", lambda e: e["disputed"].isNull()))
        .withColumn("n_hits", F.array_max(F.transform("evidence", lambda e: e["n_passes"])))
    )


class Search:
    """starts(corpus_id, question_id, read_point, start, start_ord), nodes(corpus_id, id, is_hub), edges as `build_edges` makes
    them. Empty starts or edges find nothing."""

    def __init__(self, starts: DataFrame, nodes: DataFrame, edges: DataFrame, split: int = SPLIT):
        self.edges = edges
        own = starts.select("corpus_id", "question_id", "read_point", "start", "start_ord")
        own = numbered(own, ["corpus_id"], ["read_point", "question_id", "start_ord", "start"])
        place = F.col("pos")
        self.searches = saved(own.select("*", F.floor(place / WORD).alias("word"), (place % WORD).cast("int").alias("bit")).drop("pos"))
        self.near, self.wide = self._adjacency(nodes, split)
        self.hop = 0
        first = self.searches.groupBy("corpus_id", F.col("start").alias("node"), "word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
        #: (corpus_id, node, word, depth, bits): which searches reach a node, at its least depth or a later one.
        self.reach = saved(first.select(*_SPOT, F.lit(0).alias("depth"), "bits"))
        #: By hop: (node, word, bits) that were expanded; the edges gone over, with the node they come from.
        self.opened: list[DataFrame] = []
        self.gone: list[DataFrame] = []
        text = lambda c: self.searches["start"].alias(c)
        self.met = self.searches.where("false").select(*_QUESTION, "read_point", text("src"), text("relation"), text("dst"), "start_ord", F.lit(0).alias("hop"), "word", "bit", F.lit(0).alias("side"))
        self.counted = 0

    def _adjacency(self, nodes: DataFrame, split: int) -> tuple[DataFrame, DataFrame]:
        """(near, wide). near: each edge from both of its ends, side 0 incoming, 1 outgoing. wide: hubs, and nodes whose edges are
        dealt to shards."""
        edges = self.edges
        ends = edges.select("corpus_id", F.explode(F.array("src", "dst")).alias("node")).groupBy("corpus_id", "node").agg(F.count("*").alias("n"))
        shards = ends.where(F.col("n") > split).select("corpus_id", "node", F.ceil(F.col("n") / split).cast("int").alias("shards"))
        hubs = nodes.where("is_hub").select("corpus_id", F.col("id").alias("node"), F.lit(True).alias("is_hub")).distinct()
        wide = saved(hubs.join(shards, ["corpus_id", "node"], "full").select("corpus_id", "node", F.coalesce("is_hub", F.lit(False)).alias("is_hub"), F.coalesce("shards", F.lit(1)).alias("shards")))
        # the number of searches of a corpus that may not see what appears at a section yet
        points = self.searches.groupBy("corpus_id", F.col("read_point").cast("long").alias("at")).agg(F.count("*").alias("n")).withColumn("is_point", F.lit(1))
        seen = edges.select("corpus_id", F.col("first_revealed_index").cast("long").alias("at"), F.lit(0).cast("long").alias("n"), F.lit(0).alias("is_point")).distinct()
        before = Window.partitionBy("corpus_id").orderBy("at", "is_point").rowsBetween(Window.unboundedPreceding, 0)
        gates = points.select("corpus_id", "at", "n", "is_point").union(seen).withColumn("gate", F.sum("n").over(before)).where("is_point = 0").select("corpus_id", F.col("at").alias("_at"), "gate")
        at = F.struct(F.col("ord.pass").alias("pass"), F.col("ord.doc_id").alias("doc_id"), F.col("ord.tri_pos").cast("bigint").alias("tri_pos")).alias("ord")
        dated = edges.select(*_EDGE, at, F.col("first_revealed_index").cast("long").alias("_at")).join(gates, ["corpus_id", "_at"]).drop("_at")
        side = lambda node, other, n: dated.select(*_EDGE, F.col(node).alias("node"), F.col(other).alias("other"), F.lit(n).alias("side"), "ord", "gate")
        both = side("dst", "src", 0).union(side("src", "dst", 1)).join(wide.select("corpus_id", "node", "shards"), ["corpus_id", "node"], "left")
        shard = F.when(F.col("shards") > 1, F.pmod(F.xxhash64("src", "relation", "dst"), F.col("shards"))).otherwise(0).cast("int")
        return saved(both.withColumn("shard", shard).drop("shards")), wide

    def widen(self, hops: int, allow_hub: bool, left: DataFrame | None = None) -> None:
        """Goes on to `hops` hops, through hubs too if allowed, for all questions or those of left(corpus_id, question_id)."""
        mask = None
        if left is not None:
            own = self.searches.join(left, _QUESTION, "left_semi")
            mask = own.groupBy("corpus_id", "word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask"))
        for hop in range(1, hops + 1):
            at = lambda d: F.coalesce(F.bit_or(F.when(F.col("depth") == d, F.col("bits"))), F.lit(0))
            shallow = F.coalesce(F.bit_or(F.when((F.col("depth") >= 0) & (F.col("depth") < hop - 1), F.col("bits"))), F.lit(0))
            spots = self.reach.where(F.col("depth") < hop)
            if len(self.opened) >= hop:
                spots = spots.union(self.opened[hop - 1].select(*_SPOT, F.lit(-1), "bits"))
            now = spots.groupBy(*_SPOT).agg((at(hop - 1).bitwiseAND(F.bitwise_not(shallow)).bitwiseAND(F.bitwise_not(at(-1)))).alias("bits"))
            if mask is not None:
                now = now.join(mask, ["corpus_id", "word"]).select(*_SPOT, F.col("bits").bitwiseAND(F.col("mask")).alias("bits"))
            now = now.where("bits <> 0").join(self.wide, ["corpus_id", "node"], "left")
            if hop > 1 and not allow_hub:
                now = now.where("not coalesce(is_hub, false)")
            now = saved(now.select(*_SPOT, "bits", F.coalesce("shards", F.lit(1)).alias("shards")))
            if not now.isEmpty():
                self._expand(hop, now)
            elif len(self.opened) < hop:
                self.opened.append(now.select(*_SPOT, "bits"))
        self.hop = max(self.hop, hops)

    def _expand(self, hop: int, now: DataFrame) -> None:
        split = now.select(*_SPOT, "bits", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))
        first = F.col("gate") - WORD * F.col("word")
        seen = F.when(first <= 0, F.col("bits")).when(first < WORD, F.expr(f"bits & shiftleft(-1L, cast(gate - {WORD} * word as int))")).otherwise(0)
        gone = split.join(self.near, ["corpus_id", "node", "shard"]).withColumn("bits", seen).where("bits <> 0").drop("shard", "gate")
        gone = saved(gone.select(*_SPOT, "other", "side", "src", "relation", "dst", "ord", F.lit(hop).alias("hop"), "bits"))
        arrived = gone.select("corpus_id", F.col("other").alias("node"), "word", F.lit(-1).alias("depth"), "bits")
        is_new = F.col("depth") == -1
        fresh = F.bit_or(F.when(is_new, F.col("bits"))).bitwiseAND(F.bitwise_not(F.coalesce(F.bit_or(F.when(~is_new, F.col("bits"))), F.lit(0))))
        came = self.reach.where(F.col("depth") <= hop).union(arrived).groupBy(*_SPOT).agg(fresh.alias("bits")).where("bits <> 0")
        self.reach = self.reach.union(saved(came.select(*_SPOT, F.lit(hop).alias("depth"), "bits")))
        self.gone.append(gone)
        now = now.select(*_SPOT, "bits")
        if len(self.opened) >= hop:
            self.opened[hop - 1] = self.opened[hop - 1].union(now)
        else:
            self.opened.append(now)

    def _gone(self) -> DataFrame:
        kind = "struct<pass:string,doc_id:string,tri_pos:bigint>"
        none = self.met.select("corpus_id", F.col("src").alias("node"), "word", F.col("src").alias("other"), F.lit(0).alias("side"), "src", "relation", "dst", F.lit(None).cast(kind).alias("ord"), "hop", F.lit(0).cast("long").alias("bits")).where("false")
        return reduce(DataFrame.union, self.gone) if self.gone else none

    def found(self) -> DataFrame:
        """(corpus_id, question_id, read_point, src, relation, dst, start_ord, hop, word, bit, side): each edge once a question, by
        the first start in their order that meets it, with the hop of its first sight, and the least side from which it is met there."""
        if self.counted < len(self.gone):
            rows = reduce(DataFrame.union, self.gone[self.counted :]).select("corpus_id", "word", "hop", "side", "src", "relation", "dst", F.explode(_bits()).alias("bit"))
            who = self.searches.select(*_BIT, "question_id", "read_point", "start_ord")
            rows = rows.join(who, _BIT).select(*_QUESTION, "read_point", "src", "relation", "dst", F.struct("start_ord", "hop", "word", "bit", "side").alias("x"))
            if self.counted:
                rows = rows.union(self.met.select(*_QUESTION, "read_point", "src", "relation", "dst", F.struct("start_ord", "hop", "word", "bit", "side")))
            met = rows.groupBy(*_QUESTION, "read_point", "src", "relation", "dst").agg(F.min("x").alias("x"))
            self.met = saved(met.select(*_QUESTION, "read_point", "src", "relation", "dst", "x.*"))
            self.counted = len(self.gone)
        return self.met

    def settle(self, k: int) -> DataFrame:
        """(corpus_id, question_id) of those questions whose first k triples by `ranked` are known after one hop, if two are asked for
        with hubs closed: those that k edges are near to. From here on they have their near edges alone, without those that come
        later than k; they must not be widened, and their paths are not whole.

        An edge that a start has next to it is not near if a start before it in the order comes to it at the second hop, over a
        node of one step that is no hub."""
        met = self.found()
        enough = met.groupBy(*_QUESTION).agg(F.count("*").alias("n")).where(F.col("n") >= k).select(*_QUESTION)
        own = [*_QUESTION, "read_point"]
        later = met.join(enough, _QUESTION, "left_semi").select(*own, "src", "relation", "dst", "start_ord", F.explode(F.array("src", "dst")).alias("node"))
        before = self.searches.select(*own, F.col("start_ord").alias("_before"), "word", "bit")
        later = later.join(before, own).where("_before < start_ord").join(self.wide.where("is_hub").select("corpus_id", "node"), ["corpus_id", "node"], "left_anti")
        late = later.join(self.reach.where("depth = 1").select(*_SPOT, "bits"), _SPOT).where(_has_bit("bits")).select(*own, "src", "relation", "dst").distinct()
        near = met.join(enough, _QUESTION, "left_semi").join(saved(late), [*own, "src", "relation", "dst"], "left_anti")
        done = saved(near.groupBy(*_QUESTION).agg(F.count("*").alias("n")).where(F.col("n") >= k).select(*_QUESTION))
        self.met = saved(near.join(done, _QUESTION, "left_semi").union(met.join(done, _QUESTION, "left_anti").select(*near.columns)).select(*met.columns))
        return done

    def reached(self) -> DataFrame:
        """(corpus_id, question_id, start, target, hops, word, bit): the nodes that each start reaches, itself left out."""
        depths = [F.coalesce(F.bit_or(F.when(F.col("depth") == d, F.col("bits"))), F.lit(0)) for d in range(self.hop + 1)]
        fresh, before = [], depths[0]
        for d, own in enumerate(depths[1:], 1):
            fresh.append(F.struct(F.lit(d).alias("hops"), own.bitwiseAND(F.bitwise_not(before)).alias("bits")))
            before = before.bitwiseOR(own)
        spots = self.reach.groupBy(*_SPOT).agg(F.array(*fresh).alias("x"))
        rows = spots.select(*_SPOT, F.explode("x").alias("x")).select(*_SPOT, "x.hops", "x.bits").where("bits <> 0")
        rows = rows.select("corpus_id", "word", F.explode(_bits()).alias("bit"), F.col("node").alias("target"), "hops")
        return rows.join(self.searches.select(*_BIT, "question_id", "start"), _BIT).select(*_QUESTION, "start", "target", "hops", "word", "bit")

    def traced(self, rows: DataFrame) -> DataFrame:
        """(corpus_id, word, bit, node, depth, rank, steps) of the distinct rows(corpus_id, word, bit, node, depth): of each search's
        shortest ways to the node the one that comes first, as places in the order of discovery and as texts."""
        key = [*_BIT, "node"]
        asked = saved(rows.select(*key, "depth").distinct())
        deepest = asked.agg(F.max("depth")).first()[0] or 0
        wanted, parents = {deepest: asked}, {}
        for d in range(deepest, 0, -1):
            own = wanted[d].where(F.col("depth") == d).select(*key)
            gone = self._gone().where(F.col("hop") == d)
            back = gone.select("corpus_id", "word", F.col("other").alias("node"), F.col("node").alias("parent"), "side", "ord", "src", "relation", "dst", "bits")
            step = F.concat("src", F.lit(" -["), "relation", F.lit("]-> "), "dst").alias("step")
            met = own.join(back, ["corpus_id", "word", "node"]).where(_has_bit("bits"))
            parents[d] = saved(met.groupBy(*key, "parent").agg(F.min(F.struct("side", "ord", step)).alias("x")))
            more = parents[d].select(*_BIT, F.col("parent").alias("node"), F.lit(d - 1).alias("depth"))
            wanted[d - 1] = saved(wanted[d].where(F.col("depth") < d).union(more).distinct())
        told = wanted[0].where("depth = 0").select(*key, F.array().cast(_RANK).alias("rank"), F.array().cast("array<string>").alias("steps"))
        out = [told.withColumn("depth", F.lit(0))]
        for d in range(1, deepest + 1):
            before = told.withColumnRenamed("node", "parent")
            way = parents[d].join(before, [*_BIT, "parent"]).select(*key, F.concat("rank", F.array(F.struct("x.side", "x.ord")).cast(_RANK)).alias("rank"), F.concat("steps", F.array("x.step")).alias("steps"))
            told = way.groupBy(*key).agg(F.min(F.struct("rank", "steps")).alias("y")).select(*key, "y.rank", "y.steps")
            out.append(told.withColumn("depth", F.lit(d)))
        return reduce(DataFrame.unionByName, out).select(*key, "depth", "rank", "steps")

    def in_order(self, rows: DataFrame) -> DataFrame:
        """rows of `found` with `found`, their place in the order of discovery: the start's, then that of the way."""
        own = saved(rows.select(*_EDGE, "hop", "word", "bit").distinct())
        gone = self._gone().select(*_EDGE, "hop", "word", "node", "side", "ord", "bits")
        ends = saved(own.join(gone, [*_EDGE, "hop", "word"]).where(_has_bit("bits")).select(*_EDGE, "hop", "word", "bit", "node", "side", "ord"))
        ways = self.traced(ends.select(*_BIT, "node", (F.col("hop") - 1).alias("depth")))
        ends = ends.withColumn("depth", F.col("hop") - 1).join(ways, [*_BIT, "node", "depth"])
        rank = F.concat("rank", F.array(F.struct("side", "ord")).cast(_RANK))
        best = ends.groupBy(*_EDGE, "hop", "word", "bit").agg(F.min(rank).alias("rank"))
        return rows.join(best, [*_EDGE, "hop", "word", "bit"]).withColumn("found", F.struct("start_ord", "rank")).drop("rank")

    def told(self, rows: DataFrame) -> DataFrame:
        """rows with the evidence of their edges up to their read points, and its strength."""
        met = rows.join(self.edges.select(*_EDGE, "first_revealed_index", "evidence"), _EDGE)
        return score_evidence(met.withColumn("evidence", trimmed(F.col("evidence"), F.col("read_point"))))

    def triples(self, ordered: bool = True) -> DataFrame:
        """All that was found, with evidence; ordered: with `found`."""
        rows = self.found()
        out = self.told(self.in_order(rows) if ordered else rows)
        return out.select(*_QUESTION, "read_point", "src", "relation", "dst", "hop", "first_revealed_index", *(["found"] if ordered else []), "evidence", "disputed", "unjudged", "n_hits")

    def ranked(self, k: int) -> DataFrame:
        """The first k triples of each question, with place: near ones, then those found often, then those with much evidence,
        then in the order of discovery, which is worked out only for rows that may be among the k. Next to a start it is that of the edges."""
        run = F.struct(F.col("ord.pass").alias("pass"), F.col("ord.doc_id").alias("doc_id"), F.col("ord.tri_pos").alias("tri_pos"))
        strength = self.edges.select(*_EDGE, run.alias("_run"), F.col("evidence.global_index").alias("at"), F.col("evidence.n_passes").alias("passes"))
        n = F.size(F.filter("at", lambda g: g <= F.col("read_point")))
        rows = self.found().join(strength, _EDGE).withColumn("n_evidence", n)
        rows = rows.withColumn("n_hits", F.array_max(F.slice("passes", 1, F.col("n_evidence")))).drop("at", "passes")
        order = ["hop", F.desc("n_hits"), F.desc("n_evidence"), "start_ord"]
        by = Window.partitionBy(*_QUESTION)
        beside = F.when(F.col("hop") == 1, F.struct("side", "_run"))
        near = saved(rows.withColumn("_r", F.rank().over(by.orderBy(*order, beside))).where(F.col("_r") <= k).drop("_r", "_run", "side"))
        kept = self.in_order(near).withColumn("place", F.row_number().over(by.orderBy(*order, "found"))).where(F.col("place") <= k)
        out = self.told(kept.drop("n_hits", "n_evidence"))
        return out.select(*_QUESTION, "read_point", "src", "relation", "dst", "hop", "first_revealed_index", "found", "evidence", "disputed", "unjudged", "n_hits", "place")

    def paths(self, rows: DataFrame | None = None) -> DataFrame:
        """rows of `reached` (all, if none are given) with the steps of the way of first discovery."""
        rows = self.reached() if rows is None else rows
        ways = self.traced(rows.select(*_BIT, F.col("target").alias("node"), F.col("hops").alias("depth")))
        ways = ways.select(*_BIT, F.col("node").alias("target"), F.col("depth").alias("hops"), "steps")
        return rows.join(ways, [*_BIT, "target", "hops"]).drop("word", "bit")
