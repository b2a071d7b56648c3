"""Retrieval: questions are linked to nodes and expanded hop by hop over the graph as it is visible at their read points.

questions: corpus_id, question_id, question, read_point. A batch of questions is one job, see `search`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loregraph.functions import automaton
from loregraph.functions.tables import saved
from loregraph.operators.search import Search, score_evidence

MAX_HOPS, FALLBACK_HOPS, MAX_TRIPLES, ENOUGH = 2, 3, 40, 3


class _Surfaces:
    """An automaton over characters, and what stands behind each surface."""

    def __init__(self, rows: list[tuple[str, str, int]]):
        found: dict[str, list[tuple[str, int]]] = {}
        for surface, canon, place in rows:
            found.setdefault(surface, []).append((canon, place))
        self.everywhere = found.pop("", [])
        self.machine = automaton.of_strings(found)

    def hits(self, question: str) -> dict[str, int]:
        """canon: the least place of its surfaces that the question contains."""
        out: dict[str, int] = {}
        inside = [names for _, names in self.machine.iter(question)] if len(self.machine) else []
        for names in (self.everywhere, *inside):
            for canon, place in names:
                out[canon] = min(place, out.get(canon, place))
        return out


def _met(questions: DataFrame, surface_dict: DataFrame, shard: int | None = None) -> DataFrame:
    """(corpus_id, question_id, read_point, start, ord): the canons whose surfaces a question contains, inside longer words
    too; each question is read once for each shard of the dictionary."""
    key = ["corpus_id", "question_id", "read_point"]
    kinds = ", ".join(f"{c} {questions.schema[c].dataType.simpleString()}" for c in key)
    asked = surface_dict.where("surface is not null and canon is not null").select("surface", "canon", F.col("ord").cast("long").alias("ord"))
    hits = lambda machine, row: [(*row[:3], canon, place) for canon, place in machine.hits(row[3]).items()]
    return automaton.searched(questions.where("question is not null").select(*key, "question"), asked, _Surfaces, hits, f"{kinds}, start string, ord long", shard)


def link_starts(questions: DataFrame, surface_dict: DataFrame, nodes: DataFrame) -> DataFrame:
    """(corpus_id, question_id, read_point, start, start_ord): nodes whose surface(surface, canon, ord) is in the question and
    that are visible, each once, in the order of the dictionary."""
    per = _met(questions, surface_dict).groupBy("corpus_id", "question_id", "read_point", "start").agg(F.min("ord").alias("o"))
    seen = nodes.select("corpus_id", F.col("id").alias("start"), "first_revealed_index")
    per = per.join(seen, ["corpus_id", "start"]).where("first_revealed_index <= read_point")
    place = F.row_number().over(Window.partitionBy("corpus_id", "question_id").orderBy("o", "start"))
    return per.select("corpus_id", "question_id", "read_point", "start", place.alias("start_ord"))


def expand(starts: DataFrame, nodes: DataFrame, edges: DataFrame, max_hops: int = MAX_HOPS, allow_hub: bool = False) -> tuple[DataFrame, DataFrame]:
    """(triples, paths) by breadth-first search from each start over the visible edges, taken as undirected.

    A hub is expanded only as the start, unless allow_hub. triples: every edge at an expanded node, once a question, with
    the hop of its first sight (starts in their order), its visible evidence and strength. paths: the chain of first
    discovery from the start to each reached node.
    """
    search = searched(starts, nodes, edges, max_hops, allow_hub)
    return search.triples(), search.paths()


def searched(starts: DataFrame, nodes: DataFrame, edges: DataFrame, max_hops: int = MAX_HOPS, allow_hub: bool = False) -> Search:
    """The search that `expand` makes, for the triples and paths that are wanted of it."""
    search = Search(starts, nodes, edges)
    search.widen(max_hops, allow_hub)
    return search


def rank_triples(df: DataFrame, k: int = MAX_TRIPLES, ties: tuple[str, ...] = ("found",)) -> DataFrame:
    """The first k of each question: near ones, then those found often, then those with much evidence."""
    by = Window.partitionBy("corpus_id", "question_id").orderBy("hop", F.desc("n_hits"), F.desc(F.size("evidence")), *ties)
    return df.withColumn("place", F.row_number().over(by)).where(F.col("place") <= k)


def widened(questions: DataFrame, starts: DataFrame, nodes: DataFrame, edges: DataFrame, max_hops: int = MAX_HOPS, fallback_hops: int = FALLBACK_HOPS, enough: int = ENOUGH, first: int | None = None) -> tuple[Search, DataFrame]:
    """(search, used) by stages: as asked; with fewer than `enough` triples with hubs open; then with more hops. Each stage goes on
    from where the one before it stopped. used(corpus_id, question_id, stage, hops, allow_hub): the last stage of each question.
    first: no more is wanted of the search than `ranked(first)`, so questions whose first triples are known after one hop stop there."""
    key = ["corpus_id", "question_id"]
    search, left, used = Search(starts, nodes, edges), None, []
    stages = [(max_hops, False), (max_hops, True)] + ([(fallback_hops, True)] if fallback_hops > max_hops else [])
    rest = None
    if first is not None and max_hops == 2:
        search.widen(1, False)
        rest = saved(search.searches.select(*key).distinct().join(search.settle(max(first, enough)), key, "left_anti"))
    for n, (hops, hub) in enumerate(stages, 1):
        search.widen(hops, hub, rest if left is None else left)
        mark = lambda df: df.select(*key, F.lit(n).alias("stage"), F.lit(hops).alias("hops"), F.lit(hub).alias("allow_hub"))  # noqa: B023, E731
        if n == len(stages):
            asked = questions.select(*key).distinct()
            used.append(mark(asked.join(reduce(DataFrame.union, used).select(*key), key, "left_anti") if used else asked))
            break
        found = search.found() if left is None else search.found().join(left, key, "left_semi")
        full = saved(found.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") >= enough).select(*key))
        used.append(mark(full))
        left = saved((search.searches.select(*key).distinct() if left is None else left).join(full, key, "left_anti"))
    return search, saved(reduce(DataFrame.union, used))


def retrieve(questions: DataFrame, starts: DataFrame, nodes: DataFrame, edges: DataFrame, max_hops: int = MAX_HOPS, fallback_hops: int = FALLBACK_HOPS, max_triples: int = MAX_TRIPLES, enough: int = ENOUGH) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(triples, paths, used): the ranked triples and the paths of each question's last stage, see `widened`. Questions without a
    start find nothing at any stage."""
    search, used = widened(questions, starts, nodes, edges, max_hops, fallback_hops, enough)
    return search.ranked(max_triples), search.paths(), used


def certainty(disputed: Column, unjudged: Column, n_hits: Column) -> Column:
    return F.when(disputed, "hearsay").when(unjudged & (n_hits <= 1), "weak").otherwise("confirmed")


def mark_certainty(df: DataFrame) -> DataFrame:
    return df.withColumn("certainty", certainty(F.col("disputed"), F.col("unjudged"), F.col("n_hits")))


def evidence_block(triples: DataFrame, questions: DataFrame) -> DataFrame:
    """(corpus_id, question_id, block): numbered triples with certainty, source and quote, or that nothing is revealed yet."""
    first = F.col("evidence")[0]
    line = F.format_string('[%d] %s -[%s]-> %s <%s>\n    source: %s\n    text: "%s"', "place", "src", "relation", "dst", "certainty", F.coalesce(first["label"], F.lit("?")), F.coalesce(first["quote"], F.lit("")))
    rows = mark_certainty(triples).groupBy("corpus_id", "question_id").agg(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))).alias("x"))
    none = F.format_string("Up to section %d this has not been revealed yet.", "read_point")
    return questions.join(rows, ["corpus_id", "question_id"], "left").select("corpus_id", "question_id", F.coalesce(F.array_join(F.col("x.line"), "\n"), none).alias("block"))


def select_paths(paths: DataFrame, triples: DataFrame, k: int = 4) -> DataFrame:
    """The first k paths of each question: to nodes that come early in the ranked triples, longer ones first, one a node. paths
    may be the rows of `Search.reached`, so that steps are worked out for those that are picked."""
    spots = triples.select("corpus_id", "question_id", F.posexplode(F.array("src", "dst")).alias("end", "target"), "place")
    rank = spots.groupBy("corpus_id", "question_id", "target").agg(F.min(F.struct("place", "end")).alias("at"))
    key = ["corpus_id", "question_id"]
    met = paths.join(rank, [*key, "target"], "left").where("hops >= 1")
    late = F.col("at").isNull()
    one = Window.partitionBy(*key, "target").orderBy(late, "at", F.desc("hops"), "start")
    met = met.withColumn("_n", F.row_number().over(one)).where("_n = 1").drop("_n")
    return met.withColumn("path_place", F.row_number().over(Window.partitionBy(*key).orderBy(late, "at", F.desc("hops"), "target"))).where(F.col("path_place") <= k).drop("at")


def sources(triples: DataFrame, unparsed: int = 99) -> DataFrame:
    """(corpus_id, question_id, labels): the distinct labels of the visible evidence, by their leading number."""
    rows = triples.select("corpus_id", "question_id", F.explode("evidence.label").alias("label")).distinct()
    number = F.coalesce(F.expr("try_cast(nullif(regexp_extract(label, '(\\\\d+)', 1), '') as int)"), F.lit(unparsed))
    return rows.groupBy("corpus_id", "question_id").agg(F.array_sort(F.collect_list(F.struct(number.alias("n"), "label"))).alias("x")).select("corpus_id", "question_id", F.col("x.label").alias("labels"))


def retrieval_summary(questions: DataFrame, starts: DataFrame, triples: DataFrame, used: DataFrame, counts: DataFrame) -> DataFrame:
    """Per question: starts, hops, allow_hub, n_triples, what is visible of the graph, and trace lines.
    counts: corpus_id, read_point, nodes, edges, all_nodes, all_edges."""
    key = ["corpus_id", "question_id"]
    s = starts.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("start_ord", "start"))).alias("s")).select(*key, F.col("s.start").alias("starts"))
    n = triples.groupBy(*key).agg(F.count("*").alias("n_triples"))
    met = questions.select(*key, "read_point").join(s, key, "left").join(n, key, "left").join(used, key, "left").join(counts, ["corpus_id", "read_point"], "left")
    met = met.withColumn("starts", F.coalesce("starts", F.array().cast("array<string>"))).withColumn("n_triples", F.coalesce("n_triples", F.lit(0)))
    trace = F.array(
        F.format_string("read point %d: %d of %d nodes, %d of %d edges are visible", "read_point", "nodes", "all_nodes", "edges", "all_edges"),
        F.concat(F.lit("starts: "), F.when(F.size("starts") > 0, F.array_join("starts", ", ")).otherwise("none")),
        F.format_string("%d hops, hubs %s: %d triples", "hops", F.when(F.col("allow_hub"), "open").otherwise("closed"), "n_triples"),
    )
    return met.withColumn("trace", trace)
