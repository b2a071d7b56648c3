"""Evaluation: recall of expected paths, the layer in which a wrong answer failed, grouped reports, leaks.

questions: question_id, kind, hops, question, read_point, expected_answer, expected_path array<struct<s, rel, o>>.
triples: question_id, src, dst. Judgements of answers are an input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loregraph.functions.text import key_tokens

GATE = "spoiler_gate"
#: Words that are too common in a corpus to match names by.
Weak = list[str] | tuple[str, ...]


def expected_steps(questions: DataFrame, weak: Weak = ()) -> DataFrame:
    """(question_id, step, s, o): key tokens of the ends of each expected step."""
    rows = questions.select("question_id", F.posexplode("expected_path").alias("step", "x"))
    return rows.select("question_id", "step", key_tokens(F.col("x.s"), weak).alias("s"), key_tokens(F.col("x.o"), weak).alias("o"))


def _pairs(rows: DataFrame, a: str, b: str, *key: str) -> DataFrame:
    """(key, t, u): each token of the one end with each of the other, both ways round. Names share a pair if and only if
    their ends share a token each, so a token that many names have joins nothing by itself."""
    one = rows.select(*key, F.explode(a).alias("t"), b).select(*key, "t", F.explode(b).alias("u"))
    return one.select(*key, F.explode(F.array(F.struct("t", "u"), F.struct(F.col("u").alias("t"), F.col("t").alias("u")))).alias("p")).select(*key, "p.t", "p.u").distinct()


def _matched(questions: DataFrame, edges: DataFrame, weak: Weak, *key: str) -> DataFrame:
    steps = expected_steps(questions, weak)
    ends = edges.select(*key, key_tokens(F.col("src"), weak).alias("a"), key_tokens(F.col("dst"), weak).alias("b")).distinct()
    asked = steps.select("question_id", "step", F.explode("s").alias("t"), "o").select("question_id", "step", "t", F.explode("o").alias("u"))
    hit = asked.join(_pairs(ends, "a", "b", *key), [*key, "t", "u"], "left_semi").select("question_id", "step").distinct()
    return steps.select("question_id", "step").join(hit.withColumn("matched", F.lit(True)), ["question_id", "step"], "left").withColumn("matched", F.coalesce("matched", F.lit(False)))


def match_steps(questions: DataFrame, triples: DataFrame, weak: Weak = ()) -> DataFrame:
    """(question_id, step, matched): whether a triple of the question joins the two ends, in either direction."""
    return _matched(questions, triples, weak, "question_id")


def match_graph(questions: DataFrame, edges: DataFrame, weak: Weak = ()) -> DataFrame:
    """The same against all edges."""
    return _matched(questions, edges, weak)


def path_recall(questions: DataFrame, triples: DataFrame, weak: Weak = ()) -> DataFrame:
    """(question_id, path_recall): matched steps of all; null without an expected path."""
    per = match_steps(questions, triples, weak).groupBy("question_id").agg(F.avg(F.col("matched").cast("double")).alias("path_recall"))
    return questions.select("question_id").join(per, "question_id", "left")


def failure_layer(questions: DataFrame, triples: DataFrame, edges: DataFrame, correct: DataFrame, weak: Weak = ()) -> DataFrame:
    """(question_id, failure_layer) by correct(question_id, correct): null if right; generate without a path; index if a
    step is in no edge; retrieve if one is in no triple; else generate."""
    full = match_graph(questions, edges, weak).groupBy("question_id").agg(F.bool_and("matched").alias("in_graph"))
    got = match_steps(questions, triples, weak).groupBy("question_id").agg(F.bool_and("matched").alias("retrieved"))
    met = questions.select("question_id").join(correct, "question_id", "left").join(full, "question_id", "left").join(got, "question_id", "left")
    layer = F.when(F.col("correct"), F.lit(None)).when(F.col("in_graph").isNull(), "generate").when(~F.col("in_graph"), "index").when(~F.col("retrieved"), "retrieve").otherwise("generate")
    return met.select("question_id", layer.alias("failure_layer"))


def eval_rows(questions: DataFrame, graph: DataFrame, basic: DataFrame, recall: DataFrame, layer: DataFrame) -> DataFrame:
    """One row a question with structs graph and basic. graph: question_id, answer, correct, leaked, reason, n_triples, hops_used,
    hub_opened, starts, trace; basic: question_id, answer, correct, leaked, reason, chapters."""
    nest = lambda df, name: df.select("question_id", F.struct(*[c for c in df.columns if c != "question_id"]).alias(name))
    out = questions.select("question_id", "kind", "hops", "question", "read_point", "expected_answer")
    for part in (nest(graph, "graph"), nest(basic, "basic"), recall, layer):
        out = out.join(part, "question_id", "left")
    return out


def report(rows: DataFrame) -> DataFrame:
    """(grp, n, graph_pct, basic_pct, recall_pct) for 1-hop, 2-hop, 3-hop, control, gate and total; empty groups have no row,
    nulls do not count."""
    groups = F.array_compact(F.array(
        F.when((F.col("kind") != GATE) & (F.col("hops") == 1), F.lit("1-hop")), F.when((F.col("kind") == "multihop") & (F.col("hops") == 2), F.lit("2-hop")),
        F.when((F.col("kind") == "multihop") & (F.col("hops") == 3), F.lit("3-hop")), F.when(F.col("kind") == "control_singlehop", F.lit("control")),
        F.when(F.col("kind") == GATE, F.lit("gate")), F.lit("total"),
    ))
    pct = lambda c: F.avg(c.cast("double")) * 100
    out = rows.withColumn("grp", F.explode(groups)).groupBy("grp")
    return out.agg(F.count("*").alias("n"), pct(F.col("graph.correct")).alias("graph_pct"), pct(F.col("basic.correct")).alias("basic_pct"), pct(F.col("path_recall")).alias("recall_pct"))


def leaks(rows: DataFrame) -> DataFrame:
    """(system, n, ids): questions whose answer leaked."""
    of = lambda s: rows.where(F.col(f"{s}.leaked")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list("question_id")).alias("ids")).select(F.lit(s).alias("system"), "n", "ids")
    return of("graph").union(of("basic"))


def failures(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(by layer with ids, details of the failed questions cut to 55, 55 and 70 characters)."""
    bad = rows.where(~F.coalesce("graph.correct", F.lit(False)))
    layers = bad.groupBy("failure_layer").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("question_id")).alias("ids"))
    cut = lambda c, n: F.substring(c, 1, n)
    return layers, bad.select("question_id", "question", cut(F.col("expected_answer"), 55).alias("expected"), cut(F.col("graph.answer"), 55).alias("answer"), cut(F.col("graph.reason"), 70).alias("reason"))
