import math
import re
from collections import Counter

import pytest

from loregraph.operators import evaluate, graph, rank, retrieve
from test_graph import frame, t

GRAPH = [("A", "H", 1), ("H", "B", 1), ("H", "C", 2), ("A", "D", 1), ("D", "E", 1), ("E", "F", 1), ("G", "D", 7), ("X", "Y", 1), ("H", "I", 1)]


@pytest.fixture(scope="module")
def world(spark):
    edges = graph.build_edges(graph.fold_evidence(frame(spark, *[t("p1", d, i, a, b, True if (a, b) == ("D", "E") else None) for i, (a, b, d) in enumerate(GRAPH)]))).cache()
    nodes = graph.build_nodes(edges, spark.createDataFrame([], "corpus_id string, name string, type string"))
    nodes = nodes.withColumn("is_hub", nodes.id == "H").cache()
    q = [("c", "q1", "about <A>", 5), ("c", "q2", "about <H> and <A>", 1), ("c", "q3", "nothing", 5), ("c", "q4", "<X>", 5), ("c", "q5", "<G>", 5)]
    questions = spark.createDataFrame(q, "corpus_id string, question_id string, question string, read_point int")
    surfaces = spark.createDataFrame([(f"<{x}>", x, i) for i, x in enumerate("HAXG")], "surface string, canon string, ord int")
    return nodes, edges, questions, retrieve.link_starts(questions, surfaces, nodes).cache()


def brute(start, rp, hops, hub):
    """Edges with hops, and the nodes' distances."""
    seen, dist, todo = {}, {start: 0}, [start]
    edges = [(a, b) for a, b, d in GRAPH if d <= rp]
    while todo:
        u = todo.pop(0)
        if dist[u] >= hops or (not hub and dist[u] and u == "H"):
            continue
        for a, b in edges:
            if u in (a, b):
                seen.setdefault((a, b), dist[u] + 1)
                v = b if a == u else a
                if v not in dist:
                    dist[v] = dist[u] + 1
                    todo.append(v)
    return seen, dist


def test_starts(world):
    assert {(r.question_id, r.start, r.start_ord) for r in world[3].collect()} == {("q1", "A", 1), ("q2", "H", 1), ("q2", "A", 2), ("q4", "X", 1)}


def test_starts_of_any_surface(spark):
    """Surfaces inside words, longer than the pieces, shorter ones, repeated ones and an empty one, against `in`."""
    texts = ["알료샤는 어디로 갔는가", "what links <S12> and <P123456>?", "Hannah and the Great Old House", "the Great Old Houses, the Great Old House", "", None, "a"]
    names = ["알료샤", "<S1", "<S12>", "<P123456>", "<P12345>", "anna", "the Great Old House", "the Great Old Houses", "a", ""]
    nodes = spark.createDataFrame([("c", n, 1) for n in names], "corpus_id string, id string, first_revealed_index int")
    questions = spark.createDataFrame([("c", f"q{i}", x, 5) for i, x in enumerate(texts)], "corpus_id string, question_id string, question string, read_point int")
    surfaces = spark.createDataFrame([(n, n, i) for i, n in enumerate(names)], "surface string, canon string, ord int")
    found = retrieve.link_starts(questions, surfaces, nodes)
    assert sorted((r.question_id, r.start) for r in found.collect()) == sorted((f"q{i}", n) for i, x in enumerate(texts) if x is not None for n in names if n in x)
    assert "NestedLoop" not in found._jdf.queryExecution().toString()


def test_surfaces_are_all_suppliers_and_parts(spark, tmp_path):
    from loregraph.plans import inputs

    spark.range(1, 30).selectExpr("id s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.range(1, 500).selectExpr("id p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    assert {r.canon for r in inputs.surfaces(spark, str(tmp_path)).collect()} == {f"S{i}" for i in range(1, 30)} | {f"P{i}" for i in range(1, 500)}


@pytest.mark.parametrize("hops, hub", [(1, False), (2, False), (2, True), (3, True)])
def test_expand(world, hops, hub):
    nodes, edges, _, starts = world
    triples, paths = retrieve.expand(starts, nodes, edges, hops, hub)
    got = {}
    for r in triples.collect():
        got.setdefault(r.question_id, {})[r.src, r.dst] = r.hop
    for q, order, rp in (("q1", "A", 5), ("q2", "HA", 1), ("q4", "X", 5)):
        want = {}
        for s in order:
            for e, h in brute(s, rp, hops, hub)[0].items():
                want.setdefault(e, h)
        assert got[q] == want
    reach = {(r.question_id, r.start, r.target): (r.hops, r.steps) for r in paths.collect()}
    for q, s, rp in (("q1", "A", 5), ("q2", "H", 1), ("q2", "A", 1)):
        assert {k[2]: v[0] for k, v in reach.items() if k[:2] == (q, s)} == {v: d for v, d in brute(s, rp, hops, hub)[1].items() if d}
    if hops > 1:
        assert reach["q1", "A", "E"][1] == ["A -[R]-> D", "D -[R]-> E"]


def test_retrieve(world):
    nodes, edges, questions, starts = world
    triples, paths, used = retrieve.retrieve(questions, starts, nodes, edges, max_triples=4)
    assert {r.question_id: (r.stage, r.hops, r.allow_hub) for r in used.collect()} == {"q1": (1, 2, False), "q2": (1, 2, False), "q3": (3, 3, True), "q4": (3, 3, True), "q5": (3, 3, True)}
    assert {r.question_id: r["count"] for r in triples.groupBy("question_id").count().collect()} == {"q1": 3, "q2": 4, "q4": 1}
    marks = {(r.src, r.dst): r.certainty for r in retrieve.mark_certainty(triples.where("question_id = 'q1'")).collect()}
    assert marks["D", "E"] == "hearsay" and marks["A", "D"] == "weak"
    blocks = {r.question_id: r.block for r in retrieve.evidence_block(triples, questions).collect()}
    assert blocks["q3"] == "Up to section 5 this has not been revealed yet." and blocks["q4"].startswith("[1] X -[R]-> Y <weak>")
    picked = retrieve.select_paths(paths, triples, 2).where("question_id = 'q1'").orderBy("path_place").collect()
    assert len(picked) == 2 and all(r.path_place == i + 1 for i, r in enumerate(picked))
    assert retrieve.sources(triples).where("question_id = 'q4'").first().labels == ["L1"]


def test_bm25(spark):
    texts = ["a b b c", "b c d", "", "a a a a é", "z"]
    chunks = spark.createDataFrame([("c", i, i, f"L{i % 2}", x) for i, x in enumerate(texts)], "corpus_id string, chunk_id int, global_index int, label string, text string")
    queries = spark.createDataFrame([("c", 0, 9, "B a b nix"), ("c", 1, 0, "d"), ("c", 2, -1, "a"), ("c", 3, 4, "nix")], "corpus_id string, query_id int, read_point int, text string")
    docs = [re.findall(r"\w+", x) for x in texts]
    avg, df = sum(map(len, docs)) / 5, Counter(w for d in docs for w in set(d))

    def score(q, d):
        return sum(math.log(1 + (5 - df[w] + 0.5) / (df[w] + 0.5)) * d.count(w) * 2.5 / (d.count(w) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for w in q if d.count(w))

    scores = rank.bm25_score(chunks, queries).cache()
    got = {(r.query_id, r.chunk_id): r.score for r in scores.collect()}
    for i, q in enumerate((["b", "a", "b"], ["d"], ["a"])):
        for j, d in enumerate(docs):
            assert abs(got.get((i, j), 0) - score(q, d)) < 1e-9
    top = rank.topk(scores, chunks, queries, 3)
    want = {}
    for i, (q, rp) in enumerate(((["b", "a", "b"], 9), (["d"], 0), (["a"], -1), ([], 4))):
        want[i] = sorted((j for j in range(5) if j <= rp), key=lambda j: (-round(score(q, docs[j]), 9), j))[:3]
    picked = {}
    for r in top.orderBy("place").collect():
        picked.setdefault(r.query_id, []).append(r.chunk_id)
    assert picked == {k: v for k, v in want.items() if v}
    blocks = {r.query_id: (r.block, r.labels) for r in rank.context_block(top, chunks, queries).collect()}
    assert blocks[2] == ("Up to section -1 this has not been revealed yet.", []) and blocks[1] == ("(L0) a b b c", ["L0"])


def test_bm25_top_scores_a_part_of_the_postings(spark):
    """The first six of all scores, by thresholds; of many words that all chunks have, few postings are scored."""
    import random

    r = random.Random(6)
    common, rare = [f"w{i}" for i in range(12)], [f"r{i}" for i in range(300)]
    texts = [" ".join(r.choice(common) if r.random() < 0.8 else r.choice(rare) for _ in range(r.randint(0, 60))) for _ in range(500)]
    chunks = spark.createDataFrame([("c", i, i * 7 % 500, "L", x) for i, x in enumerate(texts)], "corpus_id string, chunk_id int, global_index int, label string, text string")
    asked = [" ".join(r.sample(rare, 5) + r.sample(common, 6)) for _ in range(12)] + ["w0 w0 w1", "r1", "nix", "", None]
    queries = spark.createDataFrame([("c", i, r.choice([499, 499, 250, 20, -1]), x) for i, x in enumerate(asked)], "corpus_id string, query_id int, read_point int, text string")
    top, work = rank.bm25_top(chunks, queries)
    want = rank.topk(rank.bm25_score(chunks, queries).selectExpr("corpus_id", "query_id", "chunk_id", "round(score, 6) as score"), chunks, queries)
    key = ["query_id", "chunk_id", "score", "place"]
    assert {tuple(x) for x in top.select(*key).collect()} == {tuple(x) for x in want.select(*key).collect()}
    done = {x.query_id: (x.scored, x["all"]) for x in work.collect()}
    assert sum(a for a, _ in done.values()) < 0.5 * sum(b for _, b in done.values())
    assert rank.bm25_top(chunks.where("false"), queries)[0].collect() == []


def test_cosine(spark):
    import random

    from pyspark.sql import functions as F

    r = random.Random(1)
    rows = [(i, i % 7, [r.gauss(0, 1) for _ in range(5)]) for i in range(80)] + [(90, 0, [0.0] * 5), (91, 1, None)]
    v = spark.createDataFrame(rows, "vec_id long, global_index int, vector array<float>").repartition(3)
    q = v.where("vec_id < 6").select(F.col("vec_id").alias("query_id"), (F.col("vec_id") % 5).cast("int").alias("read_point"), "vector")
    got = {(x.query_id, x.place): (x.vec_id, x.score) for x in rank.cosine_topk(v, q, 4).collect()}
    both = q.join(v.select("vec_id", "global_index", F.col("vector").alias("w")), F.col("global_index") <= F.col("read_point"))
    exact = {}
    for x in both.select("query_id", "vec_id", F.coalesce(rank.cosine(F.col("vector"), F.col("w")), F.lit(0.0)).alias("s")).where("w is not null").collect():
        exact.setdefault(x.query_id, []).append((-x.s, x.vec_id))
    for k, s in exact.items():
        for place, (score, vec) in enumerate(sorted(s)[:4], 1):
            assert got[k, place][0] == vec and abs(got[k, place][1] + score) < 1e-6


def test_evaluation(spark):
    path = "array<struct<s:string,rel:string,o:string>>"
    q = spark.createDataFrame(
        [("a", "multihop", 2, [("Captain Karl", "R", "Ann"), ("Ann", "R", "Bob")]), ("b", "multihop", 3, [("Zed", "R", "Ann")]), ("d", "multihop", 2, [("Ann", "R", "Bob")]), ("e", "spoiler_gate", 1, []), ("f", "control_singlehop", 1, [("Ann", "R", "Karl")])],
        f"question_id string, kind string, hops int, expected_path {path}",
    ).selectExpr("*", "'?' as question", "5 as read_point", "'x' as expected_answer")
    triples = spark.createDataFrame([("a", "Ann", "Karl Berg"), ("a", "Captain Joe", "Ann Lee"), ("f", "Karl", "Ann")], "question_id string, src string, dst string")
    edges = spark.createDataFrame([("Karl", "Ann"), ("Bob", "Ann")], "src string, dst string")
    correct = spark.createDataFrame([("a", False), ("b", False), ("d", False), ("e", False), ("f", True)], "question_id string, correct boolean")
    recall = evaluate.path_recall(q, triples)
    assert {r.question_id: r.path_recall for r in recall.collect()} == {"a": 0.5, "b": 0.0, "d": 0.0, "e": None, "f": 1.0}
    layer = evaluate.failure_layer(q, triples, edges, correct)
    assert {r.question_id: r.failure_layer for r in layer.collect()} == {"a": "retrieve", "b": "index", "d": "retrieve", "e": "generate", "f": None}
    system = correct.selectExpr("question_id", "'ans' as answer", "correct", "question_id = 'e' as leaked", "'r' as reason")
    rows = evaluate.eval_rows(q, system, system, recall, layer).cache()
    got = {r.grp: (r.n, r.graph_pct, r.recall_pct) for r in evaluate.report(rows).collect()}
    assert got == {"1-hop": (1, 100.0, 100.0), "2-hop": (2, 0.0, 25.0), "3-hop": (1, 0.0, 0.0), "control": (1, 100.0, 100.0), "gate": (1, 0.0, None), "total": (5, 20.0, 37.5)}
    assert {r.system: r.ids for r in evaluate.leaks(rows).collect()} == {"graph": ["e"], "basic": ["e"]}
    layers, detail = evaluate.failures(rows)
    assert {r.failure_layer: r.ids for r in layers.collect()} == {"retrieve": ["a", "d"], "index": ["b"], "generate": ["e"]} and detail.count() == 4
