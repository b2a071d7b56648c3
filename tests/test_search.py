"""The search by bits of searches against a plain search for each start, in its order of discovery."""

import random

import pytest

from loregraph.operators import retrieve
from loregraph.operators.search import Search

EVIDENCE = "array<struct<global_index:int,doc_id:string,label:string,quote:string,disputed:boolean,n_passes:int>>"
HUBS = {"n0", "n1"}


@pytest.fixture(scope="module")
def world(spark):
    r = random.Random(4)
    edges = {}
    for i in range(140):
        a, b = (f"n{min(int(r.expovariate(0.12)), 39)}" for _ in range(2))
        if a != b:
            edges[a, r.choice("RT"), b] = (sorted(r.sample(range(1, 20), r.randint(1, 3))), ("p1", f"d{i % 9}", i))
    rows = [("c", *e, at[0], order, [(g, "d", f"L{g}", "q", None, r.randint(1, 3)) for g in at]) for e, (at, order) in edges.items()]
    table = spark.createDataFrame(rows, f"corpus_id string, src string, relation string, dst string, first_revealed_index int, ord struct<pass:string,doc_id:string,tri_pos:bigint>, evidence {EVIDENCE}").repartition(3)
    nodes = spark.createDataFrame([("c", f"n{i}", f"n{i}" in HUBS) for i in range(40)], "corpus_id string, id string, is_hub boolean")
    points = [r.randint(0, 20) for _ in range(90)]
    starts = [("c", f"q{q}", points[q], n, k) for q in range(90) for k, n in enumerate(r.sample([f"n{i}" for i in range(40)], r.randint(1, 2)), 1)]
    return edges, table.cache(), nodes.cache(), spark.createDataFrame(starts, "corpus_id string, question_id string, read_point int, start string, start_ord int").cache(), starts


def plain(edges, start, point, hops, hubs):
    """(edge: (hop, rank)), (node: (depth, steps))."""
    near = {}
    for (a, rel, b), (at, order) in edges.items():
        if at[0] <= point:
            near.setdefault(b, []).append((0, order, a, (a, rel, b)))
            near.setdefault(a, []).append((1, order, b, (a, rel, b)))
    met, reached, front = {}, {start: (0, (), ())}, [start]
    for hop in range(1, hops + 1):
        fresh = {}
        for u in front:
            if hop > 1 and not hubs and u in HUBS:
                continue
            for side, order, v, e in near.get(u, []):
                rank = (*reached[u][1], (side, order))
                met.setdefault(e, (hop, rank))
                if met[e][0] == hop:
                    met[e] = min(met[e], (hop, rank))
                if v not in reached:
                    step = f"{e[0]} -[{e[1]}]-> {e[2]}"
                    fresh[v] = min(fresh.get(v, (hop, rank, (*reached[u][2], step))), (hop, rank, (*reached[u][2], step)))
        reached |= fresh
        front = list(fresh)
    return met, reached


def expected(edges, starts, hops, hubs):
    triples, paths = {}, {}
    for _, q, point, start, k in starts:
        met, reached = plain(edges, start, point, hops, hubs)
        for e, (hop, rank) in met.items():
            triples[q, e] = min(triples.get((q, e), (k, hop, rank)), (k, hop, rank))
        paths |= {(q, start, n): (d, list(steps)) for n, (d, _, steps) in reached.items() if d}
    return triples, paths


def order_of(found):
    return tuple((x.side, (x.ord["pass"], x.ord.doc_id, x.ord.tri_pos)) for x in found.rank)


@pytest.mark.parametrize("hops, hubs, split", [(2, False, 4096), (3, True, 3)])
def test_all_that_is_found(world, hops, hubs, split):
    edges, table, nodes, starts, rows = world
    search = Search(starts, nodes, table, split)
    search.widen(hops, hubs)
    triples, paths = expected(edges, rows, hops, hubs)
    got = {(x.question_id, (x.src, x.relation, x.dst)): (x.found.start_ord, x.hop, order_of(x.found)) for x in search.triples().collect()}
    assert got == triples and len(got) > 300
    assert {(x.question_id, x.start, x.target): (x.hops, x.steps) for x in search.paths().collect()} == paths
    assert search.searches.agg({"word": "max"}).first()[0] > 0


def test_ranked_is_the_first_of_all(world):
    edges, table, nodes, starts, _ = world
    search = retrieve.searched(starts, nodes, table)
    want = {str(x) for x in retrieve.rank_triples(search.triples(), 5).select("question_id", "src", "relation", "dst", "place", "n_hits", "found").collect()}
    assert {str(x) for x in search.ranked(5).select("question_id", "src", "relation", "dst", "place", "n_hits", "found").collect()} == want


def test_a_resumed_search_goes_over_nothing_twice(world):
    edges, table, nodes, starts, rows = world
    search = Search(starts, nodes, table)
    for hops, hubs in ((2, False), (2, True), (3, True)):
        search.widen(hops, hubs)
    anew = Search(starts, nodes, table)
    anew.widen(3, True)
    key = ["question_id", "src", "relation", "dst", "hop", "found"]
    assert {str(x) for x in search.triples().select(*key).collect()} == {str(x) for x in anew.triples().select(*key).collect()}
    assert {tuple(map(str, x)) for x in search.paths().collect()} == {tuple(map(str, x)) for x in anew.paths().collect()}
    for h, done in enumerate(search.opened, 1):
        bits = [(x.node, x.word, b) for x in done.collect() for b in range(64) if x.bits >> b & 1]
        assert len(bits) == len(set(bits)), h
    # only what a stage leaves open is gone on with
    left = starts.where("question_id = 'q1'").select("corpus_id", "question_id").distinct()
    part = Search(starts, nodes, table)
    part.widen(1, False)
    part.widen(2, True, left)
    one = {e: v for (q, e), v in expected(edges, rows, 2, True)[0].items() if q == "q1"}
    assert {(x.src, x.relation, x.dst): (x.start_ord, x.hop) for x in part.found().where("question_id = 'q1'").collect()} == {e: v[:2] for e, v in one.items()}
    assert {x.hop for x in part.found().where("question_id <> 'q1'").collect()} == {1}


def test_nothing_to_search(world):
    _, table, nodes, starts, _ = world
    for search in (Search(starts.where("false"), nodes, table), Search(starts, nodes.where("false"), table.where("false"))):
        search.widen(2, False)
        assert search.triples().collect() == [] and search.paths().collect() == [] and search.ranked(3).collect() == []


def test_questions_with_enough_near_edges_stop_there(world):
    """Their first triples are those of the whole search, also where a start comes over two steps to what is next to another."""
    edges, table, nodes, starts, rows = world
    questions = starts.select("corpus_id", "question_id").distinct()
    whole, used = retrieve.widened(questions, starts, nodes, table)
    part, used_then = retrieve.widened(questions, starts, nodes, table, first=3)
    assert {tuple(x) for x in used_then.collect()} == {tuple(x) for x in used.collect()}
    key = ["question_id", "src", "relation", "dst", "hop", "place", "n_hits", "found"]
    want = {str(x) for x in retrieve.rank_triples(whole.triples(), 3).select(*key).collect()}
    assert {str(x) for x in part.ranked(3).select(*key).collect()} == want
    seen = lambda s: sum(x.bits.bit_count() if x.bits >= 0 else (x.bits & (1 << 64) - 1).bit_count() for x in s.opened[1].collect())
    assert seen(part) < 0.5 * seen(whole)
    near, found = {}, expected(edges, rows, 2, False)[0]
    for _, q, point, start, k in rows:
        for e, (hop, _) in plain(edges, start, point, 1, False)[0].items():
            near.setdefault(q, set()).add(e)
    assert sum(found[q, e][1] == 2 for q in near if len(near[q]) >= 3 for e in near[q]) > 0
