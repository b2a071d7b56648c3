import math
import re

from loregraph.operators import rank


def test_scores_are_summed_where_the_chunk_is(spark):
    """No row of a word, query and chunk is dealt out; scores are those of the formula."""
    texts = [f"the {'red ' * (n % 3)}fox {n} and the dog" for n in range(30)]
    chunks = spark.createDataFrame([("c", n, n, "x", t) for n, t in enumerate(texts)], "corpus_id string, chunk_id long, global_index long, label string, text string")
    asked = {1: "the red red fox", 2: "dog 7", 3: "nothing"}
    queries = spark.createDataFrame([("c", q, 99, t) for q, t in asked.items()], "corpus_id string, query_id long, read_point long, text string")
    out = rank.bm25_score(chunks, queries)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\([^)]*query_id", plan)
    cut = [t.split() for t in texts]
    mean = sum(map(len, cut)) / len(cut)
    idf = lambda w: math.log(1 + (len(cut) - (n := sum(w in t for t in cut)) + 0.5) / (n + 0.5))
    want = {(q, c): sum(idf(w) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / mean)) for w in words.split()) for q, words in asked.items() for c, t in enumerate(cut) if set(words.split()) & set(t)}
    got = {(r.query_id, r.chunk_id): r.score for r in out.collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)
