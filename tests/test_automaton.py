"""Automata over tokens and characters against plain searches, with many small shards."""

import random
import re

from pyspark.sql import functions as F

from loregraph.functions import automaton
from loregraph.operators import graph, retrieve


def test_forms_in_texts_against_patterns(spark):
    r = random.Random(1)
    words = ["ann", "lee", "jean-luc", "d", "é", "_x", "42", "of", "the"]
    texts = ["".join(r.choice(words) + r.choice([" ", "\n\t ", ", ", "-", "", " \xa0"]) for _ in range(r.randint(0, 40))) for _ in range(120)]
    texts = [t.upper() if i % 3 == 0 else t for i, t in enumerate(texts)] + ["", None]
    forms = [(c, f"k{i % 7}", " ".join(r.choice(words) for _ in range(r.randint(1, 4)))) for i in range(60) for c in r.sample(["a", "b", None], 1)]
    forms += [("a", "k0", "-"), ("a", "k0", ""), ("a", "k1", "-d"), ("b", "k2", "d-"), ("a", "k9", forms[0][2])]
    sections = spark.createDataFrame([("ab"[i % 2], f"d{i}", i, t) for i, t in enumerate(texts)], "corpus_id string, doc_id string, global_index int, text string").repartition(3)
    asked = spark.createDataFrame(forms, "corpus_id string, key string, form string")
    want = set()
    for corpus, key, form in forms:
        if corpus and re.search(r"\w", form):
            body = r"[ \t-\r]+".join(map(re.escape, form.split(" ")))
            rule = re.compile(rf"(?s)(?:^|\W){body}(?:$|\W)")
            want |= {(corpus, key, form, f"d{i}", i) for i, t in enumerate(texts) if t and "ab"[i % 2] == corpus and rule.search(t.lower())}
    for shard in (1000, 7):
        got = graph.find_forms(asked, sections, collapsed=False, shard=shard)
        assert {tuple(x) for x in got.collect()} == want and len(want) > 50
    assert graph.find_forms(asked.where("false"), sections).collect() == []


def test_long_texts_and_many_forms_are_one_pass(spark):
    forms = spark.range(30_000).select(F.lit("a").alias("corpus_id"), "id", F.concat(F.lit("w"), "id", F.lit(" w"), F.col("id") + 1).alias("form")).withColumnRenamed("id", "key")
    text = spark.range(1).select(F.lit("a").alias("corpus_id"), F.lit("d").alias("doc_id"), F.lit(1).alias("global_index"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(200_000)), lambda i: F.concat(F.lit("w"), i % 30_000)), " ").alias("text"))
    found = graph.find_forms(forms, text)
    assert found.count() == 29_999 and found.where("key = 29999").isEmpty()


def test_surfaces_in_shards(spark, monkeypatch):
    r = random.Random(2)
    surfaces = sorted({"".join(r.choice("abé") for _ in range(r.randint(0, 4))) for _ in range(90)})
    texts = ["".join(r.choice("abéx") for _ in range(r.randint(0, 12))) for _ in range(80)] + [None]
    nodes = spark.createDataFrame([("c", f"n{i % 30}", i % 9) for i in range(30)], "corpus_id string, id string, first_revealed_index int")
    questions = spark.createDataFrame([("c", i, t, i % 11) for i, t in enumerate(texts)], "corpus_id string, question_id int, question string, read_point int")
    rows = [(s, f"n{i % 30}", i * 7 % 90) for i, s in enumerate(surfaces)] + [(None, "n1", 0), ("a", None, 0)]
    dictionary = spark.createDataFrame(rows, "surface string, canon string, ord int")
    monkeypatch.setattr(automaton, "SHARD", 13)
    got = {}
    for x in retrieve.link_starts(questions, dictionary, nodes).orderBy("start_ord").collect():
        got.setdefault(x.question_id, []).append(x.start)
    for q, t in enumerate(texts):
        best = {}
        for s, canon, place in rows:
            if t is not None and s is not None and canon and s in t and int(canon[1:]) % 9 <= q % 11:
                best[canon] = min(place, best.get(canon, place))
        assert got.get(q, []) == sorted(best, key=lambda c: (best[c], c))
