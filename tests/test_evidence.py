from loregraph.operators import evidence as E

SECTION = "corpus_id string, doc_id string, global_index int, label string, text string"


def test_verify_quotes(spark):
    s = spark.createDataFrame([("c", "a", 1, "L", "He said: “Yes —\n indeed”."), ("c", "b", 2, "M", None)], SECTION)
    t = spark.createDataFrame([("c", "a", 1, 'said: "yes - indeed"'), ("c", "a", 2, "no"), ("c", "a", 3, ""), ("c", "b", 4, "x"), ("c", "z", 5, "x"), ("c", "a", 6, None)], "corpus_id string, doc_id string, tri_pos int, quote string")
    kept, dropped = E.verify_quotes(t, s)
    assert {(r.tri_pos, r.global_index, r.label) for r in kept.collect()} == {(1, 1, "L"), (3, 1, "L")}
    assert {(r.doc_id, r.dropped_unquoted) for r in dropped.collect()} == {("a", 2), ("b", 1), ("z", 1)}


def test_vocabulary_and_report(spark):
    df = spark.createDataFrame([("A",), ("B",), (None,)], "relation string")
    assert [r.relation for r in E.restrict_vocab(df, "relation", spark.createDataFrame([("A",), ("A",)], "label string")).collect()] == ["A"]
    s = spark.createDataFrame([("c", "a", 1, "L"), ("c", "b", 2, "M")], "corpus_id string, doc_id string, global_index int, label string")
    ents = spark.createDataFrame([("c", "a", 1, "n1", "T", ["x"]), ("c", "a", 0, "n0", "T", [])], "corpus_id string, doc_id string, ent_pos int, name string, type string, aliases array<string>")
    tris = spark.createDataFrame([("c", "a", 0, "s", "R", "o", "q", None)], "corpus_id string, doc_id string, tri_pos int, subject string, relation string, object string, quote string, disputed boolean")
    dropped = spark.createDataFrame([("c", "a", 3)], "corpus_id string, doc_id string, dropped_unquoted int")
    rows = E.collect_extraction(s, ents, tris, dropped, "p1")
    a, b = rows.orderBy("doc_id").collect()
    assert [e.name for e in a.entities] == ["n0", "n1"] and b.triples == [] and b.dropped_unquoted == 0
    r = E.extraction_report(rows).first()
    assert (r.n_sections, r.n_triples, r.n_entities, r.n_dropped, r.dropped_pct) == (2, 1, 2, 3, 75.0)


def test_mine_quotes(spark):
    s = spark.createDataFrame([("c", "a", 1, "L", "One two\n  THREE four five six")], SECTION)
    p = spark.createDataFrame([("c", 1, r"two.*?four"), ("c", 1, "seven"), ("c", 9, "x"), ("c", 1, "six")], "corpus_id string, global_index int, pattern string")
    got = {(r.global_index, r.pattern): r.quote for r in E.mine_quotes(p, s, before=2, after=3).collect()}
    assert got == {(1, "two.*?four"): "e two THREE four fi", (1, "seven"): None, (9, "x"): None, (1, "six"): "e six"}


def test_golden_checks(spark):
    q = spark.createDataFrame([("a", "multihop", 2, 5, [(1,), (5,)]), ("b", "spoiler_gate", 1, 5, [(6,)]), ("c", "multihop", 2, 5, [])], "question_id string, kind string, hops int, read_point int, evidence array<struct<global_index:int>>")
    assert [r.question_id for r in E.check_evidence_gate(q).collect()] == ["b"]
    assert {tuple(r) for r in E.question_profile(q).collect()} == {("kind", "multihop", 2), ("kind", "spoiler_gate", 1), ("hops", "2", 2)}


def test_many_quotes_of_a_section(spark, monkeypatch):
    """More quotes than stand beside a text at once; few, many, equal, empty and null ones; sections without text or quotes."""
    import random

    from loregraph.operators import evidence

    r = random.Random(3)
    texts = {"d1": "".join(r.choice("ab c\u2019") for _ in range(300)), "d2": "x “Y” z", "d3": None, "d4": ""}
    quotes = [("d1", "".join(r.choice("ab c'") for _ in range(r.randint(1, 6)))) for _ in range(400)] + [("d1", ""), ("d1", None), ("d2", 'X "y"'), ("d2", "q"), ("d3", "a"), ("d3", ""), ("d4", ""), ("d4", "a"), ("d9", "a"), ("d2", 'X "y"')]
    sections = spark.createDataFrame([("c", d, i, f"L{i}", t) for i, (d, t) in enumerate(texts.items())], "corpus_id string, doc_id string, global_index int, label string, text string")
    rows = spark.createDataFrame([("c", d, i, q) for i, (d, q) in enumerate(quotes)], "corpus_id string, doc_id string, tri_pos int, quote string")
    flat = lambda x: " ".join(x.split()).lower().replace("\u2019", "'").replace("“", '"').replace("”", '"')
    good = {i for i, (d, q) in enumerate(quotes) if q is not None and texts.get(d) is not None and flat(q) in flat(texts[d])}
    for most in (10_000, 30):
        monkeypatch.setattr(evidence, "QUOTES", most)
        kept, dropped = evidence.verify_quotes(rows, sections)
        got = kept.collect()
        assert {x.tri_pos for x in got} == good and len(got) == len(good) > 50
        assert all((x.global_index, x.label) == (int(x.doc_id[1]) - 1, f"L{int(x.doc_id[1]) - 1}") for x in got)
        want = {d: sum(1 for i, (e, _) in enumerate(quotes) if e == d and i not in good) for d, _ in quotes}
        assert {x.doc_id: x.dropped_unquoted for x in dropped.collect()} == want
