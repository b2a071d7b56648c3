import glob
import os
import re

import pytest
from pyspark.sql import functions as F

from loregraph.operators import gate, graph
from loregraph.sources import files

TRIPLE = "corpus_id string, pass string, doc_id string, global_index int, label string, tri_pos int, subject string, relation string, object string, quote string, disputed boolean"
#: A folder with a GraphML file and extraction passes whose counts are known; tests on it are skipped without.
SHIPPED = os.environ.get("LOREGRAPH_FIXTURES", "/nowhere")


def t(pas, doc, pos, s, o, disputed=None, rel="R"):
    return ("c", pas, f"ch{doc:03d}", doc, f"L{doc}", pos, s, rel, o, f"{pas}{doc}{pos}", disputed)


def frame(spark, *rows):
    return spark.createDataFrame(rows, TRIPLE)


def test_validate(spark):
    df = frame(spark, t("p1", 1, 0, None, "B"), t("p1", 1, 1, "A", "A"), t("p1", 1, 2, "A", "B"), t("p1", 1, 3, "A", "C"), t("p1", 1, 4, "A", "D"))
    types = spark.createDataFrame([("c", "B", "Place"), ("c", "C", "Person")], "corpus_id string, name string, type string")
    kept, audit = graph.validate_triples(df, types, spark.createDataFrame([("R", "Place")], "relation string, to_type string"))
    assert {r.object for r in kept.collect()} == {"B", "D"} and kept.columns == df.columns
    assert {r.reason: r.n for r in audit.collect()} == {"generic": 1, "selfloop": 1, "type": 1, "kept": 2}


@pytest.mark.parametrize("values, want", [((None, False), False), ((None, True), True), ((True, False), True), ((None, None), None), ((False, False), False)])
def test_fold_is_three_valued(spark, values, want):
    r = graph.fold_evidence(frame(spark, *[t("p1", 1, i, "A", "B", v) for i, v in enumerate(values)])).first()
    assert r.disputed is want and r.n_passes == 2 and r.n_distinct_passes == 1 and r.quote == "p110"


def test_edges_and_nodes(spark):
    df = frame(spark, t("p2", 1, 0, "A", "B"), t("p1", 3, 0, "A", "B"), t("p1", 1, 5, "A", "B"), t("p1", 2, 0, "B", "A"), t("p1", 2, 1, "C", "A", rel="Q"))
    edges = graph.build_edges(graph.fold_evidence(df))
    e = {(r.src, r.relation, r.dst): r for r in edges.collect()}
    ab = e["A", "R", "B"]
    assert (ab.first_revealed_index, ab.n_support) == (1, 2) and [(x.global_index, x.quote) for x in ab.evidence] == [(1, "p115"), (3, "p130")]
    types = spark.createDataFrame([("c", "B", "Place")], "corpus_id string, name string, type string")
    n = {r.id: (r.type, r.first_revealed_index, r.degree, r.n_chapters) for r in graph.build_nodes(edges, types).collect()}
    assert n == {"A": ("Character", 1, 3, 2), "B": ("Place", 1, 2, 2), "C": ("Character", 2, 1, 1)}


def test_spread_and_hubs(spark):
    s = spark.createDataFrame([("c", "a", 1, "Karl  Berg came"), ("c", "b", 2, "KARL\nBERG and Karlo"), ("c", "d", 3, "old Karl-x"), ("c", "e", 4, "Berg")], "corpus_id string, doc_id string, global_index int, text string")
    nodes = spark.createDataFrame([("c", "Karl Berg", "Character"), ("c", "Berg", "Character"), ("c", "x", "Place")], "corpus_id string, id string, type string")
    groups = spark.createDataFrame([("c", "Karl Berg", "Karl"), ("c", "Karl Berg", "Berg")], "corpus_id string, canon string, variant string")
    got = graph.flag_hubs(graph.text_spread(nodes, groups, s, ["berg"]), 3)
    assert {r.id: (r.n_text_chapters, r.is_hub) for r in got.collect()} == {"Karl Berg": (3, True), "Berg": (0, False), "x": (0, False)}
    assert [r.id for r in graph.top_hubs(got).collect()] == ["Karl Berg"]


def test_gate(spark):
    edges = graph.build_edges(graph.fold_evidence(frame(spark, t("p1", 1, 0, "A", "B"), t("p1", 4, 0, "A", "B"), t("p1", 3, 1, "B", "C"))))
    nodes = graph.build_nodes(edges, spark.createDataFrame([], "corpus_id string, name string, type string"))
    points = spark.createDataFrame([("c", 0), ("c", 2), ("c", 9)], "corpus_id string, read_point int")
    got = {r.read_point: (r.nodes, r.edges, r.all_nodes, r.all_edges) for r in gate.visibility_counts(nodes, edges, points).collect()}
    assert got == {0: (0, 0, 3, 2), 2: (2, 1, 3, 2), 9: (3, 2, 3, 2)}
    assert {(r.read_point, r.nodes, r.edges) for r in gate.visibility_curve(nodes, edges).collect()} == {(1, 2, 1), (3, 3, 2)}
    _, seen = gate.visible(nodes, edges, points)
    assert {(r.read_point, r.src, len(r.evidence)) for r in gate.visible_evidence(seen).collect()} == {(2, "A", 1), (9, "A", 2), (9, "B", 1)}


def test_panel_and_titles(spark):
    a = [("c", "Karl Berg", x, i, d) for x, i, d in (("karl", 1, True), ("kalle", 2, True), ("berg", 1, True), ("karl berg jr", 1, False), ("late", 9, True))] + [("c", "Ann Lee", x, 1, True) for x in ("ann", "lee")]
    df = spark.createDataFrame(a, "corpus_id string, canon string, alias string, first_index int, display boolean")
    points = spark.createDataFrame([("c", 1), ("c", 5)], "corpus_id string, read_point int")
    got = gate.alias_panel(df, points, spark.createDataFrame([("Karl Berg", "K")], "id string, label string")).collect()
    assert [(r.read_point, r.label, r.shown, r.place) for r in got] == [(5, "K", ["Berg", "Karl", "Kalle"], 1)]
    s = spark.createDataFrame([("c", 1, 1, 1, "One"), ("c", 2, 13, 1, "End")], "corpus_id string, global_index int, book_no int, chapter_no int, chapter_title string")
    assert [r.shown for r in gate.mask_titles(s, points.where("read_point = 1")).orderBy("global_index").collect()] == ["1 1 — One", "Epilogue 1"]


@pytest.mark.skipif(not glob.glob(f"{SHIPPED}/*.graphml"), reason="no graph given")
def test_shipped_graph(spark):
    nodes, edges = (df.cache() for df in files.read_graphml(spark, glob.glob(f"{SHIPPED}/*.graphml")[0]))
    points = spark.createDataFrame([("corpus", p) for p in (1, 5, 13, 31, 45, 60, 96)], "corpus_id string, read_point int")
    got = {r.read_point: (r.nodes, r.edges) for r in gate.visibility_counts(nodes, edges, points).collect()}
    assert got == {1: (8, 13), 5: (19, 38), 13: (43, 86), 31: (81, 187), 45: (145, 293), 60: (185, 378), 96: (278, 574)}
    again = graph.build_nodes(edges, nodes.select("corpus_id", nodes.id.alias("name"), "type"))
    cols = ("id", "type", "first_revealed_index", "degree", "n_chapters")
    assert set(map(tuple, again.select(*cols).collect())) == set(map(tuple, nodes.select(*cols).collect()))
    assert sorted((r.n_text_chapters for r in nodes.where("is_hub").collect()), reverse=True) == [73, 73, 54, 52]
    assert {r.src for r in edges.where("size(evidence) <> n_support or evidence[0].global_index <> first_revealed_index").collect()} == set()


@pytest.mark.skipif(not glob.glob(f"{SHIPPED}/*/*.json"), reason="no passes given")
def test_shipped_passes(spark):
    x = files.read_extractions(spark, SHIPPED).cache()
    assert {r["pass"]: r["count"] for r in x.groupBy("pass").count().collect()} == {"extract_cache": 65, "extract_cache_p2": 63, "extract_cache_p3": 68}
    triples = files.triples_of(x)
    assert triples.count() == 1549 and files.entities_of(x).count() == 920 + 862 + 907
    folded = graph.fold_evidence(triples)
    assert folded.agg({"n_passes": "sum"}).first()[0] == 1549


def test_files(spark, tmp_path):
    edges = graph.build_edges(graph.fold_evidence(frame(spark, t("p1", 1, 0, "A", "B", True), t("p1", 4, 0, "A", "B"))))
    nodes = graph.build_nodes(edges, spark.createDataFrame([], "corpus_id string, name string, type string"))
    files.write_graph(nodes, edges, nodes.select("id"), str(tmp_path / "g"))
    back = spark.read.format("xml").option("rowTag", "edge").load(f"{tmp_path}/g/graphml/edges")
    assert [(r._source, r._target) for r in back.collect()] == [("A", "B")]
    assert spark.read.json(f"{tmp_path}/g/nodes").count() == 2
    for _ in range(2):
        files.append_runs(nodes.select("id").limit(1), str(tmp_path / "runs"))
    assert spark.read.json(str(tmp_path / "runs")).count() == 2
    files.write_eval(nodes, str(tmp_path / "eval"))
    (tmp_path / "q.json").write_text('{"items": [{"id": "q1", "kind": "multihop", "hops": 2, "question": "?", "read_point": 3, "expected_path": [["A", "R", "B"]], "evidence": [{"doc_id": "d", "global_index": 2, "label_ko": "L", "quote": "q"}]}]}')
    q = files.read_questions(spark, str(tmp_path / "q.json")).first()
    assert (q.question_id, q.expected_path[0].o, q.evidence[0].label) == ("q1", "B", "L")
    s = spark.createDataFrame([("c", "ch001", 1, 1, 1, "B", 1, "T", "1 1", 4, "text")], files.SECTION)
    files.write_sections(s, str(tmp_path / "s"))
    assert files.read_sections(spark, str(tmp_path / "s")).first().text == "text"


def test_one_document_for_other_readers(spark, tmp_path):
    """The part files, one after the other, are a document that a plain XML reader takes; awkward names come back as they were."""
    import xml.etree.ElementTree as ET

    names = ['A & B', 'say "x" <y>', "é 漢\tz", "plain"]
    edges = graph.build_edges(graph.fold_evidence(frame(spark, *[t("p1", 1 + i, i, names[i], names[(i + 1) % 4]) for i in range(4)])))
    nodes = graph.build_nodes(edges, spark.createDataFrame([], "corpus_id string, name string, type string")).withColumn("is_hub", F.lit(False))
    files.write_graphml(nodes.repartition(3), edges.repartition(3), str(tmp_path / "g"))
    text = "".join(open(p, encoding="utf-8").read() for p in sorted(glob.glob(f"{tmp_path}/g/part-*")))
    space = "{http://graphml.graphdrawing.org/xmlns}"
    root = ET.fromstring(text.encode())
    found = root.find(f"{space}graph")
    assert root.tag == f"{space}graphml" and len(root.findall(f"{space}key")) == len(files.GRAPH_KEYS)
    assert {n.get("id") for n in found.findall(f"{space}node")} == set(names)
    assert {(e.get("source"), e.get("target")) for e in found.findall(f"{space}edge")} == {(names[i], names[(i + 1) % 4]) for i in range(4)}
    back_nodes, back_edges = files.read_graphml(spark, str(tmp_path / "g"))
    assert {n.id for n in back_nodes.collect()} == set(names) and {x.evidence[0].quote for x in back_edges.collect()} == {x.evidence[0].quote for x in edges.collect()}


def test_triples_are_not_dealt_out_by_relation(spark):
    """No shuffle by the relation alone, of which there are few."""
    from loregraph.operators import names

    rows = frame(spark, t("p1", 1, 0, "A", "B"), t("p1", 4, 0, "A", "C"))
    types, spec = spark.createDataFrame([], "corpus_id string, name string, type string"), spark.createDataFrame([("R", "x")], "relation string, to_type string")
    labels = spark.createDataFrame([("R", "x")], "id string, label string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for df in (*graph.validate_triples(rows, types, spec), names.with_labels(rows.select("subject", "relation", "object"), labels, labels)):
            assert not re.search(r"hashpartitioning\(relation#\d+,", df._jdf.queryExecution().executedPlan().toString())
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_a_graph_in_many_part_files(spark, tmp_path):
    """Nodes and edges of every part file come back, whether the parts are one document or each one is well-formed, and from a
    document whose elements take several lines."""
    nodes = spark.range(500).select(F.concat(F.lit(" n & "), "id").alias("id"), F.lit("Place").alias("type"), F.col("id").cast("int").alias("degree"), (F.col("id") % 2 == 0).alias("is_hub"))
    none = F.lit(None).cast(files.EVIDENCE.replace("label_ko", "label"))
    edges = nodes.select(F.col("id").alias("src"), F.lit("R>").alias("relation"), F.col("id").alias("dst"), F.col("degree").cast("bigint").alias("n_support"), none.alias("evidence"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        files.write_graphml(nodes, edges, str(tmp_path / "one"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files.write_graph(nodes.repartition(3), edges.repartition(3), nodes.select("id"), str(tmp_path / "many"))
    assert len(glob.glob(f"{tmp_path}/one/part-*")) > 2
    for path in (f"{tmp_path}/one", f"{tmp_path}/many/graphml"):
        n, e = files.read_graphml(spark, path)
        assert sorted((x.id, x.type, x.degree, x.is_hub) for x in n.collect()) == sorted(tuple(x) for x in nodes.collect())
        assert sorted((x.src, x.relation, x.dst, x.n_support) for x in e.collect()) == sorted(tuple(x)[:4] for x in edges.collect())
    (tmp_path / "plain.graphml").write_text('''<?xml version="1.0"?>
<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="d0" for="node" attr.name="type" attr.type="string"/>
<graph edgedefault="directed"><node id="a">
  <data key="d0">Place</data></node><node id="b"/>
<edge source="a" target="b" id="R"/></graph></graphml>''')
    n, e = files.read_graphml(spark, str(tmp_path / "plain.graphml"))
    assert {(x.id, x.type) for x in n.collect()} == {("a", "Place"), ("b", None)} and [(x.src, x.dst) for x in e.collect()] == [("a", "b")]


def test_a_snapshot_reads_a_prefix(spark, tmp_path):
    """The scan of an early read point gives a small part of the rows, by the scan's own count."""
    rows = spark.range(60_000).select(F.concat(F.lit("c"), F.col("id") % 2).alias("corpus_id"), (F.col("id") * 7919 % 100).cast("int").alias("first_revealed_index"), F.col("id").alias("n"))
    gate.write_by_appearance(rows.repartition(5), str(tmp_path / "edges"))
    for corpus, point, share in ((None, 4, 0.7), ("c1", 4, 0.4), (None, 99, 1.0)):
        seen = gate.snapshot(spark, str(tmp_path / "edges"), point, corpus)
        want = rows.where(F.col("first_revealed_index") <= point)
        want = want.where(F.col("corpus_id") == corpus) if corpus else want
        assert {x.n for x in seen.collect()} == {x.n for x in want.collect()}
        plan = seen._jdf.queryExecution().executedPlan()
        scan = plan.collectLeaves().apply(0)
        assert scan.metrics().apply("numOutputRows").value() <= 60_000 * share


def test_spread_of_shared_forms(spark, monkeypatch):
    """A form that many names have is looked for once; sections with several forms of a name count once."""
    ids = [f"with{c}" for c in "abcdefgh"]
    s = spark.createDataFrame([("c", n, n, f"with some {ids[n % 8]} and {ids[n % 3]}" if n % 2 else f"{ids[n % 8]} alone") for n in range(24)], "corpus_id string, doc_id int, global_index int, text string")
    forms = spark.createDataFrame([("c", i, f) for i in ids for f in (i, "with", "alone", "none")], "corpus_id string, key string, form string")
    asked, find = [], graph.find_forms
    monkeypatch.setattr(graph, "find_forms", lambda f, *a, **b: (asked.append(f.count()), find(f, *a, **b))[1])
    got = {r.id: r.n_text_chapters for r in graph.spread_of(forms.where("form <> 'alone' or key = 'witha'"), s).collect()}
    texts = [r.text.split() for r in s.collect()]
    assert got == {i: sum(1 for t in texts if {i, "with", *(["alone"] if i == "witha" else [])} & set(t)) for i in ids}
    assert asked == [11]


def test_compressed_graph_files(spark, tmp_path):
    """A compressed graph comes back whole and takes a fraction of the disk."""
    nodes = spark.range(3000).select(F.concat(F.lit("n & "), "id").alias("id"), F.lit("Place").alias("type"))
    none = F.lit(None).cast(files.EVIDENCE.replace("label_ko", "label"))
    edges = nodes.select(F.col("id").alias("src"), F.lit("R").alias("relation"), F.col("id").alias("dst"), none.alias("evidence")).repartition(3)
    size = {}
    for how in ("none", "gzip"):
        files.write_graph(nodes, edges, nodes.select("id"), f"{tmp_path}/{how}", how)
        n, e = files.read_graphml(spark, f"{tmp_path}/{how}/graphml")
        assert n.distinct().count() == 3000 and {(x.src, x.dst) for x in e.collect()} == {(f"n & {i}", f"n & {i}") for i in range(3000)}
        size[how] = sum(os.path.getsize(p) for p in glob.glob(f"{tmp_path}/{how}/**/part-*", recursive=True))
    assert size["gzip"] < 0.2 * size["none"]
