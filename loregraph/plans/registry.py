"""All registered queries of the library and the SQL that gives the same rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loregraph.functions import text as T
from loregraph.functions.tables import saved, shared_path, table
from loregraph.operators import evaluate, evidence, gate, graph, names, rank, retrieve, sections
from loregraph.plans import inputs as I
from loregraph.plans import texts
from loregraph.plans.catalog import QUERIES, SQL, query
from loregraph.sources import files

FLAGSHIP = "retrieve"


# ---- graph build


def kept_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.validate_triples(I.triples(spark, sf_dir), I.types(spark, sf_dir), I.rel_spec(spark))[0]


def built(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) with hubs flagged by their spread."""
    edges = saved(graph.build_edges(graph.fold_evidence(kept_triples(spark, sf_dir))))
    nodes = graph.build_nodes(edges, I.types(spark, sf_dir)).withColumn("n_text_chapters", F.col("n_chapters"))
    return saved(graph.flag_hubs(nodes, I.HUB_SECTIONS).drop("n_text_chapters")), edges


@query(f"WITH {I.TRIPLES_SQL} SELECT reason, count(*) AS n FROM judged GROUP BY 1")
def validate_triples(spark, sf_dir):
    return graph.validate_triples(I.triples(spark, sf_dir), I.types(spark, sf_dir), I.rel_spec(spark))[1]


@query(f"WITH {I.EVIDENCE_SQL} SELECT corpus_id, subject, relation, object, global_index, doc_id, quote, disputed, n_passes, n_distinct_passes FROM evidence")
def fold_evidence(spark, sf_dir):
    return graph.fold_evidence(kept_triples(spark, sf_dir)).drop("ord", "label")


@query(
    f"""WITH {I.EVIDENCE_SQL}
SELECT e.corpus_id, e.subject AS src, e.relation, e.object AS dst, min(global_index) AS first_revealed_index, count(*) AS n_support,
       string_agg(global_index || ':' || quote || ':' || n_passes, ',' ORDER BY global_index) AS evidence FROM evidence e GROUP BY 1, 2, 3, 4"""
)
def build_edges(spark, sf_dir):
    edges = graph.build_edges(graph.fold_evidence(kept_triples(spark, sf_dir)))
    line = lambda e: F.concat(e["global_index"], F.lit(":"), e["quote"], F.lit(":"), e["n_passes"])
    return edges.select("corpus_id", "src", "relation", "dst", "first_revealed_index", "n_support", F.array_join(F.transform("evidence", line), ",").alias("evidence"))


@query(f"WITH {I.EVIDENCE_SQL} SELECT * FROM nodes")
def build_nodes(spark, sf_dir):
    edges = graph.build_edges(graph.fold_evidence(kept_triples(spark, sf_dir)))
    return graph.build_nodes(edges, I.types(spark, sf_dir))


# ---- gate


@query(
    f"""WITH {I.EVIDENCE_SQL},
f AS (SELECT corpus_id, first_revealed_index AS read_point, count(*) AS n, 0 AS e FROM nodes GROUP BY 1, 2 UNION ALL SELECT corpus_id, first_revealed_index, 0, count(*) FROM edges GROUP BY 1, 2),
g AS (SELECT corpus_id, read_point, sum(n) AS n, sum(e) AS e FROM f GROUP BY 1, 2)
SELECT corpus_id, read_point, CAST(sum(n) OVER w AS BIGINT) AS nodes, CAST(sum(e) OVER w AS BIGINT) AS edges, CAST(sum(n) OVER (PARTITION BY corpus_id) AS BIGINT) AS all_nodes, CAST(sum(e) OVER (PARTITION BY corpus_id) AS BIGINT) AS all_edges
FROM g WINDOW w AS (PARTITION BY corpus_id ORDER BY read_point)"""
)
def visibility_curve(spark, sf_dir):
    nodes, edges = built(spark, sf_dir)
    return gate.visibility_curve(nodes, edges)


@query(
    f"""WITH {I.EVIDENCE_SQL}, {I.QUESTIONS_SQL}, p AS (SELECT DISTINCT corpus_id, read_point FROM questions)
SELECT corpus_id, read_point, (SELECT count(*) FROM nodes x WHERE x.corpus_id = p.corpus_id AND first_revealed_index <= read_point) AS nodes, (SELECT count(*) FROM nodes x WHERE x.corpus_id = p.corpus_id) AS all_nodes,
 (SELECT count(*) FROM edges x WHERE x.corpus_id = p.corpus_id AND first_revealed_index <= read_point) AS edges, (SELECT count(*) FROM edges x WHERE x.corpus_id = p.corpus_id) AS all_edges FROM p"""
)
def visibility_counts(spark, sf_dir):
    nodes, edges = built(spark, sf_dir)
    return gate.visibility_counts(nodes, edges, I.questions(spark, sf_dir).select("corpus_id", "read_point"))


@query(
    f"""WITH {I.EVIDENCE_SQL}
SELECT v.corpus_id, v.subject AS src, v.relation, v.object AS dst, count(*) AS n_visible, coalesce(bool_and(disputed IS NOT DISTINCT FROM true), true) AS disputed, bool_and(disputed IS NULL) AS unjudged, max(n_passes) AS n_hits
FROM evidence v WHERE global_index <= 100 GROUP BY 1, 2, 3, 4"""
)
def visible_evidence(spark, sf_dir):
    _, edges = built(spark, sf_dir)
    seen = gate.visible_evidence(edges.withColumn("read_point", F.lit(100)))
    return retrieve.score_evidence(seen).select("corpus_id", "src", "relation", "dst", F.size("evidence").cast("long").alias("n_visible"), "disputed", "unjudged", "n_hits")


@query(
    f"""WITH {I.EVIDENCE_SQL}, p(read_point) AS (VALUES (40), (60), (90))
SELECT read_point, corpus_id, 'edge' AS what, count(*) AS n, CAST(max(first_revealed_index) AS INTEGER) AS last, CAST(sum(n_support) AS BIGINT) AS weight FROM p JOIN edges ON first_revealed_index <= read_point GROUP BY 1, 2
UNION ALL SELECT read_point, corpus_id, 'node', count(*), CAST(max(first_revealed_index) AS INTEGER), CAST(sum(degree) AS BIGINT) FROM p JOIN nodes ON first_revealed_index <= read_point GROUP BY 1, 2"""
)
def snapshots(spark, sf_dir):
    """The graph as of three read points, from tables in the order of first appearance."""
    parts = []
    for df, what, weight in zip(built(spark, sf_dir), ("node", "edge"), ("degree", "n_support")):
        path = shared_path(spark)
        gate.write_by_appearance(df.select("corpus_id", "first_revealed_index", weight), path)
        for point in (40, 60, 90):
            seen = gate.snapshot(spark, path, point).groupBy("corpus_id").agg(F.count("*").alias("n"), F.max("first_revealed_index").cast("int").alias("last"), F.sum(weight).cast("long").alias("weight"))
            parts.append(seen.select(F.lit(point).alias("read_point"), "corpus_id", F.lit(what).alias("what"), "n", "last", "weight"))
    return reduce(DataFrame.union, parts)


# ---- retrieval


def _starts(spark, sf_dir, nodes):
    return saved(retrieve.link_starts(I.questions(spark, sf_dir), I.surfaces(spark, sf_dir), nodes))


_STARTS_SQL = """
starts AS (
  SELECT q.corpus_id, q.question_id, q.read_point, n.id AS start, CAST(row_number() OVER (PARTITION BY q.corpus_id, q.question_id ORDER BY left(n.id, 1) = 'P') AS INTEGER) AS start_ord
  FROM questions q JOIN nodes n ON n.corpus_id = q.corpus_id AND n.id IN (q.s1, q.s2) AND n.first_revealed_index <= q.read_point)"""

_NEAR_SQL = """
near AS (SELECT corpus_id, dst AS node, src AS other, 0 AS side, src, relation, dst, first_revealed_index, ord FROM edges
 UNION ALL SELECT corpus_id, src, dst, 1, src, relation, dst, first_revealed_index, ord FROM edges)"""


def _search_sql(name: str, starts: str, hops: int, hubs: bool) -> str:
    """{name}(the edges found, with their strength) and {name}_p (the nodes reached, with the steps to them), breadth first."""
    key = "corpus_id, question_id, read_point, start, start_ord"
    out = [f"{name}_f0 AS (SELECT {key}, start AS node, [] AS rank, []::VARCHAR[] AS steps FROM {starts})"]
    for h in range(1, hops + 1):
        hub = "" if hubs or h == 1 else f"JOIN nodes x ON x.corpus_id = f.corpus_id AND x.id = f.node AND x.n_chapters < {I.HUB_SECTIONS}"
        old = " UNION ALL ".join(f"SELECT corpus_id, question_id, start, node FROM {name}_f{j}" for j in range(h))
        out.append(
            f"""{name}_m{h} AS (SELECT f.corpus_id, f.question_id, f.read_point, f.start, f.start_ord, n.other, n.src, n.relation, n.dst, list_append(f.rank, {{'s': side, 'o': ord}}) AS rank,
  list_append(f.steps, n.src || ' -[' || n.relation || ']-> ' || n.dst) AS steps
  FROM {name}_f{h - 1} f {hub} JOIN near n ON n.corpus_id = f.corpus_id AND n.node = f.node AND n.first_revealed_index <= f.read_point),
{name}_f{h} AS (SELECT {key}, other AS node, min(rank) AS rank, arg_min(steps, rank) AS steps FROM {name}_m{h} m
  WHERE NOT EXISTS (FROM ({old}) r WHERE r.corpus_id = m.corpus_id AND r.question_id = m.question_id AND r.start = m.start AND r.node = m.other) GROUP BY {key}, other)"""
        )
    met = " UNION ALL ".join(f"SELECT corpus_id, question_id, read_point, src, relation, dst, {{'a': start_ord, 'h': {h}, 'r': rank}} AS x FROM {name}_m{h}" for h in range(1, hops + 1))
    reached = " UNION ALL ".join(f"SELECT corpus_id, question_id, start, node AS target, {h} AS hops, steps FROM {name}_f{h}" for h in range(1, hops + 1))
    out.append(f"{name}_t AS (SELECT corpus_id, question_id, read_point, src, relation, dst, min(x) AS x FROM ({met}) GROUP BY ALL)")
    out.append(
        f"""{name} AS (SELECT t.corpus_id, t.question_id, t.src, t.relation, t.dst, CAST(any_value(t.x).h AS INTEGER) AS hop, any_value(t.x) AS x, max(v.n_passes) AS n_hits, count(*) AS n_evidence,
  bool_and(v.disputed IS NOT DISTINCT FROM true) AS disputed, bool_and(v.disputed IS NULL) AS unjudged, arg_min(v.quote, v.global_index) AS quote, min(v.global_index) AS first_index, list(v.global_index) AS places
  FROM {name}_t t JOIN evidence v ON v.corpus_id = t.corpus_id AND v.subject = t.src AND v.relation = t.relation AND v.object = t.dst AND v.global_index <= t.read_point GROUP BY 1, 2, 3, 4, 5),
{name}_p AS ({reached}),
{name}_r AS (SELECT *, row_number() OVER (PARTITION BY corpus_id, question_id ORDER BY hop, n_hits DESC, n_evidence DESC, x.a, x.r) AS place,
  CASE WHEN disputed THEN 'hearsay' WHEN unjudged AND n_hits <= 1 THEN 'weak' ELSE 'confirmed' END AS certainty FROM {name} QUALIFY place <= 40)"""
    )
    return ",\n".join(out)


def _left_sql(name: str, starts: str, found: str) -> str:
    return f"{name} AS (SELECT * FROM {starts} s WHERE (SELECT count(*) FROM {found}_r t WHERE t.corpus_id = s.corpus_id AND t.question_id = s.question_id) < 3)"


_EXPAND_SQL = f"WITH {I.EVIDENCE_SQL}, {I.QUESTIONS_SQL}, {_STARTS_SQL}, {_NEAR_SQL}, {_search_sql('x', 'starts', 2, False)}"

#: What `retrieve` returns: k, its triples, and used, the stage of each question.
_RETRIEVE_SQL = f"""{_EXPAND_SQL}, {_left_sql("s2", "starts", "x")}, {_search_sql("y", "s2", 2, True)}, {_left_sql("s3", "s2", "y")}, {_search_sql("z", "s3", 3, True)},
k AS (SELECT r.* FROM x_r r WHERE NOT EXISTS (FROM s2 WHERE s2.corpus_id = r.corpus_id AND s2.question_id = r.question_id)
 UNION ALL SELECT r.* FROM y_r r WHERE NOT EXISTS (FROM s3 WHERE s3.corpus_id = r.corpus_id AND s3.question_id = r.question_id) UNION ALL FROM z_r),
used AS (SELECT corpus_id, question_id, CASE WHEN question_id IN (SELECT question_id FROM s3) OR question_id NOT IN (SELECT question_id FROM starts) THEN 3 WHEN question_id IN (SELECT question_id FROM s2) THEN 2 ELSE 1 END AS stage FROM questions)"""


@query(f"WITH {I.EVIDENCE_SQL}, {I.QUESTIONS_SQL}, {_STARTS_SQL} SELECT * FROM starts")
def link_starts(spark, sf_dir):
    nodes, _ = built(spark, sf_dir)
    return retrieve.link_starts(I.questions(spark, sf_dir), I.surfaces(spark, sf_dir), nodes)


@query(_EXPAND_SQL + " SELECT corpus_id, question_id, src, relation, dst, hop, n_hits, n_evidence, disputed, unjudged FROM x")
def expand(spark, sf_dir):
    nodes, edges = built(spark, sf_dir)
    triples = retrieve.searched(_starts(spark, sf_dir, nodes), nodes, edges).triples(ordered=False)
    return triples.select("corpus_id", "question_id", "src", "relation", "dst", "hop", "n_hits", F.size("evidence").cast("long").alias("n_evidence"), "disputed", "unjudged")


@query(_EXPAND_SQL + " SELECT corpus_id, question_id, src, relation, dst, CAST(place AS INTEGER) AS place, certainty FROM x_r")
def rank_triples(spark, sf_dir):
    nodes, edges = built(spark, sf_dir)
    triples = retrieve.searched(_starts(spark, sf_dir, nodes), nodes, edges).ranked(retrieve.MAX_TRIPLES)
    return retrieve.mark_certainty(triples).select("corpus_id", "question_id", "src", "relation", "dst", "place", "certainty")


@query(
    f"""{_EXPAND_SQL},
e AS (SELECT corpus_id, question_id, target, min({{'p': place, 'e': e}}) AS pl FROM (SELECT *, src AS target, 0 AS e FROM x_r UNION ALL SELECT *, dst, 1 FROM x_r) GROUP BY 1, 2, 3),
m AS (SELECT p.*, e.pl FROM x_p p LEFT JOIN e USING (corpus_id, question_id, target)),
o AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY corpus_id, question_id, target ORDER BY pl IS NULL, pl, hops DESC, start) = 1)
SELECT corpus_id, question_id, target, CAST(hops AS INTEGER) AS hops, array_to_string(steps, ' | ') AS steps, CAST(row_number() OVER w AS INTEGER) AS path_place FROM o
WINDOW w AS (PARTITION BY corpus_id, question_id ORDER BY pl IS NULL, pl, hops DESC, target) QUALIFY path_place <= 4"""
)
def expand_paths(spark, sf_dir):
    nodes, edges = built(spark, sf_dir)
    search = retrieve.searched(_starts(spark, sf_dir, nodes), nodes, edges)
    picked = saved(retrieve.select_paths(search.reached(), search.ranked(retrieve.MAX_TRIPLES)))
    return search.paths(picked).select("corpus_id", "question_id", "target", "hops", F.array_join("steps", " | ").alias("steps"), "path_place")


def _retrieved(spark, sf_dir):
    nodes, edges = built(spark, sf_dir)
    starts = _starts(spark, sf_dir, nodes)
    search, used = retrieve.widened(I.questions(spark, sf_dir), starts, nodes, edges, first=retrieve.MAX_TRIPLES)
    return nodes, edges, starts, saved(search.ranked(retrieve.MAX_TRIPLES)), used


#: Blocks of evidence; the starts, stages and traces of questions; the labels of their evidence.
_TOLD_SQL = """
b AS (SELECT corpus_id, question_id, string_agg('[' || place || '] ' || src || ' -[' || relation || ']-> ' || dst || ' <' || certainty || '>' || chr(10) || '    source: L' || first_index || chr(10) || '    text: "' || quote || '"', chr(10) ORDER BY place) AS block FROM k GROUP BY 1, 2),
blocks AS (SELECT q.corpus_id, q.question_id, coalesce(b.block, 'Up to section ' || q.read_point || ' this has not been revealed yet.') AS block FROM questions q LEFT JOIN b USING (corpus_id, question_id)),
n AS (SELECT corpus_id, question_id, count(*) AS n FROM k GROUP BY 1, 2), s AS (SELECT corpus_id, question_id, list(start ORDER BY start_ord) AS s FROM starts GROUP BY 1, 2),
m AS (SELECT q.corpus_id, q.question_id, q.read_point, coalesce(s.s, []) AS s, coalesce(n.n, 0) AS n, CASE u.stage WHEN 3 THEN 3 ELSE 2 END AS hops, u.stage > 1 AS allow_hub FROM questions q JOIN used u USING (corpus_id, question_id) LEFT JOIN n USING (corpus_id, question_id) LEFT JOIN s USING (corpus_id, question_id)),
summary AS (SELECT corpus_id, question_id, array_to_string(s, ',') AS starts, CAST(hops AS INTEGER) AS hops, allow_hub, CAST(n AS BIGINT) AS n_triples,
 'read point ' || read_point || ': ' || (SELECT count(*) FROM nodes x WHERE x.corpus_id = m.corpus_id AND first_revealed_index <= read_point) || ' of ' || (SELECT count(*) FROM nodes x WHERE x.corpus_id = m.corpus_id) || ' nodes, '
 || (SELECT count(*) FROM edges x WHERE x.corpus_id = m.corpus_id AND first_revealed_index <= read_point) || ' of ' || (SELECT count(*) FROM edges x WHERE x.corpus_id = m.corpus_id) || ' edges are visible | starts: '
 || CASE WHEN len(s) > 0 THEN array_to_string(s, ', ') ELSE 'none' END || ' | ' || hops || ' hops, hubs ' || CASE WHEN allow_hub THEN 'open' ELSE 'closed' END || ': ' || n || ' triples' AS trace FROM m),
spots AS (SELECT DISTINCT corpus_id, question_id, unnest(places) AS g FROM k),
sources AS (SELECT corpus_id, question_id, string_agg('L' || g, ',' ORDER BY g) AS labels FROM spots GROUP BY 1, 2)"""


@query(f"{_RETRIEVE_SQL}, {_TOLD_SQL} SELECT * FROM blocks")
def retrieve_(spark, sf_dir):
    _, _, _, triples, _ = _retrieved(spark, sf_dir)
    return retrieve.evidence_block(triples, I.questions(spark, sf_dir))


def _summary(spark, sf_dir, nodes, edges, starts, triples, used) -> DataFrame:
    asked = I.questions(spark, sf_dir)
    return retrieve.retrieval_summary(asked, starts, triples, used, gate.visibility_counts(nodes, edges, asked.select("corpus_id", "read_point")))


@query(f"{_RETRIEVE_SQL}, {_TOLD_SQL} SELECT * FROM summary")
def retrieval_summary(spark, sf_dir):
    out = _summary(spark, sf_dir, *_retrieved(spark, sf_dir))
    return out.select("corpus_id", "question_id", F.array_join("starts", ",").alias("starts"), "hops", "allow_hub", "n_triples", F.array_join("trace", " | ").alias("trace"))


@query(f"{_RETRIEVE_SQL}, {_TOLD_SQL} SELECT * FROM sources")
def retrieval_sources(spark, sf_dir):
    _, _, _, triples, _ = _retrieved(spark, sf_dir)
    return retrieve.sources(triples).select("corpus_id", "question_id", F.array_join("labels", ",").alias("labels"))


# ---- sections, chunks, quotes

_FLAT = r"regexp_replace(text, '\s+', ' ', 'g')"


@query(
    f"""WITH d AS (SELECT doc_id, trim({_FLAT}) AS t FROM documents), c AS (SELECT doc_id, t, unnest(CASE WHEN length(t) <= 3000 THEN [0] ELSE range(0, length(t), 2500) END) AS start FROM d)
SELECT doc_id, CAST(start // 2500 AS INTEGER) AS chunk_no, CAST(start AS INTEGER) AS start, md5(substr(t, start + 1, 3000)) AS text_md5 FROM c"""
)
def chunk_overlap(spark, sf_dir):
    out = sections.chunk_overlap(table(spark, sf_dir, "documents").select("doc_id", "text"), 3000, 500)
    return out.select("doc_id", "chunk_no", "start", F.md5("text").alias("text_md5"))


@query(
    f"""WITH d AS (SELECT doc_id, {_FLAT} AS t FROM documents), c AS (SELECT doc_id, t, unnest(range(0, length(t), 2000)) AS start FROM d)
SELECT doc_id, CAST(start // 2000 AS INTEGER) AS chunk_no, CAST(start AS INTEGER) AS start, md5(substr(t, start + 1, 2000)) AS text_md5 FROM c WHERE length(substr(t, start + 1, 2000)) >= 200"""
)
def chunk_fixed(spark, sf_dir):
    out = sections.chunk_fixed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "chunk_no", "start", F.md5("text").alias("text_md5"))


@query(
    """WITH t AS (SELECT 'log' || conv_id % 5 AS corpus_id, conv_id AS book_no, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS due, length(text) AS n FROM conversations),
c AS (SELECT corpus_id, count(*) AS n, sum(n) AS chars FROM t GROUP BY 1)
SELECT DISTINCT corpus_id, 'chapters out of order' AS what, 'book ' || book_no AS "where" FROM t WHERE turn + 1 <> due UNION ALL SELECT corpus_id, 'short section', book_no || '-' || turn FROM t WHERE n < 500
UNION ALL SELECT corpus_id, 'number of sections', CAST(n AS VARCHAR) FROM c WHERE n <> 100 UNION ALL SELECT corpus_id, 'summary', n || ' sections, ' || chars || ' characters' FROM c"""
)
def check_sections(spark, sf_dir):
    """Conversations as books of five corpora: what is wrong with them, where, and their totals."""
    c = table(spark, sf_dir, "conversations")
    rows = c.select(F.concat(F.lit("log"), F.col("conv_id") % 5).alias("corpus_id"), F.concat_ws("-", "conv_id", "turn").alias("doc_id"), F.col("turn").alias("global_index"), F.col("conv_id").alias("book_no"), (F.col("turn") + 1).alias("chapter_no"), F.length("text").alias("n_chars"))
    wrong, totals = sections.check_sections(rows, expected=100)
    return wrong.union(totals.select("corpus_id", F.lit("summary"), F.concat("n_sections", F.lit(" sections, "), "n_chars", F.lit(" characters"))))


@query("SELECT doc_id FROM documents WHERE doc_id % 3 <> 0")
def todo_sections(spark, sf_dir):
    s = table(spark, sf_dir, "documents").select(F.col("source").alias("corpus_id"), "doc_id")
    done = s.where("doc_id % 3 = 0").withColumn("pass", F.lit("extract_cache"))
    return sections.todo_sections(s, done, "extract_cache").select("doc_id")


def quotes(spark, sf_dir) -> DataFrame:
    """A quote from the middle of each document, every third one put to the document after it."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.lit("all").alias("corpus_id"), F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") + 1).otherwise(F.col("doc_id")).alias("doc_id"), F.col("doc_id").alias("tri_pos"), F.expr("substring(text, cast(greatest(floor(length(text) / 2) - 30, 0) as int) + 1, 60)").alias("quote"))


_NORM_QUOTE = lambda c: f"translate(lower(trim(regexp_replace({c}, '\\s+', ' ', 'g'))), '“”‘’—–', '\"\"''''--')"


@query(
    f"""WITH q AS (SELECT CASE WHEN doc_id % 3 = 0 THEN doc_id + 1 ELSE doc_id END AS doc_id, doc_id AS tri_pos, substr(text, CAST(greatest(length(text) // 2 - 30, 0) AS INT) + 1, 60) AS quote FROM documents)
SELECT q.tri_pos, q.doc_id, 2 * d.doc_id AS global_index, 'L' || d.doc_id AS label FROM q JOIN documents d ON d.doc_id = q.doc_id WHERE contains({_NORM_QUOTE("d.text")}, {_NORM_QUOTE("q.quote")})"""
)
def verify_quotes(spark, sf_dir):
    return evidence.verify_quotes(quotes(spark, sf_dir), _stamped(spark, sf_dir))[0].select("tri_pos", "doc_id", "global_index", "label")


def _stamped(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.lit("all").alias("corpus_id"), "doc_id", (2 * F.col("doc_id")).alias("global_index"), F.concat(F.lit("L"), "doc_id").alias("label"), "text")


@query(
    f"""WITH q AS (SELECT CASE WHEN doc_id % 3 = 0 THEN doc_id + 1 ELSE doc_id END AS doc_id, doc_id AS tri_pos, substr(text, CAST(greatest(length(text) // 2 - 30, 0) AS INT) + 1, 60) AS quote FROM documents),
k AS (SELECT q.*, contains({_NORM_QUOTE("d.text")}, {_NORM_QUOTE("q.quote")}) AS ok FROM q JOIN documents d ON d.doc_id = q.doc_id),
t AS (SELECT doc_id, string_agg('T' || tri_pos || '-' || tri_pos % 3 || '-' || md5(quote) || '-' || CASE tri_pos % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'false' ELSE 'null' END, ',' ORDER BY tri_pos) FILTER (ok) AS triples, count(*) FILTER (NOT ok) AS x FROM k GROUP BY 1),
e AS (SELECT doc_id, regexp_extract_all(text, '\\p{{Lu}}\\p{{L}}+')[:1 + doc_id % 4] AS w FROM documents)
SELECT 'p1' AS pass, e.doc_id, 2 * e.doc_id AS global_index, 'L' || e.doc_id AS label, array_to_string(list_transform(w, lambda n: n || ':Character:' || lower(n)), ',') AS entities, coalesce(triples, '') AS triples, CAST(coalesce(x, 0) AS INTEGER) AS dropped_unquoted FROM e LEFT JOIN t USING (doc_id)"""
)
def collect_extraction(spark, sf_dir):
    """A section's entities, triples and drops in one row: names from its text, triples by its quotes."""
    s = _stamped(spark, sf_dir)
    kept, gone = evidence.verify_quotes(quotes(spark, sf_dir), s)
    judged = F.when(F.col("tri_pos") % 3 == 0, True).when(F.col("tri_pos") % 3 == 1, False)
    tri = kept.select("corpus_id", "doc_id", "tri_pos", F.concat(F.lit("T"), "tri_pos").alias("subject"), (F.col("tri_pos") % 3).cast("string").alias("relation"), F.md5("quote").alias("object"), "quote", judged.alias("disputed"))
    found = F.slice(F.regexp_extract_all("text", F.lit(r"\p{Lu}\p{L}+"), F.lit(0)), F.lit(1), (1 + F.col("doc_id") % 4).cast("int"))
    ents = s.select("corpus_id", "doc_id", F.posexplode(found).alias("ent_pos", "name")).select("corpus_id", "doc_id", "ent_pos", "name", F.lit("Character").alias("type"), F.array(F.lower("name")).alias("aliases"))
    out = evidence.collect_extraction(s.drop("text"), ents, tri, gone, "p1")
    entity = lambda e: F.concat_ws(":", e["name"], e["type"], F.array_join(e["aliases"], ";"))
    triple = lambda t: F.concat_ws("-", t["subject"], t["relation"], t["object"], F.coalesce(t["disputed"].cast("string"), F.lit("null")))
    return out.select("pass", "doc_id", "global_index", "label", F.array_join(F.transform("entities", entity), ",").alias("entities"), F.array_join(F.transform("triples", triple), ",").alias("triples"), "dropped_unquoted")


@query(
    f"""WITH q AS (SELECT CASE WHEN doc_id % 3 = 0 THEN doc_id + 1 ELSE doc_id END AS doc_id, doc_id AS tri_pos, substr(text, CAST(greatest(length(text) // 2 - 30, 0) AS INT) + 1, 60) AS quote FROM documents),
k AS (SELECT q.*, coalesce(contains({_NORM_QUOTE("d.text")}, {_NORM_QUOTE("q.quote")}), false) AS ok FROM q LEFT JOIN documents d ON d.doc_id = q.doc_id),
s AS (SELECT d.doc_id, count(k.doc_id) FILTER (ok) AS t, count(k.doc_id) FILTER (NOT ok) AS x FROM documents d LEFT JOIN k USING (doc_id) GROUP BY 1)
SELECT 'p1' AS pass, count(*) AS n_sections, CAST(sum(t) AS BIGINT) AS n_triples, 0::BIGINT AS n_entities, CAST(sum(x) AS BIGINT) AS n_dropped, round(sum(x) * 100.0 / greatest(1, sum(t) + sum(x)), 6) AS dropped_pct FROM s"""
)
def extraction_report(spark, sf_dir):
    s = table(spark, sf_dir, "documents").select(F.lit("all").alias("corpus_id"), "doc_id", F.col("doc_id").alias("global_index"), F.lit("x").alias("label"), "text")
    kept, dropped = evidence.verify_quotes(quotes(spark, sf_dir), s)
    tri = kept.select("corpus_id", "doc_id", "tri_pos", F.lit("a").alias("subject"), F.lit("R").alias("relation"), F.lit("b").alias("object"), "quote", F.lit(None).cast("boolean").alias("disputed"))
    none = spark.createDataFrame([], "corpus_id string, doc_id bigint, ent_pos int, name string, type string, aliases array<string>")
    rows = evidence.collect_extraction(s.drop("text"), none, tri, dropped, "p1")
    out = evidence.extraction_report(rows)
    return out.withColumn("n_entities", F.col("n_entities").cast("long")).withColumn("n_triples", F.col("n_triples").cast("long")).withColumn("n_dropped", F.col("n_dropped").cast("long")).withColumn("dropped_pct", F.round("dropped_pct", 6))


@query(
    f"""WITH d AS (SELECT doc_id, {_FLAT} AS t, regexp_extract({_FLAT}, '^ ?[^ ]+ ([\\p{{L}}]{{2,}})', 1) AS w FROM documents),
m AS (SELECT doc_id, t, w, strpos(lower(t), lower(w)) AS pos FROM d WHERE w <> '')
SELECT doc_id, regexp_replace(substr(t, greatest(pos - 1 - 10, 0) + 1, least(length(t), pos - 1 + length(w) + 170) - greatest(pos - 1 - 10, 0)), '^\\s+|\\s+$', '', 'g') AS quote FROM m"""
)
def mine_quotes(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.lit("all").alias("corpus_id"), F.col("doc_id").alias("global_index"), "doc_id", F.lit("x").alias("label"), "text")
    word = F.regexp_extract(T.collapse(F.col("text")), r"^ ?[^ ]+ ([\p{L}]{2,})", 1)
    rules = d.select("corpus_id", "global_index", F.concat(F.lit("(?u)"), word).alias("pattern")).where(F.length("pattern") > 4)
    return evidence.mine_quotes(rules, d, before=10).select("doc_id", "quote")


# ---- names


@query(
    """WITH n AS (SELECT doc_id, regexp_replace(text, '[\\x00-\\x1f\\x7f]', ' ', 'g') AS c FROM documents)
SELECT doc_id, md5(trim(regexp_replace(c, '\\s+', ' ', 'g'))) AS clean,
 md5(lower(trim(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(c, '\\s+', ' ', 'g')), '^(?i:the|a|an)\\s+', ''), '[^\\p{L}\\p{N}_\\sÀ-ɏ-]', ' ', 'g'), '\\s+', ' ', 'g')))) AS norm,
 regexp_matches(c, '\\p{Lu}') AS has_upper FROM n"""
)
def normalised_names(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("name"))
    return d.select("doc_id", F.md5(T.clean(F.col("name"))).alias("clean"), F.md5(T.norm(F.col("name"))).alias("norm"), T.has_upper(F.col("name")).alias("has_upper"))


@query(
    """WITH e AS (SELECT p_name AS name, p_type AS type, p_partkey AS ord FROM part),
v AS (SELECT name, type, count(*) AS n, min(ord) AS first FROM e GROUP BY 1, 2)
SELECT 'all' AS corpus_id, name, arg_min(type, (-n, first)) AS type FROM v GROUP BY 2"""
)
def vote_types(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return names.vote_types(p.select(F.lit("all").alias("corpus_id"), F.lit("p1").alias("pass"), F.lit("x").alias("doc_id"), F.col("p_partkey").alias("ent_pos"), F.col("p_name").alias("name"), F.col("p_type").alias("type")))


def rule_tables(spark, sf_dir) -> names.Dicts:
    """Rule tables from part: brands are canons of names, some colours are stop words or surnames."""
    p = table(spark, sf_dir, "part")
    groups = p.select(F.initcap("p_name").alias("canon"), F.concat("p_name", F.lit(" "), "p_brand").alias("variant"), F.col("p_partkey").alias("ord")).where("ord % 4 = 0")
    word = lambda n: F.split("p_name", " ")[n]
    return names.Dicts(
        names.alias_dict(groups),
        p.where("p_partkey % 50 = 1").select(F.lower("p_name").alias("name")).distinct(),
        p.where("p_partkey % 50 = 2").select(F.lower("p_name").alias("name"), F.upper("p_name").alias("canon")).distinct(),
        p.where("p_partkey % 60 = 3").groupBy(word(1).alias("token")).agg(F.min_by(F.initcap("p_name"), "p_partkey").alias("canon"), F.min("p_partkey").alias("ord")),
        p.where("p_partkey % 60 = 5").select(word(0).alias("token")).distinct(),
    )


_RULES_SQL = """
g AS (SELECT array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS canon, p_name || ' ' || p_brand AS variant, p_partkey AS ord FROM part WHERE p_partkey % 4 = 0),
k AS (SELECT lower(canon) AS key, canon, ord, 0 AS b FROM g UNION ALL SELECT lower(replace(variant, '#', ' ')), canon, ord, 1 FROM g),
a AS (SELECT key, arg_max(canon, (ord, b)) AS canon FROM k GROUP BY 1),
stop AS (SELECT DISTINCT lower(p_name) AS name FROM part WHERE p_partkey % 50 = 1),
place AS (SELECT DISTINCT lower(p_name) AS name, upper(p_name) AS canon FROM part WHERE p_partkey % 50 = 2),
sur AS (SELECT split_part(p_name, ' ', 2) AS token, arg_min(array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' '), p_partkey) AS canon, min(p_partkey) AS ord FROM part WHERE p_partkey % 60 = 3 GROUP BY 1),
shared AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS token FROM part WHERE p_partkey % 60 = 5)"""


@query(f"WITH {_RULES_SQL} SELECT key, canon FROM a")
def alias_dict(spark, sf_dir):
    return rule_tables(spark, sf_dir).aliases


@query(
    f"""WITH {_RULES_SQL},
n AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN 'The ' || p_name ELSE p_name || ' ' || p_brand END AS name FROM part),
m AS (SELECT p_partkey, name, lower(trim(regexp_replace(regexp_replace(name, '^The ', ''), '#', ' '))) AS norm FROM n),
s AS (SELECT m.p_partkey, arg_min(sur.canon, sur.ord) AS canon FROM m JOIN sur ON list_contains(string_split(m.norm, ' '), sur.token) WHERE NOT EXISTS (SELECT 1 FROM shared WHERE list_contains(string_split(m.norm, ' '), shared.token)) GROUP BY 1)
SELECT m.p_partkey, CASE WHEN m.norm IN (FROM stop) OR lower(m.name) IN (FROM stop) THEN NULL WHEN place.canon IS NOT NULL THEN place.canon WHEN a.canon IS NOT NULL THEN a.canon WHEN s.canon IS NOT NULL THEN s.canon
 WHEN regexp_matches(m.name, '\\p{{Lu}}') THEN m.name END AS resolved
FROM m LEFT JOIN place ON place.name = m.norm LEFT JOIN a ON a.key = m.norm LEFT JOIN s ON s.p_partkey = m.p_partkey"""
)
def resolve_names(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    name = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("The "), "p_name")).otherwise(F.concat("p_name", F.lit(" "), "p_brand"))
    return names.resolve(p.select("p_partkey", name.alias("name")), "name", rule_tables(spark, sf_dir)).select("p_partkey", "resolved")


#: Candidates for aliases from part, judged: none of them is a name that comes later, so that no alias resolves another.
_LEARNED_SQL = f"""WITH {_RULES_SQL},
mentions AS (SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS name, lower(p_name) AS norm, p_type, split_part(p_name, ' ', 1) AS head FROM part),
sn AS (SELECT m.p_partkey, arg_min(sur.canon, sur.ord) AS canon FROM mentions m JOIN sur ON list_contains(string_split(m.norm, ' '), sur.token) WHERE NOT EXISTS (SELECT 1 FROM shared WHERE list_contains(string_split(m.norm, ' '), shared.token)) GROUP BY 1),
r AS (SELECT m.*, CASE WHEN m.norm IN (FROM stop) THEN NULL WHEN place.canon IS NOT NULL THEN place.canon WHEN a.canon IS NOT NULL THEN a.canon WHEN sn.canon IS NOT NULL THEN sn.canon ELSE m.name END AS canon
  FROM mentions m LEFT JOIN place ON place.name = m.norm LEFT JOIN a ON a.key = m.norm LEFT JOIN sn ON sn.p_partkey = m.p_partkey),
al AS (SELECT p_partkey, canon, unnest([lower(norm || ' ' || p_type), lower(p_type), lower(head) || ' esq']) AS key, unnest([0, 1, 2]) AS pos FROM r WHERE canon IS NOT NULL),
sh AS (SELECT list(token) AS l FROM shared),
j AS (SELECT al.*, (p_partkey, pos) AS ord, CASE WHEN len(list_filter(string_split(key, ' '), lambda w: NOT list_contains(sh.l, w))) = 0 THEN 'surname only'
  WHEN NOT list_has_any(string_split(key, ' '), list_filter(string_split(lower(canon), ' '), lambda w: length(w) > 2)) THEN 'no overlap' END AS reason
  FROM al, sh WHERE key NOT IN (SELECT key FROM a) AND key NOT IN (FROM stop)),
accepted AS (SELECT key, arg_min(canon, ord) AS canon, min(ord) AS ord FROM j WHERE reason IS NULL GROUP BY 1),
rejected AS (SELECT j.* FROM j LEFT JOIN accepted x USING (key) WHERE reason IS NOT NULL AND (x.ord IS NULL OR j.ord < x.ord))"""


def _mentions(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part")
    name = F.initcap("p_name")
    others = F.array(F.concat(name, F.lit(" "), F.initcap("p_type")), F.initcap("p_type"), F.concat(F.initcap(F.split("p_name", " ")[0]), F.lit(" Esq")))
    return p.select(F.lit("all").alias("corpus_id"), F.lit("p1").alias("pass"), F.lit("x").alias("doc_id"), F.col("p_partkey").alias("ent_pos"), name.alias("name"), others.alias("aliases"))


@query(f"{_LEARNED_SQL} SELECT key, canon FROM accepted")
def learn_aliases(spark, sf_dir):
    return names.learn_aliases(_mentions(spark, sf_dir), rule_tables(spark, sf_dir))[0].select("key", "canon")


@query(f"{_LEARNED_SQL} SELECT key AS alias, canon, reason FROM rejected")
def rejected_aliases(spark, sf_dir):
    return names.learn_aliases(_mentions(spark, sf_dir), rule_tables(spark, sf_dir))[1].select(T.norm(F.col("alias")).alias("alias"), "canon", "reason")


@query(
    f"""{_LEARNED_SQL}, {I.EVIDENCE_SQL},
x AS (SELECT 'triples raw' AS measure, count(*) AS value FROM judged UNION ALL SELECT 'triples ' || reason, count(*) FROM judged GROUP BY 1
 UNION ALL SELECT 'sections', count(DISTINCT corpus_id || doc_id) FROM judged UNION ALL SELECT 'passes', count(DISTINCT pass) FROM judged UNION ALL SELECT 'sections x passes', count(DISTINCT corpus_id || doc_id || pass) FROM judged
 UNION ALL SELECT 'aliases accepted', count(*) FROM accepted UNION ALL SELECT 'aliases rejected', count(*) FROM rejected
 UNION ALL SELECT 'nodes', count(*) FROM nodes UNION ALL SELECT 'edges', count(*) FROM edges UNION ALL SELECT 'nodes ' || type, count(*) FROM nodes GROUP BY 1)
SELECT measure, CAST(value AS BIGINT) AS value FROM x"""
)
def build_report(spark, sf_dir):
    kept, audit = graph.validate_triples(I.triples(spark, sf_dir), I.types(spark, sf_dir), I.rel_spec(spark))
    edges = saved(graph.build_edges(graph.fold_evidence(kept)))
    nodes = graph.build_nodes(edges, I.types(spark, sf_dir))
    accepted, rejected = names.learn_aliases(_mentions(spark, sf_dir), rule_tables(spark, sf_dir))
    return graph.build_report(audit, rejected, accepted, nodes, edges, I.triples(spark, sf_dir))


@query(
    f"""WITH {I.SECTIONS_SQL}, {texts.FORMS_SQL},
t AS (SELECT DISTINCT corpus_id, doc_id, global_index, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS form FROM sections)
SELECT corpus_id, form, min(global_index) AS first_index, count(DISTINCT doc_id) AS n_text_chapters FROM t JOIN forms USING (form) GROUP BY 1, 2"""
)
def text_search(spark, sf_dir):
    found = graph.find_forms(texts.forms(spark, sf_dir), I.sections(spark, sf_dir))
    return found.groupBy("corpus_id", "form").agg(F.min("global_index").alias("first_index"), F.count_distinct("doc_id").alias("n_text_chapters"))


# ---- control retriever


def _bm25_inputs(spark, sf_dir):
    """Documents as chunks, benchmark items as queries, each with a read point somewhere among the documents."""
    d = I.sections(spark, sf_dir)
    chunks = saved(d.select(F.lit("all").alias("corpus_id"), F.col("number").alias("chunk_id"), F.col("number").alias("global_index"), "label", "text"))
    top = chunks.agg(F.max("chunk_id").alias("top"))
    q = table(spark, sf_dir, "benchmark").join(top).select(F.lit("all").alias("corpus_id"), F.col("item_id").alias("query_id"), ((F.col("item_id") * 7919) % (F.col("top") + 1)).alias("read_point"), "text")
    return chunks, saved(q)


_BM25_SQL = """
c AS (SELECT doc_id AS chunk_id, regexp_extract_all(lower(text), '[a-z0-9À-ɏ가-힣]+') AS t FROM documents),
n AS (SELECT count(*) AS n, avg(len(t)) AS avg_len FROM c),
q AS (SELECT item_id AS query_id, (item_id * 7919) % ((SELECT max(doc_id) FROM documents) + 1) AS read_point, unnest(regexp_extract_all(lower(text), '[a-z0-9À-ɏ가-힣]+')) AS term FROM benchmark),
a AS (SELECT query_id, term, count(*) AS times FROM q GROUP BY 1, 2),
p AS (SELECT chunk_id, len(t) AS n_tokens, unnest(t) AS term FROM c),
tf AS (SELECT chunk_id, n_tokens, term, count(*) AS tf FROM p WHERE term IN (SELECT term FROM a) GROUP BY ALL),
df AS (SELECT term, ln(1 + (any_value(n.n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, n GROUP BY 1),
s AS (SELECT query_id, chunk_id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n_tokens / avg_len))) AS score FROM tf JOIN df USING (term) JOIN a USING (term), n GROUP BY 1, 2),
v AS (SELECT DISTINCT q.query_id, d.doc_id AS chunk_id, coalesce(round(s.score, 6), 0) AS score FROM (SELECT DISTINCT query_id, read_point FROM q) q JOIN documents d ON d.doc_id <= q.read_point LEFT JOIN s ON s.query_id = q.query_id AND s.chunk_id = d.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS place FROM v)"""


@query(f"WITH {_BM25_SQL} SELECT query_id, chunk_id, round(score, 6) AS score FROM s")
def bm25_score(spark, sf_dir):
    chunks, q = _bm25_inputs(spark, sf_dir)
    return rank.bm25_score(chunks, q).select("query_id", "chunk_id", F.round("score", 6).alias("score"))


@query(f"WITH {_BM25_SQL} SELECT query_id, chunk_id, CAST(place AS INTEGER) AS place FROM r WHERE place <= 6")
def bm25_topk(spark, sf_dir):
    chunks, q = _bm25_inputs(spark, sf_dir)
    return rank.bm25_top(chunks, q)[0].select("query_id", "chunk_id", "place")


@query(
    f"""WITH {I.SECTIONS_SQL}, {_BM25_SQL},
l AS (SELECT r.query_id, r.place, '1 ' || x.global_index AS label, x.text FROM r JOIN sections x ON x.number = r.chunk_id WHERE place <= 6),
b AS (SELECT query_id, string_agg('(' || label || ') ' || text, chr(10) || chr(10) ORDER BY place) AS block FROM l GROUP BY 1),
k AS (SELECT query_id, string_agg(label, ',' ORDER BY label COLLATE "C") AS labels FROM (SELECT DISTINCT query_id, label FROM l) GROUP BY 1)
SELECT i.item_id AS query_id, md5(coalesce(b.block, 'Up to section ' || ((i.item_id * 7919) % ((SELECT max(doc_id) FROM documents) + 1)) || ' this has not been revealed yet.')) AS block_md5, coalesce(k.labels, '') AS labels
FROM benchmark i LEFT JOIN b ON b.query_id = i.item_id LEFT JOIN k ON k.query_id = i.item_id"""
)
def bm25_context(spark, sf_dir):
    chunks, q = _bm25_inputs(spark, sf_dir)
    top = rank.bm25_top(chunks, q)[0]
    return rank.context_block(top, chunks, q).select("query_id", F.md5("block").alias("block_md5"), F.array_join("labels", ",").alias("labels"))


@query(
    """WITH q AS (SELECT vec_id AS query_id, vec_id + 200 AS read_point, embedding AS q FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT query_id, vec_id, list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]) AS score FROM q JOIN embeddings ON vec_id <= read_point),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM s) SELECT query_id, vec_id, round(score, 6) AS score, CAST(place AS INTEGER) AS place FROM r WHERE place <= 6"""
)
def cosine_topk(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), (F.col("vec_id") + 200).alias("read_point"), F.col("embedding").alias("vector"))
    return rank.cosine_topk(e.select("vec_id", F.col("vec_id").alias("global_index"), F.col("embedding").alias("vector")), q).select("query_id", "vec_id", F.round("score", 6).alias("score"), "place")


# ---- evaluation


def _golden(spark, sf_dir) -> DataFrame:
    """The questions with paths to expect: two steps from the supplier, every fourth one without a path."""
    q = I.questions(spark, sf_dir)
    step = lambda s, o: F.struct(s.alias("s"), F.lit("R").alias("rel"), o.alias("o"))
    sup, part, other = F.concat(F.lit("S"), "number"), F.concat(F.lit("P"), "part"), F.concat(F.lit("S"), F.col("number") - 1)
    kind = texts.kind_of("number")
    path = F.when(kind == evaluate.GATE, F.array().cast("array<struct<s:string,rel:string,o:string>>")).otherwise(F.array(step(sup, part), step(part, other)))
    return q.select("question_id", kind.alias("kind"), (1 + F.col("number") % 3).cast("int").alias("hops"), "question", "read_point", F.concat(F.lit("what the reader of section "), "read_point", F.lit(" may know of "), sup, F.lit(" and "), part, F.lit(" by then")).alias("expected_answer"), path.alias("expected_path"), "number")


#: golden; its steps; whether a step is among the triples of a table (named found) and in the graph.
_GOLDEN_SQL = f"""
golden AS (SELECT question_id, {texts.KIND} AS kind, 1 + number % 3 AS hops, number, sup, par, 'S' || (number - 1) AS s3, question, read_point, corpus_id,
  'what the reader of section ' || read_point || ' may know of ' || sup || ' and ' || par || ' by then' AS expected_answer, 'judged by the labels of documents whose number ends in ' || (number % 10) || ', for the question ' || question AS reason FROM questions),
steps AS (SELECT question_id, 0 AS step, lower(sup) AS s, lower(par) AS o FROM golden WHERE kind <> 'spoiler_gate' UNION ALL SELECT question_id, 1, lower(par), lower(s3) FROM golden WHERE kind <> 'spoiler_gate'),
tails AS (SELECT DISTINCT question_id, lower(src) AS a, lower(dst) AS b FROM found),
got AS (SELECT p.question_id, p.step, length(p.s) > 2 AND length(p.o) > 2 AND EXISTS (FROM tails e WHERE e.question_id = p.question_id AND (e.a = p.s AND e.b = p.o OR e.a = p.o AND e.b = p.s)) AS ok FROM steps p),
recall AS (SELECT question_id, avg(ok::INT) AS path_recall, bool_and(ok) AS retrieved FROM got GROUP BY 1)"""


@query(f"{_EXPAND_SQL}, found AS (SELECT question_id, src, dst FROM x), {_GOLDEN_SQL} SELECT g.question_id, round(path_recall, 6) AS path_recall FROM golden g LEFT JOIN recall USING (question_id)")
def path_recall(spark, sf_dir):
    nodes, edges = built(spark, sf_dir)
    triples = retrieve.searched(_starts(spark, sf_dir, nodes), nodes, edges).found()
    return evaluate.path_recall(_golden(spark, sf_dir), triples).withColumn("path_recall", F.round("path_recall", 6))


_ROWS_SQL = f"""{_RETRIEVE_SQL}, {_TOLD_SQL}, found AS (SELECT question_id, src, dst FROM k), {_GOLDEN_SQL},
verdicts AS (SELECT doc_id % 10 AS k, avg(quality) > 0.8 AS correct, avg(toxic) > 0.15 AS leaked FROM labels GROUP BY 1),
graph AS (SELECT p.question_id, bool_and(length(p.s) > 2 AND length(p.o) > 2 AND EXISTS (FROM edges e WHERE lower(e.src) = p.s AND lower(e.dst) = p.o OR lower(e.src) = p.o AND lower(e.dst) = p.s)) AS in_graph FROM steps p GROUP BY 1),
rows AS (SELECT g.question_id, g.kind, g.hops, g.question, g.read_point, g.expected_answer, g.reason, g.sup, blocks.block, u.n_triples, u.hops AS hops_used, u.allow_hub, u.starts, u.trace, coalesce(sources.labels, '') AS chapters, j.correct, j.leaked, recall.path_recall,
  CASE WHEN j.correct THEN NULL WHEN in_graph IS NULL THEN 'generate' WHEN NOT in_graph THEN 'index' WHEN NOT retrieved THEN 'retrieve' ELSE 'generate' END AS failure_layer
  FROM golden g LEFT JOIN verdicts j ON j.k = g.number % 10 LEFT JOIN recall USING (question_id) LEFT JOIN graph USING (question_id)
  LEFT JOIN blocks ON blocks.question_id = g.question_id LEFT JOIN summary u ON u.question_id = g.question_id LEFT JOIN sources ON sources.question_id = g.question_id)"""


def _rows(spark, sf_dir) -> DataFrame:
    nodes, edges, starts, triples, used = _retrieved(spark, sf_dir)
    golden = saved(_golden(spark, sf_dir))
    labels = table(spark, sf_dir, "labels").groupBy(F.pmod("doc_id", F.lit(10)).alias("k")).agg((F.avg("quality") > 0.8).alias("correct"), (F.avg("toxic") > 0.15).alias("leaked"))
    judged = golden.join(labels, F.pmod("number", F.lit(10)).cast("long") == F.col("k"), "left").select("question_id", "question", "number", "correct", "leaked")
    judged = judged.withColumn("reason", F.concat(F.lit("judged by the labels of documents whose number ends in "), F.col("number") % 10, F.lit(", for the question "), "question"))
    told = _summary(spark, sf_dir, nodes, edges, starts, triples, used).select("question_id", F.col("n_triples").cast("int").alias("n_triples"), F.col("hops").alias("hops_used"), F.col("allow_hub").alias("hub_opened"), "starts", "trace")
    blocks = retrieve.evidence_block(triples, I.questions(spark, sf_dir)).select("question_id", F.col("block").alias("answer"))
    labels = retrieve.sources(triples).select("question_id", F.col("labels").alias("chapters"))
    g = judged.join(told, "question_id").join(blocks, "question_id").select("question_id", "answer", "correct", "leaked", "reason", "n_triples", "hops_used", "hub_opened", "starts", "trace")
    says = F.concat(F.lit("the chunks say nothing of S"), "number").alias("answer")
    b = judged.join(labels, "question_id", "left").select("question_id", says, (~F.col("correct")).alias("correct"), "leaked", "reason", F.coalesce("chapters", F.array().cast("array<string>")).alias("chapters"))
    recall = evaluate.path_recall(golden, triples)
    layer = evaluate.failure_layer(golden, triples, edges, judged.select("question_id", "correct"))
    return saved(evaluate.eval_rows(golden, g, b, recall, layer))


@query(
    f"""{_ROWS_SQL},
g AS (SELECT *, unnest([CASE WHEN kind <> 'spoiler_gate' AND hops = 1 THEN '1-hop' END, CASE WHEN kind = 'multihop' AND hops = 2 THEN '2-hop' END, CASE WHEN kind = 'multihop' AND hops = 3 THEN '3-hop' END,
  CASE WHEN kind = 'control_singlehop' THEN 'control' END, CASE WHEN kind = 'spoiler_gate' THEN 'gate' END, 'total']) AS grp FROM rows)
SELECT grp, count(*) AS n, round(avg(correct::INT) * 100, 6) AS graph_pct, round(avg((NOT correct)::INT) * 100, 6) AS basic_pct, round(avg(path_recall) * 100, 6) AS recall_pct FROM g WHERE grp IS NOT NULL GROUP BY 1"""
)
def evaluation_report(spark, sf_dir):
    out = evaluate.report(_rows(spark, sf_dir))
    return out.select("grp", "n", *[F.round(c, 6).alias(c) for c in ("graph_pct", "basic_pct", "recall_pct")])


@query(f"{_ROWS_SQL} SELECT failure_layer, count(*) AS n, string_agg(question_id, ',' ORDER BY question_id) AS ids FROM rows WHERE NOT coalesce(correct, false) GROUP BY 1")
def evaluation_failures(spark, sf_dir):
    return evaluate.failures(_rows(spark, sf_dir))[0].select("failure_layer", "n", F.array_join("ids", ",").alias("ids"))


@query(f"{_ROWS_SQL} SELECT question_id, question, left(expected_answer, 55) AS expected, left(block, 55) AS answer, left(reason, 70) AS reason FROM rows WHERE NOT coalesce(correct, false)")
def evaluation_details(spark, sf_dir):
    return evaluate.failures(_rows(spark, sf_dir))[1]


@query(f"{_ROWS_SQL}, l AS (SELECT count(*) AS n, coalesce(string_agg(question_id, ',' ORDER BY question_id), '') AS ids FROM rows WHERE leaked) SELECT 'graph' AS system, n, ids FROM l UNION ALL SELECT 'basic', n, ids FROM l")
def evaluation_leaks(spark, sf_dir):
    return evaluate.leaks(_rows(spark, sf_dir)).select("system", "n", F.array_join("ids", ",").alias("ids"))


@query(f"""{_ROWS_SQL} SELECT question_id, kind, CAST(hops AS INTEGER) AS hops, question, read_point, expected_answer, md5(block) AS answer_md5, correct, leaked, reason, CAST(n_triples AS INTEGER) AS n_triples, hops_used, allow_hub AS hub_opened, starts, trace,
  'the chunks say nothing of ' || sup AS basic_answer, NOT correct AS basic_correct, chapters, round(path_recall, 6) AS path_recall, failure_layer FROM rows""")
def evaluation_rows(spark, sf_dir):
    """The nested rows of the evaluation as they come back from a file, every field of them."""
    rows, path = _rows(spark, sf_dir), shared_path(spark)
    files.write_eval(rows, path)
    read = spark.read.schema(rows.schema).json(path)
    joined = lambda c, sep: F.array_join(c, sep)
    return read.select(
        "question_id", "kind", "hops", "question", "read_point", "expected_answer", F.md5("graph.answer").alias("answer_md5"), "graph.correct", "graph.leaked", "graph.reason", "graph.n_triples", "graph.hops_used", "graph.hub_opened",
        joined("graph.starts", ",").alias("starts"), joined("graph.trace", " | ").alias("trace"), F.col("basic.answer").alias("basic_answer"), F.col("basic.correct").alias("basic_correct"), joined("basic.chapters", ",").alias("chapters"), F.round("path_recall", 6).alias("path_recall"), "failure_layer",
    )


@query(f"""WITH {I.EVIDENCE_SQL}, {I.QUESTIONS_SQL}, found AS (SELECT question_id, sup AS src, par AS dst FROM questions), {_GOLDEN_SQL},
names AS (SELECT id, CASE WHEN length(id) > 2 AND length(id) % 3 < 2 THEN [id] ELSE list_filter([['anna', 'ivan', 'old'][1 + length(id) % 3], id], lambda t: length(t) > 2) END AS t FROM (SELECT s AS id FROM steps UNION SELECT o FROM steps UNION SELECT lower(src) FROM edges UNION SELECT lower(dst) FROM edges) x),
w AS (SELECT question_id, step, a.t AS s, b.t AS o FROM steps JOIN names a ON a.id = s JOIN names b ON b.id = o), e AS (SELECT DISTINCT a.t AS a, b.t AS b FROM edges JOIN names a ON a.id = lower(src) JOIN names b ON b.id = lower(dst))
SELECT question_id, step, EXISTS (FROM e WHERE list_has_any(s, a) AND list_has_any(o, b) OR list_has_any(s, b) AND list_has_any(o, a)) AS matched FROM w""")
def match_graph(spark, sf_dir):
    """Steps between names of which many share their first word, some of them weak words, against all edges."""
    first = lambda c: F.element_at(F.array(*map(F.lit, ("Anna", "Ivan", "Old"))), 1 + F.length(c) % 3)
    named = lambda c: F.concat(first(c), F.lit(" "), c)
    q = _golden(spark, sf_dir).withColumn("expected_path", F.transform("expected_path", lambda x: F.struct(named(x["s"]).alias("s"), x["rel"].alias("rel"), named(x["o"]).alias("o"))))
    _, edges = built(spark, sf_dir)
    return evaluate.match_graph(q, edges.select(named(F.col("src")).alias("src"), named(F.col("dst")).alias("dst")), weak=["anna", "ivan"])
