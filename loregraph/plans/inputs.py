"""Inputs of the operators from the driver's tables: triples from lineitem, sections from documents, questions from suppliers.

`*_SQL` is the same table for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loregraph.functions.tables import saved, table

TRIPLES_SQL = """
raw AS (
  SELECT 'c' || (l_suppkey % 3) AS corpus_id, 'p' || l_linenumber AS pass,
         'ch' || lpad(CAST((year(l_shipdate) - 1992) * 12 + month(l_shipdate) AS VARCHAR), 3, '0') AS doc_id,
         CAST((year(l_shipdate) - 1992) * 12 + month(l_shipdate) AS INTEGER) AS global_index, l_orderkey AS tri_pos,
         CASE WHEN l_quantity >= 2 THEN 'S' || l_suppkey END AS subject, l_returnflag AS relation,
         CASE WHEN l_partkey % 97 = 0 THEN 'S' || l_suppkey ELSE 'P' || l_partkey END AS object,
         'q' || l_orderkey || '-' || l_linenumber AS quote,
         CASE WHEN l_linestatus = 'O' AND l_quantity > 25 THEN true WHEN l_quantity > 10 THEN false END AS disputed
  FROM lineitem),
types AS (SELECT 'P' || p_partkey AS name, CASE p_size % 4 WHEN 0 THEN 'Place' WHEN 1 THEN 'Event' ELSE 'Character' END AS type FROM part WHERE p_partkey % 5 <> 0),
spec(relation, to_type) AS (VALUES ('A', 'Character'), ('N', 'Character'), ('R', 'Place')),
judged AS (SELECT raw.*, CASE WHEN subject IS NULL OR object IS NULL THEN 'generic' WHEN subject = object THEN 'selfloop' WHEN types.type <> spec.to_type THEN 'type' ELSE 'kept' END AS reason
  FROM raw LEFT JOIN types ON types.name = raw.object LEFT JOIN spec USING (relation)),
kept AS (SELECT * FROM judged WHERE reason = 'kept')"""

EVIDENCE_SQL = (
    TRIPLES_SQL
    + """,
evidence AS (
  SELECT corpus_id, subject, relation, object, global_index, arg_min(doc_id, (pass, doc_id, tri_pos)) AS doc_id, arg_min(quote, (pass, doc_id, tri_pos)) AS quote,
         bool_or(disputed) AS disputed, count(*) AS n_passes, count(DISTINCT pass) AS n_distinct_passes, min((pass, doc_id, tri_pos)) AS ord
  FROM kept GROUP BY ALL),
edges AS (
  SELECT corpus_id, subject AS src, relation, object AS dst, min(global_index) AS first_revealed_index, count(*) AS n_support, min(ord) AS ord
  FROM evidence GROUP BY ALL),
ends AS (SELECT corpus_id, src AS id, first_revealed_index FROM edges UNION ALL SELECT corpus_id, dst, first_revealed_index FROM edges),
nodes AS (
  SELECT e.corpus_id, e.id, any_value(coalesce(t.type, 'Character')) AS type, min(first_revealed_index) AS first_revealed_index, count(*) AS degree,
         count(DISTINCT first_revealed_index) AS n_chapters
  FROM ends e LEFT JOIN types t ON t.name = e.id GROUP BY 1, 2)"""
)

#: Sections over which a node spreads if it counts as a hub. These inputs have no text: a node spreads over the sections in
#: which its edges appear.
HUB_SECTIONS = 50


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem")
    month = ((F.year("l_shipdate") - 1992) * 12 + F.month("l_shipdate")).cast("int")
    return t.select(
        F.concat(F.lit("c"), F.col("l_suppkey") % 3).alias("corpus_id"), F.concat(F.lit("p"), "l_linenumber").alias("pass"), F.concat(F.lit("ch"), F.lpad(month.cast("string"), 3, "0")).alias("doc_id"),
        month.alias("global_index"), F.concat(F.lit("L"), month).alias("label"), F.col("l_orderkey").alias("tri_pos"),
        F.when(F.col("l_quantity") >= 2, F.concat(F.lit("S"), "l_suppkey")).alias("subject"), F.col("l_returnflag").alias("relation"),
        F.when(F.col("l_partkey") % 97 == 0, F.concat(F.lit("S"), "l_suppkey")).otherwise(F.concat(F.lit("P"), "l_partkey")).alias("object"),
        F.concat(F.lit("q"), "l_orderkey", F.lit("-"), "l_linenumber").alias("quote"),
        F.when((F.col("l_linestatus") == "O") & (F.col("l_quantity") > 25), True).when(F.col("l_quantity") > 10, False).alias("disputed"),
    )


def types(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").where("p_partkey % 5 <> 0")
    kind = F.when(F.col("p_size") % 4 == 0, "Place").when(F.col("p_size") % 4 == 1, "Event").otherwise("Character")
    corpora = F.explode(F.array(*[F.lit(f"c{i}") for i in range(3)]))
    return p.select(corpora.alias("corpus_id"), F.concat(F.lit("P"), "p_partkey").alias("name"), kind.alias("type"))


def rel_spec(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("A", "Character"), ("N", "Character"), ("R", "Place")], "relation string, to_type string")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question for every supplier, by its number: about it and a part, about a part alone early in the text (hubs have to be
    opened), about the supplier alone at the beginning (one more hop is needed, or nothing is known yet), and again about both."""
    parts = table(spark, sf_dir, "part").agg(F.count("*").alias("parts"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("number")).join(F.broadcast(parts))
    s = s.withColumn("part", 1 + (F.col("number") * 7 + 3) % F.col("parts"))
    of = F.col("number") % 4
    sup, part = F.concat(F.lit("S"), "number"), F.concat(F.lit("P"), "part")
    text = F.when(of == 1, F.concat(F.lit("who asked for <"), part, F.lit(">?"))).when(of == 2, F.concat(F.lit("what of <"), sup, F.lit(">?"))).otherwise(F.concat(F.lit("what links <"), sup, F.lit("> and <"), part, F.lit(">?")))
    point = F.when(of == 1, 40 + F.floor(F.col("number") / 4) % 9 * 3).when(of == 2, 37 + F.floor(F.col("number") / 4) % 2).otherwise(60 + F.col("number") % 40)
    return s.select(F.concat(F.lit("c"), F.col("number") % 3).alias("corpus_id"), F.concat(F.lit("q"), "number").alias("question_id"), text.alias("question"), point.cast("int").alias("read_point"), "number", "part")


QUESTIONS_SQL = """
asked AS (SELECT s_suppkey AS number, 'S' || s_suppkey AS sup, 'P' || (1 + (s_suppkey * 7 + 3) % (SELECT count(*) FROM part)) AS par, s_suppkey % 4 AS kind FROM supplier),
questions AS (SELECT 'c' || (number % 3) AS corpus_id, 'q' || number AS question_id, CAST(CASE kind WHEN 1 THEN 40 + number // 4 % 9 * 3 WHEN 2 THEN 37 + number // 4 % 2 ELSE 60 + number % 40 END AS INTEGER) AS read_point,
  CASE WHEN kind <> 1 THEN sup END AS s1, CASE WHEN kind <> 2 THEN par END AS s2, sup, par, number,
  CASE kind WHEN 1 THEN 'who asked for <' || par || '>?' WHEN 2 THEN 'what of <' || sup || '>?' ELSE 'what links <' || sup || '> and <' || par || '>?' END AS question FROM asked)"""


def surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(surface, canon, ord): the bracketed keys of suppliers and parts."""
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("canon"), F.col("s_suppkey").alias("ord"))
    p = table(spark, sf_dir, "part").select(F.concat(F.lit("P"), "p_partkey").alias("canon"), (F.lit(1_000_000) + F.col("p_partkey")).alias("ord"))
    return s.union(p).select(F.concat(F.lit("<"), "canon", F.lit(">")).alias("surface"), "canon", "ord")


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as sections, a source a corpus, in the order of doc_id. Keys alone are put in order, by ranges, so that no
    source is one task."""
    d = table(spark, sf_dir, "documents")
    at = saved(d.select("source", "doc_id").orderBy("source", "doc_id").select("source", "doc_id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")))
    sizes = at.groupBy("source", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    skips = sizes.select(F.col("source").alias("_s"), "part", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("skip"))
    placed = at.join(skips, (at["source"].eqNullSafe(F.col("_s"))) & (at["part"] == skips["part"])).select(F.col("source").alias("_source"), F.col("doc_id").alias("_doc"), (F.col("at") - F.col("first") + F.col("skip") + 1).alias("place"))
    rows = d.join(placed, (d["doc_id"] == placed["_doc"]) & d["source"].eqNullSafe(placed["_source"]))
    return rows.select(F.col("source").alias("corpus_id"), F.col("doc_id").cast("string").alias("doc_id"), F.col("place").cast("int").alias("global_index"), F.concat(F.lit("1 "), F.col("place").cast("string")).alias("label"), "text", F.col("doc_id").alias("number"))


SECTIONS_SQL = """
sections AS (SELECT source AS corpus_id, CAST(doc_id AS VARCHAR) AS doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INTEGER) AS global_index, text, doc_id AS number FROM documents)"""
