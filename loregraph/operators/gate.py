"""The gate: what a reader sees who has read up to a section, the read point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loregraph.operators.graph import incidence


def visible(nodes: DataFrame, edges: DataFrame, read_points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges for each row of read_points(corpus_id, read_point). An edge's ends are never later than the edge."""
    gate = lambda df: df.join(read_points, "corpus_id").where("first_revealed_index <= read_point")
    return gate(nodes), gate(edges)


def write_by_appearance(df: DataFrame, path: str) -> None:
    """Nodes or edges in files and row groups by corpus and first appearance, for `snapshot`."""
    df.repartitionByRange("corpus_id", "first_revealed_index").sortWithinPartitions("corpus_id", "first_revealed_index").write.option("parquet.block.size", 4 << 20).parquet(path)


def snapshot(spark: SparkSession, path: str, read_point: int, corpus_id: str | None = None) -> DataFrame:
    """What is visible at a read point, in one corpus or in all, of a table that `write_by_appearance` wrote: a prefix of each
    corpus. Files and row groups behind it are not read, as their least appearance is in their footers."""
    seen = spark.read.parquet(path).where(F.col("first_revealed_index") <= read_point)
    return seen if corpus_id is None else seen.where(F.col("corpus_id") == corpus_id)


def trimmed(evidence: Column, read_point: Column) -> Column:
    return F.filter(evidence, lambda e: e["global_index"] <= read_point)


def visible_evidence(edges: DataFrame) -> DataFrame:
    """Edges with a read_point, their evidence cut to it; edges without any left are dropped."""
    return edges.withColumn("evidence", trimmed(F.col("evidence"), F.col("read_point"))).where(F.size("evidence") > 0)


def visibility_curve(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(corpus_id, read_point, nodes, edges, all_nodes, all_edges) at each section where something appears: counts of first
    appearances, summed up along the sections."""
    count = lambda df, n, e: df.groupBy("corpus_id", F.col("first_revealed_index").alias("read_point")).agg(n.alias("n"), e.alias("e"))
    one, zero = F.count("*"), F.lit(0).cast("long")
    firsts = count(nodes, one, zero).union(count(edges, zero, one)).groupBy("corpus_id", "read_point").agg(F.sum("n").alias("n"), F.sum("e").alias("e"))
    by = Window.partitionBy("corpus_id")
    so_far = by.orderBy("read_point").rowsBetween(Window.unboundedPreceding, 0)
    return firsts.select("corpus_id", "read_point", F.sum("n").over(so_far).alias("nodes"), F.sum("e").over(so_far).alias("edges"), F.sum("n").over(by).alias("all_nodes"), F.sum("e").over(by).alias("all_edges"))


def visibility_counts(nodes: DataFrame, edges: DataFrame, read_points: DataFrame) -> DataFrame:
    """The same at given read_points(corpus_id, read_point)."""
    points = read_points.distinct()

    def count(df: DataFrame, name: str) -> DataFrame:
        own = df.groupBy("corpus_id", "first_revealed_index").agg(F.count("*").alias("n"))
        met = points.join(own, "corpus_id", "left").groupBy("corpus_id", "read_point")
        return met.agg(F.coalesce(F.sum(F.when(F.col("first_revealed_index") <= F.col("read_point"), F.col("n"))), F.lit(0)).alias(name), F.coalesce(F.sum("n"), F.lit(0)).alias(f"all_{name}"))

    return count(nodes, "nodes").join(count(edges, "edges"), ["corpus_id", "read_point"])


def first_appearance(edges: DataFrame) -> DataFrame:
    """(corpus_id, id, first_revealed_index) of the nodes."""
    return incidence(edges).groupBy("corpus_id", "id").agg(F.min("first_revealed_index").alias("first_revealed_index"))


def mask_titles(sections: DataFrame, read_points: DataFrame, epilogue_no: int = 13, epilogue: str = "Epilogue") -> DataFrame:
    """(corpus_id, read_point, global_index, shown): the label, and the title only up to the read point."""
    head = F.when(F.col("book_no") == epilogue_no, F.concat(F.lit(f"{epilogue} "), "chapter_no")).otherwise(F.concat("book_no", F.lit(" "), "chapter_no"))
    shown = F.when(F.col("global_index") <= F.col("read_point"), F.concat(head, F.lit(" — "), "chapter_title")).otherwise(head)
    return sections.join(read_points, "corpus_id").select("corpus_id", "read_point", "global_index", shown.alias("shown"))


def alias_panel(aliases: DataFrame, read_points: DataFrame, labels: DataFrame, most: int = 6) -> DataFrame:
    """(corpus_id, read_point, canon, label, shown, place): names with two or more displayable aliases seen so far, of which
    one is another name than a shorter or longer form; the shortest first; labelled names first, then those with more."""
    seen = aliases.where("display").join(read_points, "corpus_id").where("first_index <= read_point")
    per = seen.groupBy("corpus_id", "read_point", "canon").agg(F.count("*").alias("n"), F.collect_set("alias").alias("all"))
    base = F.lower("canon")
    other = F.exists("all", lambda a: ~F.contains(base, a) & ~F.contains(a, base))
    short = F.slice(F.array_sort(F.transform("all", lambda a: F.struct(F.length(a).alias("n"), a.alias("a")))), 1, most)
    rows = per.where((F.col("n") >= 2) & other).select("corpus_id", "read_point", "canon", F.transform(short, lambda x: F.initcap(x["a"])).alias("shown"))
    rows = rows.join(labels.select(F.col("id").alias("canon"), "label"), "canon", "left")
    place = F.row_number().over(Window.partitionBy("corpus_id", "read_point").orderBy(F.col("label").isNull(), F.desc(F.size("shown")), "canon"))
    return rows.select("corpus_id", "read_point", "canon", F.coalesce("label", "canon").alias("label"), "shown", place.alias("place"))
