"""Evidence: candidate triples are kept if their quote stands in the section, golden evidence if it lies before the gate."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loregraph.functions.automaton import of_strings
from loregraph.functions.text import collapse, norm_quote, strip


#: Quotes that stand beside a section's text at once; fewer than FEW are looked for one by one.
QUOTES, FEW = 10_000, 8


def _standing(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The quotes that are in the text of their row; many are found in one pass over it."""
    for table in tables:
        for corpus, doc, text, quotes in zip(*[table.column(c) for c in ("corpus_id", "_doc", "_hay", "_quotes")]):
            text, quotes = text.as_py(), quotes.as_py()
            if len(quotes) < FEW:
                found = [q for q in quotes if q in text]
            else:
                machine = of_strings({q: q for q in quotes if q})
                found = sorted({q for _, q in machine.iter(text)} if len(machine) else []) + [q for q in quotes if not q]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([corpus.as_py()] * len(found), pa.string()), pa.array([doc.as_py()] * len(found), pa.string()), pa.array(found, pa.string())], names=["corpus_id", "_doc", "_quote"])


def _packed(asked: DataFrame, key: list[str], value: str, name: str) -> DataFrame:
    """The values of a section as arrays of about QUOTES."""
    counts = asked.groupBy(*key).agg(F.ceil(F.count("*") / QUOTES).alias("_parts"))
    part = F.pmod(F.xxhash64(value), F.col("_parts")).alias("_part")
    return asked.join(counts, key).select(*key, value, part).groupBy(*key, "_part").agg(F.collect_list(value).alias(name)).drop("_part")


def verify_quotes(candidates: DataFrame, sections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped). kept: the triples whose normalised quote is in the whole section's normalised text, stamped with
    global_index and label. dropped: (corpus_id, doc_id, dropped_unquoted). An empty quote is kept; a null one is not.

    A text stands beside the quotes of its section once, up to QUOTES of them."""
    key = ["corpus_id", "doc_id"]
    own = candidates.select(*[c for c in candidates.columns if c not in ("global_index", "label")]).withColumn("_quote", norm_quote(F.col("quote")))
    asked = own.where("_quote is not null").select("corpus_id", F.col("doc_id").cast("string").alias("_doc"), "_quote").distinct()
    hay = sections.where("text is not null").select("corpus_id", F.col("doc_id").cast("string").alias("_doc"), norm_quote(F.col("text")).alias("_hay"))
    met = _packed(asked, ["corpus_id", "_doc"], "_quote", "_quotes").join(hay, ["corpus_id", "_doc"])
    found = met.select("corpus_id", "_doc", "_hay", "_quotes").mapInArrow(_standing, "corpus_id string, _doc string, _quote string").distinct().withColumn("_ok", F.lit(True))
    judged = own.withColumn("_doc", F.col("doc_id").cast("string")).join(found, ["corpus_id", "_doc", "_quote"], "left").drop("_doc", "_quote")
    kept = judged.where("_ok").drop("_ok").join(sections.select(*key, "global_index", "label"), key)
    return kept, judged.groupBy(*key).agg(F.sum(F.when(F.col("_ok"), 0).otherwise(1)).alias("dropped_unquoted"))


def restrict_vocab(df: DataFrame, column: str, vocab: DataFrame) -> DataFrame:
    """Rows whose label is in vocab(label)."""
    return df.join(vocab.select(F.col("label").alias(column)).distinct(), column, "left_semi")


def collect_extraction(sections: DataFrame, entities: DataFrame, triples: DataFrame, dropped: DataFrame, pass_name: str) -> DataFrame:
    """One row a section: its entities and triples as arrays in their order, and how many triples were dropped."""
    key = ["corpus_id", "doc_id"]
    ents = entities.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("ent_pos", "name", "type", "aliases"))).alias("e"))
    tris = triples.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("tri_pos", "subject", "relation", "object", "quote", "disputed"))).alias("t"))
    out = sections.select(*key, "global_index", "label").join(ents, key, "left").join(tris, key, "left").join(dropped, key, "left")
    bare = lambda c, names, kind: F.coalesce(F.transform(c, lambda x: F.struct(*[x[n].alias(n) for n in names])), F.array().cast(kind))
    return out.select(
        "corpus_id", F.lit(pass_name).alias("pass"), "doc_id", "global_index", "label",
        bare(F.col("e"), ("name", "type", "aliases"), "array<struct<name:string,type:string,aliases:array<string>>>").alias("entities"),
        bare(F.col("t"), ("subject", "relation", "object", "quote", "disputed"), "array<struct<subject:string,relation:string,object:string,quote:string,disputed:boolean>>").alias("triples"),
        F.coalesce("dropped_unquoted", F.lit(0)).cast("int").alias("dropped_unquoted"),
    )


def extraction_report(extractions: DataFrame) -> DataFrame:
    """Per pass: sections, triples, entities, dropped, dropped_pct of all candidates."""
    size = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c))
    out = extractions.groupBy("pass").agg(F.count("*").alias("n_sections"), F.sum(size("triples")).alias("n_triples"), F.sum(size("entities")).alias("n_entities"), F.sum(F.coalesce("dropped_unquoted", F.lit(0))).alias("n_dropped"))
    return out.withColumn("dropped_pct", F.col("n_dropped") / F.greatest(F.lit(1), F.col("n_triples") + F.col("n_dropped")) * 100)


def mine_quotes(patterns: DataFrame, sections: DataFrame, before: int = 0, after: int = 170) -> DataFrame:
    """Per row of patterns(corpus_id, global_index, pattern): the first match in the collapsed section, widened and cut at
    the ends; quote is null where nothing matches (an error). A text stands beside the patterns of its section once."""
    key = ["corpus_id", "global_index"]
    hay = sections.select(*key, "doc_id", "label", collapse(F.col("text")).alias("_hay"))
    packed = _packed(patterns.where("pattern is not null").select(*key, "pattern").distinct(), key, "pattern", "_patterns")

    def cut(p: Column) -> Column:
        rule = F.concat(F.lit("(?is)"), p)
        at = F.regexp_instr("_hay", rule) - 1
        start = F.greatest(at - before, F.lit(0))
        end = F.least(F.length("_hay"), at + F.length(F.regexp_substr("_hay", rule)) + after)
        return F.struct(p.alias("pattern"), F.when(at >= 0, strip(F.substring("_hay", start + 1, end - start))).alias("quote"))

    found = packed.join(hay, key).select(*key, F.explode(F.transform("_patterns", cut)).alias("f")).select(*key, "f.*")
    return patterns.join(found, [*key, "pattern"], "left").join(sections.select(*key, "doc_id", "label"), key, "left")


def check_evidence_gate(questions: DataFrame) -> DataFrame:
    """Questions with evidence after their read point."""
    return questions.where(F.exists("evidence", lambda e: e["global_index"] > F.col("read_point")))


def question_profile(questions: DataFrame, gate_kind: str = "spoiler_gate") -> DataFrame:
    """(what, value, n): questions by kind, and by hops without the gate kind."""
    kinds = questions.groupBy("kind").agg(F.count("*").alias("n")).select(F.lit("kind").alias("what"), F.col("kind").alias("value"), "n")
    hops = questions.where(F.col("kind") != gate_kind).groupBy("hops").agg(F.count("*").alias("n"))
    return kinds.union(hops.select(F.lit("hops"), F.col("hops").cast("string"), "n"))
