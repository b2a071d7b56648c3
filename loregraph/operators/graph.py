"""The graph: validated triples folded over passes into edges with evidence, and nodes with their statistics.

triples: corpus_id, pass, doc_id, global_index, label, tri_pos, subject, relation, object, quote, disputed. Their run order is
(pass, doc_id, tri_pos). disputed is three-valued: null is "not judged".
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import accumulate, compress
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loregraph.functions.tables import saved
from loregraph.functions.text import collapse, norm, words

EDGE = ("corpus_id", "subject", "relation", "object")


def run_order() -> Column:
    return F.struct("pass", "doc_id", "tri_pos")


def union_passes(passes: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), passes)


def validate_triples(triples: DataFrame, types: DataFrame, rel_spec: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, audit). Drop reasons in order: generic (an end is null), selfloop, type (the object's known type is not the
    relation's). types(corpus_id, name, type), rel_spec(relation, to_type). audit: (reason, n), reason kept among them. rel_spec has a
    row a relation and is sent to all tasks: a join by relation would deal all triples to as many tasks as there are relations."""
    t = types.select("corpus_id", F.col("name").alias("object"), F.col("type").alias("_type"))
    met = triples.join(t, ["corpus_id", "object"], "left").join(F.broadcast(rel_spec.select("relation", "to_type")), "relation", "left")
    reason = (
        F.when(F.col("subject").isNull() | F.col("object").isNull(), "generic")
        .when(F.col("subject") == F.col("object"), "selfloop")
        .when(F.col("_type") != F.col("to_type"), "type")
        .otherwise("kept")
    )
    met = met.withColumn("reason", reason)
    return met.where("reason = 'kept'").select(*triples.columns), met.groupBy("reason").agg(F.count("*").alias("n"))


def fold_evidence(kept: DataFrame) -> DataFrame:
    """One row for each edge and section: the first occurrence's doc_id, label and quote; n_passes counts occurrences,
    n_distinct_passes passes; disputed is true if any is true, else false if any is false, else null."""
    first = F.min_by(F.struct("doc_id", "label", "quote"), run_order())
    out = kept.groupBy(*EDGE, "global_index").agg(
        first.alias("f"), F.count("*").alias("n_passes"), F.count_distinct("pass").alias("n_distinct_passes"), F.max("disputed").alias("disputed"), F.min(run_order()).alias("ord")
    )
    return out.select(*EDGE, "global_index", "f.doc_id", "f.label", "f.quote", "disputed", "n_passes", "n_distinct_passes", "ord")


def build_edges(evidence: DataFrame) -> DataFrame:
    """(corpus_id, src, relation, dst, first_revealed_index, n_support, ord, evidence sorted by section)."""
    item = F.struct("global_index", "doc_id", "label", "quote", "disputed", "n_passes")
    return evidence.groupBy(*EDGE).agg(
        F.min("global_index").alias("first_revealed_index"), F.count("*").alias("n_support"), F.min("ord").alias("ord"), F.array_sort(F.collect_list(item)).alias("evidence")
    ).withColumnsRenamed({"subject": "src", "object": "dst"})


def incidence(edges: DataFrame) -> DataFrame:
    """(corpus_id, id, first_revealed_index) for both ends of each edge."""
    end = lambda c: edges.select("corpus_id", F.col(c).alias("id"), "first_revealed_index")
    return end("src").union(end("dst"))


def build_nodes(edges: DataFrame, types: DataFrame, default_type: str = "Character") -> DataFrame:
    """(corpus_id, id, type, first_revealed_index, degree, n_chapters) of the ends of the edges."""
    out = incidence(edges).groupBy("corpus_id", "id").agg(F.min("first_revealed_index").alias("first_revealed_index"), F.count("*").alias("degree"), F.count_distinct("first_revealed_index").alias("n_chapters"))
    t = types.select("corpus_id", F.col("name").alias("id"), "type")
    return out.join(t, ["corpus_id", "id"], "left").select("corpus_id", "id", F.coalesce("type", F.lit(default_type)).alias("type"), "first_revealed_index", "degree", "n_chapters")


#: What words are made of. A text is cut into words and, one by one, other characters; runs of white space are one space before.
_WORD = r"[\p{L}\p{N}_]"


def _tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.regexp_replace(c, r"[ \t-\r]+", " "), F.lit(rf"(?s){_WORD}+|[^\p{{L}}\p{{N}}_]"), F.lit(0))


#: Runs of a batch; log2 of the cells of the filter that keeps most runs that are no form from being moved (8 MB).
_ROWS, _CELLS = 50_000, 26
_TOKEN = re.compile(r"\w+|\W")


def _runs(text: str, lengths: list[int]) -> set[str]:
    """The different runs of so many tokens. A run that begins or ends beside its words must not stand at a word there."""
    tokens = _TOKEN.findall(text)
    word = [t[0] == "_" or t[0].isalnum() for t in tokens]
    begun = [a or not b for a, b in zip(word, [False, *word])]
    ended = [a or not b for a, b in zip(word, [*word[1:], False])]
    at = [0, *accumulate(map(len, tokens))]
    out: set[str] = set()
    for n in lengths:  # a form of one token is a word
        out.update(compress(tokens, word) if n == 1 else [text[p:q] for p, q, x, y in zip(at, at[n:], begun, ended[n - 1 :]) if x and y])
    return out


def _cells(runs: list[str]) -> np.ndarray:
    """The filter's cells of runs."""
    return np.fromiter(map(crc32, map(str.encode, runs)), np.int64, len(runs)) & ((1 << _CELLS) - 1)


def _filled(runs: DataFrame) -> np.ndarray:
    """The filter of runs(_run), a bit a cell, of fixed size: a run whose bit is not set is surely none of them."""

    def cells(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            yield pa.RecordBatch.from_arrays([pa.array(_cells(table.column(0).to_pylist()))], names=["cell"])

    found = runs.select("_run").mapInArrow(cells, "cell long").groupBy(F.expr("shiftright(cell, 6)").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(cell & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << _CELLS - 6, "<i8")
    out[found.column("at").to_numpy()] = found.column("bits").to_numpy()
    return out.view(np.uint8)


def find_forms(forms: DataFrame, sections: DataFrame, collapsed: bool = True, shard: int | None = None) -> DataFrame:
    """(corpus_id, key, form, doc_id, global_index): where each normalised form stands as whole words, in any case, with any
    white space between its words.

    A join: each text gives its different runs of as many tokens as some form has, and meets the forms by them. So the work grows
    with the texts and with the forms, not with their product. Runs that a filter of fixed size tells to be no form of any corpus are
    not moved. A null corpus meets nothing. `shard` has no meaning any more.
    """
    text = collapse(F.col("text")) if collapsed else F.col("text")
    asked = forms.where(F.col("form").rlike(_WORD)).select("corpus_id", "key", F.lower("form").alias("form"))
    asked = saved(asked.distinct().withColumn("_tokens", _tokens(F.col("form"))).select("corpus_id", "key", "form", F.size("_tokens").alias("_n"), F.array_join("_tokens", "").alias("_run")))
    lengths = sorted(r[0] for r in asked.select("_n").distinct().collect())
    kinds = {c: sections.schema[c].dataType for c in ("doc_id", "global_index")}
    if not lengths:
        return asked.select("corpus_id", "key", "form", *[F.lit(None).cast(t).alias(c) for c, t in kinds.items()])
    held = sections.where("text is not null").select("corpus_id", "doc_id", "global_index", F.regexp_replace(F.lower(text), r"[ \t-\r]+", " ").alias("_text"))

    sent = sections.sparkSession.sparkContext.broadcast(_filled(asked))

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = sent.value
        for table in tables:
            rows, found = [], []

            def batch() -> pa.RecordBatch:
                took = pa.array(rows, pa.int64())  # noqa: B023
                return pa.RecordBatch.from_arrays([*[table.column(c).take(took) for c in range(3)], pa.array(found, pa.string())], names=["corpus_id", "doc_id", "global_index", "_run"])  # noqa: B023

            for i, text in enumerate(table.column("_text").to_pylist()):
                own = list(_runs(text, lengths))
                at = _cells(own)
                own = [own[n] for n in np.flatnonzero(filled[at >> 3] >> (at & 7) & 1)]
                rows.extend([i] * len(own))
                found.extend(own)
                if len(rows) >= _ROWS:
                    yield batch()
                    rows, found = [], []
            if rows:
                yield batch()

    names = ", ".join(f"{c} {sections.schema[c].dataType.simpleString()}" for c in ("corpus_id", "doc_id", "global_index"))
    runs = held.mapInArrow(run, f"{names}, _run string")
    return runs.join(asked, ["corpus_id", "_run"]).select("corpus_id", "key", "form", "doc_id", "global_index")


def spread_of(forms: DataFrame, sections: DataFrame) -> DataFrame:
    """(corpus_id, id, n_text_chapters): in how many sections any form of a key stands, of forms(corpus_id, key, form).

    Each form is looked for once, however many keys have it. A key's most frequent form counts by its number of sections; to these come
    the sections of its other forms in which that one does not stand. So a frequent form that many keys share is not written out for each.
    """
    met = saved(find_forms(forms.select("corpus_id", F.col("form").alias("key"), "form").distinct(), sections).select("corpus_id", "form", "doc_id").distinct())
    counts = met.groupBy("corpus_id", "form").agg(F.count("*").alias("n"))
    own = forms.join(counts, ["corpus_id", "form"]).groupBy("corpus_id", "key").agg(F.max(F.struct("n", "form")).alias("top"), F.collect_set("form").alias("forms"))
    own = saved(own.select("corpus_id", "key", F.col("top.n").alias("n"), F.col("top.form").alias("top"), "forms"))
    others = own.where(F.size("forms") > 1).select("corpus_id", "key", "top", F.explode("forms").alias("form")).where("form <> top")
    beside = others.join(met, ["corpus_id", "form"]).select("corpus_id", "key", "doc_id", "top").distinct()
    beside = beside.join(met.withColumnRenamed("form", "top"), ["corpus_id", "top", "doc_id"], "left_anti").groupBy("corpus_id", "key").agg(F.count("*").alias("more"))
    out = own.join(beside, ["corpus_id", "key"], "left")
    return out.select("corpus_id", F.col("key").alias("id"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("n_text_chapters"))


def text_spread(nodes: DataFrame, alias_groups: DataFrame, sections: DataFrame, shared: list[str], kind: str = "Character") -> DataFrame:
    """nodes with n_text_chapters: for nodes of the kind, sections that hold the name or an alias of alias_groups(corpus_id,
    canon, variant). Forms of shared words alone are not looked for. Others have 0."""
    people = nodes.where(F.col("type") == kind).select("corpus_id", F.col("id").alias("key"))
    names = people.select("corpus_id", "key", F.col("key").alias("name"))
    names = names.union(people.join(alias_groups.select("corpus_id", F.col("canon").alias("key"), "variant"), ["corpus_id", "key"]).select("corpus_id", "key", "variant"))
    forms = names.select("corpus_id", "key", norm(F.col("name")).alias("form")).where("form <> ''")
    forms = forms.where(F.size(F.array_except(words(F.col("form")), F.array(*map(F.lit, shared)) if shared else F.array().cast("array<string>"))) > 0)
    spread = spread_of(forms.withColumn("form", F.lower("form")).distinct(), sections)
    return nodes.join(spread, ["corpus_id", "id"], "left").withColumn("n_text_chapters", F.coalesce("n_text_chapters", F.lit(0)))


def flag_hubs(nodes: DataFrame, min_sections: int = 50) -> DataFrame:
    return nodes.withColumn("is_hub", F.col("n_text_chapters") >= min_sections)


def top_hubs(nodes: DataFrame, k: int = 12) -> DataFrame:
    """The k hubs with the widest spread."""
    return nodes.where("is_hub").orderBy(F.desc("n_text_chapters"), "corpus_id", "id").limit(k).select("corpus_id", "id", "n_text_chapters")


def build_report(audit: DataFrame, rejected: DataFrame, accepted: DataFrame, nodes: DataFrame, edges: DataFrame, triples: DataFrame | None = None) -> DataFrame:
    """(measure, value): triples raw, kept and dropped by reason, aliases, nodes, edges, nodes by type; with triples, the
    sections and passes that they come from, and how many sections were read in how many passes."""
    row = lambda name, df: df.agg(F.count("*").alias("value")).select(F.lit(name).alias("measure"), "value")
    parts = [
        audit.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("value")).select(F.lit("triples raw").alias("measure"), "value"),
        audit.select(F.concat(F.lit("triples "), "reason").alias("measure"), F.col("n").alias("value")),
        row("aliases accepted", accepted), row("aliases rejected", rejected), row("nodes", nodes), row("edges", edges),
        nodes.groupBy("type").agg(F.count("*").alias("value")).select(F.concat(F.lit("nodes "), "type").alias("measure"), "value"),
    ]
    if triples is not None:
        read = triples.select("corpus_id", "doc_id", "pass").distinct()
        parts += [row("sections", read.select("corpus_id", "doc_id").distinct()), row("passes", read.select("pass").distinct()), row("sections x passes", read)]
    return reduce(DataFrame.union, parts)
