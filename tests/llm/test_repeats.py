"""Results of stages side by side, and documents that repeat in their thousands."""

from collections import Counter

from pyspark.sql import functions as F


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars int, text string")


def test_two_results_of_a_stage(spark, tmp_path):
    """A result can be read after another call of its stage, until its tables are dropped."""
    from loregraph.llm import stages
    from loregraph.llm.common import dropped

    docs = documents(spark, [(i, f"s{i % 3}", "en", 20, " ".join(f"{(i * 7919 + j * 104729) % 99991:x}" for j in range(8))) for i in range(30)])
    a = stages.mixing(spark, docs, str(tmp_path))
    b = stages.mixing(spark, docs.where("doc_id < 12"), str(tmp_path))
    c = stages.line_dedup(spark, docs, str(tmp_path))
    mix = sorted((r.doc_id, r.mix_copies) for r in a.collect())
    assert b.count() > 0 and c.count() == 30 and sorted((r.doc_id, r.mix_copies) for r in a.where("true").collect()) == mix
    assert a.reads and all(t.saved_at for t in a.reads)
    dropped(*b.reads, *c.reads)
    assert a.count() == len(mix)


def test_rows_that_repeat_in_blocks(spark, monkeypatch):
    """Alike rows, null keys and texts of equal size among them, share their copies evenly over many blocks."""
    from loregraph.llm import mixing

    monkeypatch.setattr(mixing, "BLOCK", 7)
    rows = [(None, None, None, None, f"two words{i % 2}") for i in range(300)] + [(i, "b", "en", 1, f"three short words {i}") for i in range(40)] + [(7, "c", "en", 1, "again and again")] * 61
    docs = documents(spark, rows).repartition(5)
    plan = mixing.mix_plan(docs).collect()
    assert len(plan) == len(rows)
    for source, times in ((None, 300), ("c", 61)):
        own = [r.copies for r in plan if r.source == source and r.doc_id in (None, 7)]
        units = mixing.mix_units(docs).where(F.col("source").eqNullSafe(F.lit(source))).collect()
        assert len(own) == times and max(own) - min(own) <= 1 and sum(own) == sum(u.copies for u in units)
    got = mixing.mixed(docs)
    taken = Counter((r.source, r.doc_id, r.mix_copies) for r in got.collect())
    want = Counter((r.source, r.doc_id, r.copies) for r in plan if r.copies)
    assert taken == want and got.columns == [*docs.columns, "mix_copies"]
