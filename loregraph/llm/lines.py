"""Line dedup: fuzzy lines by MinHash, with DataFrame functions only.

A line's set: all its windows of WINDOW characters (lower-cased and trimmed; a shorter line is its own window). Lines whose
sets have a Jaccard similarity of 0.8 or more are linked; union-find over the links gives components; of each the first line
stays, by doc_id and place. All similarities are exact, over all windows; only the candidates are found by chance.

Candidates: a line's sketch is the smallest hashes of its windows in order; bands are runs of neighbours in that order, so
that a window that differs breaks only the runs around it. Long lines have many windows, so theirs are chosen by content:
LONG_WINDOW characters that begin with a space. Lines with few of these, in any script, have bands of all windows, those in
between have both kinds. At a similarity of 0.80 to 0.85 more than 99% of pairs share a band, above it 99.8%.

Blank lines stay as they are. Null text stays null. A document that had lines and lost all of them is dropped from
`deduplicated` (its lines stand elsewhere), but `line_counts` reports it. Repeated rows of a document count once: all of them
lose the same lines. A null doc_id comes first in the order. Very long lines are lines like others. An empty table gives no
row. Columns other than doc_id and text are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loregraph.llm.common import dropped, free_names, recorded, saved
from loregraph.llm.linking import link, prefix_lists

WINDOW, LONG_WINDOW = 5, 10
#: What chosen windows begin with.
BEGIN = " "
#: Bands: (least and most windows of a set + 1, hashes of the sketch, neighbours, anchor: runs begin at hashes that it divides).
CHOSEN_BANDS = ((24, 60, 60, 3, 3), (48, None, 60, 3, 5))
ALL_BANDS = ((0, 30, 30, 3, 1), (24, 60, 60, 4, 3), (48, None, 60, 4, 6))
#: Sets with fewer chosen windows than this have bands of all windows.
FEW = 30
#: log2 of the cells of the filter that keeps most rows that are not wanted from being moved (2 MB).
FILTER_BITS = 23
#: Rounds in which bands are dealt out.
ROUNDS = 4


def normal(line: Column) -> Column:
    return F.lower(F.trim(line))


def windows(line: Column) -> Column:
    """The distinct hashes of the windows of a normalised line."""
    found = F.regexp_extract_all(line, F.lit(rf"(?s)(?=(.{{{WINDOW}}}))"), F.lit(1))
    return F.when(F.length(line) <= WINDOW, F.array(F.xxhash64(line))).otherwise(F.array_distinct(F.transform(found, lambda w: F.xxhash64(w))))


def chosen_windows(line: Column) -> Column:
    """The distinct hashes of the long windows of a normalised line that begin with BEGIN."""
    found = F.regexp_extract_all(line, F.lit(rf"(?s){BEGIN}(?=(.{{{LONG_WINDOW - 1}}}))"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda w: F.xxhash64(w)))


def _bands(hashes: str, kinds: tuple, salt: int) -> Column:
    """Tokens of the smallest of a column of distinct hashes in ascending order, for the kinds that fit their number.

    A column, not an expression: what a lambda refers to is computed anew for each element."""
    sketch, none, out = F.col(hashes), F.array().cast("array<bigint>"), []
    for k, (low, high, most, run, anchor) in enumerate(kinds):
        starts = F.sequence(F.lit(1), F.greatest(F.least(F.size(sketch), F.lit(most)) - (run - 1), F.lit(1)))
        if anchor > 1:
            starts = F.filter(starts, lambda i: F.element_at(sketch, i) % anchor == 0)
        fits = (F.size(sketch) >= low) & (F.lit(True) if high is None else F.size(sketch) < high)
        out.append(F.when(fits, F.transform(starts, lambda i: F.xxhash64(F.lit(salt + k), F.slice(sketch, i, F.lit(run))))).otherwise(none))
    return F.concat(*out)


def doc_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, doc_key, line_no, line, id, id2) for each line of docs that is not blank; doc_key is a hash of the document's
    id and text, id and id2 are hashes of the normalised line."""
    key = F.xxhash64("doc_id", "text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    rows = rows.select("doc_id", key.alias("doc_key"), F.posexplode(F.split("text", "\n")).alias("line_no", "raw"))
    rows = rows.select("doc_id", "doc_key", "line_no", normal(F.col("raw")).alias("line")).where("line <> ''")
    return rows.withColumn("id", F.xxhash64("line")).withColumn("id2", F.xxhash64(F.lit(2), "line"))


def only_cells(rows: DataFrame, column: str, wanted: DataFrame, hit: str, bits: int = FILTER_BITS) -> DataFrame:
    """rows with the column `hit`, false where the column's value is surely not in wanted(v): by a table of fixed size that
    is broadcast."""
    at, found = free_names([*rows.columns, hit], "_cell", "_bits")
    cell = F.col("v").bitwiseAND(F.lit((1 << bits) - 1))
    mask = wanted.select(F.shiftright(cell, 6).alias(at), F.expr("shiftleft(1L, cast(v & 63 as int))").alias("bit")).groupBy(at).agg(F.bit_or("bit").alias(found))
    met = rows.withColumn(at, F.shiftright(F.col(column).bitwiseAND(F.lit((1 << bits) - 1)), 6)).join(F.broadcast(saved(mask, few=True)), at, "left")
    return met.withColumn(hit, F.expr(f"coalesce(({found} & shiftleft(1L, cast(`{column}` & 63 as int))) <> 0, false)")).drop(at, found)


def line_groups(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines, roots), saved: lines(doc_id, doc_key, line_no, id, id2) that are not blank, roots(id, id2, root) of those that
    have near copies."""
    place = ["doc_id", "doc_key", "line_no", "id", "id2"]
    found = doc_lines(docs).select(*place, "line", F.sort_array(chosen_windows(F.col("line"))).alias("chosen"))
    found = found.select(*place, "chosen", F.when(F.size("chosen") < FEW, F.sort_array(windows(F.col("line")))).alias("all"))
    found = found.select(*place, _bands("chosen", CHOSEN_BANDS, 10).alias("long"), F.when(F.col("all").isNotNull(), _bands("all", ALL_BANDS, 20)).alias("short"))
    sketch = saved(found)
    lists = sketch.select("id", F.explode(F.concat("long", F.coalesce("short", F.array().cast("array<bigint>")))).alias("token"))
    texts: list[DataFrame] = []

    def prepare(ids: DataFrame) -> DataFrame:
        near = only_cells(doc_lines(docs).select("id", "line"), "id", ids.withColumnRenamed("id", "v"), "hit").where("hit").join(ids, "id", "left_semi")
        texts.append(saved(near.groupBy("id").agg(F.min("line").alias("line")).select("id", "line", F.size(windows(F.col("line"))).alias("size"))))
        return texts[0].select("id", "size")

    def crowded(ids: DataFrame) -> DataFrame:
        sets = saved(texts[0].join(ids.select("id"), "id", "left_semi").select("id", "size", windows(F.col("line")).alias("set")))
        return saved(prefix_lists(sets.select("id", F.explode("set").alias("element")), sets.select("id", "size"), 4, 5))

    def verify(pairs: DataFrame) -> DataFrame:
        a, b = (texts[0].select(F.col("id").alias(x), F.col("line").alias(f"l{x}"), F.col("size").alias(f"n{x}")) for x in "ab")
        met = pairs.join(a, "a").join(b, "b").where(F.least("na", "nb") * 5 >= F.greatest("na", "nb") * 4)
        met = met.select("a", "b", "na", "nb", F.size(F.array_intersect(windows(F.col("la")), windows(F.col("lb")))).alias("inter"))
        return met.where("inter * 5 >= (na + nb - inter) * 4").select("a", "b")

    # bands say nothing of sizes: only strays meet by theirs, which `prepare` counts
    roots = link(lists, verify, prepare=prepare, crowded=[crowded], rounds=ROUNDS)
    return sketch.select(*place), saved(roots.join(texts[0], "id").select("id", F.xxhash64(F.lit(2), "line").alias("id2"), "root"), few=True)


def removed_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, doc_key, gone), saved: the places of the lines that leave each document."""
    with recorded() as tables:
        lines, roots = line_groups(docs)
        lines = lines.select("id", "id2", F.struct("doc_id", "line_no", "doc_key").alias("at"))
        # equal lines without a near copy are one group too; own tells different lines of one hash apart
        placed = saved(lines.join(roots, ["id", "id2"], "left").select(F.coalesce("root", "id").alias("root"), F.when(F.col("root").isNull(), F.col("id2")).alias("own"), "at"))
        first = saved(placed.groupBy("root", "own").agg(F.min("at").alias("first"), F.max("at").alias("last")).where("first <> last").select("root", "own", "first"))
        met = placed.join(first.withColumnRenamed("own", "_own"), "root").where("own <=> _own and at <> first").select("at.doc_id", "at.doc_key", "at.line_no").distinct()
        gone = saved(met.groupBy("doc_id", "doc_key").agg(F.collect_list("line_no").alias("gone")))
    dropped(*[t for t in tables if t is not gone])
    return gone


def _with_gone(docs: DataFrame, gone: str) -> DataFrame:
    """docs with the column `gone`, the places of the lines that leave, null for none."""
    key, hit, doc = free_names([*docs.columns, gone], "_key", "_hit", "_doc")
    table = removed_lines(docs.select("doc_id", "text")).toDF(doc, f"{key}_", gone)
    keyed = docs.withColumn(key, F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    keyed = only_cells(keyed, key, table.select(F.col(f"{key}_").alias("v")), hit)
    safe = keyed.where(~F.col(hit)).select(*docs.columns, F.lit(None).cast("array<int>").alias(gone))
    met = keyed.where(F.col(hit)).join(table, (F.col(key) == F.col(f"{key}_")) & F.col("doc_id").cast("long").eqNullSafe(F.col(doc)), "left")
    return safe.unionByName(met.select(*docs.columns, gone))


def _cleaned(text: Column, gone: Column) -> Column:
    return F.when(gone.isNull(), text).otherwise(F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains(gone, i)), "\n"))


def _solid(text: Column) -> Column:
    """How many lines of a text are not blank."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x) != ""))


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs in all their columns, with text less the repeated lines, without the documents that lost all their lines."""
    (gone,) = free_names(docs.columns, "_gone")
    out = _with_gone(docs, gone)
    emptied = F.col(gone).isNotNull() & (F.size(gone) >= _solid(F.col("text")))
    return out.where(~emptied).withColumn("text", _cleaned(F.col("text").cast("string"), F.col(gone))).select(*docs.columns)


def line_counts(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_lines (not blank), n_removed, kept_chars, kept_md5 of the text that stays."""
    out = _with_gone(docs.select("doc_id", "text"), "gone").withColumn("kept", _cleaned(F.col("text").cast("string"), F.col("gone")))
    return out.select("doc_id", _solid(F.col("text")).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), F.length("kept").cast("long").alias("kept_chars"), F.md5("kept").alias("kept_md5"))
