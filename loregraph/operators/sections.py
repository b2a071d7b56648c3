"""Sections of long ordered texts, and chunks of sections.

Lines come as (corpus_id, line_no, line). Heading rules are a parameter; the defaults read PART / Book / EPILOGUE / Chapter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loregraph.functions.tables import numbered, saved
from loregraph.functions.text import collapse, flat, roman_to_int, strip


@dataclass(frozen=True)
class Headings:
    """Patterns with one group for the number (book: a second one for the title); null switches a kind off."""

    part: str | None = r"^PART ([IVXL]+)\s*$"
    book: str | None = r"^Book ([IVXL]+)\.\s*(.*)$"
    epilogue: str | None = r"^EPILOGUE\s*$"
    chapter: str = r"^Chapter ([IVXL]+)\.\s*$"
    epilogue_no: int = 13
    epilogue_title: str = "Epilogue"
    roman: bool = True


def classify_lines(lines: DataFrame, rules: Headings = Headings()) -> DataFrame:
    """Adds kind (part, book, epilogue, chapter or null), number, title."""
    number = roman_to_int if rules.roman else (lambda c: c.try_cast("int"))
    kind, value, title = F.lit(None).cast("string"), F.lit(None).cast("int"), F.lit(None).cast("string")
    for name in ("chapter", "epilogue", "book", "part"):
        pattern = getattr(rules, name)
        if pattern is None:
            continue
        hit = F.col("line").rlike(pattern)
        kind = F.when(hit, F.lit(name)).otherwise(kind)
        if name == "epilogue":
            value, title = F.when(hit, F.lit(rules.epilogue_no)).otherwise(value), F.when(hit, F.lit(rules.epilogue_title)).otherwise(title)
        else:
            value = F.when(hit, number(F.regexp_extract("line", pattern, 1))).otherwise(value)
            title = F.when(hit, strip(F.regexp_extract("line", pattern, 2))).otherwise(title) if name == "book" else F.when(hit, F.lit(None)).otherwise(title)
    return lines.withColumn("kind", kind).withColumn("number", value).withColumn("title", title)


#: Lines of a block of the scan.
BLOCK = 4096
#: What a line is to the scan: blank, no heading, a chapter's, a book's or an epilogue's, a part's heading.
_BLANK, _PLAIN, _CHAPTER, _BOOK, _PART = range(5)
#: States: outside titles, after a chapter's heading with its title still to come, in a title.
_OUT, _DUE, _IN = range(3)


def _after(state: int, line: int) -> int:
    if line == _BLANK:
        return _DUE if state == _DUE else _OUT
    if state != _OUT:
        return _IN
    return _DUE if line == _CHAPTER else _OUT


#: By state and line.
_STEP = [[_after(s, c) for c in range(5)] for s in range(3)]


def _exits(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state after each block for each state before it."""
    for table in tables:
        out = []
        for kinds in table.column("kinds").to_pylist():
            ends = [_OUT, _DUE, _IN]
            for c in kinds:
                ends = [_STEP[s][c] for s in ends]
            out.append(ends)
        yield pa.RecordBatch.from_arrays([table.column("corpus_id"), table.column("block"), pa.array(out, pa.list_(pa.int32()))], names=["corpus_id", "block", "exits"])


def _entries(key: tuple, table: pa.Table) -> pa.Table:
    """The state before each block of a corpus."""
    table = table.sort_by("block")
    state, out = _OUT, []
    for ends in table.column("exits").to_pylist():
        out.append(state)
        state = ends[state]
    return pa.table({"corpus_id": table.column("corpus_id"), "block": table.column("block"), "entry": pa.array(out, pa.int32())})


def _applied(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each line's part: whether it is in a title or a heading, how many chapters have begun in the block and what heading came last."""
    for table in tables:
        for corpus, block, entry, numbers, kinds in zip(*[table.column(c).to_pylist() for c in ("corpus_id", "block", "entry", "numbers", "kinds")]):
            state, chapters, inside = entry, 0, None
            titles, heads, count, last = [], [], [], []
            for c in kinds:
                head = state == _OUT and c > _PLAIN
                state = _STEP[state][c]
                if head:
                    chapters += c == _CHAPTER
                    inside = inside if c == _PART else c == _CHAPTER
                titles.append(state == _IN)
                heads.append(head)
                count.append(chapters)
                last.append(inside)
            n = len(kinds)
            yield pa.RecordBatch.from_arrays(
                [pa.array([corpus] * n, pa.string()), pa.array([block] * n, pa.int64()), pa.array(numbers, pa.int64()), pa.array(titles), pa.array(heads), pa.array(count, pa.int64()), pa.array(last, pa.bool_())],
                names=["corpus_id", "block", "line_no", "in_title", "is_head", "chapters", "in_chapter"],
            )


def scan_lines(marked: DataFrame) -> DataFrame:
    """(corpus_id, line_no, in_title, is_head, global_index, in_chapter) of classified lines(corpus_id, line_no, line, kind).

    The scan is that of a machine of three states. Lines are dealt to blocks of BLOCK lines; each block is turned into the map from the
    state before it to the state after it; these maps, one small row a block, are followed through each corpus; then the blocks are
    gone through again from their states, and counts are carried over blocks.
    """
    kind = F.when(strip(F.col("line")) == "", _BLANK).when(F.col("kind") == "chapter", _CHAPTER).when(F.col("kind").isin("book", "epilogue"), _BOOK).when(F.col("kind") == "part", _PART).otherwise(_PLAIN)
    slim = marked.select("corpus_id", F.col("line_no").cast("long").alias("line_no"), F.when(F.col("line").isNull(), _BLANK).otherwise(kind).alias("c"))
    placed = numbered(slim, ["corpus_id"], ["line_no"]).withColumn("block", F.floor(F.col("pos") / BLOCK))
    rows = F.array_sort(F.collect_list(F.struct("pos", "line_no", "c")))
    blocks = saved(placed.groupBy("corpus_id", "block").agg(rows.alias("x")).select("corpus_id", "block", F.col("x.line_no").alias("numbers"), F.col("x.c").alias("kinds")))
    exits = blocks.select("corpus_id", "block", "kinds").mapInArrow(_exits, "corpus_id string, block long, exits array<int>")
    entries = exits.groupBy("corpus_id").applyInArrow(_entries, "corpus_id string, block long, entry int")
    schema = "corpus_id string, block long, line_no long, in_title boolean, is_head boolean, chapters long, in_chapter boolean"
    told = saved(blocks.join(entries, ["corpus_id", "block"]).mapInArrow(_applied, schema))
    so_far = Window.partitionBy("corpus_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = told.groupBy("corpus_id", "block").agg(F.max("chapters").alias("n"), F.max_by("in_chapter", F.when(F.col("in_chapter").isNotNull(), F.col("line_no"))).alias("last"))
    carried = sums.select("corpus_id", "block", F.coalesce(F.sum("n").over(so_far), F.lit(0)).alias("before"), F.last("last", ignorenulls=True).over(so_far).alias("was"))
    return told.join(carried, ["corpus_id", "block"]).select("corpus_id", "line_no", "in_title", "is_head", (F.col("chapters") + F.col("before")).alias("global_index"), F.coalesce("in_chapter", "was", F.lit(False)).alias("in_chapter"))


def assign_sections(lines: DataFrame, rules: Headings = Headings()) -> DataFrame:
    """One row a section: corpus_id, doc_id, global_index, part, book_no, book_title, chapter_no, chapter_title, label,
    n_chars, text.

    A chapter's title is the first block of non-blank lines after its heading; lines in it are no headings. A book or
    epilogue heading ends the chapter before it; what follows up to the next chapter heading is dropped. A corpus may be of any
    length, a section is one row. A null line is blank; line numbers of a corpus are distinct.
    """
    marked = classify_lines(lines, rules)
    scan = saved(scan_lines(marked))
    own = marked.withColumn("line_no", F.col("line_no").cast("long"))
    heads = own.where("kind is not null").select("corpus_id", "line_no", "kind", "number", "title").join(scan.where("is_head").select("corpus_id", "line_no", "global_index"), ["corpus_id", "line_no"])
    # headings alone, which are few beside the lines
    up_to = Window.partitionBy("corpus_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    is_ = lambda *k: F.col("kind").isin(*k)
    heads = heads.select(
        "corpus_id", "global_index", "kind", F.col("number").alias("chapter_no"),
        F.last(F.when(is_("part"), F.col("number")), ignorenulls=True).over(up_to).alias("part"),
        F.last(F.when(is_("book", "epilogue"), F.struct("number", "title")), ignorenulls=True).over(up_to).alias("book"),
    ).where("kind = 'chapter'").drop("kind")
    inside = scan.where("in_chapter and (in_title or not is_head)").select("corpus_id", "line_no", "in_title", "global_index")
    rows = own.select("corpus_id", "line_no", "line").join(inside, ["corpus_id", "line_no"])
    joined = lambda rows, sep: F.array_join(F.transform(F.array_sort(F.collect_list(rows)), lambda r: r["line"]), sep)
    texts = rows.groupBy("corpus_id", "global_index").agg(
        joined(F.when(F.col("in_title"), F.struct("line_no", strip(F.col("line")).alias("line"))), " ").alias("chapter_title"),
        joined(F.when(~F.col("in_title"), F.struct("line_no", F.coalesce("line", F.lit("")).alias("line"))), "\n").alias("raw"),
    )
    out = heads.join(texts, ["corpus_id", "global_index"], "left").withColumns({c: F.coalesce(c, F.lit("")) for c in ("chapter_title", "raw")})
    text = strip(F.regexp_replace("raw", "\n{3,}", "\n\n"))
    return out.select(
        "corpus_id", F.format_string("ch%03d", "global_index").alias("doc_id"), F.col("global_index").cast("int").alias("global_index"), "part",
        F.col("book.number").alias("book_no"), F.col("book.title").alias("book_title"), "chapter_no", "chapter_title",
        F.concat(F.coalesce(F.col("book.number").cast("string"), F.lit("-")), F.lit(" "), F.coalesce(F.col("chapter_no").cast("string"), F.lit("-"))).alias("label"),
        F.length(text).alias("n_chars"), text.alias("text"),
    )


def check_sections(sections: DataFrame, expected: int | None = None, short: int = 500) -> tuple[DataFrame, DataFrame]:
    """(violations, summary). Violations: corpora with another number of sections than expected, books whose chapters are
    not 1..k in order, sections of fewer than `short` characters."""
    totals = sections.groupBy("corpus_id").agg(F.count("*").alias("n_sections"), F.sum("n_chars").cast("long").alias("n_chars"))
    by_book = Window.partitionBy("corpus_id", "book_no").orderBy("global_index")
    gaps = sections.withColumn("due", F.row_number().over(by_book)).where("not (chapter_no <=> due)")
    out = gaps.groupBy("corpus_id", "book_no").agg(F.count("*").alias("n")).select("corpus_id", F.lit("chapters out of order").alias("what"), F.concat(F.lit("book "), F.coalesce(F.col("book_no").cast("string"), F.lit("-"))).alias("where"))
    out = out.union(sections.where(F.col("n_chars") < short).select("corpus_id", F.lit("short section"), "doc_id"))
    if expected is not None:
        out = out.union(totals.where(F.col("n_sections") != expected).select("corpus_id", F.lit("number of sections"), F.col("n_sections").cast("string")))
    return out, totals


def _pieces(sections: DataFrame, body: Column, pieces: Column, step: int) -> DataFrame:
    rows = sections.withColumn("_body", body).select(*[c for c in sections.columns if c != "text"], F.posexplode(pieces).alias("chunk_no", "text"))
    return rows.select(*[c for c in rows.columns if c != "text"], (F.col("chunk_no") * step).alias("start"), "text")


def chunk_overlap(sections: DataFrame, chunk: int = 12000, overlap: int = 1000) -> DataFrame:
    """Windows of `chunk` characters of the flat text, each `chunk - overlap` after the one before; a text that fits is
    one, even if empty. (…, chunk_no, start, text). A text is read once: a match is a step, what it looks ahead at a window."""
    step = chunk - overlap
    windows = F.regexp_extract_all("_body", F.lit(f"(?s)(?=(.{{1,{chunk}}})).{{1,{step}}}"), F.lit(1))
    return _pieces(sections, flat(F.coalesce("text", F.lit(""))), F.when(F.length("_body") <= chunk, F.array("_body")).otherwise(windows), step)


def chunk_fixed(sections: DataFrame, size: int = 2000, min_len: int = 200) -> DataFrame:
    """Pieces of `size` characters of the collapsed, untrimmed text; pieces shorter than min_len are dropped."""
    pieces = F.regexp_extract_all("_body", F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    return _pieces(sections, collapse(F.coalesce("text", F.lit(""))), pieces, size).where(F.length("text") >= min_len)


def todo_sections(sections: DataFrame, extractions: DataFrame, pass_name: str, only: list | None = None) -> DataFrame:
    """Sections without a result in this pass; `only` lists doc_ids or numbers."""
    if only:
        names = [x for x in only if isinstance(x, str)]
        numbers = [x for x in only if not isinstance(x, str)]
        sections = sections.where(F.col("doc_id").isin(names) | F.col("global_index").isin(numbers))
    done = extractions.where(F.col("pass") == pass_name).select("corpus_id", "doc_id").distinct()
    return sections.join(done, ["corpus_id", "doc_id"], "left_anti")
