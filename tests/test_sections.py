import re

from loregraph.operators import sections as S

RAW = """preface
PART I
Book I. The  First
dropped line

Chapter I.
A Title
in two lines

body one


PART II
body two
Chapter II.
Chapter III.

text of two
Book II. Second
dropped too
Chapter I.

One More

last

EPILOGUE
no section
Chapter I.

End

the end
*** END
after"""


def lines(spark, raw=RAW, corpus="c"):
    return spark.createDataFrame([(corpus, i, x) for i, x in enumerate(raw.split("\n"))], "corpus_id string, line_no int, line string")


def test_sections(spark, tmp_path):
    from loregraph.sources import files

    (tmp_path / "book.txt").write_text(RAW)
    (tmp_path / "none.txt").write_text("no marker")
    cut = files.read_lines(spark, str(tmp_path), "PART I", "*** END")
    assert {r.corpus_id for r in cut.collect()} == {"book"}
    got = S.assign_sections(cut).orderBy("global_index").collect()
    assert [(r.doc_id, r.part, r.book_no, r.book_title, r.chapter_no, r.chapter_title, r.text) for r in got] == [
        ("ch001", 1, 1, "The  First", 1, "A Title in two lines", "body one\n\nbody two"),
        ("ch002", 2, 1, "The  First", 2, "Chapter III.", "text of two"),
        ("ch003", 2, 2, "Second", 1, "One More", "last"),
        ("ch004", 2, 13, "Epilogue", 1, "End", "the end"),
    ]
    assert [r.label for r in got] == ["1 1", "1 2", "2 1", "13 1"] and [r.n_chars for r in got] == [18, 11, 4, 7]
    assert "text" not in files.section_index(S.assign_sections(cut)).columns


def test_chains_of_headings(spark):
    raw = "Chapter I.\n\nChapter II.\n\nChapter III.\n\nChapter IV.\nx\n\ny"
    got = S.assign_sections(lines(spark, raw)).orderBy("global_index").collect()
    assert [(r.chapter_no, r.chapter_title, r.text) for r in got] == [(1, "Chapter II.", ""), (3, "Chapter IV. x", "y")]


def test_checks(spark):
    rows = S.assign_sections(lines(spark))
    bad, totals = S.check_sections(rows, expected=5)
    assert totals.first().n_sections == 4
    assert {(r.what) for r in bad.collect()} == {"short section", "number of sections"}
    gap, _ = S.check_sections(rows.where("global_index <> 1"), short=0)
    assert [(r.what, r["where"]) for r in gap.collect()] == [("chapters out of order", "book 1")]


def test_chunks(spark):
    texts = ["", "a" * 5, "ab " * 40, " x  " + "y" * 300]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    for chunk, over in ((50, 10), (119, 1)):
        want = set()
        for i, t in enumerate(texts):
            t = re.sub(r"\s+", " ", t).strip()
            starts = [0] if len(t) <= chunk else range(0, len(t), chunk - over)
            want |= {(i, n, s, t[s : s + chunk]) for n, s in enumerate(starts)}
        assert {tuple(r) for r in S.chunk_overlap(df, chunk, over).select("doc_id", "chunk_no", "start", "text").collect()} == want
    want = set()
    for i, t in enumerate(texts):
        t = re.sub(r"\s+", " ", t)
        want |= {(i, t[s : s + 100]) for s in range(0, len(t), 100) if len(t[s : s + 100]) >= 20}
    assert {(r.doc_id, r.text) for r in S.chunk_fixed(df, 100, 20).collect()} == want


def test_todo(spark):
    s = spark.createDataFrame([("c", f"ch{i:03d}", i) for i in range(1, 6)], "corpus_id string, doc_id string, global_index int")
    done = spark.createDataFrame([("c", "ch002", "p1"), ("c", "ch003", "p2")], "corpus_id string, doc_id string, pass string")
    ids = lambda df: sorted(r.global_index for r in df.collect())
    assert ids(S.todo_sections(s, done, "p1")) == [1, 3, 4, 5]
    assert ids(S.todo_sections(s, done, "p1", ["ch002", "ch004", 5])) == [4, 5]


def plain_sections(lines):
    """The sections of one corpus by a scan line by line."""
    out, inside, part, book, due, titled = [], False, None, None, False, False
    number = lambda s: {"I": 1, "II": 2, "IV": 4}[s]
    for x in lines:
        if titled or due:
            if x.strip():
                out[-1]["title"].append(x.strip())
                due, titled = False, True
                continue
            if titled:
                titled = False
        if m := re.match(r"PART ([IVXL]+)\s*$", x):
            part = number(m[1])
        elif m := re.match(r"Book ([IVXL]+)\.\s*(.*)$", x):
            book, inside = (number(m[1]), m[2].strip()), False
        elif re.match(r"EPILOGUE\s*$", x):
            book, inside = (13, "Epilogue"), False
        elif m := re.match(r"Chapter ([IVXL]+)\.\s*$", x):
            out.append({"no": number(m[1]), "part": part, "book": book, "title": [], "text": []})
            inside, due = True, True
        elif inside:
            out[-1]["text"].append(x)
    return [(s["part"], *(s["book"] or (None, None)), s["no"], " ".join(s["title"]), re.sub(r"\n{3,}", "\n\n", "\n".join(s["text"])).strip()) for s in out]


def test_sections_over_many_blocks(spark, monkeypatch):
    """Headings, titles and chains of headings across the borders of blocks of any size."""
    import random

    r = random.Random(8)
    kinds = ["", "", " ", "plain", "more  text", "Chapter I.", "Chapter IV.", "Book II. Of it", "EPILOGUE", "PART II", "PART I"]
    corpora = {f"c{k}": [r.choice(kinds if k % 2 else kinds[:1] + kinds[5:7] + kinds[3:4]) for _ in range(r.randint(1, 120))] for k in range(8)}
    rows = [(c, i * 3, x) for c, xs in corpora.items() for i, x in enumerate(xs)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "corpus_id string, line_no int, line string").repartition(3)
    want = {c: plain_sections(xs) for c, xs in corpora.items()}
    for block in (1, 4, 4096):
        monkeypatch.setattr(S, "BLOCK", block)
        got = {}
        for x in S.assign_sections(df).orderBy("global_index").collect():
            got.setdefault(x.corpus_id, []).append((x.part, x.book_no, x.book_title, x.chapter_no, x.chapter_title, x.text))
            assert x.global_index == len(got[x.corpus_id])
        assert got == {c: v for c, v in want.items() if v} and sum(map(len, got.values())) > 60


def test_chunks_of_a_very_long_text(spark):
    """Pieces are cut in one pass: a text eight times as long takes no sixty-four times the time."""
    import time

    from pyspark.sql import functions as F

    one = spark.range(1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ab é 漢字 "), 1_000_000).alias("text"))
    began = time.time()
    got = S.chunk_fixed(one).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("c"), F.max("start").alias("s")).first()
    assert (got.n, got.c, got.s) == (4000, 8_000_000, 7_998_000)
    got = S.chunk_overlap(one, 3000, 500).agg(F.count("*").alias("n"), F.max("start").alias("s"), F.min(F.length("text")).alias("m")).first()
    assert (got.n, got.s, got.m) == (3200, 7_997_500, 2_499) and time.time() - began < 60


def test_lines_of_a_file_cut_among_tasks(spark, tmp_path):
    """Line numbers go on over the blocks of a file, with line breaks of any kind."""
    from loregraph.sources import files

    want = [f"line {i}" * (i % 7) for i in range(3000)]
    (tmp_path / "a.txt").write_bytes("".join(x + ("\n", "\r\n", "\r")[i % 3] if x else x + "\n" for i, x in enumerate(want)).replace("\r\n\n", "\r\n \n").encode())
    text = (tmp_path / "a.txt").read_bytes().decode()
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        read = files.read_lines(spark, str(tmp_path))
        got = sorted((x.line_no, x.line) for x in read.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == list(enumerate(re.split("\r\n|\r|\n", text)[:-1]))
