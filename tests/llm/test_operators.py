"""Each operator against brute force on small tables that hold nulls, empty and long texts, ties, repeats, extra columns."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

DOC = "doc_id long, text string, lang string, source string, n_chars long, id string, size string, token string"


def corpus(seed=1, n=60, vocab=300):
    """Documents with copies, near copies, nulls, empty texts, short texts, odd whitespace and a long text."""
    r = random.Random(seed)
    words = ["w%d" % i for i in range(vocab)]
    base = [" ".join(r.choice(words) for _ in range(r.randint(20, 80))) for _ in range(n)]
    texts = list(base)
    for i in range(0, 12):
        w = base[i].split(" ")
        w[r.randrange(len(w))] = "EDIT"
        texts.append("  ".join(w) if i % 2 else " ".join(w))
    texts += [base[0], base[0], base[1].upper(), None, "", "  \n\t", "one two", "One two", "one two three four", "one two three four", "ünder ärger", " ".join(r.choice(words) for _ in range(4000))]
    texts += [" ".join(f"t{j}" for j in range(k)) for k in (5, 6, 9, 10, 13, 14)] + [" ".join([*(f"t{j}" for j in range(k)), "end"]) for k in (5, 9, 13)]
    return [(i, t, "en" if i % 3 else None, f"s{i % 4}" if i % 7 else None, 0, "x", "y", "z") for i, t in enumerate(texts)]


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def shingles(text, k=5):
    w = words_of(text)
    if not w:
        return set()
    return {tuple(w)} if len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def groups(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOC).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


# 10


def brute_jaccard(rows):
    s = [shingles(t) for _, t, *_ in rows]
    links = [(i, j) for i in range(len(s)) for j in range(i) if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 80 * len(s[i] | s[j])]
    return s, groups(len(s), links)


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_groups(spark, seed):
    from loregraph.llm.jaccard import jaccard_groups

    rows = corpus(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_groups(spark.createDataFrame(rows, DOC)).collect()}
    s, root = brute_jaccard(rows)
    assert got == {i: (len(s[i]), root[i]) for i in range(len(rows))}


def test_jaccard_enumerates_subsets(spark, monkeypatch):
    from loregraph.llm import jaccard

    monkeypatch.setattr(jaccard, "boundary", lambda *a: 10)
    rows = corpus(3, n=12)
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_groups(spark.createDataFrame(rows, DOC)).collect()}
    assert got == dict(enumerate(brute_jaccard(rows)[1]))


def test_jaccard_near_copies_without_their_source(spark):
    """A large group whose members are often less than similar to one another: no link may be lost."""
    from loregraph.llm.jaccard import jaccard_groups

    r = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(90):
        w = list(base)
        for at in r.sample(range(120), r.choice([0, 1, 2, 3, 4]) if i else 3):
            w[at] = f"e{i}_{at}"
        rows.append((i, " ".join(w), None, None, 0, "", "", ""))
    got = {r.doc_id: r.component_id for r in jaccard_groups(spark.createDataFrame(rows, DOC)).collect()}
    assert got == dict(enumerate(brute_jaccard(rows)[1]))


def test_jaccard_one_of_each_group(docs, empty):
    from loregraph.llm.jaccard import jaccard_groups, one_of_each_group

    root = brute_jaccard(corpus())[1]
    left = one_of_each_group(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(set(root))
    assert jaccard_groups(empty).count() == 0 and one_of_each_group(empty).count() == 0


def test_jaccard_rows_with_null_or_shared_ids(spark):
    from loregraph.llm.jaccard import one_of_each_group

    text = lambda a: " ".join(f"{a}{i}" for i in range(60))
    rows = [(3, text("a")), (None, text("a") + " end"), (None, text("b")), (None, None), (None, ""), (5, text("a") + " other"), (5, text("c")), (6, text("d"))]
    left = one_of_each_group(spark.createDataFrame([(i, x, "", "", 0, "", "", "") for i, x in rows], DOC))
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted([rows[i] for i in (0, 2, 3, 4, 6, 7)], key=str)


def test_jaccard_boundary():
    from loregraph.llm.jaccard import boundary, least_overlap, partners

    assert boundary({}, 4, 5) == 0
    assert boundary({3: 1000}, 4, 5) >= 3  # one subset costs less than scanning
    for n in range(1, 30):
        for m in partners(n, 4, 5):
            need = least_overlap(n, m, 4, 5)
            assert 5 * need >= 4 * (n + m - need) and 5 * (need - 1) < 4 * (n + m - need + 1)


# 4


def test_mixing(spark, docs, empty):
    from loregraph.llm.mixing import mix_plan, mixed

    rows = [(i, f"a{i} " * (i % 9 + 1), None, "abcd"[i % 4] if i % 5 else None, 0, "", "", "") for i in range(900)] + [(3, "x y", None, "a", 0, "", "", "")] * 5 + [(1000 + i, t, None, "a", 0, "", "", "") for i, t in enumerate((None, "", " \n"))]
    df = spark.createDataFrame(rows, DOC)
    got = mix_plan(df).collect()
    again = mix_plan(df.repartition(7)).collect()
    key = lambda r: (r.doc_id, r.size, r.source or "", r.copies)
    assert sorted(map(key, got)) == sorted(map(key, again)) and len(got) == len(rows)
    size = Counter()
    for _, t, _, s, *_ in rows:
        size[s] += len(words_of(t))
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    total, full = sum(size.values()), set()
    while True:
        free = {s for s in order if s not in full}
        share = (total - sum(3 * size[s] for s in full)) / max(1, sum(weight[s] for s in free))
        new = {s for s in free if share * weight[s] > 3 * size[s]}
        if not new:
            break
        full |= new
    for s in order:
        mine = [r for r in got if r.source == s]
        target = 3 * size[s] if s in full else share * weight[s]
        assert {r.source_size for r in mine} == {size[s]} and all(abs(r.target - target) < 1e-6 for r in mine)
        assert abs(sum(r.taken for r in mine) - target) <= max(r.size for r in mine)
        assert all(r.taken <= 3 * r.size and r.taken == r.size * r.copies for r in mine)
        assert all(math.floor(target / size[s]) <= r.copies <= math.ceil(target / size[s]) for r in mine if r.size)
    out = mixed(df)
    assert out.columns == [*df.columns, "mix_copies"]
    assert sorted((r.doc_id, r.mix_copies) for r in out.collect()) == sorted((r.doc_id, r.copies) for r in got if r.copies)
    assert mix_plan(empty).count() == 0 and mixed(empty).count() == 0


def test_mixing_keeps_expectations(spark):
    """Over many seeds each document is taken as often as its share says."""
    from loregraph.llm.mixing import rounded

    units = spark.range(40).select(F.lit("a").alias("source"), F.lit(40).cast("long").alias("left"), F.col("id").alias("doc_id"), (1 + F.col("id") % 5).alias("size"), F.lit(1).cast("long").alias("times"), F.lit(0).cast("long").alias("whole"), (0.3 * (1 + F.col("id") % 5)).alias("q"))
    taken = Counter()
    for seed in range(12):
        for r in rounded(units, seed).collect():
            taken[r.doc_id] += r.copies
    assert abs(sum(taken.values()) / (12 * 40) - 0.3) < 0.06


# 3


def brute_tiles(a, b, k):
    used_a, used_b, out = set(), set(), []
    while True:
        best = None
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and i + n not in used_a and j + n not in used_b:
                    n += 1
                if n >= k and (best is None or n > best[2]):
                    best = (i, j, n)
        if best is None:
            return out
        i, j, n = best
        used_a |= set(range(i, i + n))
        used_b |= set(range(j, j + n))
        out.append(best)


def test_tiles_against_brute_force():
    from loregraph.llm.decontam import tiles
    from loregraph.llm.wordhash import mix

    r = random.Random(2)
    for _ in range(200):
        a, b = ([r.randrange(4) for _ in range(r.randrange(0, 30))] for _ in range(2))
        h = lambda x: mix(np.array(x, np.uint64) + np.uint64(7))
        got, want = tiles(h(a), h(b), 3), brute_tiles(a, b, 3)
        assert [t[2] for t in got] == [t[2] for t in want]
        assert got == want


def test_contamination(spark, docs, empty, monkeypatch):
    from loregraph.llm import decontam

    item = " ".join(f"b{i}" for i in range(30))
    w = item.split(" ")
    texts = [f"x y {item} z", " ".join(w[15:] + ["gap"] + w[:15]), " ".join(w[:14]), None, "", "clean text of other words here", item.upper(), " ".join("filler" for _ in range(9000)) + " " + item]
    df = spark.createDataFrame([(i, t, "", "", 0, "", "", "") for i, t in enumerate(texts)] + [(0, texts[0], "", "", 0, "", "", ""), (None, item, "", "", 0, "", "", "")], DOC)
    bench = spark.createDataFrame([(7, item, "q"), (8, "a b c", "q"), (9, None, "q"), (None, "u " * 20, "q")], "item_id long, text string, doc_id string")
    want = sorted([(0, 7, 30), (0, 7, 30), (1, 7, 30), (6, 7, 30), (7, 7, 30), (-1, 7, 30)])
    row = lambda r: (-1 if r.doc_id is None else r.doc_id, r.item_id, r.covered)
    assert sorted(map(row, decontam.contamination(df, bench).collect())) == want
    left = decontam.decontaminated(df, bench)
    assert left.columns == df.columns and sorted(r.doc_id for r in left.collect()) == [2, 3, 4, 5]
    assert decontam.contamination(empty, bench).count() == 0 and decontam.decontaminated(df, bench.where("false")).count() == df.count()
    monkeypatch.setattr(decontam, "SENT_WORDS", 0)
    assert sorted(set(map(row, decontam.contamination(df, bench).collect()))) == sorted(set(want))
    assert sorted(r.doc_id for r in decontam.decontaminated(df, bench).collect()) == [2, 3, 4, 5]


@pytest.mark.parametrize("sent", [2_000_000, 0])
def test_decontaminated_rows_with_null_or_shared_ids(spark, monkeypatch, sent):
    from loregraph.llm import decontam

    monkeypatch.setattr(decontam, "SENT_WORDS", sent)
    item = " ".join(f"b{i}" for i in range(30))
    rows = [(None, f"x {item}"), (None, "clean text of other words here"), (None, None), (4, item), (4, "another clean text of more words"), (5, "clean text of other words here")]
    left = decontam.decontaminated(spark.createDataFrame([(i, x, "", "", 0, "", "", "") for i, x in rows], DOC), spark.createDataFrame([(7, item)], "item_id long, text string"))
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted([rows[i] for i in (1, 2, 4, 5)], key=str)


# 5


def line_set(line, width=5):
    return {line[i : i + width] for i in range(max(1, len(line) - width + 1))}


def test_line_dedup(spark, empty):
    from loregraph.llm.lines import deduplicated, line_counts

    r = random.Random(4)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(400)]
    line = lambda n: " ".join(r.choice(words) for _ in range(n))
    common, long_one = line(40), line(60)
    texts = []
    for i in range(40):
        own = [line(r.randint(8, 30)) for _ in range(3)]
        w = long_one.split(" ")
        w[i % 60] = f"edit{i}"
        texts.append("\n".join([own[0], common if i % 2 else common.upper() + "  ", "", own[1], " ".join(w), own[2]]))
    texts += [texts[0], None, "", "\n\n", common, "漢" * 3 + "字テキスト" * 20, "漢" * 3 + "字テキスト" * 20 + "終"]
    rows = [(i, t, "", "", 0, "", "", "") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOC).repartition(3)
    norm = lambda x: x.strip(" ").lower()
    at = [(i, j, norm(x)) for i, t in enumerate(texts) if t is not None for j, x in enumerate(t.split("\n")) if norm(x)]
    sets = [line_set(x) for _, _, x in at]
    links = [(a, b) for a in range(len(at)) for b in range(a) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    root = groups(len(at), links)
    gone = {(at[k][0], at[k][1]) for k in range(len(at)) if root[k] != k}
    want = {}
    for i, t in enumerate(texts):
        solid = [] if t is None else [j for j, x in enumerate(t.split("\n")) if norm(x)]
        want[i] = (len(solid), sum((i, j) in gone for j in solid))
    got = {r.doc_id: (r.n_lines, r.n_removed) for r in line_counts(df).collect()}
    assert got == want
    kept = {r.doc_id: r.text for r in deduplicated(df).collect()}
    for i, t in enumerate(texts):
        if want[i][0] and want[i][0] == want[i][1]:
            assert i not in kept
        else:
            assert kept[i] == (None if t is None else "\n".join(x for j, x in enumerate(t.split("\n")) if (i, j) not in gone))
    assert deduplicated(df).columns == df.columns and deduplicated(empty).count() == 0 and line_counts(empty).count() == 0


def test_lines_of_a_large_group(spark):
    """Many edits of one line, with the same few words put in and ends cut off: no link may be lost."""
    from loregraph.llm.lines import line_counts

    r = random.Random(1)
    base = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(45)]
    texts = []
    for i in range(150):
        w = list(base)
        for at in r.sample(range(45), r.choice([0, 1, 2, 3, 4, 5]) if i else 3):
            w[at] = r.choice(["the", "of", "and", "zz", "qq"])
        texts.append(" ".join(w[: len(w) - r.choice([0, 0, 0, 2, 6, 10])]))
    sets = [line_set(x) for x in texts]
    root = groups(len(sets), [(a, b) for a in range(len(sets)) for b in range(a) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])])
    got = {x.doc_id: x.n_removed for x in line_counts(spark.createDataFrame([(i, x, "", "", 0, "", "", "") for i, x in enumerate(texts)], DOC)).collect()}
    assert got == {i: int(root[i] != i) for i in range(len(texts))}


def test_lines_with_one_character_edited(spark):
    """Edits of one character, and words that agree only at their beginnings, against sets of all windows of five characters."""
    from loregraph.llm.lines import line_counts

    r = random.Random(8)
    word = lambda a, b: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(a, b)))
    lines = []
    for n in [1, 2, 3, 5, 7, 9, 11, 14, 17, 20, 24, 30, 60] * 6:
        x = " ".join(word(3, 9) for _ in range(n))
        at = r.randrange(len(x))
        lines += [x, x[:at] + "z" + x[at + 1 :]]
    for _ in range(6):  # the same twelve first characters, other tails
        heads = [word(12, 12) for _ in range(8)]
        lines += [" ".join(h + word(7, 7) for h in heads) for _ in range(2)]
    lines += ["漢字" * 40 + word(60, 60), "é" * 3 + word(200, 200), "abc", "abcd", "abcde"]
    sets = [{x[i : i + 5] for i in range(max(1, len(x) - 4))} for x in lines]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    root = groups(len(sets), links)
    assert 40 < len(links) < 78
    got = {x.doc_id: x.n_removed for x in line_counts(spark.createDataFrame([(i, x, "", "", 0, "", "", "") for i, x in enumerate(lines)], DOC)).collect()}
    assert got == {i: int(root[i] != i) for i in range(len(sets))}


# 6


def test_language(spark, empty):
    from loregraph.llm.langid import identified, languages

    r = random.Random(3)
    parts = {"aa": "ba be bi bo bu da de di".split(), "bb": "xro kst plü zrt ngh vxx".split(), "cc": "мо ло ко во ша жи".split()}
    text = lambda k, n: " ".join("".join(r.choice(parts[k]) for _ in range(3)) for _ in range(n))
    rows = [(i, text(k, r.randint(5, 60)), k, "s", 0, "", "", "") for i, k in enumerate(list(parts) * 60)]
    rows += [(500, None, "aa", "", 0, "", "", ""), (501, "", "aa", "", 0, "", "", ""), (502, "12 34 !", "bb", "", 0, "", "", ""), (None, text("bb", 9), None, "", 0, "", "", ""), (503, text("cc", 20000), None, "", 0, "", "", "")]
    df = spark.createDataFrame(rows, DOC)
    got = languages(df).collect()
    by = {x.doc_id: x for x in got}
    assert len(got) == len(rows)
    for i, t, k, *_ in rows:
        x = by[i]
        assert x.held_out == (i is None or zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= x.score <= 1
        assert x.lang_pred == ("und" if i in (500, 501, 502) else k or {None: "bb", 503: "cc"}[i])
    kept = identified(df)
    assert kept.columns == df.columns and {x.doc_id for x in kept.collect()} == {x[0] for x in rows} - {500, 501, 502}
    assert languages(empty).count() == 0
    assert {x.lang_pred for x in languages(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_does_not_use_held_out_labels(spark):
    from loregraph.llm.langid import languages

    rows = [(i, "la la le li" if i % 2 else "xz qz vz kz", "p" if i % 2 else "q", "", 0, "", "", "") for i in range(80)]
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    other = [(i, t, "wrong" if held(i) else k, *x) for i, t, k, *x in rows]
    a, b = (sorted((r.doc_id, r.lang_pred, r.score) for r in languages(spark.createDataFrame(x, DOC)).collect()) for x in (rows, other))
    assert a == b


# 1


def test_resampling(spark, empty):
    from loregraph.llm.importance import kth_largest, resampled

    r = random.Random(6)
    good, bad = [f"g{i}" for i in range(50)], [f"b{i}" for i in range(50)]
    rows = [(i, " ".join(r.choice(bad if i % 4 == 0 else good) for _ in range(60)), "", "", 0, "", "", "") for i in range(200)] + [(300, None, "", "", 0, "", "", ""), (301, "", "", "", 0, "", "", "")]
    labels = spark.createDataFrame([(i, 0 if i % 4 == 0 else 1, 0, 5) for i in range(0, 200, 2)] + [(999, 1, None, 5), (None, 1, 0, 5)], "doc_id long, quality int, toxic int, text int")
    got = {x.doc_id: x for x in resampled(spark.createDataFrame(rows, DOC), labels, 0.7).collect()}
    assert len(got) == 202 and not got[300].selected and got[300].log_weight is None
    assert sum(x.selected for x in got.values()) == round(0.7 * 202)
    assert not any(got[i].selected for i in range(0, 200, 4))
    assert min(got[i].log_weight for i in range(1, 200, 4)) > max(got[i].log_weight for i in range(0, 200, 4))
    assert resampled(empty, labels).count() == 0
    assert {x.log_weight for x in resampled(spark.createDataFrame(rows[:9], DOC), labels.where("false")).collect()} == {0.0}
    values = [r.random() for _ in range(3000)] + [0.5] * 3000
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for k in (1, 2, 100, 1499, 1600, 4000, 4400, 5999, 6000):
        assert kth_largest(df, k) == sorted(values, reverse=True)[k - 1]


# 8


@pytest.mark.parametrize(("order", "heavy", "rounds"), [(3, 100_000, 2), (3, 20, 3), (2, 20, 1), (1, 100_000, 2), (4, 50, 2)])
def test_stupid_backoff(spark, docs, empty, order, heavy, rounds):
    from loregraph.llm.ngram_lm import scores

    toks = [words_of(t) for _, t, *_ in corpus()]
    c = Counter(tuple(t[i : i + n]) for t in toks for n in range(1, order + 1) for i in range(len(t) - n + 1))
    total = sum(map(len, toks))

    def one(g):
        if len(g) == 1:
            return math.log(c[g] / total)
        return math.log(c[g] / c[g[:-1]]) if c[g] >= 2 else math.log(0.4) + one(g[1:])

    got = {r.doc_id: r for r in scores(docs, order=order, heavy=heavy, rounds=rounds).collect()}
    for i, t in enumerate(toks):
        want = sum(one(tuple(t[max(0, j - order + 1) : j + 1])) for j in range(len(t)))
        assert got[i].n_words == len(t)
        assert got[i].log_score is None if not t else abs(got[i].log_score - want) < 1e-6 * max(1, len(t))
    assert scores(empty, order=order).count() == 0


def test_stupid_backoff_of_nulls_and_repeats(spark):
    from loregraph.llm.ngram_lm import scores

    rows = [(None, "a b c a b c"), (1, "a b c a b c"), (1, "a b c a b c"), (None, None), (2, ""), (3, "a b")]
    got = {(r.doc_id, r.n_words, None if r.log_score is None else round(r.log_score, 6)) for r in scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {g[:2] for g in got} == {(None, 6), (1, 6), (None, 0), (2, 0), (3, 2)} and len(got) == 5
    assert len({g[2] for g in got if g[1] == 6}) == 1


def test_stupid_backoff_deals_out_runs_of_ngrams(spark, docs, monkeypatch):
    """Few and many partitions and runs give the same scores, and no step has a row an n-gram beside its tables."""
    from loregraph.llm import ngram_lm

    plain = {r.doc_id: r.log_score for r in ngram_lm.scores(docs, heavy=100_000, rounds=2).collect()}
    plans, saved = [], ngram_lm.saved
    monkeypatch.setattr(ngram_lm, "saved", lambda df, **k: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or saved(df, **k))
    monkeypatch.setattr(ngram_lm, "PART_CHARS", 500)
    monkeypatch.setattr(ngram_lm, "BLOCK", 64)
    got = {r.doc_id: r.log_score for r in ngram_lm.scores(docs, heavy=100_000, rounds=2).collect()}
    assert got.keys() == plain.keys()
    assert all(got[i] is None if x is None else abs(got[i] - x) < 1e-6 * max(1, abs(x)) for i, x in plain.items())
    dealt = [p for p in plans if "MapInArrow exploded" in p or "MapInArrow run(" in p]
    assert len(dealt) == 4 and not any("Join" in p for p in dealt)


def test_hashes_give_their_prefix_back():
    from loregraph.llm.ngram_lm import ngrams, prefixes
    from loregraph.llm.wordhash import numbers

    w, text = numbers(5, 50), np.repeat(np.arange(5), 10)
    levels = {n: (h, s, t) for n, h, s, t in ngrams(w, text, 3)}
    for n in (2, 3):
        h, s, _ = levels[n]
        assert set(prefixes(h, s, np.full(len(h), n))) <= set(levels[n - 1][0]) and set(s) <= set(levels[n - 1][0])
        assert len(h) == 50 - 5 * (n - 1)


def test_ngrams_of_a_range_are_those_that_lie_in_it():
    from loregraph.llm.ngram_lm import ngrams
    from loregraph.llm.wordhash import numbers

    w, text = numbers(5, 400), np.repeat(np.arange(8), 50)
    whole, parts = list(ngrams(w, text, 3)), [list(ngrams(w, text, 3, k, 3)) for k in range(3)]
    for n, h, s, t in whole:
        place = [int(x >> 32) * 3 >> 32 for x in h.tolist()]
        for k in range(3):
            own = np.array([p == k for p in place])
            assert parts[k][n - 1][0] == n and all(np.array_equal(a, b[own]) for a, b in zip(parts[k][n - 1][1:], (h, s, t)))


def test_ngrams_are_ordered_by_packed_numbers():
    """Also those that only their last bits tell apart, equal ones, and numbers too wide to be packed."""
    from loregraph.llm.ngram_lm import _by_document, _order

    r = np.random.default_rng(3)
    for h in (r.integers(0, 1 << 63, 5000).astype(np.uint64) * np.uint64(2), r.integers(0, 3000, 5000).astype(np.uint64), np.zeros(0, np.uint64), np.full(3, (1 << 64) - 1, np.uint64)):
        by = _order(h)
        assert sorted(by.tolist()) == list(range(len(h))) and np.array_equal(h[by], np.sort(h))
    h, doc = r.integers(0, 50, 4000).astype(np.uint64), r.integers(0, 30, 4000)
    for part, doc in ((r.integers(0, 9, 4000), doc), (r.integers(0, 1 << 30, 4000), doc << 40), (np.zeros(4000, int), np.zeros(4000, int))):
        by = _by_document(part, doc, h)
        met = list(zip(part[by].tolist(), doc[by].tolist()))
        assert sorted(by.tolist()) == list(range(4000)) and met == sorted(met)
    assert (np.diff(h[by].astype(int)) != 0).sum() == 49


def test_words_at_the_ends_of_texts_and_of_white_space():
    from loregraph.llm.wordhash import words

    texts = ["", "a b", "c", " \t", "\x08 d\x0e\x1f\x0b\x0c\re ", "\u00a0f", "", "g\n"]
    data = [t.encode() for t in texts]
    bounds = np.cumsum([0, *map(len, data)])
    h, text, start, end = words(np.frombuffer(b"".join(data), np.uint8), bounds)
    want = [(i, w) for i, t in enumerate(data) for w in re.findall(rb"[^\x20\x09-\x0d]+", t)]
    assert [(int(i), b"".join(data)[a:b]) for i, a, b in zip(text, start, end)] == want
    assert len(set(h.tolist())) == len({w for _, w in want})


# 7


def test_chat(spark):
    from loregraph.llm.chat import rendered

    r = random.Random(8)
    logs = {}
    for c in range(30):
        logs[c] = [(t, "user" if t % 2 == 0 else "assistant", f"text {r.randrange(3)}") for t in range(r.randint(1, 6))]
    logs[40] = [(t, "user", f"turn {t}") for t in range(150)]
    logs[41] = logs[40][:70]
    logs[42] = [(0, None, "x")]
    logs[43] = [(0, "", "x")]
    logs[44] = [(0, None, "x"), (1, "user", None)]
    rows = [(c, t, role, text, "extra") for c, turns in logs.items() for t, role, text in turns] + [(40, 3, "user", "turn 3", "extra")]
    rows += [(None, 0, "user", "n"), (None, 1, "user", "m")] and [(None, 0, "user", "n", "e"), (None, 1, "user", "m", "e")]
    got = rendered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, place string")).collect()
    seqs = {c: [(role, text) for _, role, text in sorted(v, key=lambda x: x[0])] for c, v in logs.items()} | {None: [("user", "n"), ("user", "m")]}
    keep = set()
    for c, s in seqs.items():
        longer = any(len(o) > len(s) and o[: len(s)] == s for o in seqs.values())
        first = all(o != s or (d is not None and c is not None and c <= d) or d == c for d, o in seqs.items())
        if not longer and first:
            keep.add(c)
    assert {r.conv_id for r in got} == keep
    text = {}
    for r in sorted(got, key=lambda r: r.segment):
        text[r.conv_id] = text.get(r.conv_id, "") + r.text
    for c in keep:
        assert text[c] == "".join(f"<|{role or ''}|>\n{t or ''}<|end|>\n" for role, t in seqs[c])
    assert rendered(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# 9


def test_url_list(spark):
    import datetime as dt

    from loregraph.llm.urllist import evaluated

    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(n)
    r = random.Random(9)
    patterns = ["a.com", "b.a.com", "a.com/x", "b.a.com/x/y", "c.org", "Z.NET"]
    entries = [(r.choice(patterns), r.choice(["add", "remove"]), day(r.randrange(90))) for _ in range(60)] + [(None, "add", day(1)), ("a.com", None, day(2)), ("a.com", "add", None)]
    urls = ["http://a.com/", "https://b.a.com/x/y/z?q", "http://u@b.a.com:80/X/", "http://xa.com/", "http://c.org", "http://z.net./p#f", "odd", None, ""]
    captures = [(i, urls[i % len(urls)], day(r.randrange(100)) if i % 11 else None, "e") for i in range(400)]
    state = {}
    for p in {e[0].lower() for e in entries if e[0]}:
        days = {}
        for q, a, d in entries:
            if q and q.lower() == p and a and d:
                days[d] = max(days.get(d, ""), a)
        state[p] = sorted(days.items())
    active = lambda p, d: next((a for t, a in reversed(state.get(p, [])) if t <= d), "") == "add"

    def entry(url, d):
        m = re.match(r"[a-z]+://(?:[^@/]*@)?([^/?#:]+?)\.?(?::\d+)?(/[^?#]*)?(?:[?#].*)?$", url or "")
        if not m or d is None:
            return None
        host, labels = m[1].lower(), m[1].lower().split(".")
        steps = [s for s in (m[2] or "").lower().split("/") if s]
        keys = [".".join(labels[i:]) for i in range(max(1, len(labels) - 1))] + [host + "/" + "/".join(steps[:i]) for i in range(1, len(steps) + 1)]
        return max((k for k in keys if active(k, d)), key=lambda k: (len(k), k), default=None)

    c = spark.createDataFrame(captures, "id long, url string, day date, pattern string")
    e = spark.createDataFrame(entries, "pattern string, action string, day date")
    got = {x.id: (x.blocked, x.entry) for x in evaluated(c, e).collect()}
    assert got == {i: (entry(u, d) is not None, entry(u, d)) for i, u, d, _ in captures}
    assert sum(b for b, _ in got.values()) > 30
    assert evaluated(c.where("false"), e).count() == 0 and not any(x.blocked for x in evaluated(c, e.where("false")).collect())


def test_url_list_with_days_far_away(spark):
    """Open entries meet captures of the year 1 and 9999 as others, and no day in between takes any row."""
    import datetime as dt

    from loregraph.llm.urllist import evaluated

    far, near, old = dt.date(9999, 12, 31), dt.date(2024, 5, 5), dt.date(1, 1, 1)
    entries = spark.range(2000).selectExpr("concat('h', id, '.com') as pattern", "'add' as action", "date'2024-01-01' as day").union(spark.sql("select 'h3.com', 'remove', date'9999-12-31'")).union(spark.sql("select 'h4.com', 'add', date'0001-01-01'"))
    captures = spark.createDataFrame([(i, f"http://h{h}.com/a", d) for i, (h, d) in enumerate([(1, far), (1, old), (2, near), (3, far), (3, near), (4, old), (9999, far)])], "id long, url string, day date")
    got = evaluated(captures, entries)
    assert {x.id: x.entry for x in got.collect()} == {0: "h1.com", 1: None, 2: "h2.com", 3: None, 4: "h3.com", 5: "h4.com", 6: None}
    assert "Generate sequence" not in got._jdf.queryExecution().toString()


# 2


def test_images(spark):
    from loregraph.llm.media import copy_groups, drawn, rendered_vectors

    r = np.random.default_rng(1)
    rows = [(i, [float(x) for x in r.normal(size=8)], 0) for i in range(60)]
    rows += [(100 + i, rows[5][1], 0) for i in range(12) if (100 + i) % 10 != 4]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    made = rendered_vectors(vectors)
    got = {x.id: x for x in copy_groups(made).collect()}
    assert len(got) == made.count()
    copies = [(x.id, x.made_from) for x in made.where("made_from is not null").select("id", "made_from").collect()]
    assert len(copies) >= 6 and all(got[a].component_id == got[b].component_id for a, b in copies)
    same = {5} | {x for x in got if x >= 100 and x % 10 != 4}
    assert {got[i].class_id for i in same} == {5}
    singles = [i for i in range(60) if i % 10 not in (3, 4) and i != 5]
    assert len({got[i].component_id for i in singles}) == len(singles)
    x = drawn(np.arange(5.0), 64).astype(np.uint8)
    odd = [(1, 64, 64, x.tobytes(), "e"), (2, 64, 64, None, "e"), (3, 64, 64, b"short", "e"), (None, 64, 64, x.tobytes(), "e"), (4, 2, 2, b"abcd", "e"), (5, None, 3, b"", "e")]
    got = copy_groups(spark.createDataFrame(odd, "id long, height int, width int, pixels binary, class_id string")).collect()
    assert sorted((-1 if r.id is None else r.id, r.class_id) for r in got) == [(-1, 1), (1, 1), (2, None), (3, None), (4, 4), (5, None)]
    assert copy_groups(spark.createDataFrame([], "id long, height int, width int, pixels binary")).count() == 0


def test_images_against_brute_force(spark):
    """Every kind of edit is found, and the groups are those of all pairs compared."""
    from loregraph.llm.media import AGREE, EDITS, agreement, copy_groups, descriptors, drawn, edited

    r = np.random.default_rng(3)
    images = [drawn(r.normal(size=64), 128).astype(np.uint8) for _ in range(30)]
    rows, kinds = [], {}
    for i, x in enumerate(images):
        rows.append((10 * i, x))
        for j in range(2 if i < 14 else 0):
            kinds[10 * i + 1 + j] = EDITS[(i + 3 * j) % len(EDITS)]
            rows.append((10 * i + 1 + j, np.ascontiguousarray(edited(x.astype(float), EDITS[(i + 3 * j) % len(EDITS)])).astype(np.uint8)))
    rows += [(900, np.full((60, 60), 77, np.uint8)), (901, np.full((50, 60), 77, np.uint8)), (902, np.zeros((1, 50), np.uint8)), (903, np.zeros((16, 16), np.uint8))]
    found = [descriptors(x) for _, x in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if agreement(found[i], found[j]) >= AGREE]
    want = {rows[i][0]: rows[k][0] for i, k in enumerate(groups(len(rows), links))}
    made = spark.createDataFrame([(i, *x.shape, x.tobytes()) for i, x in rows], "id long, height int, width int, pixels binary")
    got = {x.id: x.component_id for x in copy_groups(made.repartition(3)).collect()}
    assert sum(got[i] == want[i] for i in want) >= 0.95 * len(want)
    right = Counter(k for i, k in kinds.items() if got[i] == i // 10 * 10)
    assert all(right[k] >= 0.75 * n for k, n in Counter(kinds.values()).items()) and sum(right.values()) >= 0.9 * len(kinds)
    assert all(got[i] == i for i in got if i < 900 and i not in kinds) and all(got[i] == i for i in (900, 901, 902, 903))


def test_images_in_one_slot(spark, monkeypatch):
    """A corner that all images share: finer tables and strays must still give the groups."""
    from loregraph.llm import linking, media

    r = np.random.default_rng(4)
    rows = []
    for i in range(24):
        x = media.drawn(r.normal(size=64), 96).astype(np.uint8)
        x[2:38, 2:38] = media.drawn(np.arange(8.0), 96).astype(np.uint8)[2:38, 2:38]  # a mark, too small to be a copy
        rows += [(2 * i, x), (2 * i + 1, np.ascontiguousarray(media.edited(x.astype(float), "bright")).astype(np.uint8))]
    found = [media.descriptors(x) for _, x in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if media.agreement(found[i], found[j]) >= 14]
    want = dict(enumerate(groups(len(rows), links)))
    monkeypatch.setattr(linking, "CROWDED", 6)
    made = spark.createDataFrame([(i, *x.shape, x.tobytes()) for i, x in rows], "id long, height int, width int, pixels binary")
    assert {x.id: x.component_id for x in media.copy_groups(made, agree=14).collect()} == want


# shared parts


def test_components(spark):
    from loregraph.llm.linking import components

    r = random.Random(7)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(40)] + [(7, 7), (None, 3), (2, None)]
    got = {x.id: x.root for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = groups(1100, [(a, b) for a, b in edges if a is not None and b is not None])
    for a, b in edges:
        if a is not None and b is not None and a != b:
            assert got[a] == root[a] and got[b] == root[b]


def test_word_hashes():
    import pyarrow as pa

    from loregraph.llm.wordhash import chunks, grams, words

    texts = ["A b\tC", "", None, "x" * 2_000_000, "b c", "ü  Ü", "a b c d e f"]
    seen = {}
    for at, data, bounds in chunks(pa.array(texts), 100):
        h, t, s, e = words(data, bounds)
        for x, i in zip(h, t):
            seen.setdefault(at + int(i), []).append(int(x))
    assert [len(seen.get(i, [])) for i in range(7)] == [3, 0, 0, 1, 2, 2, 6]
    assert seen[0] == seen[6][:3] and seen[0][1:] == seen[4] and seen[5][0] != seen[5][1]
    g, at = grams(np.array(seen[0] + seen[6], np.uint64), np.array([0] * 3 + [1] * 6), 3)
    assert len(g) == 5 and g[0] == g[1] and list(at) == [0, 3, 4, 5, 6]


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(12)
    words = ["".join(r.choice("aeioubdgklmnr") for _ in range(r.randint(2, 7))) for _ in range(500)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    item = text(30)
    boiler = text(20)
    texts = [f"{text(25)}\n{text(30)}" for _ in range(40)]
    texts += [f"{texts[0]}\n{text(3)}", texts[1], f"{text(10)}\n{boiler}", f"{boiler}\n{text(12)}", f"{text(9)} {item} {text(9)}", "123 456", None]
    rows = [(i, t, "en", f"s{i % 3}", 0 if t is None else len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    d = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        d = stage(spark, d, str(tmp_path))
        seen[name] = {x.doc_id: x for x in d.collect()}
    ids = set(range(len(texts)))
    assert set(seen["language_id"]) == ids - {45, 46}
    assert set(seen["line_dedup"]) == ids - {41, 45, 46}
    assert seen["line_dedup"][40].text == texts[40].split("\n")[2] and seen["line_dedup"][43].text == texts[43].split("\n")[1]
    assert set(seen["ngram_jaccard"]) == set(seen["line_dedup"])
    assert set(seen["decontamination"]) == set(seen["ngram_jaccard"]) - {44}
    assert set(seen["mixing"]) <= set(seen["decontamination"]) and all(x.mix_copies >= 1 for x in seen["mixing"].values())
    whole = {x.doc_id: x for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert {k: v.text for k, v in whole.items()} == {k: v.text for k, v in seen["mixing"].items()}
