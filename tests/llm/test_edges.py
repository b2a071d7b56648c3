"""Hard cases of the operators: repetitive and very long texts, many small texts, repeated keys, clashing names, and results
computed anew by plain loops."""

import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


# 1


def test_importance_weights_against_plain_loops(spark, monkeypatch):
    from loregraph.llm import importance
    from loregraph.llm.wordhash import mix

    r = random.Random(3)
    texts = {i: " ".join(r.choice("abcdefgh") * (1 + (i % 3 == 0)) for _ in range(r.randint(1, 30))) for i in range(40)}
    labels = {i: (int(i % 3 == 0), int(i % 9 == 0)) for i in range(30)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    table = spark.createDataFrame([(i, *v) for i, v in labels.items()], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in importance.resampled(docs, table).collect()}

    # n-grams as strings: at 2^18 cells these few do not collide
    grams = {i: [*(w := words_of(t)), *zip(w, w[1:])] for i, t in texts.items()}
    raw = Counter(g for x in grams.values() for g in x)
    target = [i for i, (q, t) in labels.items() if q == 1 and t == 0]
    fold = {i: spark.range(1).select(F.pmod(F.xxhash64(F.lit(7), F.lit(i).cast("long")), F.lit(2))).first()[0] for i in target}
    counts = [Counter(g for i in target if fold[i] == f for g in grams[i]) for f in (0, 1)]
    for i, x in grams.items():
        own = counts[1] if fold.get(i) == 0 else counts[0] if fold.get(i) == 1 else counts[0] + counts[1]
        n, every = sum(own.values()), sum(raw.values())
        want = sum(math.log((own[g] + importance.PRIOR) / (raw[g] / every * n + importance.PRIOR)) for g in x)
        assert got[i].n_grams == len(x) and abs(got[i].log_weight - want) < 1e-6 * max(1, len(x))
    keys = sorted((x.gumbel_key for x in got.values()), reverse=True)
    k = round(len(target) / len(labels) * len(texts))
    assert {i for i, x in got.items() if x.selected} == {i for i, x in got.items() if x.gumbel_key >= keys[k - 1]}
    noise = [x.gumbel_key - x.log_weight for x in got.values()]
    assert len(set(noise)) == len(noise) and -3 < np.mean(noise) < 3
    assert mix(np.zeros(1, np.uint64)).dtype == np.uint64


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


def test_tiles_of_repetitive_texts():
    from loregraph.llm.decontam import tiles
    from loregraph.llm.wordhash import mix

    h = lambda x: mix(np.array(x, np.uint64) + np.uint64(7))
    r = random.Random(6)
    for n in (2, 3):
        for _ in range(60):
            a, b = ([r.randrange(n) for _ in range(r.randrange(0, 26))] for _ in range(2))
            assert tiles(h(a), h(b), 3, most=0) == tiles(h(a), h(b), 3) == brute_tiles(a, b, 3)
    began = time.time()
    assert tiles(h([1] * 200_000), h([1] * 50), 5) == [(0, 0, 50)]
    found = tiles(h([1, 2] * 30_000), h([2] * 7 + [1, 2] * 20), 5)
    assert found[0][2] == 41 and time.time() - began < 60


# 6


def test_language_scores_against_plain_loops(spark):
    """Presence kernel, ridge regression and score recomputed with sets and dense solves."""
    from loregraph.llm import langid

    r = random.Random(5)
    alphabet = {"aa": "abcde ", "bb": "defgh ", "cc": "xyzäö "}
    rows = [(i, "".join(r.choice(alphabet[k]) for _ in range(60)), k) for i, k in enumerate(list(alphabet) * 30)]
    got = {x.doc_id: x for x in langid.languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}

    def cells(text):
        x, _ = langid.presence(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))
        grams = {text[i : i + n] for n in (1, 2, 3) for i in range(len(text) - n + 1)}
        assert len(grams) - 2 <= x.sum() <= len(grams)  # a cell for each n-gram, but for collisions
        return np.flatnonzero(x[0])

    sets = {i: set(cells(t)) for i, t, _ in rows}
    kernel = lambda a, b: len(a & b) / math.sqrt(len(a) * len(b))
    learned = [(i, k) for i, _, k in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    held = {i for i, _, _ in rows} - {i for i, _ in learned}
    assert {i for i in got if got[i].held_out} == held
    assert sum(got[i].lang_pred == k for i, _, k in rows if i in held) >= 0.95 * len(held)
    order = {i: spark.range(1).select(F.xxhash64(F.lit(i).cast("long"))).first()[0] for i, _ in learned}
    per = {k: sorted((i for i, x in learned if x == k), key=lambda i: order[i]) for k in alphabet}
    picked = sorted((at, k, i) for k in per for at, i in enumerate(per[k]))
    marks = [i for _, _, i in picked][: langid.LANDMARKS]
    k_nm = np.array([[kernel(sets[i], sets[m]) for m in marks] for _, _, i in picked])
    k_mm = np.array([[kernel(sets[i], sets[m]) for m in marks] for i in marks])
    names = sorted(alphabet)
    y = np.array([[1.0 if k == n else -1.0 for n in names] for _, k, _ in picked])
    w = np.linalg.lstsq(k_nm.T @ k_nm + langid.RIDGE * len(picked) * k_mm / len(marks) + 1e-6 * np.eye(len(marks)), k_nm.T @ y, rcond=None)[0]
    for i, _, _ in rows:
        s = np.array([kernel(sets[i], sets[m]) for m in marks]) @ w
        assert got[i].lang_pred == names[int(s.argmax())] and abs(got[i].score - min(1, max(0, (1 + s.max()) / 2))) < 2e-2


def test_language_of_many_small_texts_and_repeated_keys(spark):
    from loregraph.llm.langid import identified, languages

    rows = [(i, "ab"[i % 2], "xy"[i % 2], "p", 0.5) for i in range(10_000)] + [(20_001, "aaaa", "x", "p", 0.5)] * 5_000
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double").coalesce(1)
    got = languages(docs.select("doc_id", "text", "lang"))
    assert got.where("lang_pred = 'x'").count() == 10_000 and got.count() == 15_000
    kept = identified(docs)
    assert kept.columns == docs.columns and kept.count() == 15_000


# 7


def test_chat_of_an_id_like_a_mark(spark):
    from loregraph.llm.chat import rendered

    rows = [(None, 0, "user", "a"), ("null", 0, "user", "b"), ("null conversation", 0, "user", "c")]
    got = rendered(spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")).collect()
    assert sorted((str(r.conv_id), r.n_turns) for r in got) == [("None", 1), ("null", 1), ("null conversation", 1)]


# names that clash


CLASH = "_key _gone _hit _cell _bits _doc _source _size _times _copies _place copies times place mix_copies source_size target root own first at id id2 hit component_id set_id n_shingles n lang_pred score".split()


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(i // 2, f"line {i % 3} of some text that is long enough to be told\nand another one {i % 5} of the kind", "en", f"s{i % 2}", *["x"] * len(CLASH)) for i in range(24)]
    rows += rows[:3] + [(None, None, None, None, *["x"] * len(CLASH)), (None, "", None, None, *["x"] * len(CLASH))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} string" for c in CLASH))


def test_stages_with_clashing_columns(spark, clashing, tmp_path):
    from loregraph.llm import stages

    spark.createDataFrame([(1, "five words or more of a benchmark item")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for step in (stages.language_id, stages.line_dedup, stages.ngram_jaccard, stages.decontamination, stages.mixing):
        out = step(spark, clashing, str(tmp_path))
        names = out.columns
        assert names[: len(clashing.columns)] == clashing.columns and len(set(names)) == len(names)
        assert all(r["_key"] == "x" for r in out.collect())
        none = step(spark, clashing.where("false"), str(tmp_path))
        assert none.columns == names and none.count() == 0


def test_mixing_of_repeated_rows_with_clashing_columns(spark, clashing):
    from loregraph.llm.mixing import mix_plan, mixed

    got = mixed(clashing)
    taken = got.select(F.sum(F.col("mix_copies_") * F.size(F.split("text", "\\s+")))).first()[0]
    assert got.columns == [*clashing.columns, "mix_copies_"] and taken == mix_plan(clashing).select(F.sum("taken")).first()[0]


# 10 and what links lists


def test_short_near_copies_take_subsets(spark, monkeypatch):
    """Thousands of short documents: the boundary that the costs give is above 0, and the groups are right."""
    from loregraph.llm import jaccard

    r = random.Random(9)
    texts = []
    for i in range(700):
        w = [f"v{r.randrange(3000)}" for _ in range(r.randint(5, 13))]
        texts += [" ".join(w), " ".join([*w, f"e{i}"]), " ".join(["o", *w]) if i % 2 else " ".join(w)]
    seen = []
    plain = jaccard.boundary
    monkeypatch.setattr(jaccard, "boundary", lambda *a: seen.append(plain(*a)) or seen[-1])
    got = {x.doc_id: x.component_id for x in jaccard.jaccard_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert seen and seen[0] > 0
    sets = [{tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(words_of, texts)]
    by, root = {}, list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in enumerate(sets):
        for g in s:
            by.setdefault(g, []).append(i)
    for i, s in enumerate(sets):
        for j in {j for g in s for j in by[g] if j < i}:
            if 100 * len(s & sets[j]) >= 80 * len(s | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert got == {i: find(i) for i in range(len(sets))}


def test_a_common_passage_is_compared_little(spark, monkeypatch):
    """One passage in thousands of otherwise unlike documents, a part of them just similar enough: few pairs are compared."""
    from loregraph.llm import jaccard

    r = random.Random(10)
    passage = [f"p{i}" for i in range(50)]
    texts = [" ".join([*passage, *(f"x{i}_{j}" for j in range(1 + i % 14))]) for i in range(3000)]
    compared = []
    plain = jaccard._linked
    monkeypatch.setattr(jaccard, "_linked", lambda pairs, *a: compared.append(pairs.count()) or plain(pairs, *a))
    got = {x.doc_id: x.component_id for x in jaccard.jaccard_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    # with a and b own words: 46 common shingles of 46 + a + b
    close = lambda a, b: 100 * 46 >= 80 * (46 + a + b)
    want = {i: 0 if close(1 + i % 14, 1) else i for i in range(3000)}
    assert got == want and sum(compared) < 20 * len(texts), compared
    assert r.random() < 1
