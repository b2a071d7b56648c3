"""The manifest's trees, proofs and folds against plain recursion."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from loregraph.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, grp string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc, text):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc[0], doc[3], doc[2], doc[4], text)])


def up(nodes):
    """All levels of a tree."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][k : k + 3]) for k in range(0, len(levels[-1]), 3)])
    return levels


def plain(docs, changed):
    groups = {}
    for d in docs:
        groups.setdefault(d[3], []).append(d)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees, out = {}, []
    for s in names:
        groups[s].sort(key=lambda d: ((d[0] is not None, d[0] or 0), leaf(d, d[1])))
        trees[s] = up([leaf(d, d[1]) for d in groups[s]])
    top = up([trees[s][-1][0] for s in names])
    for place, s in enumerate(names):
        for i, d in enumerate(groups[s]):
            node, proof = leaf(d, changed(d)), ""
            for levels, k in ((trees[s], i), (top, place)):
                for level in levels[:-1]:
                    run = level[k - k % 3 : k - k % 3 + 3]
                    left, right = "".join(run[: k % 3]), "".join(run[k % 3 + 1 :])
                    node, proof, k = h(left, node, right), proof + left + right, k // 3
            root = top[-1][0]
            out.append((d[0], leaf(d, d[1]), trees[s][-1][0], root, h(proof), node, node == root))
    return out


def docs_of(r, n, groups):
    text = lambda: r.choice([None, "", "a\nb", "é\n", "漢字 " * r.randint(0, 5), "same"])
    rows = [(r.choice([None, i, i, i, i // 2]), text(), r.choice([None, "en"]), r.choice(groups), r.choice([None, 5])) for i in range(n)]
    return rows + rows[: n // 10]


@pytest.mark.parametrize("n, groups, height", [(1, ["a"], 1), (2, [None], 6), (40, [None, "", "a", "é", "b"], 1), (130, ["hot"] * 6 + [None, "x", "y"], 2), (60, [f"g{i}" for i in range(40)], 1)])
def test_folds_against_plain_recursion(spark, n, groups, height):
    rows = docs_of(random.Random(n), n, groups)
    docs = spark.createDataFrame([(*d, "x", "y") for d in rows], SCHEMA).repartition(3)
    altered = {"text": F.when(F.col("doc_id") % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))}
    got = merkle.folds(merkle.leaves(docs, altered), height=height).collect()
    want = plain(rows, lambda d: d[1].replace("\n", "") if d[1] and d[0] is not None and d[0] % 2 == 0 else d[1])
    key = lambda x: (x[0] is None, x[0] or 0, *map(str, x[1:]))
    assert sorted(((x.id, x.leaf, x.subroot, x.root, x.proof_sha256, x.folded_root, x.verified) for x in got), key=key) == sorted(want, key=key)
    assert n < 10 or {x.verified for x in got} == {True, False}


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert merkle.folds(merkle.leaves(docs)).collect() == []


def test_states_are_resumed(monkeypatch):
    """A fold begins no hash anew: it goes on from kept states."""
    nodes = [h(str(i)) for i in range(20)]
    block = merkle.Block(nodes, 20, 3, 6)
    new = h("new")
    want = up(nodes[:7] + [new] + nodes[8:])[-1][0]
    assert [len(b) for b in block.before] == [20, 7, 3] and block.root == up(nodes)[-1][0]
    monkeypatch.setattr(merkle.hashlib, "sha256", None)
    assert block.fold(7, new) == want and block.fold(7, nodes[7]) == block.root
