"""A Merkle manifest of a dataset: a tree over the rows of each group (source), a tree over the groups' roots, and folds that
recompute the root from one replaced leaf.

A node is the SHA-256 (lower-case hex) of up to FAN consecutive nodes of the level below; a level's last run may be shorter. The
hash state before each child of a parent is copied and kept while a block of the tree is in hand. A fold resumes the state
before the replaced child with the replacement and the siblings to its right; those to its left are not hashed again.

Rows are put in order by ranges and numbered by their partitions' sizes, so that a group may be of any size. Trees are
built in bands of HEIGHT levels: a band's block is FAN ** HEIGHT nodes of one group, one row, and its root is a node of the
next band. Then the siblings on the way from each block's root to the top go down the bands, to each block once.

Nulls in any field are hashed as `-`. A null group is a group, the first; a null id comes first in its group. Rows with the same
id go by their leaf; repeated rows are leaves of their own with equal hashes, so their order is of no account. An empty table
gives no rows. Texts are hashed whole, once, where they are read. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loregraph.llm.common import numbered, saved, setting

FAN, HEIGHT = 3, 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Blocks in a Python batch.
BLOCKS = "32"
_PATH = "array<struct<left:string,right:string>>"


def digest(values: list[Column]) -> Column:
    """SHA-256 of values one after the other: null as `-`, others as their length in bytes, a colon and the value."""
    text = lambda c: F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)
    return F.sha2(F.concat(*[F.coalesce(text(v.cast("string")), F.lit("-")) for v in values]), 256)


def leaves(docs: DataFrame, altered: dict[str, Column] | None = None, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(grp, id, leaf, changed): each row's leaf, and the leaf that it would have with the altered fields."""
    altered = altered or {}
    group = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit(""))
    return docs.select(group.alias("grp"), F.col("doc_id").cast("long").alias("id"), digest([F.col(f) for f in fields]).alias("leaf"), digest([altered.get(f, F.col(f)) for f in fields]).alias("changed"))


class Block:
    """Consecutive nodes of one level, the levels above them and the states before each child: `height` levels above, or, if
    the tree has no more than a block of such nodes (total), as many as lead to one node."""

    def __init__(self, nodes: list[str], total: int, fan: int, height: int):
        self.levels, self.before, self.fan = [nodes], [], fan
        while len(self.before) < height if total > fan**height else len(self.levels[-1]) > 1:
            states, above = [], []
            for k in range(0, len(self.levels[-1]), fan):
                state = hashlib.sha256()
                for child in self.levels[-1][k : k + fan]:
                    states.append(state.copy())
                    state.update(child.encode())
                above.append(state.hexdigest())
            self.before.append(states)
            self.levels.append(above)

    @property
    def root(self) -> str:
        return self.levels[-1][0]

    def siblings(self, i: int) -> Iterator[tuple[str, str]]:
        """What stands left and right of node i's ancestors, itself included, below the root."""
        for level in self.levels[:-1]:
            first = i - i % self.fan
            yield "".join(level[first:i]), "".join(level[i + 1 : first + self.fan])
            i //= self.fan

    def fold(self, i: int, node: str) -> str:
        """The root with `node` in the place of node i."""
        for level, before in zip(self.levels, self.before):
            state = before[i].copy()
            state.update(node.encode())
            state.update("".join(level[i + 1 : i - i % self.fan + self.fan]).encode())
            node, i = state.hexdigest(), i // self.fan
        return node


@dataclass
class Tree:
    """bands: (grp, block, total, nodes) from the leaves up, nodes being structs with pos and hash; roots: (grp, hash, total)."""

    bands: list[DataFrame]
    roots: DataFrame
    fan: int
    height: int


def grown(nodes: DataFrame, fan: int = FAN, height: int = HEIGHT) -> Tree:
    """The trees of nodes(grp, pos, total, hash, others): one for each grp. Other columns stay in the nodes of the first band."""
    width = fan**height
    tree = Tree([], nodes, fan, height)
    roots = []

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            total = table.column("total").to_pylist()
            tops = [Block(hashes, n, fan, height).root for hashes, n in zip(table.column("hashes").to_pylist(), total)]
            up = [-(-n // width) for n in total]
            yield pa.RecordBatch.from_arrays([table.column("grp"), table.column("block"), pa.array(up, pa.int64()), pa.array(tops)], names=["grp", "pos", "total", "hash"])

    while True:
        other = [c for c in nodes.columns if c not in ("grp", "total")]
        row = F.struct("pos", *[c for c in other if c != "pos"])
        band = nodes.groupBy("grp", F.floor(F.col("pos") / width).alias("block")).agg(F.max("total").alias("total"), F.array_sort(F.collect_list(row)).alias("nodes"))
        with setting(nodes.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch", BLOCKS):
            band = saved(band, few=True)
            nodes = saved(band.select("grp", "block", "total", F.col("nodes.hash").alias("hashes")).mapInArrow(run, "grp string, pos long, total long, hash string"))
        tree.bands.append(band)
        roots.append(nodes.where("total = 1").select("grp", "hash"))
        nodes = nodes.where("total > 1")
        if nodes.isEmpty():
            break
    out = roots[0]
    for r in roots[1:]:
        out = out.union(r)
    tree.roots = out
    return tree


_SIDES = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def _sides(held: Block, up: list[dict]) -> pa.Array:
    return pa.array([[{"left": a, "right": b} for a, b in held.siblings(i)] + up for i in range(len(held.levels[0]))], _SIDES)


def ways(tree: Tree, tops: DataFrame) -> DataFrame:
    """The first band of the tree with `up`, the siblings on the way from each block's root to the very top, by tops(grp,
    subroot, root, up), those of the way from the trees' roots; subroot and root go along."""
    fan, height = tree.fan, tree.height
    width = fan**height

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            for grp, number, total, hashes, subroot, root, up in zip(*[table.column(c).to_pylist() for c in ("grp", "block", "total", "hashes", "subroot", "root", "up")]):
                n = len(hashes)
                places = pa.array(range(number * width, number * width + n), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([grp] * n), places, pa.array([subroot] * n), pa.array([root] * n), _sides(Block(hashes, total, fan, height), up)], names=["grp", "block", "subroot", "root", "up"])

    known: DataFrame | None = None
    for band in reversed(tree.bands):
        last = band.where(F.col("total") <= width).select("grp", "block").join(tops.select("grp", "subroot", "root", "up"), "grp")
        held = band.join(last if known is None else last.unionByName(known), ["grp", "block"])
        if band is not tree.bands[0]:
            with setting(band.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch", BLOCKS):
                known = saved(held.withColumn("hashes", F.col("nodes.hash")).drop("nodes").mapInArrow(run, f"grp string, block long, subroot string, root string, up {_PATH}"))
    return held


def manifest(rows: DataFrame, fan: int = FAN, height: int = HEIGHT) -> tuple[Tree, Tree, DataFrame]:
    """The trees of rows(grp, id, leaf, changed), the tree of their roots (of grp ""), and tops(grp, subroot, root, up)."""
    rows = saved(rows.select("grp", "id", F.col("leaf").alias("hash"), "changed"))  # a sort reads its rows twice
    trees = grown(numbered(rows, ["grp"], ["id", "hash"]), fan, height)
    order = numbered(trees.roots.select(F.lit("").alias("grp"), F.col("grp").alias("name"), "hash"), ["grp"], ["name"])
    whole = grown(order, fan, height)
    way = ways(whole, whole.roots.select("grp", F.col("hash").alias("subroot"), F.col("hash").alias("root"), F.array().cast(_PATH).alias("up")))

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            for total, names, hashes, root, up in zip(*[table.column(c).to_pylist() for c in ("total", "names", "hashes", "root", "up")]):
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(hashes), pa.array([root] * len(names)), _sides(Block(hashes, total, fan, height), up)], names=["grp", "subroot", "root", "up"])

    with setting(rows.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch", BLOCKS):
        tops = saved(way.select("total", F.col("nodes.name").alias("names"), F.col("nodes.hash").alias("hashes"), "root", "up").mapInArrow(run, f"grp string, subroot string, root string, up {_PATH}"))
    return trees, whole, tops


def folds(rows: DataFrame, fan: int = FAN, height: int = HEIGHT) -> DataFrame:
    """(id, grp, leaf, subroot, root, proof_sha256, folded_root, verified) of rows(grp, id, leaf, changed): the hash of all
    siblings on the way to the root, the root recomputed from `changed`, and whether it is the root."""
    trees, _, tops = manifest(rows, fan, height)

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            for grp, total, nodes, subroot, root, up in zip(*[table.column(c).to_pylist() for c in ("grp", "total", "nodes", "subroot", "root", "up")]):
                held = Block([n["hash"] for n in nodes], total, fan, height)
                above = [(hashlib.sha256(s["left"].encode()), s["right"].encode()) for s in up]
                rest = "".join(s["left"] + s["right"] for s in up).encode()
                proofs, folded = [], []
                for i, n in enumerate(nodes):
                    proofs.append(hashlib.sha256("".join(a + b for a, b in held.siblings(i)).encode() + rest).hexdigest())
                    node = held.fold(i, n["changed"])
                    for before, right in above:
                        state = before.copy()
                        state.update(node.encode())
                        state.update(right)
                        node = state.hexdigest()
                    folded.append(node)
                columns = [[n["id"] for n in nodes], [grp] * len(nodes), [n["hash"] for n in nodes], [subroot] * len(nodes), [root] * len(nodes), proofs, folded, [f == root for f in folded]]
                kinds = [pa.int64(), *[pa.string()] * 6, pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["id", "grp", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    schema = "id long, grp string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    with setting(rows.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch", BLOCKS):
        held = saved(ways(trees, tops).select("grp", "total", "nodes", "subroot", "root", "up"), few=True)
        return saved(held.mapInArrow(run, schema))
