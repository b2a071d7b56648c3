"""A trie of conversation prefixes, with totals of subtrees by depth bands.

A node is a distinct sequence of first turns. Its key is its depth and the exclusive or of hashes of place and turn (128 bits): the
keys of a conversation's prefixes come from a scan in blocks of BAND turns, blocks of blocks and so on, so that a
conversation may be of any length. Turns are told apart by SHA-256; that all members of a node end in the same turn and come
from the same parent is checked, so two prefixes with one key would be an error, not one node.

Totals of subtrees: a node adds its own to its ancestors inside its band of BAND depths only. Bands' roots are the nodes
of a trie that is BAND times less deep, which is solved in the same way; then the completed totals of the roots go to the
nodes of the band above them. So a node is exploded to BAND rows at most, and there are two rounds a level of this recursion, whose
depth is the logarithm of the longest conversation.

Turns are in the order of turn (null first), role and text; null role or text is empty; repeated rows are turns of their own.
Rows with a null conv_id belong to no conversation and are left out. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loregraph.llm.common import numbered, saved

#: Depths of a band, and turns of a block; members in one row of the list that is hashed.
BAND, MEMBERS = 8, 4096
_KEY = ["depth", "k1", "k2"]
_KEYS = "array<struct<k1:bigint,k2:bigint>>"


def placed_turns(turns: DataFrame) -> DataFrame:
    """(conv, pos, turn, n_bytes): each turn's place from 1, the hash of its role and text, and the bytes of the text."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("no"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    hashed = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    keep = [hashed.alias("turn"), F.octet_length("text").cast("long").alias("n_bytes")]
    return numbered(rows.where("conv is not null"), ["conv"], ["no", "role", "text"], keep).select("conv", (F.col("pos") + 1).alias("pos"), "turn", "n_bytes", "total")


def rebuilt(placed: DataFrame, head: Column, donor: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """(turns, convs): conversation c begins with the first `head` turns of conversation `donor` (both by conv; at most
    `most` turns) and goes on with its own after its first `head`."""
    convs = placed.groupBy("conv").agg(F.max("total").alias("n")).select("conv", "n", head.alias("head"), donor.alias("donor"))
    convs = saved(convs)
    lengths = convs.select(F.col("conv").alias("donor"), F.col("n").alias("given"))
    convs = saved(convs.join(lengths, "donor", "left").select("conv", "head", "donor", F.least("head", F.coalesce("given", F.lit(0))).alias("given")))
    first = placed.where(F.col("pos") <= most).select(F.col("conv").alias("donor"), "pos", "turn", "n_bytes")
    begun = convs.join(first, "donor").where("pos <= head").select("conv", "pos", "turn", "n_bytes")
    own = placed.join(convs.select("conv", "head", "given"), "conv").where("pos > head").select("conv", (F.col("pos") - F.col("head") + F.col("given")).alias("pos"), "turn", "n_bytes")
    return begun.union(own), convs.select("conv")


def _xor(a: Column, b: Column) -> Column:
    return F.struct(a["k1"].bitwiseXOR(b["k1"]).alias("k1"), a["k2"].bitwiseXOR(b["k2"]).alias("k2"))


def _blocks(rows: DataFrame, *more: str) -> DataFrame:
    """(conv, block, xs): rows(conv, pos, k1, k2, full, others) in blocks of BAND places."""
    return saved(rows.groupBy("conv", F.floor((F.col("pos") - 1) / BAND).alias("block")).agg(F.array_sort(F.collect_list(F.struct("pos", "k1", "k2", "full", *more))).alias("xs")))


def _keyed(blocks: DataFrame, before: DataFrame) -> DataFrame:
    """blocks with keys: the key before the block and after each of its rows; before(conv, block, k1, k2)."""
    start = F.array(F.struct(F.coalesce("k1", F.lit(0)).cast("long").alias("k1"), F.coalesce("k2", F.lit(0)).cast("long").alias("k2"))).cast(_KEYS)
    keys = F.aggregate("xs", start, lambda ks, x: F.concat(ks, F.array(_xor(F.element_at(ks, -1), x))))
    return blocks.join(before, ["conv", "block"], "left").select("conv", "block", "xs", keys.alias("keys"))


def prefixes(turns: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(rows, levels). rows(conv, depth, k1, k2, chain, turn, n_bytes): the prefixes of each conversation, with the keys of the
    ancestors of each from its band's root on. levels: (depth, k1, k2, chain) of the roots of bands, of bands of bands and
    so on, whose chains are of such roots."""
    unit = [F.xxhash64(F.lit(k), F.col("pos").cast("long"), "turn").alias(f"k{k}") for k in (1, 2)]
    levels = [_blocks(turns.select("conv", F.col("pos").cast("long").alias("pos"), *unit, F.lit(True).alias("full"), "turn", "n_bytes"), "turn", "n_bytes")]
    while (levels[-1].agg(F.max(F.col("block") * BAND + F.size("xs"))).first()[0] or 0) >= BAND:
        zero = F.struct(F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"))
        x = F.aggregate("xs", zero, lambda s, x: _xor(s, x))
        full = (F.size("xs") == BAND) & F.forall("xs", lambda x: x["full"])
        levels.append(_blocks(levels[-1].select("conv", (F.col("block") + 1).alias("pos"), x.alias("x"), full.alias("full")).select("conv", "pos", "x.k1", "x.k2", "full")))
    chains = []
    before = levels[-1].select("conv", "block", F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2")).where("false")
    for n in range(len(levels) - 1, 0, -1):
        keyed = saved(_keyed(levels[n], before))
        rows = keyed.select("conv", "keys", F.posexplode("xs").alias("i", "x"))
        step = F.lit(BAND**n)
        chain = rows.where("x.full").select((F.col("x.pos") * step).alias("depth"), F.col("keys")[F.col("i") + 1].alias("k"), F.slice("keys", 1, F.col("i") + 1).alias("chain"))
        chains.append(saved(chain.select("depth", "k.k1", "k.k2", "chain").groupBy(*_KEY).agg(F.first("chain").alias("chain"))))
        before = rows.select("conv", (F.col("x.pos") - 1).alias("block"), F.col("keys")[F.col("i")].alias("k")).select("conv", "block", "k.k1", "k.k2")
    rows = _keyed(levels[0], before).select("conv", "keys", F.posexplode("xs").alias("i", "x"))
    rows = rows.select("conv", F.col("x.pos").alias("depth"), F.col("keys")[F.col("i") + 1].alias("k"), F.slice("keys", 1, F.col("i") + 1).alias("chain"), "x.turn", "x.n_bytes")
    return rows.select("conv", "depth", "k.k1", "k.k2", "chain", "turn", "n_bytes"), chains[::-1]


def _along(rows: DataFrame, unit: int, own: bool) -> DataFrame:
    """The weights of rows at their ancestors in their band but its root; own: at themselves too."""
    first = F.floor((F.col("depth") / unit - 1) / BAND) * BAND
    up = F.transform(F.slice("chain", 2, BAND), lambda k, j: F.struct(((first + j + 1) * unit).cast("long").alias("depth"), k["k1"].alias("k1"), k["k2"].alias("k2")))
    self_ = F.array(F.struct(F.col("depth").cast("long").alias("depth"), "k1", "k2"))
    return rows.select(F.explode(F.concat(up, self_) if own else up).alias("n"), "leaves", "saved").select("n.*", "leaves", "saved")


def subtree_totals(weights: DataFrame, chains: list[DataFrame], deepest: int, unit: int = 1) -> DataFrame:
    """(depth, k1, k2, leaves, saved): the weights(depth, k1, k2, chain, leaves, saved) of each node's subtree. chains: of the
    roots of bands and above, as from `prefixes`."""
    inner = F.floor(F.col("depth") / unit) % BAND != 0
    summed = lambda df: df.groupBy(*_KEY).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    head = F.floor((F.col("depth") / unit - 1) / BAND) * BAND * unit
    to_root = weights.where(inner).select(head.cast("long").alias("depth"), F.col("chain")[0]["k1"].alias("k1"), F.col("chain")[0]["k2"].alias("k2"), "leaves", "saved")
    roots = saved(summed(weights.where(~inner).select(*_KEY, "leaves", "saved").union(to_root)))
    if deepest >= unit * BAND:
        roots = subtree_totals(roots.join(chains[0], _KEY, "left"), chains[1:], deepest, unit * BAND)
    below = roots.where("depth > 0").join(weights.where(~inner).select(*_KEY, "chain"), _KEY)
    inside = summed(_along(weights.where(inner), unit, True).union(_along(below, unit, False)))
    return saved(inside.union(roots.select(*_KEY, "leaves", "saved")))


def member_lists(ends: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256) of the nodes of ends(depth, k1, k2, conv): their conversations' numbers ascending, joined
    by commas, hashed. Lists of over MEMBERS are cut into rows, which one task reads in order, as SHA-256 must."""
    listed = F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    rows = numbered(ends, _KEY, ["conv"]).groupBy(*_KEY, "total", F.floor(F.col("pos") / MEMBERS).alias("part")).agg(listed.alias("text"))
    rows = saved(rows)
    short = rows.where(F.col("total") <= MEMBERS).select(*_KEY, F.sha2("text", 256).alias("ends_sha256"))

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, out = None, None, []
        for table in tables:
            for depth, k1, k2, text in zip(*[table.column(c).to_pylist() for c in (*_KEY, "text")]):
                if now != (depth, k1, k2):
                    if now:
                        out.append((*now, state.hexdigest()))
                    now, state = (depth, k1, k2), hashlib.sha256(text.encode())
                else:
                    state.update(f",{text}".encode())
        if now:
            out.append((*now, state.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=[*_KEY, "ends_sha256"])

    long = rows.where(F.col("total") > MEMBERS).repartition(*_KEY).sortWithinPartitions(*_KEY, "part").select(*_KEY, "text")
    return short.union(long.mapInArrow(run, "depth long, k1 long, k2 long, ends_sha256 string"))


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of each node, from turns(conv,
    pos, turn, n_bytes) with places from 1 without gaps, and convs(conv), all conversations, those without turns too."""
    rows, chains = prefixes(turns)
    rows = saved(rows)
    zero = F.lit(0).cast("long")
    top = convs.select("conv", zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), F.array().cast(_KEYS).alias("chain"), F.lit(b"").alias("turn"), zero.alias("n_bytes"))
    every = rows.union(top)
    above = F.element_at("chain", -1)
    above = F.when(F.size("chain") > 0, above)
    nodes = every.groupBy(*_KEY).agg(
        F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.max("n_bytes").alias("n_bytes"), F.first("chain").alias("chain"),
        F.min("turn").alias("t0"), F.max("turn").alias("t1"), F.min(above).alias("up"), F.max(above).alias("u1"),
    )
    alike = (F.col("t0") == F.col("t1")) & F.col("up").eqNullSafe(F.col("u1"))
    nodes = saved(nodes.select(*_KEY, F.when(alike, F.col("conv_id")).otherwise(F.raise_error(F.lit("two prefixes have one key")).cast("long")).alias("conv_id"), "n_convs", "n_bytes", "chain", "up"))

    born = nodes.where("depth > 0").select((F.col("depth") - 1).alias("depth"), "up.k1", "up.k2", F.lit(1).cast("long").alias("n_children"), F.lit(0).cast("long").alias("saved"), F.lit(None).cast(_KEYS).alias("chain"))
    own = nodes.select(*_KEY, zero.alias("n_children"), ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved"), "chain")
    counted = saved(own.union(born).groupBy(*_KEY).agg(F.sum("n_children").alias("n_children"), F.sum("saved").alias("saved"), F.first("chain", ignorenulls=True).alias("chain")))
    weights = counted.select(*_KEY, "chain", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaves"), "saved")
    totals = subtree_totals(weights, chains, nodes.agg(F.max("depth")).first()[0] or 0)

    last = every.groupBy("conv").agg(F.max(F.struct(*_KEY)).alias("n")).select("n.*", "conv")
    told = nodes.join(counted.select(*_KEY, "n_children"), _KEY).join(totals, _KEY).join(member_lists(last), _KEY, "left")
    told = told.select(*_KEY, "up", "conv_id", "n_convs", "n_children", "leaves", "saved", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
    parents = nodes.select((F.col("depth") + 1).alias("_d"), F.col("k1").alias("_1"), F.col("k2").alias("_2"), F.col("conv_id").alias("parent_conv_id"))
    met = told.join(parents, (told["depth"] == parents["_d"]) & (told["up"]["k1"] == parents["_1"]) & (told["up"]["k2"] == parents["_2"]), "left")
    return met.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), "ends_sha256")
