"""Components of similar sets, from lists of sets that share a token, without writing all pairs of a list.

Each list has a pivot, a set that may well be like the others. A set is compared with the smallest pivot of its lists first, then, in a few rounds,
with those of its other pivots that are not yet in its component, so a large group of near copies costs a comparison or two for each of its
members. The sets of a list that are still not in the component of its pivot ("strays") are compared with the list's other
sets that they are apart from, as far as sizes and places allow a link: a join by token and class of size. So each pair of a
list that could join two components is compared.

What keeps strays few is the order of the tokens. `prefix_lists` ranks elements by their exact counts, rarest first; a set's
`rem` is how many of its elements stand from the token on. Two sets whose first common token this is share no more than the
smaller rem. A passage that many otherwise unlike sets share stands last in all of them, so that rem decides about it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loregraph.llm.common import dropped, recorded, saved

#: From this many sets on a list with strays is crowded. Sizes within this factor are one class.
CROWDED, CLASS = 32, 1.05


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, root) for each end of edges(a, b), saved; root is the component's smallest id.

    Alternates the large star (larger neighbours go to the smallest neighbour) and the small star (smaller neighbours
    and the node go to the smallest one) until nothing changes. Null ends and loops are left out.
    """
    both = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = saved(both.distinct(), few=True)
    for _ in range(most_rounds):
        # Done when each node has one edge and no root is a node: then all edges are stars around roots.
        ends = now.select("a", F.lit(1).alias("n")).union(now.select("b", F.lit(0)).distinct())
        if ends.groupBy("a").agg(F.sum("n").alias("n"), F.count("*").alias("c")).where("n > 1 or c > 1").isEmpty():
            break
        out = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = out.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = saved(out.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), few=True)
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = saved(small.union(down.select("a", F.col("m").alias("b"))).distinct(), few=True)
        dropped(now, large)
        now = after
    else:
        raise RuntimeError("the components did not settle")
    roots = now.select(F.col("a").alias("id"), F.col("b").alias("root"))
    out = saved(roots.union(roots.select(F.col("root").alias("id"), "root").distinct()), few=True)
    dropped(now)
    return out


def may_link(size_a: Column, size_b: Column, rem_a: Column, rem_b: Column, over: int, under: int) -> Column:
    """Whether sets of these sizes that share at most the smaller rem can have a similarity of over/under."""
    fits = F.least(size_a, size_b) * under >= F.greatest(size_a, size_b) * over
    return fits & (F.least(rem_a, rem_b) * (over + under) >= (size_a + size_b) * over)


def prefix_lists(parts: DataFrame, sizes: DataFrame, over: int, under: int) -> DataFrame:
    """(token, id, size, rem): each set's rarest elements, as many as a partner must share one of.

    parts(id, element) without repeats, sizes(id, size) of all sets in parts. Elements of one set alone come first in its
    order and stand in no list: a set that has too many of them has no partner.
    """
    counts = saved(parts.groupBy("element").agg(F.count("*").alias("c")).where("c > 1"), few=True)
    shared = parts.join(counts, "element")
    order = Window.partitionBy("id")
    placed = shared.select("id", "element", F.row_number().over(order.orderBy("c", "element")).alias("at"), F.count("*").over(order).alias("met"))
    placed = placed.join(sizes, "id").withColumn("rem", F.col("met") - F.col("at") + 1)
    return placed.where(F.col("rem") * under >= F.col("size") * over).select(F.col("element").alias("token"), "id", "size", "rem")


def _apart(pairs: DataFrame, roots: DataFrame | None) -> DataFrame:
    """The pairs(a, b) that are not in one component of roots(id, root)."""
    if roots is None:
        return pairs
    a, b = (roots.select(F.col("id").alias(x), F.col("root").alias(f"_{x}")) for x in "ab")
    return pairs.join(a, "a", "left").join(b, "b", "left").where(F.coalesce("_a", "a") != F.coalesce("_b", "b")).select("a", "b")


def _stray_pairs(rest: DataFrame, over: int, under: int) -> DataFrame:
    """(a, b) of the sets of a list, one of them a stray, that may link. rest(token, id, size, rem, root, stray)."""
    kind = lambda x: F.floor(F.log(x) / F.log(F.lit(CLASS)))
    smallest = F.col("size") * over / under
    largest = F.least(F.col("size") * under / over, F.col("rem") * (over + under) / over - F.col("size"))
    strays = rest.where("stray").select("token", *[F.col(c).alias(f"_{c}") for c in ("id", "size", "rem", "root")], F.explode(F.when(largest + 0.02 >= smallest, F.sequence(kind(smallest - 0.01), kind(largest + 0.01)))).alias("kind"))
    others = rest.withColumn("kind", kind(F.col("size")))
    met = strays.join(others, ["token", "kind"]).where((F.col("root") != F.col("_root")) & (~F.col("stray") | (F.col("_id") < F.col("id"))))
    met = met.where(may_link(F.col("size"), F.col("_size"), F.col("rem"), F.col("_rem"), over, under))
    return met.select(F.least("id", "_id").alias("a"), F.greatest("id", "_id").alias("b"))


Verify = Callable[[DataFrame], DataFrame]


def _joined(roots: DataFrame | None, pairs: DataFrame, verify: Verify) -> DataFrame:
    """The components after the links among the pairs(a, b), which are apart."""
    found = saved(verify(pairs), few=True)
    if roots is None:
        return components(found)
    a, b = (roots.select(F.col("id").alias(x), F.col("root").alias(f"_{x}")) for x in "ab")
    # links between components, not between their members
    met = found.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b")).distinct()
    tops = components(met)
    moved = roots.join(tops.select(F.col("id").alias("root"), F.col("root").alias("top")), "root", "left").select("id", F.coalesce("top", "root").alias("root"))
    return saved(moved.union(tops.join(roots, "id", "left_anti").select("id", "root")), few=True)


def _shared(postings: DataFrame, central: bool) -> DataFrame:
    """(token, id, size, rem, pivot, _size, _rem, n) of the lists that have two sets or more, n of them, with their pivot, its size and rem.
    All rows are moved once. Without sizes all are 1."""
    by, sized = Window.partitionBy("token"), "size" in postings.columns
    before = [(F.col("size") - F.col("rem")).alias("before")] if central else []
    head = F.min(F.struct(*before, "id", *(["size", "rem"] if sized else []))).over(by)
    met = postings.where("token is not null").select("*", head.alias("_p"), F.min("id").over(by).alias("_first"), F.max("id").over(by).alias("_last")).where("_first <> _last")
    one = F.lit(1)
    met = met.select("token", "id", *(["size", "rem"] if sized else []), F.col("_p.id").alias("pivot"), *([F.col("_p.size").alias("_size"), F.col("_p.rem").alias("_rem")] if sized else [])).distinct()
    met = met.withColumn("n", F.count("*").over(by))
    return met if sized else met.withColumns({"size": one, "rem": one, "_size": one, "_rem": one})


def link(postings: DataFrame, verify: Verify, over: int = 4, under: int = 5, prepare: Callable[[DataFrame], DataFrame | None] | None = None, crowded: list[Callable[[DataFrame], DataFrame]] | None = None, known: DataFrame | None = None, central: bool = False, rounds: int = 1) -> DataFrame:
    """The components of the sets, (id, root) for those that have a partner, saved.

    postings(token, id, size, rem): the lists; rows may repeat. Without size and rem all sets are alike. rounds: the lists are dealt out in
    so many rounds, by their tokens, so that less of them is on disk at once; postings are read in each. verify gets pairs(a, b) without repeats and returns those of
    them that link, by exact similarity of at least over/under. prepare(ids) is called before that with all sets that have
    company, and may return their sizes(id, size), by which strays meet if postings has none. crowded[0](ids) gives other, finer lists (`prefix_lists`) in which sets of crowded lists meet their partners,
    crowded[1] those for what is crowded there, and so on; in the last ones all strays are compared.
    known(id, root): components from before. central: the pivot of a list is the set that has the fewest elements before it, as
    it can link with the most others; else the smallest id, which takes no sort.
    """
    parts = [saved(_shared(postings if rounds == 1 else postings.where(F.pmod("token", F.lit(rounds)) == i), central)) for i in range(rounds)]
    shared = reduce(DataFrame.union, parts)
    sizes = prepare(saved(shared.select("id").distinct(), few=True)) if prepare else None
    star = shared.where("id <> pivot").where(may_link(F.col("size"), F.col("_size"), F.col("rem"), F.col("_rem"), over, under))
    star = saved(_apart(star.select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct(), known), few=True)

    roots, width = known, 1
    while not star.isEmpty():
        order = Window.partitionBy("b").orderBy("a")
        ranked = saved(star.withColumn("at", F.row_number().over(order)), few=True)
        roots = _joined(roots, saved(ranked.where(F.col("at") <= width).select("a", "b"), few=True), verify)
        dropped(star)
        star = saved(_apart(ranked.where(F.col("at") > width).select("a", "b"), roots), few=True)
        width *= 4
    if roots is None:
        roots = saved(shared.select("id", F.col("id").alias("root")).where("false"), few=True)
    # A list of two needs no second look: the pair has been compared or cannot fit.
    placed = shared.where("id <> pivot and n > 2").withColumn("n", F.col("n") - 1)
    placed = placed.join(roots.select(F.col("id").alias("pivot"), F.col("root").alias("_p")), "pivot", "left").join(roots.select("id", F.col("root").alias("_r")), "id", "left")
    if sizes is not None:
        placed = placed.drop("size", "rem").join(sizes.select("id", "size", F.col("size").alias("rem")), "id")
    placed = placed.select("token", "id", "size", "rem", "n", F.coalesce("_r", "id").alias("root"), (F.coalesce("_r", "id") != F.coalesce("_p", "pivot")).alias("stray"))
    rest = saved(placed.withColumn("any", F.max("stray").over(Window.partitionBy("token"))).where("any").drop("any"))
    small = rest.where(F.col("n") < CROWDED) if crowded else rest
    pairs = saved(_apart(_stray_pairs(small, over, under).distinct(), roots), few=True)
    if not pairs.isEmpty():
        roots = _joined(roots, pairs, verify)
    if crowded:
        ids = saved(rest.where(F.col("n") >= CROWDED).select("id", "size").distinct(), few=True)
        if not ids.isEmpty():
            roots = link(crowded[0](ids), verify, over, under, crowded=crowded[1:], known=roots, central=True)
    dropped(*parts, rest, star)
    return roots


def _slots_met(pairs: DataFrame, meetings: int) -> DataFrame:
    """The distinct pairs(a, b) that meet in so many of their slots."""
    return pairs.distinct().groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= meetings).select("a", "b")


def _with_roots(rows: DataFrame, roots: DataFrame | None, column: str, root: str) -> DataFrame:
    """rows with the component of the ids of a column."""
    if roots is None:
        return rows.withColumn(root, F.col(column))
    named = roots.select(F.col("id").alias(column), F.col("root").alias("_named"))
    return rows.join(named, column, "left").withColumn(root, F.coalesce("_named", column)).drop("_named")


def _headed(lists: DataFrame) -> DataFrame:
    """(token, pivot, n) of the lists with two sets or more."""
    return lists.groupBy("token").agg(F.min("id").alias("pivot"), F.max("id").alias("last"), F.count("*").alias("n")).where("pivot <> last").drop("last")


def link_met(postings: DataFrame, verify: Verify, meetings: int, finer: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """The components of the sets, (id, root) for those that have a partner, saved, by pairs that share `meetings` slots or more.

    postings(token, slot, id): the lists; at first each slot is a list. A pair's slots are counted once over all lists, whether
    few or many sets are on them. verify gets pairs(a, b) without repeats and returns those that link.

    Pivots first, as in `link`; a pair may meet at different pivots, so that this only finds some of the pairs. Two sets of
    different components are not both in their list's pivot's, so in each list they share one of them is a stray: a join of
    the strays with all others of their lists (pivots too) sees every slot of such a pair, and the count is whole.

    finer[0](rows), of rows(slot, id) of crowded lists with strays, gives longer lists(token, slot, id) for these, where two sets
    of a slot may meet more than once; finer[1] those for what is crowded there still. These only join components early, at little
    cost: in the end all strays of the first lists are compared, crowded or not, so that no pair is lost.
    """
    first = lists = saved(postings.select("token", "slot", "id").distinct())
    roots, tried = None, None

    def still_open(met: DataFrame) -> DataFrame:
        """The rows of the lists that have strays."""
        placed = _with_roots(_with_roots(met, roots, "id", "root"), roots, "pivot", "_p").withColumn("stray", F.col("root") != F.col("_p"))
        open_lists = placed.groupBy("token").agg(F.max("stray").alias("any")).where("any").select("token")
        return saved(placed.join(open_lists, "token").select("token", "slot", "id", "n", "root", "stray"))

    for step in [*finer, None]:
        met = saved(lists.join(_headed(lists), "token"))
        star = _slots_met(met.where("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b"), "slot"), meetings)
        star = _apart(star if tried is None else star.join(tried, ["a", "b"], "left_anti"), roots)
        star, width = saved(star, few=True), 1
        while not star.isEmpty():
            ranked = saved(star.withColumn("at", F.row_number().over(Window.partitionBy("b").orderBy("a"))), few=True)
            now = saved(ranked.where(F.col("at") <= width).select("a", "b"), few=True)
            roots, tried = _joined(roots, now, verify), now if tried is None else tried.union(now)
            dropped(star)
            star = saved(_apart(ranked.where(F.col("at") > width).select("a", "b"), roots), few=True)
            width *= 4
        rest = still_open(met)
        dropped(met, *([] if lists is first else [lists]))
        if step is None or rest.where(F.col("n") >= CROWDED).isEmpty():
            break
        crowded = rest.where(F.col("n") >= CROWDED).select("slot", "id").distinct()
        lists = saved(rest.where(F.col("n") < CROWDED).select("token", "slot", "id").union(step(crowded).select("token", "slot", "id")).distinct())
        dropped(rest)
    if lists is not first:
        dropped(rest)
        rest = still_open(first.join(_headed(first), "token"))
    dropped(first)
    strays = rest.where("stray").select("token", F.col("id").alias("_id"), F.col("root").alias("_root"))
    both = strays.join(rest, "token").where((F.col("root") != F.col("_root")) & (~F.col("stray") | (F.col("_id") < F.col("id"))))
    pairs = _slots_met(both.select(F.least("id", "_id").alias("a"), F.greatest("id", "_id").alias("b"), "slot"), meetings)
    pairs = saved(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), few=True)
    if roots is None or not pairs.isEmpty():
        roots = _joined(roots, pairs, verify)
    return roots
