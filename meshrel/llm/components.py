"""Connected components by repeated contraction, in DataFrame operations only.

Each round sends every node to its smallest neighbour, follows that map once
more, and rebuilds the edges between what is left. Edge lists shrink
geometrically; nothing but counts reaches the driver, and each round's tables
are written to the shared folder, so a lost executor costs one round.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import discard, save

PARITY_WORDS = 16  # a power of two
LIGHT = 1024  # up to so many items, parities of 1024 bits part sets of similarity 0.7 from those of 0.8
BLOCK = 2048  # members of a group that meet in one task


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable, for every id on an edge (a, b). Loops, repeats and either order are fine."""
    e = save(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while not e.isEmpty():
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        nearest = save(both.groupBy("a").agg(F.least("a", F.min("b")).alias("p")), "nearest")
        again = nearest.select(F.col("a").alias("p"), F.col("p").alias("pp"))
        hop = save(nearest.join(again, "p", "left").select("a", F.coalesce("pp", "p").alias("p")), "hop")
        if labels is None:
            new = save(hop.select(F.col("a").alias("id"), F.col("p").alias("component")), "labels")
        else:
            new = save(relabel(labels, hop.select(F.col("a").alias("id"), F.col("p").alias("component"))), "labels")
        left = hop.select("a", F.col("p").alias("pa"))
        right = hop.select(F.col("a").alias("b"), F.col("p").alias("pb"))
        rest = e.join(left, "a").join(right, "b").where("pa <> pb")
        rest = save(rest.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
        discard(e, nearest, hop, labels)
        e, labels = rest, new
    return labels if labels is not None else e.select(F.col("a").alias("id"), F.col("b").alias("component"))


def relabel(labels: DataFrame, step: DataFrame) -> DataFrame:
    """labels (id, component) with each component taken to its own component in step."""
    return labels.join(step.select(F.col("id").alias("component"), F.col("component").alias("next")), "component", "left").select("id", F.coalesce("next", "component").alias("component"))


def parities(sets: DataFrame) -> DataFrame:
    """id, size and p0, p1, ...: for each of 64 * PARITY_WORDS hashed cells, whether the set (id, distinct 64-bit items) has an odd number of items there."""
    h = F.col("item")
    word = F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(PARITY_WORDS - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))
    each = [F.bit_xor(F.when(word == w, bit).otherwise(F.lit(0).cast("long"))).alias(f"p{w}") for w in range(PARITY_WORDS)]
    # outer: an inner explode would have the optimizer compute all items a second time, below the join, to see whether there are any
    return sets.select("id", F.explode_outer("items").alias("item")).groupBy("id").agg(F.count("item").alias("size"), *each)


def link_groups(members: DataFrame, verify: Callable[[DataFrame, DataFrame], DataFrame], fetch: Callable[[DataFrame], DataFrame], items: Column, percent: int, read: Sequence[DataFrame] = ()) -> DataFrame:
    """Components of verified links between members of like groups: (id, component) for linked ids.

    members: (key, id), each key's ids candidates of one another. First every id
    is tested against its group's most central one (the id whose groups are
    largest in sum), which settles groups of copies in linear work. Where ids of
    one group still lie in different components, every pair across components
    is tested within the join, in the first group that both share, and few leave
    it that do not hold. Pairs are passed over that the distances to the centre
    rule out (1 - similarity is a metric) or the parities of their sets: two sets
    differ in at least as many items as bits of their parities. So no link is
    lost. Sets above ``LIGHT`` items, for which the parities are too short, travel
    whole and are compared in the join; the pairs that leave it are verified.
    fetch gives ids what they hold (id, payload), once for all tests; verify gives
    each pair (a, b), from that, its similarity and whether it holds (ok); items is
    the set in a payload, for which a pair holds if 100 * intersection >= percent * union;
    read: saved tables that only members reads, deleted as soon as it has been.
    """
    # exchanged once: count(id) keeps both columns, so that the join reads the exchange that the count has read. Few keys
    # repeat: they are looked up, where a merge would sort every member
    by_key = members.repartition("key")
    sizes = by_key.groupBy("key").agg(F.count("id").alias("n")).where("n > 1")
    groups = save(by_key.join(sizes.hint("shuffle_hash"), "key").select("key", "id", "n"), "groups")
    discard(*read)
    weight = groups.groupBy("id").agg(F.sum("n").alias("w"))
    centres = groups.select("key", "id").join(weight, "id").groupBy("key").agg(F.max(F.struct("w", (-F.col("id")).alias("i"))).alias("top"))
    shared = save(groups.select("key", "id").join(centres.select("key", (-F.col("top.i")).alias("m")), "key"), "centred")
    stars = shared.where("id <> m").select(F.col("id").alias("a"), F.col("m").alias("b")).distinct()
    held = save(fetch(weight.select("id")), "held")
    tested = save(verify(stars, held), "tested")
    found = tested.where("ok").select("a", "b")
    labels = connected_components(found)
    # centres have been tested against all members of their groups: what is left are pairs of others
    placed = shared.where("id <> m").join(labels, "id", "left").select("key", "id", "m", F.coalesce("component", "id").alias("c"))
    counts = placed.groupBy("key", "c").agg(F.count("*").alias("n"))
    mixed = counts.groupBy("key").agg(F.count("*").alias("several"), F.max(F.struct("n", "c")).alias("top")).where("several > 1").select("key", F.col("top.c").alias("main"))
    placed = placed.join(mixed, "key").join(tested.select(F.col("a").alias("id"), F.col("b").alias("m"), "similarity"), ["id", "m"])
    placed = save(placed.select("key", "id", "c", "similarity", (F.col("c") == F.col("main")).alias("main")), "mixed")
    discard(groups, shared)
    if placed.isEmpty():
        return labels
    keys = placed.groupBy("id").agg(F.array_sort(F.collect_list("key")).alias("keys"))
    parity = save(parities(keys.join(held, "id").select("id", items.alias("items"))), "parities")
    heavy = parity.where(F.col("size") > LIGHT).select("id").join(held, "id").select("id", items.alias("items"))
    described = save(keys.join(parity, "id").join(heavy, "id", "left"), "described")
    # a pair across components has at most one member in its group's largest component (main): that one is always y;
    # the y of a large group are dealt out in blocks, each of which meets all its x
    blocks = placed.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = save(placed.join(blocks, "key"), "dealt")
    x = dealt.where("not main").join(described, "id").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).alias("x")
    y = dealt.join(described, "id").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).alias("y")
    cheap = (F.col("y.main") | (F.col("x.id") > F.col("y.id"))) & (F.col("x.c") != F.col("y.c")) & (F.abs(F.col("x.similarity") - F.col("y.similarity")) <= 1 - percent / 100 + 1e-9)
    cheap &= 100 * F.least("x.size", "y.size") >= percent * F.greatest("x.size", "y.size")
    # 100 * c >= percent * u, where c = (s - d) / 2 and u = (s + d) / 2 for sizes of s in sum and d items in one set only
    apart = sum((F.bit_count(F.col(f"x.p{w}").bitwiseXOR(F.col(f"y.p{w}"))) for w in range(PARITY_WORDS)), F.lit(0))
    near = (100 + percent) * apart <= (100 - percent) * (F.col("x.size") + F.col("y.size"))
    own = F.element_at(F.array_intersect("x.keys", "y.keys"), 1) == F.col("x.key")
    common = F.size(F.array_intersect("x.items", "y.items"))
    whole = F.col("x.items").isNotNull() & F.col("y.items").isNotNull()
    holds = F.when(whole, 100 * common >= percent * (F.col("x.size") + F.col("y.size") - common)).otherwise(True)
    test = F.when(cheap, F.when(near, F.when(own, holds).otherwise(False)).otherwise(False)).otherwise(False)
    likely = save(x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.block") == F.col("y.block")) & test).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")), "crossed")
    named = labels.select("id", "component")
    more = verify(likely, held).where("ok").select("a", "b")
    # what the crossing pairs add lies between components: only their graph is contracted again
    for k in ("a", "b"):
        more = more.join(named.select(F.col("id").alias(k), F.col("component").alias(f"c{k}")), k, "left").withColumn(k, F.coalesce(f"c{k}", k)).drop(f"c{k}")
    more = connected_components(more)
    out = labels.unionByName(more.join(labels, "id", "left_anti").select("id", F.col("id").alias("component")))
    out = save(relabel(out, more), "linked")
    discard(placed, dealt, parity, described, likely, held, tested, labels, more)
    return out
