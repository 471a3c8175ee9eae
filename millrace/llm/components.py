"""Links between sets, and connected components, without pairing all members of a group.

``linked_components`` finds the components of the graph in which two sets are linked when
their Jaccard similarity reaches a bound, given postings such that linked sets share a key.
A posting says how many members of its set may still be shared where its key is the first
shared one; with the sizes this bounds every overlap before any members are compared, and
drops postings that no other of their list can meet. In each round every key's list picks
pivots, the sets with the largest part that may be shared; they are compared with those
that are not yet in their component, and leave the list. A group of g copies thus costs
about g comparisons, not g * g. Only pairs that already are in one component, or that the
bounds rule out, are left out, so no component is missed. The pivots of a list grow from
round to round, but never beyond ``PIVOTS``; rounds go on until no list has anything open.

Overlaps are entries of the product of the sets' incidence matrix with its transpose, and
only those that pivots ask for are computed: the columns are cut into blocks, each pair's
blocks meet, and their counts are accumulated.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import forget, map_batches, spread_join, stored

#: Pivots of a list at most, by round; the last number is for all rounds after.
PIVOTS = (1, 4, 16, 64)
#: Components are brought up to date when the links of the last rounds are at least one for so many open postings.
WORTH = 100
#: Columns of a set that stand in one row, about.
BLOCK_COLUMNS = 1024


def blocks_of(n: int) -> int:
    """Into how many blocks the columns of a set of that size are cut: a power of two."""
    return 1 << ((n - 1) // BLOCK_COLUMNS).bit_length()


def _blocks_of(n: Column) -> Column:
    above = F.floor((n - 1) / BLOCK_COLUMNS).cast("long")
    return F.when(above > 0, F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(above)))).otherwise(F.lit(1).cast("long"))


def column_blocks_of(columns: np.ndarray, n: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Blocks, block and columns of a set of size n: cut in as many as its size asks for, and, to meet sets of half as many blocks, in half as many."""
    blocks = blocks_of(n)
    if blocks == 1:
        yield 1, 0, columns
        return
    own = columns.astype(np.uint64) & np.uint64(blocks - 1)
    order = np.argsort(own, kind="stable")
    cuts = np.searchsorted(own[order], np.arange(blocks + 1))
    for k in range(blocks):
        part = columns[order[cuts[k] : cuts[k + 1]]]
        if len(part):
            yield blocks, k, part
            yield blocks // 2, k % (blocks // 2), part


#: The ids of so many pairs (8 bytes each) are sent to all tasks, to pick the sets that they ask for.
BROADCAST_PAIRS = 200_000
#: So many links (16 bytes each) are joined up in one task; more, by stars in all tasks.
LINKS_IN_ONE_TASK = 2_000_000


def joined_up(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of links and the smallest id that each reaches."""
    ids, of = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = of[: len(a)], of[len(a) :]
    low = np.arange(len(ids))
    while True:
        least = np.minimum(low[left], low[right])
        new = low.copy()
        np.minimum.at(new, low[left], least)
        np.minimum.at(new, low[right], least)
        while (new[new] != new).any():
            new = new[new]
        if (new == low).all():
            return ids, ids[low]
        low = new


def connected_components(edges: DataFrame, in_one_task: int = LINKS_IN_ONE_TASK) -> DataFrame:
    """``id, component``: for each id in the stored ``edges(a, b)`` the smallest id that it reaches.

    Up to ``in_one_task`` edges are joined up by one task. Beyond it, large stars and small stars alternate until nothing
    changes; each group is reduced to its minimum before it is shuffled.
    """
    if edges.count() > in_one_task:
        return components_by_stars(edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches]
        if links:
            ids, low = joined_up(*[np.concatenate(x) for x in zip(*links, strict=True)])
            for at in range(0, len(ids), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 100_000]) for x in (ids, low)], ["id", "component"])

    return map_batches(edges.select("a", "b").where("a <> b").coalesce(1), run, "id long, component long")


def components_by_stars(edges: DataFrame) -> DataFrame:
    """The same, however many edges there are."""
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state, n = None, now.count()
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count("*").alias("size")))
        large = spread_join(both.where("b > a"), least, ["a"], total=2 * n).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = large.unionByName(least.where("a <> m").select("a", F.col("m").alias("b"))).distinct()
        # After the large stars every id has few smaller neighbours.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        before, now = now, stored(small)
        forget(before, least)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        state, n = seen, seen[0]
    heads = now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(heads)


def with_links(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """The stored components ``labels(id, component)`` after new ``links(a, b)``: only the components that these join are looked at."""
    if labels is None:
        return stored(connected_components(stored(links)))
    ends = links.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    known = labels.unionByName(ends.join(labels, "id", "left_anti").select("id", F.col("id").alias("component")))
    of = lambda c: labels.select(F.col("id").alias(c), F.col("component").alias(f"{c}_2"))
    heads = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_2", "a").alias("a"), F.coalesce("b_2", "b").alias("b"))
    heads = stored(heads)
    moved = stored(connected_components(heads).select(F.col("id").alias("component"), F.col("component").alias("to")))
    sizes = known.groupBy("component").agg(F.count("*").alias("size"))
    table = stored(sizes.join(moved, "component", "left").select("component", F.coalesce("to", "component").alias("to"), "size"))
    out = stored(spread_join(known, table, ["component"]).select("id", F.col("to").alias("component")))
    forget(heads, moved, table)
    return out


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of ``pairs(a, b, na, nb)``, na and nb the sizes, those whose sets are linked: 100 * intersection >= percent * union, above 50 per cent.

    ``sets(id, n, blocks, block, h)`` has a row for each of ``column_blocks_of``; h may leave out members that no other set has.
    With ``bits, shared`` (see ``ngram_join.SPARSE``) pairs whose bits differ too much are dropped before their rows meet.
    """
    if percent <= 50:
        raise ValueError("sets that differ by more than half in size aren't cut alike")
    if "bits" in sets.columns:
        narrow = sets.where("bits is not null").select("id", "bits", "shared")
        for c in ("a", "b"):
            pairs = pairs.join(narrow.withColumnsRenamed({"id": c, "bits": f"bits_{c}", "shared": f"shared_{c}"}), c)
        odd = F.aggregate(F.zip_with("bits_a", "bits_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
        # What sets of these sizes may differ in, if they are linked; members that are left out differ in any case.
        differ = odd + F.col("na") - F.col("shared_a") + F.col("nb") - F.col("shared_b")
        pairs = pairs.where((100 + percent) * differ <= (100 - percent) * (F.col("na") + F.col("nb"))).select("a", "b", "na", "nb")
    pairs = stored(pairs)
    if pairs.count() <= BROADCAST_PAIRS:  # counted: then only the rows that are asked for are moved
        left_ids, right_ids = (F.broadcast(pairs.select(F.col(c).alias("id")).distinct()) for c in ("a", "b"))
        lefts, rights = sets.join(left_ids, "id", "left_semi"), sets.join(right_ids, "id", "left_semi")
    else:
        lefts = rights = sets
    asked = pairs.withColumn("blocks", _blocks_of(F.least("na", "nb")))
    left = lefts.select(F.col("id").alias("a"), "blocks", "block", F.col("h").alias("ha"))
    right = rights.select(F.col("id").alias("b"), "blocks", "block", F.col("h").alias("hb"))
    met = asked.join(left, ["a", "blocks"]).join(right, ["b", "blocks", "block"])
    shared = met.select("a", "b", "na", "nb", F.size(F.array_intersect("ha", "hb")).alias("o"))
    total = shared.groupBy("a", "b", "na", "nb").agg(F.sum("o").alias("o"))
    return total.where(100 * F.col("o") >= percent * (F.col("na") + F.col("nb") - F.col("o"))).select("a", "b")


def linked_components(postings: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``id, component`` of the ids that are linked with any other.

    ``postings(key, id, n, u)`` must give linked sets a common key; with that as the first common
    one no more than u members are shared. ``sets`` as in ``verified``.
    """
    # 100 * o >= percent * (a + b - o) with o <= u says: the other's size is at most u * (100 + percent) / percent - n.
    room = F.floor(F.col("u") * (100 + percent) / percent) - F.col("n")
    lists = stored(postings.select("key", "id", F.col("n").cast("long").alias("n"), "u").groupBy("key", "id", "n").agg(F.max("u").alias("u")).withColumn("room", room.cast("long")))
    labels = None
    done: list[DataFrame] = [lists]

    def may_link(n: Column, room_of_n: Column, m: Column, room_of_m: Column) -> Column:
        return (100 * n >= percent * m) & (100 * m >= percent * n) & (m <= room_of_n) & (n <= room_of_m)

    waiting: list[DataFrame] = []

    def up_to_date() -> DataFrame | None:
        now = with_links(labels, functools.reduce(DataFrame.unionByName, waiting)) if waiting else labels
        forget(*waiting, *([labels] if waiting and labels is not None else []))
        waiting.clear()
        return now

    found = 0
    for k in itertools.count():
        if labels is None:
            marked = lists.withColumn("label", F.col("id"))
        else:
            marked = lists.join(labels.withColumnRenamed("component", "label"), "id", "left").withColumn("label", F.coalesce("label", "id"))
        here = stored(marked.select("key", "id", "n", "u", "room", "label"))
        forget(*done)
        some = PIVOTS[min(k, len(PIVOTS) - 1)]
        best = F.max(F.struct((F.col("u") / F.col("n")).alias("x"), F.xxhash64("id", F.lit(k)).alias("y"), *[F.col(c).alias(c) for c in ("id", "n", "room", "label")])).alias("p")
        bounds = {"lo": F.min("label"), "hi": F.max("label"), "least": F.min("n"), "most": F.max("room")}
        parts = here.groupBy("key", F.pmod(F.xxhash64("id", F.lit(k)), F.lit(some)).alias("part")).agg(best, F.count("*").alias("size"), *[x.alias(c) for c, x in bounds.items()])
        again = {"lo": F.min("lo"), "hi": F.max("hi"), "least": F.min("least"), "most": F.max("most")}
        # A list whose members are all in one component has nothing more to say.
        picked = stored(parts.groupBy("key").agg(F.collect_list("p").alias("pivots"), F.sum("size").alias("size"), *[x.alias(c) for c, x in again.items()]).where("lo <> hi").drop("lo", "hi"))
        total = picked.agg(F.sum("size")).first()[0]
        done = [here, picked]
        if not total:
            forget(*done)
            break
        # Nor has a member that is too large or has too little room for all others.
        open_lists = spread_join(here, picked, ["key"], total=total).where("room >= least and n <= most")
        p = F.col("p")
        asked = F.filter("pivots", lambda x: (F.col("label") != x["label"]) & may_link(F.col("n"), F.col("room"), x["n"], x["room"]))
        met = open_lists.withColumn("p", F.explode(asked))
        first = F.col("id") < p["id"]
        pairs = met.select(F.least("id", p["id"]).alias("a"), F.greatest("id", p["id"]).alias("b"), F.when(first, F.col("n")).otherwise(p["n"]).alias("na"), F.when(first, p["n"]).otherwise(F.col("n")).alias("nb")).distinct()
        new = stored(verified(pairs, sets, percent))
        n_new = new.count()
        if n_new:
            found += n_new
            waiting.append(new)
        else:
            forget(new)
        if found * WORTH >= total:
            labels, found = up_to_date(), 0
        lists = open_lists.where(~F.exists("pivots", lambda x: x["id"] == F.col("id"))).select("key", "id", "n", "u", "room")
    labels = up_to_date()
    if labels is None:
        return sets.sparkSession.createDataFrame([], "id long, component long")
    return labels
