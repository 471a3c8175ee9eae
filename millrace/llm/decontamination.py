"""Benchmark decontamination by spaced seeds, with DataFrame operations only.

Texts are words: lower-cased runs of letters and digits, so marks and white space make no
difference. Each mask says which words
of a run count; the words under its ones are hashed together with the mask's number, so a
substituted word under a zero doesn't hide a copy. Test and training hashes are joined. A
hit fixes an item and a shift; the item is laid along the document at that shift, and
substitutions are tolerated: of some ``window`` consecutive item words (all, of a shorter
item) at least ``percent`` must agree. So a short line that an item happens to share with
many documents contaminates none of them.

Hashes meet on the map side, next to the words that verify them, while the benchmark's
hashes number at most ``BROADCAST_HASHES``; beyond that both sides are shuffled by hash.

Defined results: null texts, texts with fewer words than the lightest mask and items of fewer than
``LEAST_WORDS`` words match nothing; texts of any length are read whole; repeated rows, and rows with equal ids,
are reported once for each (id, item); a null id or item is reported like another; empty
tables give an empty table. Only the named columns are read, so other columns can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import stored, with_rows

#: The masks. Words under a 1 are hashed. The second row is for items of five words, where one substitution may leave no run to the others.
MASKS = ("1111", "11011", "1001011")
SHORT_MASKS = ("1011", "1101")
#: Items of fewer words match nothing: they would be found by chance.
LEAST_WORDS = 4
WINDOW, PERCENT = 20, 80
BROADCAST_HASHES = 500_000
GAPS = r"[^\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """The words in order; an empty one stands first or last where the text begins or ends with other characters."""
    return F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), GAPS)


def seed_hashes(first: Column, tokens: Column, at: Column, masks: tuple[str, ...]) -> Column:
    """The hash under each mask of the run that begins at ``at``; null where the run doesn't fit."""
    return F.array(
        *[
            F.when(at + len(mask) <= F.size(tokens), F.xxhash64(F.lit(k), first, *[F.get(tokens, at + j) for j in range(1, len(mask)) if mask[j] == "1"]))
            for k, mask in enumerate(masks)
        ]
    )


def seeds(rows: DataFrame, keep: list[str], masks: tuple[str, ...]) -> DataFrame:
    """``keep``, ``at`` and ``seed`` for every place and mask of ``t``.

    The outer form keeps the optimizer from splitting each text once more to filter empty arrays, which can't occur.
    """
    placed = rows.select(*keep, "t", F.posexplode_outer("t").alias("at", "w"))
    return placed.select(*keep, "at", F.explode(seed_hashes(F.col("w"), F.col("t"), F.col("at"), masks)).alias("seed")).where("seed is not null")


def needed(length: Column, window: int, percent: int) -> Column:
    """How many words of a window, or of a shorter item, must agree."""
    return F.ceil(F.least(length, F.lit(window)) * percent / 100)


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, percent: int = PERCENT, broadcast_hashes: int = BROADCAST_HASHES) -> DataFrame:
    """``doc_id, item_id, item_words, matched`` for each document and the items copied in it; ``matched`` counts the agreeing words at the best shift."""
    rows = docs.select("doc_id", words(F.col("text")).alias("t"))
    items = stored(benchmark.select("item_id", F.filter(words(F.col("text")), lambda w: w != "").alias("b")).where(F.size("b") >= LEAST_WORDS).distinct())
    masks = MASKS + (SHORT_MASKS if items.where(F.size("b") == 5).limit(1).count() else ())
    test = stored(seeds(items.select("item_id", F.col("b").alias("t")), ["item_id"], masks).select("seed", "item_id", F.col("at").alias("item_at")).distinct())
    small = test.count() <= broadcast_hashes
    if small:
        placed = rows.select("doc_id", "t", F.posexplode_outer("t").alias("at", "w"))
        train = placed.select("doc_id", "t", "at", F.explode(seed_hashes(F.col("w"), F.col("t"), F.col("at"), masks)).alias("seed"))
        hits = train.join(F.broadcast(test), "seed").select("doc_id", "t", "item_id", (F.col("at") - F.col("item_at")).alias("shift"))
        laid = hits.join(F.broadcast(items), hits["item_id"].eqNullSafe(items["item_id"])).select("doc_id", "t", hits["item_id"], "b", "shift")
    else:
        hits = seeds(rows, ["doc_id"], masks).join(test, "seed").select("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
        laid = hits.join(rows.withColumnRenamed("doc_id", "d"), F.col("doc_id").eqNullSafe(F.col("d"))).join(items.withColumnRenamed("item_id", "i"), F.col("item_id").eqNullSafe(F.col("i"))).select("doc_id", "t", "item_id", "b", "shift")
    agree = F.transform("b", lambda w, k: F.when(F.col("shift") + k >= 0, F.get("t", F.col("shift") + k)).eqNullSafe(w).cast("int"))
    add = lambda s, x: s + x
    length = F.size("agree")
    scored = laid.select("doc_id", "item_id", "shift", agree.alias("agree")).withColumn("matched", F.aggregate("agree", F.lit(0), add))
    likely = scored.where(F.col("matched") >= needed(length, window, percent)).groupBy("doc_id", "item_id", "shift", "agree").agg(F.max("matched").alias("matched"))
    starts = F.sequence(F.lit(1), F.greatest(length - window + 1, F.lit(1)))
    best = F.array_max(F.transform(starts, lambda i: F.aggregate(F.slice("agree", i, F.lit(window)), F.lit(0), add)))
    found = likely.where(best >= needed(length, window, percent))
    return found.groupBy("doc_id", "item_id").agg(F.max(length).cast("long").alias("item_words"), F.max("matched").cast("long").alias("matched"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows that no item is copied in, with all their columns, each judged by itself whatever its id."""
    rows = with_rows(docs)
    own = rows.select(F.col("__row").alias("doc_id"), "text")
    bad = stored(contaminated(own, benchmark).select(F.col("doc_id").alias("__row")).distinct())
    return rows.join(bad, "__row", "left_anti").select(*docs.columns)
