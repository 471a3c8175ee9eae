"""Windows of words, banded by their least hash, and spans of words from windows that occur again.

A window is ``RUN`` words in a row, wherever lines begin and end. Its band is one minimum
hash: the leftmost of the least hashes of its ``ANCHOR``-word shingles, so equal windows
collide with certainty. Windows in a row with the same minimum are a segment: a row, instead
of one for each word. Segments equal as a whole are a class, summed before it is shuffled.
Only where a minimum has different classes are the windows of one segment of each class
looked at, in their texts, and held against each other word by word (by 64-bit hashes of
all their words, besides the equal minimum).

Of each window's occurrences the first in (document, row, place) stays; the words of all
others are repeated, but for those that the first one itself has where the two overlap.
Overlapping and touching windows are one span.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import forget, spread_join, stored
from millrace.llm.text_arrays import mixed, powers

RUN, ANCHOR = 50, 13
_BACK = np.uint64(pow(int(powers(2)[1]), -1, 1 << 64))


class Hashed:
    """Hashes of any run of words from sums of powers."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        self.sums = np.append(np.uint64(0), np.cumsum(words * powers(n), dtype=np.uint64)) if n else np.zeros(1, np.uint64)
        back = np.full(n + 1, _BACK, np.uint64)
        back[0] = 1
        self.back = np.multiply.accumulate(back)

    def runs(self, at: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        """The hash of the ``size`` words from each place ``at``."""
        return mixed((self.sums[at + size] - self.sums[at]) * self.back[at])


def leftmost_least(x: np.ndarray, span: int) -> np.ndarray:
    """The place of the leftmost least number in each ``span`` numbers in a row."""
    low, width = np.arange(len(x)), 1
    while width < span:
        step = min(width, span - width)
        left, right = low[:-step], low[step:]
        low = np.where(x[right] < x[left], right, left)
        width += step
    return low


def segments(words: np.ndarray, counts: np.ndarray, run: int) -> tuple[np.ndarray, ...]:
    """Of many texts' words, the segments: text, place (of all words), number of windows, minimum and hash of all words."""
    anchor = min(ANCHOR, run)
    empty = np.zeros(0, np.int64)
    if len(words) < run:
        return empty, empty, empty, empty.view(np.uint64), empty.view(np.uint64)
    hashed = Hashed(words)
    shingles = hashed.runs(np.arange(len(words) - anchor + 1), anchor)
    low = leftmost_least(shingles, run - anchor + 1)
    ends = np.cumsum(counts)
    of = np.repeat(np.arange(len(counts)), counts)[: len(low)]
    whole = np.flatnonzero(np.arange(len(low)) + run <= ends[of])
    new = np.append(True, (low[whole][1:] != low[whole][:-1]) | (np.diff(whole) > 1))[: len(whole)]
    first = np.flatnonzero(new)
    at, n = whole[first], np.diff(np.append(first, len(whole)))
    return of[at], at, n, shingles[low[at]], hashed.runs(at, n + run - 1)


def classes_of(found: DataFrame) -> DataFrame:
    """Classes of ``found(doc_id, row, at, n, start, mid, end, a, b)``, a the minimum and b the hash: ``size``, the ``first`` place and whether the minimum is ``met`` by others."""
    place = F.struct("doc_id", "row", "at", "start", F.col("mid").alias("stop"), "end")
    classes = stored(found.groupBy("a", "b", "n").agg(F.count("*").alias("size"), F.min(place).alias("first")))
    several = stored(classes.groupBy("a").agg(F.count("*").alias("classes")).withColumn("met", F.col("classes") > 1))
    out = stored(spread_join(classes, several, ["a"], size="classes"))
    forget(classes, several)
    return out


def spans_of(found: DataFrame, classes: DataFrame, windows: DataFrame, run: int) -> DataFrame:
    """``doc_id, row, start, end, n_words, keep_doc_id, keep_start, removed`` of all spans of windows that occur again.

    ``windows(a, b, n, doc_id, row, at, start, stop, h, size, head)`` are those of the first
    segments of the classes that meet others; ``size`` is the class's, ``head`` marks the first.
    """
    place = F.struct("doc_id", "row", "at", "start", "stop")
    groups = stored(windows.groupBy("a", "h").agg(F.sum("size").alias("total"), F.count("*").alias("size"), F.min(place).alias("keep")).where("total > 1").drop("total"))
    parts = spread_join(windows.drop("size"), groups, ["a", "h"])
    columns = ["doc_id", "row", "at", "until", "start", "end", "keep"]
    met = parts.withColumn("until", F.col("at") + run).withColumn("end", F.col("stop")).select(*columns)
    # The first window of a class's first segment: what stays of it stands for the class.
    heads = parts.where("head").select("a", "b", "n", F.col("keep").alias("head"))
    again = classes.where("size > 1").join(heads, ["a", "b", "n"], "left")
    own = F.struct(*[F.col(f"first.{c}").alias(c) for c in ("doc_id", "row", "at", "start", "stop")])
    again = stored(again.select("a", "b", "n", "size", "met", "first", F.coalesce("head", own).alias("keep")))
    members = spread_join(found, again.drop("met"), ["a", "b", "n"]).withColumn("until", F.col("at") + F.col("n") + run - 1)
    others = members.where((F.col("row") != F.col("first.row")) | (F.col("at") != F.col("first.at"))).select(*columns)
    alone = again.where("not met").select("first.*", "n", "keep").withColumn("until", F.col("at") + F.col("n") + run - 1).select(*columns)
    same_row = F.col("row") == F.col("keep.row")
    all_found = met.unionByName(others).unionByName(alone).withColumn("removed", ~(same_row & (F.col("at") == F.col("keep.at"))))
    # Where the repeat overlaps the one that stays, that one's words stay.
    overlap = F.col("removed") & same_row & (F.col("at") < F.col("keep.at") + run)
    all_found = all_found.withColumn("start", F.when(overlap, F.col("keep.stop")).otherwise(F.col("start"))).withColumn("at", F.when(overlap, F.col("keep.at") + run).otherwise(F.col("at")))
    order = Window.partitionBy("row", "removed").orderBy("at", "until")
    reached = F.max("until").over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = all_found.withColumn("new", F.coalesce((F.col("at") > reached).cast("int"), F.lit(1)))
    spans = spans.withColumn("span", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    out = spans.groupBy("doc_id", "row", "removed", "span").agg(F.min("start").alias("start"), F.max("end").alias("end"), (F.max("until") - F.min("at")).cast("int").alias("n_words"), F.min(F.struct("at", "keep")).alias("f"))
    return out.select("doc_id", "row", "start", "end", "n_words", F.col("f.keep.doc_id").alias("keep_doc_id"), F.col("f.keep.start").alias("keep_start"), "removed")
