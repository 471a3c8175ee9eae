"""Fingerprints from improbable features: entropy-ranked byte windows in chained Bloom filters.

First, all documents: how often each level of entropy occurs among all windows of
``WINDOW`` bytes. A window's rank is how frequent its level is; rare ranks are improbable.
Then, each text: in every run of ``SPAN`` windows the leftmost one of the lowest rank gets
a vote, windows with at least ``VOTES`` votes are features, as is the choice of a run that
has no such window, so each run has one in texts of any length. Each different feature sets
``HASHES`` bits in the current filter of ``FILTER_BITS`` bits; after ``PER_FILTER``
features a new filter begins. Two fingerprints are compared by the bits that their filters
share beyond chance, as a part of the most that they could share.

The written form is ``n1.n2...:hex``: the features of each filter, then the filters.

Defined results: a null text is an empty text, with the fingerprint ``:``; a text shorter
than a window is one feature; two empty fingerprints are alike (1), an empty and another
are not (0); equal texts have equal fingerprints; texts of any length are read whole;
rows with equal ids are ordered by text, null ids come first, so repeated rows are each
other's next document; an only row is its own next; an empty table gives an empty table.
Only the id and text columns are read, so other columns can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import map_batches, n_blocks
from millrace.llm.text_arrays import mixed

WINDOW, SPAN, VOTES = 16, 24, 6
LEVELS = 1000
FILTER_BITS, PER_FILTER, HASHES = 2048, 128, 5
#: Bytes whose windows are worked on at a time.
BLOCK = 1 << 20

_F = np.array([0.0, *(c * np.log2(c) for c in range(1, WINDOW + 1))])
#: What one more byte that is c times in the window adds to sum(c * log2 c), in 2^-20 steps so that sums are exact.
_STEP = np.rint(np.diff(_F) * (1 << 20)).astype(np.int64)
_FULL = WINDOW * np.log2(WINDOW) * (1 << 20)


def window_levels(data: np.ndarray) -> np.ndarray:
    """The entropy level, 0 to LEVELS, of each window of a text's bytes."""
    if len(data) < WINDOW:
        return np.zeros(0, np.int64)
    before, after = np.zeros(len(data), np.uint8), np.zeros(len(data), np.uint8)
    for k in range(1, WINDOW):
        same = (data[k:] == data[:-k]).view(np.uint8)
        before[k:] += same
        after[:-k] += same
    total = np.cumsum(_STEP[before])
    total[WINDOW:] -= np.cumsum(_STEP[after[:-WINDOW]])
    return ((1 - total[WINDOW - 1 :] / _FULL) * LEVELS + 0.5).astype(np.int64).clip(0, LEVELS)


def blocks(data: np.ndarray) -> Iterator[np.ndarray]:
    """Overlapping stretches such that each window is in exactly one of them."""
    for at in range(0, max(1, len(data) - WINDOW + 1), BLOCK):
        yield data[at : at + BLOCK + WINDOW - 1]


def level_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """How many windows of all texts have each level: LEVELS + 1 numbers, whatever the input's size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LEVELS + 1, np.int64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                for part in blocks(np.frombuffer(x or b"", np.uint8)):
                    total += np.bincount(window_levels(part), minlength=LEVELS + 1)
        level = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(level, pa.int64()), pa.array(total[level], pa.int64())], ["level", "windows"])

    out = np.zeros(LEVELS + 1, np.int64)
    counted = map_batches(docs.select(F.col(text_col).cast("string").cast("binary").alias("text")), run, "level long, windows long")
    for r in counted.groupBy("level").agg(F.sum("windows").alias("windows")).collect():
        out[r["level"]] = r["windows"]
    return out


def ranks_of(counts: np.ndarray) -> np.ndarray:
    """The rank of each level: 0 for the rarest; levels of equal counts in their own order."""
    out = np.empty(len(counts), np.int64)
    out[np.argsort(counts, kind="stable")] = np.arange(len(counts))
    return out


def feature_hashes(data: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Hashes of a text's different features in order of their first place."""
    if not len(data):
        return np.zeros(0, np.uint64)
    if len(data) < WINDOW:
        return np.frombuffer(hashlib.sha1(data.tobytes()).digest()[:8], np.uint64)
    rank = np.concatenate([ranks[window_levels(x)] for x in blocks(data)])
    # Rank and place in one number: its minimum is the leftmost of the lowest rank.
    key = (rank << 40) | np.arange(len(rank))
    span = min(SPAN, len(key))
    low, width = key, 1
    while width < span:
        step = min(width, span - width)
        low = np.minimum(low[:-step], low[step:])
        width += step
    votes = np.bincount(low & ((1 << 40) - 1), minlength=len(key))
    low &= (1 << 40) - 1
    chosen = votes >= VOTES
    # A run without such a window (of a period below VOTES, or of one level) has its own choice.
    before = np.append(0, np.cumsum(chosen))
    chosen[low[before[span:] == before[:-span]]] = True
    places = np.flatnonzero(chosen)
    windows = np.lib.stride_tricks.sliding_window_view(data, WINDOW)[places]
    halves = np.ascontiguousarray(windows).view("<u8")
    h = mixed(mixed(halves[:, 0]) + halves[:, 1])
    _, first = np.unique(h, return_index=True)
    return h[np.sort(first)]


class Fingerprint:
    """A chain of filters, as packed bits, with the number of features and of bits of each."""

    def __init__(self, data: bytes, ranks: np.ndarray):
        h = feature_hashes(np.frombuffer(data, np.uint8), ranks)
        self.sizes = [min(PER_FILTER, len(h) - at) for at in range(0, len(h), PER_FILTER)]
        bits = np.zeros((len(self.sizes), FILTER_BITS), bool)
        chain = np.arange(len(h)) // PER_FILTER
        for k in range(HASHES):
            bits[chain, (h >> np.uint64(11 * k)) % np.uint64(FILTER_BITS)] = True
        self.filters = np.packbits(bits, axis=1)
        self.weights = bits.sum(axis=1)

    def __str__(self) -> str:
        return ".".join(map(str, self.sizes)) + ":" + self.filters.tobytes().hex()


def likeness(a: Fingerprint, b: Fingerprint) -> float:
    """0 to 1: for each filter of the shorter chain the best match in the longer, weighted by features."""
    if not len(a.sizes) or not len(b.sizes):
        return float(len(a.sizes) == len(b.sizes))
    if len(a.sizes) > len(b.sizes) or (len(a.sizes) == len(b.sizes) and str(a) > str(b)):
        a, b = b, a
    total = 0.0
    for size, own, weight in zip(a.sizes, a.filters, a.weights, strict=True):
        shared = np.bitwise_count(b.filters & own).sum(axis=1)
        chance = weight * b.weights / FILTER_BITS
        most = np.minimum(weight, b.weights)
        score = np.where(most > chance, (shared - chance) / np.maximum(most - chance, 1e-9), shared == most).astype(np.float64)
        # Fewer bits beyond chance than a single shared feature brings aren't a match.
        score[shared - chance < np.minimum(HASHES, most) * (1 - b.weights / FILTER_BITS) - 1e-9] = 0.0
        total += size * max(0.0, float(score.max()))
    return min(1.0, total / sum(a.sizes))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: np.ndarray | None = None) -> DataFrame:
    """``<id>, fingerprint`` of each row; the ranks are learned from ``docs`` where none are given."""
    sent = docs.sparkSession.sparkContext.broadcast(ranks_of(level_counts(docs, text_col)) if ranks is None else ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([str(Fingerprint(x or b"", sent.value)) for x in batch.column(1).to_pylist()], pa.string())], ["id", "fingerprint"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return map_batches(rows, run, "id long, fingerprint string").withColumnRenamed("id", id_col)


def in_id_order(docs: DataFrame) -> DataFrame:
    """``bucket, last, id, no_id, text`` such that, within a bucket in order of (last, id, text), each row is followed by the next document; rows marked ``last`` are borrowed from the next bucket.

    Buckets are ranges of ids. Their beginnings come from a range partitioning of the ids
    alone: as many numbers as there are buckets. The texts are shuffled once, and a bucket
    is walked as a stream and never held whole.
    """
    no_id = F.col("doc_id").isNull()
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"), no_id.alias("no_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = n_blocks(docs)
    ranges = rows.select("id").repartitionByRange(n, "id").groupBy(F.spark_partition_id().alias("p")).agg(F.min("id").alias("id"))
    sent = docs.sparkSession.sparkContext.broadcast(np.array(sorted(r["id"] for r in ranges.select("id").collect()), np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = sent.value
        for batch in batches:
            ids = batch.column(0).to_numpy()
            bucket = np.searchsorted(firsts, ids, "right") - 1
            begins = firsts[bucket] == ids
            yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), pa.array(np.zeros(len(ids), bool)), *batch.columns], ["bucket", "last", "id", "no_id", "text"])
            if begins.any():  # the first bucket's beginning follows the last bucket's end
                own = batch.filter(pa.array(begins))
                yield pa.RecordBatch.from_arrays([pa.array(((bucket[begins] - 1) % len(firsts)).astype(np.int32)), pa.array(np.ones(own.num_rows, bool)), *own.columns], ["bucket", "last", "id", "no_id", "text"])

    placed = map_batches(rows, run, "bucket int, last boolean, id long, no_id boolean, text string")
    return placed.repartition(n, "bucket").sortWithinPartitions("bucket", "last", "id", "text")


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by as much of the next document's beginning."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut] if cut else text


def edit_study(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint against those of its edited text and of the next document."""
    sent = docs.sparkSession.sparkContext.broadcast(ranks_of(level_counts(docs)))
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = sent.value
        held = None  # the row that waits for its successor
        for batch in batches:
            out = []
            for bucket, last, i, no_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = Fingerprint(text.encode("utf-8"), ranks)
                if held is not None and held[0] == bucket:
                    _, was, its = held[1:]
                    changed = edited(was, text)
                    raw = changed.encode("utf-8")
                    new = Fingerprint(raw, ranks)
                    out.append((held[1], len(was), hashlib.sha256(raw).hexdigest(), str(its), str(new), likeness(its, new), likeness(its, own)))
                held = None if last else (bucket, None if no_id else i, text, own)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kinds[k]) for k in range(len(names))], names)

    return map_batches(in_id_order(docs), run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
