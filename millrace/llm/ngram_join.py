"""Exact Jaccard join of documents on their word n-grams, as a blocked sparse product.

The document by n-gram incidence matrix is cut into blocks of columns by the n-gram's
hash. A block keeps the columns that at least two documents have, with their counts;
brought back together by document they are the sparse rows. Size-derived bounds then
discard rows and pairs:

* a document with fewer than 75 % shared n-grams can't be linked;
* of its shared n-grams, ordered from rare to frequent, a linked pair must have one in
  common among the first ``shared - ceil(0.75 n) + 1`` (those that only one document has
  would come first), so that lines which very many documents share propose no pairs;
* sizes must be within 75 % of each other;
* where the first shared n-gram stands at place p of a document's ``shared``, no more than
  ``shared - p`` can be common, which must suffice for both;
* bits that say whether an odd number of a document's n-grams fall on them differ between
  two documents in no more places than the n-grams do; where they differ in too many, the
  pair's rows needn't meet.

Of the product of the matrix with its transpose, the entries that are left are computed
block by block: each pair's counts of common columns are accumulated over blocks of columns
(see ``components``). Equal sets are one class from the start, and each task sends a class's
columns once, however many copies it sees.

Defined results: a null text and one without words have an empty set, link with nothing
and are their own component; a row without an id is linked like any other, and its component
is the smallest id that it reaches, or null where there is none; repeated rows, and rows of
equal ids, stay and are told apart by their number; an empty table gives an empty table. Only
the id and text columns are read, so other columns can't clash (names that begin with two
underscores are the operator's own).
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import forget, map_batches, n_blocks, spread_join, stored, with_rows
from millrace.llm.components import BLOCK_COLUMNS, column_blocks_of, linked_components
from millrace.llm.text_arrays import frequent, mixed, set_print, shingle_sets

#: Entries that a task gathers before it sends blocks, and sorts at a time; classes it remembers.
FLUSH_ENTRIES, SORT_ENTRIES = 1_000_000, 500_000
SEEN_LIMIT = 2_000_000
COLUMN_BYTES = 6
#: A column that so many documents of a task's entries have is known to be frequent: it isn't counted in its block.
FREQUENT = 255


def set_prints(rows: DataFrame, n: int) -> DataFrame:
    """``id, row, n, p1, p2`` of ``rows(id, row, text)``: the size of each set and what stands for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets([x or b"" for x in batch.column(2).to_pylist()], n)
            prints = [set_print(x) for x in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(x) for x in sets], pa.int64()), pa.array([x[0] for x in prints], pa.int64()), pa.array([x[1] for x in prints], pa.int64())], ["id", "row", "n", "p1", "p2"])

    return map_batches(rows, run, "id long, row long, n long, p1 long, p2 long")


def rows_by_task(batch_rows: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
    for batch in batch_rows:
        yield from batch.column(1).to_pylist()


def steps(ids: np.ndarray) -> bytes:
    """The differences between neighbours: ids of a scan lie close together, so that these compress."""
    return np.diff(ids, prepend=0).tobytes()


def column_blocks(rows: DataFrame, n: int, blocks: int) -> DataFrame:
    """``block, payload``: the entries of the matrix by block of columns, for one document of each class and task.

    Of a column, the block's number and ``COLUMN_BYTES`` bytes are kept: enough for chance
    to make two columns of a pair of documents one about once in 2^50. Entries of columns
    that are frequent in a task don't meet in one place: they travel apart (as block -1 and
    below) and leave a mark, a document of size 0, in the column's block.
    """

    def payload(ids: np.ndarray, sizes: np.ndarray, own: np.ndarray, *columns: np.ndarray) -> bytes:
        first = np.flatnonzero(np.append(True, np.diff(own) != 0))
        docs = own[first]
        count = np.diff(np.append(first, len(own))).astype(np.int32)
        return b"".join([np.int64(len(docs)).tobytes(), np.int64(len(own)).tobytes(), steps(ids[docs]), sizes[docs].astype(np.int32).tobytes(), count.tobytes(), *[x.tobytes() for x in columns]])

    def packed(row_ids: list[int], sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        ids = np.array([*row_ids, row_ids[-1]], np.int64)
        sizes = np.array([*map(len, sets), 0], np.int64)
        h = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        often = frequent(h, FREQUENT)
        if often.any():
            mine = h[often]
            keys = (mine // np.uint64(blocks) & np.uint64((1 << 8 * COLUMN_BYTES) - 1)) * np.uint64(blocks) + mine % np.uint64(blocks)
            yield pa.RecordBatch.from_arrays([pa.array([-1 - row_ids[0] % blocks], pa.int32()), pa.array([payload(ids, sizes, owner[often], keys)], pa.binary())], ["block", "payload"])
            marks = np.unique(mine)
            h, owner = np.append(h[~often], marks), np.append(owner[~often], np.full(len(marks), len(sets), np.int32))
        block = (h % np.uint64(blocks)).astype(np.int32)
        order = np.argsort(block, kind="stable")
        column, owner, block = h[order] // np.uint64(blocks), owner[order], block[order]
        low, high = column.astype(np.uint32), (column >> np.uint64(32)).astype(np.uint16)
        cuts = np.searchsorted(block, np.arange(blocks + 1))
        for at in range(0, blocks, 64):
            names = [b for b in range(at, min(at + 64, blocks)) if cuts[b] < cuts[b + 1]]
            payloads = [payload(ids, sizes, *[x[cuts[b] : cuts[b + 1]] for x in (owner, low, high)]) for b in names]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(payloads, pa.binary())], ["block", "payload"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int, int]] = set()
        ids: list[int] = []
        sets: list[np.ndarray] = []
        entries = 0
        for batch in batches:
            for i, x in zip(batch.column(0).to_pylist(), shingle_sets([x or b"" for x in batch.column(1).to_pylist()], n), strict=True):
                key = (len(x), *set_print(x))
                if len(x) and key not in seen:
                    if len(seen) >= SEEN_LIMIT:
                        seen.clear()
                    seen.add(key)
                    ids.append(i)
                    sets.append(x)
                    entries += len(x)
            if entries >= FLUSH_ENTRIES:
                yield from packed(ids, sets)
                ids, sets, entries = [], [], 0
        if ids:
            yield from packed(ids, sets)

    return map_batches(rows, run, "block int, payload binary")


def shared_entries(columns: DataFrame, blocks: int) -> DataFrame:
    """``block, payload``: by block of rows, the columns (as longs) that two or more documents have, with how many do (FREQUENT: that many or more)."""

    def decoded(raws: list[tuple[int, bytes]], part: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
        """Columns and the numbers of their rows, of one part of the columns."""
        keys, owners, row = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)], 0
        for block, raw in raws:
            k, m = map(int, np.frombuffer(raw, np.int64, 2))
            if block < 0:
                row += k
                continue
            column = np.frombuffer(raw, np.uint16, m, 16 + 16 * k + 4 * m).astype(np.uint64) << np.uint64(32)
            column |= np.frombuffer(raw, np.uint32, m, 16 + 16 * k)
            own = column % np.uint64(parts) == part
            owners.append(np.repeat(np.arange(row, row + k, dtype=np.int32), np.frombuffer(raw, np.int32, k, 16 + 12 * k))[own])
            keys.append(column[own] * np.uint64(blocks) + np.uint64(block))
            row += k
        return np.concatenate(keys), np.concatenate(owners)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raws = [x for batch in batches for x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        if not raws:
            return
        shapes = [tuple(map(int, np.frombuffer(raw, np.int64, 2))) for _, raw in raws]
        all_ids = np.concatenate([np.cumsum(np.frombuffer(raw, np.int64, k, 16)) for (_, raw), (k, _) in zip(raws, shapes, strict=True)])
        all_sizes = np.concatenate([np.frombuffer(raw, np.int32, k, 16 + 8 * k) for (_, raw), (k, _) in zip(raws, shapes, strict=True)])
        # Sorted a part at a time: what is in memory at once is in proportion to the part.
        parts = -(-sum(m for (block, _), (_, m) in zip(raws, shapes, strict=True) if block >= 0) // SORT_ENTRIES)
        mark = all_sizes == 0
        found = [(np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.uint8))]
        for part in range(parts):
            h, owner = decoded(raws, part, parts)
            order = np.argsort(h)
            h, owner = h[order], owner[order]
            del order
            first = np.flatnonzero(np.append(True, h[1:] != h[:-1])[: len(h)])
            times = np.diff(np.append(first, len(h)))
            if len(first):
                df = np.minimum(times + FREQUENT * np.maximum.reduceat(mark[owner], first), FREQUENT).astype(np.uint8)
                keep = np.repeat(df > 1, times) & ~mark[owner]
                found.append((h[keep], owner[keep], np.repeat(df, times)[keep]))
        row = 0
        for (block, raw), (k, m) in zip(raws, shapes, strict=True):
            if block < 0:
                owner = np.repeat(np.arange(row, row + k, dtype=np.int32), np.frombuffer(raw, np.int32, k, 16 + 12 * k))
                found.append((np.frombuffer(raw, np.uint64, m, 16 + 16 * k), owner, np.full(m, FREQUENT, np.uint8)))
            row += k
        del raws
        h, owner, df = (np.concatenate([x[k] for x in found]) for k in range(3))
        del found
        to = (all_ids[owner] % blocks).astype(np.int32)
        order = np.lexsort((owner, to))
        h, owner, df, to = h[order], owner[order], df[order], to[order]
        cuts = np.searchsorted(to, np.arange(blocks + 1))
        for b in range(blocks):
            own = owner[cuts[b] : cuts[b + 1]]
            if len(own):
                first = np.flatnonzero(np.append(True, np.diff(own) != 0))
                docs = own[first]
                count = np.diff(np.append(first, len(own))).astype(np.int32)
                payload = b"".join([np.int64(len(docs)).tobytes(), np.int64(len(own)).tobytes(), steps(all_ids[docs]), all_sizes[docs].tobytes(), count.tobytes(), h[cuts[b] : cuts[b + 1]].tobytes(), df[cuts[b] : cuts[b + 1]].tobytes()])
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([payload], pa.binary())], ["block", "payload"])

    return map_batches(columns, run, "block int, payload binary")


#: A row of the matrix, in parts: ``at`` and ``first`` hold the columns, ordered from rare to frequent, that linked rows must meet in; ``blocks, block, h`` all columns (see ``components``), and in part 0 ``bits``: of each bit whether an odd number of columns fall on it.
SPARSE = "id long, part long, n long, shared long, at long, first array<long>, blocks long, block long, h array<long>, bits array<long>"
#: 64-bit words of ``bits``.
WORDS = 8


def sparse_rows(shared: DataFrame, percent: int) -> DataFrame:
    """The rows, as ``SPARSE``, of the documents that enough shared columns are left of."""
    names = [x.split(" ")[0] for x in SPARSE.split(", ")]
    kinds = [pa.list_(pa.int64()) if x in ("first", "h", "bits") else pa.int64() for x in names]

    def parts_of(i: int, n: int, h: np.ndarray, bits: np.ndarray) -> Iterator[tuple]:
        must = h[: len(h) - -(-percent * n // 100) + 1]
        firsts = [(at, must[at : at + BLOCK_COLUMNS]) for at in range(0, len(must), BLOCK_COLUMNS)]
        for part, (first, block) in enumerate(itertools.zip_longest(firsts, column_blocks_of(h, n), fillvalue=(None, None))):
            yield (i, part, n, len(h), *first, *(block if block[0] is not None else (None, None, None)), None if part else bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sizes, counts, keys, often = [], [], [], [], []
        for raw in rows_by_task(batches):
            k, m = map(int, np.frombuffer(raw, np.int64, 2))
            ids.append(np.cumsum(np.frombuffer(raw, np.int64, k, 16)))
            sizes.append(np.frombuffer(raw, np.int32, k, 16 + 8 * k))
            counts.append(np.frombuffer(raw, np.int32, k, 16 + 12 * k))
            keys.append(np.frombuffer(raw, np.int64, m, 16 + 16 * k))
            often.append(np.frombuffer(raw, np.uint8, m, 16 + 16 * k + 8 * m))
        if not ids:
            return
        row_counts = np.concatenate(counts)
        docs, at, of = np.unique(np.concatenate(ids), return_index=True, return_inverse=True)
        n = np.concatenate(sizes)[at].astype(np.int64)
        total = np.bincount(of, weights=row_counts, minlength=len(docs))
        dense = 100 * total >= percent * n
        owner = np.repeat(of, row_counts)
        keep = dense[owner]
        owner, h, df = owner[keep], np.concatenate(keys)[keep], np.concatenate(often)[keep]
        order = np.lexsort((h, df, owner))
        owner, h = owner[order], h[order]
        bits = np.zeros((len(docs), WORDS), np.uint64)
        spread = mixed(h.astype(np.uint64))
        np.bitwise_xor.at(bits, (owner, (spread >> np.uint64(6)) % np.uint64(WORDS)), np.uint64(1) << (spread & np.uint64(63)))
        which = np.flatnonzero(dense)
        starts, ends = np.searchsorted(owner, which), np.searchsorted(owner, which, "right")
        found: list[tuple] = []
        size = 0
        for w, a, b in zip(which.tolist(), starts.tolist(), ends.tolist(), strict=True):
            for x in parts_of(int(docs[w]), int(n[w]), h[a:b], bits[w].view(np.int64)):
                found.append(x)
                size += len(names) + sum(len(y) for y in (x[5], x[8]) if y is not None)
                if size >= SORT_ENTRIES:
                    yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], kinds[k]) for k in range(len(names))], names)
                    found, size = [], 0
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], kinds[k]) for k in range(len(names))], names)

    return map_batches(shared, run, SPARSE)


def sparse_matrix(rows: DataFrame, n: int, percent: int, blocks: int) -> DataFrame:
    """The sparse rows of ``rows(row, text)``, the text as bytes."""
    shared = shared_entries(column_blocks(rows, n, blocks).repartition(blocks, "block"), blocks)
    return sparse_rows(shared.repartition(blocks, "block"), percent)


def first_columns(sets: DataFrame) -> DataFrame:
    """``key, id, n, u``: the columns of sparse rows that linked rows must meet in."""
    placed = sets.select(F.posexplode("first").alias("place", "key"), "id", "n", "shared", "at")
    return placed.select("key", "id", "n", (F.col("shared") - F.col("at") - F.col("place")).cast("long").alias("u"))


def joined_components(docs: DataFrame, percent: int, n: int, text_col: str) -> DataFrame:
    """``id, row, n, component_id, keep`` of ``docs`` with ``__row`` and ``__id``: the smallest id that a row reaches and, of the rows that it reaches, the one of the smallest id."""
    text = F.col(text_col).cast("string").cast("binary").alias("text")
    prints = stored(set_prints(docs.select(F.col("__id").alias("id"), F.col("__row").alias("row"), text), n))
    filled = prints.where("n > 0")
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row"))
    classes = stored(filled.groupBy("n", "p1", "p2").agg(F.min("row").alias("rep"), first.alias("first"), F.count("*").alias("size")))
    sparse = stored(sparse_matrix(docs.select(F.col("__row").alias("row"), text), n, percent, n_blocks(docs)))
    # Several tasks may have sent a row of one class: the first stands for it, under the name of the class.
    sent = sparse.where("part = 0").select("id").join(filled.select(F.col("row").alias("id"), "n", "p1", "p2"), "id")
    named = stored(sent.join(classes.select("n", "p1", "p2", "rep"), ["n", "p1", "p2"]).groupBy("rep").agg(F.min("id").alias("id")))
    sets = stored(sparse.join(named, "id").drop("id").withColumnRenamed("rep", "id"))
    forget(sparse, named)
    found = linked_components(first_columns(sets), sets.where("h is not null"), percent)
    forget(sets)
    joined = stored(classes.join(found.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep")))
    heads = stored(joined.groupBy("component").agg(F.min("first").alias("head"), F.count("*").alias("size")))
    named = stored(spread_join(joined.withColumnRenamed("size", "rows"), heads, ["component"]).select("n", "p1", "p2", "head", F.col("rows").alias("size")))
    forget(classes, joined, heads)
    out = spread_join(filled, named, ["n", "p1", "p2"]).select("id", "row", "n", F.col("head.id").alias("component_id"), F.col("head.row").alias("keep"))
    return out.unionByName(prints.where("n = 0").select("id", "row", "n", F.col("id").alias("component_id"), F.col("row").alias("keep")))


def jaccard_components(docs: DataFrame, percent: int = 75, n: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id>, n_shingles, component_id`` of each row: the smallest id reachable by links, and the size of its set."""
    rows = with_rows(docs.select(F.col(id_col).cast("long").alias("__id"), text_col), "__id")
    return joined_components(rows, percent, n, text_col).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def one_of_each_group(docs: DataFrame, percent: int = 75, n: int = 5) -> DataFrame:
    """The row of the smallest id of each component, with all its columns; rows without an id go where a linked row has one, and rows without words stay.

    The rows to remove are a written table whose size the planner knows.
    """
    rows = with_rows(docs)
    found = joined_components(rows.withColumn("__id", F.col("doc_id").cast("long")), percent, n, "text")
    gone = stored(found.where("keep <> row").select(F.col("row").alias("__row")))
    return rows.join(gone, "__row", "left_anti").select(*docs.columns)
