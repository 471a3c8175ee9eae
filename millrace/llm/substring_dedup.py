"""Removal of repeated passages by MinHash banding of paragraphs.

Two kinds of paragraph are banded, in one scan, and joined where they collide:

* a line of at least ``MIN_WORDS`` words, with the set of its 5-word shingles. Lines with
  equal sets are one class. ``BANDS`` bands of ``ROWS`` minimum hashes each, a shape with a
  recall of 0.99995 at a similarity of 0.75, tell which classes collide. Those alone are
  joined, on shingles of theirs that a linked pair must share (bands are so wide that
  thousands of lines with half their text in common would collide pair by pair; the bounds
  of ``ngram_join`` keep such pairs from being proposed), and linked where their exact Jaccard
  similarity is 0.75 or more;
* each window of ``RUN`` words, wherever lines begin and end (see ``shared_runs``). One minimum
  hash is band enough, since what collides is linked only where it is equal word by word.

Components are clusters. Of each cluster the occurrence first in (document, row, place)
stays and all others are removals. Windows that overlap or touch are reported as one span,
so a verbatim passage of ``RUN`` words or more is found to its full extent.

Defined results: null texts have no paragraphs; shorter lines and shorter repeats inside
lines are left alone; texts of any length are read whole; paragraphs that are repeated within
a document count as any others; repeated rows (and rows with equal ids) are copies of
each other, told apart by their number; rows without an id are clustered too and, coming
first, are kept; an empty table gives an empty table. Only the id and text columns are read
(``remove_passages`` keeps all others as they are), so other columns can't clash (names that
begin with two underscores are the operator's own).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import forget, map_batches, n_blocks, spread_join, stored, with_rows
from millrace.llm.components import linked_components
from millrace.llm.ngram_join import first_columns, sparse_matrix
from millrace.llm.shared_runs import RUN, Hashed, classes_of, segments, spans_of
from millrace.llm.text_arrays import _BASE, frequent, mixed, place_words, shingles, word_hashes

MIN_WORDS, PERCENT, SHINGLE = 25, 75, 5
BANDS, ROWS = 12, 2
KINDS = ("paragraph", "run")
_FACTORS = mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)
#: Classes that a task remembers, to compute bands once for each, and band keys that it gathers or sorts at a time.
SEEN_LIMIT, KEYS_AT_ONCE = 500_000, 1_000_000
#: A band key that so many classes of a task's keys have collides: they needn't meet in one place.
FREQUENT = 255


def band_keys(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each set, its shingles end to end in ``x``, a number for each band: one minimum hash after the other."""
    starts = np.cumsum(sizes) - sizes
    keys = np.repeat(np.arange(1, BANDS + 1, dtype=np.uint64)[None, :], len(sizes), axis=0)
    for k, factor in enumerate(_FACTORS):
        # The shingles' hashes are mixed already: multiplying by an odd number orders them anew.
        keys[:, k // ROWS] = mixed(keys[:, k // ROWS] ^ mixed(np.minimum.reduceat(x * factor, starts)))
    return keys


#: Paragraphs: kind, place (document, row, number of the first word, code points), size (of the set, or in windows), a (of a line its class, of a segment its minimum), b (of a segment the hash of all words) and, once for each class of lines and task, bands. ``mid`` ends a segment's first window.
FOUND = "kind int, doc_id long, row long, at int, n int, n_words int, start int, mid int, end int, a long, b long, bands binary"


def find_paragraphs(rows: DataFrame, min_words: int, run: int, kinds: tuple[str, ...]) -> DataFrame:
    """The paragraphs, as ``FOUND``, of ``rows(doc_id, row, text)``."""
    names = [x.split(" ")[0] for x in FOUND.split(", ")]

    def lines(words: np.ndarray, starts: np.ndarray, feeds: np.ndarray, seen: set) -> tuple:
        """First word, words, line start, line end, size of the set, class and bands of the lines that are long enough."""
        line = np.searchsorted(feeds, starts)
        change = np.flatnonzero(np.append(True, line[1:] != line[:-1])[: len(line)])
        count = np.diff(np.append(change, len(line)))
        long = count >= min_words
        first, count, line = change[long], count[long], line[change[long]]
        m = count - SHINGLE + 1
        owner = np.repeat(np.arange(len(m)), m)
        place = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + first[owner]
        x = shingles(words, SHINGLE)[place]
        order = np.lexsort((x, owner))
        x, owner = x[order], owner[order]
        new = np.append(True, (x[1:] != x[:-1]) | (owner[1:] != owner[:-1]))[: len(x)]
        x, owner = x[new], owner[new]
        size = np.bincount(owner, minlength=len(m))
        at = np.cumsum(size) - size
        p1 = np.add.reduceat(x, at) if len(x) else x
        p2 = np.add.reduceat(mixed(x ^ _BASE), at) if len(x) else x
        own = mixed(p1 ^ mixed(p2 + size.astype(np.uint64)))
        fresh = np.zeros(len(m), bool)
        for k, key in enumerate(own.tolist()):
            if key not in seen:
                if len(seen) >= SEEN_LIMIT:
                    seen.clear()
                seen.add(key)
                fresh[k] = True
        bands: list = [None] * len(m)
        if fresh.any():
            for k, keys in zip(np.flatnonzero(fresh).tolist(), band_keys(x[fresh[owner]], size[fresh]), strict=True):
                bands[k] = keys.tobytes()
        return first, count, np.append(0, feeds + 1)[line], feeds[line], size, own, bands

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()

        def packed(kind: int, batch: pa.RecordBatch, doc: np.ndarray, first_word: np.ndarray, *columns: object) -> pa.RecordBatch:
            of = pa.array(doc)
            *numbers, a, b, bands = columns
            arrays = [pa.array(np.full(len(doc), kind, np.int32)), batch.column(0).take(of), batch.column(1).take(of), pa.array(first_word.astype(np.int32)), *[pa.array(x.astype(np.int32)) for x in numbers], pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(bands, pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, names)

        for batch in batches:
            texts = [x or "" for x in batch.column(2).to_pylist()]
            words, counts = word_hashes([x.encode("utf-8") for x in texts])
            starts, ends, origin, feeds = place_words(texts)
            first_of = np.cumsum(counts) - counts
            of = np.repeat(np.arange(len(texts)), counts)
            if "paragraph" in kinds and len(words):
                first, n_words, begin, end, size, own, bands = lines(words, starts, feeds, seen)
                doc = of[first]
                yield packed(0, batch, doc, first - first_of[doc], size, n_words, begin - origin[doc], end - origin[doc], end - origin[doc], own, np.zeros(len(doc), np.uint64), bands)
            if "run" in kinds:
                doc, at, n, least, whole = segments(words, counts, run)
                if len(at):
                    yield packed(1, batch, doc, at - first_of[doc], n, n + run - 1, starts[at] - origin[doc], ends[at + run - 1] - origin[doc], ends[at + n + run - 2] - origin[doc], least, whole, [None] * len(at))

    return map_batches(rows, work, FOUND)


def colliding(classes: DataFrame, blocks: int) -> DataFrame:
    """``key, id, n``: the band keys that two or more of ``classes(id, n, bands)`` have.

    Keys travel packed, by block. Those that are frequent in a task don't meet in one place:
    they travel apart (as block -1 and below) and leave a mark, a class of size 0, in their block.
    """

    def payload(key: np.ndarray, i: np.ndarray, n: np.ndarray) -> bytes:
        return b"".join([key.tobytes(), i.tobytes(), n.astype(np.int32).tobytes()])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, KEYS_AT_ONCE // BANDS):
                part = batch.slice(at, KEYS_AT_ONCE // BANDS)
                key = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint64)
                i, n = (np.repeat(part.column(k).to_numpy(), BANDS) for k in (0, 1))
                often = frequent(key, FREQUENT)
                names, payloads = [], []
                if often.any():
                    names.append(-1 - int(i[0]) % blocks)
                    payloads.append(payload(key[often], i[often], n[often]))
                    marks = np.unique(key[often])
                    none = np.zeros(len(marks), np.int64)
                    key, i, n = np.append(key[~often], marks), np.append(i[~often], none), np.append(n[~often], none)
                block = (key % np.uint64(blocks)).astype(np.int32)
                order = np.argsort(block, kind="stable")
                key, i, n = key[order], i[order], n[order]
                cuts = np.searchsorted(block[order], np.arange(blocks + 1))
                for b in np.flatnonzero(np.diff(cuts)).tolist():
                    names.append(b)
                    payloads.append(payload(*[x[cuts[b] : cuts[b + 1]] for x in (key, i, n)]))
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(payloads, pa.binary())], ["block", "payload"])

    def rows(key: np.ndarray, i: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(key), 100_000):
            arrays = [pa.array(x[at : at + 100_000]) for x in (key.view(np.int64), i, n.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(arrays, ["key", "id", "n"])

    def arrays_of(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        m = len(raw) // 20
        return np.frombuffer(raw, np.uint64, m), np.frombuffer(raw, np.int64, m, 8 * m), np.frombuffer(raw, np.int32, m, 16 * m)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raws = []
        for batch in batches:
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if block < 0:
                    yield from rows(*arrays_of(raw))
                else:
                    raws.append(raw)
        parts = -(-sum(map(len, raws)) // (20 * KEYS_AT_ONCE))
        for part in range(parts):
            own = []
            for raw in raws:
                key, i, n = arrays_of(raw)
                mine = (key // np.uint64(blocks)) % np.uint64(parts) == part
                own.append((key[mine], i[mine], n[mine]))
            key, i, n = (np.concatenate(x) for x in zip(*own, strict=True))
            order = np.lexsort((n, i, key))
            key, i, n = key[order], i[order], n[order]
            # Of what several tasks sent of one class, one is enough.
            one = np.append(True, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (n[1:] != n[:-1]))[: len(key)]
            key, i, n = key[one], i[one], n[one]
            same = key[1:] == key[:-1]
            keep = (np.append(same, False) | np.append(False, same))[: len(key)] & (n > 0)
            yield from rows(key[keep], i[keep], n[keep])

    sent = map_batches(classes, send, "block int, payload binary").repartition(blocks, "block")
    return map_batches(sent, meet, "key long, id long, n long")


#: Read again: for a line (kind 0) its text, for a segment (kind 1) a row for each window, with its class's size; the first is marked ``head``.
READ = "kind int, id long, line binary, n int, a long, b long, doc_id long, row long, at int, start int, stop int, hash long, size long, head boolean"


def read_again(rows: DataFrame, asked: DataFrame, run: int) -> DataFrame:
    """``READ`` of the paragraphs ``asked(kind, row, id, at, n, start, end, a, b, size)``, in their texts."""
    lists = stored(asked.groupBy("row").agg(F.collect_list(F.struct("kind", "id", "at", "n", "start", "end", "a", "b", "size")).alias("asked")))
    met = rows.join(lists, "row").select("doc_id", "row", "text", "asked")
    schema = [x.split(" ") for x in READ.split(", ")]
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}

    def filled(n: int, given: dict[str, object]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(given[c]) if c in given and not isinstance(given[c], pa.Array) else given.get(c, pa.nulls(n, types[t])) for c, t in schema], [c for c, _ in schema])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners, texts = [], []
            for k, text in enumerate(batch.column(2).to_pylist()):
                kind, i, at, n, start, end, a, b, times = (x.to_numpy(zero_copy_only=False) for x in batch.column(3).slice(k, 1).flatten().flatten())
                line = kind == 0
                owners += i[line].tolist()
                texts += [text[x:y].encode("utf-8") for x, y in zip(start[line].tolist(), end[line].tolist(), strict=True)]
                if line.all():
                    continue
                at, n, a, b, times = (x[~line] for x in (at, n, a, b, times))
                n = n.astype(np.int64)
                words, _ = word_hashes([text.encode("utf-8")])
                starts, ends, _, _ = place_words([text])
                size = int(n.sum())
                place = np.repeat(at.astype(np.int64) - (np.cumsum(n) - n), n) + np.arange(size)
                of = pa.array(np.full(size, k))
                given = {"kind": np.ones(size, np.int32), "n": np.repeat(n, n).astype(np.int32), "a": np.repeat(a, n), "b": np.repeat(b, n), "doc_id": batch.column(0).take(of), "row": batch.column(1).take(of), "at": place.astype(np.int32), "start": starts[place].astype(np.int32), "stop": ends[place + run - 1].astype(np.int32), "hash": Hashed(words).runs(place, run).view(np.int64), "size": np.repeat(times, n), "head": place == np.repeat(at, n)}
                yield filled(size, given)
            if owners:
                yield filled(len(owners), {"kind": np.zeros(len(owners), np.int32), "id": pa.array(owners, pa.int64()), "line": pa.array(texts, pa.binary())})

    return map_batches(met, work, READ)


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, percent: int = PERCENT, run: int = RUN, kinds: tuple[str, ...] = KINDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``kind, doc_id, start, end, n_words, keep_doc_id, keep_start, removed`` of every passage that occurs again.

    ``keep_*`` name the occurrence of its cluster that stays, which is itself where ``removed``
    is false. Starts and ends are code points. ``kind`` is ``paragraph`` (a line) or ``run``.
    """
    columns = ["kind", "doc_id", "start", "end", "n_words", "keep_doc_id", "keep_start", "removed"]
    rows = with_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")))
    return passages_of_rows(rows.select("doc_id", F.col("__row").alias("row"), "text"), min_words, percent, run, kinds).select(*columns)


def passages_of_rows(rows: DataFrame, min_words: int, percent: int, run: int, kinds: tuple[str, ...]) -> DataFrame:
    """The same, with ``row``, for ``rows(doc_id, row, text)``."""
    found = stored(find_paragraphs(rows, min_words, run, kinds))
    lines = found.where("kind = 0").select("doc_id", "row", "at", "n", "n_words", "start", "end", F.col("a").alias("id"))
    met = stored(colliding(found.where("bands is not null").select(F.col("a").alias("id"), "n", "bands"), n_blocks(rows)))
    # Lines that occur once and collide with none are most of all, and end here.
    near = met.select("id", F.lit(True).alias("near")).distinct()
    again = stored(lines.groupBy("id").agg(F.count("*").alias("size")).join(near, "id", "left").where("size > 1 or near"))
    lines = stored(spread_join(lines, again.drop("near"), ["id"]))
    # One of each class, summed up before it is shuffled: a passage in a third of all documents is one row from each task.
    classes = stored(lines.groupBy("id", "n").agg(F.min(F.struct("doc_id", "row", "at", "start", "end")).alias("first"), F.count("*").alias("size")))
    runs = found.where("kind = 1").drop("kind", "bands")
    anchors = stored(runs.groupBy("a").agg(F.count("*").alias("size")).where("size > 1"))
    runs = stored(spread_join(runs, anchors, ["a"]))
    forget(found, anchors)
    run_classes = classes_of(runs)
    none = F.lit(0).cast("long")
    asked_lines = classes.join(again.where("near"), "id", "left_semi").select(F.lit(0).alias("kind"), "first.row", "id", "first.at", "n", "first.start", "first.end", none.alias("a"), none.alias("b"), "size")
    asked_runs = run_classes.where("met").select(F.lit(1).alias("kind"), "first.row", none.alias("id"), "first.at", "n", "first.start", "first.end", "a", "b", "size")
    read = stored(read_again(rows, asked_lines.unionByName(asked_runs), run))
    texts = read.where("kind = 0").select(F.col("id").alias("row"), F.col("line").alias("text"))
    sets = stored(sparse_matrix(texts, SHINGLE, percent, n_blocks(texts)))
    linked = linked_components(first_columns(sets), sets.where("h is not null"), percent)
    forget(sets)
    clusters = stored(classes.join(linked, "id", "left").withColumn("cluster", F.coalesce("component", "id")))
    heads = stored(clusters.groupBy("cluster").agg(F.sum("size").alias("total"), F.count("*").alias("size"), F.min("first").alias("keep")).where("total > 1").drop("total"))
    kept = stored(spread_join(clusters.withColumnRenamed("size", "rows"), heads, ["cluster"]).select("id", "keep", F.col("rows").alias("size")))
    forget(met, again, classes, clusters, heads)
    first = (F.col("row") == F.col("keep.row")) & (F.col("at") == F.col("keep.at"))
    columns = ["kind", "doc_id", "row", "start", "end", "n_words", F.col("keep.doc_id").alias("keep_doc_id"), F.col("keep.start").alias("keep_start"), (~first).alias("removed")]
    of_lines = spread_join(lines, kept, ["id"]).withColumn("kind", F.lit(KINDS[0])).select(*columns)
    windows = read.where("kind = 1").select("a", "b", "n", "doc_id", "row", "at", "start", "stop", F.col("hash").alias("h"), "size", "head")
    of_runs = spans_of(runs, run_classes, windows, run).withColumn("kind", F.lit(KINDS[1]))
    return of_lines.unionByName(of_runs)


def without(docs: DataFrame, min_words: int, percent: int, run: int, kind: str, id_col: str, text_col: str) -> DataFrame:
    """``docs`` without the removals of one kind; of a line, its line feed goes too. All columns stay."""
    numbered = stored(docs.withColumn("__row", F.monotonically_increasing_id()))
    rows = numbered.select(F.col(id_col).cast("long").alias("doc_id"), F.col("__row").alias("row"), F.col(text_col).cast("string").alias("text"))
    gone = passages_of_rows(rows, min_words, percent, run, (kind,)).where("removed")
    gone = stored(gone.groupBy(F.col("row").alias("__row")).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("__gone")))
    joined = numbered.join(gone, "__row", "left")
    text, spans = F.col(text_col), F.col("__gone")
    last = F.element_at(spans, -1)
    if kind == "paragraph":  # a last line goes with the feed before it, if that is left
        spans = F.transform(spans, lambda x: F.struct(x["start"].alias("start"), (x["end"] + 1).alias("end")))
    # Code points between the spans: after the one before (or from the beginning) up to the next (or the end).
    begin = F.concat(F.array(F.lit(0)), F.transform(spans, lambda x: x["end"]))
    stop = F.concat(F.transform(spans, lambda x: x["start"]), F.array(F.length(text)))
    left = F.array_join(F.transform(F.arrays_zip(begin.alias("b"), stop.alias("e")), lambda x: F.substring(text, x["b"] + 1, F.greatest(x["e"] - x["b"], F.lit(0)))), "")
    if kind == "paragraph":
        left = F.when(last["end"] == F.length(text), F.regexp_replace(left, "\n\\z", "")).otherwise(left)
    return joined.withColumn(text_col, F.when(F.col("__gone").isNull(), text).otherwise(left)).select(*docs.columns)


def remove_passages(docs: DataFrame, min_words: int = MIN_WORDS, percent: int = PERCENT, run: int = RUN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the lines to remove and then without the runs of words that what is left has before; all columns stay."""
    out = docs
    for kind in KINDS:
        out = without(out, min_words, percent, run, kind, id_col, text_col)
    return out
