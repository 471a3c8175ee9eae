"""Quality classification by the perplexity of an interpolated modified Kneser-Ney model.

The model is of order ``ORDER`` over characters as they are (code points, case and all
scripts; no folding, no hashing), so its tables grow with the text it is trained on. Each task sums
the n-grams of its trusted texts; the sums are sharded by n-gram, and joins of the count
tables of neighbouring orders give discounts, back-off weights and probabilities. No table of
the model is ever in one place.

Documents are scored by joins with these tables. They are taken in chunks of the files'
rows; of a chunk, each different n-gram is asked for once, and the questions travel packed to
the n-grams' shards. There what all chunks ask for is looked up once, order by order, by joins
with the tables; the answers meet the chunk's documents and are summed for each document, as
often as the n-gram occurs there.

A document's perplexity is the exponential of the mean negative log probability of its
characters, over its whole text. To be judged, ``SMOOTH`` characters of the language's mean are
added, since short texts scatter. A document is rejected when that lies above the
``QUANTILE`` of trusted documents of its language, times ``SLACK``, or below the
``1 - QUANTILE`` one, divided by it: text that is far too predictable is repetition. One of
``HELD_BACK`` trusted documents, by a hash of its id, sets these bounds and isn't trained on.

Defined results: null texts and texts without a visible character have no perplexity and are rejected;
texts of any length are scored whole; languages without trusted texts, and null languages, use
the bounds of all trusted texts; with no trusted text at all only empty texts are
rejected; rows with equal ids are each scored, and are trusted if any label of their id
is; labels without an id say nothing; empty tables give an empty table. Only the named columns are read
(``keep_good`` keeps all others as they are), so other columns can't clash (names that begin
with two underscores are the operator's own).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from millrace.llm.common import forget, map_batches, n_blocks, stored
from millrace.llm.text_arrays import mixed

ORDER = 5
QUANTILE, SLACK, SMOOTH, HELD_BACK = 0.95, 1.1, 40, 4
#: Trusted ids are sent to all tasks up to this many; beyond it documents and labels are shuffled by id.
BROADCAST_IDS = 2_000_000
#: Rows of a file that are one chunk, n-grams worked on at a time, and slots of the tables that find them again.
CHUNK_ROWS, BLOCK, SLOTS = 16384, 1 << 20, 1 << 21
#: Characters of several texts that are worked on at a time while a chunk's n-grams are held too, and n-grams that wait to be sent.
PIECE = 1 << 18
#: Fixed value: the character that stands before a text's first (and for the null character).
EDGE = "\x02"
_WEIGHTS = mixed(np.arange(1, ORDER + 1, dtype=np.uint64)) | np.uint64(1)


class Grams:
    """The n-grams of many texts: every character with the ``ORDER - 1`` before it."""

    def __init__(self, texts: list[str]):
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        pad = EDGE * (ORDER - 1)
        self.codes = np.frombuffer(bytearray("".join([pad + x for x in texts]).encode("utf-32-le", "surrogatepass")), np.uint32)
        self.codes[self.codes == 0] = ord(EDGE)
        self.sizes = sizes
        first = np.cumsum(sizes + ORDER - 1) - sizes - ORDER + 1
        self.at = np.arange(sizes.sum()) + np.repeat(first - (np.cumsum(sizes) - sizes), sizes)

    def blocks(self, size: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places and hashes, so many at a time."""
        for k in range(0, len(self.at), size):
            at = self.at[k : k + size]
            low, high = int(at[0]), int(at[-1]) + 1
            sums = np.zeros(high - low, np.uint64)
            for j in range(ORDER):
                sums += self.codes[low + j : high + j].astype(np.uint64) * _WEIGHTS[j]
            yield at, mixed(sums[at - low])

    def strings(self, at: np.ndarray) -> pa.Array:
        """The n-grams at these places."""
        codes = np.ascontiguousarray(self.codes[at[:, None] + np.arange(ORDER)])
        return pa.array(codes.view(f"<U{ORDER}").reshape(-1).tolist(), pa.string())


def pieces(texts: list[str]) -> Iterator[tuple[slice, Grams]]:
    """The n-grams of ``texts``, of ``PIECE`` characters at a time; a longer text is one piece."""
    first, held = 0, 0
    for k, text in enumerate(texts):
        if k > first and held + len(text) > PIECE:
            yield slice(first, k), Grams(texts[first:k])
            first, held = k, 0
        held += len(text)
    if texts:
        yield slice(first, len(texts)), Grams(texts[first:])


def added(known: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``known`` with ``keys`` (both sorted, each once), and which of these are new."""
    at = np.searchsorted(known, keys)
    fresh = known[np.minimum(at, len(known) - 1)] != keys if len(known) else np.ones(len(keys), bool)
    return np.insert(known, at[fresh], keys[fresh]), fresh


def hashes_of(grams: str) -> np.ndarray:
    """The hashes of n-grams end to end."""
    codes = np.frombuffer(grams.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, ORDER).astype(np.uint64)
    return mixed((codes * _WEIGHTS).sum(axis=1, dtype=np.uint64))


def ngram_counts(texts: DataFrame) -> DataFrame:
    """``g, c`` of all ``texts(text)``: summed in each task, block by block, then by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = Grams([x or "" for x in batch.column(0).to_pylist()])
            for at, h in grams.blocks():
                _, first, times = np.unique(h, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([grams.strings(at[first]), pa.array(times.astype(np.int64))], ["g", "c"])

    return map_batches(texts, run, "g string, c long").groupBy("g").agg(F.sum("c").alias("c"))


def discounts(counts: DataFrame) -> tuple[float, float, float]:
    """The three modified Kneser-Ney discounts, from how many n-grams occur once to four times; 0.5, 1, 1.5 where these say nothing."""
    n = {r["c"]: r["n"] for r in counts.where("c <= 4").groupBy("c").agg(F.count("*").alias("n")).collect()}
    if not all(n.get(k) for k in (1, 2, 3, 4)):
        return 0.5, 1.0, 1.5
    y = n[1] / (n[1] + 2 * n[2])
    return tuple(min(max(k - (k + 1) * y * n[k + 1] / n[k], 0.05 * k), k - 0.05) for k in (1, 2, 3))


def context(gram: Column, order: int) -> Column:
    return F.substring(gram, 1, order - 1)


def lower(gram: Column, order: int) -> Column:
    return F.substring(gram, 2, order - 1)


class Model:
    """By order from 1: the seen n-grams with probabilities ``seen(g, p)``, and contexts with back-off weights ``weights(ctx, gamma)``.

    Orders below the highest count how many different characters come before an n-gram; the
    lowest is interpolated with a uniform distribution over the characters seen and one more.
    """

    def __init__(self, texts: DataFrame):
        tables = [stored(ngram_counts(texts))]
        for order in range(ORDER - 1, 0, -1):
            tables.insert(0, stored(tables[0].select(lower(F.col("g"), order + 1).alias("g")).groupBy("g").agg(F.count("*").alias("c"))))
        self.uniform = 1.0 / (tables[0].count() + 1)
        self.seen: list[DataFrame] = []
        self.weights: list[DataFrame] = []
        for order, table in enumerate(tables, 1):
            d1, d2, d3 = discounts(table)
            g = F.col("g")
            rows = table.select("g", "c", context(g, order).alias("ctx"), lower(g, order).alias("lower"))
            cut = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
            contexts = stored(rows.groupBy("ctx").agg(F.sum("c").alias("total"), (F.sum(cut) / F.sum("c")).alias("gamma")))
            joined = rows.join(contexts, "ctx")
            below = joined.withColumn("q", F.lit(self.uniform)) if order == 1 else joined.join(self.seen[-1].select(F.col("g").alias("lower"), F.col("p").alias("q")), "lower")
            self.seen.append(stored(below.select("g", ((F.col("c") - cut) / F.col("total") + F.col("gamma") * F.col("q")).alias("p"))))
            self.weights.append(contexts.select("ctx", "gamma"))
        forget(*tables)

    def log_probabilities(self, grams: DataFrame) -> DataFrame:
        """``g, logp`` of the different ``grams(g)`` of the highest order, with their other columns, looked up from the lowest order upwards."""
        asked, more = [grams], [c for c in grams.columns if c != "g"]
        for order in range(ORDER - 1, 0, -1):
            asked.insert(0, stored(asked[0].select(lower(F.col("g"), order + 1).alias("g")).distinct()))
        known: DataFrame | None = None
        for order, table in enumerate(asked, 1):
            g = F.col("g")
            met = table.join(self.seen[order - 1], "g", "left").withColumn("ctx", context(g, order)).join(self.weights[order - 1], "ctx", "left")
            # A context that is unseen itself passes the lower order on.
            if known is None:
                met = met.withColumn("q", F.lit(self.uniform))
            else:
                met = met.withColumn("lower", lower(g, order)).join(known.select(F.col("g").alias("lower"), F.col("p").alias("q")), "lower")
            before, known = known, stored(met.select("g", F.coalesce("p", F.coalesce("gamma", F.lit(1.0)) * F.col("q")).alias("p"), *(more if order == ORDER else ())))
            forget(*([table] if order < ORDER else []), *([before] if before is not None else []))
        return known.select("g", F.log("p").alias("logp"), *more)


def chunked(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__chunk``: file and range of rows, the same in every job, however that splits the files. What isn't read from files is stored first."""
    place = F.xxhash64("_metadata.file_path", F.floor(F.col("_metadata.row_index") / CHUNK_ROWS))
    try:
        return docs.withColumn("__chunk", place)
    except AnalysisException:
        return stored(docs).withColumn("__chunk", place)


def asked_grams(docs: DataFrame, shards: int) -> DataFrame:
    """``shard, chunk, grams``: the different n-grams of each chunk, end to end, once from each task that reads of it."""

    def packed(chunk: np.ndarray, h: np.ndarray, codes: np.ndarray) -> pa.RecordBatch:
        shard = (h % np.uint64(shards)).astype(np.int32)
        order = np.lexsort((shard, chunk))
        chunk, shard = chunk[order], shard[order]
        text = np.ascontiguousarray(codes[order]).tobytes().decode("utf-32-le", "surrogatepass")
        cuts = np.flatnonzero(np.append(True, (chunk[1:] != chunk[:-1]) | (shard[1:] != shard[:-1])))
        grams = [text[a * ORDER : b * ORDER] for a, b in zip(cuts.tolist(), np.append(cuts[1:], len(chunk)).tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(shard[cuts]), pa.array(chunk[cuts]), pa.array(grams, pa.string())], ["shard", "chunk", "grams"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, known = np.zeros(SLOTS, np.uint64), np.zeros(0, np.uint64)
        waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            own = batch.column(0).to_numpy()
            for part, grams in pieces([x or "" for x in batch.column(1).to_pylist()]):
                chunks = np.repeat(own[part], grams.sizes)
                for k, (at, h) in enumerate(grams.blocks(PIECE)):
                    chunk = chunks[k * PIECE : k * PIECE + len(at)]
                    key = mixed(h ^ chunk.view(np.uint64))
                    slot = (key & np.uint64(SLOTS - 1)).astype(np.int64)
                    new = np.flatnonzero(table[slot] != key)
                    table[slot[new]] = key[new]
                    keys, first = np.unique(key[new], return_index=True)
                    known, fresh = added(known, keys)  # some only lost their slot to another
                    which = new[first[fresh]]
                    waiting.append((chunk[which], h[which], grams.codes[at[which][:, None] + np.arange(ORDER)]))
                    size += len(which)
                    if size >= PIECE:
                        yield packed(*map(np.concatenate, zip(*waiting, strict=True)))
                        waiting, size = [], 0
        if size:
            yield packed(*map(np.concatenate, zip(*waiting, strict=True)))

    return map_batches(docs.select("__chunk", F.col("text").cast("string").alias("text")), run, "shard int, chunk long, grams string")


def different_grams(asked: DataFrame, shards: int) -> DataFrame:
    """``shard, g``: what all chunks ask for, each n-gram once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.zeros(0, np.uint64)
        for batch in batches:
            shard = batch.column(0).to_numpy()
            grams = batch.column(1).to_pylist()
            text = "".join(grams)
            h, first = np.unique(hashes_of(text), return_index=True)
            known, fresh = added(known, h)
            at = first[fresh]
            of = np.repeat(shard, [len(x) // ORDER for x in grams])[at]
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(of), pa.array([text[k * ORDER : (k + 1) * ORDER] for k in at.tolist()], pa.string())], ["shard", "g"])

    return map_batches(asked.select("shard", "grams").repartition(shards, "shard"), run, "shard int, g string")


class Answers:
    """Log probabilities by hash."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray]]):
        h, logp = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.uint64), np.zeros(0))
        order = np.argsort(h, kind="stable")
        self.h, self.logp = h[order], logp[order]
        # Most are found at once in a table; those that lost their slot to another, by a search.
        self.mask = np.uint64(min(SLOTS, 1 << (4 * len(h)).bit_length()) - 1)
        slot = (self.h & self.mask).astype(np.int64)
        self.at = np.zeros(int(self.mask) + 1, np.int64)
        self.at[slot] = np.arange(len(h))

    def of(self, h: np.ndarray) -> np.ndarray:
        if not len(h):
            return np.zeros(0)
        if not len(self.h):
            raise RuntimeError("a chunk's n-grams have no answers")
        at = self.at[(h & self.mask).astype(np.int64)]
        other = np.flatnonzero(self.h[at] != h)
        if len(other):
            at[other] = np.minimum(np.searchsorted(self.h, h[other]), len(self.h) - 1)
            if (self.h[at[other]] != h[other]).any():
                raise RuntimeError("a chunk's n-grams aren't those that were asked for")
        return self.logp[at]


def costs(texts: list[str], known: Answers) -> tuple[np.ndarray, np.ndarray]:
    """Each text's sum of negative log probabilities, and its characters."""
    nll, n = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    for part, grams in pieces(texts):
        each = np.concatenate([np.zeros(0), *[known.of(h) for _, h in grams.blocks(PIECE)]])
        sums = np.append(0.0, np.cumsum(each))
        ends = np.cumsum(grams.sizes)
        nll[part], n[part] = sums[ends - grams.sizes] - sums[ends], grams.sizes
    return nll, n


def by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """Group, kind and rows, of batches whose first two columns are these."""
    for batch in batches:
        group, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cuts = np.flatnonzero(np.append(True, (group[1:] != group[:-1]) | (kind[1:] != kind[:-1]))[: len(group)])
        for a, b in zip(cuts.tolist(), np.append(cuts[1:], len(group)).tolist(), strict=True):
            yield group[a], kind[a], batch.slice(a, b - a)


def answered(asked: DataFrame, known: DataFrame, shards: int) -> DataFrame:
    """``chunk, grams, logps`` (32-bit floats) for ``asked(shard, chunk, grams)``, from ``known(shard, g, logp)``."""
    none = F.lit(None)
    both = known.select("shard", F.lit(0).alias("kind"), none.cast("long").alias("chunk"), F.col("g").alias("grams"), "logp")
    both = both.unionByName(asked.select("shard", F.lit(1).alias("kind"), "chunk", "grams", none.cast("double").alias("logp")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, parts, table = None, [], None
        for group, kind, rows in by_group(batches):
            if group != shard:
                shard, parts, table = group, [], None
            grams = rows.column(3).to_pylist()
            if kind == 0:
                parts.append((hashes_of("".join(grams)), rows.column(4).to_numpy()))
                continue
            table = table or Answers(parts)
            logps = [table.of(hashes_of(x)).astype(np.float32).tobytes() for x in grams]
            yield pa.RecordBatch.from_arrays([rows.column(2), rows.column(3), pa.array(logps, pa.binary())], ["chunk", "grams", "logps"])

    return map_batches(both.repartition(shards, "shard").sortWithinPartitions("shard", "kind"), run, "chunk long, grams string, logps binary")


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``__nll``, the sum of negative log probabilities (null for a text without a visible character), and ``__n``, the characters."""
    placed, shards = chunked(docs), n_blocks(docs)
    asked = stored(asked_grams(placed, shards))
    known = model.log_probabilities(stored(different_grams(asked, shards)))
    answers = answered(asked, known, shards).select(F.col("chunk").alias("__chunk"), F.lit(0).alias("kind"), "grams", "logps", F.lit(None).cast("binary").alias("packed"))
    names = docs.columns
    text = names.index("text")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chunks = batch.column(len(names)).to_numpy()
            for chunk in np.unique(chunks).tolist():
                own = batch.filter(pa.array(chunks == chunk)).select(names)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, own.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                    writer.write_batch(own)
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([1], pa.int32()), pa.nulls(1, pa.string()), pa.nulls(1, pa.binary()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["__chunk", "kind", "grams", "logps", "packed"])

    rows = StructType([StructField("__chunk", LongType()), StructField("kind", IntegerType()), StructField("grams", StringType()), StructField("logps", BinaryType()), StructField("packed", BinaryType())])
    both = answers.unionByName(map_batches(placed.select(*names, "__chunk"), pack, rows))
    both = both.repartition(n_blocks(docs), "__chunk").sortWithinPartitions("__chunk", "kind")
    schema = StructType([*docs.schema.fields, StructField("__nll", DoubleType()), StructField("__n", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, parts, known = None, [], None
        for group, kind, rows in by_group(batches):
            if group != chunk:
                chunk, parts, known = group, [], None
            if kind == 0:
                parts += [(hashes_of(g), np.frombuffer(p, np.float32).astype(np.float64)) for g, p in zip(rows.column(2).to_pylist(), rows.column(3).to_pylist(), strict=True)]
                continue
            known = known or Answers(parts)
            parts = []
            for packed in rows.column(4).to_pylist():
                for own in pa.ipc.open_stream(packed):
                    texts = [x or "" for x in own.column(text).to_pylist()]
                    nll, n = costs(texts, known)
                    nothing = np.array([not x.strip() for x in texts])
                    yield pa.RecordBatch.from_arrays([*own.columns, pa.array(nll, mask=nothing), pa.array(n)], [*names, "__nll", "__n"])

    return map_batches(both, run, schema)


def of_trusted(docs: DataFrame, trusted: DataFrame, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """The rows of ``docs`` whose ids are in ``trusted(doc_id)``."""
    return docs.join(F.broadcast(trusted) if trusted.count() <= broadcast_ids else trusted, "doc_id", "left_semi")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids of documents that a label calls good and none calls toxic."""
    return labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("q"), F.max("toxic").alias("t")).where("q = 1 and coalesce(t, 0) = 0").select("doc_id")


def held_back(doc_id: Column) -> Column:
    """Whether a trusted document sets the bounds instead of being trained on."""
    return F.pmod(F.xxhash64(doc_id.cast("long"), F.lit("bounds")), F.lit(HELD_BACK)) == 0


def language(lang: Column) -> Column:
    return F.coalesce(lang.cast("string"), F.lit(""))


def judge(found: DataFrame, trusted: DataFrame, quantile: float, slack: float) -> DataFrame:
    """``found``, the stored result of ``scored``, with ``__perplexity, __judged, __low, __high, __rejected``."""
    known = of_trusted(found.select(F.col("doc_id").cast("long").alias("doc_id"), language(F.col("lang")).alias("__lang"), "__nll", "__n").where("__nll is not null"), trusted).where(held_back(F.col("doc_id")))
    known = stored(known.select("__lang", "__nll", "__n"))
    overall = known.agg((F.sum("__nll") / F.sum("__n")).alias("m")).first()["m"] or 0.0
    means = stored(known.groupBy("__lang").agg((F.sum("__nll") / F.sum("__n")).alias("__mean")))  # a row for each language
    smoothed = F.exp((F.col("__nll") + SMOOTH * F.coalesce("__mean", F.lit(overall))) / (F.col("__n") + SMOOTH))
    ends = F.percentile_approx("__judged", [1 - quantile, quantile], 100_000).alias("q")
    own = known.join(means, "__lang").withColumn("__judged", smoothed)
    low, high = own.agg(ends).first()["q"] or [0.0, float("inf")]
    bounds = stored(own.groupBy("__lang").agg(ends).join(means, "__lang").select("__lang", "__mean", (F.col("q")[0] / slack).alias("__low"), (F.col("q")[1] * slack).alias("__high")))
    met = found.withColumn("__lang", language(F.col("lang"))).join(bounds, "__lang", "left").drop("__lang")
    met = met.withColumns({"__judged": smoothed, "__perplexity": F.exp(F.col("__nll") / F.col("__n")), "__low": F.coalesce("__low", F.lit(low / slack)), "__high": F.coalesce("__high", F.lit(high * slack))})
    out = (F.col("__judged") < F.col("__low")) | (F.col("__judged") > F.col("__high"))
    return met.withColumn("__rejected", F.coalesce(out, F.lit(True)))


def train(docs: DataFrame, trusted: DataFrame) -> Model:
    own = of_trusted(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), trusted)
    return Model(own.where(~held_back(F.col("doc_id"))).select("text"))


def judged(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, slack: float = SLACK) -> DataFrame:
    """``doc_id, lang, perplexity, judged, low, high, rejected`` of each row; ``judged`` is the smoothed perplexity."""
    trusted = stored(trusted_ids(labels))
    found = stored(scored(docs, train(docs, trusted)).select("doc_id", "lang", "__nll", "__n"))
    return judge(found, trusted, quantile, slack).select("doc_id", "lang", *[F.col(f"__{x}").alias(x) for x in ("perplexity", "judged", "low", "high", "rejected")])


def keep_good(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, slack: float = SLACK) -> DataFrame:
    """The rows of ``docs`` that aren't rejected, with all their columns."""
    trusted = stored(trusted_ids(labels))
    found = stored(scored(docs, train(docs, trusted)))
    return judge(found, trusted, quantile, slack).where("not __rejected").select(*docs.columns)
