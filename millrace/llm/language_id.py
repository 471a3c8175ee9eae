"""Language identification by compression.

For each language a raw-content zstandard dictionary is filled with sample text. A text,
lower-cased and stripped to its letters, is compressed with each; the language whose dictionary leaves the fewest bytes wins, and
the score is how much fewer they are than the runner-up's (0 to 1). ``rejected`` marks
texts whose margin is too narrow to act upon.

The dictionaries come from a bounded sample: of every language about ``SAMPLE_DOCS``
training rows, chosen by a hash of their ids among the rows of at most ``ROW_BYTES``, are
taken whole, in the hash's order, as long as they fit into ``DICT_BYTES``. A language without such rows
has its shortest one. Ids choose rows for the sample only and are no input of a prediction.

Defined results: ``und`` with score 0 for a null text and for one without a letter; ties
go to the alphabetically first language; rows without text or language teach nothing;
with no training rows every text is ``und``; a null id counts as held out; repeated rows
give repeated rows; an empty table gives an empty table. Only ``doc_id, text, lang`` are
read, so other columns can't clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import map_batches

#: Bytes of each dictionary, rows sampled for it, bytes of a row that may be sampled, zstandard's level and the margin below which a result is rejected.
DICT_BYTES = 98_304
SAMPLE_DOCS, ROW_BYTES = 400, 16_384
LEVEL = 6
MIN_MARGIN = 0.01
LETTER = regex.compile(r"\p{L}")
NO_LETTERS = re.compile(r"[\W\d_]+")


def letters_only(text: str) -> str:
    """Lower-case words with single spaces: case, digits and marks say little of a language but cost bytes."""
    return f" {NO_LETTERS.sub(' ', text.lower()).strip()} "


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def fit(train: DataFrame, sample_docs: int = SAMPLE_DOCS, dict_bytes: int = DICT_BYTES) -> dict[str, bytes]:
    """A dictionary's content for each language of ``train(doc_id, text, lang)``.

    Two scans without a shuffle of text: rows are counted by language, then those come to
    the driver whose hash falls below a threshold that about ``sample_docs`` rows pass.
    """
    rows = train.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    place, size = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)), F.octet_length("text")
    counted = rows.groupBy("lang").agg(F.count_if(size <= ROW_BYTES).alias("n"), F.min_by(F.when(size > ROW_BYTES, F.col("text")), size).alias("shortest")).collect()
    if not counted:
        return {}
    below = F.create_map(*[x for r in counted for x in (F.lit(r["lang"]), F.lit(min(1 << 40, (sample_docs << 40) // max(1, r["n"]) + 1)))])
    picked = rows.where((size <= ROW_BYTES) & (place < below[F.col("lang")])).select("lang", place.alias("place"), "text").collect()
    out = {}
    for r in sorted(counted):
        own = sorted((x["place"], x["text"]) for x in picked if x["lang"] == r["lang"])
        content, room = [], dict_bytes
        for _, text in own:
            data = letters_only(text).encode("utf-8")
            if len(data) <= room:
                content.append(data)
                room -= len(data)
        found = b"".join(content) or letters_only(r["shortest"] or "").encode("utf-8")
        if found.strip():
            out[r["lang"]] = found
    return out


class CompressionClassifier:
    def __init__(self, contents: dict[str, bytes], level: int = LEVEL):
        self.langs = sorted(contents)
        self.coders = []
        for lang in self.langs:
            d = zstandard.ZstdCompressionDict(contents[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.coders.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and margin."""
        if not text or not self.langs or not LETTER.search(text):
            return "und", 0.0
        data = letters_only(text).encode("utf-8")
        sizes = [len(c.compress(data)) for c in self.coders]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        rest = [n for i, n in enumerate(sizes) if i != best]
        return self.langs[best], (min(rest) - sizes[best]) / min(rest) if rest else 1.0


def identify(docs: DataFrame, contents: dict[str, bytes], min_margin: float = MIN_MARGIN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id>, lang_pred, score, rejected`` of each row."""
    sent = docs.sparkSession.sparkContext.broadcast(contents)  # at most DICT_BYTES a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = CompressionClassifier(sent.value)
        for batch in batches:
            found = [model.predict(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], ["id", "lang_pred", "score"])

    out = map_batches(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), run, "id long, lang_pred string, score double")
    return out.select(F.col("id").alias(id_col), "lang_pred", "score", (F.col("score") < min_margin).alias("rejected"))
