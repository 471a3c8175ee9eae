"""Token counts of a word-end BPE vocabulary by rank-synchronous array merging.

The pre-tokens of a batch that are not known yet lie end to end in one array of symbol
ids, with a second array saying which pre-token each symbol belongs to. In each round
every pre-token applies its own lowest-ranked pair wherever that occurs, all pre-tokens
at once; those without a ranked pair leave. What is left of each is its token count.

Defined results: a null text counts as empty, with no bytes and no tokens; texts of any
length are counted whole; repeated rows give repeated rows; an empty table gives an empty
table. Only the id and text columns are read, so other columns can't clash.
"""

from __future__ import annotations

import contextlib
import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.byte_bpe import read_vocabulary, unicode_spaces
from millrace.llm.common import map_batches

#: Counts that a Python worker remembers before it starts afresh, and symbols merged at a time.
MEMO_LIMIT = 400_000
SYMBOLS_AT_ONCE = 1_000_000
_COUNTERS: dict[str, WordBpeCounter] = {}


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class WordBpeCounter:
    """Counts as a tokenizer file with an NFC and lower-case normalizer, a split pattern, bytes as letters and BPE with word ends does."""

    def __init__(self, tokenizer_file: bytes):
        spec = json.loads(tokenizer_file)
        model = spec["model"]
        end, vocab = model["end_of_word_suffix"], model["vocab"]
        pattern = next(x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.split = regex.compile(unicode_spaces(pattern)).findall
        special = sorted((x["content"] for x in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        letters = byte_letters()
        self.plain = np.array([vocab[x] for x in letters], np.int64)
        self.final = np.array([vocab[x + end] for x in letters], np.int64)
        self.width = max(vocab.values()) + 1
        pairs = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), made[order]
        self.memo: dict[str, int] = {}

    def surviving(self, words: list[str]) -> np.ndarray:
        """The number of symbols left of each word."""
        raw = [w.encode("utf-8") for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        symbols, owner = self.plain[data], np.repeat(np.arange(len(raw)), sizes)
        ends = np.cumsum(sizes) - 1
        symbols[ends] = self.final[data[ends]]
        counts = np.ones(len(raw), np.int64)
        none = len(self.keys)
        while len(symbols) > 1:
            key = symbols[:-1] * self.width + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), none - 1)
            found = (self.keys[at] == key) & (owner[:-1] == owner[1:])
            rank = np.append(np.where(found, self.rank[at], none), none)
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            lowest = np.minimum.reduceat(rank, first)
            length = np.diff(np.append(first, len(owner)))
            counts[owner[first]] = length
            best = np.repeat(lowest, length)
            hit = (rank == best) & (best < none)
            # Of a run x x x only every second place merges, from the left.
            index = np.arange(len(hit))
            started = np.maximum.accumulate(np.where(hit & ~np.append(False, hit[:-1]), index, 0))
            hit &= (index - started) % 2 == 0
            merging = np.flatnonzero(hit)
            if not len(merging):
                break
            symbols[merging] = self.made[at[merging]]
            keep = np.repeat(lowest < none, length)
            keep[merging + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        if len(symbols) == 1:
            counts[owner[0]] = 1
        return counts

    def words(self, text: str) -> list[str]:
        """The normalized pre-tokens of a text without special strings."""
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        # Letter by letter: a final sigma isn't treated apart.
        return self.split(text.replace("Σ", "σ").lower())

    def count(self, texts: list[str]) -> list[int]:
        """Token counts; a special string is one token."""
        memo, all_words, extra = self.memo, [], []
        for text in texts:
            found = len(self.special.findall(text)) if self.special and "<|" in text else 0
            extra.append(found)
            all_words.append([w for part in self.special.split(text) for w in self.words(part)] if found else self.words(text))
        if len(memo) > MEMO_LIMIT:
            memo.clear()
        new, symbols = [], 0
        for word in {w for words in all_words for w in words if w not in memo}:
            new.append(word)
            symbols += len(word)
            if symbols >= SYMBOLS_AT_ONCE:
                memo.update(zip(new, self.surviving(new).tolist(), strict=True))
                new, symbols = [], 0
        if new:
            memo.update(zip(new, self.surviving(new).tolist(), strict=True))
        return [n + sum(map(memo.__getitem__, words)) for n, words in zip(extra, all_words, strict=True)]


@contextlib.contextmanager
def counter(tokenizer_file: bytes) -> Iterator[WordBpeCounter]:
    """One counter for each vocabulary and Python worker, lent to a task; what it memoised goes with the task."""
    key = hashlib.sha256(tokenizer_file).hexdigest()
    if key not in _COUNTERS:
        _COUNTERS[key] = WordBpeCounter(tokenizer_file)
    try:
        yield _COUNTERS[key]
    finally:
        _COUNTERS[key].memo.clear()


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id>, n_bytes, n_tokens, over_limit`` of each row."""
    sent = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with counter(sent.value) as own:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(own.count([x or "" for x in batch.column(1).to_pylist()]), pa.int64())], ["id", "n_bytes", "n_tokens"])

    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    out = map_batches(rows, run, "id long, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
