"""Byte-level BPE encoding and decoding by longest matches with backtracking.

A pre-token's bytes, read as Latin-1, go through one Aho-Corasick pass that gives the
longest vocabulary entry at every position. Tokens are then taken greedily; where two
neighbours could not stand side by side in a BPE encoding, the search steps to a shorter
entry or back. A position that failed is never tried again, so the work is linear in the
number of bytes. Whether two tokens may be neighbours depends on the two alone and is
memoised.

Defined results: a null text is an empty text and has no tokens; texts of any length are
encoded whole; repeated rows give repeated rows; an empty table gives an empty table.
Only the id and text columns are read, so other columns can't clash.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import map_batches

#: Bytes that each of the two generations of encoded pre-tokens may take in a Python worker, and pairs of neighbours.
MEMO_LIMIT, NEIGHBOURS_LIMIT = 10 << 20, 200_000
#: The same where encoding is all that a session does; they are then kept from task to task.
MEMO_LIMIT_ALONE, NEIGHBOURS_LIMIT_ALONE = 80 << 20, 500_000
#: What an entry takes in a dictionary, beside its word and its tokens.
ENTRY_BYTES = 48
#: Rows that are encoded or decoded at a time.
SLICE_ROWS = 200
NEVER = 1 << 60
_CODECS: dict[str, ByteBpe] = {}


def unicode_spaces(pattern: str) -> str:
    """The pattern with white space as Unicode defines it, as Rust's regular expressions have it."""
    inside = regex.sub(r"\[\^?[^\]]*\]", lambda m: m[0].replace(r"\s", r"\p{White_Space}"), pattern)
    return inside.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")


class Memo(dict):
    """Pre-tokens and their tokens in one form: as 32-bit numbers (bytes), or as decimal ids joined by commas (text).

    Two generations: words that were used since the last time live on. Their size in bytes is
    bounded, not their number, for a pre-token may be as long as a text; one that takes more
    than a sixteenth of the room is not remembered. A pre-token whose tokens
    don't decode to its own bytes is noted in ``odd``, so the others' needn't be kept.
    """

    IDS, TEXT = "ids", "text"

    def __init__(self, codec: ByteBpe, form: str):
        super().__init__()
        self.codec, self.form, self.limit, self.taken = codec, form, MEMO_LIMIT, 0
        self.older: dict[str, bytes | str] = {}
        self.odd: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes | str:
        found = self.older.get(word)
        if found is None:
            piece = word.encode("utf-8")
            ids = self.codec.pieces(piece)
            found = array("i", ids).tobytes() if self.form == self.IDS else ",".join([self.codec.text_of[i] for i in ids])
            decoded = self.codec.decode(ids)
            if decoded != piece:
                self.odd[word] = decoded
        own = word.__sizeof__() + found.__sizeof__() + ENTRY_BYTES
        if own > self.limit // 16:
            return found
        if self.taken + own > self.limit:
            self.older = {}
            self.older = dict(self)
            self.clear()
            self.taken = 0
        self[word] = found
        self.taken += own
        return found

    def forget(self) -> None:
        self.clear()
        self.older, self.taken, self.odd = {}, 0, {}


class ByteBpe:
    """Encoder and decoder for ranks in the .tiktoken format."""

    def __init__(self, rank_file: bytes, pattern: str):
        self.ranks: dict[bytes, int] = {}
        for line in rank_file.splitlines():
            if line.strip():
                token, rank = line.split()
                self.ranks[base64.b64decode(token)] = int(rank)
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        self.text_of = {rank: str(rank) for rank in self.bytes_of}
        self.split = regex.compile(unicode_spaces(pattern)).findall
        self.memos = {form: Memo(self, form) for form in (Memo.IDS, Memo.TEXT)}
        self.neighbours: dict[int, bool] = {}
        self.neighbours_limit = NEIGHBOURS_LIMIT
        self.shorter: dict[int, int | None] = {}
        self.edges: tuple[dict[int, list[tuple[bytes, int]]], ...] = ({}, {})
        self.size: dict[int, int] = {}
        self.trie = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            if len(token) == 1 or self.merged(token) == [rank]:
                self.trie.add_word(token.decode("latin-1"), rank)
                self.size[rank] = len(token)
        self.trie.make_automaton()

    def merged(self, piece: bytes) -> list[int]:
        """The definition: merge the pair of lowest rank, leftmost first, until none is left. For short pieces."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(parts[k] + parts[k + 1], NEVER), k) for k in range(len(parts) - 1))
            if rank == NEVER:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[x] for x in parts]

    def last_pair(self, token: bytes) -> tuple[bytes, bytes]:
        """The two parts whose merge makes the token."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            _, i = min((self.ranks.get(parts[k] + parts[k + 1], NEVER), k) for k in range(len(parts) - 1))
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts[0], parts[1]

    def edge(self, token: int, side: int) -> list[tuple[bytes, int]]:
        """What stands at the token's left (0) or right (1) end while it is merged, from a byte to the whole, each with the rank of the merge that takes it up."""
        known = self.edges[side].get(token)
        if known is None:
            piece, until = self.bytes_of[token], NEVER
            known = [(piece, until)]
            while len(piece) > 1:
                until = self.ranks[piece]
                piece = self.last_pair(piece)[side]
                known.append((piece, until))
            known.reverse()
            self.edges[side][token] = known
        return known

    def may_follow(self, left: int, right: int) -> bool:
        """Whether BPE of both together gives just these two.

        Merges come in order of rank, since a part's rank is below its whole's. So the two
        ends are walked upwards in that order; if ever what stands left and right of the
        border would merge before either is taken up (at equal ranks, the leftmost first),
        the two can't be neighbours.
        """
        key = left << 32 | right
        known = self.neighbours.get(key)
        if known is None:
            if len(self.neighbours) > self.neighbours_limit:
                self.neighbours.clear()
            known = self.neighbours[key] = self._keep_apart(self.edge(left, 1), self.edge(right, 0))
        return known

    def _keep_apart(self, lefts: list[tuple[bytes, int]], rights: list[tuple[bytes, int]]) -> bool:
        ranks = self.ranks
        i = j = 0
        while True:
            a, a_until = lefts[i]
            b, b_until = rights[j]
            rank = ranks.get(a + b, NEVER)
            if rank < a_until and rank <= b_until and rank < NEVER:
                return False
            if a_until == b_until == NEVER:
                return True
            if a_until <= b_until:
                i += 1
            else:
                j += 1

    def prefix_of(self, token: int) -> int | None:
        """The longest shorter entry that the token begins with."""
        if token not in self.shorter:
            text = self.bytes_of[token].decode("latin-1")
            self.shorter[token] = next((self.trie.get(text[:n]) for n in range(len(text) - 1, 0, -1) if text[:n] in self.trie), None)
        return self.shorter[token]

    def pieces(self, piece: bytes) -> list[int]:
        """The BPE tokens of one pre-token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        text = piece.decode("latin-1")
        size, neighbours, may_follow, prefix_of, longest = self.size, self.neighbours, self.may_follow, self.prefix_of, self.trie.iter_long
        out: list[int] = []
        closed: set[int] = set()
        at, last, n = 0, None, len(text)
        while at < n:
            # Longest matches one after the other, until one can't stand beside the one before it.
            for end, token in longest(text, at):
                if end + 1 - size[token] != at:
                    return self.backtracked(text)
                if last is not None:
                    known = neighbours.get(last << 32 | token)
                    if not (may_follow(last, token) if known is None else known):
                        break
                if end + 1 in closed:
                    break
                out.append(token)
                last = token
                at = end + 1
            else:
                return out if at == n else self.backtracked(text)
            # Then a shorter one, or a step back; from there longest matches again.
            candidate = prefix_of(token)
            while True:
                while candidate is not None:
                    end = at + size[candidate]
                    if end not in closed and (last is None or may_follow(last, candidate)):
                        break
                    candidate = prefix_of(candidate)
                if candidate is not None:
                    break
                closed.add(at)
                candidate = out.pop()
                at -= size[candidate]
                last = out[-1] if out else None
                candidate = prefix_of(candidate)
            out.append(candidate)
            last, at = candidate, end
        return out

    def backtracked(self, text: str) -> list[int]:
        """The same from the longest matches at all places, found beforehand."""
        size, may_follow = self.size, self.may_follow
        n = len(text)
        longest: list = [None] * n
        for end, token in self.trie.iter(text):
            longest[end + 1 - size[token]] = token  # of one start, longer ones end later
        out: list[int] = []
        closed: set[int] = set()
        at, last, token = 0, None, longest[0]
        while True:
            candidate: int | None = token
            while candidate is not None:
                end = at + size[candidate]
                if end not in closed and (last is None or may_follow(last, candidate)):
                    break
                candidate = self.prefix_of(candidate)
            if candidate is not None:
                out.append(candidate)
                if end == n:
                    return out
                at, last, token = end, candidate, longest[end]
            else:
                closed.add(at)
                token = out.pop()
                at -= size[token]
                last = out[-1] if out else None

    def forget(self) -> None:
        """Drop what was memoised: a kept worker's next task may be of another kind and need the room."""
        for memo in self.memos.values():
            memo.forget()
        self.neighbours.clear()
        self.shorter.clear()

    def packed(self, text: str) -> bytes:
        """The token ids as 32-bit numbers."""
        return b"".join(map(self.memos[Memo.IDS].__getitem__, self.split(text)))

    def encode(self, text: str) -> list[int]:
        return array("i", self.packed(text)).tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of tokens, SHA-256 of the ids joined by commas, SHA-256 of the decoded bytes."""
        words = self.split(text)
        memo = self.memos[Memo.TEXT]
        ids = ",".join(map(memo.__getitem__, words))
        if memo.odd:
            decoded = b"".join([memo.odd.get(x) or x.encode("utf-8") for x in words])
        else:
            decoded = "".join(words).encode("utf-8")
        return ids.count(",") + bool(words), hashlib.sha256(ids.encode("ascii")).hexdigest(), hashlib.sha256(decoded).hexdigest()


@contextlib.contextmanager
def codec(rank_file: bytes, pattern: str, memo_limit: int = MEMO_LIMIT, keep: bool = False) -> Iterator[ByteBpe]:
    """One codec for each vocabulary and Python worker, lent to a task. What it memoised, by default in ``memo_limit`` bytes a generation, goes with the task unless the next one should ``keep`` it."""
    key = hashlib.sha256(rank_file + pattern.encode()).hexdigest()
    if key not in _CODECS:
        _CODECS[key] = ByteBpe(rank_file, pattern)
    for memo in _CODECS[key].memos.values():
        memo.limit = memo_limit
    _CODECS[key].neighbours_limit = NEIGHBOURS_LIMIT_ALONE if keep else NEIGHBOURS_LIMIT
    try:
        yield _CODECS[key]
    finally:
        if not keep:
            _CODECS[key].forget()


def read_vocabulary(path: str) -> bytes:
    """The rank file's bytes, read once on the driver (a vocabulary's size doesn't grow with the data)."""
    with open(path, "rb") as f:
        return f.read()


def in_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, few at a time: a batch's texts, their words and ids would stand beside each other several times."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row its id and the token ids (null text: none)."""
    sent = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with codec(sent.value, pattern) as bpe:
            for batch in in_slices(batches):
                rows = [bpe.packed(x or "") for x in batch.column(1).to_pylist()]
                ends = (np.cumsum([0, *map(len, rows)]) // 4).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(rows), np.int32)))], ["id", "ids"])

    return map_batches(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), run, "id long, ids array<int>").withColumnRenamed("id", id_col)


def decode_documents(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """For each row its id and the text that its token ids stand for (null ids: empty text)."""
    sent = encoded.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with codec(sent.value, pattern) as bpe:
            for batch in in_slices(batches):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bpe.decode(x or []).decode("utf-8", "replace") for x in batch.column(1).to_pylist()], pa.string())], ["id", "text"])

    return map_batches(encoded.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).cast("array<int>").alias("ids")), run, "id long, text string").withColumnRenamed("id", id_col)


def encode_digests(docs: DataFrame, path: str, pattern: str, memo_limit: int = MEMO_LIMIT_ALONE) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of each row, without shipping the ids themselves."""
    sent = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with codec(sent.value, pattern, memo_limit, keep=True) as bpe:
            for batch in batches:
                rows = [bpe.digest(x or "") for x in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.string()), pa.array([x[2] for x in rows], pa.string())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
