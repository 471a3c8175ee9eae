import base64
import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

tiktoken = pytest.importorskip("tiktoken")
import public_tokenizers as P  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from millrace.llm import byte_bpe, token_counts  # noqa: E402

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
WORDS = P.path("word_bpe_49k.json")
BPE = byte_bpe.ByteBpe(byte_bpe.read_vocabulary(RANKS), P.PATTERN)
ENC = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}, special_tokens={})
COUNTER = token_counts.WordBpeCounter(byte_bpe.read_vocabulary(WORDS))
TOKENIZER = Tokenizer.from_file(WORDS)

LETTERS = "aaab  '\n\t\r\x1c\x85 　éßñ中文字🙂s'll12٣́ΣΑΣ<|>endoftext_-."
HARD = ["", "a" * 5000, "ab" * 3000, " " * 1000, "中" * 900, "<|startoftext|>x<|endoftext|>", "\n\n \n", "İΣ", "x" * 100_000]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=LETTERS, max_size=80))
def test_same_as_the_libraries(text):
    ids = BPE.encode(text)
    assert ids == ENC.encode_ordinary(text)
    assert BPE.decode(ids) == text.encode()
    assert COUNTER.count([text]) == [len(TOKENIZER.encode(text, add_special_tokens=False).ids)]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcdeinost", min_size=1, max_size=300))
def test_long_words(text):
    assert BPE.encode(text) == ENC.encode_ordinary(text)
    assert COUNTER.count([text]) == [len(TOKENIZER.encode(text, add_special_tokens=False).ids)]


def test_hard_cases():
    assert [BPE.encode(x) for x in HARD] == [ENC.encode_ordinary(x) for x in HARD]
    assert COUNTER.count(HARD) == [len(TOKENIZER.encode(x, add_special_tokens=False).ids) for x in HARD]


def test_every_vocabulary_entry():
    random.seed(5)
    for token in random.sample(list(BPE.ranks), 3000):
        assert BPE.pieces(token) == [BPE.ranks[token]]


def test_neighbours_equal_the_definition():
    random.seed(6)
    ids = [i for i in BPE.size if BPE.size[i] <= 4]
    for _ in range(20_000):
        a, b = random.choice(ids), random.choice(ids)
        assert BPE.may_follow(a, b) == (BPE.merged(BPE.bytes_of[a] + BPE.bytes_of[b]) == [a, b])


def test_queries(spark):
    rows = [(k, x, "extra") for k, x in enumerate([*HARD[:8], None])] + [(3, HARD[3], "extra"), (None, "null id", "extra")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(map(tuple, byte_bpe.encode_digests(docs, RANKS, P.PATTERN).collect()), key=str)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = sorted(((i, len(e := ENC.encode_ordinary(x or "")), sha(",".join(map(str, e)).encode()), sha((x or "").encode())) for i, x, _ in rows), key=str)
    assert got == want
    counts = sorted((tuple(r) for r in token_counts.count_tokens(docs, WORDS).collect()), key=str)
    assert counts == sorted(((i, len((x or "").encode()), n := len(TOKENIZER.encode(x or "", add_special_tokens=False).ids), n > 2048) for i, x, _ in rows), key=str)
    encoded = byte_bpe.encode_documents(docs, RANKS, P.PATTERN)
    assert {(r["doc_id"], tuple(r["ids"])) for r in encoded.collect()} == {(i, tuple(ENC.encode_ordinary(x or ""))) for i, x, _ in rows}
    assert {tuple(r) for r in byte_bpe.decode_documents(encoded, RANKS, P.PATTERN).collect()} == {(i, x or "") for i, x, _ in rows}
    assert byte_bpe.encode_digests(docs.limit(0), RANKS, P.PATTERN).count() == 0
    assert token_counts.count_tokens(docs.limit(0), WORDS).count() == 0
