import tracemalloc

import public_tokenizers as P
import pyarrow as pa

from millrace.llm import byte_bpe

RANKS = P.path("byte_bpe_multi_50k.tiktoken")


def held(memo):
    return sum(w.__sizeof__() + x.__sizeof__() for part in (memo, memo.older) for w, x in part.items())


def test_what_is_remembered_follows_bytes_not_words():
    bpe = byte_bpe.ByteBpe(byte_bpe.read_vocabulary(RANKS), P.PATTERN)
    memo = bpe.memos[byte_bpe.Memo.IDS]
    words = ["".join(chr(97 + (k * j) % 26) for j in range(2_000)) + "abcdefghij"[k % 10] * k for k in range(1, 400)]
    want = [bpe.encode(w) for w in words]
    memo.forget()
    memo.limit = 256 << 10
    assert [bpe.encode(w) for w in words] == want == [bpe.pieces(w.encode()) for w in words]
    assert held(memo) <= 2 * memo.limit
    memo.limit = byte_bpe.MEMO_LIMIT
    long = "x" * 700_000
    assert bpe.decode(bpe.encode(long)) == long.encode()
    assert held(memo) < 700_000


def test_a_full_batch_is_encoded_in_little_memory(spark, monkeypatch):
    caught = []
    monkeypatch.setattr(byte_bpe, "map_batches", lambda df, fn, schema: caught.append(fn) or df.select("id"))
    byte_bpe.encode_documents(spark.createDataFrame([], "doc_id long, text string"), RANKS, P.PATTERN)
    texts = [None if k == 7 else f"{k} " + "some words of a text " * 200 for k in range(2_000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(2_000), pa.int64()), pa.array(texts, pa.string())], ["id", "text"])
    first = [r for out in caught[0](iter([batch])) for r in out.to_pylist()]
    bpe = byte_bpe.ByteBpe(byte_bpe.read_vocabulary(RANKS), P.PATTERN)
    assert [(r["id"], r["ids"]) for r in first] == [(k, bpe.encode(x or "")) for k, x in enumerate(texts)]
    del first
    tracemalloc.start()
    try:
        assert sum(out.num_rows for out in caught[0](iter([batch]))) == 2_000
        assert tracemalloc.get_traced_memory()[1] / 1e6 < 10
    finally:
        tracemalloc.stop()
