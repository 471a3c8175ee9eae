import tracemalloc

import numpy as np
import pyarrow as pa

from millrace.llm import quality


def texts_of(n, size, seed=3):
    codes = np.random.default_rng(seed).integers(97, 105, (n, size), dtype=np.uint32)
    return ["".join(map(chr, row)) for row in codes.tolist()]


def peak_mb(work):
    tracemalloc.start()
    try:
        got = work()
        return got, tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_a_full_batch_asks_for_its_grams_in_little_memory(spark, monkeypatch):
    caught = []
    monkeypatch.setattr(quality, "map_batches", lambda df, fn, schema: caught.append(fn))
    quality.asked_grams(spark.createDataFrame([], "__chunk long, text string"), 8)
    texts = [*texts_of(200, 20_000), "", *texts_of(1, 400_000, 4)]
    chunks = [k % 2 for k in range(len(texts))]
    batch = pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), pa.array(texts)], ["__chunk", "text"])
    rows, mb = peak_mb(lambda: list(caught[0](iter([batch]))))
    assert mb < 120
    asked = [(c, g[k : k + 5]) for r in rows for c, g in zip(r.column(1).to_pylist(), r.column(2).to_pylist(), strict=True) for k in range(0, len(g), 5)]
    wanted = {(c, (quality.EDGE * 4 + x)[k : k + 5]) for c, x in zip(chunks, texts, strict=True) for k in range(len(x))}
    assert len(asked) == len(set(asked)) and set(asked) == wanted


def test_costs_are_those_of_each_text_by_itself():
    texts = [*texts_of(100, 10_000), "", "a", *texts_of(1, 400_000, 4), "", "hello"]
    grams = sorted({(quality.EDGE * 4 + x)[k : k + 5] for x in texts for k in range(len(x))})
    logp = -np.arange(1.0, len(grams) + 1)
    price = dict(zip(grams, logp.tolist(), strict=True))
    known = quality.Answers([(quality.hashes_of("".join(grams)), logp)])
    (nll, n), mb = peak_mb(lambda: quality.costs(texts, known))
    assert mb < 40
    assert n.tolist() == [len(x) for x in texts]
    assert np.allclose(nll, [-sum(price[(quality.EDGE * 4 + x)[k : k + 5]] for k in range(len(x))) for x in texts], rtol=1e-12)
