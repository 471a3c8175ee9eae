import re
from collections import Counter

import duckdb
import pytest
import tiktoken
import tiktoken.load
from test_filters import PLAIN, plain_judgement, plain_spans
from test_similarity import plain_components, plain_set

import corpus_pipeline
from millrace.llm import queries as Q
from millrace.llm.common import load

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(Q.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = Q.QUERIES[name](spark, SF)
    got = con.execute(Q.ORACLE_SQL[name])
    columns = [c[0] for c in got.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(repr(tuple(r)) for r in df.select(*columns).collect()) == sorted(repr(r) for r in got.fetchall())


def plain_contaminated(text, items):
    """Whether an item lies along the text at some shift such that 16 of some 20 words in a row agree (80 % of a shorter item)."""
    words = lambda x: re.findall(r"[^\W_]+", (x or "").lower())
    t = words(text)
    for item in items:
        b = words(item)
        if len(b) < 4:
            continue
        places = {}
        for k, w in enumerate(b):
            places.setdefault(w, []).append(k)
        shifts = Counter(i - k for i, w in enumerate(t) for k in places.get(w, ()))
        least = -(-min(len(b), 20) * 80 // 100)
        for shift, n in shifts.items():
            if n >= least:
                agree = [0 <= shift + k < len(t) and t[shift + k] == w for k, w in enumerate(b)]
                if any(sum(agree[k : k + 20]) >= least for k in range(max(len(b) - 19, 1))):
                    return True
    return False


def plain_redaction(text):
    out, at = [], 0
    for kind, a, b in sorted(plain_spans(text), key=lambda x: (x[1], -x[2])):
        if a >= at:
            out += [text[at:a], f"<{list(PLAIN)[kind].upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def test_pipeline_equals_brute_force(spark):
    """All five stages in plain Python, on documents of sf0.001; row by row, with the token ids."""
    import public_tokenizers

    con = duckdb.connect()
    docs = con.execute(f"SELECT doc_id, text, lang FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()
    labels = con.execute(f"SELECT doc_id, quality, toxic FROM '{SF}/labels.parquet'").fetchall()
    items = [x for (x,) in con.execute(f"SELECT text FROM '{SF}/benchmark.parquet'").fetchall()]
    verdict = plain_judgement(spark, docs, labels)
    texts = {i: x for i, x, _ in docs if not verdict[i][1]}
    top = plain_components({i: plain_set(x) for i, x in texts.items()})
    texts = {i: x for i, x in texts.items() if top[i] == i}
    texts = {i: plain_redaction(x) for i, x in texts.items() if not plain_contaminated(x, items)}
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = tiktoken.load.load_tiktoken_bpe(path)
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {i: plain.encode_ordinary(x) for i, x in texts.items()}
    got = corpus_pipeline.run(spark, SF).collect()
    assert 0 < len(want) < len(docs) and len(got) == len(want)
    assert {r["doc_id"]: r["ids"] for r in got} == want and all(r["n_tokens"] == len(want[r["doc_id"]]) for r in got)


def test_stages_on_odd_tables(spark, tmp_path):
    """Null, empty and repeated rows, rows without an id, extra columns with names the operators use; and no rows at all."""
    docs = load(spark, SF, "documents")
    some = docs.orderBy("doc_id").limit(60)
    odd = some.unionByName(some.limit(5)).unionByName(spark.createDataFrame([(None, None, None, None, None), (None, "", "en", "s", 0), (7, None, "en", None, None), (None, "the card 4111 1111 1111 1111 of", "en", "s", 5)], docs.schema))
    odd = odd.selectExpr("*", "1 as n", "'x' as row", "2 as component_id", "doc_id as item_id")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, SF)
        n = out.count()
        assert 0 < n <= 69, name
        if name != "byte-level BPE":
            assert out.columns == odd.columns
            assert stage(spark, odd.limit(0), SF).count() == 0
    kept = corpus_pipeline.near_duplicate_stage(spark, odd, SF).groupBy("doc_id").count().where("count > 1 and doc_id is not null").count()
    assert kept <= 1  # id 7 has a null text beside its own
    red = corpus_pipeline.pii_stage(spark, odd, SF).where("doc_id is null and text like 'the card%'").first()
    assert red["text"] == "the card <CARD> of" and red["n_chars"] == 18
    for t in ("documents", "labels", "benchmark"):
        load(spark, SF, t).limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages(spark, tmp_path):
    """Each stage against its operator's own findings on the stage's input; each of those is held against a brute-force version elsewhere."""
    from millrace.llm import decontamination, ngram_join, pii, quality

    docs = load(spark, SF, "documents")
    columns = docs.columns
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        if k == 0:
            want = ids(quality.judged(docs, load(spark, SF, "labels")).where("not rejected"))
        elif k == 1:
            want = ids(ngram_join.jaccard_components(docs).where("doc_id = component_id"))
        elif k == 2:
            bad = {r["doc_id"] for r in decontamination.contaminated(docs, load(spark, SF, "benchmark")).collect()}
            want = [i for i in ids(docs) if i not in bad]
        else:
            want = ids(docs)
        assert ids(out) == want, name
        if k < 4:
            assert out.columns == columns
        if k == 3:
            found = pii.report(out).agg({c: "sum" for c in ("n_email", "n_ip", "n_card", "n_phone")}).first()
            assert set(found) == {0}
            assert out.where("n_chars <> length(text)").count() == 0
        docs = out
    assert corpus_pipeline.run(spark, SF).count() == docs.count()
