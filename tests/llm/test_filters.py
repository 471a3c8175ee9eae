import random
import re
import zlib

import numpy as np
import pytest

from millrace.llm import chat_format, decontamination, language_id, pii, quality

WORDS = [w + v for w in ("ra", "to", "mi", "ke", "su", "bo") for v in ("n", "la", "sti", "der", "")]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


# Personal data


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "card": r"[0-9](?:[ -]?[0-9])+", "phone": r"\+[0-9][ ().0-9-]+[0-9]"}


def plain_luhn(d):
    total = 0
    for k, c in enumerate(reversed(d)):
        v = int(c) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def plain_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")) or kind == "card" and not (13 <= len(d) <= 19 and plain_luhn(d)) or kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((k, *m.span()))
    return out


def test_base_spans_equal_the_expressions():
    rng = random.Random(1)
    for _ in range(20_000):
        text = "".join(rng.choice("0123456789 .-+()@ab%@.é\n") for _ in range(rng.randint(0, 45)))
        assert pii.base_spans(text) == plain_spans(text)
    assert pii.base_spans("9" * 200_000 + "@" + "a." * 50_000) == [(0, 0, 300_000)]


def test_contexts_discover_identifiers(spark):
    rng = random.Random(4)
    cards = []
    while len(cards) < 12:
        d = "".join(rng.choice("0123456789") for _ in range(16))
        if plain_luhn(d):
            cards.append(d)
    wrong = next(d for d in ("4111111111111112", "4111111111111113") if not plain_luhn(d))
    rows = [(k, f"{sentence(rng, 5)} card number {d} on file {sentence(rng, 4)}", 1) for k, d in enumerate(cards)]
    rows += [(50, f"again card number {wrong} on file", 1), (51, f"nothing known of {wrong[::-1]} here", 1), (52, None, 1), (53, "", 1)]
    got = {r["doc_id"]: r for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string, base int")).collect()}
    assert [got[k]["n_card"] for k in range(12)] == [1] * 12 and got[50]["n_card"] == 0
    assert (got[50]["n_added"], got[51]["n_added"]) == (1, 0)
    kind, a, b = got[50]["spans"].split(":")
    assert kind == "card" and rows[12][1][int(a) : int(b)] == wrong
    red = {r["doc_id"]: r for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string, base int")).collect()}
    assert red[50]["text"] == "again card number <CARD> on file" and red[52]["text"] is None and red[51]["text"] == rows[13][1] and red[0]["base"] == 1
    assert pii.report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def planted(rng, n):
    """Rows with identifiers in telling contexts: most in the base's forms, some in others; and numbers that are none."""
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    rows, other = [], {}
    for i in range(n):
        kind = i % 4
        odd = rng.random() < 0.3
        if kind == 0:
            value = f"{digits(4)}-{digits(5)}-{digits(3)}" if odd else next(d for d in iter(lambda: digits(16), "") if plain_luhn(d))
            said = f"{rng.choice(['my card number', 'paid with card number', 'card number'])} {value} {rng.choice(['on file', 'expires soon'])}"
        elif kind == 1:
            value = f"0{digits(3)} {digits(3)} {digits(4)}" if odd else f"+1 ({digits(3)}) {digits(3)}-{digits(4)}"
            said = f"{rng.choice(['please phone', 'phone', 'you may phone'])} {value} {rng.choice(['today', 'after lunch'])}"
        elif kind == 2:
            value = f"{rng.choice(WORDS)}{digits(3)}(at)host{digits(1)}.org" if odd else f"{rng.choice(WORDS)}.{digits(3)}@mail{digits(1)}.org"
            said = f"{rng.choice(['kindly write mailto', 'mailto'])} {value} {sentence(rng, 1)}"
        else:
            value, odd = f"{sentence(rng, 1)}{digits(7)}", False
            said = f"{rng.choice(['order', 'in lot'])} {value} {sentence(rng, 1)}"
        if odd:
            other[i] = (("card", "phone", "email")[kind], value)
        rows.append((i if i % 10 else None, f"{sentence(rng, 6)} {said} {sentence(rng, 6)}", i))
    return rows, other


def test_bootstrapping_finds_other_forms(spark):
    rng = random.Random(12)
    rows, other = planted(rng, 1600)
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int")
    red = {r["n"]: r["text"] for r in pii.redact(docs).collect()}
    found = {i for i, (kind, value) in other.items() if red[i] == rows[i][1].replace(value, f"<{kind.upper()}>")}
    assert len(found) > 0.9 * len(other)
    assert all(red[i] == rows[i][1] for i in range(3, 1600, 4))  # numbers in other contexts stay
    assert any(rows[i][0] is None for i in found)
    got = pii.report(docs)
    added = got.agg({"n_added": "sum"}).first()[0]
    assert len(found) <= added <= len(other) and got.count() == 1600
    study = pii.held_out_study(docs)
    assert study["hidden"] > 250 and study["found"] > 0.9 * study["hidden"] and study["right"] > 0.98 * study["found"]


def test_odd_rows_of_personal_data(spark):
    twice = "a@b.cd 4111111111111111 " * 2
    rows = [(1, twice), (1, twice), (None, twice), (2, None), (3, ""), (4, "x " * 300_000 + "1.2.3.4")]
    got = pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(str((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"])) for r in got) == sorted(map(str, [(1, 2, 0, 2)] * 2 + [(None, 2, 0, 2), (2, 0, 0, 0), (3, 0, 0, 0), (4, 0, 1, 0)]))
    assert {r["spans"] for r in got if r["doc_id"] == 4} == {"ip:600000:600007"}
    assert pii.mentions("call 0171 555 3824, or 12 34", [])[0]["value"] == "0171 555 3824"


# Benchmark decontamination


def test_decontamination_tolerates_substitutions(spark):
    rng = random.Random(2)
    item = [f"w{k}" for k in range(30)]
    line = " ".join(item[:9])
    gaps = [w if k % 6 else "x" for k, w in enumerate(item)]
    docs = [
        (1, sentence(rng, 20) + " " + " ".join(item) + " " + sentence(rng, 5)),
        (2, "  " + " ".join(gaps).upper()),
        (3, sentence(rng, 10) + " " + line + " " + sentence(rng, 10)),
        (4, None),
        (5, ""),
        (6, " ".join(item[5:])),
        (7, " ".join(w if k % 2 else "y" for k, w in enumerate(item))),
        (1, " ".join(item)),
        (None, " ".join(item)),
    ]
    df = spark.createDataFrame([(i, x, "z") for i, x in docs], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(0, " ".join(item)), (1, "too short"), (2, None)], "item_id long, text string")
    for limit in (500_000, 0):  # hashes met on the map side, and shuffled
        got = sorted((str(r["doc_id"]), r["item_id"], r["item_words"], r["matched"]) for r in decontamination.contaminated(df, bench, broadcast_hashes=limit).collect())
        assert got == [("1", 0, 30, 30), ("2", 0, 30, 25), ("6", 0, 30, 25), ("None", 0, 30, 30)]
    kept = decontamination.without_contaminated(df, bench)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["3", "4", "5", "7"] and kept.columns == df.columns
    five = spark.createDataFrame([(5, "one two three four five")], "item_id long, text string")
    edits = [(k, " ".join("zz" if j == k else w for j, w in enumerate("x one two three four five y".split()))) for k in range(1, 6)]
    edits += [(9, "one two three zz zz"), (10, "ab " * 300_000 + "one two three four five")]
    assert sorted(r["doc_id"] for r in decontamination.contaminated(spark.createDataFrame(edits, "doc_id long, text string"), five).collect()) == [1, 2, 3, 4, 5, 10]
    assert decontamination.contaminated(df.limit(0), bench).count() == 0 and decontamination.contaminated(df, bench.limit(0)).count() == 0


# Chat formatting


def test_events_fold_into_messages(spark):
    log = [
        (1, 0, "a", "message", "user", "hi"),
        (1, 1, "b", "delta", "assistant", "one "),
        (1, 2, "b", "delta", None, "two"),
        (1, 3, "b", "regenerate", None, None),
        (1, 4, "b", "delta", None, "three"),
        (1, 5, "a", "edit", None, "hello"),
        (1, 6, "c", "message", "user", "gone"),
        (1, 7, "c", "delete", None, None),
        (1, 1, "b", "delta", "assistant", "one "),
        (2, 0, None, None, None, None),
    ]
    df = spark.createDataFrame(log, "conv_id long, seq long, msg_id string, kind string, role string, text string").repartition(3)
    back = {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_conversations(df)).collect()}
    assert [(t["role"], t["text"]) for t in back[1]["turns"]] == [("user", "hello"), ("assistant", "three")] and back[1]["loss_text"] == "three"
    assert [(t["role"], t["text"]) for t in back[2]["turns"]] == [("", "")]
    assert chat_format.format_conversations(df.limit(0)).count() == 0
    with pytest.raises(Exception, match="unknown kind"):
        chat_format.format_conversations(spark.createDataFrame([(1, 0, "a", "odd", "user", "")], df.schema)).collect()


def test_messages_of_one_place(spark):
    """Equal seqs, null seqs, no names and repeated rows: every row stays, ordered by role and text."""
    schema = "conv_id long, seq long, msg_id string, kind string, role string, text string, extra int"
    log = [(1, 3, None, None, "user", "x", 1), (1, 3, None, None, "user", "x", 2), (1, 3, None, None, "assistant", "y", 1), (1, None, None, None, None, None, 1), (None, 1, "m", "message", "user", "n", 1), (None, 1, "m", "message", "user", "n", 1)]
    got = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in chat_format.read_back(chat_format.format_conversations(spark.createDataFrame(log, schema).repartition(3))).collect()}
    assert got == {1: [("", ""), ("assistant", "y"), ("user", "x"), ("user", "x")], None: [("user", "n")]}


@pytest.mark.parametrize("streamed", [False, True])
def test_any_text_survives_the_template(spark, streamed):
    rng = random.Random(5)
    pieces = ["###", "#", "</turn>", "</turn", ">", "\\", "\\h", "\\t", "\\b", "\n", " ", ": ", "assistant", "é🙂", ""]
    rows = [(c, t, rng.choice(["user", "assistant", "a: b", "### x", ""]), "".join(rng.choice(pieces) for _ in range(rng.randint(0, 12))), "m") for c in range(120) for t in range(rng.randint(1, 5))]
    rows += [(200, 0, role, text, "m") for role, text in (("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d"))]  # one turn
    rows += [(201, 0, "user", "same", "m")] * 3 + [(201, None, "user", "first", "m"), (201, 1, None, None, "m"), (None, 5, "assistant", "lost", "m")]
    rows += [(202, 1, "assistant", "é### " * 200_000, "m"), (202, 0, "user", "", "m")]  # a megabyte
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, msg_id string").repartition(4)
    seen = set()
    for r in chat_format.read_back(chat_format.format_conversations(chat_format.as_events(df, streamed))).collect():
        key = lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")
        own = sorted((x for x in rows if x[0] == r["conv_id"]), key=key)
        assert [(t["role"], t["text"]) for t in r["turns"]] == [(x[2] or "", x[3] or "") for x in own]
        assert r["loss_text"] == "".join(x[3] or "" for x in own if x[2] == "assistant")
        seen.add(r["conv_id"])
    assert seen == {x[0] for x in rows}


# Language


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    from millrace.llm.queries import op6_language_id

    got = {r["doc_id"]: r for r in op6_language_id(spark, "/root/testdata/sf0.01").collect()}
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for i, r in got.items())
    held = [i for i, r in got.items() if r["held_out"]]
    assert sum(got[i]["lang_pred"] == lang[i] for i in held) / len(held) > 0.97


def test_language_of_odd_texts(spark):
    train = spark.createDataFrame([(1, "the house and the garden " * 30, "en"), (2, "das haus und der garten " * 30, "de"), (3, None, "fr"), (4, "x", None)], "doc_id long, text string, lang string")
    contents = language_id.fit(train)
    assert sorted(contents) == ["de", "en"]
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "123 !?"), (4, "the garden and the house"), (None, "der garten und das haus")], "doc_id long, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"] > 0) for r in language_id.identify(docs, contents).collect()}
    assert got == {1: ("und", False), 2: ("und", False), 3: ("und", False), 4: ("en", True), None: ("de", True)}
    assert {r["lang_pred"] for r in language_id.identify(docs, language_id.fit(train.limit(0))).collect()} == {"und"}


# Quality


def plain_model(texts):
    """Interpolated modified Kneser-Ney over characters, by dictionaries: the probability of an n-gram."""
    from collections import Counter, defaultdict

    grams = Counter()
    for x in texts:
        padded = quality.EDGE * (quality.ORDER - 1) + x
        grams.update(padded[k : k + quality.ORDER] for k in range(len(x)))
    tables = [grams]
    for _ in range(quality.ORDER - 1):
        tables.insert(0, Counter(g[1:] for g in tables[0]))

    def cuts(t):
        n = Counter(t.values())
        if not all(n[k] for k in (1, 2, 3, 4)):
            return 0.5, 1.0, 1.5
        y = n[1] / (n[1] + 2 * n[2])
        return [min(max(k - (k + 1) * y * n[k + 1] / n[k], 0.05 * k), k - 0.05) for k in (1, 2, 3)]

    contexts = []
    for t in tables:
        d, own = cuts(t), defaultdict(lambda: [0, 0.0])
        for g, c in t.items():
            own[g[:-1]][0] += c
            own[g[:-1]][1] += d[min(c, 3) - 1]
        contexts.append((d, own))

    def p(g):
        low = p(g[1:]) if len(g) > 1 else 1 / (len(tables[0]) + 1)
        d, own = contexts[len(g) - 1]
        if g[:-1] not in own:
            return low
        total, cut = own[g[:-1]]
        c = tables[len(g) - 1][g]
        return (max(c - d[min(c, 3) - 1], 0) if c else 0) / total + cut / total * low

    return p, sorted(tables[0])


def test_model_equals_a_plain_one(spark):
    rng = random.Random(6)
    texts = [sentence(rng, 40) for _ in range(30)] + ["Éa, 12!\n", "zz", "日本語の文", "a\0b", ""]
    model = quality.Model(spark.createDataFrame([(x,) for x in [*texts, None]], "text string").repartition(3))
    p, letters = plain_model([x.replace("\0", quality.EDGE) for x in texts])
    padded = quality.EDGE * 4 + texts[0]
    asked = [padded[k : k + 5] for k in range(60)] + ["qxj 9", "日本語の文", "ran l", "~~~~~", "a" + quality.EDGE + "b c"]
    whole = [asked[7][:4] + c for c in [*letters, "~"]]
    got = {r["g"]: r["logp"] for r in model.log_probabilities(spark.createDataFrame([(x,) for x in asked + whole], "g string")).collect()}
    for g in asked + whole:
        assert abs(np.log(p(g)) - got[g]) < 1e-9
    assert abs(sum(np.exp(got[g]) for g in whole) - 1) < 1e-9  # over a context's characters and an unseen one


def plain_judgement(spark, docs, labels):
    """doc_id -> (perplexity, rejected) by the definition."""
    from pyspark.sql import functions as F

    good = {i for i, q, _ in labels if i is not None and q == 1} - {i for i, _, t in labels if t == 1}
    back = {r["doc_id"] for r in spark.createDataFrame([(i,) for i in good], "doc_id long").where(quality.held_back(F.col("doc_id"))).collect()}
    p, _ = plain_model([x or "" for i, x, *_ in docs if i in good - back])
    memo = {}

    def nll(x):
        padded = quality.EDGE * 4 + x
        out = 0.0
        for k in range(len(x)):
            g = padded[k : k + 5]
            if g not in memo:
                memo[g] = -np.log(p(g))
            out += memo[g]
        return out

    sums = [(nll(x), len(x)) if x and x.strip() else None for _, x, *_ in docs]
    known = [(lang or "", *s) for (i, _, lang, *_), s in zip(docs, sums, strict=True) if i in back and s]
    mean = lambda rows: sum(n for _, n, _ in rows) / sum(m for *_, m in rows)
    smooth = lambda s, m: np.exp((s[0] + quality.SMOOTH * m) / (s[1] + quality.SMOOTH))
    means = {lang: mean([r for r in known if r[0] == lang]) for lang in {r[0] for r in known}}

    def ends(values):
        v = sorted(values)
        at = lambda q: v[max(int(np.ceil(q * len(v))) - 1, 0)]
        return at(1 - quality.QUANTILE) / quality.SLACK, at(quality.QUANTILE) * quality.SLACK

    every = ends([smooth(r[1:], means[r[0]]) for r in known])
    own = {lang: ends([smooth(r[1:], means[lang]) for r in known if r[0] == lang]) for lang in means}
    out = {}
    for (i, _, lang, *_), s in zip(docs, sums, strict=True):
        low, high = own.get(lang or "", every)
        out[i] = (np.exp(s[0] / s[1]), not low <= smooth(s, means.get(lang or "", mean(known))) <= high) if s else (None, True)
    return out


def test_quality_equals_the_definition(spark, tmp_path):
    rng = random.Random(8)
    rows = [(k, sentence(rng, rng.choice((3, 30, 60))), ["aa", "bb", None][k % 3], k) for k in range(120)]
    rows += [(200 + k, "".join(rng.choice("qxz%$#9") for _ in range(300)), "aa", 1) for k in range(5)]
    rows += [(300, None, "aa", 1), (301, " \n", "aa", 1), (302, sentence(rng, 60), "zz", 1), (303, sentence(rng, 60), None, 1), (304, "la " * 300, "aa", 1), (305, sentence(rng, 30_000), "bb", 1), (306, "", None, 1), (307, "日本" * 50, "bb", 1)]
    labels = [(k, 1, 0) for k in range(120)] + [(200, 0, 0), (None, 1, 0), (302, 1, 1), (300, 1, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, perplexity int").repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want = plain_judgement(spark, rows, labels)
    got = {r["doc_id"]: r for r in quality.judged(docs, marks).collect()}
    assert set(got) == set(want)
    for i, (perplexity, rejected) in want.items():
        assert got[i]["rejected"] == rejected and (got[i]["perplexity"] is None if perplexity is None else abs(got[i]["perplexity"] / perplexity - 1) < 1e-5)
    assert all(want[200 + k][1] for k in range(5)) and want[304][1] and sum(want[k][1] for k in range(120)) < 12
    docs.write.parquet(str(tmp_path / "d"))  # from files, with their own numbering of rows
    kept = quality.keep_good(spark.read.parquet(str(tmp_path / "d")), marks)
    assert kept.columns == docs.columns and {r["doc_id"]: r["text"] for r in kept.collect()} == {i: x for i, x, *_ in rows if not want[i][1]}


def test_quality_of_odd_tables(spark):
    docs = spark.createDataFrame([(1, "abc abc", "x"), (1, "abc abc", "x"), (None, "abc", None), (2, None, "x"), (3, " ", "y")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.judged(docs.limit(0), labels).count() == 0
    for marks in (labels, labels.limit(0)):
        got = sorted(str((r["doc_id"], r["rejected"], r["perplexity"] is None)) for r in quality.judged(docs, marks).collect())
        assert len(got) == 5 and {x for x in got if "True, True" in x} == {"(2, True, True)", "(3, True, True)"}
    assert {r["doc_id"] for r in quality.judged(docs, labels.limit(0)).where("not rejected").collect()} == {1, None}
    assert quality.keep_good(docs.limit(0), labels.limit(0)).count() == 0


def test_quality_on_held_out_labels(spark):
    """Of the held-back trusted documents most are kept, of those called bad most go (neither was trained on)."""
    from pyspark.sql import functions as F

    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet").groupBy("doc_id").agg(F.max("quality").alias("q"), F.max("toxic").alias("t"))
    got = quality.judged(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")).join(labels, "doc_id").withColumn("back", quality.held_back(F.col("doc_id"))).collect()
    good = [r["rejected"] for r in got if r["q"] == 1 and not r["t"] and r["back"]]
    bad = [r["rejected"] for r in got if r["q"] == 0 and not r["t"]]
    assert sum(good) <= 0.07 * len(good) and sum(bad) >= 0.85 * len(bad)


def test_ids_in_one_or_many_tasks(spark):
    docs = spark.createDataFrame([(k, "x") for k in range(10)], "doc_id long, text string")
    ids = spark.createDataFrame([(2,), (3,)], "doc_id long")
    assert quality.of_trusted(docs, ids).count() == quality.of_trusted(docs, ids, broadcast_ids=0).count() == 2
