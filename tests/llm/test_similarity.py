import random
import re
from collections import defaultdict

import pytest

from millrace.llm import components, fingerprints, ngram_join, substring_dedup
from millrace.llm.text_arrays import shingle_sets, word_hashes

WORD = re.compile("[^\x20\x09-\x0d]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def plain_set(text, n=5):
    w = WORD.findall((text or "").translate(UPPER))
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def plain_components(sets):
    """id -> smallest id reachable, by comparing all pairs."""
    ids = sorted(sets)
    top = {i: i for i in ids}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                p, q = sorted((find(a), find(b)))
                top[q] = p
    return {i: find(i) for i in ids}


def corpus(seed, n=60):
    """Texts with exact and near copies, chains of edits, a line that most of them share, and odd ones."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 3)))
    shared = " ".join(word() for _ in range(30))
    texts = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.45 or not texts:
            own = [word() for _ in range(rng.choice((0, 1, 3, 4, 5, 6, 9, 40, 120)))]
            text = " ".join(own) + ("\n" + shared if rng.random() < 0.6 else "")
        elif kind < 0.6:
            text = rng.choice(texts)
        else:
            w = rng.choice(texts).split(" ")
            for _ in range(rng.randint(1, 3)):
                w[rng.randrange(len(w))] = word()
            text = " ".join(w)
        texts.append(text.upper() if rng.random() < 0.1 else text)
    return [*texts, None, "", " \t\n", " ", "A b", "a B"]


def test_words_and_sets_equal_plain_ones():
    texts = [x or "" for x in corpus(1)] + ["x" * (3 << 20) + " y", "a\x0bb\x0cc d"]
    hashes, counts = word_hashes([x.encode() for x in texts])
    assert counts.tolist() == [len(WORD.findall(x)) for x in texts]
    words = [w.translate(UPPER) for x in texts for w in WORD.findall(x)]
    assert len(set(words)) == len(set(hashes.tolist())) and len(set(zip(words, hashes.tolist(), strict=True))) == len(set(words))
    sets = shingle_sets([x.encode() for x in texts])
    for x, own in zip(texts, sets, strict=True):
        assert len(plain_set(x)) == len(own)


def long_texts(seed):
    """Texts whose sets are cut into several blocks of columns, and near copies on both sides of the next cut."""
    rng = random.Random(seed)
    out = []
    for n in (components.BLOCK_COLUMNS - 20, 2 * components.BLOCK_COLUMNS + 9, 5000):
        w = [f"{rng.randrange(10**6)}" for _ in range(n)]
        out += [" ".join(w), " ".join([*w, *[f"x{k}" for k in range(n // 8)]]), " ".join([*w[: n // 2], *[f"y{k}" for k in range(n // 2)]])]
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_join_equals_all_pairs(spark, seed, monkeypatch):
    monkeypatch.setattr(components, "PIVOTS", [(1, 4), (1, 1, 4, 16, 64), (64,)][seed - 1])
    monkeypatch.setattr(ngram_join, "FLUSH_ENTRIES", 500)
    texts = corpus(seed) + (long_texts(seed) if seed == 2 else [])
    docs = spark.createDataFrame([(10 + k, x, "n") for k, x in enumerate(texts)], "doc_id long, text string, n string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(docs).collect()}
    sets = {10 + k: plain_set(x) for k, x in enumerate(texts)}
    comp = plain_components(sets)
    assert got == {i: (len(sets[i]), comp[i]) for i in sets}


def test_lists_of_many_unlinked_sets_are_worked_off(spark, monkeypatch):
    """More rounds than pivots grow in; within the list, chains of linked sets."""
    import numpy as np

    monkeypatch.setattr(components, "PIVOTS", (1, 6))
    sets = {i: {*range(7), *(1000 * i + k for k in range(3))} for i in range(40)}
    for i in (12, 25, 31):  # 12, 100 + 12 and 200 + 12 are a chain
        sets[100 + i] = {*range(7), 1000 * i, 1000 * i + 1, 5}
        sets[200 + i] = {*range(6), 1000 * i, 1000 * i + 1, 77}
    plain = plain_components({i: frozenset(x) for i, x in sets.items()})
    rows = [(i, len(x), 1, 0, sorted(x)) for i, x in sets.items()]
    table = spark.createDataFrame(rows, "id long, n long, blocks long, block long, h array<long>")
    postings = spark.createDataFrame([(1, i, len(x), len(x)) for i, x in sets.items()], "key long, id long, n long, u long")
    got = {r["id"]: r["component"] for r in components.linked_components(postings, table, 75).collect()}
    assert got and got == {i: c for i, c in plain.items() if list(plain.values()).count(c) > 1}
    parts = list(components.column_blocks_of(np.arange(3000, dtype=np.int64), 3000))
    assert sorted({(x, y) for x, y, _ in parts}) == [*[(2, k) for k in range(2)], *[(4, k) for k in range(4)]]


def test_join_of_odd_tables(spark):
    schema = "doc_id long, text string, component_id int"
    assert ngram_join.jaccard_components(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "a b c d e f", 1), (None, None, 1), (5, "a b c d e f", 1), (5, "a b c d e f", 1), (3, "A B C D E F", 1), (None, "p q r s t u", 1), (8, "p q r s t u", 1), (8, "u t s r q p", 1), (9, "u t s r q p", 1), (None, "", 1), (None, "solo", 1)]
    docs = spark.createDataFrame(rows, schema)
    got = sorted(map(str, ngram_join.jaccard_components(docs).collect()))
    want = [(None, 2, 3), (None, 0, None), (5, 2, 3), (5, 2, 3), (3, 2, 3), (None, 2, 8), (8, 2, 8), (8, 2, 8), (9, 2, 8), (None, 0, None), (None, 1, None)]
    assert got == sorted(f"Row(doc_id={i}, n_shingles={n}, component_id={c})" for i, n, c in want)
    kept = ngram_join.one_of_each_group(docs.unionByName(spark.createDataFrame([(10, "x", 1), (10, "x", 1)], schema)))
    left = sorted(str((r["doc_id"], r["text"])) for r in kept.collect())
    assert left == sorted(map(str, [(3, "A B C D E F"), (8, "p q r s t u"), (8, "u t s r q p"), (None, None), (None, ""), (None, "solo"), (10, "x")]))
    assert kept.columns == docs.columns


def test_components_of_a_chain(spark):
    rng = random.Random(1)
    order = list(range(40))
    rng.shuffle(order)
    edges = list(zip(order, order[1:], strict=False)) + [(100, 101), (101, 101)]
    for limit in (1000, 10):  # in one task, and by stars
        got = {r["id"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long"), limit).collect()}
        assert got == {**{i: 0 for i in range(40)}, 100: 100, 101: 100}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    before = spark.createDataFrame([(i, 0) for i in (0, 3, 5)] + [(7, 7), (8, 7)], "id long, component long")
    after = components.with_links(before, spark.createDataFrame([(8, 9), (5, 9), (20, 21)], "a long, b long"))
    assert {r["id"]: r["component"] for r in after.collect()} == {**{i: 0 for i in (0, 3, 5, 7, 8, 9)}, 20: 20, 21: 20}


@pytest.mark.parametrize("ids", ["own", "none"])
def test_repeated_lines_equal_all_pairs(spark, ids):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    passage = [word() for _ in range(60)]
    long = [word() for _ in range(3000)]  # a line whose set is cut into blocks
    docs = {}
    for i in range(40):
        lines = [" ".join(word() for _ in range(rng.choice((3, 30, 70)))) for _ in range(3)]
        if i % 3 == 0:
            w = list(passage)
            if i % 2:
                w[rng.randrange(60)] = word()
            lines.insert(rng.randrange(4), " ".join(w))
        if i in (5, 20):
            lines.append(" ".join([*long, *[word() for _ in range(i)]]))
        docs[i] = "\n".join(lines)
    docs[50], docs[51] = None, ""
    table = [(i if ids == "own" else None, x, 1) for i, x in docs.items()]
    df = spark.createDataFrame(table, "doc_id long, text string, para int").coalesce(1)
    sets = {(i, k): plain_set(line) for i, x in docs.items() for k, line in enumerate((x or "").split("\n")) if len(line.split()) >= substring_dedup.MIN_WORDS}
    comp = plain_components(sets)
    size = defaultdict(int)
    for c in comp.values():
        size[c] += 1
    want = {p: c for p, c in comp.items() if size[c] > 1}
    begin = lambda i, k: sum(len(line) + 1 for line in docs[i].split("\n")[:k])
    name = lambda i: i if ids == "own" else None
    places = sorted(str((name(p[0]), begin(*p), begin(*p) + len(docs[p[0]].split("\n")[p[1]]), name(c[0]), begin(*c), p != c)) for p, c in want.items())
    got = substring_dedup.repeated_passages(df, kinds=("paragraph",)).collect()
    assert sorted(str((r["doc_id"], r["start"], r["end"], r["keep_doc_id"], r["keep_start"], r["removed"])) for r in got) == places and {r["kind"] for r in got} == {"paragraph"}
    left = sorted(str((r["doc_id"], r["text"])) for r in substring_dedup.remove_passages(df).collect())
    plain = {i: None if x is None else "\n".join(line for k, line in enumerate(x.split("\n")) if (i, k) not in want or want[i, k] == (i, k)) for i, x in docs.items()}
    assert left == sorted(str((name(i), x)) for i, x in plain.items())
    assert substring_dedup.repeated_passages(df.limit(0)).count() == 0


def test_fingerprints(spark):
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(n)) for n in (400, 300, 3, 1000)] + ["", None, "éé", "a" * 5000, "abc"]
    ids = [7, 3, 12, 40, 5, 9, 1, 77, 60]
    docs = spark.createDataFrame([(i, x, "x") for i, x in zip(ids, texts, strict=True)], "doc_id long, text string, fingerprint string").repartition(3)
    got = {r["doc_id"]: r for r in fingerprints.edit_study(docs).collect()}
    import hashlib

    ranks = fingerprints.ranks_of(fingerprints.level_counts(docs))
    order = sorted(zip(ids, [x or "" for x in texts], strict=True))
    for k, (i, x) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        cut = len(x) // 4
        changed = x[: len(x) - cut] + following[:cut]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(x), hashlib.sha256(changed.encode()).hexdigest())
        own, new, other = (fingerprints.Fingerprint(y.encode(), ranks) for y in (x, changed, following))
        assert (r["fingerprint"], r["edited_fingerprint"]) == (str(own), str(new))
        assert (r["near_edited"], r["near_next"]) == (fingerprints.likeness(own, new), fingerprints.likeness(own, other))
        assert fingerprints.likeness(own, own) == 1.0
    assert got[40]["near_edited"] > 0.6 and got[40]["near_next"] < 0.2
    assert {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprints(docs).collect()} == {i: r["fingerprint"] for i, r in got.items()}


def test_window_levels_equal_counted_ones():
    import numpy as np

    rng = random.Random(2)
    data = bytes(rng.choice(b"aabbcdef \xc3") for _ in range(300))
    w = fingerprints.WINDOW
    want = []
    for k in range(len(data) - w + 1):
        counts = np.unique(list(data[k : k + w]), return_counts=True)[1]
        h = -sum(c / w * np.log2(c / w) for c in counts)
        want.append(h / np.log2(w) * fingerprints.LEVELS)
    got = fingerprints.window_levels(np.frombuffer(data, np.uint8))
    assert np.abs(got - np.array(want)).max() <= 0.51


def test_fingerprints_of_odd_tables(spark):
    schema = "doc_id long, text string"
    assert fingerprints.edit_study(spark.createDataFrame([], schema)).count() == 0
    one = fingerprints.edit_study(spark.createDataFrame([(1, "abcdefgh")], schema)).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    rows = fingerprints.edit_study(spark.createDataFrame([(1, "abcdefgh"), (1, "abcdefgh"), (None, "zz"), (None, None)], schema)).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == ["1", "1", "None", "None"]
