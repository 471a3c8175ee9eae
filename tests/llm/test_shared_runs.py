import random
import re

import pytest

from millrace.llm import substring_dedup
from millrace.llm.shared_runs import RUN

WORD = re.compile("[^\x20\x09-\x0d]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def plain_repeats(texts):
    """(text's number, removed) -> places of its words in windows that occur again, by looking at every window of every text."""
    places, out = {}, {}
    words = [[m[0].translate(UPPER) for m in WORD.finditer(x or "")] for x in texts]
    for i, w in enumerate(words):
        for k in range(len(w) - RUN + 1):
            places.setdefault(tuple(w[k : k + RUN]), []).append((i, k))
    for (j, p), *others in places.values():
        if others:
            out.setdefault((j, False), set()).update(range(p, p + RUN))
        for i, k in others:
            out.setdefault((i, True), set()).update(range(max(k, p + RUN) if j == i else k, k + RUN))
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéF日") for _ in range(rng.randint(2, 5)))
    own = lambda n: [word() for _ in range(n)]
    passages = [own(n) for n in (49, 50, 51, 60, 75, 140)]
    texts = []
    for _ in range(40):
        w = own(rng.choice((0, 5, 40, 90)))
        for _ in range(rng.randint(0, 3)):
            p = list(rng.choice(passages))
            a = rng.choice((0, 0, 1, 7))
            p = p[a : len(p) - rng.choice((0, 0, 1, 20))]
            if rng.random() < 0.3:
                p[rng.randrange(len(p))] = word()
            w += p + own(rng.choice((0, 3, 30)))
        texts.append("".join(x + rng.choice(("  ", " ", "\n", "\t\n", " ")) for x in w))
    return [*texts, "Der " * 300, "der " * 70, "a b c " * 60, texts[3], None, "", " \n"]


@pytest.mark.parametrize("seed", [1, 2])
def test_repeated_runs_equal_brute_force(spark, seed):
    texts = corpus(seed)
    docs = spark.createDataFrame([(10 + k, x, "x") for k, x in enumerate(texts)], "doc_id long, text string, row string").repartition(3)
    want = plain_repeats(texts)
    got = {}
    for r in substring_dedup.repeated_passages(docs, kinds=("run",)).collect():
        i = r["doc_id"] - 10
        places = {k for k, m in enumerate(WORD.finditer(texts[i])) if r["start"] <= m.start() and m.end() <= r["end"]}
        own = got.setdefault((i, r["removed"]), set())
        assert r["kind"] == "run" and len(places) == r["n_words"] and not places & own
        own |= places
    assert len(want) > 15 and got == want


def test_every_document_with_a_passage_is_found(spark):
    """Passages of 51 to 90 words planted at random places of lines, in at least two documents each: recall 1 of documents, and no others."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6)))
    texts = [[word() for _ in range(rng.randint(60, 200))] for _ in range(300)]
    planted = set()
    for k in range(30):
        p = [word() for _ in range(51 + k)]
        for i in rng.sample(range(200), 2 + k % 3):
            at = rng.randrange(len(texts[i]))
            texts[i][at:at] = p
            planted.add(i)
    rows = [(i, "".join(w + rng.choice("      \n") for w in x)) for i, x in enumerate(texts)]
    got = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    found = {r["doc_id"] for r in got}
    broken = {i for i, _ in plain_repeats([x for _, x in rows])}
    assert broken <= planted and found == broken and len(broken) > 0.95 * len(planted)  # a later passage may cut an earlier one


def test_passages_go_whatever_the_lines(spark):
    rng = random.Random(5)
    own = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(n)]
    p = own(60)
    wrapped = "\n".join(" ".join(p[k : k + 12]) for k in range(0, 60, 12))  # no line of 25 words
    head, tail = " ".join(own(80)), " ".join(own(80))
    inside = f"{head} {' '.join(p)} {tail}"  # a line that differs in most of its words
    docs = spark.createDataFrame([(1, wrapped), (2, inside), (2, wrapped), (None, "x"), (3, "Der " * 300)], "doc_id long, text string").repartition(2)
    assert substring_dedup.repeated_passages(docs, kinds=("paragraph",)).count() == 0
    left = sorted((r["doc_id"] or 0, " ".join((r["text"] or "").split())) for r in substring_dedup.remove_passages(docs).collect())
    assert left == sorted([(1, " ".join(p)), (2, f"{head} {tail}"), (2, ""), (0, "x"), (3, " ".join(["Der"] * RUN))])
    assert substring_dedup.repeated_passages(docs.limit(0)).count() == 0


def test_very_long_and_equal_ids(spark):
    rng = random.Random(3)
    p = " ".join(str(rng.randrange(10**6)) for _ in range(70))
    long = " ".join(str(rng.randrange(10**9)) for _ in range(150_000))  # 1.5 MB in one line
    docs = spark.createDataFrame([(1, f"{long} {p}"), (1, f"u v {p} w"), (None, f"{p} x"), (None, None)], "doc_id long, text string").coalesce(1)
    got = sorted(((r["doc_id"], r["start"], r["end"], r["removed"]) for r in substring_dedup.repeated_passages(docs, kinds=("run",)).collect()), key=str)
    assert len(got) == 3 and (None, 0, len(p), False) in got and (1, 4, 4 + len(p), True) in got and (1, len(long) + 1, len(long) + 1 + len(p), True) in got
