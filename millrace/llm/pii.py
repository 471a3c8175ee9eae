"""Personal data by bootstrapped contextual extraction.

Base spans (email, ip, card, phone) come from fixed expressions and checks, and always
stay. Their values are the seeds. The words around a seed induce lexical patterns: the two words before it, the
one before it, the one after it. Other tokens with a digit or an at sign, and rows of numbers,
are candidates, whatever their form. Patterns and values make a graph that Spark scores in rounds:

* a pattern that at least ``MIN_SEEDS`` different known values of a kind support is worth, for that kind,
  the share of identifiers among all that its words are followed (or preceded) by anywhere in
  the corpus, candidates of unknown kind left aside. So words that stand before anything are worth nothing;
* a candidate scores what its patterns of worth ``MIN_WORTH`` or more say together (noisy or), a little
  less for each where its coarse class isn't one that the kind's seeds have;
* candidates that reach ``ACCEPT`` are identifiers: their spans are added to the base, and in the
  next round they support patterns like seeds. Rounds end when nothing new is accepted.

The graph holds one edge for each different (pattern, value): a value or a context that
fills a third of the rows is one edge, summed before it is shuffled. Patterns with enough support are sent to
the scan that counts their words ``PATTERNS_AT_ONCE`` at a time.

Defined results: a null text is empty and has no spans; texts of any length are read
whole; positions are code points, end exclusive; repeated rows give repeated rows, told apart by
their number; a null id stays null; equal scores go to the first kind; an empty table gives an empty table. Only the id and text columns are
read (``redact`` keeps all others as they are), so other columns can't clash (names that begin
with two underscores are the operator's own).
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import forget, map_batches, stored, with_rows

#: The kinds in their order, and the expressions and limits of the base.
KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Rounds of scoring at most, different values that a pattern needs, the worth that it needs to be heard, the score that a candidate needs, and what a candidate of another class loses.
ROUNDS, MIN_SEEDS, MIN_WORTH, ACCEPT, LOOSE = 5, 4, 0.3, 0.8, 0.85
#: The shortest candidate, the most digits of a row of numbers, the share of a kind's seeds that makes a class its own.
SHORTEST, MOST_DIGITS, OWN_CLASS = 6, 19, 0.05
#: Patterns that a scan counts at a time, and normalised words that it remembers.
PATTERNS_AT_ONCE, WORDS_LIMIT = 200_000, 500_000

ANCHOR = re.compile(r"[0-9@]")
TOKEN = re.compile(r"\S+")
NUMBERS = re.compile(r"(?:\+|\(|\+\()?\d[\d().+/-]*")
EDGE_MARKS = "\"'`()[]{}<>,;:.!?|*#$%&="


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind's number, start, end) by kind, then start."""
    out: list[tuple[int, int, int]] = []
    if not ANCHOR.search(text):
        return out
    end = 0
    for m in DOMAIN.finditer(text) if "@" in text else ():
        # The expression's first part ends at the at sign, which it can't hold: it reaches back as far as it may.
        start = m.start()
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            end = m.end()
            out.append((0, start, end))
    # Each run of digits is tried once, from its beginning: it can't be shortened before a full stop.
    out += [(1, *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    for m in PHONE.finditer(text) if "+" in text else ():
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((3, *m.span()))
    return out


def coarse_class(value: str) -> str:
    """What a value is made of: with an at sign, four numbers, digits by how many, or a mixture."""
    if "@" in value or "(at)" in value or "[at]" in value:
        return "at"
    if re.fullmatch(r"\d+(\.\d+){3}", value):
        return "quad"
    digits = sum(map(str.isdigit, value))
    if re.fullmatch(r"[\d\s().+/-]+", value):
        return "long" if digits >= 13 else "number" if digits >= 7 else "short"
    return "mixed"


def context_word(word: str) -> str:
    return re.sub(r"\d", "0", word.strip(EDGE_MARKS).lower())


def before_and_after(text: str, start: int, end: int) -> tuple[str, str, str]:
    """The two words before a span and the one after it, normalised; empty at the text's ends."""
    reach = start
    words: list[str] = []
    while reach and len(words) < 2:
        stop = reach
        while stop and text[stop - 1].isspace():
            stop -= 1
        reach = stop
        while reach and not text[reach - 1].isspace():
            reach -= 1
        if reach < stop:
            words.append(context_word(text[reach:stop]))
    following = TOKEN.search(text, end)
    return (words[1] if len(words) > 1 else ""), (words[0] if words else ""), (context_word(following[0]) if following else "")


def mentions(text: str, base: list[tuple[int, int, int]]) -> list[dict]:
    """Seeds and candidates: kind's number (-1: candidate), span, value, coarse class and patterns."""
    spans = [(k, a, b) for k, a, b in base]
    covered = sorted((a, b) for _, a, b in base)
    at, place = 0, 0
    while m := ANCHOR.search(text, at):
        start = end = m.start()
        while start and not text[start - 1].isspace():
            start -= 1
        while end < len(text) and not text[end].isspace():
            end += 1
        at = end
        if NUMBERS.fullmatch(text, start, end):  # numbers parted by single spaces are one candidate
            digits = sum(map(str.isdigit, text[start:end]))
            while text[end : end + 1] == " " and (more := NUMBERS.match(text, end + 1)) and (more.end() == len(text) or text[more.end()].isspace() or text[more.end()] in EDGE_MARKS):
                digits += sum(map(str.isdigit, more[0]))
                if digits > MOST_DIGITS:
                    break
                at = end = more.end()
        while start < end and text[start] in EDGE_MARKS:
            start += 1
        while end > start and text[end - 1] in EDGE_MARKS:
            end -= 1
        while place < len(covered) and covered[place][1] <= start:
            place += 1
        if end - start >= SHORTEST and not any(a < end and start < b for a, b in covered[place : place + 4]):
            spans.append((-1, start, end))
    out = []
    for kind, a, b in spans:
        two, one, after = before_and_after(text, a, b)
        patterns = [f"2 {two} {one}"] * bool(one and two) + [f"1 {one}"] * bool(one) + [f"a {after}"] * bool(after)
        out.append({"kind": kind, "start": a, "end": b, "value": text[a:b], "form": coarse_class(text[a:b]), "patterns": patterns})
    return out


SPAN = "struct<kind:int,start:int,end:int>"
SCANNED = f"row long, id long, base array<{SPAN}>, base_sha256 string, found array<struct<kind:int,start:int,end:int,value:string,form:string,patterns:array<string>>>"


def scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Each row's base spans and mentions, without its text. ``docs`` has ``__row``."""
    span = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
    mention = pa.struct([*span, ("value", pa.string()), ("form", pa.string()), ("patterns", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, prints, found = [], [], []
            for text in batch.column(2).to_pylist():
                own = base_spans(text or "")
                base.append([{"kind": k, "start": a, "end": b} for k, a, b in own])
                prints.append(hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in own).encode()).hexdigest())
                found.append(mentions(text or "", own))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(base, pa.list_(span)), pa.array(prints, pa.string()), pa.array(found, pa.list_(mention))], ["row", "id", "base", "base_sha256", "found"])

    return map_batches(docs.select(F.col("__row").alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), run, SCANNED)


def context_totals(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """``pattern, total``: how often the words of the stored ``patterns(pattern)`` stand anywhere in ``texts(text)``, whatever is beside them."""
    blocks = -(-patterns.count() // PATTERNS_AT_ONCE)
    out = None
    for block in range(blocks):
        own = [r["pattern"] for r in patterns.where(F.pmod(F.xxhash64("pattern"), F.lit(blocks)) == block).collect()]
        sent = texts.sparkSession.sparkContext.broadcast(own)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            asked = [x.split(" ") for x in sent.value]
            alone = {x[1] for x in asked if x[0] != "2"}
            pairs = {(x[1], x[2]) for x in asked if x[0] == "2"}
            seconds = {x for _, x in pairs}
            memo: dict[str, str] = {}
            totals: Counter = Counter()
            for batch in batches:
                for text in batch.column(0).to_pylist():
                    words = (text or "").split()
                    for w in words:
                        if w not in memo:
                            if len(memo) >= WORDS_LIMIT:
                                memo.clear()
                            memo[w] = context_word(w)
                    words = [memo.get(w) or context_word(w) for w in words]
                    totals.update(filter(alone.__contains__, words))
                    totals.update(pair for k, w in enumerate(words) if w in seconds and k and (pair := (words[k - 1], w)) in pairs)
            found = [(p, totals[x[1]] if x[0] != "2" else totals[x[1], x[2]]) for p, x in zip(sent.value, asked, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], ["pattern", "total"])

        counted = map_batches(texts.select("text"), run, "pattern string, total long").groupBy("pattern").agg(F.sum("total").alias("total"))
        out = counted if out is None else out.unionByName(counted)
    return out if out is not None else patterns.withColumn("total", F.lit(0).cast("long"))


def discovered(mentioned: DataFrame, texts: DataFrame) -> DataFrame:
    """``value, kind``: the candidates that high-confidence patterns make identifiers. ``mentioned(kind, value, form, patterns)`` of ``texts(text)``."""
    edges = mentioned.select(F.explode("patterns").alias("pattern"), "value", "form", "kind").groupBy("pattern", "value", "form").agg(F.max("kind").alias("kind"), F.count("*").alias("n"))
    edges = stored(edges)
    values = mentioned.where("kind >= 0").groupBy("value", "form").agg(F.max("kind").alias("k"))
    forms = values.groupBy("k", "form").agg(F.count("*").alias("c"))
    of_kind = forms.groupBy("k").agg(F.sum("c").alias("total"))
    own_forms = stored(forms.join(of_kind, "k").where(F.col("c") >= OWN_CLASS * F.col("total")).select("k", "form", F.lit(1.0).alias("fit")))  # kinds times classes
    known = stored(values.limit(0).select("value", "k"))
    totals = None
    for _ in range(ROUNDS):
        labelled = edges.join(known.withColumnRenamed("k", "found"), "value", "left").withColumn("k", F.when(F.col("kind") >= 0, F.col("kind")).otherwise(F.col("found")))
        labelled = stored(labelled.drop("found", "kind"))
        support = labelled.where("k is not null").groupBy("pattern", "k").agg(F.count("*").alias("seeds"), F.sum("n").alias("hits")).where(F.col("seeds") >= MIN_SEEDS)
        support = stored(support)
        asked = support.select("pattern").distinct()
        asked = stored(asked if totals is None else asked.join(totals, "pattern", "left_anti"))
        new = context_totals(texts, asked)
        before, totals = totals, stored(new if totals is None else totals.unionByName(new))
        unknown = labelled.where("k is null").groupBy("pattern").agg(F.sum("n").alias("unknown"))
        worth = F.col("hits") / (F.greatest(F.col("total") - F.coalesce("unknown", F.lit(0)), F.col("hits")) + 1)
        patterns = stored(support.join(totals, "pattern").join(unknown, "pattern", "left").select("pattern", "k", worth.alias("worth")).where(F.col("worth") >= MIN_WORTH))
        heard = labelled.where("k is null").drop("k").join(patterns, "pattern").join(own_forms, ["k", "form"], "left")
        score = 1 - F.exp(F.sum(F.log1p(-F.col("worth") * F.coalesce("fit", F.lit(LOOSE)))))
        best = heard.groupBy("value", "k").agg(score.alias("score")).where(F.col("score") >= ACCEPT).groupBy("value").agg(F.max(F.struct(F.col("score"), (-F.col("k")).alias("k"))).alias("b"))
        accepted = stored(best.select("value", (-F.col("b.k")).alias("k")))
        some = accepted.limit(1).count()
        older, known = known, stored(known.unionByName(accepted))
        forget(labelled, support, asked, patterns, accepted, older, *([before] if before is not None else []))
        if not some:
            break
    return known.select("value", F.col("k").cast("int").alias("kind"))


def held_out_study(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> dict[str, int]:
    """A third of the base spans' values, by a hash, is hidden from the seeds: how many there are, how many come back, and how many of these under their own kind."""
    rows = with_rows(docs, id_col)
    found = stored(scan(rows, id_col, text_col).select(F.explode("found").alias("m")).select("m.*"))
    hide = (F.col("kind") >= 0) & (F.pmod(F.xxhash64("value", F.lit("hidden")), F.lit(3)) == 0)
    hidden = stored(found.where(hide).select("value", F.col("kind").alias("true")).distinct())
    back = discovered(found.withColumn("kind", F.when(hide, F.lit(-1)).otherwise(F.col("kind"))), rows.select(F.col(text_col).cast("string").alias("text")))
    met = hidden.join(back, "value", "left").agg(F.count("*").alias("hidden"), F.count("kind").alias("found"), F.count_if(F.col("kind") == F.col("true")).alias("right"))
    return met.first().asDict()


def find_spans(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row, id, base, base_sha256, added``: the spans of each of ``rows``, which have ``__row``; ``added`` also holds the values."""
    scanned = stored(scan(rows, id_col, text_col))
    found = scanned.select("row", F.explode("found").alias("m")).select("row", "m.*")
    new = discovered(found.select("kind", "value", "form", "patterns"), rows.select(F.col(text_col).cast("string").alias("text")))
    added = found.where("kind < 0").select("row", "start", "end", "value").join(new, "value").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("kind", "start", "end", "value"))).alias("added"))
    none = F.array().cast("array<struct<kind:int,start:int,end:int,value:string>>")
    return scanned.drop("found").join(added, "row", "left").withColumn("added", F.coalesce("added", none))


def report(docs: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added`` of each row of ``docs(doc_id, text)``."""
    names = F.array(*map(F.lit, KINDS))
    both = F.sort_array(F.concat("base", F.transform("added", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))))
    kinds = F.transform("base", lambda x: x["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    spans = F.array_join(F.transform(both, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
    return find_spans(with_rows(docs.select("doc_id", "text"))).select(F.col("id").alias("doc_id"), *counts, "base_sha256", spans.alias("spans"), F.size("added").cast("long").alias("n_added"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span of personal data replaced by its kind in angle brackets; all columns stay.

    Base spans are found again in each text as it is read; only the added ones, which are
    few, come by a join, and are applied where the text has that value in that place.
    """
    rows = with_rows(docs, id_col)
    added = find_spans(rows, id_col, text_col).where(F.size("added") > 0)
    added = stored(added.select(F.col("row").alias("__row"), F.col("added").alias("__added")))
    text = docs.schema.names.index(text_col)
    joined = rows.join(added, "__row", "left").select(*docs.columns, "__added")
    columns = docs.columns
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value, more in zip(batch.column(text).to_pylist(), batch.column(len(columns)).to_pylist(), strict=True):
                if value is None:
                    out.append(None)
                    continue
                spans = base_spans(value) + [(x["kind"], x["start"], x["end"]) for x in more or ()]
                done, at = [], 0
                for kind, a, b in sorted(spans, key=lambda x: (x[1], -x[2])):
                    if a >= at:
                        done += [value[at:a], f"<{KINDS[kind].upper()}>"]
                    at = max(at, b)
                done.append(value[at:])
                out.append("".join(done))
            arrays = [pa.array(out, pa.string()) if k == text else batch.column(k) for k in range(len(columns))]
            yield pa.RecordBatch.from_arrays(arrays, columns)

    return map_batches(joined, run, schema)
