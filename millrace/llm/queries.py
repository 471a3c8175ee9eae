"""The registered queries of this subpackage: thin wrappers that put each operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import byte_bpe, chat_format, decontamination, fingerprints, language_id, ngram_join, pii, quality, substring_dedup, token_counts
from millrace.llm.common import load


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(load(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(load(spark, sf_dir, "documents"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    text = "\\### Assistant: </turn> ok"
    own = spark.range(1).select(
        F.lit(-7).cast("long").alias("conv_id"), F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(text).alias("text")) for k, role in enumerate(("user", "assistant"))])).alias("t")
    ).select("conv_id", "t.*")
    back = chat_format.read_back(chat_format.format_conversations(chat_format.as_events(rows.unionByName(own), streamed=True)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = language_id.is_held_out(F.col("doc_id"))
    contents = language_id.fit(docs.where(~held_out))
    out = language_id.identify(docs, contents)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.count_tokens(load(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.encode_digests(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(load(spark, sf_dir, "documents"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_study(load(spark, sf_dir, "documents"))


QUERIES = {
    "op1_pii": op1_pii,
    "op2_decontamination": op2_decontamination,
    "op3_ngram_join": op3_ngram_join,
    "op4_chat_format": op4_chat_format,
    "op5_quality": op5_quality,
    "op6_language_id": op6_language_id,
    "op7_token_counts": op7_token_counts,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_fingerprints": op10_fingerprints,
}

ORACLE_SQL = {
    "op2_decontamination": r"""
WITH d AS (
  SELECT doc_id, ws[i] AS w, i FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower("text"), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ws FROM documents), unnest(range(1, len(ws) + 1)) AS u(i)
), b AS (
  SELECT item_id, len(ws) AS n, ws[i] AS w, i FROM (SELECT item_id, list_filter(regexp_split_to_array(lower("text"), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ws FROM benchmark), unnest(range(1, len(ws) + 1)) AS u(i) WHERE len(ws) >= 4
), m AS (
  SELECT doc_id, item_id, any_value(n) AS n, d.i - b.i AS shift, count(*) AS matched, list(b.i) AS places FROM d JOIN b ON d.w = b.w GROUP BY doc_id, item_id, d.i - b.i
  HAVING count(*) >= ceil(least(any_value(n), 20) * 80 / 100)
), best AS (
  SELECT *, list_max(list_transform(range(1, greatest(n - 19, 1) + 1), lambda s: len(list_filter(places, lambda p: p >= s AND p < s + 20)))) AS within FROM m
)
SELECT doc_id, item_id, max(n) AS item_words, max(matched) AS matched FROM best WHERE within >= ceil(least(n, 20) * 80 / 100) GROUP BY doc_id, item_id
""",
    "op3_ngram_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 4), ' ') AS g FROM w, unnest(range(1, greatest(len(ws) - 3, 2))) AS u(i) WHERE len(ws) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL
), l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)
), r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT w.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, least(w.doc_id, min(r.b)) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN r ON r.a = w.doc_id GROUP BY w.doc_id
""",
    "op4_chat_format": r"""
WITH c AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce("text", '') AS txt FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, replace(replace(replace(txt, '\', '\b'), '###', '\h'), '</turn>', '\t') AS esc,
    replace(replace(replace(replace(role, '\', '\b'), '###', '\h'), '</turn>', '\t'), ':', '\c') AS esc_role FROM c
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || txt || chr(10), '' ORDER BY turn NULLS FIRST, role, txt)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(txt) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN txt ELSE '' END, '' ORDER BY turn NULLS FIRST, role, txt)) AS loss_sha256,
  CAST(sum(length('### ' || esc_role || ': ' || esc || ' </turn>' || chr(10))) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
""",
    "op9_substring_dedup": r"""
WITH RECURSIVE lines AS (
  SELECT doc_id, k AS para, ls[k + 1] AS line FROM (SELECT doc_id, string_split("text", chr(10)) AS ls FROM documents WHERE "text" IS NOT NULL), unnest(range(len(ls))) AS u(k)
), p AS (
  SELECT doc_id * 1000000 + para AS id, doc_id, len(ws) AS n_words, ws, CAST(coalesce(sum(length(line) + 1) OVER w, 0) AS INTEGER) AS start, length(line) AS size
  FROM (SELECT *, list_filter(regexp_split_to_array(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM lines)
  WINDOW w AS (PARTITION BY doc_id ORDER BY para ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), s AS (SELECT DISTINCT id, array_to_string(list_slice(ws, i, i + 4), ' ') AS g FROM p, unnest(range(1, len(ws) - 3)) AS u(i) WHERE n_words >= 25
), n AS (SELECT id, count(*) AS n FROM s GROUP BY id
), c AS (SELECT x.id AS a, y.id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.id <> y.id GROUP BY ALL
), l AS (SELECT a, b FROM c JOIN n na ON na.id = a JOIN n nb ON nb.id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)
), r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), k AS (SELECT a AS id, least(a, min(b)) AS keep FROM r GROUP BY a
), pieces AS (
  SELECT doc_id, i, ps[i] AS piece FROM (SELECT doc_id, regexp_extract_all("text", '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+') AS ps FROM documents WHERE "text" IS NOT NULL), unnest(range(1, len(ps) + 1)) AS u(i)
), words AS (
  SELECT doc_id, i, stop - length(w) AS start, stop, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w
  FROM (SELECT doc_id, i, regexp_replace(piece, '^[\x20\x09-\x0D]+', '') AS w, CAST(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i) AS INTEGER) AS stop FROM pieces)
), runs AS (
  SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 49), ' ') AS g FROM (SELECT doc_id, list(w ORDER BY i) AS ws FROM words GROUP BY doc_id), unnest(range(1, len(ws) - 48)) AS u(i)
), firsts AS (SELECT g, min({'d': doc_id, 'i': i}) AS f FROM runs GROUP BY g HAVING count(*) > 1
), found AS (
  SELECT doc_id, i, f.d AS d, f.i AS j, doc_id <> f.d OR i <> f.i AS removed, doc_id = f.d AND i > f.i AND i < f.i + 50 AS overlap FROM runs JOIN firsts USING (g)
), placed AS (
  SELECT x.doc_id, removed, d, j, CASE WHEN overlap THEN j + 50 ELSE x.i END AS i, x.i + 50 AS until, CASE WHEN overlap THEN e.stop ELSE a.start END AS start, z.stop
  FROM found x JOIN words a ON a.doc_id = x.doc_id AND a.i = x.i JOIN words z ON z.doc_id = x.doc_id AND z.i = x.i + 49 JOIN words e ON e.doc_id = x.d AND e.i = x.j + 49
), marked AS (
  SELECT *, CASE WHEN i <= max(until) OVER w THEN 0 ELSE 1 END AS new FROM placed WINDOW w AS (PARTITION BY doc_id, removed ORDER BY i, until ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), numbered AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, removed ORDER BY i, until ROWS UNBOUNDED PRECEDING) AS span FROM marked
), spans AS (
  SELECT doc_id, removed, min(start) AS start, max(stop) AS stop, max(until) - min(i) AS n_words, min({'i': i, 'd': d, 'j': j}) AS f FROM numbered GROUP BY doc_id, removed, span
)
SELECT 'paragraph' AS kind, p.doc_id, p.start, CAST(p.start + p.size AS INTEGER) AS "end", CAST(p.n_words AS INTEGER) AS n_words, q.doc_id AS keep_doc_id, q.start AS keep_start, keep <> p.id AS removed
FROM p JOIN k USING (id) JOIN p q ON q.id = keep
UNION ALL
SELECT 'run', s.doc_id, s.start, s.stop, CAST(s.n_words AS INTEGER), s.f.d, w.start, removed FROM spans s JOIN words w ON w.doc_id = s.f.d AND w.i = s.f.j
""",
}
