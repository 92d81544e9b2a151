"""Queries that apply each operator to its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, common, embed_dedup, langid, mixing, ngram_join, pii, quality, substring, token_files
from .common import table


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), 0.93)


OP5_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0
), p AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= 0.93
), r AS (
  SELECT vec_id AS a, vec_id AS c FROM embeddings
  UNION SELECT r.a, p.b FROM r JOIN p ON r.c = p.a
), c AS (SELECT a, min(c) AS c FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.c AS component_id, e.vec_id = c.c AS kept
FROM embeddings e JOIN c ON e.vec_id = c.a LEFT JOIN n ON e.vec_id = n.a
"""


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"), F.lit(hard).alias("text"))
    made = chat.format_chats(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own))
    read = made.withColumn("turns", chat.parse(F.col("formatted")))
    read = read.withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans"), F.col("turns")))
    flat = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(flat, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


OP6_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, contains(text, '<s>') OR contains(text, '</s>') OR contains(text, '[INST]') OR contains(text, '[/INST]') AS hit,
    replace(replace(replace(replace(replace(text, '&', '&amp;'), '<s>', '&lt;s>'), '</s>', '&lt;/s>'), '[INST]', '&lb;INST]'), '[/INST]', '&lb;/INST]') AS esc,
    replace(replace(replace(replace(replace(replace(role, '&', '&amp;'), '<s>', '&lt;s>'), '</s>', '&lt;/s>'), '[INST]', '&lb;INST]'), '[/INST]', '&lb;/INST]'), '|', '&bar;') AS head
  FROM c
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(9 + length(head) + 2 + 7 + length(CASE WHEN hit THEN esc ELSE text END) + 4) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = mixing.mix(docs)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, text, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), k AS (
  SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS k FROM s
), w AS (
  SELECT *, CASE k % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w, source_size * 2.0::DOUBLE AS cap FROM k
), f AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM w
), l AS (
  SELECT arg_min(level, cap / w) FILTER (WHERE level * w <= cap) AS level FROM f
), t AS (
  SELECT f.source, f.source_size, least(cap, l.level * w) AS target FROM f, l
), x AS (
  SELECT doc_id, source, size, greatest(length(bin(size)) - 1, 0) AS k, (CAST(('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u FROM d
), g AS (
  SELECT source, k, sum(size) AS words, least(greatest(k, 2), 8) / 8.0::DOUBLE AS w FROM x GROUP BY source, k
), h AS (
  SELECT g.*, t.source_size, t.target, (t.target - 2.0::DOUBLE * coalesce(sum(words) OVER (PARTITION BY g.source ORDER BY w DESC, k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / nullif(sum(w * words) OVER (PARTITION BY g.source ORDER BY w DESC, k DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS c
  FROM g JOIN t ON g.source IS NOT DISTINCT FROM t.source
), i AS (
  SELECT *, arg_max(c, w * 100 + k) FILTER (WHERE c * w <= 2.0::DOUBLE) OVER (PARTITION BY source) AS best FROM h
), e AS (
  SELECT *, coalesce(least(best * w, 2.0::DOUBLE), 2.0::DOUBLE) AS e FROM i
), p AS (
  SELECT *, floor(e) AS sure, e - floor(e) AS p, target - sum(floor(e) * words) OVER (PARTITION BY source) AS goal FROM e
), q AS (
  SELECT x.doc_id, x.size, p.*, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS q FROM x JOIN p ON x.source IS NOT DISTINCT FROM p.source AND x.k = p.k
), r AS (
  SELECT *, coalesce(sum(CASE WHEN p > 0 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY q NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS passed FROM q
)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target,
  CAST((sure + CASE WHEN p > 0 AND passed + size / 2.0::DOUBLE <= goal THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM r
"""


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long")
    counts = [of(i).alias(f"n_{k}") for i, k in enumerate(pii.KINDS[:4])]
    return d.select("doc_id", *counts, F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    rows = common.cut(quality.measured(docs).drop("text"), "measured")
    steps = common.cut(quality.proven(rows, table(spark, sf_dir, "labels")), "steps")
    return quality.judged(rows, steps).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _beyond() -> str:
    """SQL: for each step, whether a rule rejects at it."""
    out = []
    for g in range(quality.STEPS):
        tests = [f"{top} {'>' if sign > 0 else '<'} {low} * {cutoffs[g]!r}::DOUBLE" for top, low, sign, cutoffs in quality.RULES.values()]
        out.append(f"CASE WHEN {' OR '.join(tests)} THEN 1 ELSE 0 END")
    return ", ".join(out)


OP9_SQL = rf"""
WITH t AS (
  SELECT doc_id, lang, coalesce(text, '') AS text FROM documents
), d AS (
  SELECT doc_id, lang, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t
), g AS (
  SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS h FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1))) AS i FROM d)
), r AS (
  SELECT doc_id, count(DISTINCT k) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 5)) AS k FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, h) AS c FROM g) WHERE c > 1) GROUP BY doc_id
), m AS (
  SELECT d.doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, length(regexp_replace(text, '\P{{Lu}}', '', 'g')) AS n_capitals,
    length(regexp_replace(text, '[\p{{L}}\p{{N}}\x20\x09-\x0D]', '', 'g')) AS n_marks,
    len(l) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN r ON d.doc_id = r.doc_id
), b AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, [{_beyond()}] AS hit FROM m
), s AS (
  SELECT *, coalesce(list_position(hit, 1), {quality.STEPS + 1}) AS step FROM b
), q AS (
  SELECT doc_id FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1
), c AS (
  SELECT lang, count(*) AS n, list(step) AS steps FROM s SEMI JOIN q ON s.doc_id = q.doc_id WHERE NOT base_failed GROUP BY lang
), k AS (
  SELECT lang, n, g, len(list_filter(steps, lambda x: x <= g)) AS k, count(*) OVER () / {quality.STEPS} AS strata FROM c, range(1, {quality.STEPS + 1}) AS x(g)
), p AS (
  SELECT lang, g, list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({quality.RISK}) + (n - i) * ln(1 - {quality.RISK})))) <= {quality.ERROR} / strata AS ok FROM k
), z AS (
  SELECT lang, coalesce(min(g) FILTER (WHERE NOT ok), {quality.STEPS + 1}) - 1 AS proven FROM p GROUP BY lang
)
SELECT s.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND step > coalesce(z.proven, 0) AS kept
FROM s LEFT JOIN z ON s.lang IS NOT DISTINCT FROM z.lang
"""


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = langid.fit(docs.filter(~langid.held_out()))
    plain = docs.select("doc_id", langid.held_out().alias("held_out"), "text")
    return langid.identify(plain, net).select("doc_id", "held_out", "lang_pred", "score")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar(table(spark, sf_dir, "documents"), k=4, percent=85).select("doc_id", "n_shingles", "component_id", "n_links")


OP2_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), u AS (
  SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0
), s AS (
  SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 3], ' ')) AS h FROM u
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), c AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY 1, 2
), p AS (
  SELECT c.a, c.b FROM c JOIN n x ON x.doc_id = c.a JOIN n y ON y.doc_id = c.b WHERE 100 * c.k >= 85 * (x.n + y.n - c.k)
), r AS (
  SELECT doc_id AS a, doc_id AS c FROM documents
  UNION SELECT r.a, p.b FROM r JOIN p ON r.c = p.a
)
SELECT r.a AS doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(r.c) AS component_id, CAST(coalesce(any_value(l.l), 0) AS BIGINT) AS n_links
FROM r LEFT JOIN n ON n.doc_id = r.a LEFT JOIN (SELECT a, count(*) AS l FROM p GROUP BY a) l ON l.a = r.a GROUP BY r.a
"""


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.deduplicate(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), s AS (
  SELECT doc_id, w, unnest(range(1, greatest(len(w) - 48, 1))) AS i FROM d
), g AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM s
), m AS (
  SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS least FROM g
), c AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM m WHERE least < doc_id
), p AS (
  SELECT doc_id, generate_subscripts(w, 1) AS k, unnest(w) AS x FROM d
), r AS (
  SELECT p.doc_id, count(c.k) AS n, string_agg(p.x, ' ' ORDER BY p.k) FILTER (WHERE c.k IS NULL) AS kept
  FROM p LEFT JOIN c ON p.doc_id = c.doc_id AND p.k = c.k GROUP BY p.doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(r.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(r.kept, '')) AS kept_sha256
FROM d LEFT JOIN r ON d.doc_id = r.doc_id
"""


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tokens = common.cut(token_files.tokenize(docs, public_tokenizers.path("byte_bpe_50k.json")), "ids")
    manifest = token_files.write(tokens, token_files.new_folder(spark))
    common.discard(tokens)
    return token_files.read(manifest).select("doc_id", "start", "n_tokens", F.crc32("codes").alias("ids_crc32"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    back = bpe.decode(bpe.encode(docs, ranks).drop("text"), ranks)
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_ngram_join": op2_ngram_join,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_token_files": op4_token_files,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_chat_formatting": op6_chat_formatting,
    "op7_mixing": op7_mixing,
    "op8_pii": op8_pii,
    "op9_quality_rules": op9_quality_rules,
    "op10_byte_bpe": op10_byte_bpe,
}
SQL = {"op2_ngram_join": OP2_SQL, "op3_substring_dedup": OP3_SQL, "op5_embedding_dedup": OP5_SQL, "op6_chat_formatting": OP6_SQL, "op7_mixing": OP7_SQL, "op9_quality_rules": OP9_SQL}
