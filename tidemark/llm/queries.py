"""Queries of this subpackage, with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import chat_format, decontaminate, jaccard_join, line_dedup, packing, pii, quality_model, quality_rules, toxicity, url_filter

TOKENIZER = "byte_bpe_50k.json"

#: Stands for the secret that a deployment passes in.
PII_KEY = "example-key"

URL_POLICY = url_filter.UrlPolicy(rules=url_filter.parse_rules(allow=["org/", "com/fr/"], block=["example.org/es/", "example.org/en/1", "com/de/"]))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(_table(spark, sf_dir, "pages"), URL_POLICY).select("page_id", "host", "path", "rule", "verdict")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(_table(spark, sf_dir, "documents")).drop("failed_rule")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack_documents(_table(spark, sf_dir, "documents"), str(tokenizer_path()), with_ids=False)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_model.fit_on(docs, quality_model.graded_ratings(_table(spark, sf_dir, "labels")))
    rated = quality_model.rate_documents(docs, model)
    return rated.select("doc_id", F.col("__tm_expected").alias("expected_grade"), F.col("__tm_tail").alias("tail_probability"), F.col("__tm_kept").alias("kept"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(_table(spark, sf_dir, "documents"), PII_KEY)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit_on(docs, _table(spark, sf_dir, "labels"), learnable=~held_out())
    scored = toxicity.tag_documents(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), F.col("__tm_score").alias("score"), (F.col("__tm_score") >= 0.5).cast("int").alias("predicted"), F.size("__tm_spans").alias("n_spans"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(_table(spark, sf_dir, "documents"))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link_components(_table(spark, sf_dir, "documents"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("\\### Assistant: </turn> ok")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    out = chat_format.digest_chats(chat_format.format_chats(rows.unionByName(probe)))
    return out.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_quality_rules": op2_quality_rules,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_decontamination": op4_decontamination,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_pii": op6_pii,
    "op7_toxicity": op7_toxicity,
    "op8_line_dedup": op8_line_dedup,
    "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
    "op10_chat_format": op10_chat_format,
}


def _url_sql() -> str:
    """Terms without a sign in them stand between borders just where they are a run of letters and digits of the URL."""
    strict, soft = set(URL_POLICY.strict), URL_POLICY.soft
    terms = ", ".join([*(f"('{t}', true, 0.0)" for t in sorted(strict)), *(f"('{t}', false, {w})" for t, w in sorted(soft.items()) if t not in strict)])
    rules = ", ".join(f"('{r.host}', '{r.path}', {str(r.allow).lower()})" for r in URL_POLICY.rules)
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
    WITH r(rh, rp, ok) AS (VALUES {rules}), v(term, strict, weight) AS (VALUES {terms}),
    p AS (SELECT page_id, coalesce(url, '') AS url, CASE WHEN contains(coalesce(url, ''), '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') ELSE '' END AS rest FROM pages),
    q AS (SELECT page_id, {lower.format("url")} AS u, {lower.format("regexp_extract(rest, '^[^/]*')")} AS host, substr(rest, length(regexp_extract(rest, '^[^/]*')) + 1) AS path FROM p),
    m AS (SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(ok, length(rh || rp)) AS ok
          FROM q JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id),
    w AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(u, '[a-z0-9]+')) AS term FROM q),
    h AS (SELECT page_id, bool_or(strict) OR (count(*) >= {URL_POLICY.min_soft} AND sum(weight) >= {URL_POLICY.soft_threshold}) AS bad FROM w JOIN v USING (term) GROUP BY page_id)
    SELECT q.page_id, host, path, rule, CASE WHEN rule IS NOT NULL THEN CASE WHEN ok THEN 'allow' ELSE 'block' END WHEN coalesce(bad, false) THEN 'block' ELSE 'allow' END AS verdict
    FROM q LEFT JOIN m ON q.page_id = m.page_id LEFT JOIN h ON q.page_id = h.page_id
    """


_WORDS_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_RULES_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, {_WORDS_SQL} AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
win AS (SELECT rid, i, array_to_string(w[i:i + 7], ' ') AS k FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS n FROM win) WHERE n >= 2),
cov AS (SELECT rid, count(DISTINCT i + j) AS n FROM rep, range(0, 8) AS o(j) GROUP BY rid),
f AS (SELECT doc_id, t, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
             coalesce(cov.n, 0)::BIGINT AS n_repeat_words, len(l) AS n_full_lines,
             length(regexp_replace(t, '[^\p{{L}}]', '', 'g')) AS letters, length(regexp_replace(t, '[^\p{{Lu}}]', '', 'g')) AS capitals
      FROM d LEFT JOIN cov ON d.rid = cov.rid),
g AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words
            OR 2 * n_dup_lines > n_full_lines OR 20 * length(regexp_replace(t, '[^!]', '', 'g')) > 3 * n_words
            OR 2 * length(regexp_replace(t, '[^0-9]', '', 'g')) > word_chars OR 2 * capitals > letters OR 2 * letters < word_chars
            OR 20 * len(regexp_extract_all(t, '(?:\.\.\.|…)\s*(?:\n|$)')) > 7 * n_full_lines) AS kept
FROM g
"""

_LINES_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
x AS (SELECT rid, doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM x),
r AS (SELECT key, max(doc_id) AS keep FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
y AS (SELECT k.rid, k.doc_id, pos, line, coalesce(k.doc_id < keep, false) AS gone FROM k LEFT JOIN r ON k.key = r.key)
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM y GROUP BY rid
"""

_CHAT_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
e AS (SELECT *, length(regexp_replace(text, '(###|</turn>|\\)', '\\\1', 'g')) + 9
                + CASE role WHEN 'system' THEN 12 WHEN 'user' THEN 10 WHEN 'assistant' THEN 15
                       ELSE 8 + length(regexp_replace(role, '(###|</turn>|\\|\])', '\\\1', 'g')) END AS chars FROM c)
SELECT conv_id::BIGINT AS conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

_JACCARD_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT rid, doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS k
      FROM (SELECT rid, doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
p AS (SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.k = b.k AND a.rid < b.rid JOIN n na ON na.rid = a.rid JOIN n nb ON nb.rid = b.rid
      GROUP BY a.rid, b.rid, a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 75 * (na.n + nb.n - count(*))),
e AS (SELECT x, y FROM p UNION SELECT y, x FROM p),
r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id FROM d LEFT JOIN n ON n.rid = d.rid LEFT JOIN c ON c.x = d.doc_id
"""

SQL: dict[str, str] = {
    "op1_url_filter": _url_sql(),
    "op2_quality_rules": _RULES_SQL,
    "op8_line_dedup": _LINES_SQL,
    "op9_ngram_jaccard_join": _JACCARD_SQL,
    "op10_chat_format": _CHAT_SQL,
}
