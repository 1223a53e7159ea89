"""Queries of the training-data operators over the tables of a data folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from eventlake.llm import bpe, chat, decontaminate, jaccard, licenses, quality, token_counts, token_files, url_filter, vector_graph

#: Folder of public tokenizer files; every operator takes the file's path as a parameter.
TOKENIZERS = "/opt/tokenizers"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], rows.schema)
    threads = chat.linear_threads(rows.unionByName(extra), "conv_id", "turn", "role", "text")
    return chat.chat_digest(chat.format_chats(threads, "conv_id", "message", "parent", "role", "text"), "conv_id")


OP1_SQL = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, length(role) + length(regexp_replace(role, '[^\\<\[\n]', '', 'g'))
    + length(text) + length(regexp_replace(text, '[^\\<\[]', '', 'g')) + 14 AS chars FROM r)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) + 7 AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


def op2_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_graph.near_duplicate_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label", 0.93)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), "doc_id", "text", f"{TOKENIZERS}/piece_bpe_32k.model")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text")


#: Grade of good documents, and the probability of it that keeps a document.
GOOD_GRADE, GOOD_PROBABILITY = 2, 0.6


def quality_model(documents: DataFrame, labels: DataFrame) -> quality.OrdinalModel:
    """Grades: 0 of low quality, 1 well written but toxic, 2 good."""
    grade = quality.F.expr("CASE WHEN quality = 0 THEN 0 WHEN quality = 1 AND coalesce(toxic, 0) = 1 THEN 1 WHEN quality = 1 THEN 2 END")
    return quality.train(documents, "doc_id", "text", labels.select("doc_id", grade.alias("grade")), "grade")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = quality_model(documents, table(spark, sf_dir, "labels"))
    return quality.score_documents(documents, "doc_id", "text", model, GOOD_GRADE, GOOD_PROBABILITY)


#: The query's own shingles and threshold; elsewhere near copies link at five words and 0.8.
JACCARD = jaccard.Measure(words=3, percent=90)


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_groups(table(spark, sf_dir, "documents"), "doc_id", "text", JACCARD)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.bpe_encode(table(spark, sf_dir, "documents"), "doc_id", "text", f"{TOKENIZERS}/word_bpe_49k.json")
    return bpe.bpe_digest(encoded, "doc_id")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return token_files.token_file_digest(spark, documents, "doc_id", "text", f"{TOKENIZERS}/byte_bpe_50k.json", end_id=0)


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"), "doc_id", "text")


#: Verdict, host and path of the site rules.
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
#: Hosts whose names have one of these words are on the list of hosts to block.
LISTED_WORDS = ("spam", "ads", "track", "casino", "malware", "phish", "pills", "adult", "bets")


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    host, _ = url_filter.split_url(url_filter.F.col("url"))
    named = url_filter.F.rlike(host, url_filter.F.lit(rf"(^|[.-])({'|'.join(LISTED_WORDS)})([.-]|$)"))
    listed = pages.select(host.alias("host")).where(named).distinct()
    return url_filter.judge_urls(pages, "page_id", "url", URL_RULES, listed)


OP10_SQL = rf"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id,
  translate(regexp_extract(rest, '^([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') AS path FROM u),
r AS (SELECT *, CASE
  WHEN host = '' THEN NULL
  WHEN ends_with('.' || host, '.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
  WHEN ends_with('.' || host, '.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
  WHEN ends_with('.' || host, '.net') AND starts_with(path, '/es/') THEN 'net/es/'
  WHEN ends_with('.' || host, '.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
  WHEN ends_with('.' || host, '.com') AND starts_with(path, '/') THEN 'com/' END AS rule,
  regexp_matches(host, '(^|[.-])({'|'.join(LISTED_WORDS)})([.-]|$)') AS listed FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow'
  WHEN rule IS NOT NULL OR listed THEN 'block' ELSE 'allow' END AS verdict, listed FROM r
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat": op1_chat,
    "op2_vectors": op2_vectors,
    "op3_token_counts": op3_token_counts,
    "op4_decontaminate": op4_decontaminate,
    "op5_quality": op5_quality,
    "op6_jaccard": op6_jaccard,
    "op7_bpe": op7_bpe,
    "op9_licenses": op9_licenses,
    "op10_urls": op10_urls,
    "op8_token_files": op8_token_files,
}
ORACLES: dict[str, str] = {
    "op1_chat": OP1_SQL,
    "op10_urls": OP10_SQL,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
