"""Queries that apply each operator to its whole table, and their SQL where it exists."""

from __future__ import annotations

import re
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from resalelens.llm import (
    bpe, conversation_repair, decontaminate, embedding_dedup, language, line_dedup, minhash, mixing, ngram_lm,
    suffix_dedup, token_files, url_rules, vector_codes,
)
from resalelens.llm.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
VOCABULARY = "word_bpe_49k.json"


def query(sql: str | None = None):
    """Register a function under its own name."""
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn
    return add


@query()
def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode_decode(docs, "text", public_tokenizers.path(VOCABULARY))
    return coded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


@query()
def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    read = token_files.through_files(docs, public_tokenizers.path(VOCABULARY))
    return read.select("doc_id", "start", "n_tokens", token_files.checksum("ids").alias("ids_crc32"))


_TRIMMED = "trim({}, ' ' || chr(9) || chr(13))"

LINES_SQL = f"""
WITH lines AS (
  SELECT source, unnest(list_distinct(list_filter(
    list_transform(string_split(text, chr(10)), lambda x: {_TRIMMED.format('x')}), lambda x: x <> ''))) AS line
  FROM documents WHERE text IS NOT NULL),
counts AS (SELECT source, line, count(*) AS n FROM lines GROUP BY ALL HAVING count(*) >= {line_dedup.MIN_PAGES}),
totals AS (SELECT source, count(*) AS pages FROM documents GROUP BY ALL),
bad AS (
  SELECT c.source, list(line) AS drop FROM counts c JOIN totals t ON c.source IS NOT DISTINCT FROM t.source
  WHERE n > pages * {line_dedup.RATIO}::DOUBLE GROUP BY ALL),
kept AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS before,
    list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(coalesce(drop, []), {_TRIMMED.format('x')})) AS after
  FROM documents d LEFT JOIN bad b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE coalesce(array_to_string(after, chr(10)), '') END AS text,
  coalesce(len(before), 0) AS n_lines, coalesce(len(before) - len(after), 0) AS n_dropped
FROM kept"""


@query(LINES_SQL)
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_dedup.drop_lines(docs).select("doc_id", "text", "n_lines", "n_dropped")


def _glob_regex(glob: str) -> str:
    return "".join({"*": ".*", "@": "[^/?]*"}.get(ch, re.escape(ch)) for ch in glob).replace("'", "''")


def _urls_sql() -> str:
    fits = "(host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '{1}')"
    ranked = sorted(url_rules.HOST_RULES, key=lambda r: -len(r.name))
    rule = " ".join(f"WHEN {fits.format(r.host, r.path)} THEN '{r.name}'" for r in ranked)
    own = " ".join(f"WHEN '{r.name}' THEN '{r.verdict}'" for r in ranked)
    full = "regexp_full_match(subject, '{}', 's')"
    allow = " OR ".join(full.format(_glob_regex(r.glob)) for r in url_rules.GLOB_RULES if r.verdict == "allow")
    block = " ".join(
        f"WHEN {full.format(_glob_regex(r.glob))} THEN '{r.glob}'" for r in url_rules.GLOB_RULES if r.verdict == "block")
    return f"""
WITH parts AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), '{url_rules.UPPER}', '{url_rules.LOWER}') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*[^?#]*(\\?[^#]*)', 1, 's'), '') AS query
  FROM pages),
ruled AS (SELECT *, '.' || host || path || query AS subject, CASE {rule} END AS rule FROM parts),
judged AS (SELECT *, CASE WHEN rule IS NOT NULL OR {allow} THEN NULL {block} END AS pattern FROM ruled)
SELECT page_id, host, path, rule,
  CASE rule {own} ELSE CASE WHEN pattern IS NULL THEN 'allow' ELSE 'block' END END AS verdict, pattern
FROM judged"""


@query(_urls_sql())
def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_rules.judge_urls(pages).select("page_id", "host", "path", "rule", "verdict", "pattern")


@query()
def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return minhash.near_duplicates(docs, width=3, percent=85).select("doc_id", "n_shingles", "component_id", "kept")


@query()
def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return embedding_dedup.near_vectors(vectors).select("vec_id", "n_links", "component_id", "kept")


@query()
def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    languages, model = language.train(docs, "text", "lang")
    found = language.identify(docs, "text", languages, model, F.col("lang"), F.col("source"))
    return found.select("doc_id", "language", F.round("confidence", 6).alias("confidence"), F.col("accepted").alias("kept"))


@query()
def page_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same evidence where all of it exists: raw pages with markup and addresses."""
    docs = table(spark, sf_dir, "documents").select("text", "lang")
    languages, model = language.train(docs, "text", "lang")
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    plain = F.regexp_replace("html", r"(?s)<(script|style)\b.*?</\1>|<!--.*?-->|<[^>]*>", " ")
    declared = F.lower(F.regexp_extract("html", r"(?i)<html[^>]*\blang=[\"']?([a-z]+)", 1))
    ready = pages.select("page_id", plain.alias("text"), declared.alias("declared"), url_rules.url_parts(F.col("url"))[0].alias("host"))
    found = language.identify(ready, "text", languages, model, F.col("declared"), F.col("host"))
    return found.select("page_id", "host", "declared", "language", F.round("confidence", 6).alias("confidence"), "accepted")


@query()
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_items(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("matches").alias("_m")).select("doc_id", "_m.*")


@query()
def op7_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", ngram_lm.held_out(F.col("doc_id")))
    scored = ngram_lm.score_texts(docs, docs.filter("NOT held_out"))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query()
def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = suffix_dedup.drop_repeats(docs)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query()
def op11_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = mixing.mix(docs, mixing.weights_in_turn(docs))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies")


@query()
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    coded, codebooks = vector_codes.encode(vectors)
    return vector_codes.with_label_error(coded).select(
        "vec_id", "code", "error", "label_error", F.lit(vector_codes.checksum(codebooks)).alias("codebooks_sha256"))


@query()
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    repair = conversation_repair.Repair(conversation_repair.damaged(rows))
    same = F.col("_of").eqNullSafe(F.col("conv_id"))
    found = rows.select(F.col("conv_id").alias("_of")).distinct().join(repair.conversations, same, "left").drop("conv_id")
    found = found.withColumnRenamed("_of", "conv_id").join(repair.digests().withColumnRenamed("conv_id", "_of"), same, "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select(
        "conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
