"""Corpus pipeline: each stage keeps the columns of ``documents`` and works on all rows that
the stage before it kept; the last one adds the token ids.

1. language ID: rows whose text is in no language go; ``lang`` is the language found.
2. line dedup: texts lose the boilerplate lines of their source; copies do not make a
   text boilerplate.
3. MinHash near-dedup: one row of each group of near copies stays (five words, 0.8).
4. decontamination: rows that hold a benchmark item, edited or not, go.
5. BPE: ``ids``, ``n_tokens`` and the ``decoded`` text are added.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir). Nulls, empty
tables, repeated rows and extra columns follow the operators' own rules; a row without
text is rejected by the first stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from resalelens.llm import bpe, decontaminate, language, line_dedup, minhash
from resalelens.llm.queries import VOCABULARY
from resalelens.llm.tables import table
from resalelens.operators.storage import written


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    languages, model = language.train(docs, "text", "lang")
    found = language.identify(docs, "text", languages, model, F.col("lang"), F.col("source"))
    kept = found.filter("accepted")
    return kept.select(*(F.col("language").alias(c) if c == "lang" else F.col(c) for c in docs.columns))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``n_chars`` follows the new text."""
    found = line_dedup.drop_lines(docs, "source", "text", copies_apart=True)
    return found.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one(docs, "doc_id", "text")


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.find_items(docs, table(spark, sf_dir, "benchmark"), "text")
    return found.filter(F.size("matches") == 0).select(*docs.columns)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(docs, "text", public_tokenizers.path(VOCABULARY))


STAGES = [
    ("language ID", language_stage), ("line dedup", line_stage), ("MinHash near-dedup", near_stage),
    ("decontamination", benchmark_stage), ("BPE", encode_stage),
]

# A trained model and alignment scores have no SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
