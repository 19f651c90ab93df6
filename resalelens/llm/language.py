"""Language of texts by fusing evidence the Bayesian way.

The posterior of a language is the product of

- the likelihood of the text's byte trigrams, hashed to ``BUCKETS`` counts per language;
  trigrams with digits, punctuation or control characters tell no language and are left out;
  overlapping trigrams are not independent, so a text counts as ``EFFECTIVE`` of them at
  most, by their mean and never by a prefix of the text;
- the chance that a page of this language declares what it declares in its markup;
- the chance that its address ends as it does, by a table of country suffixes;
- a prior of its host, smoothed towards the prior of the host's suffix, which in turn is
  smoothed towards that of all pages. These priors are sums of the posteriors without a
  prior, grouped by suffix and host with partial aggregation; a host of any size is one
  row per task before the shuffle.

One more class, ``und``, draws trigrams uniformly: text that no language explains better
than chance. Rows of that class, and texts without any letter, are not accepted.

Trigram counts are fitted on all labelled rows, so a language of any share has a model;
equal texts of one label are counted once there, so a group of copies does not outweigh
the rest. Everything else covers all rows, and repeated rows count each. Missing evidence
is neutral. Rows without a host share one prior.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F, types as T

from resalelens.llm.tables import at_work, bounded_batches
from resalelens.operators.storage import written

BUCKETS = 1 << 14
EFFECTIVE = 100
DECLARED_TRUST = 0.9
SUFFIX_TRUST = 0.8
HOST_WEIGHT, SUFFIX_WEIGHT, ALL_WEIGHT = 20.0, 50.0, 100.0
NONE = "und"
# Country suffixes that tell a language.
LETTERS = np.array([b >= 128 or b == 32 or 97 <= b <= 122 for b in range(256)])
SUFFIXES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "au": "en", "ie": "en"}


def buckets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Trigram buckets of all texts, one after the other, and how many each text has."""
    raw = [(t or "").encode().lower() for t in texts]
    size = np.array([len(r) for r in raw], np.int64)
    flat = np.frombuffer(b"".join(raw), np.uint8)
    if len(flat) < 3:
        return np.zeros(0, np.int64), np.zeros(len(raw), np.int64)
    owner = np.repeat(np.arange(len(raw), dtype=np.int32), size)
    good = LETTERS[flat] & (flat != 32)
    # Of the three bytes all must be letters or blanks of one text, and one a letter.
    fits = LETTERS[flat[:-2]] & LETTERS[flat[1:-1]] & LETTERS[flat[2:]] & (owner[:-2] == owner[2:])
    fits &= good[:-2] | good[1:-1] | good[2:]
    wide = flat.astype(np.uint32)
    code = (wide[:-2] << np.uint32(16) | wide[1:-1] << np.uint32(8) | wide[2:])[fits]
    return ((code * np.uint32(2654435761)) >> np.uint32(18)).astype(np.int64), np.bincount(owner[:-2][fits], minlength=len(raw))


COUNTED = "language string, bucket int, n long"


def train(labelled: DataFrame, text: str, label: str) -> tuple[list[str], np.ndarray]:
    """Languages and their log trigram probabilities, with the uniform class last."""
    bounded_batches(labelled.sparkSession)
    known = labelled.filter(F.col(label).isNotNull() & F.col(text).isNotNull())
    known = known.select(F.col(label).alias("language"), F.col(text).alias("text"))
    page = F.xxhash64("text")
    # Only texts with copies are shuffled, one of each text per task.
    several = written(
        known.groupBy("language", page.alias("_page")).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
        .select(F.col("language").alias("_of"), "_page"), "copied-texts")
    marked = known.join(several, (F.col("language") == F.col("_of")) & (page == F.col("_page")), "left")
    single = marked.filter("_page IS NULL").select("language", "text")
    copied = marked.filter("_page IS NOT NULL").groupBy("language", "_page").agg(F.any_value("text").alias("text"))

    def count(batches):
        at_work("language")
        for batch in batches:
            labels = np.array(batch.column(0).to_pylist(), object)
            for language in sorted(set(labels)):
                code, _ = buckets([t for t, x in zip(batch.column(1).to_pylist(), labels) if x == language])
                found = np.bincount(code, minlength=BUCKETS)
                hit = np.flatnonzero(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([language] * len(hit), pa.string()), pa.array(hit.astype(np.int32)), pa.array(found[hit])],
                    names=["language", "bucket", "n"])

    # As many rows as languages x buckets at most.
    counted = single.union(copied.select("language", "text")).mapInArrow(count, COUNTED)
    table = counted.groupBy("language", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(table["language"].unique())
    counts = np.zeros((len(languages) + 1, BUCKETS))
    for i, language in enumerate(languages):
        own = table[table["language"] == language]
        counts[i, own["bucket"]] = own["n"]
    counts[:-1] += 0.5 * counts[:-1].sum(axis=1, keepdims=True) / (BUCKETS * 10) + 1e-3
    counts[-1] = 1
    return [*languages, NONE], np.log(counts / counts.sum(axis=1, keepdims=True))


def evidence(languages: list[str], model: Broadcast[np.ndarray]):
    """Column function of text, declared language and suffix: log posterior without prior."""
    place = {x: i for i, x in enumerate(languages)}
    others = max(1, len(languages) - 1)

    def fused(row: np.ndarray, told: str | None, trust: float) -> None:
        if told in place:
            row += math.log((1 - trust) / others)
            row[place[told]] += math.log(trust) - math.log((1 - trust) / others)

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def weigh(texts: pa.Array, declared: pa.Array, suffixes: pa.Array) -> pa.Array:
        at_work("language")
        code, count = buckets(texts.to_pylist())
        start = (np.cumsum(count) - count)[count > 0]
        out = np.zeros((len(count), len(languages)))
        for i, logs in enumerate(model.value.astype(np.float32)):
            if len(start):
                total = np.add.reduceat(logs[code], start, dtype=np.float64)
                out[count > 0, i] = total / count[count > 0] * np.minimum(count[count > 0], EFFECTIVE)
        for row, told, suffix in zip(out, declared.to_pylist(), suffixes.to_pylist()):
            fused(row, told, DECLARED_TRUST)
            fused(row, SUFFIXES.get(suffix or ""), SUFFIX_TRUST)
        out -= out.max(axis=1, keepdims=True, initial=-np.inf) if out.size else 0
        out -= np.log(np.exp(out).sum(axis=1, keepdims=True)) if out.size else 0
        return pa.array(out.tolist(), pa.list_(pa.float64()))
    return weigh


def suffix_of(host: Column) -> Column:
    """Last label of a host name, null if it has no dot."""
    return F.nullif(F.regexp_extract(host, r"\.([^.:]+)(:\d*)?$", 1), F.lit(""))


def host_priors(weighed: DataFrame, classes: int) -> DataFrame:
    """Log prior of each class per host, from the posteriors without a prior."""
    sums = [F.sum(F.exp(F.col("__lid_log")[i])).alias(f"_s{i}") for i in range(classes)]
    hosts = written(weighed.groupBy("__lid_of", "_suffix").agg(*sums), "host-sums")
    again = [F.sum(f"_s{i}").alias(f"_u{i}") for i in range(classes)]
    total = hosts.agg(*again).first()
    mass = sum(x or 0 for x in total) + ALL_WEIGHT
    overall = [((x or 0) + ALL_WEIGHT / classes) / mass for x in total]
    by_suffix = hosts.groupBy(F.col("_suffix").alias("_sx")).agg(*again)

    def smoothed(names: list[str], parent: list[Column], weight: float) -> list[Column]:
        whole = sum((F.col(n) for n in names), F.lit(0.0)) + weight
        return [(F.col(n) + p * weight) / whole for n, p in zip(names, parent)]

    upper = smoothed([f"_u{i}" for i in range(classes)], [F.lit(x) for x in overall], SUFFIX_WEIGHT)
    joined = hosts.join(by_suffix, F.col("_suffix").eqNullSafe(F.col("_sx")))
    lower = smoothed([f"_s{i}" for i in range(classes)], upper, HOST_WEIGHT)
    return joined.select(F.col("__lid_of").alias("__lid_host"), F.array(*[F.log(p) for p in lower]).alias("__lid_prior"))


def identify(
    pages: DataFrame, text: str, languages: list[str], model: np.ndarray,
    declared: Column | None = None, host: Column | None = None,
) -> DataFrame:
    """All rows and columns with ``language``, ``confidence`` and ``accepted`` added or
    replaced."""
    spark = pages.sparkSession
    bounded_batches(spark)
    nothing = F.lit(None).cast("string")
    declared, host = (nothing if c is None else c for c in (declared, host))
    weigh = evidence(languages, spark.sparkContext.broadcast(model))
    log = weigh(F.col(text), declared.cast("string"), suffix_of(host))
    seen = pages.select(host.alias("__lid_of"), suffix_of(host).alias("_suffix"), log.alias("__lid_log"))
    priors = written(host_priors(seen, len(languages)), "host-priors")
    known = pages.withColumns({"__lid_of": host, "__lid_log": log}).join(priors, F.col("__lid_of").eqNullSafe(F.col("__lid_host")), "left")
    # Fused weights before they are made to sum to one; the largest is one.
    fused = F.zip_with("__lid_log", "__lid_prior", lambda a, b: a + b)
    known = known.withColumn("__lid_fused", fused).withColumn("__lid_best", F.array_max("__lid_fused"))
    mass = F.aggregate("__lid_fused", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("__lid_best")))
    named = F.array(*map(F.lit, languages))
    best = F.element_at(named, F.array_position("__lid_fused", F.col("__lid_best")).cast("int"))
    wordless = ~F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    return (
        known.withColumn("language", F.when(wordless, NONE).otherwise(best))
        .withColumn("confidence", F.when(wordless, 1.0).otherwise(1.0 / mass))
        .withColumn("accepted", F.col("language") != NONE)
        .drop("__lid_of", "__lid_log", "__lid_host", "__lid_prior", "__lid_fused", "__lid_best")
    )
