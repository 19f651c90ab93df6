"""First rows of a group in scan order.

``row_number() <= k`` is planned with a group limit before the shuffle, so each
task sends at most ``k`` rows per key however many copies of a key there are. Spark
does so for small ``k``; for a larger one the same limit is first applied to salted
parts of each group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from resalelens.functions.text import norm_title
from resalelens.operators.storage import written

_RANK, _SALT = "_rank", "_salt"
_PLANNED_LIMIT = 1000   # largest k, exclusive, that Spark limits before the shuffle
_SALTS = 64


def _ranked_within(df: DataFrame, keys: list[str | Column], order: Sequence[str | Column], k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(_RANK, F.row_number().over(w)).filter(F.col(_RANK) <= k).drop(_RANK)


def first_rows(df: DataFrame, keys: Sequence[str | Column], order: Sequence[str | Column], k: int) -> DataFrame:
    """First ``k`` rows of each key; ``order`` decides every tie."""
    if k >= _PLANNED_LIMIT:
        salt = F.pmod(F.xxhash64(*order), F.lit(_SALTS))
        df = _ranked_within(df.withColumn(_SALT, salt), [*keys, _SALT], order, k).drop(_SALT)
    return _ranked_within(df, list(keys), order, k)


def near_first(df: DataFrame, key: str, pos: str, k: int) -> DataFrame:
    """Rows that may be among the first ``k`` of their key by ``pos``, for few keys with long
    lists: ``first_rows`` would sort them all. Nothing that belongs to the first is lost.

    The lowest lead of ``pos`` (its first field) in each bin of a key is that of one row, so
    the ``k``-th of these lowest is a bound that ``k`` rows keep. ``df`` is read twice, and
    the second time only up to the highest bound if every key has one.
    """
    lead, kind = F.col(pos), df.schema[pos].dataType
    while isinstance(kind, T.StructType):
        lead, kind = lead[kind.fields[0].name], kind.fields[0].dataType
    bins = F.pmod(F.xxhash64(lead), F.lit(4 * k))
    lowest = df.groupBy(key, bins.alias(_SALT)).agg(F.min(lead).alias("_low"))
    bounds = written(lowest.groupBy(key).agg(F.get(F.array_sort(F.collect_list("_low")), F.lit(k - 1)).alias("_last")), "bounds")
    if isinstance(kind, T.IntegralType):
        open_keys, last = bounds.agg(F.count_if(F.col("_last").isNull()), F.max("_last")).first()
        if open_keys == 0 and last is not None:
            df = df.filter(lead.isNull() | (lead <= F.lit(last).cast(kind)))
    within = lead.isNull() | F.col("_last").isNull() | (lead <= F.col("_last"))
    return df.join(F.broadcast(bounds), key).filter(within).drop("_last")


def first_per_key(df: DataFrame, key: str = "id", order: Sequence[str | Column] = ("pos",)) -> DataFrame:
    """One row per key: the first in scan order."""
    return first_rows(df, [key], order, 1)


def first_per_title(df: DataFrame, title: str = "title", order: Sequence[str | Column] = ("pos",)) -> DataFrame:
    """One row per normalised title: the first in scan order."""
    return (
        first_rows(df.withColumn("_norm", norm_title(F.col(title))), ["_norm"], order, 1)
        .drop("_norm")
    )


def capped(df: DataFrame, max_rows: int, order: Sequence[str | Column] = ("pos",)) -> DataFrame:
    """First ``max_rows`` rows of the scan."""
    return df.orderBy(*order).limit(max_rows)
