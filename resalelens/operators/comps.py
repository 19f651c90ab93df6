"""Summaries of sold prices.

A popular query may hold a large part of all prices, so no long group of prices is
ever brought together. Rows are counted first per bucket of their query and source.
Where a bucket holds few, its prices are ranked as they are, after one shuffle. The
prices of crowded buckets, and of price lists, are counted once per (query, source, band, price), which
partial aggregation does before the shuffle, and the counts are stored; there are a few
hundred bands. Running sums over the band rows tell in which band a rank lies; only the
prices of that band are then looked at, and being in cents they are few thousand at most
per query for ordinary prices, 100,000 for the dearest band.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from resalelens import settings as S
from resalelens.functions import money
from resalelens.operators.first import first_rows
from resalelens.operators.storage import written

KEYS = ["query", "source"]
BAND = [*KEYS, "band"]
FACTS = ["total", "low", "high", "count"]
BUCKETS = 1 << 18     # of query and source; rows are counted per bucket
CROWDED = 200_000     # rows of a bucket, and so of a group, that one task may rank


def _copies(comps: DataFrame) -> Column:
    return F.sum("copies") if "copies" in comps.columns else F.count(F.lit(1))


def _banded(comps: DataFrame) -> DataFrame:
    """Priced rows with the price cut to its two leading digits; whole dollars below a hundred."""
    width = F
    for digits in range(2, 9):
        width = width.when(F.col("price") < 10 ** digits, 10 ** (digits - 2))
    width = width.otherwise(10 ** 7)
    return comps.filter(F.col("price").isNotNull()).withColumn("band", F.floor(F.col("price") / width) * width)


def _before(n: str, w) -> Column:
    """Running sum of the rows before this one."""
    return F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))


def price_counts(comps: DataFrame) -> DataFrame:
    """Rows per query, source, band and price, stored: bands, ranks and lists come from it."""
    return written(_banded(comps).groupBy(*BAND, "price").agg(_copies(comps).alias("copies")), "price-counts")


def comp_stats(comps: DataFrame) -> DataFrame:
    """Average, upper median, lowest, highest and number of prices per query and source.

    ``comps`` has ``query, source, price`` and may have ``copies``. It is read twice, and
    once more if a bucket is crowded: pass a stored table if it takes long to find.
    """
    bucket = F.pmod(F.xxhash64(*KEYS), F.lit(BUCKETS)).alias("_bucket")
    crowds = written(comps.groupBy(bucket).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > CROWDED).select("_bucket"), "crowds")
    if crowds.isEmpty():
        middle = _ranked_middle(comps)
    else:
        dealt = comps.withColumn("_bucket", bucket)
        middle = _ranked_middle(dealt.join(crowds, "_bucket", "left_anti").drop("_bucket")).unionByName(
            _banded_middle(dealt.join(crowds, "_bucket", "left_semi").drop("_bucket")))
    return middle.select(
        *KEYS,
        money.cents(F.col("total").cast("double") / F.col("count")).alias("avg"),
        money.cents(F.col("price")).alias("median"),
        money.cents(F.col("low")).alias("low"),
        money.cents(F.col("high")).alias("high"),
        F.col("count"),
    )


def _ranked_middle(comps: DataFrame) -> DataFrame:
    """Middle price and facts of groups that are short enough to be sorted in one task."""
    weighted = "copies" in comps.columns
    n = F.col("copies") if weighted else F.lit(1).cast("long")
    exact = F.col("price").cast("decimal(18,4)")
    exact = exact * n.cast("decimal(18,0)") if weighted else exact
    w = Window.partitionBy(*KEYS).orderBy("price")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    middle = F.floor(F.col("count") / 2)
    return (
        comps.filter(F.col("price").isNotNull())
        .select(*KEYS, "price", n.alias("n"), exact.alias("exact"))
        .select(
            *KEYS, "price", "n", _before("n", w).alias("seen"), F.sum("n").over(whole).alias("count"),
            F.sum("exact").over(whole).cast("decimal(38,4)").alias("total"),
            F.min("price").over(whole).alias("low"), F.max("price").over(whole).alias("high"))
        .filter((F.col("seen") <= middle) & (middle < F.col("seen") + F.col("n")))
        .select(*KEYS, "price", *FACTS)
    )


def _banded_middle(comps: DataFrame) -> DataFrame:
    """The same of groups of any length: no row goes further than the first, partial count."""
    counted = price_counts(comps)
    exact = F.col("price").cast("decimal(18,4)") * F.col("copies").cast("decimal(18,0)")
    bands = counted.groupBy(*BAND).agg(
        F.sum("copies").alias("n"),
        F.sum(exact).alias("total"),
        F.min("price").alias("low"),
        F.max("price").alias("high"),
    )
    w = Window.partitionBy(*KEYS).orderBy("band")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    middle = F.floor(F.col("count") / 2)
    targets = (
        bands
        .withColumn("before", _before("n", w))
        .withColumn("count", F.sum("n").over(whole))
        .withColumn("total", F.sum("total").over(whole).cast("decimal(38,4)"))
        .withColumn("low", F.min("low").over(whole))
        .withColumn("high", F.max("high").over(whole))
        .filter((F.col("before") <= middle) & (middle < F.col("before") + F.col("n")))
        .select(*[F.col(c).alias(f"_{c}") for c in BAND], (middle - F.col("before")).alias("rank"), *FACTS)
    )
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in BAND])
    return (
        counted.join(targets, same)
        .select(*KEYS, "price", "rank", *FACTS, F.col("copies").alias("n"))
        .withColumn("seen", _before("n", Window.partitionBy(*KEYS).orderBy("price")))
        .filter((F.col("seen") <= F.col("rank")) & (F.col("rank") < F.col("seen") + F.col("n")))
        .select(*KEYS, "price", *FACTS)
    )


def price_list(comps: DataFrame) -> DataFrame:
    """Sorted prices of each query and source as rows: price, copies, first rank."""
    counted = price_counts(comps)
    steps = counted.withColumn("within", _before("copies", Window.partitionBy(*BAND).orderBy("price")))
    bands = counted.groupBy(*BAND).agg(F.sum("copies").alias("n")).select(
        *BAND, _before("n", Window.partitionBy(*KEYS).orderBy("band")).alias("before"))
    return steps.join(bands, BAND).select(
        *KEYS, "price", "copies", (F.col("before") + F.col("within") + 1).alias("first_rank"))


def market_value(items: DataFrame, prices: DataFrame, sample: int = S.MARKET_SAMPLE) -> DataFrame:
    """Market value of every item from its first ``sample`` sold prices in page order.

    ``items`` has ``item``; ``prices`` has ``item, pos, price``, already in bounds.
    """
    kept = first_rows(prices.filter(F.col("price").isNotNull()), ["item"], ["pos"], sample)
    stats = kept.groupBy("item").agg(
        F.median("price").alias("median"),
        F.min("price").alias("low"),
        F.max("price").alias("high"),
        F.count(F.lit(1)).alias("n"),
    )
    span = F.concat(
        F.lit("$"), money.plain(money.cents(F.col("low"))),
        F.lit("–$"), money.plain(money.cents(F.col("high"))),
    )
    return items.join(stats, "item", "left").select(
        *items.columns,
        F.coalesce(money.cents(F.col("median")), F.lit(0.0)).alias("median_price"),
        F.coalesce(span, F.lit("unknown")).alias("price_range"),
        F.coalesce(F.col("n"), F.lit(0).cast("long")).alias("sample_size"),
        F.lit(S.MARKET_SOURCE).alias("source"),
        F.when(F.col("n").isNull(), S.NO_SALES_NOTE).alias("note"),
    )


def with_comps(listings: DataFrame, stats: DataFrame) -> DataFrame:
    """Attach to each listing the comps of the source it should trust.

    ``listings`` has ``query`` and ``query2``, the terms looked up in the primary
    and in the secondary source. The secondary counts only where the primary has
    fewer than three prices and the secondary has more. ``stats`` is read once per
    source: pass a stored table.
    """
    def side(source: str, key: str, name: str) -> DataFrame:
        return stats.filter(F.col("source") == source).select(
            F.col("query").alias(key),
            F.struct("avg", "median", "low", "high", "count", F.col("query").alias("query"), "source").alias(name),
        )

    joined = (
        listings.join(side(S.PRIMARY_SOURCE, "query", "_c1"), "query", "left")
        .join(side(S.SECONDARY_SOURCE, "query2", "_c2"), "query2", "left")
    )
    n1 = F.coalesce(F.col("_c1.count"), F.lit(0))
    n2 = F.coalesce(F.col("_c2.count"), F.lit(0))
    chosen = F.when((n1 < S.MED_COMPS) & (n2 > n1), F.col("_c2")).otherwise(F.col("_c1"))
    return joined.withColumn("comps", chosen).drop("_c1", "_c2", "query", "query2")
