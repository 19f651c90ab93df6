"""Mix sources to target weights by entropy balancing.

The size of a document is its number of words. Groups (sources) share the whole size of the
table by their weights; the target of a group stops at ``cap`` times its own size and the
excess is shared by the others, by weight. Among all rates of documents, at most ``cap``
each, whose words add up to the targets, those closest to "every document once" in relative
entropy are ``min(cap, exp(dual * size))``, with one dual value per group: the solution of a
convex problem that Newton's method finds, kept inside a shrinking bracket.

Rates depend on group and size alone, so documents are counted per (group, size) once, and
each Newton step is a grouped sum over those counts. Sums are decimals, so they do not
depend on the order of rows and reruns agree.

Rates become whole copies in three steps, all of them exact sums or windows over counts:
within a band of sizes (powers of two) the running number of copies is rounded, what a band
leaves over is carried to the next smaller band and settled by copies of its roomiest size,
and the copies of a size go to its documents evenly, those with the smallest hash of their
key getting one more. Where a single copy of a size is over ``COARSE`` of the target, those
sizes are rounded first and the others are balanced anew towards what is left. The hash is found without ranking all documents of a size: they are
counted in ``sqrt(n)`` ranges of the hash, and only the range that holds the border is
looked at. A group's words come as near to its target as its smaller sizes allow, from none
to ``cap`` copies of them all.

Only DataFrame functions are used, and texts are never shuffled. A group's rows in a window
are its distinct sizes, at most the square root of twice its words; a carry runs over at
most 63 bands.

Null and blank texts have size 0 and take part with one copy and no words. Documents with
equal keys (null is a key) get equal numbers of copies. A null group is a group. Groups
without a weight take nothing. Empty tables give no rows. Columns of ``docs`` that are
named like the result's are replaced.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from resalelens.operators.ranking import numbered
from resalelens.operators.storage import written

WORD = r"[^\x20\x09-\x0D]+"
CAP = 3
#: Relative distance from a target at which a dual value is settled, and a limit of steps
#: that halving alone stays below.
CLOSE = 1e-9
STEPS = 300
#: Share of a target above which one copy is too much for the carry to settle.
COARSE = 0.02
RESULT = ["size", "source_size", "target", "rate", "copies", "taken"]


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _exact(value: Column) -> Column:
    """A sum that does not depend on the order of rows."""
    return F.sum(value.cast("decimal(36,12)")).cast("double")


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def weights_in_turn(docs: DataFrame, group: str = "source", turn: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """``group, weight``: weights repeat over the groups in code point order, null last."""
    groups = docs.select(group).distinct()
    of_place = F.element_at(F.array(*map(F.lit, turn)), (F.pmod(F.col("_place_of") - 1, F.lit(len(turn))) + 1).cast("int"))
    return numbered(groups, [F.col(group).asc_nulls_last()], "_place_of").select(group, of_place.alias("weight"))


def targets(groups: DataFrame, cap: int = CAP) -> DataFrame:
    """``groups`` (``g, words, weight``) with ``target``: the level of words per weight rises
    until all words are shared; a group whose cap it reaches stays there."""
    full = lambda level: F.col("weight") * F.lit(level) > F.col("words") * F.lit(cap)
    total = groups.agg(F.sum("words")).first()[0] or 0
    level, stopped = 0.0, -1
    while True:
        row = groups.agg(
            F.sum(F.when(full(level), 0).otherwise(F.col("weight"))).alias("open"),
            F.sum(F.when(full(level), F.col("words") * cap).otherwise(0)).alias("held"),
            F.sum(full(level).cast("long")).alias("stopped")).first()
        if not row.open or row.stopped == stopped:
            break
        level, stopped = (total - row.held) / row.open, row.stopped
    reached = F.when(full(level), (F.col("words") * cap).cast("double")).otherwise(F.col("weight") * F.lit(level))
    return groups.withColumn("target", F.coalesce(reached, F.lit(0.0)))


def _rate(cap: int) -> Column:
    return F.exp(F.least(F.col("dual") * F.col("x"), F.lit(math.log(cap))))


def duals(sizes: DataFrame, groups: DataFrame, cap: int = CAP) -> DataFrame:
    """``g, mean, dual`` of each group with words and a target. ``x``, the size over the
    group's mean size, keeps the exponents in range."""
    at_cap = F.col("target") >= F.col("words") * F.lit(cap * (1 - 1e-12))
    mean = F.col("words") / F.col("docs")
    most, wanted = F.lit(math.log(cap)) / (F.col("smallest") / mean), F.col("target") / mean
    state = written(
        groups.filter("words > 0 AND target > 0").select(
            F.col("g").alias("of"), mean.alias("mean"), wanted.alias("wanted"),
            F.when(at_cap, most).otherwise(0.0).alias("dual"),
            # x * exp(-y x) is at most 1 / (e y), so this dual takes less than is wanted.
            (-F.col("docs") / (F.lit(math.e) * wanted)).alias("low"), most.alias("high"), at_cap.alias("settled")), "duals")
    for _ in range(STEPS):
        if state.filter("NOT settled").isEmpty():
            break
        state = written(_newton(sizes, state, cap), "duals")
    return state.select(F.col("of").alias("g"), "mean", "dual")


def _newton(sizes: DataFrame, state: DataFrame, cap: int) -> DataFrame:
    """One step for all groups: the words at the present dual values and how they grow."""
    taken = F.col("n") * _rate(cap) * F.col("x")
    inside = F.col("dual") * F.col("x") < F.lit(math.log(cap))
    sums = (
        sizes.join(state, _same("g", "of")).withColumn("x", F.col("size") / F.col("mean"))
        .groupBy(*state.columns).agg(_exact(taken).alias("_now"), _exact(F.when(inside, taken * F.col("x")).otherwise(0)).alias("_slope")))
    miss = F.ln("wanted") - F.ln("_now")
    short = F.col("_now") < F.col("wanted")
    low, high = F.when(short, F.col("dual")).otherwise(F.col("low")), F.when(short, F.col("high")).otherwise(F.col("dual"))
    step = F.col("dual") + F.when(F.col("_slope") > 0, miss * F.col("_now") / F.col("_slope"))
    settled = F.coalesce(F.abs(miss) <= CLOSE, F.lit(False)) | (high - low <= F.abs(F.col("dual")) * 1e-14)
    moved = F.when((step > low) & (step < high), step).otherwise((low + high) / 2)
    keep = F.col("settled") | settled
    return sums.select(
        "of", "mean", "wanted", F.when(keep, F.col("dual")).otherwise(moved).alias("dual"), low.alias("low"), high.alias("high"), keep.alias("settled"))


def copies_by_size(rated: DataFrame, cap: int = CAP) -> DataFrame:
    """Copies ``k`` of all documents of each size of each group; ``rated`` is ``g, size, n, rate``."""
    band = F.length(F.bin("size"))
    in_band = Window.partitionBy("g", "band").orderBy(F.col("size").desc())
    running = F.floor(F.sum(F.col("n") * F.col("rate")).over(in_band.rowsBetween(Window.unboundedPreceding, 0)) + 0.5)
    most = F.col("n") * cap
    rounded = written(
        rated.withColumn("band", band).withColumn("_run", running)
        .withColumn("k", F.least(most, F.greatest(F.lit(0), F.col("_run") - F.lag("_run", 1, 0).over(in_band))).cast("long")).drop("_run"), "rounded")
    room = F.struct(F.least(F.col("k"), most - F.col("k")).alias("room"), "size", "k", "n")
    bands = rounded.groupBy("g", "band").agg(
        _exact((F.col("n") * F.col("rate") - F.col("k")) * F.col("size")).alias("left"), F.max(room).alias("at"))
    kind = "struct<carry:double,moves:array<struct<size:bigint,move:bigint>>>"
    start = F.struct(F.lit(0.0).alias("carry"), F.array().alias("moves")).cast(kind)

    def settle(acc: Column, b: Column) -> Column:
        due, at = acc["carry"] + b["left"], b["at"]
        move = F.greatest(-at["k"], F.least(at["n"] * cap - at["k"], F.round(due / at["size"]).cast("long")))
        moves = F.concat(acc["moves"], F.array(F.struct(at["size"].alias("size"), move.alias("move"))))
        return F.struct((due - move * at["size"]).alias("carry"), moves.alias("moves")).cast(kind)

    carried = bands.groupBy("g").agg(F.sort_array(F.collect_list(F.struct((-F.col("band")).alias("down"), "left", "at"))).alias("all"))
    moves = carried.select("g", F.explode(F.aggregate("all", start, settle)["moves"]).alias("m")).select(
        F.col("g").alias("_of"), F.col("m.size").alias("_size"), F.col("m.move").alias("_move"))
    return rounded.join(moves, _same("g", "_of") & (F.col("size") == F.col("_size")), "left").select(
        "g", "size", "n", (F.col("k") + F.coalesce("_move", F.lit(0))).alias("k"))


def _rated(sizes: DataFrame, solved: DataFrame, cap: int) -> DataFrame:
    """``sizes`` with its columns and ``rate``, 0 for groups without a dual value."""
    solved = solved.select(F.col("g").alias("_of"), "mean", "dual")
    return sizes.join(solved, _same("g", "_of"), "left").withColumn("x", F.col("size") / F.col("mean")).select(
        *sizes.columns, F.when(F.col("dual").isNull(), 0.0).otherwise(_rate(cap)).alias("rate"))


def whole_copies(rated: DataFrame, groups: DataFrame, cap: int = CAP) -> DataFrame:
    """``g, size, n, k``: copies of all documents of each size, coarse sizes first."""
    goal = groups.select(F.col("g").alias("_of"), "target")
    marked = written(
        rated.join(goal, _same("g", "_of")).withColumn("coarse", F.col("size") > F.col("target") * COARSE).drop("_of"), "rated")
    coarse = marked.filter("coarse")
    if coarse.isEmpty():
        return copies_by_size(marked.select("g", "size", "n", "rate"), cap)
    large = written(copies_by_size(coarse.select("g", "size", "n", "rate"), cap), "coarse")
    held = large.groupBy(F.col("g").alias("_of")).agg(F.sum(F.col("k") * F.col("size")).alias("held"))
    small = marked.filter("NOT coarse").join(held, _same("g", "_of"), "left").drop("_of")
    again = small.filter("held IS NOT NULL").groupBy("g", "target", "held").agg(
        F.sum(F.col("size") * F.col("n")).alias("words"), F.sum("n").alias("docs"), F.min("size").alias("smallest"))
    rest = again.withColumn("target", F.greatest(F.lit(0.0), F.least(F.col("target") - F.col("held"), (F.col("words") * cap).cast("double"))))
    sizes = written(small.filter("held IS NOT NULL").select("g", "size", "n"), "size-counts")
    balanced = _rated(sizes, duals(sizes, written(rest, "groups"), cap), cap)
    fine = small.filter("held IS NULL").select("g", "size", "n", "rate").unionByName(balanced)
    return copies_by_size(fine, cap).unionByName(large)


def borders(keys: DataFrame, classes: DataFrame) -> DataFrame:
    """``g, size, border`` of each class (``g, size, n, extra``) with ``extra`` documents to
    single out: those whose ``key`` (not negative) is at most ``border``."""
    split = classes.filter("extra > 0").select(
        F.col("g").alias("_of"), F.col("size").alias("_size"), "extra", F.ceil(F.sqrt("n")).alias("ranges"))
    dealt = written(
        keys.join(split, _same("g", "_of") & (F.col("size") == F.col("_size"))).select(
            "g", "size", "key", "extra", F.least(F.floor(F.col("key") / F.lit(2.0 ** 63) * F.col("ranges")), F.col("ranges") - 1).alias("range")), "dealt")
    counted = dealt.groupBy("g", "size", "range", "extra").agg(F.count(F.lit(1)).alias("n"))
    earlier = F.coalesce(F.sum("n").over(
        Window.partitionBy("g", "size").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    split_range = counted.withColumn("_before", earlier).filter("_before < extra AND extra <= _before + n").select(
        F.col("g").alias("_of"), F.col("size").alias("_size"), F.col("range").alias("_range"), (F.col("extra") - F.col("_before")).alias("rest"))
    same = _same("g", "_of") & (F.col("size") == F.col("_size")) & (F.col("range") == F.col("_range"))
    near = dealt.join(split_range, same).groupBy("g", "size", "rest", "key").agg(F.count(F.lit(1)).alias("n"))
    passed = F.coalesce(F.sum("n").over(
        Window.partitionBy("g", "size").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    nearer = F.col("_passed") + F.col("n") - F.col("rest") <= F.col("rest") - F.col("_passed")
    return near.withColumn("_passed", passed).filter("_passed < rest AND rest <= _passed + n").select(
        "g", "size", (F.col("key") - F.when(nearer | (F.col("n") == 1), 0).otherwise(1)).alias("border"))


def mix(
    docs: DataFrame, weights: DataFrame, group: str = "source", text: str = "text", key: str = "doc_id", cap: int = CAP,
) -> DataFrame:
    """``docs`` with its size in words, its group's ``source_size`` and ``target``, its ``rate``,
    whole ``copies`` and the words ``taken``. ``weights`` has ``group`` and ``weight``."""
    place = F.shiftrightunsigned(F.xxhash64(key), 1)
    keys = written(docs.select(F.col(group).alias("g"), n_words(F.col(text)).alias("size"), place.alias("key")), "sizes")
    counts = written(keys.groupBy("g", "size").agg(F.count(F.lit(1)).alias("n")), "size-counts")
    solid = counts.filter("size > 0")
    shared = weights.select(F.col(group).alias("_of"), F.col("weight").cast("double").alias("weight"))
    words = counts.groupBy("g").agg(
        F.sum(F.col("size") * F.col("n")).alias("words"), F.sum(F.when(F.col("size") > 0, F.col("n")).otherwise(0)).alias("docs"),
        F.min(F.when(F.col("size") > 0, F.col("size"))).alias("smallest"))
    groups = words.join(shared, _same("g", "_of"), "left").select("g", "words", "docs", "smallest", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    groups = written(targets(written(groups, "groups"), cap), "targets")

    rated = written(_rated(solid, duals(solid, groups, cap), cap), "rates")
    base = F.expr("k div n")
    classes = written(
        whole_copies(rated, groups, cap).select("*", base.alias("base"), (F.col("k") - base * F.col("n")).alias("extra")), "copies")
    last = borders(keys, classes).select(F.col("g").alias("_of"), F.col("size").alias("_size"), "border")
    same = _same("g", "_of") & (F.col("size") == F.col("_size"))
    known = classes.join(last, same, "left").select("g", "size", "base", "border")
    rates = rated.select(F.col("g").alias("_of"), F.col("size").alias("_size"), "rate")
    known = known.join(rates, same).select("g", "size", "rate", "base", "border")
    blank = counts.filter("size = 0").select("g", "size", F.lit(1.0).alias("rate"), F.lit(1).cast("long").alias("base"), F.lit(None).cast("long").alias("border"))
    sources = groups.select(F.col("g").alias("_of"), "words", "target")
    facts = written(known.unionByName(blank).join(sources, _same("g", "_of")).drop("_of"), "mix")
    facts = reduce(lambda df, c: df.withColumnRenamed(c, f"__mix_{c}"), facts.columns, facts)

    own = docs.drop(*RESULT).withColumn("__mix_words_of", n_words(F.col(text))).withColumn("__mix_key", place)
    joined = own.join(facts, F.col(group).eqNullSafe(F.col("__mix_g")) & (F.col("__mix_words_of") == F.col("__mix_size")), "left")
    copies = F.col("__mix_base") + F.coalesce((F.col("__mix_key") <= F.col("__mix_border")).cast("long"), F.lit(0))
    return joined.select(
        *own.columns[:-2], F.col("__mix_size").alias("size"), F.col("__mix_words").alias("source_size"), F.col("__mix_target").alias("target"),
        F.col("__mix_rate").alias("rate"), copies.alias("copies"), (copies * F.col("__mix_size")).alias("taken"))
