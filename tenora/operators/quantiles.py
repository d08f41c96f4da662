"""Exact, interpolated percentiles that never bring a whole group into one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tenora.operators.lookup import to_long
from tenora.session import stored

#: Groups up to so many rows are solved in two passes; this bounds the values of a group that may meet in one task.
TWO_PASSES = 5_000_000
SKETCH_PARTS = 16
#: Values of one group and rank that may meet in one task in larger groups.
MOST_CANDIDATES = 20_000
#: Parts that a bracket is cut into at each narrowing.
CUTS = 256


def _narrowed(
    spark: SparkSession, rows: DataFrame, slot: list[str], probabilities: Mapping[str, float], accuracy: int
) -> DataFrame:
    """``percentiles_long`` of (slot, v) by rounds that narrow the brackets until few values are left in each."""
    names, probs = list(probabilities), [float(p) for p in probabilities.values()]
    most = max(1, min(accuracy, MOST_CANDIDATES))
    ranks = F.array(*[F.struct(F.lit(j).alias("j"), F.lit(p).alias("p")) for j, p in enumerate(probs)])
    ends = rows.groupBy(*slot).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    wanted = ends.select(*slot, "n", "low", "high", F.explode(ranks).alias("r")).select(*slot, "n", "low", "high", "r.j", "r.p")
    wanted = wanted.withColumn("position", F.col("p") * (F.col("n") - 1))
    both = F.array_distinct(F.array(F.floor("position"), F.ceil("position")))
    # One bracket for each of the two order statistics of a rank: ``rank`` rows of the group come before it.
    open_ = wanted.select(*slot, "low", "high", F.explode(both).alias("rank")).distinct().withColumns(
        {"before": F.lit(0).cast("long"), "inside": F.lit(None).cast("long")})
    open_ = open_.join(ends.select(*slot, F.col("n").alias("all")), slot).withColumn("inside", F.col("all")).drop("all")
    brackets, closed = stored(spark, open_, "brackets"), None
    wanted_rows = stored(spark, wanted, "ranks")
    while True:
        settled = (F.col("inside") <= most) | (F.col("low") >= F.col("high"))
        done = brackets.filter(settled)
        closed = done if closed is None else closed.union(done)
        going = brackets.filter(~settled)
        if going.isEmpty():
            break
        width = (F.col("high") / CUTS - F.col("low") / CUTS)
        ranges = going.select(*slot, "low", "high").distinct()
        cut = F.when(F.col("v") >= F.col("high"), CUTS - 1).otherwise(
            F.least(F.lit(CUTS - 1), F.floor(F.try_divide(F.col("v") - F.col("low"), width)))).cast("int")
        held = rows.join(ranges, slot).filter(F.col("v").between(F.col("low"), F.col("high")))
        counts = held.groupBy(*slot, "low", "high", F.coalesce(cut, F.lit(0)).alias("cut")).agg(
            F.count(F.lit(1)).alias("k"), F.min("v").alias("least"), F.max("v").alias("most"))
        upto = F.sum("k").over(Window.partitionBy(*slot, "low", "high").orderBy("cut").rowsBetween(Window.unboundedPreceding, -1))
        parts = counts.withColumn("earlier", F.coalesce(upto, F.lit(0)))  # at most CUTS rows a bracket
        found = going.drop("inside").join(parts, [*slot, "low", "high"])
        at = F.col("before") + F.col("earlier")
        found = found.filter((F.col("rank") >= at) & (F.col("rank") < at + F.col("k")))
        brackets = stored(spark, found.select(
            *slot, F.col("least").alias("low"), F.col("most").alias("high"), "rank", at.alias("before"), F.col("k").alias("inside")), "brackets")
    closed = closed.select(*slot, "low", "high", "rank", "before")
    ranges = closed.filter("low < high").select(*slot, "low", "high").distinct()
    held = rows.join(ranges, slot).filter(F.col("v").between(F.col("low"), F.col("high")))
    counts = held.groupBy(*slot, "low", "high", "v").agg(F.count(F.lit(1)).alias("k"))
    group = Window.partitionBy(*slot, "low", "high").orderBy("v")
    placed = counts.withColumn("upto", F.sum("k").over(group.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    inside = F.col("rank") - F.col("before")
    hit = (F.col("upto") > inside) & (F.col("upto") - F.col("k") <= inside)
    known = closed.filter("low < high").join(placed, [*slot, "low", "high"]).filter(hit).select(*slot, "rank", "v")
    known = known.union(closed.filter("low >= high").select(*slot, "rank", F.col("low").alias("v")))
    floor, position = F.floor("position"), F.col("position")
    ordered = wanted_rows.join(known, slot).filter((F.col("rank") == floor) | (F.col("rank") == F.ceil("position")))
    solved = ordered.groupBy(*slot, "j").agg(
        F.max(F.when(F.col("rank") == floor, F.col("v"))).alias("a"), F.max("v").alias("z"), F.first("position").alias("position"))
    solved = solved.withColumn("solved", F.col("a") + (F.col("z") - F.col("a")) * (position - F.floor(position)))
    return solved.groupBy(*slot).agg(*[
        F.max(F.when(F.col("j") == j, F.col("solved"))).alias(s) for j, s in enumerate(names)
    ])


def percentiles_long(
    rows: DataFrame,
    slot: Sequence[str],
    probabilities: Mapping[str, float],
    value: str = "value",
    accuracy: int = 10_000,
    few_groups: bool = True,
) -> DataFrame:
    """One row per ``slot`` with a column per suffix in ``probabilities``.

    The built-in exact percentile keeps every distinct value of a group in one buffer. Here a first pass, run at once,
    counts the groups and brackets each wanted rank by bounded sketches (those of a group are merged in SKETCH_PARTS
    tasks, and the widest bounds of all parts enclose the rank). Where no group has more than TWO_PASSES rows, a second
    pass counts what lies below and above each bracket and groups the few values inside, and a running count over those
    finds the exact order statistics; groups up to ``accuracy`` rows use all values.

    Larger groups are solved in rounds: a bracket, at first from the smallest to the largest value, is cut into CUTS
    parts of equal width, one pass counts the rows of all parts, and the part that holds the rank is the next bracket,
    until it holds at most MOST_CANDIDATES rows or equal values. A bracket's counts come from the rows themselves, so
    no rank can fall outside, in whatever order the rows come, and every pass emits counts only. Brackets are joined by
    their measured size, so there may be any number of groups (``few_groups`` is kept for older callers and decides
    nothing). Null and NaN values are left out.
    """
    slot, names, v = list(slot), list(probabilities), F.col(value)
    spark = rows.sparkSession
    rows = rows.filter(v.isNotNull() & ~F.isnan(v.cast("double"))).select(*slot, v.cast("double").alias("v"))
    probs = [float(probabilities[s]) for s in names]
    margin, m = 4.0 / accuracy, len(probs)
    cuts = [max(0.0, p - margin) for p in probs] + [min(1.0, p + margin) for p in probs]
    parts = rows.groupBy(*slot, (F.spark_partition_id() % SKETCH_PARTS).alias("part")).agg(
        F.count("v").alias("n"), F.percentile_approx("v", cuts, accuracy).alias("cuts"))
    low = F.array(*[F.min(F.col("cuts")[j]) for j in range(m)])
    high = F.array(*[F.max(F.col("cuts")[m + j]) for j in range(m)])
    brackets = stored(spark, parts.groupBy(*slot).agg(
        F.sum("n").alias("n_all"), F.when(F.sum("n") > accuracy, F.struct(low.alias("low"), high.alias("high"))).alias("b")), "brackets")
    if (brackets.agg(F.max("n_all")).first()[0] or 0) > TWO_PASSES:
        return _narrowed(spark, rows, slot, probabilities, accuracy)
    v = F.col("v")
    marks = []
    for j in range(m):
        # side -1: below the bracket, 1: above it, 0: a candidate; no bracket means all are candidates.
        side = F.when(v < F.col("b.low")[j], -1).when(v > F.col("b.high")[j], 1).otherwise(0)
        marks.append(F.struct(F.lit(j).alias("j"), side.alias("side")))
    counted = (
        rows.join(brackets, slot)
        .select(*slot, v.alias("v"), F.explode(F.array(*marks)).alias("m"))
        .groupBy(*slot, "m.j", "m.side", F.when(F.col("m.side") == 0, F.col("v")).alias("v"))
        .agg(F.count(F.lit(1)).alias("k"))
    )
    group = Window.partitionBy(*slot, "j")
    upto = F.sum("k").over(
        group.orderBy("side", "v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    position = F.element_at(F.array(*[F.lit(p) for p in probs]), F.col("j") + 1) * (F.col("n") - 1)

    def at(rank: Column) -> Column:
        hit = (F.col("upto") > rank) & (F.col("upto") - F.col("k") <= rank)
        return F.max(F.when(hit, F.col("v")))

    found = counted.withColumns({"upto": upto, "n": F.sum("k").over(group)}).groupBy(*slot, "n", "j").agg(
        at(F.floor(position)).alias("a"), at(F.ceil(position)).alias("z")
    )
    solved = F.when(
        F.col("a").isNotNull() & F.col("z").isNotNull(),
        F.col("a") + (F.col("z") - F.col("a")) * (position - F.floor(position)),
    ).otherwise(F.raise_error(F.lit("a rank lies outside its bracket")).cast("double"))
    return found.withColumn("solved", solved).groupBy(*slot).agg(*[
        F.max(F.when(F.col("j") == j, F.col("solved"))).alias(s) for j, s in enumerate(names)
    ])


def exact_percentiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Mapping[str, float],
    by: Sequence[str] = (),
    accuracy: int = 10_000,
    few_groups: bool = True,
) -> DataFrame:
    """Wide form: one row per group with ``<column>_<suffix>`` for every column and suffix."""
    keys, names = list(by), list(probabilities)
    for k in keys:
        df = df.filter(F.col(k).isNotNull())
    long = percentiles_long(
        to_long(df, columns, keys), [*keys, "column"], probabilities, accuracy=accuracy, few_groups=few_groups
    )
    return long.groupBy(*keys).agg(*[
        F.max(F.when(F.col("column") == c, F.col(s))).alias(f"{c}_{s}") for c in columns for s in names
    ])


def medians(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), **kw) -> DataFrame:
    return exact_percentiles(df, columns, {"median": 0.5}, by, **kw)


def join_on_keys(frames: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Join per-group results (one row per group each) on their non-null keys."""
    return reduce(lambda a, b: a.join(b, list(keys), "left"), frames)
