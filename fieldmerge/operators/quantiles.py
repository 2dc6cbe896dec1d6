"""Exact values at given ranks within groups of any size: no task holds a group.

Each wanted rank of a group has an interval that holds its value. A round counts the values in BINS parts of the interval, equal by
value or, every second time, by order of magnitude, with partial sums in every task, and the part that holds the rank is the next interval, from its least value to its largest. That
ends when all values of an interval are equal, or when no more than FEW are left, which are sorted. Values outside all intervals
are dropped as soon as possible, so from the second round on few rows are read.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldmerge.functions.session import stored

BINS, FEW = 4096, 1000


def _by_size(column: str) -> Column:
    """Grows with the value as its order of magnitude does."""
    size = F.log2(F.abs(column)) + 1076
    return F.when(F.col(column) > 0, size).when(F.col(column) < 0, -size).otherwise(0.0)


def at_ranks(rows: DataFrame, keys: list[str], values: dict[str, tuple[str, Callable[[Column], Column]]]) -> DataFrame:
    """(*keys, *values): for each name the value of a column at a rank, the smallest being 1, given as a function of how many there are.

    Nulls and NaN are no values; a group without any value has no row; groups with null keys are groups like others; equal values
    each have a rank. rows is read several times, so it should be stored.
    """
    columns = list(dict.fromkeys(c for c, _ in values.values()))
    known = F.array(*(F.struct(F.lit(c).alias("__c"), F.col(c).cast("double").alias("__v")) for c in columns))
    long = rows.select(F.struct(*keys).alias("__key") if keys else F.struct(F.lit(0).alias("__none")).alias("__key"), F.explode(known).alias("__e")).select("__key", "__e.*")
    long = long.where("__v is not null and not isnan(__v)")
    sizes = long.groupBy("__key", "__c").agg(F.count(F.lit(1)).alias("n"), F.min("__v").alias("low"), F.max("__v").alias("high"))
    wanted = [F.when(F.col("__c") == c, F.struct(F.lit(name).alias("name"), rank(F.col("n")).cast("long").alias("rank"))) for name, (c, rank) in values.items()]
    goals = sizes.withColumn("w", F.explode(F.filter(F.array(*wanted), lambda w: w.isNotNull()))).select("__key", "__c", "w.*", "n", "low", "high")
    goals = stored(goals.where(F.col("rank").between(1, F.col("n"))), "goals")
    done, live = [goals.where("low = high").select("__key", "name", F.col("low").alias("value"))], goals.where("low < high")
    scales = itertools.cycle((lambda c: F.col(c) / 2, _by_size))
    while live.where(F.col("n") > FEW).limit(1).count():
        inside, scale = long.join(live, ["__key", "__c"]).where("__v between low and high"), next(scales)
        # values that differ in their last digits only have one order of magnitude: such an interval waits for the round by value
        step = F.coalesce(F.try_divide(scale("__v") - scale("low"), scale("high") - scale("low")), F.lit(0.0))
        binned = inside.withColumn("bin", F.least(F.lit(BINS - 1), F.floor(step * BINS)))
        counts = binned.groupBy("__key", "__c", "name", "rank", "bin").agg(F.count(F.lit(1)).alias("n"), F.min("__v").alias("low"), F.max("__v").alias("high"))
        upto = F.sum("n").over(Window.partitionBy("__key", "name").orderBy("bin"))
        held = counts.withColumn("upto", upto).where("upto >= rank and upto - n < rank")
        goals = stored(held.select("__key", "__c", "name", (F.col("rank") - (F.col("upto") - F.col("n"))).alias("rank"), "n", "low", "high"), "goals")
        done.append(goals.where("low = high").select("__key", "name", F.col("low").alias("value")))
        live = goals.where("low < high")
        spans = live.groupBy("__key", "__c").agg(F.min("low").alias("__low"), F.max("high").alias("__high"))
        long = stored(long.join(spans, ["__key", "__c"]).where("__v between __low and __high").select("__key", "__c", "__v"), "values")
    few = long.join(live, ["__key", "__c"]).where("__v between low and high").groupBy("__key", "name", "rank").agg(F.sort_array(F.collect_list("__v")).alias("all"))
    told = few.select("__key", "name", F.element_at("all", F.col("rank").cast("int")).alias("value"))
    for part in done:
        told = told.unionByName(part)
    wide = told.groupBy("__key").agg(*(F.max(F.when(F.col("name") == name, F.col("value"))).alias(name) for name in values))
    return wide.select(*(F.col(f"__key.{k}").alias(k) for k in keys), *values)


def medians(column: str, low: str, high: str) -> dict[str, tuple[str, Callable[[Column], Column]]]:
    """The two values between which the median of a column lies, for at_ranks(); see median()."""
    return {low: (column, lambda n: F.floor((n + 1) / 2)), high: (column, lambda n: F.floor(n / 2) + 1)}


def median(low: str, high: str) -> Column:
    return F.col(low) + (F.col(high) - F.col(low)) * 0.5
