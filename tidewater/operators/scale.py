"""Broadcasts of checked size, and numbering of rows without one task for all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SMALL = 100_000


def broadcast_if_small(df: DataFrame, most: int = SMALL) -> DataFrame:
    """df with a broadcast hint if it has at most `most` rows; else as it is, and Catalyst picks the join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


RANGE_ROWS, MOST_RANGES = 1_000_000, 4096


def carried(rows: DataFrame, keys: list[str], order: list[str], value: str, out: str, backwards: bool = False, upto: int = 0, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The last non-null `value` at or before each row (upto = 0; -1: before it), per key, in the order of the columns `order`,
    whose first is a date, a timestamp or a number; backwards: the next one after it.

    A scan in two levels, so that a key of any size is many tasks. Time is cut into equal ranges, one for each `range_rows`
    rows of the table. What each range of a key ends with is a small table, by partial aggregation; a window over a key's
    ranges carries it on; and it enters the range after it as one row more, ahead of the range's own, before the ranges are
    scanned apart. The rows are shuffled once, by key and range.
    """
    at = F.col(order[0]).cast("timestamp").cast("double") if rows.schema[order[0]].dataType.typeName() in ("date", "timestamp", "timestamp_ntz") else F.col(order[0]).cast("double")
    marked = rows.withColumn("_x", at)
    ends = marked.agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), F.least(F.ceil(F.count("*") / float(range_rows)), F.lit(MOST_RANGES)).alias("_n"))  # one row
    part = F.floor((F.col("_x") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * F.col("_n"))
    place = F.when(F.col("_x").isNull(), -1).when((F.col("_n") <= 1) | (F.col("_hi") == F.col("_lo")), 0).otherwise(F.least(part, F.col("_n") - 1))
    marked = marked.crossJoin(F.broadcast(ends)).withColumn("_range", place.cast("int")).drop("_x", "_lo", "_hi", "_n")  # nulls come first, as in the order
    pick = F.min_by if backwards else F.max_by
    last = marked.groupBy(*keys, "_range").agg(pick(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias("_end"))
    side = lambda c: c.desc() if backwards else c.asc()
    over = Window.partitionBy(*keys).orderBy(side(F.col("_range"))).rowsBetween(Window.unboundedPreceding, -1)  # a row for each range of a key
    enters = last.select(*keys, "_range", F.last("_end", ignorenulls=True).over(over).alias(value), F.lit(0).alias("_own")).filter(F.col(value).isNotNull())
    both = marked.withColumn("_own", F.lit(1)).unionByName(enters, allowMissingColumns=True)
    scan = Window.partitionBy(*keys, "_range").orderBy("_own", *(side(F.col(c)) for c in order)).rowsBetween(Window.unboundedPreceding, upto)
    return both.withColumn(out, F.last(value, ignorenulls=True).over(scan)).filter("_own = 1").drop("_own", "_range")


def total_order(df: DataFrame, coarse: Column, order: list[str], out: str) -> DataFrame:
    """1, 2, ... over all rows in the given order. `coarse` is a function of the order's first key that grows with it (a day
    of a timestamp): groups are numbered by themselves and begin where the sums of the groups before them end."""
    rows = df.withColumn("_group", coarse)
    sizes = rows.groupBy("_group").agg(F.count("*").alias("_n"))
    begin = sizes.select("_group", (F.sum("_n").over(Window.orderBy(F.col("_group").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_begin"))  # a row a group
    inner = F.row_number().over(Window.partitionBy("_group").orderBy(*order))
    first = broadcast_if_small(begin.withColumnRenamed("_group", "_g"))
    return rows.withColumn("_inner", inner).join(first, F.col("_group").eqNullSafe(F.col("_g"))).withColumn(out, (F.col("_begin") + F.col("_inner")).cast("long")).drop("_group", "_g", "_begin", "_inner")


def bucketed_digest(hashes: DataFrame, keys: list[str], h: str, out: str, separator: str = ",") -> DataFrame:
    """Per key, sha256 of its hashes (hex texts) in any order: first of each bucket of hashes with the same three digits, in
    order, then of the buckets' digests. No task gathers a key's hashes."""
    b = hashes.select(*keys, F.col(h).alias("_h"), F.substring(h, 1, 3).alias("_b"))
    per = b.groupBy(*keys, "_b").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("_h")), separator), 256).alias("_d"), F.count("*").alias("_n"))
    return per.groupBy(*keys).agg(F.sum("_n").alias("row_count"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_b", "_d"))), lambda x: x["_d"]), separator), 256).alias(out))
