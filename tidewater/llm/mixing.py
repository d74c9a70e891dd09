"""Mixing sources to target weights by Pareto order sampling.

Each source has a target number of words: sources share ``total_share`` of all words by weight, no source takes more
than ``max_repeat`` times its own words, and what is above is shared out again by weight. A document's expected number
of copies is its source's target over its source's words; the whole part of it is certain. The fractional part is an
inclusion probability p, and documents are ranked by their random odds over their inclusion odds,
(u / (1 - u)) / (p / (1 - p)), u drawn from a hash of (seed, doc_id, text, source, number among equal rows): each source takes the documents of lowest rank up
to its fixed size in words. The sample's size is met exactly but for part of a document; one more document per source,
the one that fits what is left best, closes that.

The cut in each source is found from sums over 1/256-wide steps of the rank's logarithm (no step holds over a
thousandth of a source), then row by row inside one step; no source is sorted or gathered as a whole.

A null text has size 0; of a text of any length only its size and hash are kept. An empty table gives no rows. Rows without words are never taken. A null source is a source of its own, the last. Rows that
share a doc_id, or have none, are drawn each by itself, and rows that are equal throughout by their number among each
other, so reruns agree. Source sizes are one row for each source, a small table. Other columns, whatever their names, are
not read, but for those to carry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Stash, numbered

STEPS = 256


def row_key(text_hash: str = "_hash", ordinal: str = "_ordinal") -> Column:
    """One text for each row."""
    return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col(text_hash), F.coalesce("source", F.lit("")), F.col(ordinal).cast("string"))


def uniform(key: Column, seed: int) -> Column:
    """In (0, 1), from the first 52 bits of an MD5 of seed and key."""
    return (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), total_share: float = 1.5, max_repeat: float = 2.0) -> DataFrame:
    """sizes (source, source_size) -> with target. Sources in code-point order, null last, weigh as weights, repeating."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("w", w.cast("double")).withColumn("cap", max_repeat * F.col("source_size")).withColumn("goal", total_share * F.sum("source_size").over(everything))
    fill = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    rows = rows.withColumn("full", F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1))).withColumn("open", F.sum("w").over(fill.rowsBetween(0, Window.unboundedFollowing)))
    rows = rows.withColumn("level", (F.col("goal") - F.coalesce("full", F.lit(0.0))) / F.col("open"))
    rows = rows.withColumn("level", F.min(F.when(F.col("level") * F.col("w") < F.col("cap"), F.struct((F.col("cap") / F.col("w")).alias("o"), F.col("level").alias("v")))).over(everything)["v"])
    return rows.select("source", "source_size", F.coalesce(F.least("cap", F.col("level") * F.col("w")), "cap").alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 20240229, carry: tuple[str, ...] = (), **shares) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, copies, taken (words, repeats counted), carry."""
    stash = Stash(docs.sparkSession)
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.md5(F.coalesce(text, F.lit(""))).alias("_hash"), *carry)
    rows = stash.put(rows.withColumn("_row", F.monotonically_increasing_id()))
    rows = numbered(rows, ["doc_id", "source", "_hash"], "_ordinal", 16).withColumn("key", row_key()).drop("_hash", "_ordinal", "_row")
    return mix_sizes(stash.put(rows), stash, seed, carry, **shares)


def mix_sizes(rows: DataFrame, stash: Stash, seed: int = 20240229, carry: tuple[str, ...] = (), **shares) -> DataFrame:
    """As mix(), for rows (doc_id, source, size, key, carry) that are there already; key: a text of each row's own."""
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), **shares)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    targets = targets.withColumn("whole", F.floor(ratio).cast("long")).withColumn("p", ratio - F.floor(ratio)).withColumn("words", F.col("target") - F.col("whole") * F.col("source_size"))
    targets = stash.put(targets)
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    t = targets.select(F.col("source").alias("s"), "source_size", "target", "whole", "p", "words")
    u, p = uniform(F.col("key"), seed), F.least(F.greatest("p", F.lit(1e-12)), F.lit(1 - 1e-12))
    ranked = rows.join(t, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("rank", F.log(u) - F.log(1 - u) - F.log(p) + F.log(1 - p)).withColumn("step", F.floor(F.col("rank") * STEPS))
    ranked = stash.put(ranked)
    steps = ranked.groupBy("source", "step").agg(F.sum("size").alias("step_size"))
    upto = Window.partitionBy("source").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.withColumn("upto", F.sum("step_size").over(upto)).join(targets.select(F.col("source").alias("s"), "words"), F.col("source").eqNullSafe(F.col("s")))
    cut = stash.put(steps.filter(F.col("upto") > F.col("words")).groupBy("source").agg(F.min_by(F.struct("step", (F.col("upto") - F.col("step_size")).alias("before")), "step").alias("c")).select(F.col("source").alias("s"), "c.step", "c.before"))
    at = ranked.join(cut.withColumnRenamed("step", "cut_step"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    inside = at.filter(F.col("step") == F.col("cut_step")).withColumn("upto", F.col("before") + F.sum("size").over(Window.partitionBy("source").orderBy("rank", "key").rowsBetween(Window.unboundedPreceding, 0)))
    last = inside.filter(F.col("upto") > F.col("words")).groupBy("source").agg(F.min(F.struct("rank", "key")).alias("stop")).select(F.col("source").alias("s"), "stop")
    picked = stash.put(at.join(last, F.col("source").eqNullSafe(F.col("s")), "left").drop("s").withColumn("picked", (F.col("p") > 0) & (F.col("stop").isNull() | (F.struct("rank", "key") < F.col("stop")))).drop("stop", "before", "cut_step"))
    gap = picked.groupBy("source").agg(F.first("words").alias("words"), F.sum(F.when(F.col("picked"), F.col("size")).otherwise(0)).alias("got")).select(F.col("source").alias("s"), (F.col("words") - F.col("got")).alias("gap"))
    left = picked.filter(~F.col("picked") & (F.col("size") > 0) & (F.col("p") > 0)).join(gap, F.col("source").eqNullSafe(F.col("s"))).filter(F.col("size") < 2 * F.col("gap"))
    closing = left.groupBy("source").agg(F.min_by("key", F.struct(F.abs(F.col("size") - F.col("gap")), F.col("rank"), F.col("key"))).alias("closing_key")).select(F.col("source").alias("s"), "closing_key")
    out = picked.join(closing, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    copies = F.when(F.col("size") > 0, F.col("whole") + (F.col("picked") | F.coalesce(F.col("key") == F.col("closing_key"), F.lit(False))).cast("long")).otherwise(0)
    return out.withColumn("copies", copies).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *carry)
