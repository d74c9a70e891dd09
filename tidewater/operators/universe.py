"""Point-in-time universe selection with evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scale import broadcast_if_small
from .temporal import contains, source_gaps


def select(memberships: DataFrame, lifecycle: DataFrame, liquidity: DataFrame, dates: DataFrame) -> DataFrame:
    """Every asset with some membership, per date: included, and the reason if not.

    memberships: asset_id, effective_from, effective_to; lifecycle: asset_id, effective_from, effective_to, status;
    liquidity: asset_id, available_at, value; dates: selection_date, decision_at (few rows, broadcast).
    Order of tests: membership (MISSING, AMBIGUOUS), lifecycle (exactly one, ACTIVE), liquidity (one visible value).
    """
    d = broadcast_if_small(dates)
    hits = lambda spans, flag: spans.join(d, contains(F.col("effective_from"), F.col("effective_to"), F.col("selection_date"))).groupBy("asset_id", "selection_date").agg(*flag)
    member = hits(memberships, [F.count("*").alias("n_member")])
    life = hits(lifecycle, [F.count("*").alias("n_life"), F.min(F.when(F.col("status") == "ACTIVE", 1).otherwise(0)).alias("active")])
    all_assets = memberships.select("asset_id").distinct().join(d)
    j = liquidity_counts(all_assets, liquidity).join(member, ["asset_id", "selection_date"], "left").join(life, ["asset_id", "selection_date"], "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    reason = F.when(n("n_member") == 0, "MISSING").when(n("n_member") > 1, "AMBIGUOUS").when((n("n_life") != 1) | (n("active") != 1), "LIFECYCLE").when(n("n_visible") < 1, "LIQUIDITY")
    tested = n("n_member").eqNullSafe(F.lit(1)) & (n("n_life") == 1) & (n("active") == 1)
    return j.select("asset_id", "selection_date", reason.isNull().alias("included"), reason.alias("reason"), F.when(tested, n("n_lookahead")).otherwise(0).cast("long").alias("lookahead_prevented"))


def liquidity_counts(probes: DataFrame, liquidity: DataFrame) -> DataFrame:
    """probes (asset_id, decision_at, ...) with n_visible, the liquidity values available at the decision, and n_lookahead,
    the rows that come after it (all, without a decision time): running counts over one window per asset."""
    e = liquidity.filter("available_at is not null").select("asset_id", F.col("available_at").alias("_t"), F.lit(0).alias("_side"), F.col("value").isNotNull().cast("long").alias("_v"), F.lit(1).cast("long").alias("_n"))
    p = probes.select("asset_id", F.col("decision_at").alias("_t"), F.lit(1).alias("_side"), F.lit(0).cast("long").alias("_v"), F.lit(0).cast("long").alias("_n"), F.struct(*probes.columns).alias("_p"))
    both = p.unionByName(e, allowMissingColumns=True)
    upto = Window.partitionBy("asset_id").orderBy(F.col("_t").asc_nulls_first(), "_side").rowsBetween(Window.unboundedPreceding, 0)
    counted = both.withColumn("n_visible", F.sum("_v").over(upto)).withColumn("n_lookahead", F.sum("_n").over(Window.partitionBy("asset_id")) - F.sum("_n").over(upto))
    return counted.filter("_side = 1").select("_p.*", "n_visible", "n_lookahead")


def history(selected: DataFrame) -> DataFrame:
    """Over a set of dates: counts by reason summed over dates; members and exclusions of the last date."""
    last = selected.agg(F.max("selection_date").alias("_last"))
    s = selected.crossJoin(F.broadcast(last))
    by = s.groupBy(F.coalesce("reason", F.lit("INCLUDED")).alias("outcome")).agg(F.count("*").alias("n_all_dates"), F.count_if(F.col("selection_date") == F.col("_last")).alias("n_last_date"), F.count_distinct(F.when(F.col("included"), F.col("asset_id"))).alias("members"))
    return by


def members(selected: DataFrame) -> DataFrame:
    """The union of the members of all dates, with the first and last date of each."""
    return selected.filter("included").groupBy("asset_id").agg(F.min("selection_date").alias("first_date"), F.max("selection_date").alias("last_date"), F.count("*").alias("n_dates"))


def last_exclusions(selected: DataFrame) -> DataFrame:
    """What the last date leaves out, and why."""
    last = selected.agg(F.max("selection_date").alias("selection_date"))
    return selected.filter("not included").join(F.broadcast(last), "selection_date", "left_semi").select("asset_id", "selection_date", "reason")  # one row


def survivorship_warnings(memberships: DataFrame, dates: DataFrame) -> DataFrame:
    """Ranges of requested days that fall between two of an asset's intervals."""
    return source_gaps(memberships, dates, ["asset_id"], "selection_date")
