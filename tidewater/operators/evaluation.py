"""Cross-sectional factor evaluation: ranks, correlations, quantiles, forward returns, turnover.

A section is a set of key columns (evaluation, date). Undefined results are null with a detail code, never NaN.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scale import broadcast_if_small


def average_rank(value: Column | str, section: list[str]) -> Column:
    """1-based rank, ties share the mean of their positions; null in a section of fewer than two."""
    v = F.col(value) if isinstance(value, str) else value
    every = Window.partitionBy(*section)
    w = every.orderBy(v)
    upto = F.count(F.lit(1)).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))  # the place of the last tie
    r = (F.rank().over(w) + upto) / F.lit(2.0)
    return F.when(F.count(F.lit(1)).over(every) >= 2, r)


def pearson(x: str, y: str) -> Column:
    """Aggregate: correlation, null for fewer than two pairs or without dispersion on either side."""
    a, b = F.col(x), F.col(y)
    spread = F.var_pop(a) * F.var_pop(b)
    return F.when((F.count(F.lit(1)) >= 2) & (spread > 0), F.covar_pop(a, b) / F.sqrt(F.when(spread > 0, spread)))


def ic(df: DataFrame, section: list[str], factor: str, ret: str, method: str = "pearson") -> DataFrame:
    """Information coefficient per section over the pairs that have both values."""
    pairs = df.filter(F.col(factor).isNotNull() & F.col(ret).isNotNull())
    if method == "spearman":
        pairs = pairs.withColumn("_x", average_rank(factor, section)).withColumn("_y", average_rank(ret, section))
        factor, ret = "_x", "_y"
    return pairs.groupBy(*section).agg(F.count("*").alias("n_pairs"), pearson(factor, ret).alias("ic"))


def ic_summary(ics: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Mean and sample deviation of defined coefficients; the deviation is undefined for a single one."""
    return ics.filter("ic is not null").groupBy(*(keys or [])).agg(F.count("*").alias("n_sections"), F.avg("ic").alias("ic_mean"), F.stddev_samp("ic").alias("ic_std"))


def quantile_groups(df: DataFrame, section: list[str], factor: str, asset: str, q: int) -> DataFrame:
    """Groups 1..q by position in (factor, asset): least(q, (r - 1) * q div n + 1). A section with fewer than q distinct
    values has no groups (status UNDEFINED, with a detail code)."""
    if not 2 <= q <= 20:
        raise ValueError("quantiles.range")
    ok = df.filter(F.col(factor).isNotNull() & ~F.isnan(F.col(factor).cast("double")))
    every = Window.partitionBy(*section)
    distinct = F.sum(F.when(F.col("_first"), 1).otherwise(0)).over(every)
    order = every.orderBy(factor, asset)
    first = F.coalesce(F.lag(factor).over(order) != F.col(factor), F.lit(True))
    r = ok.withColumn("_r", F.row_number().over(order)).withColumn("_n", F.count("*").over(every)).withColumn("_first", first).withColumn("_d", distinct)
    group = F.least(F.lit(q), F.expr(f"cast(((_r - 1) * {q}) div _n + 1 as int)"))
    return r.withColumn("quantile", F.when(F.col("_d") >= q, group)).withColumn("status", F.when(F.col("_d") >= q, "OK").otherwise("UNDEFINED")).withColumn("detail", F.when(F.col("_d") < q, "insufficient-distinct-values")).drop("_r", "_n", "_first", "_d")


def quantile_returns(grouped: DataFrame, section: list[str], ret: str, weight: str) -> DataFrame:
    """Weighted mean return per group over valid rows (weight > 0, return present), with counts of the others."""
    valid = F.col(ret).isNotNull() & F.col(weight).isNotNull() & (F.col(weight) > 0)
    g = grouped.filter("quantile is not null").groupBy(*section, "quantile").agg(F.count("*").alias("n_assets"), F.count_if(~valid).alias("missing_count"), F.sum(F.when(valid, F.col(weight) * F.col(ret))).alias("_wr"), F.sum(F.when(valid, F.col(weight))).alias("_w"))
    return g.withColumn("quantile_return", F.when(F.col("_w") > 0, F.try_divide("_wr", "_w"))).drop("_wr", "_w")


def quantile_spread(returns: DataFrame, section: list[str]) -> DataFrame:
    """max - min over the groups, and top group - bottom group."""
    v = returns.filter("quantile_return is not null")
    return v.groupBy(*section).agg((F.max("quantile_return") - F.min("quantile_return")).alias("range_spread"), (F.max_by("quantile_return", "quantile") - F.min_by("quantile_return", "quantile")).alias("top_bottom_spread"))


def forward_returns(decisions: DataFrame, endpoints: DataFrame, keys: list[str], decision_at: str, at: str, value: str, h: int) -> DataFrame:
    """v[h] / v[0] - 1 over the valid endpoints strictly after each decision; null and a code if there are too few.

    Endpoints are numbered once per key, and a decision finds its first one by an as-of window: no pair of a decision
    and each endpoint is made.
    """
    if not 1 <= h <= 252:
        raise ValueError("holding_period.range")
    by = Window.partitionBy(*keys).orderBy(at)
    valid = endpoints.filter(F.col(value) > 0)
    spans = valid.select(*keys, F.col(at).alias("_t"), F.col(value).alias("_v0"), F.lead(value, h).over(by).alias("_vh"))
    d = decisions.select(*keys, F.col(decision_at).alias("_t"), F.lit(1).alias("_side"), F.struct(*decisions.columns).alias("_p"), F.lit(None).cast(spans.select(F.struct("_t", "_v0", "_vh")).schema[0].dataType).alias("_s"))
    s = spans.select(*keys, "_t", F.lit(0).alias("_side"), F.lit(None).cast(d.schema["_p"].dataType).alias("_p"), F.struct("_t", "_v0", "_vh").alias("_s"))
    w = Window.partitionBy(*keys).orderBy(F.col("_t").desc(), F.col("_side").desc()).rowsBetween(Window.unboundedPreceding, -1)
    got = d.unionByName(s).withColumn("_s", F.last("_s", ignorenulls=True).over(w)).filter("_side = 1")
    out = got.select("_p.*", F.try_divide(F.col("_s._vh"), F.col("_s._v0")).alias("_q"))
    return out.select(*decisions.columns, (F.col("_q") - 1).alias("forward_return"), F.when(F.col("_q").isNull(), "insufficient-endpoints").alias("detail"))


def turnover(weights: DataFrame, keys: list[str], section: str, asset: str, weight: str) -> DataFrame:
    """Half the sum of absolute weight changes between consecutive sections, over the union of their assets."""
    index = Window.partitionBy(*keys).orderBy(section) if keys else Window.orderBy(section)
    dates = weights.select(*keys, section).distinct().withColumn("_i", F.row_number().over(index))
    w = weights.join(dates if keys else broadcast_if_small(dates), [*keys, section]).select(*keys, asset, "_i", F.col(weight).alias("_w"))
    both = w.select(*keys, asset, "_i", "_w", F.lit(0.0).alias("_b")).unionByName(w.select(*keys, asset, (F.col("_i") + 1).alias("_i"), F.lit(0.0).alias("_w"), F.col("_w").alias("_b")))
    change = both.groupBy(*keys, "_i", asset).agg(F.sum("_w").alias("_w"), F.sum("_b").alias("_b"))
    return change.groupBy(*keys, "_i").agg((F.sum(F.abs(F.col("_w") - F.col("_b"))) / 2).alias("turnover")).join(dates.filter("_i > 1"), [*keys, "_i"]).select(*keys, section, "turnover")


def rank_autocorrelation(df: DataFrame, section: str, asset: str, factor: str) -> DataFrame:
    """Correlation of average ranks between consecutive sections over the assets they share."""
    dates = df.select(section).distinct().withColumn("_i", F.row_number().over(Window.orderBy(section)))
    a = df.filter(F.col(factor).isNotNull()).join(broadcast_if_small(dates), section).select("_i", section, asset, F.col(factor).alias("_x"))
    b = a.select((F.col("_i") + 1).alias("_i"), asset, F.col("_x").alias("_y"))
    shared = a.join(b, ["_i", asset]).withColumn("_x", average_rank("_x", [section])).withColumn("_y", average_rank("_y", [section]))
    return shared.groupBy(section).agg(F.count("*").alias("n_shared"), pearson("_x", "_y").alias("autocorrelation"))


def coverage(df: DataFrame, factor: str, ret: str) -> DataFrame:
    """Aligned assets over all assets, 0 without assets."""
    ok = F.count_if(F.col(factor).isNotNull() & F.col(ret).isNotNull())
    return df.agg(ok.alias("aligned"), F.count("*").alias("assets"), F.coalesce(F.try_divide(ok, F.count("*")), F.lit(0.0)).alias("coverage"))


def annualised_ic(ics: DataFrame, section: str, half_life: float, periods: int) -> DataFrame:
    """Decay-weighted mean coefficient (weight halves every half_life sections back) scaled by sqrt(periods)."""
    back = F.row_number().over(Window.orderBy(F.col(section).desc())) - 1
    w = ics.filter("ic is not null").withColumn("_w", F.pow(F.lit(0.5), back / half_life))
    return w.agg((F.sum(F.col("_w") * F.col("ic")) / F.sum("_w") * F.sqrt(F.lit(float(periods)))).alias("annualised_ic"))


def decayed_annualised_ic(samples: DataFrame, weights: DataFrame, base_rate: float, section: str = "factor_date", asset: str = "asset_id") -> DataFrame:
    """samples (section, asset, factor), weights (section, asset, weight), both sections alike. Each asset's weights are
    summed over all sections; the coefficient is that of the last section's factor values (0 where it has none) and these
    values times the summed weights; it is compounded over the days from the first section to the last."""
    ends = samples.agg(F.min(section).alias("_a"), F.max(section).alias("_b"))
    combined = weights.groupBy(asset).agg(F.sum("weight").alias("_w"))
    last = samples.join(F.broadcast(ends), F.col(section) == F.col("_b"), "left_semi").select(asset, F.col("factor").alias("_x"))
    pairs = combined.join(last, asset, "left").withColumn("_x", F.coalesce("_x", F.lit(0.0))).withColumn("_y", F.col("_x") * F.col("_w"))
    one = pairs.agg(F.count("*").alias("n_assets"), pearson("_x", "_y").alias("_ic")).crossJoin(F.broadcast(ends))
    return one.select("n_assets", (F.pow(F.abs(1 + F.col("_ic") * base_rate), F.date_diff("_b", "_a")) - 1).alias("annualised_ic"))


def evaluate(df: DataFrame, section: str, asset: str, factor: str, ret: str, weight: str, q: int) -> tuple[DataFrame, DataFrame]:
    """(points, summary) of a whole factor evaluation. points, one row a section: aligned and missing counts, Pearson and
    Spearman coefficients, quantile spreads, rank autocorrelation and turnover against the section before. summary: their
    counts, coverage, mean and sample deviation of the coefficients, status UNDEFINED without sections."""
    s = [section]
    both = F.col(factor).isNotNull() & F.col(ret).isNotNull()
    counts = df.groupBy(section).agg(F.count("*").alias("asset_count"), F.count_if(both).alias("aligned_count"), F.count_if(~both).alias("missing_count"))
    groups = quantile_returns(quantile_groups(df, s, factor, asset, q), s, ret, weight)
    parts = [
        ic(df, s, factor, ret).select(section, F.col("ic").alias("pearson")),
        ic(df, s, factor, ret, "spearman").select(section, F.col("ic").alias("spearman")),
        quantile_spread(groups, s),
        rank_autocorrelation(df, section, asset, factor).select(section, F.col("autocorrelation").alias("rank_autocorrelation")),
        turnover(df.filter(F.col(weight).isNotNull()), [], section, asset, weight),
    ]
    points = counts
    for p in parts:
        points = points.join(p, section, "left")
    summary = points.agg(
        F.count("*").alias("n_sections"),
        F.coalesce(F.sum("aligned_count"), F.lit(0)).alias("aligned_count"),
        F.coalesce(F.sum("missing_count"), F.lit(0)).alias("missing_count"),
        F.coalesce(F.try_divide(F.sum("aligned_count"), F.sum("asset_count")), F.lit(0.0)).alias("coverage_ratio"),
        F.avg("pearson").alias("coefficient_mean"),
        F.stddev_samp("pearson").alias("coefficient_sample_std"),
        F.when(F.count("*") > 0, "OK").otherwise("UNDEFINED").alias("status"),
    )
    return points, summary


def coefficient_at(df: DataFrame, samples: str, section: str, at, factor: str, ret: str) -> DataFrame:
    """The Pearson coefficient of the first sample (smallest `samples`) with that factor date; no row if there is none."""
    hit = df.filter(F.col(section) == at)
    first = hit.agg(F.min(samples).alias(samples))
    return ic(hit.join(F.broadcast(first), samples, "left_semi"), [section], factor, ret)


def weighted_forward_return(df: DataFrame, section: list[str], ret: str, weight: str) -> DataFrame:
    """Per section the weighted mean of defined returns with positive weight, and how many were and were not defined."""
    ok = F.col(ret).isNotNull() & F.coalesce(F.col(weight) > 0, F.lit(False))
    w = F.sum(F.when(ok, F.col(weight)))
    value = F.try_divide(F.sum(F.when(ok, F.col(weight) * F.col(ret))), F.when(w > 0, w))
    return df.groupBy(*section).agg(F.count(ret).alias("aligned_count"), F.count_if(F.col(ret).isNull()).alias("missing_count"), value.alias("weighted_return")).withColumn("status", F.when(F.col("weighted_return").isNull(), "UNDEFINED").otherwise("OK"))
