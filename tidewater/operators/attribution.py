"""Returns and performance attribution."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def modified_dietz(periods: DataFrame, flows: DataFrame, key: str) -> DataFrame:
    """periods: key, start_at, end_at, start_value, end_value (dates); flows: key, flow_at, amount.

    (E - S - sum F) / (S + sum F * (1 - elapsed share)); null if start >= end, a flow lies after the end, or the
    denominator isn't positive.
    """
    j = periods.join(flows, key, "left")
    span = F.date_diff("end_at", "start_at")
    weight = F.lit(1.0) - F.try_divide(F.date_diff("flow_at", "start_at").cast("double"), span.cast("double"))
    g = j.groupBy(key, "start_at", "end_at", "start_value", "end_value").agg(F.coalesce(F.sum("amount"), F.lit(0.0)).alias("_f"), F.coalesce(F.sum(F.col("amount") * weight), F.lit(0.0)).alias("_wf"), F.max("flow_at").alias("_last"))
    den = F.col("start_value") + F.col("_wf")
    ok = (F.col("start_at") < F.col("end_at")) & (F.col("_last").isNull() | (F.col("_last") <= F.col("end_at"))) & (den > 0)
    return g.select(key, F.when(ok, F.try_divide(F.col("end_value") - F.col("start_value") - F.col("_f"), den)).alias("period_return"))


def period_attribution(weights: DataFrame, returns: DataFrame, totals: DataFrame, key: str, asset: str) -> DataFrame:
    """Asset contributions, cash and cost effects and the residual. totals: key, total_return, cash_effect, cost."""
    s = weights.join(returns, [key, asset]).groupBy(key).agg(F.sum(F.col("weight") * F.col("asset_return")).alias("asset_effect"))
    return totals.join(s, key, "left").withColumn("asset_effect", F.coalesce("asset_effect", F.lit(0.0))).withColumn("cost_drag", -F.col("cost")).withColumn("residual", F.col("total_return") - F.col("asset_effect") - F.col("cash_effect") - F.col("cost_drag")).select(key, "asset_effect", "cash_effect", "cost_drag", "residual", "total_return")


def brinson_fachler(groups: DataFrame, key: list[str]) -> DataFrame:
    """groups: key..., grp, wp, wb, rp, rb -> allocation, selection, interaction per group, and the residual per key."""
    every = Window.partitionBy(*key)
    big_p, big_b = F.sum(F.col("wp") * F.col("rp")).over(every), F.sum(F.col("wb") * F.col("rb")).over(every)
    g = groups.withColumn("_p", big_p).withColumn("_b", big_b)
    g = g.withColumn("allocation", (F.col("wp") - F.col("wb")) * (F.col("rb") - F.col("_b"))).withColumn("selection", F.col("wb") * (F.col("rp") - F.col("rb"))).withColumn("interaction", (F.col("wp") - F.col("wb")) * (F.col("rp") - F.col("rb")))
    parts = F.sum(F.col("allocation") + F.col("selection") + F.col("interaction")).over(every)
    return g.withColumn("residual", F.col("_p") - F.col("_b") - parts).drop("_p", "_b")


def local_fx_effect(df: DataFrame) -> DataFrame:
    """start/end local value and rate -> local return, FX return, total, and the effects (1 + l)(1 + f) - 1 = l + f + l f."""
    local = F.try_divide(F.col("end_value"), F.col("start_value")) - 1
    fx = F.try_divide(F.col("end_rate"), F.col("start_rate")) - 1
    return df.withColumn("local_return", local).withColumn("fx_return", fx).withColumn("total_return", (1 + F.col("local_return")) * (1 + F.col("fx_return")) - 1).withColumn("cross_effect", F.col("local_return") * F.col("fx_return"))


def linked_contributions(df: DataFrame, key: list[str], component: str, at: str) -> DataFrame:
    """L = sum_t C_t * prod_{s > t} (1 + R_s): the closed form of L_t = L_{t-1} (1 + R_t) + C_t.

    df: key..., component, at, period_return, contribution (each component in every period).
    """
    later = Window.partitionBy(*key, component).orderBy(F.col(at).desc()).rowsBetween(Window.unboundedPreceding, -1)
    growth = F.coalesce(F.product(1 + F.col("period_return")).over(later), F.lit(1.0))
    return df.withColumn("_g", growth).groupBy(*key, component).agg(F.sum(F.col("contribution") * F.col("_g")).alias("linked"))


def geometric_total(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg((F.product(1 + F.col("period_return")) - 1).alias("total_return"))
