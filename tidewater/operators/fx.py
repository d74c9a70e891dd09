"""Currency conversion with bounded look-back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .temporal import asof_join

LOOKBACK_DAYS = 4  # the day itself and four before it


def with_inverses(rates: DataFrame) -> DataFrame:
    """Direct rates and their reciprocals, which name the version they come from."""
    inverse = rates.select(F.col("target_currency").alias("source_currency"), F.col("source_currency").alias("target_currency"), "rate_date", F.try_divide(F.lit(1.0), F.col("rate")).alias("rate"), F.concat("version_id", F.lit("-INVERSE")).alias("version_id"), F.col("version_id").alias("direct_version_id"))
    return rates.withColumn("direct_version_id", F.lit(None).cast("string")).unionByName(inverse)


def inverse_check(direct: DataFrame, supplied: DataFrame, tolerance: float = 1e-10) -> DataFrame:
    """Each direct rate with the inverse that was supplied for it (direct_version_id): ok if the product is 1 within the
    tolerance and the pair and date are its own, else mismatch; missing without one."""
    i = supplied.select(F.col("direct_version_id").alias("version_id"), F.col("rate").alias("_inverse"), F.col("source_currency").alias("_s"), F.col("target_currency").alias("_t"), F.col("rate_date").alias("_d"))
    j = direct.join(i, "version_id", "left")
    same = (F.col("_s") == F.col("target_currency")) & (F.col("_t") == F.col("source_currency")) & (F.col("_d") == F.col("rate_date"))
    good = F.coalesce(same & (F.abs(F.col("rate") * F.col("_inverse") - 1) <= tolerance), F.lit(False))
    return j.withColumn("status", F.when(F.col("_inverse").isNull(), "missing").when(good, "ok").otherwise("mismatch")).drop("_inverse", "_s", "_t", "_d")


def convert(values: DataFrame, rates: DataFrame, policy: str = "FALLBACK") -> DataFrame:
    """values: source_currency, target_currency, at (date), amount. EXACT_DATE takes that day's rate only, FALLBACK the
    latest of that day and the four before it. Equal currencies convert at 1; a non-positive amount is invalid."""
    r = rates.select("source_currency", "target_currency", "rate_date", "rate", "version_id")
    got = asof_join(values, r, ["source_currency", "target_currency"], "at", "rate_date", "version_id", ["rate", "rate_date", "version_id"], within_days=0 if policy == "EXACT_DATE" else LOOKBACK_DAYS)
    same = F.col("source_currency") == F.col("target_currency")
    rate = F.when(same, F.lit(1.0)).otherwise(F.col("rate"))
    status = F.when(F.col("amount") <= 0, "invalid-value").when(same, "identity").when(F.col("rate").isNull(), "unavailable").otherwise("converted")
    return got.withColumn("status", status).withColumn("converted", F.when(F.col("status").isin("identity", "converted"), F.col("amount") * rate)).withColumn("rate_date", F.when(F.col("status") == "converted", F.col("rate_date"))).withColumn("version_id", F.when(F.col("status") == "converted", F.col("version_id"))).drop("rate")
