"""Volatility, drawdown, tracking error, beta, covariance contributions, concentration."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


MATRIX_ASSETS = 5_000


def _annual(a: float) -> float:
    if not 0 < a <= 366:
        raise ValueError("annualisation.range")
    return a


def volatility(r: str, a: float) -> Column:
    """Aggregate: sqrt(sample variance * a), null for fewer than two."""
    return F.sqrt(F.var_samp(r) * _annual(a))


def tracking_error(p: str, b: str, a: float) -> Column:
    return F.sqrt(F.var_samp(F.col(p) - F.col(b)) * _annual(a))


def beta(p: str, b: str) -> Column:
    """Aggregate over pairs: sample covariance over benchmark variance, null without benchmark dispersion."""
    both = F.col(p).isNotNull() & F.col(b).isNotNull()
    x, y = F.when(both, F.col(p)), F.when(both, F.col(b))
    return F.try_divide(F.covar_samp(x, y), F.when(F.var_samp(y) > 0, F.var_samp(y)))


def max_drawdown(df: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """Largest fall from a running peak, 1 - v / peak; only positive values count."""
    peak = F.max(value).over(Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, 0))
    return df.filter(F.col(value) > 0).withColumn("_d", 1 - F.col(value) / peak).groupBy(*keys).agg(F.max("_d").alias("max_drawdown"))


def covariance_coo(df: DataFrame, section: str, asset: str, value: str) -> DataFrame:
    """Sample covariances as (i, j, v) over shared sections. The matrix has a row for each pair of assets, so assets are the
    small dimension: over MATRIX_ASSETS of them is an error (for contributions alone see panel_contributions())."""
    if df.select(asset).distinct().limit(MATRIX_ASSETS + 1).count() > MATRIX_ASSETS:
        raise ValueError("matrix.assets")
    a = df.select(section, F.col(asset).alias("i"), F.col(value).alias("x"))
    b = df.select(section, F.col(asset).alias("j"), F.col(value).alias("y"))
    return a.join(b, section).groupBy("i", "j").agg(F.covar_samp("x", "y").alias("v"))


def covariance_contributions(cov: DataFrame, weights: DataFrame) -> DataFrame:
    """Marginal (Sigma w), component w * (Sigma w), and its share of volatility; weights: (i, w)."""
    m = cov.join(weights.select(F.col("i").alias("j"), F.col("w").alias("_wj")), "j").groupBy("i").agg(F.sum(F.col("v") * F.col("_wj")).alias("marginal"))
    c = m.join(weights, "i").withColumn("component", F.col("w") * F.col("marginal"))
    total = F.sum("component").over(Window.partitionBy())
    return c.withColumn("variance", total).withColumn("component_vol", F.try_divide(F.col("component"), F.when(total > 0, F.sqrt(F.when(total > 0, total))))).select("i", "w", "marginal", "component", "component_vol", "variance")


def panel_contributions(df: DataFrame, weights: DataFrame, section: str, asset: str, value: str) -> DataFrame:
    """covariance_contributions() of a complete panel without its matrix, linear in the rows: an asset's marginal is its
    covariance with the weighted sum of all. weights: (i, w). Assets that lack a section have status INCOMPLETE, no figures,
    and no part in the sum."""
    sections = df.filter(F.col(value).isNotNull()).agg(F.count_distinct(section).alias("_all"))
    whole = df.groupBy(F.col(asset).alias("i")).agg(F.count(value).alias("_n")).crossJoin(F.broadcast(sections)).select("i", (F.col("_n") == F.col("_all")).alias("_whole"))  # one row
    rows = df.select(F.col(asset).alias("i"), F.col(section).alias("_s"), F.col(value).alias("_x")).join(whole.filter("_whole"), "i").join(weights, "i")
    total = rows.groupBy("_s").agg(F.sum(F.col("w") * F.col("_x")).alias("_p"))
    m = rows.join(total, "_s").groupBy("i", "w").agg(F.covar_samp("_x", "_p").alias("marginal"))
    c = whole.join(m, "i", "left").withColumn("component", F.col("w") * F.col("marginal"))
    variance = m.agg(F.sum(F.col("w") * F.col("marginal")).alias("variance"))
    c = c.crossJoin(F.broadcast(variance))  # one row
    return c.select("i", "w", "marginal", "component", F.try_divide(F.col("component"), F.when(F.col("variance") > 0, F.sqrt(F.when(F.col("variance") > 0, F.col("variance"))))).alias("component_vol"), "variance", F.when(F.col("_whole"), "OK").otherwise("INCOMPLETE").alias("status"))


def symmetry(cov: DataFrame, key: str, tolerance: float = 1e-12) -> DataFrame:
    """Per matrix (key, i, j, v): the number of its assets, and whether it is whole and symmetric, by a join of (i, j) with
    (j, i)."""
    t = cov.select(F.col(key).alias("_k"), F.col("j").alias("_i"), F.col("i").alias("_j"), F.col("v").alias("_t"))
    both = cov.join(t, (F.col(key) == F.col("_k")) & (F.col("i") == F.col("_i")) & (F.col("j") == F.col("_j")), "left")
    g = both.groupBy(key).agg(F.count_distinct("i").alias("n"), F.count("*").alias("cells"), F.min(F.coalesce(F.abs(F.col("v") - F.col("_t")) <= tolerance, F.lit(False))).alias("same"))
    return g.select(key, F.col("n").cast("int").alias("n_assets"), (F.col("same") & (F.col("cells") == F.col("n") * F.col("n"))).alias("symmetric"))


def psd_check(cov: DataFrame, key: str, tolerance: float = 1e-12) -> DataFrame:
    """Per matrix: symmetric, smallest eigenvalue, and whether it is >= -tolerance * max(1, largest of the diagonal). cov: (key, i, j, v).

    Eigenvalues need a matrix whole in one task; one of over MATRIX_ASSETS assets is an error."""
    if cov.select(key, "i").distinct().groupBy(key).count().filter(F.col("count") > MATRIX_ASSETS).limit(1).count():
        raise ValueError("matrix.assets")

    def check(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.pivot(index="i", columns="j", values="v").sort_index(axis=0).sort_index(axis=1)
        a = m.to_numpy(dtype=float)
        whole = a.shape[0] == a.shape[1] and not np.isnan(a).any()
        sym = bool(whole and np.allclose(a, a.T, rtol=0, atol=tolerance))
        low = float(np.linalg.eigvalsh((a + a.T) / 2)[0]) if sym else None
        return pd.DataFrame({key: [pdf[key].iloc[0]], "n_assets": [len(m)], "symmetric": [sym], "min_eigenvalue": [low], "psd": [bool(sym and low >= -tolerance * max(1.0, float(np.abs(np.diag(a)).max())))]})

    return cov.groupBy(key).applyInPandas(check, f"{key} {cov.schema[key].dataType.simpleString()}, n_assets int, symmetric boolean, min_eigenvalue double, psd boolean")


def concentration(df: DataFrame, dims: list[str], value: str = "value") -> DataFrame:
    """Shares of the total by each dimension's values, in one pass; unclassified assets are left out of a dimension."""
    sets = df.select(F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("member")) for d in dims])).alias("s"), value).select("s.*", value)
    total = df.agg(F.sum(value).alias("_total"))
    return sets.filter("member is not null").groupBy("dimension", "member").agg(F.sum(value).alias("_v")).crossJoin(F.broadcast(total)).select("dimension", "member", (F.col("_v").cast("double") / F.col("_total").cast("double")).alias("share"))


def top_k_share(df: DataFrame, k: int, asset: str = "asset_id", value: str = "value") -> Column | DataFrame:
    """Share of the k largest holdings (ties to the smaller asset id)."""
    top = df.orderBy(F.col(value).desc(), asset).limit(k).agg(F.sum(value).alias("_top"))
    return top.crossJoin(df.agg(F.sum(value).alias("_total"))).select((F.col("_top").cast("double") / F.col("_total").cast("double")).alias(f"top_{k}"))
