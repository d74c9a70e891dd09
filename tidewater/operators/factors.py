"""Factor transformations over series (per asset) and sections (per date), and point-in-time factor inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scale import broadcast_if_small
from .temporal import asof_join

#: The accepted transformations and bounds of a factor definition.
TRANSFORMATIONS = ("lag", "simple_return", "log_return", "difference", "ratio", "rolling_mean", "rolling_std", "rank", "winsorize", "zscore", "neutralize", "identity")
MAX_FIELDS, MAX_TRANSFORMATIONS, MAX_WINDOW = 64, 32, 2520


def definition_errors(fields: list[str], window: int, transformations: list[dict]) -> list[str]:
    """All codes that apply, sorted."""
    bad = set()
    if not 1 <= len(fields) <= MAX_FIELDS:
        bad.add("fields.count")
    if len(set(fields)) != len(fields) or any(not f.strip() for f in fields):
        bad.add("fields.names")
    if not 1 <= window <= MAX_WINDOW:
        bad.add("window.range")
    if len(transformations) > MAX_TRANSFORMATIONS:
        bad.add("transformations.count")
    for t in transformations:
        if t.get("kind") not in TRANSFORMATIONS:
            bad.add("transformations.kind")
        if t.get("kind") == "winsorize" and not 0 <= t.get("lower", 0) < t.get("upper", 1) <= 1:
            bad.add("transformations.winsorize")
    return sorted(bad)


def series(asset: str, at: str):
    return Window.partitionBy(asset).orderBy(at)


def lag(x: str, asset: str, at: str, n: int = 1) -> Column:
    return F.lag(x, n).over(series(asset, at))


def simple_return(x: str, asset: str, at: str, n: int = 1) -> Column:
    return F.try_divide(F.col(x), lag(x, asset, at, n)) - 1


def log_return(x: str, asset: str, at: str, n: int = 1) -> Column:
    q = F.try_divide(F.col(x), lag(x, asset, at, n))
    return F.when(q > 0, F.ln(F.when(q > 0, q)))


def difference(x: str, asset: str, at: str, n: int = 1) -> Column:
    return F.col(x) - lag(x, asset, at, n)


def ratio(x: str, y: str) -> Column:
    return F.try_divide(F.col(x), F.col(y))


def rolling(x: str, asset: str, at: str, window: int, how: str) -> Column:
    """Mean or sample deviation of the last `window` observations, null until there are as many."""
    w = series(asset, at).rowsBetween(-(window - 1), 0)
    f = F.avg if how == "mean" else F.stddev_samp
    return F.when(F.count(x).over(w) == window, f(x).over(w))


def winsorize(df: DataFrame, section: list[str], x: str, lower: float, upper: float, out: str) -> DataFrame:
    """Clamp to the order statistics at floor(q * (n - 1)) + 1 (one-based) of the section's non-null values. Each section's
    values are gathered once (the assets of a date); see winsorize_large() for sections without a bound."""
    xs = F.sort_array(F.collect_list(x))
    at = lambda q: F.get(xs, F.floor(F.lit(q) * (F.count(x) - 1)).cast("int"))
    return _clamped(df, df.groupBy(*section).agg(at(lower).alias("_lo"), at(upper).alias("_hi")), section, x, out)


def _clamped(df: DataFrame, bounds: DataFrame, section: list[str], x: str, out: str) -> DataFrame:
    b = bounds.select(*[F.col(c).alias(f"_k_{c}") for c in section], "_lo", "_hi")
    same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in section]
    value = F.when(F.col(x).isNotNull(), F.least(F.greatest(F.col(x), F.col("_lo")), F.col("_hi")))
    return df.join(b, same, "left").withColumn(out, value).drop("_lo", "_hi", *[f"_k_{c}" for c in section])


def winsorize_large(df: DataFrame, section: list[str], x: str, lower: float, upper: float, out: str, ranges: int = 64) -> DataFrame:
    """winsorize() for sections of any size. Approximate quantiles cut a section into ranges of values; counts tell in which
    range an order statistic lies, and only the distinct values of that range are put in order."""
    some = df.filter(F.col(x).isNotNull()).select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"_s{i}") for i, c in enumerate(section)], *[F.col(c).isNull().alias(f"_z{i}") for i, c in enumerate(section)], F.col(x).alias("_x"))
    keys = [f"_s{i}" for i in range(len(section))] + [f"_z{i}" for i in range(len(section))]
    counts = some.groupBy(*keys, "_x").agg(F.count("*").alias("_n"))
    cuts = some.groupBy(*keys).agg(F.count("*").alias("_all"), F.percentile_approx("_x", [i / ranges for i in range(1, ranges)], 1000).alias("_cuts"))
    dealt = counts.join(cuts, keys).withColumn("_b", F.aggregate("_cuts", F.lit(0), lambda acc, c: acc + (c < F.col("_x")).cast("int"))).drop("_cuts")
    sizes = dealt.groupBy(*keys, "_all", "_b").agg(F.sum("_n").alias("_size"))
    upto = F.sum("_size").over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))
    places = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), (F.floor(F.lit(q) * (F.col("_all") - 1)) + 1).alias("r")) for i, q in enumerate((lower, upper))]))
    hit = sizes.withColumn("_upto", upto).withColumn("_p", places).filter((F.col("_p.r") <= F.col("_upto")) & (F.col("_p.r") > F.col("_upto") - F.col("_size"))).select(*keys, "_b", F.col("_p.i").alias("_i"), (F.col("_p.r") - F.col("_upto") + F.col("_size")).alias("_rank"))
    inside = dealt.join(hit, [*keys, "_b"]).withColumn("_cum", F.sum("_n").over(Window.partitionBy(*keys, "_i").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)))
    found = inside.filter(F.col("_cum") >= F.col("_rank")).groupBy(*keys).agg(F.min(F.when(F.col("_i") == 0, F.col("_x"))).alias("_lo"), F.min(F.when(F.col("_i") == 1, F.col("_x"))).alias("_hi"))
    tagged = df.withColumns({f"_s{i}": F.coalesce(F.col(c).cast("string"), F.lit("")) for i, c in enumerate(section)} | {f"_z{i}": F.col(c).isNull() for i, c in enumerate(section)})
    return _clamped(tagged, found, keys, x, out).drop(*keys)


def zscore(x: str, section: list[str]) -> Column:
    """Population deviation; the section is undefined with fewer than two values or no dispersion."""
    every = Window.partitionBy(*section)
    sd = F.stddev_pop(x).over(every)
    return F.when((F.count(x).over(every) >= 2) & (sd > 0), F.try_divide(F.col(x) - F.avg(x).over(every), sd))


def neutralize(df: DataFrame, section: list[str], y: str, x: str, out: str = "residual") -> DataFrame:
    """Residual of y on one exposure x and a constant, per section (closed form); undefined if x has no dispersion."""
    every = Window.partitionBy(*section)
    ok = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    var = F.var_pop(x).over(every)
    beta = F.try_divide(F.covar_pop(x, y).over(every), F.when(var > 0, var))
    return ok.withColumn(out, F.col(y) - F.avg(y).over(every) - beta * (F.col(x) - F.avg(x).over(every)))


def neutralize_many(df: DataFrame, section: list[str], asset: str, y: str, xs: list[str]) -> DataFrame:
    """Residuals on several exposures and a constant; null if the design's rank is deficient.

    Each section's covariances are sums, so they are aggregated where the rows are; the normal equations of the standardised
    exposures are solved by Cholesky factors, one column for each of their entries. A pivot of 1e-10 or less (of an exposure's
    own dispersion) says that it depends on those before it."""
    k, ok = len(xs), df.dropna(subset=[y, *xs]).select(*section, asset, F.col(y).cast("double").alias("_y"), *(F.col(x).cast("double").alias(f"_x{i}") for i, x in enumerate(xs)))
    cov = [F.covar_pop(f"_x{i}", f"_x{j}").alias(f"s{i}_{j}") for i in range(k) for j in range(i + 1)] + [F.covar_pop(f"_x{i}", "_y").alias(f"c{i}") for i in range(k)]
    g = ok.groupBy(*section).agg(F.count("*").alias("_n"), F.avg("_y").alias("my"), *(F.avg(f"_x{i}").alias(f"m{i}") for i in range(k)), *cov)
    c = F.col
    g = g.withColumns({f"d{i}": F.sqrt(F.when(c(f"s{i}_{i}") > 0, c(f"s{i}_{i}"))) for i in range(k)})
    for j in range(k):  # the factor's columns, one after the other
        pivot = F.lit(1.0)
        for h in range(j):
            pivot = pivot - c(f"l{j}_{h}") * c(f"l{j}_{h}")
        g = g.withColumn(f"l{j}_{j}", F.sqrt(F.when(pivot > 1e-10, pivot)))
        for i in range(j + 1, k):
            rest = F.try_divide(c(f"s{i}_{j}"), c(f"d{i}") * c(f"d{j}"))
            for h in range(j):
                rest = rest - c(f"l{i}_{h}") * c(f"l{j}_{h}")
            g = g.withColumn(f"l{i}_{j}", rest / c(f"l{j}_{j}"))
    for i in range(k):
        rest = F.try_divide(c(f"c{i}"), c(f"d{i}"))
        for h in range(i):
            rest = rest - c(f"l{i}_{h}") * c(f"z{h}")
        g = g.withColumn(f"z{i}", rest / c(f"l{i}_{i}"))
    for i in reversed(range(k)):
        rest = c(f"z{i}")
        for h in range(i + 1, k):
            rest = rest - c(f"l{h}_{i}") * c(f"b{h}")
        g = g.withColumn(f"b{i}", rest / c(f"l{i}_{i}"))
    g = g.select(*(c(x).alias(f"_k_{x}") for x in section), "_n", "my", *(c(f"m{i}") for i in range(k)), *((c(f"b{i}") / c(f"d{i}")).alias(f"b{i}") for i in range(k)))
    residual = c("_y") - c("my")
    for i in range(k):
        residual = residual - c(f"b{i}") * (c(f"_x{i}") - c(f"m{i}"))
    same = [c(x).eqNullSafe(c(f"_k_{x}")) for x in section]
    return ok.join(g, same).select(*section, asset, F.when(c("_n") > k, residual).alias("residual"))


def point_in_time(inputs: DataFrame, decisions: DataFrame, asset: str, fields: list[str], depth: int = 8) -> DataFrame:
    """Per decision, asset and field the latest observation on or before the factor date that was available at the
    decision; MISSING where there is none. decisions: decision_id, factor_date, decision_at.

    One window per asset and field over the union of inputs and decisions, by observation date: a decision looks at the
    `depth` inputs before it, latest first, and takes the first one that was available. Where none of them was and there
    are more, latest_available() looks in all inputs of that asset and field, in n log n.
    """
    keys = [asset, "field_name"]
    used = inputs.filter(F.col("field_name").isin(fields))
    d = broadcast_if_small(decisions.select("decision_id", "factor_date", "decision_at"))
    wanted = inputs.select(asset).distinct().crossJoin(d).withColumn("field_name", F.explode(F.array(*map(F.lit, fields))))  # the result's rows
    kind = used.select(F.struct("observation_date", "available_at", "input_version_id", "value").alias("i")).schema["i"].dataType
    i = used.select(*keys, F.col("observation_date").alias("_t"), F.lit(0).alias("_side"), F.struct("observation_date", "available_at", "input_version_id", "value").alias("_i"), F.lit(None).cast(wanted.schema["decision_id"].dataType).alias("decision_id"), F.lit(None).cast("date").alias("factor_date"), F.lit(None).cast(wanted.schema["decision_at"].dataType).alias("decision_at"))
    p = wanted.select(*keys, F.col("factor_date").alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(kind).alias("_i"), "decision_id", "factor_date", "decision_at")
    w = Window.partitionBy(*keys).orderBy("_t", "_side", "_i")
    both = i.unionByName(p).withColumn("_place", F.sum(1 - F.col("_side")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # Inputs in their order, each with those just before it; a decision takes those of the last input before it.
    near = F.collect_list("_i").over(Window.partitionBy(*keys, "_side").orderBy("_place").rowsBetween(-(depth - 1), 0))
    both = both.withColumn("_near", F.when(F.col("_side") == 0, near))
    seen = both.withColumn("_near", F.last("_near", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("_side = 1")
    first = F.try_element_at(F.filter("_near", lambda x: x["available_at"] <= F.col("decision_at")), F.lit(-1))
    seen = seen.withColumn("_best", first)
    unclear = F.col("_best").isNull() & (F.col("_place") > depth)
    done = seen.filter(~unclear).select("decision_id", *keys, "_best")
    rest = seen.filter(unclear).select("decision_id", *keys, "factor_date", "decision_at")
    late = used.join(rest.select(*keys).distinct(), keys, "left_semi")
    all_rows = done.unionByName(latest_available(rest, late, keys).select("decision_id", *keys, "_best"))
    return all_rows.select("decision_id", *keys, "_best.*").withColumn("status", F.when(F.col("value").isNull(), "MISSING").otherwise("OK"))


def latest_available(decisions: DataFrame, inputs: DataFrame, keys: list[str]) -> DataFrame:
    """Each decision (decision_id, keys, factor_date, decision_at) with _best, its latest input (observation_date,
    available_at, input_version_id, value) observed by the factor date and available by the decision; null if none is.

    Of a key's inputs in the order of their availability, a decision may see the first c. These make up one block of 2 ** level
    inputs for each bit of c, and an input lies in one block of each level; so each decision asks as many as-of lookups by
    observation date as c has bits, and the latest of their answers counts. Rows grow by the logarithm of a key's inputs,
    however many of them came late.
    """
    i = inputs.select(*keys, F.col("available_at").alias("_t"), F.lit(0).alias("_side"), F.struct("observation_date", "available_at", "input_version_id", "value").alias("_i"))
    d = decisions.select(*keys, F.col("decision_at").alias("_t"), F.lit(1).alias("_side"), F.struct("decision_id", "factor_date", "decision_at").alias("_d"))
    both = i.unionByName(d, allowMissingColumns=True).withColumn("_c", F.sum(1 - F.col("_side")).over(Window.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)))
    levels = F.sequence(F.lit(0), F.lit(40))
    shift = lambda c, level: F.call_function("shiftright", c, level)
    both = both.withColumn("_top", F.floor(F.log2(F.greatest(F.max("_c").over(Window.partitionBy(*keys)), F.lit(1)).cast("double"))).cast("int"))
    held = both.filter("_side = 0").select(*keys, F.col("_i.observation_date").alias("_on"), "_i", F.explode(F.sequence(F.lit(0), "_top")).alias("_level"), F.col("_c"))
    held = held.withColumn("_block", shift(F.col("_c") - 1, F.col("_level"))).drop("_c")
    bits = F.filter(levels, lambda level: shift(F.col("_c"), level) % 2 == 1)
    asked = both.filter("_side = 1").select(*keys, "_d", F.col("_d.factor_date").alias("_on"), F.explode_outer(bits).alias("_level"), "_c").withColumn("_block", shift(F.col("_c"), F.col("_level")) - 1).drop("_c")
    found = asof_join(asked, held, [*keys, "_level", "_block"], "_on", "_on", "_i", ["_i"])
    best = found.groupBy(*keys, "_d").agg(F.max("_i").alias("_best"))
    return best.select("_d.*", *keys, "_best")


def adjust_prices(prices: DataFrame, factors: DataFrame, asset: str, at: str, price: str, mode: str) -> DataFrame:
    """Backward: price * f; forward: price * f / last f; unadjusted: as is. One factor per date within [1e-12, 1e12], or
    the whole series is rejected (null, status REJECTED) and each of its rows says in `fault` what is wrong with its own date:
    missing, repeated or out-of-range (null where nothing is)."""
    if mode == "unadjusted":
        return prices.withColumn("adjusted", F.col(price)).withColumn("status", F.lit("OK")).withColumn("fault", F.lit(None).cast("string"))
    f = factors.groupBy(asset, at).agg(F.count("*").alias("_n"), F.max("factor").alias("_f"))
    every = Window.partitionBy(asset)
    j = prices.join(f, [asset, at], "left")
    fault = F.when(F.col("_n").isNull() | F.col("_f").isNull(), "missing").when(F.col("_n") != 1, "repeated").when(~F.col("_f").between(1e-12, 1e12), "out-of-range")
    j = j.withColumn("fault", fault)
    bad = F.max(F.when(F.col("fault").isNotNull(), 1).otherwise(0)).over(every)
    base = F.max_by("_f", at).over(every) if mode == "forward" else F.lit(1.0)
    return j.withColumn("_bad", bad).withColumn("_base", base).withColumn("adjusted", F.when(F.col("_bad") == 0, F.col(price) * F.try_divide(F.col("_f"), F.col("_base")))).withColumn("status", F.when(F.col("_bad") == 0, "OK").otherwise("REJECTED")).drop("_n", "_f", "_bad", "_base")
