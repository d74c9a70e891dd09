"""Factor evaluation over monthly bars: factor = the month's return, outcome = the next month's."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import factors as X
from ..operators import trading
from ..tables import bars, nav, observations, with_views
from .registry import query

_S = ["bar_date"]


def panel(spark, sf_dir):
    """asset_id, bar_date, factor (close / open - 1), ret (next close / close - 1), weight, close, open."""
    b = bars(spark, sf_dir)
    nxt = F.lead("close").over(Window.partitionBy("asset_id").orderBy("bar_date"))
    return b.select("asset_id", "bar_date", (F.col("close") / F.col("open") - 1).alias("factor"), (nxt / F.col("close") - 1).alias("ret"), F.col("volume").alias("weight"), "close", "open")


_P = with_views("bars") + """,
panel AS (SELECT asset_id, bar_date, close / open - 1 AS factor, lead(close) OVER (PARTITION BY asset_id ORDER BY bar_date) / close - 1 AS ret, volume AS weight, close, open FROM bars)"""
_RANK = "rank() OVER (PARTITION BY {s} ORDER BY {x}) + (count(*) OVER (PARTITION BY {s}, {x}) - 1) / 2.0"
_CORR = "CASE WHEN count(*) >= 2 AND var_pop({x}) * var_pop({y}) > 0 THEN covar_pop({x}, {y}) / sqrt(var_pop({x}) * var_pop({y})) END"
_PAIRS = _P + ", pairs AS (SELECT * FROM panel WHERE factor IS NOT NULL AND ret IS NOT NULL)"
_RANKED = _PAIRS + f", ranked AS (SELECT *, {_RANK.format(s='bar_date', x='factor')} AS rf, {_RANK.format(s='bar_date', x='ret')} AS rr FROM pairs)"
_Q = _P + """, q AS (SELECT *, row_number() OVER (PARTITION BY bar_date ORDER BY factor, asset_id) AS r, count(*) OVER (PARTITION BY bar_date) AS n FROM panel WHERE factor IS NOT NULL),
d AS (SELECT bar_date, count(DISTINCT factor) AS d FROM panel GROUP BY 1),
g AS (SELECT q.*, CASE WHEN d >= 5 THEN least(5, (r - 1) * 5 // n + 1)::INTEGER END AS quantile, CASE WHEN d >= 5 THEN 'OK' ELSE 'UNDEFINED' END AS status FROM q JOIN d USING (bar_date))"""


@query(with_views("bars") + " SELECT asset_id, bar_date, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume, turnover, n_trades FROM bars")
def ohlc_bars_monthly(spark, sf_dir):
    b = bars(spark, sf_dir)
    return b.select("asset_id", "bar_date", *[F.round(c, 6).alias(c) for c in ("open", "high", "low", "close")], "volume", "turnover", "n_trades")


@query(_RANKED + " SELECT asset_id, bar_date, rf::DOUBLE AS factor_rank FROM ranked")
def average_ranks(spark, sf_dir):
    p = panel(spark, sf_dir).filter("factor is not null and ret is not null")
    return p.select("asset_id", "bar_date", E.average_rank("factor", _S).cast("double").alias("factor_rank"))


@query(_PAIRS + f" SELECT bar_date, count(*) AS n_pairs, round({_CORR.format(x='factor', y='ret')}, 8) AS ic FROM pairs GROUP BY 1")
def ic_pearson(spark, sf_dir):
    return E.ic(panel(spark, sf_dir), _S, "factor", "ret").withColumn("ic", F.round("ic", 8))


@query(_RANKED + f" SELECT bar_date, count(*) AS n_pairs, round({_CORR.format(x='rf', y='rr')}, 8) AS ic FROM ranked GROUP BY 1")
def ic_spearman(spark, sf_dir):
    return E.ic(panel(spark, sf_dir), _S, "factor", "ret", "spearman").withColumn("ic", F.round("ic", 8))


@query(_PAIRS + f", c AS (SELECT bar_date, {_CORR.format(x='factor', y='ret')} AS ic FROM pairs GROUP BY 1) SELECT count(*) AS n_sections, round(avg(ic), 8) AS ic_mean, round(stddev_samp(ic), 8) AS ic_std FROM c WHERE ic IS NOT NULL")
def ic_summary(spark, sf_dir):
    return E.ic_summary(E.ic(panel(spark, sf_dir), _S, "factor", "ret")).select("n_sections", F.round("ic_mean", 8).alias("ic_mean"), F.round("ic_std", 8).alias("ic_std"))


@query(_PAIRS + f""", c AS (SELECT bar_date, {_CORR.format(x='factor', y='ret')} AS ic FROM pairs GROUP BY 1),
w AS (SELECT ic, pow(0.5, (row_number() OVER (ORDER BY bar_date DESC) - 1) / 12.0) AS w FROM c WHERE ic IS NOT NULL) SELECT round(sum(w * ic) / sum(w) * sqrt(12.0), 8) AS annualised_ic FROM w""")
def annualised_ic(spark, sf_dir):
    return E.annualised_ic(E.ic(panel(spark, sf_dir), _S, "factor", "ret"), "bar_date", 12.0, 12).select(F.round("annualised_ic", 8).alias("annualised_ic"))


@query(_Q + " SELECT asset_id, bar_date, quantile, status FROM g")
def quantile_allocation(spark, sf_dir):
    return E.quantile_groups(panel(spark, sf_dir), _S, "factor", "asset_id", 5).select("asset_id", "bar_date", "quantile", "status")


_QR = _Q + """, qr AS (SELECT bar_date, quantile, count(*) AS n_assets, count(*) FILTER (NOT coalesce(ret IS NOT NULL AND weight > 0, false)) AS missing_count, sum(CASE WHEN ret IS NOT NULL AND weight > 0 THEN weight * ret END) / sum(CASE WHEN ret IS NOT NULL AND weight > 0 THEN weight END) AS v FROM g WHERE quantile IS NOT NULL GROUP BY 1, 2)"""


@query(_QR + " SELECT bar_date, quantile, n_assets, missing_count, round(v, 8) AS quantile_return FROM qr")
def quantile_returns(spark, sf_dir):
    g = E.quantile_groups(panel(spark, sf_dir), _S, "factor", "asset_id", 5)
    return E.quantile_returns(g, _S, "ret", "weight").withColumn("quantile_return", F.round("quantile_return", 8))


@query(_QR + " SELECT bar_date, round(max(v) - min(v), 8) AS range_spread, round(arg_max(v, quantile) - arg_min(v, quantile), 8) AS top_bottom_spread FROM qr WHERE v IS NOT NULL GROUP BY 1")
def quantile_spread(spark, sf_dir):
    g = E.quantile_groups(panel(spark, sf_dir), _S, "factor", "asset_id", 5)
    s = E.quantile_spread(E.quantile_returns(g, _S, "ret", "weight"), _S)
    return s.select("bar_date", *[F.round(c, 8).alias(c) for c in ("range_spread", "top_bottom_spread")])


@query(with_views("bars") + """, v AS (SELECT asset_id, bar_date, close, lead(close, 3) OVER (PARTITION BY asset_id ORDER BY bar_date) AS v3 FROM bars WHERE close > 0),
d AS (SELECT DISTINCT asset_id, (bar_date + INTERVAL 14 DAY)::DATE AS decision_date FROM bars)
SELECT d.asset_id, d.decision_date, round((SELECT v3 / close - 1 FROM v WHERE v.asset_id = d.asset_id AND v.bar_date > d.decision_date ORDER BY v.bar_date LIMIT 1), 8) AS forward_return FROM d""")
def forward_returns(spark, sf_dir):
    b = bars(spark, sf_dir)
    d = b.select("asset_id", F.date_add("bar_date", 14).alias("decision_date"))
    f = E.forward_returns(d, b, ["asset_id"], "decision_date", "bar_date", "close", 3)
    return f.select("asset_id", "decision_date", F.round("forward_return", 8).alias("forward_return"))


@query(_P + """, i AS (SELECT bar_date, row_number() OVER (ORDER BY bar_date) AS i FROM (SELECT DISTINCT bar_date FROM panel)),
x AS (SELECT i, bar_date, asset_id, factor FROM panel JOIN i USING (bar_date) WHERE factor IS NOT NULL),
s AS (SELECT a.bar_date, a.asset_id, a.factor AS x, b.factor AS y FROM x a JOIN x b ON b.i + 1 = a.i AND a.asset_id = b.asset_id),
r AS (SELECT bar_date, """ + _RANK.format(s="bar_date", x="x") + " AS x, " + _RANK.format(s="bar_date", x="y") + f""" AS y FROM s)
SELECT bar_date, count(*) AS n_shared, round({_CORR.format(x='x', y='y')}, 8) AS autocorrelation FROM r GROUP BY 1""")
def rank_autocorrelation(spark, sf_dir):
    return E.rank_autocorrelation(panel(spark, sf_dir), "bar_date", "asset_id", "factor").withColumn("autocorrelation", F.round("autocorrelation", 8))


@query(_P + """, w AS (SELECT asset_id, bar_date, weight / sum(weight) OVER (PARTITION BY bar_date) AS w FROM panel),
i AS (SELECT bar_date, row_number() OVER (ORDER BY bar_date) AS i FROM (SELECT DISTINCT bar_date FROM w)), wi AS (SELECT * FROM w JOIN i USING (bar_date)),
t AS (SELECT coalesce(a.i, b.i + 1) AS i, sum(abs(coalesce(a.w, 0) - coalesce(b.w, 0))) / 2 AS t FROM wi a FULL JOIN wi b ON a.asset_id = b.asset_id AND a.i = b.i + 1 GROUP BY 1)
SELECT bar_date, round(t, 8) AS turnover FROM t JOIN i USING (i) WHERE i > 1""")
def one_way_turnover(spark, sf_dir):
    w = panel(spark, sf_dir).withColumn("w", F.col("weight") / F.sum("weight").over(Window.partitionBy("bar_date")))
    return E.turnover(w, [], "bar_date", "asset_id", "w").withColumn("turnover", F.round("turnover", 8))


@query(_P + " SELECT count(*) FILTER (factor IS NOT NULL AND ret IS NOT NULL) AS aligned, count(*) AS assets, round(count(*) FILTER (factor IS NOT NULL AND ret IS NOT NULL) / count(*), 8) AS coverage FROM panel")
def coverage_ratio(spark, sf_dir):
    return E.coverage(panel(spark, sf_dir), "factor", "ret").withColumn("coverage", F.round("coverage", 8))


_RHO = """i AS (SELECT bar_date, row_number() OVER (ORDER BY bar_date) AS i FROM (SELECT DISTINCT bar_date FROM panel)), x AS (SELECT i, bar_date, asset_id, factor FROM panel JOIN i USING (bar_date) WHERE factor IS NOT NULL),
sh AS (SELECT a.bar_date, a.asset_id, a.factor AS x, b.factor AS y FROM x a JOIN x b ON b.i + 1 = a.i AND a.asset_id = b.asset_id), sr AS (SELECT bar_date, """ + _RANK.format(s="bar_date", x="x") + " AS x, " + _RANK.format(s="bar_date", x="y") + f""" AS y FROM sh),
rho AS (SELECT bar_date, {_CORR.format(x='x', y='y')} AS rho FROM sr GROUP BY 1)"""
_TURN = """wi AS (SELECT asset_id, i, weight AS w FROM panel JOIN i USING (bar_date)),
tu AS (SELECT coalesce(a.i, b.i + 1) AS i, sum(abs(coalesce(a.w, 0) - coalesce(b.w, 0))) / 2 AS t FROM wi a FULL JOIN wi b ON a.asset_id = b.asset_id AND a.i = b.i + 1 GROUP BY 1), tt AS (SELECT bar_date, t FROM tu JOIN i USING (i) WHERE i > 1)"""
_EVAL = _QR + f""", pe AS (SELECT bar_date, {_CORR.format(x='factor', y='ret')} AS pearson FROM panel WHERE factor IS NOT NULL AND ret IS NOT NULL GROUP BY 1),
rk AS (SELECT *, {_RANK.format(s='bar_date', x='factor')} AS rf, {_RANK.format(s='bar_date', x='ret')} AS rr FROM panel WHERE factor IS NOT NULL AND ret IS NOT NULL), sp AS (SELECT bar_date, {_CORR.format(x='rf', y='rr')} AS spearman FROM rk GROUP BY 1),
qs AS (SELECT bar_date, max(v) - min(v) AS range_spread, arg_max(v, quantile) - arg_min(v, quantile) AS top_bottom_spread FROM qr WHERE v IS NOT NULL GROUP BY 1), {_RHO}, {_TURN},
n AS (SELECT bar_date, count(*) AS asset_count, count(*) FILTER (factor IS NOT NULL AND ret IS NOT NULL) AS aligned_count FROM panel GROUP BY 1)"""


def _evaluation(spark, sf_dir):
    return E.evaluate(panel(spark, sf_dir), "bar_date", "asset_id", "factor", "ret", "weight", 5)


@query(_EVAL + " SELECT bar_date, asset_count, aligned_count, asset_count - aligned_count AS missing_count, round(pearson, 8) AS pearson, round(spearman, 8) AS spearman, round(range_spread, 8) AS range_spread, round(top_bottom_spread, 8) AS top_bottom_spread, round(rho, 8) AS rank_autocorrelation, round(t, 6) AS turnover FROM n LEFT JOIN pe USING (bar_date) LEFT JOIN sp USING (bar_date) LEFT JOIN qs USING (bar_date) LEFT JOIN rho USING (bar_date) LEFT JOIN tt USING (bar_date)")
def factor_evaluation(spark, sf_dir):
    points, _ = _evaluation(spark, sf_dir)
    r = lambda c, n=8: F.round(c, n).alias(c)
    return points.select("bar_date", "asset_count", "aligned_count", "missing_count", r("pearson"), r("spearman"), r("range_spread"), r("top_bottom_spread"), r("rank_autocorrelation"), r("turnover", 6))


@query(_EVAL + " SELECT count(*) AS n_sections, sum(aligned_count)::BIGINT AS aligned_count, sum(asset_count - aligned_count)::BIGINT AS missing_count, round(sum(aligned_count) / sum(asset_count), 8) AS coverage_ratio, round(avg(pearson), 8) AS coefficient_mean, round(stddev_samp(pearson), 8) AS coefficient_sample_std, 'OK' AS status FROM n LEFT JOIN pe USING (bar_date)")
def factor_evaluation_summary(spark, sf_dir):
    _, s = _evaluation(spark, sf_dir)
    return s.select("n_sections", "aligned_count", "missing_count", *[F.round(c, 8).alias(c) for c in ("coverage_ratio", "coefficient_mean", "coefficient_sample_std")], "status")


@query(_P + f", one AS (SELECT * FROM panel WHERE bar_date = DATE '1997-03-01' AND factor IS NOT NULL AND ret IS NOT NULL) SELECT bar_date, count(*) AS n_pairs, round({_CORR.format(x='factor', y='ret')}, 8) AS ic FROM one GROUP BY 1")
def coefficient_at_date(spark, sf_dir):
    p = panel(spark, sf_dir)
    two = p.withColumn("sample", F.lit(1)).unionByName(p.withColumn("sample", F.lit(2)).withColumn("ret", -F.col("ret")))
    return E.coefficient_at(two, "sample", "bar_date", F.lit("1997-03-01").cast("date"), "factor", "ret").withColumn("ic", F.round("ic", 8))


@query(_P + " SELECT bar_date, count(ret) AS aligned_count, count(*) - count(ret) AS missing_count, round(sum(weight * ret) FILTER (weight > 10) / sum(weight) FILTER (weight > 10 AND ret IS NOT NULL), 8) AS weighted_return, CASE WHEN count(*) FILTER (weight > 10 AND ret IS NOT NULL) > 0 THEN 'OK' ELSE 'UNDEFINED' END AS status FROM panel GROUP BY 1")
def weighted_forward_return(spark, sf_dir):
    p = panel(spark, sf_dir).withColumn("weight", F.when(F.col("weight") > 10, F.col("weight")).otherwise(0.0))
    return E.weighted_forward_return(p, _S, "ret", "weight").withColumn("weighted_return", F.round("weighted_return", 8))


@query(_P + f""", e AS (SELECT min(bar_date) AS a, max(bar_date) AS b FROM panel), c AS (SELECT asset_id, sum(weight / 1000.0::DOUBLE) AS w FROM panel GROUP BY 1), l AS (SELECT asset_id, factor AS x FROM panel, e WHERE bar_date = b),
p AS (SELECT asset_id, coalesce(x, 0) AS x, coalesce(x, 0) * w AS y FROM c LEFT JOIN l USING (asset_id)), o AS (SELECT count(*) AS n_assets, {_CORR.format(x='x', y='y')} AS ic FROM p)
SELECT n_assets, round(pow(abs(1 + ic * 0.0001::DOUBLE), b - a) - 1, 8) AS annualised_ic FROM o, e""")
def decayed_annualised_ic(spark, sf_dir):
    p = panel(spark, sf_dir)
    d = E.decayed_annualised_ic(p, p.select("bar_date", "asset_id", (F.col("weight") / 1000.0).alias("weight")), 0.0001, "bar_date")
    return d.select("n_assets", F.round("annualised_ic", 8).alias("annualised_ic"))


_WIN = _P + """, b AS (SELECT bar_date, list_sort(list(factor)) AS xs, count(factor) AS n FROM panel WHERE factor IS NOT NULL GROUP BY 1)"""


@query(_WIN + " SELECT asset_id, bar_date, round(least(greatest(factor, xs[floor(0.1 * (n - 1))::INTEGER + 1]), xs[floor(0.9 * (n - 1))::INTEGER + 1]), 8) AS winsorized FROM panel JOIN b USING (bar_date)")
def winsorize(spark, sf_dir):
    return X.winsorize(panel(spark, sf_dir), _S, "factor", 0.1, 0.9, "w").select("asset_id", "bar_date", F.round("w", 8).alias("winsorized"))


@query(with_views("observations") + """, b AS (SELECT metric, list_sort(list(value)) AS xs, count(value) AS n FROM observations GROUP BY 1)
SELECT event_id, round(least(greatest(value, xs[floor(0.05 * (n - 1))::INTEGER + 1]), xs[floor(0.95 * (n - 1))::INTEGER + 1]), 6) AS winsorized FROM observations JOIN b USING (metric)""")
def winsorize_large_sections(spark, sf_dir):
    o = observations(spark, sf_dir)
    return X.winsorize_large(o, ["metric"], "value", 0.05, 0.95, "w").select("event_id", F.round("w", 6).alias("winsorized"))


@query(_P + " SELECT asset_id, bar_date, round(CASE WHEN count(factor) OVER s >= 2 AND stddev_pop(factor) OVER s > 0 THEN (factor - avg(factor) OVER s) / stddev_pop(factor) OVER s END, 6) AS z FROM panel WINDOW s AS (PARTITION BY bar_date)")
def zscore(spark, sf_dir):
    return panel(spark, sf_dir).select("asset_id", "bar_date", F.round(X.zscore("factor", _S), 6).alias("z"))


@query(with_views("bars") + """ SELECT asset_id, bar_date, round(lag(close) OVER w, 6) AS lagged, round(close / lag(close) OVER w - 1, 8) AS simple_return, round(ln(close / lag(close) OVER w), 8) AS log_return, round(close - lag(close) OVER w, 6) AS diff, round(close / open, 8) AS ratio
FROM bars WINDOW w AS (PARTITION BY asset_id ORDER BY bar_date)""")
def lag_simple_log_return(spark, sf_dir):
    a = ("close", "asset_id", "bar_date")
    return bars(spark, sf_dir).select("asset_id", "bar_date", F.round(X.lag(*a), 6).alias("lagged"), F.round(X.simple_return(*a), 8).alias("simple_return"), F.round(X.log_return(*a), 8).alias("log_return"), F.round(X.difference(*a), 6).alias("diff"), F.round(X.ratio("close", "open"), 8).alias("ratio"))


@query(with_views("bars") + """ SELECT asset_id, bar_date, round(CASE WHEN count(close) OVER w = 6 THEN avg(close) OVER w END, 6) AS rolling_mean, round(CASE WHEN count(close) OVER w = 6 THEN stddev_samp(close) OVER w END, 6) AS rolling_std
FROM bars WINDOW w AS (PARTITION BY asset_id ORDER BY bar_date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)""")
def rolling_mean_std(spark, sf_dir):
    r = lambda how: F.round(X.rolling("close", "asset_id", "bar_date", 6, how), 6).alias(f"rolling_{how}")
    return bars(spark, sf_dir).select("asset_id", "bar_date", r("mean"), r("std"))


@query(_P + """, o AS (SELECT *, avg(factor) OVER s AS mf, avg(weight) OVER s AS mw, covar_pop(weight, factor) OVER s AS c, var_pop(weight) OVER s AS v FROM panel WHERE factor IS NOT NULL AND weight IS NOT NULL WINDOW s AS (PARTITION BY bar_date))
SELECT asset_id, bar_date, round(factor - mf - CASE WHEN v > 0 THEN c / v END * (weight - mw), 8) AS residual FROM o""")
def neutralize_ols_1d(spark, sf_dir):
    return X.neutralize(panel(spark, sf_dir), _S, "factor", "weight").select("asset_id", "bar_date", F.round("residual", 8).alias("residual"))


@query(_P + """, ok AS (SELECT * FROM panel WHERE factor IS NOT NULL AND weight IS NOT NULL AND close IS NOT NULL),
d AS (SELECT asset_id, bar_date, count(*) OVER s AS n, factor - avg(factor) OVER s AS y, weight - avg(weight) OVER s AS a, close - avg(close) OVER s AS b FROM ok WINDOW s AS (PARTITION BY bar_date)),
m AS (SELECT *, sum(a * a) OVER s AS aa, sum(b * b) OVER s AS bb, sum(a * b) OVER s AS ab, sum(a * y) OVER s AS ay, sum(b * y) OVER s AS byy FROM d WINDOW s AS (PARTITION BY bar_date))
SELECT asset_id, bar_date, round(CASE WHEN n >= 3 AND aa * bb - ab * ab > 1e-9 * aa * bb THEN y - a * (ay * bb - byy * ab) / (aa * bb - ab * ab) - b * (byy * aa - ay * ab) / (aa * bb - ab * ab) END, 6) AS residual FROM m""")
def neutralize_ols_multi(spark, sf_dir):
    """Two exposures: the SQL solves the two normal equations of the deviations."""
    return X.neutralize_many(panel(spark, sf_dir), _S, "asset_id", "factor", ["weight", "close"]).select("asset_id", "bar_date", F.round("residual", 6).alias("residual"))


@query(with_views("observations") + """, d AS (SELECT 1 AS decision_id, max(logical_date) - 5 AS factor_date, max(available_at) - INTERVAL 5 DAY AS decision_at FROM observations UNION ALL SELECT 2, max(logical_date) - 27, max(available_at) - INTERVAL 27 DAY FROM observations),
vis AS (SELECT d.decision_id, o.asset_id, o.metric AS field_name, arg_max(o.value, row(o.logical_date, o.available_at, o.event_id)) AS value FROM observations o JOIN d ON o.available_at <= d.decision_at AND o.logical_date <= d.factor_date GROUP BY 1, 2, 3),
w AS (SELECT decision_id, asset_id, field_name FROM (SELECT DISTINCT asset_id FROM observations), (SELECT decision_id FROM d), (SELECT unnest(['click', 'view']) AS field_name))
SELECT w.decision_id, w.asset_id, w.field_name, round(v.value, 6) AS value, CASE WHEN v.value IS NULL THEN 'MISSING' ELSE 'OK' END AS status FROM w LEFT JOIN vis v USING (decision_id, asset_id, field_name)""")
def factor_point_in_time(spark, sf_dir):
    o = observations(spark, sf_dir).select("asset_id", F.col("metric").alias("field_name"), "value", F.col("logical_date").alias("observation_date"), "available_at", F.col("event_id").alias("input_version_id"))
    last = o.agg(F.max("observation_date").alias("d"), F.max("available_at").alias("t"))
    one = lambda i, days, back: last.select(F.lit(i).alias("decision_id"), F.date_sub("d", days).alias("factor_date"), (F.col("t") - F.expr(f"interval {back} days")).alias("decision_at"))
    got = X.point_in_time(o, one(1, 5, 5).union(one(2, 27, 27)), "asset_id", ["click", "view"])
    return got.select("decision_id", "asset_id", "field_name", F.round("value", 6).alias("value"), "status")


@query(with_views("bars") + """, f AS (SELECT asset_id, bar_date, CASE WHEN asset_id = 'Brand#11' AND bar_date = (SELECT min(bar_date) FROM bars) THEN 1e13 ELSE 1 + month(bar_date) / 100.0::DOUBLE END AS factor FROM bars),
j AS (SELECT b.asset_id, b.bar_date, b.close, f.factor, max(CASE WHEN f.factor BETWEEN 1e-12 AND 1e12 THEN 0 ELSE 1 END) OVER (PARTITION BY b.asset_id) AS bad, arg_max(f.factor, b.bar_date) OVER (PARTITION BY b.asset_id) AS last FROM bars b JOIN f USING (asset_id, bar_date))
SELECT asset_id, bar_date, round(CASE WHEN bad = 0 THEN close * factor / last END, 6) AS forward_adjusted, round(CASE WHEN bad = 0 THEN close * factor END, 6) AS backward_adjusted, CASE WHEN bad = 0 THEN 'OK' ELSE 'REJECTED' END AS status FROM j""")
def price_adjustment(spark, sf_dir):
    b = bars(spark, sf_dir).select("asset_id", "bar_date", "close")
    first = F.min("bar_date").over(Window.partitionBy())
    f = b.withColumn("_m", first).select("asset_id", "bar_date", F.when((F.col("asset_id") == "Brand#11") & (F.col("bar_date") == F.col("_m")), 1e13).otherwise(1 + F.month("bar_date") / 100.0).alias("factor"))
    fw = X.adjust_prices(b, f, "asset_id", "bar_date", "close", "forward").select("asset_id", "bar_date", F.round("adjusted", 6).alias("forward_adjusted"), "status")
    bw = X.adjust_prices(b, f, "asset_id", "bar_date", "close", "backward").select("asset_id", "bar_date", F.round("adjusted", 6).alias("backward_adjusted"))
    return fw.join(bw, ["asset_id", "bar_date"])


@query(_P + """, u AS (SELECT bar_date, asset_id, weight AS score FROM panel), t AS (SELECT *, floor(score / sum(score) OVER (PARTITION BY bar_date) * 1e12) AS w FROM u),
r AS (SELECT *, row_number() OVER (PARTITION BY bar_date ORDER BY w DESC, asset_id) AS r, sum(w) OVER (PARTITION BY bar_date) AS s FROM t)
SELECT bar_date, asset_id, ((w + CASE WHEN r = 1 THEN 1e12 - s ELSE 0 END) / 1e12)::DECIMAL(20,12)::VARCHAR AS weight FROM r""")
def score_weights(spark, sf_dir):
    return trading.score_weights(panel(spark, sf_dir), _S, "asset_id", "weight").select("bar_date", "asset_id", F.col("weight").cast("string").alias("weight"))


@query(_P + """, r AS (SELECT bar_date, asset_id, row_number() OVER (PARTITION BY bar_date ORDER BY factor DESC, asset_id) AS r, count(*) OVER (PARTITION BY bar_date) AS n FROM panel WHERE factor IS NOT NULL)
SELECT bar_date, asset_id, round(CASE WHEN least(n, 6) * 0.2::DOUBLE >= 1 - 1e-12 THEN CASE WHEN r <= 6 THEN greatest(least(0.2::DOUBLE, 1 - (r - 1) * 0.2::DOUBLE), 0) ELSE 0 END END, 8) AS weight, CASE WHEN least(n, 6) * 0.2::DOUBLE >= 1 - 1e-12 THEN 'OPTIMAL' ELSE 'INFEASIBLE' END AS status FROM r""")
def capped_optimum(spark, sf_dir):
    return trading.optimise(panel(spark, sf_dir), "bar_date", "asset_id", "factor", 0.2, 6).select("bar_date", "asset_id", F.round("weight", 8).alias("weight"), "status")


@query(_P + """, r AS (SELECT bar_date, asset_id, factor, substr(asset_id, 7, 1) AS g FROM panel WHERE factor IS NOT NULL),
c AS (SELECT *, greatest(least(0.2::DOUBLE, 0.3::DOUBLE - 0.2::DOUBLE * (row_number() OVER (PARTITION BY bar_date, g ORDER BY factor DESC, asset_id) - 1)), 0) AS cap FROM r),
n AS (SELECT *, count(*) FILTER (cap > 1e-12) OVER (PARTITION BY bar_date ORDER BY factor DESC, asset_id ROWS UNBOUNDED PRECEDING) AS k FROM c), m AS (SELECT * REPLACE (CASE WHEN k <= 8 AND cap > 1e-12 THEN cap ELSE 0 END AS cap) FROM n),
w AS (SELECT *, sum(cap) OVER (PARTITION BY bar_date) AS whole, coalesce(sum(cap) OVER (PARTITION BY bar_date ORDER BY factor DESC, asset_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM m)
SELECT bar_date, asset_id, round(CASE WHEN whole >= 1 - 1e-12 THEN greatest(least(cap, 1 - used), 0) END, 8) AS weight, CASE WHEN whole >= 1 - 1e-12 THEN 'OPTIMAL' ELSE 'INFEASIBLE' END AS status FROM w""")
def grouped_optimum(spark, sf_dir):
    p = panel(spark, sf_dir).withColumn("g", F.substring("asset_id", 7, 1))
    return trading.optimise(p, "bar_date", "asset_id", "factor", 0.2, 8, "g", 0.3).select("bar_date", "asset_id", F.round("weight", 8).alias("weight"), "status")


@query(_P + """, ng AS (SELECT bar_date, 0.1::DOUBLE * count(DISTINCT substr(asset_id, 7, 1)) AS need FROM panel GROUP BY 1),
r AS (SELECT bar_date, asset_id, factor, need, substr(asset_id, 7, 1) AS g FROM panel JOIN ng USING (bar_date) WHERE factor IS NOT NULL AND NOT (month(bar_date) % 4 = 0 AND asset_id LIKE 'Brand#1%')),
i AS (SELECT *, 0.2::DOUBLE * (row_number() OVER (PARTITION BY bar_date, g ORDER BY factor DESC, asset_id) - 1) AS a FROM r),
p AS (SELECT *, greatest(least(a + 0.2, 0.1::DOUBLE) - a, 0) AS low, greatest(least(a + 0.2, 0.3::DOUBLE) - greatest(a, 0.1::DOUBLE), 0) AS more FROM i),
f AS (SELECT *, coalesce(sum(more) OVER (PARTITION BY bar_date ORDER BY factor DESC, asset_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(low) OVER (PARTITION BY bar_date) AS lows, sum(low + more) OVER (PARTITION BY bar_date) AS whole FROM p)
SELECT bar_date, asset_id, round(CASE WHEN lows > need - 1e-9 AND whole > 1 - 1e-9 THEN low + greatest(least(more, 1 - need - before), 0) END, 8) AS weight, CASE WHEN lows > need - 1e-9 AND whole > 1 - 1e-9 THEN 'OPTIMAL' ELSE 'INFEASIBLE' END AS status FROM f""")
def bounded_optimum(spark, sf_dir):
    """Lower and upper bounds of groups by the exact solver; the SQL fills each group to its lower bound, then the best."""
    p = panel(spark, sf_dir).withColumn("g", F.substring("asset_id", 7, 1)).withColumns({"lo": F.lit(0.1), "hi": F.lit(0.3)})
    p = p.withColumn("factor", F.when(~((F.month("bar_date") % 4 == 0) & F.startswith("asset_id", F.lit("Brand#1"))), F.col("factor")))
    got = trading.target_weights(p, "bar_date", "asset_id", "factor", 0.2, group="g", lower="lo", upper="hi", cash=(0.0, 0.0))
    return got.filter("asset_id is not null").select("bar_date", "asset_id", F.round("weight", 8).alias("weight"), "status")


@query(with_views("nav") + " SELECT round(sum(CASE WHEN benchmark > 0 AND value > 0 THEN value * benchmark END) / sum(CASE WHEN benchmark > 0 AND value > 0 THEN value END), 2) AS weighted_mean, max(value) - min(value) AS value_range, count(DISTINCT benchmark) AS n_distinct FROM nav")
def weighted_mean(spark, sf_dir):
    ok = (F.col("benchmark") > 0) & (F.col("value") > 0)
    return nav(spark, sf_dir).agg(F.round(F.try_divide(F.sum(F.when(ok, F.col("value") * F.col("benchmark"))), F.sum(F.when(ok, F.col("value")))), 2).alias("weighted_mean"), (F.max("value") - F.min("value")).alias("value_range"), F.count_distinct("benchmark").alias("n_distinct"))


