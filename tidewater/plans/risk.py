"""Risk and attribution over monthly values and bars."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import attribution as A
from ..operators import factorise
from ..operators import risk as R
from ..tables import bars, holdings, load, nav, with_views
from .registry import query

_RET = with_views("nav") + ", r AS (SELECT nav_date, value / lag(value) OVER (ORDER BY nav_date) - 1 AS p, benchmark / lag(benchmark) OVER (ORDER BY nav_date) - 1 AS b FROM nav)"


def _returns(spark, sf_dir):
    w = Window.orderBy("nav_date")  # one row a month
    return nav(spark, sf_dir).select("nav_date", (F.col("value") / F.lag("value").over(w) - 1).alias("p"), (F.col("benchmark") / F.lag("benchmark").over(w) - 1).alias("b"))


@query(_RET + " SELECT round(sqrt(var_samp(p) * 12), 8) AS volatility FROM r")
def ann_volatility(spark, sf_dir):
    return _returns(spark, sf_dir).agg(F.round(R.volatility("p", 12), 8).alias("volatility"))


@query(_RET + " SELECT round(sqrt(var_samp(p - b) * 12), 8) AS tracking_error FROM r")
def tracking_error(spark, sf_dir):
    return _returns(spark, sf_dir).agg(F.round(R.tracking_error("p", "b", 12), 8).alias("tracking_error"))


@query(_RET + " SELECT round(covar_samp(p, b) / var_samp(b), 8) AS beta FROM r WHERE p IS NOT NULL AND b IS NOT NULL")
def beta(spark, sf_dir):
    return _returns(spark, sf_dir).agg(F.round(R.beta("p", "b"), 8).alias("beta"))


@query(with_views("bars") + ", p AS (SELECT asset_id, 1 - close / max(close) OVER (PARTITION BY asset_id ORDER BY bar_date) AS d FROM bars WHERE close > 0) SELECT asset_id, round(max(d), 8) AS max_drawdown FROM p GROUP BY 1")
def max_drawdown(spark, sf_dir):
    return R.max_drawdown(bars(spark, sf_dir), ["asset_id"], "bar_date", "close").withColumn("max_drawdown", F.round("max_drawdown", 8))


_COV = with_views("bars") + """, r AS (SELECT asset_id, bar_date, close / open - 1 AS x FROM bars),
cov AS (SELECT a.asset_id AS i, b.asset_id AS j, covar_samp(a.x, b.x) AS v FROM r a JOIN r b USING (bar_date) GROUP BY 1, 2),
w AS (SELECT asset_id AS i, sum(volume) / (SELECT sum(volume) FROM bars) AS w FROM bars GROUP BY 1)"""


def _cov(spark, sf_dir):
    b = bars(spark, sf_dir)
    cov = R.covariance_coo(b.select("bar_date", "asset_id", (F.col("close") / F.col("open") - 1).alias("x")), "bar_date", "asset_id", "x")
    by = b.groupBy(F.col("asset_id").alias("i")).agg(F.sum("volume").alias("s"))
    return cov, by.select("i", (F.col("s") / F.sum("s").over(Window.partitionBy())).alias("w"))


@query(_COV + ", m AS (SELECT cov.i, sum(v * w.w) AS marginal FROM cov JOIN w ON w.i = cov.j GROUP BY 1), c AS (SELECT m.i, w.w, marginal, w.w * marginal AS component FROM m JOIN w ON w.i = m.i) SELECT i, round(w, 8) AS w, round(marginal, 10) AS marginal, round(component, 10) AS component, round(component / sqrt(sum(component) OVER ()), 8) AS component_vol, round(sum(component) OVER (), 10) AS variance FROM c")
def covariance_contributions(spark, sf_dir):
    c = R.covariance_contributions(*_cov(spark, sf_dir))
    return c.select("i", F.round("w", 8).alias("w"), F.round("marginal", 10).alias("marginal"), F.round("component", 10).alias("component"), F.round("component_vol", 8).alias("component_vol"), F.round("variance", 10).alias("variance"))


@query(_COV + """, n AS (SELECT asset_id AS i, count(x) = (SELECT count(DISTINCT bar_date) FROM r WHERE x IS NOT NULL) AS whole FROM r GROUP BY 1), m AS (SELECT cov.i, sum(v * w.w) AS marginal FROM cov JOIN w ON w.i = cov.j JOIN n a ON a.i = cov.i AND a.whole JOIN n b ON b.i = cov.j AND b.whole GROUP BY 1)
SELECT n.i, round(marginal, 10) AS marginal, round(w.w * marginal, 10) AS component, CASE WHEN whole THEN 'OK' ELSE 'INCOMPLETE' END AS status FROM n JOIN w ON w.i = n.i LEFT JOIN m ON m.i = n.i""")
def panel_contributions(spark, sf_dir):
    """Contributions without the matrix; the SQL takes them from the matrix."""
    b = bars(spark, sf_dir)
    _, w = _cov(spark, sf_dir)
    c = R.panel_contributions(b.select("bar_date", "asset_id", (F.col("close") / F.col("open") - 1).alias("x")), w, "bar_date", "asset_id", "x")
    return c.select("i", F.round("marginal", 10).alias("marginal"), F.round("component", 10).alias("component"), "status")


@query(_COV + " SELECT 1 AS matrix_id, count(DISTINCT i)::INTEGER AS n_assets, true AS symmetric FROM cov")
def covariance_symmetry(spark, sf_dir):
    cov, _ = _cov(spark, sf_dir)
    return R.symmetry(cov.withColumn("matrix_id", F.lit(1)), "matrix_id").select("matrix_id", "n_assets", "symmetric")


@query()
def psd_check(spark, sf_dir):
    """Rows only: symmetry and the smallest eigenvalue of the asset covariance matrix."""
    cov, _ = _cov(spark, sf_dir)
    return R.psd_check(cov.withColumn("matrix_id", F.lit(1)), "matrix_id").select("matrix_id", "n_assets", "symmetric", "psd")


_STRESSED = """WITH c AS (SELECT l_returnflag, corr(l_quantity, l_extendedprice) AS a, corr(l_quantity, l_discount) AS b, corr(l_extendedprice, l_discount) AS c FROM lineitem GROUP BY 1),
m AS (SELECT l_returnflag || ':' || s AS matrix_id, a, b - s / 10.0::DOUBLE AS b, c + s / 10.0::DOUBLE AS c FROM c, generate_series(0, 9) t(s))"""


@query(_STRESSED + " SELECT matrix_id, 3 AS n_assets, true AS symmetric, a * a <= 1 AND b * b <= 1 AND c * c <= 1 AND 1 + 2 * a * b * c - a * a - b * b - c * c >= 0 AS psd FROM m")
def psd_of_stressed_correlations(spark, sf_dir):
    """Correlations of three measures, one pair moved down and one up in steps, until no panel could have them; the SQL takes
    the principal minors."""
    li = load(spark, sf_dir, "lineitem")
    pairs = [("q", "p", F.corr("l_quantity", "l_extendedprice"), 0), ("q", "d", F.corr("l_quantity", "l_discount"), -1), ("p", "d", F.corr("l_extendedprice", "l_discount"), 1)]
    c = li.groupBy("l_returnflag").agg(*[x.alias(i + j) for i, j, x, _ in pairs]).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(9))))
    cell = lambda i, j, v: F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), v.alias("v"))
    moved = [(i, j, F.col(i + j) + side * F.col("s") / 10.0) for i, j, _, side in pairs]
    cells = [cell(i, j, v) for i, j, v in moved] + [cell(j, i, v) for i, j, v in moved] + [cell(i, i, F.lit(1.0)) for i in "qpd"]
    cov = c.select(F.concat_ws(":", "l_returnflag", "s").alias("matrix_id"), F.explode(F.array(*cells)).alias("x")).select("matrix_id", "x.*")
    return factorise.psd_by_tiles(cov, "matrix_id", side=2)


@query(with_views("holdings") + """, t AS (SELECT sum(value)::DOUBLE AS t FROM holdings), l AS (SELECT 'industry' AS dimension, industry AS member, value FROM holdings UNION ALL SELECT 'market', market, value FROM holdings UNION ALL SELECT 'currency', currency, value FROM holdings)
SELECT dimension, member, round(sum(value)::DOUBLE / (SELECT t FROM t), 10) AS share FROM l GROUP BY 1, 2""")
def concentration(spark, sf_dir):
    return R.concentration(holdings(spark, sf_dir), ["industry", "market", "currency"]).withColumn("share", F.round("share", 10))


@query(with_views("holdings") + " SELECT round((SELECT sum(value) FROM (SELECT value FROM holdings ORDER BY value DESC, asset_id LIMIT 5))::DOUBLE / sum(value)::DOUBLE, 10) AS top_5 FROM holdings")
def top_five_share(spark, sf_dir):
    return R.top_k_share(holdings(spark, sf_dir), 5).select(F.round("top_5", 10).alias("top_5"))


@query("""WITH p AS (SELECT c_custkey AS k, DATE '1996-01-01' AS s, DATE '1997-01-01' AS e, 100000.0::DOUBLE + c_acctbal AS sv, 150000.0::DOUBLE + 2 * c_acctbal AS ev FROM customer),
f AS (SELECT o_custkey AS k, CAST(o_orderdate AS DATE) AS d, o_totalprice / 10 AS a FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01'),
g AS (SELECT p.k, sv, ev, coalesce(sum(a), 0) AS f, coalesce(sum(a * (1 - (d - s) / (e - s)::DOUBLE)), 0) AS wf FROM p LEFT JOIN f USING (k) GROUP BY p.k, sv, ev)
SELECT k, round(CASE WHEN sv + wf > 0 THEN (ev - sv - f) / (sv + wf) END, 8) AS period_return FROM g""")
def period_return_dietz(spark, sf_dir):
    c, o = load(spark, sf_dir, "customer"), load(spark, sf_dir, "orders")
    p = c.select(F.col("c_custkey").alias("k"), F.lit("1996-01-01").cast("date").alias("start_at"), F.lit("1997-01-01").cast("date").alias("end_at"), (F.lit(100000.0) + F.col("c_acctbal")).alias("start_value"), (F.lit(150000.0) + 2 * F.col("c_acctbal")).alias("end_value"))
    f = o.filter((F.col("o_orderdate") >= "1996-01-01") & (F.col("o_orderdate") < "1997-01-01")).select(F.col("o_custkey").alias("k"), F.col("o_orderdate").cast("date").alias("flow_at"), (F.col("o_totalprice") / 10).alias("amount"))
    return A.modified_dietz(p, f, "k").withColumn("period_return", F.round("period_return", 8))


_GRP = """WITH t AS (SELECT year(o_orderdate) AS y, c_mktsegment AS grp, sum(CAST(o_totalprice AS DECIMAL(18,2)))::DOUBLE AS s, count(*) AS n, sum(CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE 0 END)::DOUBLE AS sf, count(*) FILTER (o_orderstatus = 'F') AS nf FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2),
g AS (SELECT y, grp, s / sum(s) OVER (PARTITION BY y) AS wp, n / (sum(n) OVER (PARTITION BY y))::DOUBLE AS wb, sf / s AS rp, nf / n::DOUBLE AS rb FROM t)"""


def _groups(spark, sf_dir):
    o, c = load(spark, sf_dir, "orders"), load(spark, sf_dir, "customer")
    money = F.col("o_totalprice").cast("decimal(18,2)")
    t = o.join(c, o.o_custkey == c.c_custkey).groupBy(F.year("o_orderdate").cast("long").alias("y"), F.col("c_mktsegment").alias("grp")).agg(F.sum(money).cast("double").alias("s"), F.count("*").alias("n"), F.sum(F.when(F.col("o_orderstatus") == "F", money).otherwise(0)).cast("double").alias("sf"), F.count_if(F.col("o_orderstatus") == "F").alias("nf"))
    w = Window.partitionBy("y")
    return t.select("y", "grp", (F.col("s") / F.sum("s").over(w)).alias("wp"), (F.col("n") / F.sum("n").over(w)).alias("wb"), (F.col("sf") / F.col("s")).alias("rp"), (F.col("nf") / F.col("n")).alias("rb"))


@query(_GRP + """, z AS (SELECT *, sum(wp * rp) OVER (PARTITION BY y) AS bp, sum(wb * rb) OVER (PARTITION BY y) AS bb FROM g), e AS (SELECT *, (wp - wb) * (rb - bb) AS allocation, wb * (rp - rb) AS selection, (wp - wb) * (rp - rb) AS interaction FROM z)
SELECT y, grp, round(allocation, 10) AS allocation, round(selection, 10) AS selection, round(interaction, 10) AS interaction, abs(bp - bb - sum(allocation + selection + interaction) OVER (PARTITION BY y)) < 1e-10 AS balanced FROM e""")
def brinson_fachler(spark, sf_dir):
    b = A.brinson_fachler(_groups(spark, sf_dir), ["y"])
    return b.select("y", "grp", *[F.round(c, 10).alias(c) for c in ("allocation", "selection", "interaction")], (F.abs(F.col("residual")) < 1e-10).alias("balanced"))


@query(_GRP + " SELECT y, round(sum(wp * rp), 10) AS asset_effect, 0.001::DOUBLE AS cash_effect, -0.002::DOUBLE AS cost_drag, round(sum(wb * rb) - sum(wp * rp) + 0.001, 10) AS residual FROM g GROUP BY 1")
def period_attribution(spark, sf_dir):
    g = _groups(spark, sf_dir)
    totals = g.groupBy("y").agg(F.sum(F.col("wb") * F.col("rb")).alias("total_return")).withColumn("cash_effect", F.lit(0.001)).withColumn("cost", F.lit(0.002))
    p = A.period_attribution(g.select("y", "grp", F.col("wp").alias("weight")), g.select("y", "grp", F.col("rp").alias("asset_return")), totals, "y", "grp")
    return p.select("y", F.round("asset_effect", 10).alias("asset_effect"), "cash_effect", "cost_drag", F.round("residual", 10).alias("residual"))


@query(with_views("bars", "fx_rates") + """, b AS (SELECT asset_id, bar_date, close, lag(close) OVER (PARTITION BY asset_id ORDER BY bar_date) AS pc FROM bars), f AS (SELECT source_currency, rate_date, rate, lag(rate) OVER (PARTITION BY source_currency ORDER BY rate_date) AS pr FROM fx_rates)
SELECT asset_id, bar_date, source_currency, round(close / pc - 1, 8) AS local_return, round(rate / pr - 1, 8) AS fx_return, round((close / pc) * (rate / pr) - 1, 8) AS total_return, round((close / pc - 1) * (rate / pr - 1), 8) AS cross_effect FROM b JOIN f ON bar_date = rate_date""")
def local_fx_effect(spark, sf_dir):
    from ..tables import fx_rates

    b = bars(spark, sf_dir).select("asset_id", "bar_date", F.col("close").alias("end_value"), F.lag("close").over(Window.partitionBy("asset_id").orderBy("bar_date")).alias("start_value"))
    r = fx_rates(spark, sf_dir).select("source_currency", F.col("rate_date").alias("bar_date"), F.col("rate").alias("end_rate"), F.lag("rate").over(Window.partitionBy("source_currency").orderBy("rate_date")).alias("start_rate"))
    e = A.local_fx_effect(b.join(r, "bar_date"))
    return e.select("asset_id", "bar_date", "source_currency", *[F.round(c, 8).alias(c) for c in ("local_return", "fx_return", "total_return", "cross_effect")])


_LINK = with_views("nav") + """, r AS (SELECT nav_date, value / lag(value) OVER (ORDER BY nav_date) - 1 AS r FROM nav), x AS (SELECT nav_date, greatest(least(r, 0.2), -0.2) AS r FROM r WHERE r IS NOT NULL),
c AS (SELECT nav_date, r, 'a' AS component, 0.3 * r AS c FROM x UNION ALL SELECT nav_date, r, 'b', 0.7 * r FROM x), l AS (SELECT component, c * coalesce(exp(sum(ln(1 + r)) OVER (PARTITION BY component ORDER BY nav_date DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1) AS g FROM c)"""


def _linked(spark, sf_dir):
    x = _returns(spark, sf_dir).filter("p is not null").select("nav_date", F.greatest(F.least("p", F.lit(0.2)), F.lit(-0.2)).alias("period_return"))
    parts = F.explode(F.array(F.struct(F.lit("a").alias("component"), (0.3 * F.col("period_return")).alias("contribution")), F.struct(F.lit("b").alias("component"), (0.7 * F.col("period_return")).alias("contribution"))))
    return x.withColumn("z", parts).select("nav_date", "period_return", "z.*")


@query(_LINK + " SELECT component, round(sum(g), 7) AS linked FROM l GROUP BY 1")
def linked_attribution(spark, sf_dir):
    return A.linked_contributions(_linked(spark, sf_dir), [], "component", "nav_date").withColumn("linked", F.round("linked", 7))


@query(_LINK + " SELECT round(exp(sum(ln(1 + r))) - 1, 7) AS total_return FROM x")
def geometric_total_return(spark, sf_dir):
    return A.geometric_total(_linked(spark, sf_dir).select("nav_date", "period_return").distinct(), []).withColumn("total_return", F.round("total_return", 7))
