"""Intervals, as-of lookups, revision chains, universes, gaps."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import fx, temporal, universe, versions
from ..tables import bars, fx_rates, load, memberships, observations, open_days, with_views
from .registry import query


@query(with_views("memberships") + " SELECT o.o_orderkey, count(m.asset_id) AS n FROM orders o LEFT JOIN memberships m ON m.asset_id = o.o_custkey AND m.effective_from <= CAST(o.o_orderdate AS DATE) + 40 AND (m.effective_to IS NULL OR CAST(o.o_orderdate AS DATE) + 40 <= m.effective_to) GROUP BY 1")
def interval_membership_join(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("asset_id"), F.date_add(F.col("o_orderdate").cast("date"), 40).alias("at"))
    j = temporal.interval_join(o, memberships(spark, sf_dir), ["asset_id"], "at", how="left")
    return j.groupBy("o_orderkey").agg(F.count("effective_from").alias("n"))


def _profiles(spark, sf_dir):
    """Quarterly rule profiles per order priority; every third quarter has two, every fifth none."""
    q = load(spark, sf_dir, "orders").select("o_orderpriority", F.trunc(F.col("o_orderdate").cast("date"), "quarter").alias("effective_from")).distinct().withColumn("k", F.year("effective_from") * 4 + F.quarter("effective_from"))
    end = F.date_sub(F.add_months("effective_from", 3), 1)
    copies = F.when(F.col("k") % 5 == 0, F.array().cast("array<int>")).when(F.col("k") % 3 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return q.withColumn("c", F.explode(copies)).select("o_orderpriority", "effective_from", end.alias("effective_to"), F.concat_ws("-", "o_orderpriority", F.col("k").cast("string"), F.col("c").cast("string")).alias("version_id"))


_PROFILES = """WITH q AS (SELECT DISTINCT o_orderpriority, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS effective_from, year(o_orderdate) * 4 + quarter(o_orderdate) AS k FROM orders),
prof AS (SELECT o_orderpriority, effective_from, (effective_from + INTERVAL 3 MONTH)::DATE - 1 AS effective_to, o_orderpriority || '-' || k || '-' || c AS version_id FROM q, (SELECT unnest([1, 2]) AS c) WHERE k % 5 <> 0 AND (c = 1 OR k % 3 = 0))"""


@query(_PROFILES + """ SELECT o.o_orderkey, count(version_id) AS n_matches, CASE count(version_id) WHEN 0 THEN 'missing' WHEN 1 THEN 'resolved' ELSE 'ambiguous' END AS status, CASE WHEN count(version_id) = 1 THEN min(version_id) END AS resolved_id, coalesce(string_agg(version_id, ',' ORDER BY version_id), '') AS candidate_ids
FROM orders o LEFT JOIN prof p ON p.o_orderpriority = o.o_orderpriority AND CAST(o.o_orderdate AS DATE) BETWEEN p.effective_from AND p.effective_to GROUP BY 1""")
def resolve_exactly_one(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.col("o_orderdate").cast("date").alias("at"))
    return temporal.resolve_exactly_one(o, ["o_orderkey"], _profiles(spark, sf_dir), ["o_orderpriority"], "at", "version_id")


@query("""WITH v AS (SELECT c_custkey, DATE '1995-01-01' + (c_custkey % 900)::INTEGER AS effective_from, CASE WHEN c_custkey % 4 = 0 THEN DATE '1998-01-01' END AS effective_to, 'a' || c_custkey AS version_id FROM customer
UNION ALL SELECT c_custkey, DATE '1996-06-01', NULL, 'b' || c_custkey FROM customer WHERE c_custkey % 3 = 0),
p AS (SELECT DISTINCT o_custkey AS c_custkey, CAST(o_orderdate AS DATE) AS "at" FROM orders)
SELECT c_custkey, "at", version_id FROM (SELECT p.c_custkey, p."at", v.version_id, row_number() OVER (PARTITION BY p.c_custkey, p."at" ORDER BY v.effective_from DESC NULLS LAST, v.effective_to DESC NULLS FIRST, v.version_id) AS r FROM p LEFT JOIN v ON v.c_custkey = p.c_custkey AND v.effective_from <= p."at" AND (v.effective_to IS NULL OR p."at" <= v.effective_to)) WHERE r = 1""")
def scd2_point_lookup(spark, sf_dir):
    c = load(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    a = c.select("c_custkey", F.date_add(F.lit("1995-01-01").cast("date"), (k % 900).cast("int")).alias("effective_from"), F.when(k % 4 == 0, F.lit("1998-01-01").cast("date")).alias("effective_to"), F.concat(F.lit("a"), k).alias("version_id"))
    b = c.filter(k % 3 == 0).select("c_custkey", F.lit("1996-06-01").cast("date").alias("effective_from"), F.lit(None).cast("date").alias("effective_to"), F.concat(F.lit("b"), k).alias("version_id"))
    p = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderdate").cast("date").alias("at")).distinct()
    return temporal.scd2_lookup(a.union(b), p, "c_custkey", "at", "version_id").select("c_custkey", "at", "version_id")


@query("""WITH v AS (SELECT c_custkey, o_orderdate AS d, o_orderstatus AS s, o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey),
k AS (SELECT c_custkey, d::DATE AS d, max(s) AS s FROM v GROUP BY 1, 2), c AS (SELECT *, lag(s) OVER (PARTITION BY c_custkey ORDER BY d) AS b FROM k)
SELECT c_custkey, s, d AS effective_from, lead(d) OVER (PARTITION BY c_custkey ORDER BY d) - 1 AS effective_to FROM c WHERE b IS NULL OR b <> s""")
def scd2_registration(spark, sf_dir):
    o = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey"), F.col("o_orderdate").cast("date").alias("d")).agg(F.max("o_orderstatus").alias("s"))
    return versions.changes(o, "c_custkey", "d", ["s"]).select("c_custkey", "s", "effective_from", "effective_to")


_O = with_views("observations") + ", cut AS (SELECT min(available_at) + (max(available_at) - min(available_at)) / 2 AS t FROM observations)"


def _cut(o):
    return o.agg((F.min("available_at") + (F.max("available_at") - F.min("available_at")) / 2).alias("t"))


@query(_O + " SELECT asset_id, metric, arg_max(event_id, row(available_at, event_id)) AS event_id, round(arg_max(value, row(available_at, event_id)), 6) AS value FROM observations, cut WHERE available_at <= t GROUP BY 1, 2")
def pit_fact_selection(spark, sf_dir):
    o = observations(spark, sf_dir)
    seen = o.crossJoin(F.broadcast(_cut(o)))
    best, _ = versions.point_in_time(seen.select("asset_id", "metric", "event_id", "value", "available_at", "t"), ["asset_id", "metric"], F.col("t"), "available_at", "event_id")
    return best.select("asset_id", "metric", "event_id", F.round("value", 6).alias("value"))


@query(_O + " SELECT event_id, available_at <= t AS included, CASE WHEN available_at > t THEN 'decision-time-before-provider-available-at' END AS reason FROM observations, cut")
def pit_exclusion_evidence(spark, sf_dir):
    o = observations(spark, sf_dir)
    seen = o.crossJoin(F.broadcast(_cut(o)))
    ok = F.col("available_at") <= F.col("t")
    return seen.select("event_id", ok.alias("included"), F.when(~ok, "decision-time-before-provider-available-at").alias("reason"))


_CHAIN = with_views("observations") + """, o AS (SELECT asset_id, metric, event_id, available_at, CASE WHEN value >= 10 THEN floor(value / 25)::BIGINT END AS content FROM observations),
c AS (SELECT *, lag(content) OVER w AS b, row_number() OVER w AS r FROM o WINDOW w AS (PARTITION BY asset_id, metric ORDER BY available_at, event_id)),
ch AS (SELECT asset_id, metric, event_id, available_at, content, row_number() OVER (PARTITION BY asset_id, metric ORDER BY available_at, event_id) AS revision_position, lag(content) OVER (PARTITION BY asset_id, metric ORDER BY available_at, event_id) AS predecessor_content FROM c WHERE r = 1 OR b IS DISTINCT FROM content)"""


def _chain(spark, sf_dir):
    o = observations(spark, sf_dir).select("asset_id", "metric", "event_id", "available_at", F.when(F.col("value") >= 10, F.floor(F.col("value") / 25)).alias("content"))
    return versions.chain(o, ["asset_id", "metric"], ["available_at", "event_id"], "content")


@query(_CHAIN + " SELECT asset_id, metric, event_id, content, revision_position::INTEGER AS revision_position, predecessor_content FROM ch")
def revision_chain(spark, sf_dir):
    return _chain(spark, sf_dir).select("asset_id", "metric", "event_id", "content", "revision_position", "predecessor_content")


@query(_CHAIN + " SELECT asset_id, metric, arg_max(event_id, revision_position) AS event_id, max(revision_position)::INTEGER AS revision_position FROM ch GROUP BY 1, 2")
def current_version_view(spark, sf_dir):
    return versions.current(_chain(spark, sf_dir), ["asset_id", "metric"]).select("asset_id", "metric", "event_id", "revision_position")


@query(_CHAIN + " SELECT event_id, revision_position::INTEGER AS revision_position, content FROM ch WHERE asset_id = 7 AND metric = 'click' ORDER BY revision_position")
def revision_history(spark, sf_dir):
    return versions.history(_chain(spark, sf_dir), {"asset_id": 7, "metric": "click"}).select("event_id", "revision_position", "content")


@query(_CHAIN + """, cur AS (SELECT asset_id, metric, arg_max(row(content), revision_position)[1] AS now, max(revision_position) AS "at" FROM ch GROUP BY 1, 2),
inc AS (SELECT DISTINCT asset_id, 'click' AS metric, asset_id % 4 AS content FROM observations UNION ALL SELECT -1, 'click', 1)
SELECT inc.asset_id, inc.metric, inc.content::BIGINT AS content, (coalesce("at", 0) + 1)::INTEGER AS revision_position, now AS predecessor_content FROM inc LEFT JOIN cur USING (asset_id, metric) WHERE "at" IS NULL OR now IS DISTINCT FROM inc.content""")
def publish_successors(spark, sf_dir):
    inc = observations(spark, sf_dir).select("asset_id", F.lit("click").alias("metric"), (F.col("asset_id") % 4).alias("content")).distinct()
    new = spark.range(-1, 0).select(F.col("id").alias("asset_id"), F.lit("click").alias("metric"), F.lit(1).cast("long").alias("content"))
    return versions.publish(_chain(spark, sf_dir), inc.union(new), ["asset_id", "metric"], "content").select("asset_id", "metric", "content", F.col("revision_position").cast("int").alias("revision_position"), "predecessor_content")


@query("""WITH m AS (SELECT min(CAST(o_orderdate AS DATE)) AS a, max(CAST(o_orderdate AS DATE)) AS b FROM orders), s AS (SELECT DISTINCT c_custkey % 10 AS grp, CAST(o_orderdate AS DATE) AS day FROM orders JOIN customer ON c_custkey = o_custkey),
e AS (SELECT grp, (a + i::INTEGER) AS day FROM (SELECT a, unnest(range(b - a + 1)) AS i FROM m), (SELECT unnest(range(10)) AS grp)),
x AS (SELECT grp, day, day - (row_number() OVER (PARTITION BY grp ORDER BY day))::INTEGER AS run FROM e ANTI JOIN s USING (grp, day))
SELECT grp::BIGINT AS grp, min(day) AS range_start, max(day) AS range_end, count(*) AS n_points FROM x GROUP BY grp, run""")
def missing_segments(spark, sf_dir):
    o, c = load(spark, sf_dir, "orders"), load(spark, sf_dir, "customer")
    day = F.col("o_orderdate").cast("date")
    stored = o.join(c, o.o_custkey == c.c_custkey).select((F.col("c_custkey") % 10).alias("grp"), day.alias("day")).distinct()
    ends = o.agg(F.min(day).alias("a"), F.max(day).alias("b"))
    expected = ends.select(F.explode(F.sequence("a", "b")).alias("day")).select("day", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long"))).alias("grp"))
    return temporal.missing_ranges(expected, stored, ["grp"], "day")


@query("""WITH d AS (SELECT DISTINCT o_custkey, CAST(o_orderdate AS DATE) - (dayofmonth(o_orderdate) - 1)::INTEGER AS day FROM orders), q AS (SELECT DISTINCT o_custkey, (year(day) * 12 + month(day)) AS m FROM d),
r AS (SELECT o_custkey, m, m - row_number() OVER (PARTITION BY o_custkey ORDER BY m) AS g FROM q) SELECT o_custkey, min(m)::INTEGER AS range_start, max(m)::INTEGER AS range_end, count(*) AS n_points FROM r GROUP BY o_custkey, g""")
def month_islands(spark, sf_dir):
    d = F.col("o_orderdate").cast("date")
    q = load(spark, sf_dir, "orders").select("o_custkey", (F.year(d) * 12 + F.month(d)).alias("m")).distinct()
    return temporal.islands(q, ["o_custkey"], "m", step=1)


@query(with_views("memberships") + """, n AS (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY effective_from) AS id FROM (SELECT asset_id, effective_from - 100 AS effective_from, effective_to FROM memberships))
SELECT a.asset_id, a.id::INTEGER AS left_id, b.id::INTEGER AS right_id FROM n a JOIN n b ON a.asset_id = b.asset_id AND a.id < b.id WHERE greatest(a.effective_from, b.effective_from) <= least(coalesce(a.effective_to, DATE '9999-12-31'), coalesce(b.effective_to, DATE '9999-12-31'))""")
def overlap_conflicts(spark, sf_dir):
    m = memberships(spark, sf_dir).withColumn("effective_from", F.date_sub("effective_from", 100))
    m = m.withColumn("id", F.row_number().over(Window.partitionBy("asset_id").orderBy("effective_from")))
    return temporal.conflicts(m, "asset_id", "id")


@query("""SELECT l_partkey, CAST(l_shipdate AS DATE) AS effective_date, count(DISTINCT l_suppkey) AS n_versions FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_suppkey) > 1""")
def corporate_action_conflicts(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").groupBy("l_partkey", F.col("l_shipdate").cast("date").alias("effective_date")).agg(F.count_distinct("l_suppkey").alias("n_versions")).filter("n_versions > 1")


_UNI = with_views("memberships") + """, dt AS (SELECT DATE '1997-05-15' AS selection_date, TIMESTAMP '1997-05-15 00:00:00' AS decision_at UNION ALL SELECT DATE '1999-02-01', TIMESTAMP '1999-02-01 00:00:00'),
life AS (SELECT c_custkey AS asset_id, DATE '1990-01-01' AS effective_from, NULL::DATE AS effective_to, CASE WHEN c_acctbal < 0 THEN 'SUSPENDED' ELSE 'ACTIVE' END AS status FROM customer),
liq AS (SELECT o_custkey AS asset_id, o_orderdate AS available_at, CASE WHEN o_totalprice > 50000 THEN o_totalprice END AS value FROM orders),
mem AS (SELECT * FROM memberships UNION ALL SELECT * FROM memberships WHERE asset_id % 11 = 0),
aa AS (SELECT DISTINCT asset_id FROM mem),
m AS (SELECT asset_id, selection_date, count(*) AS n FROM mem JOIN dt ON effective_from <= selection_date AND (effective_to IS NULL OR selection_date <= effective_to) GROUP BY 1, 2),
l AS (SELECT asset_id, selection_date, count(*) AS n, min((status = 'ACTIVE')::INTEGER) AS act FROM life JOIN dt ON effective_from <= selection_date AND (effective_to IS NULL OR selection_date <= effective_to) GROUP BY 1, 2),
q AS (SELECT asset_id, selection_date, count(*) FILTER (available_at <= decision_at AND value IS NOT NULL) AS v, count(*) FILTER (available_at > decision_at) AS f FROM liq, dt GROUP BY 1, 2),
u AS (SELECT aa.asset_id, dt.selection_date, CASE WHEN coalesce(m.n, 0) = 0 THEN 'MISSING' WHEN m.n > 1 THEN 'AMBIGUOUS' WHEN coalesce(l.n, 0) <> 1 OR coalesce(l.act, 0) <> 1 THEN 'LIFECYCLE' WHEN coalesce(q.v, 0) < 1 THEN 'LIQUIDITY' END AS reason,
  CASE WHEN coalesce(m.n, 0) = 1 AND l.n = 1 AND l.act = 1 THEN coalesce(q.f, 0) ELSE 0 END::BIGINT AS lookahead_prevented
  FROM aa CROSS JOIN dt LEFT JOIN m ON m.asset_id = aa.asset_id AND m.selection_date = dt.selection_date LEFT JOIN l ON l.asset_id = aa.asset_id AND l.selection_date = dt.selection_date LEFT JOIN q ON q.asset_id = aa.asset_id AND q.selection_date = dt.selection_date)"""


def _universe(spark, sf_dir):
    c, o, m = load(spark, sf_dir, "customer"), load(spark, sf_dir, "orders"), memberships(spark, sf_dir)
    dates = spark.sql("SELECT * FROM VALUES (DATE'1997-05-15', TIMESTAMP'1997-05-15 00:00:00'), (DATE'1999-02-01', TIMESTAMP'1999-02-01 00:00:00') AS t(selection_date, decision_at)")
    life = c.select(F.col("c_custkey").alias("asset_id"), F.lit("1990-01-01").cast("date").alias("effective_from"), F.lit(None).cast("date").alias("effective_to"), F.when(F.col("c_acctbal") < 0, "SUSPENDED").otherwise("ACTIVE").alias("status"))
    liq = o.select(F.col("o_custkey").alias("asset_id"), F.col("o_orderdate").cast("timestamp").alias("available_at"), F.when(F.col("o_totalprice") > 50000, F.col("o_totalprice")).alias("value"))
    return universe.select(m.union(m.filter("asset_id % 11 = 0")), life, liq, dates)


@query(_UNI + " SELECT asset_id, selection_date, reason IS NULL AS included, reason, lookahead_prevented FROM u")
def universe_pit(spark, sf_dir):
    return _universe(spark, sf_dir)


@query(_UNI + " SELECT coalesce(reason, 'INCLUDED') AS outcome, count(*) AS n_all_dates, count(*) FILTER (selection_date = DATE '1999-02-01') AS n_last_date, count(DISTINCT CASE WHEN reason IS NULL THEN asset_id END) AS members FROM u GROUP BY 1")
def universe_history(spark, sf_dir):
    return universe.history(_universe(spark, sf_dir))


@query(with_views("memberships") + """, days AS (SELECT DATE '1997-01-01' + (7 * i)::INTEGER AS selection_date FROM (SELECT unnest(range(60)) AS i) UNION SELECT DATE '1997-03-02' + i::INTEGER FROM (SELECT unnest(range(5)) AS i)),
e AS (SELECT asset_id, min(effective_from) AS a, max(coalesce(effective_to, DATE '9999-12-31')) AS b FROM memberships GROUP BY 1),
p AS (SELECT asset_id, selection_date FROM e, days WHERE a < selection_date AND selection_date < b),
g AS (SELECT p.* FROM p WHERE NOT EXISTS (SELECT 1 FROM memberships m WHERE m.asset_id = p.asset_id AND m.effective_from <= p.selection_date AND (m.effective_to IS NULL OR p.selection_date <= m.effective_to))),
r AS (SELECT *, selection_date - (row_number() OVER (PARTITION BY asset_id ORDER BY selection_date))::INTEGER AS run FROM g)
SELECT asset_id, min(selection_date) AS range_start, max(selection_date) AS range_end, count(*) AS n_points FROM r GROUP BY asset_id, run""")
def survivorship_warnings(spark, sf_dir):
    days = spark.sql("SELECT DISTINCT d AS selection_date FROM (SELECT explode(transform(sequence(0, 59), i -> date_add(DATE'1997-01-01', 7 * i))) AS d UNION ALL SELECT explode(transform(sequence(0, 4), i -> date_add(DATE'1997-03-02', i))) AS d)")
    return universe.survivorship_warnings(memberships(spark, sf_dir), days)


_FX = with_views("fx_rates") + """, v AS (SELECT o_orderkey, n_name AS source_currency, CASE WHEN o_orderkey % 10 = 0 THEN n_name ELSE 'BASE' END AS target_currency, CAST(o_orderdate AS DATE) AS "at", CASE WHEN o_orderkey % 97 = 0 THEN 0.0 ELSE o_totalprice END AS amount FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey)"""


@query(_FX + """, j AS (SELECT v.*, r.rate, r.version_id AS ver FROM v LEFT JOIN fx_rates r ON r.source_currency = v.source_currency AND r.target_currency = v.target_currency AND r.rate_date = CAST(date_trunc('month', v."at") AS DATE) AND v."at" - r.rate_date <= 4)
SELECT o_orderkey, CASE WHEN amount <= 0 THEN 'invalid-value' WHEN source_currency = target_currency THEN 'identity' WHEN rate IS NULL THEN 'unavailable' ELSE 'converted' END AS status,
round(CASE WHEN amount <= 0 THEN NULL WHEN source_currency = target_currency THEN amount ELSE amount * rate END, 4) AS converted, CASE WHEN amount > 0 AND source_currency <> target_currency THEN ver END AS version_id FROM j""")
def fx_asof_convert(spark, sf_dir):
    o, c, n = (load(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    k = F.col("o_orderkey")
    v = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).select("o_orderkey", F.col("n_name").alias("source_currency"), F.when(k % 10 == 0, F.col("n_name")).otherwise("BASE").alias("target_currency"), F.col("o_orderdate").cast("date").alias("at"), F.when(k % 97 == 0, 0.0).otherwise(F.col("o_totalprice")).alias("amount"))
    return fx.convert(v, fx_rates(spark, sf_dir)).select("o_orderkey", "status", F.round("converted", 4).alias("converted"), "version_id")


@query(with_views("fx_rates") + " SELECT version_id, round(rate, 10) AS rate, round(1 / rate, 10) AS inverse, version_id || '-INVERSE' AS inverse_id, abs(rate * (1 / rate) - 1) <= 1e-10 AS round_trip FROM fx_rates")
def inverse_rate_roundtrip(spark, sf_dir):
    r = fx.with_inverses(fx_rates(spark, sf_dir))
    d = r.filter("direct_version_id is null").select("version_id", "rate")
    i = r.filter("direct_version_id is not null").select(F.col("direct_version_id").alias("version_id"), F.col("rate").alias("inverse"), F.col("version_id").alias("inverse_id"))
    return d.join(i, "version_id").select("version_id", F.round("rate", 10).alias("rate"), F.round("inverse", 10).alias("inverse"), "inverse_id", (F.abs(F.col("rate") * F.col("inverse") - 1) <= 1e-10).alias("round_trip"))


@query(with_views("fx_rates") + " SELECT source_currency, rate_date, round(rate, 10) AS rate FROM fx_rates WHERE target_currency = 'BASE' AND rate_date IN (DATE '1996-01-01', DATE '1997-01-01', DATE '1998-01-01')")
def fx_rate_selection(spark, sf_dir):
    days = [F.lit(d).cast("date") for d in ("1996-01-01", "1997-01-01", "1998-01-01")]
    return fx_rates(spark, sf_dir).filter((F.col("target_currency") == "BASE") & F.col("rate_date").isin(days)).select("source_currency", "rate_date", F.round("rate", 10).alias("rate"))


@query("""WITH s AS (SELECT c_custkey AS custkey, min(o_orderdate) FILTER (o.o_orderdate > TIMESTAMP '1997-01-01' + INTERVAL 1 DAY * (c_custkey % 300)) AS next_at, TIMESTAMP '1997-01-01' + INTERVAL 1 DAY * (c_custkey % 300) AS decision_at FROM customer LEFT JOIN orders o ON o_custkey = c_custkey GROUP BY c_custkey)
SELECT custkey, decision_at::DATE AS decision_date, next_at::DATE AS next_date FROM s""")
def next_session_schedule(spark, sf_dir):
    c = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey"), F.date_add(F.lit("1997-01-01").cast("date"), (F.col("c_custkey") % 300).cast("int")).cast("timestamp_ntz").alias("decision_at"))
    o = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("custkey"), "o_orderdate")
    return temporal.next_event(c, o, ["custkey"], "decision_at", "o_orderdate", "next_at").select("custkey", F.col("decision_at").cast("date").alias("decision_date"), F.col("next_at").cast("date").alias("next_date"))


@query(with_views("open_days") + """, t AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_shipdate AS DATE) AS "at", (l_linenumber % 3)::INTEGER AS n FROM lineitem), f AS (SELECT t.*, (SELECT min(idx) FROM open_days WHERE day >= t."at") AS i, EXISTS (SELECT 1 FROM open_days WHERE day = t."at") AS open FROM (SELECT DISTINCT "at", n FROM t) t)
SELECT "at" AS trade_date, n, d.day AS settles FROM f LEFT JOIN open_days d ON d.idx = CASE WHEN open OR n = 0 THEN i + n ELSE i + n - 1 END""")
def nth_open_day_settlement(spark, sf_dir):
    t = load(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").alias("trade_date"), (F.col("l_linenumber") % 3).cast("int").alias("n")).distinct()
    return temporal.nth_open_day(t, open_days(spark, sf_dir), "trade_date", F.col("n"), "settles")


@query(with_views("bars") + """, p AS (SELECT DISTINCT asset_id, (bar_date + INTERVAL 45 DAY)::DATE AS "at" FROM bars)
SELECT p.asset_id, p."at", round((SELECT close FROM bars b WHERE b.asset_id = p.asset_id AND b.bar_date <= p."at" ORDER BY b.bar_date DESC LIMIT 1), 6) AS close FROM p""")
def latest_close_valuation(spark, sf_dir):
    b = bars(spark, sf_dir).select("asset_id", "bar_date", "close")
    p = b.select("asset_id", F.date_add("bar_date", 45).alias("at")).distinct()
    return temporal.asof_join(p, b, ["asset_id"], "at", "bar_date", "bar_date", ["close"]).select("asset_id", "at", F.round("close", 6).alias("close"))


@query(with_views("bars", "open_days") + """, p AS (SELECT DISTINCT asset_id, (bar_date + INTERVAL 20 DAY)::DATE AS "at" FROM bars UNION SELECT DISTINCT asset_id, (bar_date + INTERVAL 6 DAY)::DATE FROM bars),
v AS (SELECT p.asset_id, p."at", (SELECT max(bar_date) FROM bars b WHERE b.asset_id = p.asset_id AND b.bar_date <= p."at") AS source_date FROM p),
n AS (SELECT v.*, (SELECT count(*) FROM open_days WHERE day > source_date AND day <= v."at") AS k FROM v)
SELECT n.asset_id, n."at", CASE WHEN k <= 5 THEN round(close, 6) END AS close, CASE WHEN source_date IS NOT NULL AND k <= 5 THEN 'valued' ELSE 'unavailable' END AS status FROM n LEFT JOIN bars b ON b.asset_id = n.asset_id AND b.bar_date = source_date""")
def bounded_valuation(spark, sf_dir):
    """The last close of at most five open days before the day."""
    b = bars(spark, sf_dir).select("asset_id", "bar_date", "close")
    p = b.select("asset_id", F.date_add("bar_date", 20).alias("at")).union(b.select("asset_id", F.date_add("bar_date", 6).alias("at"))).distinct()
    v = temporal.asof_join(p, b, ["asset_id"], "at", "bar_date", "bar_date", ["close", "bar_date"])
    v = temporal.within_open_days(v, open_days(spark, sf_dir), "bar_date", "at", 5, "near")
    return v.select("asset_id", "at", F.when(F.col("near"), F.round("close", 6)).alias("close"), F.when(F.col("near"), "valued").otherwise("unavailable").alias("status"))


@query("""SELECT event_id, last_click FROM (SELECT event_id, event_type, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_type <> 'click', event_id ROWS UNBOUNDED PRECEDING) AS last_click FROM events) WHERE event_type = 'view'""")
def asof_events(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    p = e.filter("event_type = 'view'").select("event_id", "user_id", "ts")
    f = e.filter("event_type = 'click'").select("user_id", F.col("ts").alias("cts"), F.col("event_id").alias("last_click"))
    return temporal.asof_join(p, f, ["user_id"], "ts", "cts", "last_click", ["last_click"]).select("event_id", "last_click")


@query("""WITH s AS (SELECT s_suppkey, DATE '1996-01-01' + (s_suppkey * 37 % 1500)::INTEGER AS a FROM supplier), sp AS (SELECT s_suppkey, a, CASE WHEN s_suppkey % 5 > 0 THEN a + 90 END AS b FROM s),
d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS "at" FROM orders) SELECT "at", count(*) AS n_active FROM d JOIN sp ON a <= "at" AND (b IS NULL OR "at" <= b) GROUP BY 1""")
def binned_interval_counts(spark, sf_dir):
    s = load(spark, sf_dir, "supplier").select("s_suppkey", F.date_add(F.lit("1996-01-01").cast("date"), (F.col("s_suppkey") * 37 % 1500).cast("int")).alias("effective_from"))
    s = s.withColumn("effective_to", F.when(F.col("s_suppkey") % 5 > 0, F.date_add("effective_from", 90)))
    d = load(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("at")).distinct()
    return temporal.binned_interval_join(d, s, "at").groupBy("at").agg(F.count("*").alias("n_active"))


def _exchange_days(spark, sf_dir):
    """Order days as calendar days: Saturdays have an extra session, Sundays are closed, Fridays have both kinds."""
    d = load(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    dow = F.dayofweek("day")
    kinds = F.when(dow == 7, F.array(F.lit("non_regular"))).when(dow == 6, F.array(F.lit("regular"), F.lit("non_regular"))).otherwise(F.array(F.lit("regular")))
    return d.select(F.lit("X").alias("exchange"), "day", F.when(dow == 1, "closed").otherwise("full").alias("kind"), F.transform(kinds, lambda k: F.struct(k.alias("kind"))).alias("sessions"))


@query("""WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders), t AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS trade_date, (l_linenumber % 3)::INTEGER AS k FROM lineitem)
SELECT trade_date, k, (SELECT min(day) FROM d WHERE day >= trade_date AND CASE k WHEN 0 THEN dayofweek(day) BETWEEN 1 AND 5 WHEN 1 THEN dayofweek(day) IN (5, 6) ELSE dayofweek(day) BETWEEN 1 AND 6 END) AS session_date FROM t""")
def next_permitted_session(spark, sf_dir):
    k = F.col("k")
    t = load(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").alias("trade_date"), (F.col("l_linenumber") % 3).cast("int").alias("k")).distinct()
    permitted = F.when(k == 0, F.array(F.lit("regular"))).when(k == 1, F.array(F.lit("non_regular"))).otherwise(F.array(F.lit("regular"), F.lit("non_regular")))
    got = temporal.next_permitted_date(t.withColumn("exchange", F.lit("X")).withColumn("permitted", permitted), _exchange_days(spark, sf_dir), ["exchange"], "trade_date", "permitted", "session_date")
    return got.select("trade_date", "k", "session_date")


@query(with_views("open_days") + """, t AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS trade_date, CASE WHEN l_linenumber % 2 = 0 THEN 'SAME_MARKET_DATE' ELSE 'NEXT_OPEN_MARKET_DATE' END AS rule FROM lineitem)
SELECT trade_date, rule, CASE rule WHEN 'SAME_MARKET_DATE' THEN trade_date ELSE (SELECT min(day) FROM open_days WHERE day > trade_date) END AS sell_available FROM t""")
def sell_available_date(spark, sf_dir):
    t = load(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").alias("trade_date"), F.when(F.col("l_linenumber") % 2 == 0, "SAME_MARKET_DATE").otherwise("NEXT_OPEN_MARKET_DATE").alias("rule")).distinct()
    return temporal.sell_available(t, open_days(spark, sf_dir), "trade_date", "rule", "sell_available")


@query(with_views("fx_rates") + """, s AS (SELECT version_id, source_currency, rate_date, rate, CASE WHEN month(rate_date) % 3 = 0 THEN 1 / rate * 1.01::DOUBLE WHEN month(rate_date) % 3 = 1 THEN 1 / rate END AS inverse FROM fx_rates)
SELECT version_id, CASE WHEN inverse IS NULL THEN 'missing' WHEN abs(rate * inverse - 1) <= 1e-10 THEN 'ok' ELSE 'mismatch' END AS status FROM s""")
def supplied_inverse_check(spark, sf_dir):
    r = fx_rates(spark, sf_dir)
    m = F.month("rate_date") % 3
    given = fx.with_inverses(r).filter("direct_version_id is not null").filter(m < 2).withColumn("rate", F.when(m == 0, F.col("rate") * 1.01).otherwise(F.col("rate")))
    return fx.inverse_check(r, given).select("version_id", "status")


@query("""WITH w AS (SELECT page_id, '/w/' || (page_id // 4)::VARCHAR || CASE page_id % 4 WHEN 0 THEN '' WHEN 1 THEN '/a' WHEN 2 THEN '/a/b/' ELSE '' END AS p FROM pages), c AS (SELECT page_id, rtrim(p, '/') AS p FROM w)
SELECT a.page_id AS left_id, b.page_id AS right_id, CASE WHEN a.p = b.p THEN 'equal-path' ELSE 'ancestor-or-descendant' END AS conflict FROM c a JOIN c b ON (a.p = b.p AND a.page_id < b.page_id) OR starts_with(b.p, a.p || '/')""")
def path_conflicts(spark, sf_dir):
    k = F.col("page_id")
    end = F.when(k % 4 == 1, "/a").when(k % 4 == 2, "/a/b/").otherwise("")
    w = load(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("/w/"), F.floor(k / 4).cast("string"), end).alias("path"))
    return temporal.path_conflicts(w, "page_id", "path")


@query(_UNI + " SELECT asset_id, min(selection_date) AS first_date, max(selection_date) AS last_date, count(*) AS n_dates FROM u WHERE reason IS NULL GROUP BY 1")
def universe_members(spark, sf_dir):
    return universe.members(_universe(spark, sf_dir))


@query(_UNI + " SELECT asset_id, selection_date, reason FROM u WHERE reason IS NOT NULL AND selection_date = DATE '1999-02-01'")
def universe_last_exclusions(spark, sf_dir):
    return universe.last_exclusions(_universe(spark, sf_dir))


@query(_O + " SELECT event_id, available_at <= t AS included, CASE WHEN available_at > t THEN 'provider-available-after-decision' END AS exclusion_reason FROM observations, cut")
def observation_alignment(spark, sf_dir):
    o = observations(spark, sf_dir)
    return versions.align(o.crossJoin(F.broadcast(_cut(o))), F.col("t"), "available_at").select("event_id", "included", "exclusion_reason")


@query(_CHAIN + """, c2 AS (SELECT asset_id, metric, revision_position, sha256(coalesce(content::VARCHAR, '')) AS cid, asset_id::VARCHAR || '|' || metric AS k FROM ch)
, r AS (WITH RECURSIVE f AS (SELECT asset_id, metric, revision_position, '' AS before, sha256(chr(31) || 'FACT' || chr(31) || k || chr(31) || cid) AS revision_id, cid, k FROM c2 WHERE revision_position = 1
 UNION ALL SELECT c2.asset_id, c2.metric, c2.revision_position, sha256(f.revision_id || chr(31) || f.cid), sha256(sha256(f.revision_id || chr(31) || f.cid) || chr(31) || 'FACT' || chr(31) || c2.k || chr(31) || c2.cid), c2.cid, c2.k FROM f JOIN c2 ON c2.asset_id = f.asset_id AND c2.metric = f.metric AND c2.revision_position = f.revision_position + 1) SELECT * FROM f)
SELECT asset_id, metric, revision_position::INTEGER AS revision_position, nullif(before, '') AS predecessor_id, sha256(revision_id || chr(31) || cid) AS version_id FROM r""")
def revision_ids(spark, sf_dir):
    c = _chain(spark, sf_dir).withColumn("cid", F.sha2(F.coalesce(F.col("content").cast("string"), F.lit("")), 256)).withColumn("k", F.concat_ws("|", F.col("asset_id").cast("string"), "metric"))
    return versions.with_ids(c, "FACT", ["asset_id", "metric"], "cid", "k").select("asset_id", "metric", "revision_position", "predecessor_id", "version_id")
