"""Trading rules, costs, the ledger, settlement, runs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import governance, scale, versions
from ..operators import trading as B
from ..functions.text import close_enough
from ..tables import load, nav, trades, with_views
from .registry import query


@query(with_views("trades") + """, x AS (SELECT row_number() OVER () AS z, * FROM trades),
r AS (SELECT t.ord, CASE WHEN t.asset_id < 'Brand#15' THEN 'missing' WHEN t.asset_id < 'Brand#17' THEN 'ambiguous' ELSE 'resolved' END AS ps, t.price, t.trade_date, floor(t.quantity / 4) * 4 AS lots, CASE WHEN t.line_status = 'F' THEN 'SELL' ELSE 'BUY' END AS side,
  CASE t.return_flag WHEN 'R' THEN 'HALTED' ELSE 'ACTIVE' END AS halt, CASE WHEN t.asset_id >= 'Brand#40' THEN 'A_SHARE' ELSE 'US' END AS market, CASE WHEN t.quantity = 17 THEN NULL ELSE 1500.0 END AS ref, dayofweek(t.trade_date) NOT IN (0, 6) AS has,
  CASE WHEN dayofweek(t.trade_date) = 6 THEN t.trade_date + 2 END AS sd FROM trades t),
o AS (SELECT CASE WHEN ps <> 'resolved' THEN 'profile-' || ps WHEN price <= 0 THEN 'invalid-price' WHEN NOT has THEN CASE WHEN sd IS NOT NULL THEN 'deferred' ELSE 'session-not-permitted' END WHEN lots = 0 THEN 'invalid-lot' WHEN side = 'SELL' AND lots > 30 THEN 'sell-quantity-unavailable'
  WHEN halt <> 'ACTIVE' THEN 'halt:' || halt WHEN ref IS NULL THEN 'price-limit-source-missing' WHEN abs((price - ref) / ref) > CASE WHEN market = 'A_SHARE' THEN 0.1 ELSE 0.3 END THEN CASE WHEN market = 'A_SHARE' THEN 'price-limit' ELSE 'provider-price-band' END ELSE 'fill' END AS outcome FROM r)
SELECT outcome, count(*) AS n FROM o GROUP BY 1""")
def rule_evaluation(spark, sf_dir):
    a, dow = F.col("asset_id"), F.dayofweek("trade_date")
    t = trades(spark, sf_dir).select(
        F.when(a < "Brand#15", "missing").when(a < "Brand#17", "ambiguous").otherwise("resolved").alias("profile_status"),
        "price",
        "trade_date",
        B.lots(F.col("quantity"), F.lit(4)).alias("lot_quantity"),
        F.when(F.col("line_status") == "F", "SELL").otherwise("BUY").alias("side"),
        F.lit(30).alias("sellable"),
        F.when(F.col("return_flag") == "R", "HALTED").otherwise("ACTIVE").alias("halt_status"),
        F.when(a >= "Brand#40", "A_SHARE").otherwise("US").alias("market"),
        F.when(F.col("quantity") != 17, F.lit(1500.0)).alias("reference_price"),
        F.lit(0.1).alias("limit_pct"),
        F.lit(0.3).alias("band_pct"),
        (~dow.isin(1, 7)).alias("has_session"),
        F.when(dow == 7, F.date_add("trade_date", 2)).alias("session_date"),
    )
    return t.select(F.regexp_replace(B.rule_outcome(), "^deferred:.*", "deferred").alias("outcome")).groupBy("outcome").agg(F.count("*").alias("n"))


@query("""SELECT l_returnflag, round(sum(CAST(round(c + greatest(5 - (c + t + p + s), 0), 6) AS DECIMAL(18,6))), 2)::DOUBLE AS commission, round(sum(CAST(round(greatest(c + t + p + s, 5), 6) AS DECIMAL(18,6))), 2)::DOUBLE AS total, count(*) AS n FROM (SELECT l_returnflag, l_extendedprice * 0.0003::DOUBLE AS c, l_extendedprice * 0.001::DOUBLE AS t, l_extendedprice * 0.00002::DOUBLE AS p, l_extendedprice * 0.0005::DOUBLE AS s FROM lineitem) GROUP BY 1""")
def trade_costs(spark, sf_dir):
    c = B.costs(F.col("l_extendedprice"), 0.0003, 0.001, 0.00002, 0.0005, 5.0)
    d = lambda k: F.round(F.sum(F.round(c[k], 6).cast("decimal(18,6)")), 2).cast("double").alias(k)
    return load(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(d("commission"), d("total"), F.count("*").alias("n"))


_REQ = """WITH req AS (SELECT l_suppkey, l_shipdate, l_partkey::VARCHAR AS asset_id, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_quantity::INTEGER AS request_id, CASE WHEN l_linestatus = 'F' AND l_quantity > 40 THEN 'SELL' ELSE 'BUY' END AS side, (l_quantity::BIGINT % 5 + 1) AS want, 10 + (l_partkey % 7) AS price FROM lineitem)"""


def _requests(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem")
    return li.select("l_suppkey", F.col("l_partkey").cast("string").alias("asset_id"), F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.col("l_quantity").cast("int").cast("string")).alias("request_id"), F.col("l_shipdate").alias("executed_at"), F.when((F.col("l_linestatus") == "F") & (F.col("l_quantity") > 40), "SELL").otherwise("BUY").alias("side"), (F.col("l_quantity").cast("long") % 5 + 1).alias("lots_wanted"), F.lit(1).alias("lot"), (10 + F.col("l_partkey") % 7).cast("double").alias("price"))


@query(_REQ + """, o AS (SELECT l_suppkey, list({'s': side, 'w': want, 'p': price} ORDER BY l_shipdate, asset_id, request_id) AS v FROM req GROUP BY 1)
SELECT l_suppkey, list_reduce(list_prepend(1000.0::DOUBLE, list_transform(v, lambda x: x.p * 1000 + x.w + CASE WHEN x.s = 'SELL' THEN 0.5 ELSE 0 END)), lambda c, x: CASE WHEN x % 1 > 0 THEN c + floor(x % 1000) * floor(x / 1000) ELSE c - least(x % 1000, floor(c / floor(x / 1000))) * floor(x / 1000) END)::DOUBLE AS final_cash, len(v) AS n_orders FROM o""")
def ledger_fold(spark, sf_dir):
    return B.ledger_expr(_requests(spark, sf_dir), "l_suppkey", 1000.0).select("l_suppkey", "final_cash", F.col("n_orders").cast("long").alias("n_orders"))


@query()
def ledger_positions(spark, sf_dir):
    """Rows only: the whole fold with halts, bands, positions and costs, per supplier."""
    r = _requests(spark, sf_dir).withColumn("halted", F.col("lots_wanted") == 5).withColumn("reference_price", F.lit(13.0))
    led = B.ledger(r, "l_suppkey", 1000.0, 0.001, 0.25)
    return led.groupBy("outcome").agg(F.count("*").alias("n"), F.sum("filled").alias("filled"), F.count_if((F.col("cash_after") < 0) | (F.col("position_after") < 0)).alias("breaches"))


@query("""WITH f AS (SELECT l_suppkey, CAST(l_shipdate AS DATE) + 2 AS settles, CASE WHEN l_linestatus = 'F' THEN 1 ELSE -1 END * CAST(l_extendedprice AS DECIMAL(18,2)) AS amount FROM lineitem), d AS (SELECT l_suppkey, settles, sum(amount) AS due FROM f GROUP BY 1, 2)
SELECT l_suppkey, settles, due::DOUBLE AS due, (sum(due) OVER (PARTITION BY l_suppkey ORDER BY settles))::DOUBLE AS settled_cash FROM d""")
def cash_settlement_sweep(spark, sf_dir):
    amount = F.when(F.col("l_linestatus") == "F", 1).otherwise(-1) * F.col("l_extendedprice").cast("decimal(18,2)")
    f = load(spark, sf_dir, "lineitem").select("l_suppkey", F.date_add(F.col("l_shipdate").cast("date"), 2).alias("settles"), amount.alias("amount"))
    return B.cash_settlement(f, "l_suppkey", "settles", "amount").select("l_suppkey", "settles", F.col("due").cast("double").alias("due"), F.col("settled_cash").cast("double").alias("settled_cash"))


@query("""WITH s AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) SELECT o_custkey, CASE WHEN n > 1 AND o_custkey % 9 = 1 THEN 'duplicate-asset' WHEN n > 1 AND o_custkey % 9 = 2 THEN 'negative-weight' WHEN n > 1 AND o_custkey % 9 = 0 THEN 'sum' ELSE 'ok' END AS status FROM s""")
def target_weight_check(spark, sf_dir):
    o, k = load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), F.col("o_custkey") % 9
    every = Window.partitionBy("o_custkey")
    w = o.withColumn("n", F.count("*").over(every)).withColumn("first", F.min("o_orderkey").over(every)).withColumn("is_first", F.col("first") == F.col("o_orderkey"))
    several = F.col("n") > 1
    weight = F.when(several & (k == 0), 0.9 / F.col("n")).when(several & (k == 2), F.when(F.col("is_first"), -0.5).otherwise(1.5 / (F.col("n") - 1))).otherwise(1.0 / F.col("n"))
    return B.weight_check(w.withColumn("asset", F.when(several & (k == 1), F.col("first")).otherwise(F.col("o_orderkey"))).withColumn("weight", weight), "o_custkey", "asset", "weight")


@query("""WITH a AS (SELECT p_partkey, p_size AS quantity, DATE '1996-01-01' + (p_partkey % 700)::INTEGER AS held_from FROM part), ev AS (SELECT DISTINCT l_partkey, date_trunc('year', l_shipdate)::DATE AS effective_date FROM lineitem WHERE l_quantity >= 49),
j AS (SELECT a.p_partkey, quantity, held_from, count(*) FILTER (effective_date > held_from) AS n FROM a LEFT JOIN ev ON l_partkey = p_partkey GROUP BY 1, 2, 3) SELECT p_partkey, n AS n_events, round(quantity * pow(2.0, n), 6) AS adjusted_quantity FROM j""")
def corporate_action_application(spark, sf_dir):
    p = load(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("quantity"), F.date_add(F.lit("1996-01-01").cast("date"), (F.col("p_partkey") % 700).cast("int")).alias("held_from"))
    ev = load(spark, sf_dir, "lineitem").filter("l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey"), F.trunc(F.col("l_shipdate").cast("date"), "year").alias("effective_date"))
    ev = ev.withColumn("event_id", F.concat_ws("-", "p_partkey", F.col("effective_date").cast("string"))).withColumn("ratio", F.lit(2.0))
    return B.apply_actions(p, ev, "p_partkey").select("p_partkey", "n_events", F.round("adjusted_quantity", 6).alias("adjusted_quantity"))


@query("""SELECT o_custkey, CAST(o_orderdate AS DATE) AS decision_date, count(*) AS n FROM orders GROUP BY 1, 2 HAVING count(*) > 1""")
def duplicate_decisions(spark, sf_dir):
    return load(spark, sf_dir, "orders").groupBy("o_custkey", F.col("o_orderdate").cast("date").alias("decision_date")).agg(F.count("*").alias("n")).filter("n > 1")


@query("""SELECT row_number() OVER (ORDER BY o_orderdate, o_custkey, o_orderkey) AS seq, o_orderkey FROM orders""")
def event_total_order(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select("o_orderdate", "o_custkey", "o_orderkey")
    return scale.total_order(o, F.col("o_orderdate").cast("date"), ["o_orderdate", "o_custkey", "o_orderkey"], "seq").select("seq", "o_orderkey")


@query(with_views("nav") + """, a AS (SELECT nav_date, value, round(value, -3) * CASE WHEN month(nav_date) % 2 = 1 THEN 1.01::DOUBLE ELSE 1 END AS other FROM nav) SELECT nav_date, abs(value - other) <= 1e-3 * greatest(1, abs(value), abs(other)) AS same, value < other AS rose FROM a""")
def run_comparison(spark, sf_dir):
    a = nav(spark, sf_dir).select("nav_date", "value")
    b = a.select("nav_date", (F.round("value", -3) * F.when(F.month("nav_date") % 2 == 1, 1.01).otherwise(1.0)).alias("other"))
    return a.join(b, "nav_date", "full").select("nav_date", close_enough(F.col("value"), F.col("other"), 1e-3).alias("same"), (F.col("value") < F.col("other")).alias("rose"))


_MANIFEST = """WITH a AS (SELECT o_custkey AS run_id, sha256(o_custkey::VARCHAR || ':' || o_orderkey::VARCHAR || '|' || sha256({content})) AS h FROM orders),
b AS (SELECT run_id, substr(h, 1, 3) AS b, sha256(string_agg(h, ',' ORDER BY h)) AS d, count(*) AS n FROM a GROUP BY 1, 2),
m AS (SELECT run_id, sum(n)::BIGINT AS n_artifacts, sha256(sha256(string_agg(d, ',' ORDER BY b)) || '|42') AS manifest_id FROM b GROUP BY 1)"""


def _manifest(spark, sf_dir, content):
    return governance.experiment_manifest(load(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", content, 42).withColumnRenamed("o_custkey", "run_id")


@query(_MANIFEST.format(content="o_orderstatus") + " SELECT run_id, n_artifacts, manifest_id FROM m")
def experiment_manifest(spark, sf_dir):
    return _manifest(spark, sf_dir, F.col("o_orderstatus"))


_CHANGED = "CASE WHEN o_custkey % 5 = 0 THEN o_orderpriority ELSE o_orderstatus END"


@query(_MANIFEST.format(content="o_orderstatus") + ", " + _MANIFEST.format(content=_CHANGED).replace("WITH a AS", "a2 AS").replace("FROM a GROUP", "FROM a2 GROUP").replace("b AS (SELECT run_id, sub", "b2 AS (SELECT run_id, sub").replace("FROM b GROUP", "FROM b2 GROUP").replace("m AS (SELECT run_id, sum", "m2 AS (SELECT run_id, sum") + " SELECT m.run_id, CASE WHEN m.manifest_id = m2.manifest_id THEN 'same' ELSE 'mismatch' END AS status FROM m JOIN m2 USING (run_id)")
def replay_check(spark, sf_dir):
    changed = F.when(F.col("o_custkey") % 5 == 0, F.col("o_orderpriority")).otherwise(F.col("o_orderstatus"))
    return governance.replay_check(_manifest(spark, sf_dir, F.col("o_orderstatus")), _manifest(spark, sf_dir, changed), "run_id").select("run_id", "status")


@query("""WITH r AS (SELECT o_orderkey, CASE o_custkey % 4 WHEN 0 THEN 'p0' WHEN 1 THEN 'p1' WHEN 2 THEN 'p2' ELSE 'none' END AS provider, CASE WHEN o_orderkey % 3 = 0 THEN 'bars' WHEN o_orderkey % 3 = 1 THEN 'navs' ELSE 'facts' END AS category, CASE o_orderkey % 5 WHEN 0 THEN 'export' WHEN 1 THEN 'retain' ELSE 'use' END AS action, o_orderdate FROM orders)
SELECT o_orderkey, CASE WHEN provider = 'none' THEN 'compliance/profile-missing' WHEN provider = 'p1' AND o_orderdate > TIMESTAMP '1998-01-01' THEN 'compliance/profile-inactive' WHEN category = 'facts' AND provider <> 'p2' THEN 'compliance/category-unsupported'
WHEN action = 'retain' AND category = 'navs' THEN 'compliance/retention-prohibited' WHEN action = 'export' AND (category <> 'bars' OR provider = 'p1') THEN 'compliance/export-prohibited' ELSE 'allowed' END AS outcome FROM r""")
def compliance_gate(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    r = load(spark, sf_dir, "orders").select("o_orderkey", F.when(c % 4 == 0, "p0").when(c % 4 == 1, "p1").when(c % 4 == 2, "p2").otherwise("none").alias("provider"), F.when(k % 3 == 0, "bars").when(k % 3 == 1, "navs").otherwise("facts").alias("category"), F.when(k % 5 == 0, "export").when(k % 5 == 1, "retain").otherwise("use").alias("action"), F.col("o_orderdate").cast("timestamp").alias("request_at"))
    profiles = spark.sql("""SELECT * FROM VALUES
      ('p0', 'old', 1, TIMESTAMP'1990-01-01', TIMESTAMP'1991-01-01', array('bars'), map('bars', false), map('bars', false)),
      ('p0', 'v0', 2, TIMESTAMP'1990-01-01', NULL, array('bars', 'navs'), map('bars', true, 'navs', false), map('bars', true)),
      ('p1', 'v1', 1, TIMESTAMP'1990-01-01', TIMESTAMP'1998-01-01', array('bars', 'navs'), map('bars', true), map('navs', false)),
      ('p2', 'v2', 1, TIMESTAMP'1990-01-01', NULL, array('bars', 'navs', 'facts'), map('bars', true, 'facts', true), map('bars', true))
      AS t(provider, version_id, position, effective_from, effective_to, categories, retention, export)""")
    return governance.compliance_gate(r, profiles).select("o_orderkey", "outcome")


@query("""SELECT p_partkey, list_sort(list_filter([CASE WHEN p_partkey % 11 = 0 THEN 'provider_name' END, CASE WHEN p_partkey % 13 <> 0 AND p_size > 45 THEN 'provenance' END, CASE WHEN p_partkey % 13 <> 0 AND p_size < 5 THEN 'request_limits' END], lambda x: x IS NOT NULL)) AS codes,
CASE WHEN p_partkey % 13 = 0 THEN 'unsupported-contract-version:0' END AS incompatible_reason, p_partkey % 11 <> 0 AND p_partkey % 13 <> 0 AND p_size BETWEEN 5 AND 45 AND p_partkey % 2 = 0 AS may_enable FROM part""")
def provider_capabilities(spark, sf_dir):
    k, size = F.col("p_partkey"), F.col("p_size")
    a = load(spark, sf_dir, "part").select("p_partkey", k.cast("string").alias("adapter_id"), F.when(k % 11 == 0, " ").otherwise("some").alias("provider_name"), F.when(k % 13 == 0, "0").otherwise("1").alias("contract_version"), F.lit("supported").alias("normalized_response"), F.when(size > 45, "perhaps").otherwise("unknown").alias("provenance"), F.lit("unsupported").alias("categorized_errors"), F.when(size < 5, 0).when(size > 20, 1000).alias("max_requests_per_period"), F.when(size < 5, 60).when(size > 20, 60).alias("measurement_period_seconds"))
    shown = a.filter(k % 2 == 0).select("adapter_id")
    return governance.adapter_status(a, shown, "1").select("p_partkey", "codes", "incompatible_reason", "may_enable")


@query("""SELECT o_orderkey, list_sort(list_filter([CASE WHEN o_orderkey % 7 = 0 THEN 'version.missing' END, CASE WHEN o_orderstatus = 'P' THEN 'snapshot.unavailable' END, CASE WHEN o_orderkey % 10 = 0 THEN 'date_range.invalid' END, CASE WHEN o_custkey % 3 = 0 THEN 'base_currency.invalid' END], lambda x: x IS NOT NULL)) AS codes FROM orders""")
def run_request_validation(spark, sf_dir):
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    names = {c: F.lit("v1") for c in governance.RUN_IDENTIFIERS} | {"snapshot_id": F.col("o_orderstatus"), "strategy_version": F.when(k % 7 == 0, " ").otherwise("s")}
    r = load(spark, sf_dir, "orders").select("o_orderkey", *[c.alias(n) for n, c in names.items()], F.when(k % 10 == 0, F.date_add(day, 1)).otherwise(day).alias("start_date"), day.alias("end_date"), F.when(F.col("o_custkey") % 3 == 0, "EURO").otherwise("EUR").alias("base_currency"))
    return r.select("o_orderkey", governance.run_request_codes(["F", "O"]).alias("codes"))


@query()
def table_manifest(spark, sf_dir):
    """Rows only (the hash is Spark's own): order-insensitive content of the orders table."""
    return versions.manifest(load(spark, sf_dir, "orders"))


@query()
def infeasible_subset(spark, sf_dir):
    """Rows only: minimal infeasible constraint subsets over part sizes, five parts a group."""
    p = load(spark, sf_dir, "part")
    g = F.floor(F.col("p_partkey") / 5).alias("grp")
    rows = p.select(g, F.concat(F.lit("c"), F.lpad(F.col("p_partkey").cast("string"), 12, "0")).alias("constraint_id"), F.create_map(F.lit("x"), F.lit(1.0), F.when(F.col("p_size") % 2 == 0, "y").otherwise("z"), F.lit(1.0)).alias("coefficients"), F.when(F.col("p_size") > 25, F.col("p_size") / 10.0).alias("lower"), F.when(F.col("p_size") <= 25, F.col("p_size") / 10.0).alias("upper"))
    nonneg = p.select(g).distinct().select("grp", F.explode(F.array(*[F.struct(F.lit(f"n{v}").alias("c"), F.lit(v).alias("v")) for v in "xyz"])).alias("s")).select("grp", F.col("s.c").alias("constraint_id"), F.create_map("s.v", F.lit(1.0)).alias("coefficients"), F.lit(0.0).alias("lower"), F.lit(1.2).alias("upper"))
    return B.infeasible_subsets(rows.unionByName(nonneg), "grp")


@query("""SELECT o_orderkey, (greatest(floor(least(o_totalprice / (1 + 0.001::DOUBLE), o_totalprice - 30000) / (10 * (1 + o_custkey % 50))), 0) * 10)::BIGINT AS affordable FROM orders""")
def affordable_quantity(spark, sf_dir):
    price = (1 + F.col("o_custkey") % 50).cast("double")
    return load(spark, sf_dir, "orders").select("o_orderkey", B.affordable(F.col("o_totalprice"), price, F.lit(10), 0.001, 30000.0).alias("affordable"))


@query("""WITH r AS (SELECT o_orderkey, o_custkey, o_orderdate, count(*) OVER (PARTITION BY o_custkey, o_orderdate::DATE) AS n FROM orders)
SELECT o_orderkey, list_sort(list_filter([CASE WHEN o_orderkey % 10 = 0 THEN 'requested_quantity.positive' END, CASE WHEN o_orderkey % 11 = 0 THEN 'requested_price.negative' END, CASE WHEN o_orderkey % 6 = 0 THEN 'inputs.look_ahead' END, CASE WHEN n > 1 THEN 'decision.duplicate' END], lambda x: x IS NOT NULL)) AS codes FROM r""")
def trade_request_validation(spark, sf_dir):
    k = F.col("o_orderkey")
    o = load(spark, sf_dir, "orders")
    r = o.select("o_orderkey", k.cast("string").alias("request_id"), F.col("o_custkey").alias("asset_id"), F.col("o_orderdate").alias("decision_at"), F.when(k % 10 == 0, 0).otherwise(5).alias("requested_quantity"), F.when(k % 11 == 0, -1).otherwise(0).alias("requested_price"))
    late = F.when(k % 6 == 0, F.col("o_orderdate") + F.expr("interval 1 second")).otherwise(F.col("o_orderdate"))
    inputs = o.filter(k % 2 == 0).select(k.cast("string").alias("request_id"), late.alias("available_at"))
    return B.request_violations(r, inputs).select("o_orderkey", "codes")


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 1 THEN ['experiment_id'] WHEN 2 THEN ['data_snapshot_id', 'fx_policy_version_id'] ELSE CAST([] AS VARCHAR[]) END AS missing FROM part""")
def plan_pins(spark, sf_dir):
    k = F.col("p_partkey") % 4
    pins = {c: F.lit("v") for c in B.PINS} | {"experiment_id": F.when(k == 1, " ").otherwise("e"), "data_snapshot_id": F.when(k != 2, "s"), "fx_policy_version_id": F.when(k == 2, "").otherwise("f")}
    return load(spark, sf_dir, "part").select("p_partkey", *[v.alias(c) for c, v in pins.items()]).select("p_partkey", B.missing_pins().alias("missing"))


@query("""WITH r AS (SELECT o_orderkey, o_custkey, CASE o_custkey % 5 WHEN 0 THEN 'M0' WHEN 1 THEN 'M1' ELSE 'M2' END AS market, o_orderdate FROM orders),
s AS (SELECT CASE s_suppkey % 2 WHEN 0 THEN 'M1' ELSE 'M2' END AS market, TIMESTAMP '1996-01-01 09:30:00' + INTERVAL 1 DAY * (s_suppkey * 13 % 1500) AS start_at FROM supplier WHERE s_suppkey % 7 > 0),
j AS (SELECT r.*, (SELECT min(start_at) FROM s WHERE s.market = r.market AND s.start_at > r.o_orderdate) AS execution_at, CASE WHEN market = 'M0' THEN 'rule-missing' WHEN market = 'M1' AND o_orderdate::DATE BETWEEN DATE '1998-01-01' AND DATE '1998-06-30' THEN 'rule-ambiguous' END AS bad FROM r),
t AS (SELECT *, coalesce(bad, CASE WHEN execution_at IS NULL THEN 'session-missing' ELSE 'scheduled' END) AS status FROM j)
SELECT o_orderkey, status, execution_at::VARCHAR AS execution_at, CASE WHEN status = 'scheduled' THEN row_number() OVER (PARTITION BY status ORDER BY execution_at, o_custkey, o_orderkey::VARCHAR) END AS seq FROM t""")
def request_schedule(spark, sf_dir):
    c = F.col("o_custkey") % 5
    r = load(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("request_id"), F.col("o_custkey").alias("asset_id"), F.when(c == 0, "M0").when(c == 1, "M1").otherwise("M2").alias("market"), F.col("o_orderdate").alias("decision_at"))
    rules = spark.sql("SELECT * FROM VALUES ('M1', 'a', DATE'1990-01-01', NULL), ('M1', 'b', DATE'1998-01-01', DATE'1998-06-30'), ('M2', 'c', DATE'1990-01-01', NULL) AS t(market, version_id, effective_from, effective_to)")
    k = F.col("s_suppkey")
    start = F.date_add(F.lit("1996-01-01").cast("date"), (k * 13 % 1500).cast("int")).cast("timestamp_ntz") + F.expr("interval 570 minutes")
    sessions = load(spark, sf_dir, "supplier").select(F.when(k % 2 == 0, "M1").otherwise("M2").alias("market"), start.alias("start_at"), F.when(k % 7 > 0, "regular").otherwise("non_regular").alias("kind"))
    got = B.schedule(r, rules, sessions)
    return got.select("o_orderkey", "status", F.date_format("execution_at", "yyyy-MM-dd HH:mm:ss").alias("execution_at"), "seq")


@query("""WITH p AS (SELECT p_partkey, p_size AS quantity, DATE '1996-01-01' + (p_partkey % 700)::INTEGER AS held_from FROM part), e AS (SELECT DISTINCT l_partkey, date_trunc('quarter', l_shipdate)::DATE AS ex_date FROM lineitem WHERE l_quantity >= 45)
SELECT p_partkey, ex_date + 10 AS payment_date, round(sum(quantity * 0.25::DOUBLE * 0.9::DOUBLE), 6) AS credit, count(*) AS n_positions FROM p JOIN e ON l_partkey = p_partkey WHERE held_from < ex_date GROUP BY 1, 2""")
def cash_distribution(spark, sf_dir):
    p = load(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("quantity"), F.date_add(F.lit("1996-01-01").cast("date"), (F.col("p_partkey") % 700).cast("int")).alias("held_from"))
    ex = F.trunc(F.col("l_shipdate").cast("date"), "quarter")
    a = load(spark, sf_dir, "lineitem").filter("l_quantity >= 45").select(F.col("l_partkey").alias("p_partkey"), ex.alias("ex_date"))
    a = a.select("p_partkey", "ex_date", F.date_add("ex_date", 10).alias("payment_date"), F.concat_ws("-", F.col("p_partkey").cast("string"), F.col("ex_date").cast("string")).alias("event_id"), F.lit(0.25).alias("per_share"))
    return B.cash_distributions(p, a, "p_partkey", 0.1).select("p_partkey", "payment_date", F.round("credit", 6).alias("credit"), "n_positions")
