"""The driver's tables, and the research views derived from them.

Views are lazy DataFrames; each has its SQL twin in VIEWS, for the oracle. Timestamps of the files are without zone and
are read as UTC.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order line: a trade in its part's brand. (date, order, line, part) is a total order."""
    part = load(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("asset_id"))
    line = load(spark, sf_dir, "lineitem")
    return line.join(part, line.l_partkey == part.p_partkey).select(
        "asset_id",
        F.col("l_shipdate").cast("date").alias("trade_date"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("amount"),
        F.col("l_linestatus").alias("line_status"),
        F.col("l_returnflag").alias("return_flag"),
        F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey").alias("ord"),
    )


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly bars by asset: open and close in trade order."""
    t = trades(spark, sf_dir)
    return t.groupBy("asset_id", F.trunc("trade_date", "month").alias("bar_date")).agg(
        F.min_by("price", "ord").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "ord").alias("close"),
        F.sum("quantity").alias("volume"),
        F.sum(F.col("amount").cast("decimal(18,2)")).cast("double").alias("turnover"),
        F.count("*").alias("n_trades"),
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as bitemporal facts of (asset, metric), available when they happened."""
    e = load(spark, sf_dir, "events")
    return e.select("event_id", F.col("user_id").alias("asset_id"), F.col("event_type").alias("metric"), F.col("ts").cast("date").alias("logical_date"), F.col("ts").cast("timestamp").alias("available_at"), "value", "props")


def nav(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly order totals: a portfolio value and a benchmark (one order priority)."""
    o = load(spark, sf_dir, "orders")
    money = F.col("o_totalprice").cast("decimal(18,2)")
    return o.groupBy(F.trunc(F.col("o_orderdate").cast("date"), "month").alias("nav_date")).agg(F.sum(money).cast("double").alias("value"), F.sum(F.when(F.col("o_orderpriority") == "1-URGENT", money)).cast("double").alias("benchmark"))


def holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of positive balance: value, industry (segment), market (region), currency (nation)."""
    c, n, r = (load(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    return c.filter("c_acctbal > 0").join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select(F.col("c_custkey").alias("asset_id"), F.col("c_acctbal").cast("decimal(18,2)").alias("value"), F.col("c_mktsegment").alias("industry"), F.col("r_name").alias("market"), F.col("n_name").alias("currency"))


def open_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trading calendar: every day on which an order was placed, numbered."""
    from .operators.temporal import number_days

    days = load(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    return number_days(days.filter(F.dayofweek("day").between(2, 6)))


def memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's quarters with orders, as closed intervals; the last one is open-ended."""
    from .operators.temporal import islands

    o = load(spark, sf_dir, "orders")
    q = o.select(F.col("o_custkey").alias("asset_id"), (F.year("o_orderdate") * 4 + F.quarter("o_orderdate")).alias("q")).distinct()
    runs = islands(q, ["asset_id"], "q", step=1)
    start = lambda c: F.make_date(F.floor((c - 1) / 4).cast("int"), ((c - 1) % 4 * 3 + 1).cast("int"), F.lit(1))
    last = F.max("range_end").over(Window.partitionBy("asset_id"))
    return runs.withColumn("last", last).select("asset_id", start(F.col("range_start")).alias("effective_from"), F.when(F.col("range_end") < F.col("last"), F.date_sub(start(F.col("range_end") + 1), 1)).alias("effective_to"))


def fx_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pseudo-rate per nation and month: its mean order price over the month's mean, from the month's first day."""
    c, n, o = (load(spark, sf_dir, t) for t in ("customer", "nation", "orders"))
    month = F.trunc(F.col("o_orderdate").cast("date"), "month")
    money = F.col("o_totalprice").cast("decimal(18,2)")
    by = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).groupBy("n_name", month.alias("rate_date")).agg(F.sum(money).cast("double").alias("s"), F.count("*").alias("k"))
    every = by.groupBy("rate_date").agg(F.sum(F.col("s").cast("decimal(28,2)")).cast("double").alias("ts"), F.sum("k").alias("tk"))
    return by.join(every, "rate_date").select(F.col("n_name").alias("source_currency"), F.lit("BASE").alias("target_currency"), "rate_date", ((F.col("s") / F.col("k")) / (F.col("ts") / F.col("tk"))).alias("rate"), F.concat_ws("-", F.col("n_name"), F.col("rate_date").cast("string")).alias("version_id"))


VIEWS = {
    "trades": """trades AS (SELECT p_brand AS asset_id, CAST(l_shipdate AS DATE) AS trade_date, l_extendedprice / l_quantity AS price, l_quantity AS quantity, l_extendedprice AS amount,
        l_linestatus AS line_status, l_returnflag AS return_flag, row(l_shipdate, l_orderkey, l_linenumber, l_partkey) AS ord FROM lineitem JOIN part ON l_partkey = p_partkey)""",
    "bars": """bars AS (SELECT asset_id, CAST(date_trunc('month', trade_date) AS DATE) AS bar_date, arg_min(price, ord) AS open, max(price) AS high, min(price) AS low, arg_max(price, ord) AS close,
        sum(quantity) AS volume, sum(CAST(amount AS DECIMAL(18,2)))::DOUBLE AS turnover, count(*) AS n_trades FROM trades GROUP BY 1, 2)""",
    "observations": """observations AS (SELECT event_id, user_id AS asset_id, event_type AS metric, CAST(ts AS DATE) AS logical_date, ts AS available_at, value, props FROM events)""",
    "nav": """nav AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS nav_date, sum(CAST(o_totalprice AS DECIMAL(18,2)))::DOUBLE AS value,
        sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (o_orderpriority = '1-URGENT')::DOUBLE AS benchmark FROM orders GROUP BY 1)""",
    "holdings": """holdings AS (SELECT c_custkey AS asset_id, CAST(c_acctbal AS DECIMAL(18,2)) AS value, c_mktsegment AS industry, r_name AS market, n_name AS currency
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal > 0)""",
    "open_days": """open_days AS (SELECT day, row_number() OVER (ORDER BY day) AS idx FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders) WHERE dayofweek(day) BETWEEN 1 AND 5)""",
    "memberships": """mq AS (SELECT DISTINCT o_custkey AS asset_id, year(o_orderdate) * 4 + quarter(o_orderdate) AS q FROM orders),
      mr AS (SELECT asset_id, min(q) AS a, max(q) AS b FROM (SELECT asset_id, q, q - row_number() OVER (PARTITION BY asset_id ORDER BY q) AS g FROM mq) GROUP BY asset_id, g),
      memberships AS (SELECT asset_id, make_date(((a - 1) // 4)::INTEGER, ((a - 1) % 4 * 3 + 1)::INTEGER, 1) AS effective_from,
        CASE WHEN b < max(b) OVER (PARTITION BY asset_id) THEN (make_date((b // 4)::INTEGER, (b % 4 * 3 + 1)::INTEGER, 1) - INTERVAL 1 DAY)::DATE END AS effective_to FROM mr)""",
    "fx_rates": """fm AS (SELECT n_name, CAST(date_trunc('month', o_orderdate) AS DATE) AS rate_date, sum(CAST(o_totalprice AS DECIMAL(18,2)))::DOUBLE AS s, count(*) AS k
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2),
      ft AS (SELECT rate_date, sum(CAST(s AS DECIMAL(28,2)))::DOUBLE AS ts, sum(k) AS tk FROM fm GROUP BY 1),
      fx_rates AS (SELECT n_name AS source_currency, 'BASE' AS target_currency, rate_date, (s / k) / (ts / tk) AS rate, concat_ws('-', n_name, rate_date::VARCHAR) AS version_id FROM fm JOIN ft USING (rate_date))""",
}
NEEDS = {"bars": ["trades"]}


def with_views(*names: str) -> str:
    """`WITH ...` of these views and what they need."""
    order: list[str] = []
    for n in names:
        order += [x for x in (*NEEDS.get(n, ()), n) if x not in order]
    return "WITH " + ",\n".join(VIEWS[n] for n in order)
