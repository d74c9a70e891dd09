"""The query surface: typed pages, predicates, search, JSON paths, text rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import query as Q
from ..operators import quality, scale, versions
from ..tables import bars, load, observations, with_views
from .registry import query


def _daily_bars(spark, sf_dir):
    b = bars(spark, sf_dir)
    currency = F.when(F.substring("asset_id", 7, 1) == "1", "USD").when(F.substring("asset_id", 7, 1) == "2", "JPY").otherwise("EUR")
    return b.select(F.col("asset_id").alias("canonical_asset_id"), F.col("bar_date").alias("observation_date"), currency.alias("trading_currency"), F.concat_ws("-", "asset_id", F.col("bar_date").cast("string")).alias("version_id"), F.lit("sim").alias("provider"), F.col("n_trades").cast("long").alias("n_trades"))


_DAILY = with_views("bars") + """,
daily AS (SELECT asset_id AS canonical_asset_id, bar_date AS observation_date, CASE substr(asset_id, 7, 1) WHEN '1' THEN 'USD' WHEN '2' THEN 'JPY' ELSE 'EUR' END AS trading_currency,
  asset_id || '-' || bar_date::VARCHAR AS version_id, 'sim' AS provider, n_trades::BIGINT AS n_trades FROM bars)"""


@query(_DAILY + """ SELECT * FROM daily WHERE trading_currency IN ('USD', 'JPY') ORDER BY canonical_asset_id NULLS FIRST, observation_date NULLS FIRST, version_id NULLS FIRST LIMIT 50 OFFSET 25""")
def typed_query_page(spark, sf_dir):
    q = Q.TypedQuery("s1", "DAILY_BAR", (Q.QueryFilter("trading_currency", ("USD", "JPY")),), limit=50, offset=25)
    return Q.run(q, {"DAILY_BAR": _daily_bars(spark, sf_dir)}, {"s1"})[0]


@query(_DAILY + """, m AS (SELECT count(*) AS n FROM daily WHERE trading_currency IN ('USD', 'JPY')) SELECT n AS matching_count, greatest(least(n - 25, 50), 0)::BIGINT AS returned_count, n > 75 AS additional_results FROM m""")
def typed_query_counts(spark, sf_dir):
    q = Q.TypedQuery("s1", "DAILY_BAR", (Q.QueryFilter("trading_currency", ("USD", "JPY")),), limit=50, offset=25)
    return Q.run(q, {"DAILY_BAR": _daily_bars(spark, sf_dir)}, {"s1"})[1]


@query("""SELECT l_returnflag, count(*) AS n, sum(CAST(l_quantity AS BIGINT))::BIGINT AS quantity FROM lineitem
WHERE l_quantity > 10 AND l_quantity <= 40 AND l_returnflag <> 'N' AND l_shipdate >= DATE '1996-01-01' AND l_discount BETWEEN 0.02 AND 0.08 AND l_linestatus = 'F' GROUP BY 1""")
def predicate_matrix(spark, sf_dir):
    import datetime

    p = Q.predicate([("l_quantity", ">", 10), ("l_quantity", "<=", 40), ("l_returnflag", "<>", "N"), ("l_shipdate", ">=", datetime.date(1996, 1, 1))]) & Q.filter_map({"l_discount": (0.02, 0.08), "l_linestatus": "F"})
    return load(spark, sf_dir, "lineitem").filter(p).groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"))


@query("""SELECT p_partkey, p_name, p_brand FROM part WHERE p_size >= 30 AND p_brand = 'Brand#12' ORDER BY p_partkey""")
def engine_select(spark, sf_dir):
    return Q.select(load(spark, sf_dir, "part"), ["p_partkey", "p_name", "p_brand"], [("p_size", ">=", 30), ("p_brand", "=", "Brand#12")], None)


@query("""SELECT p_name, p_brand FROM part WHERE contains(lower(p_name), '#1') OR contains(lower(p_brand), '#1') ORDER BY p_name, p_brand LIMIT 50""")
def substring_catalog(spark, sf_dir):
    return Q.search(load(spark, sf_dir, "part"), " #1 ", ["p_name", "p_brand"], 500).select("p_name", "p_brand")


@query("""SELECT p_partkey, p_name, p_brand FROM part WHERE contains(lower(p_name), 'brand#2') OR contains(lower(p_brand), 'brand#2') """)
def substring_indexed(spark, sf_dir):
    """All matches, by the trigram postings."""
    p = load(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    postings = Q.trigrams(p, "p_partkey", ["p_name", "p_brand"])
    return Q.candidates(p, postings, "p_partkey", "Brand#2").filter(F.lower("p_name").contains("brand#2") | F.lower("p_brand").contains("brand#2"))


@query("""SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1""")
def optional_filter(spark, sf_dir):
    return Q.optional(load(spark, sf_dir, "orders"), o_orderstatus="F", o_orderpriority=None).groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("""SELECT event_type, count(*) AS n, sum(k)::BIGINT AS total, max(k) AS largest FROM (SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) WHERE k >= 50 GROUP BY 1""")
def json_path_filter(spark, sf_dir):
    k = F.get_json_object("props", "$.k").try_cast("long")
    return load(spark, sf_dir, "events").select("event_type", k.alias("k")).filter("k >= 50").groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("total"), F.max("k").alias("largest"))


_EN = "CASE WHEN contains(m, 'data') OR contains(m, 'table') OR contains(m, 'column') THEN 'query_dataset' WHEN contains(m, 'test') OR contains(m, 'run') THEN 'run_backtest' WHEN contains(m, 'rule') OR contains(m, 'lot') THEN 'open_sources' ELSE 'show_quote' END"


@query(f"""SELECT action, role, count(*) AS n FROM (SELECT role, {_EN} AS action FROM (SELECT role, lower(coalesce(text, '')) AS m FROM conversations)) GROUP BY 1, 2""")
def intent_routing(spark, sf_dir):
    groups = ((("data", "table", "column"), "query_dataset"), (("test", "run"), "run_backtest"), (("rule", "lot"), "open_sources"))
    return load(spark, sf_dir, "conversations").select("role", T.intent(F.coalesce("text", F.lit("")), groups).alias("action")).groupBy("action", "role").agg(F.count("*").alias("n"))


@query("""SELECT doc_id, md5(replace(replace(replace(text, 'token', '[REDACTED]'), 'from', '[REDACTED]'), 'the', '[REDACTED]')) AS digest FROM documents WHERE text IS NOT NULL""")
def redaction(spark, sf_dir):
    return load(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.md5(T.redact(F.col("text"), ["the", "from", "token", ""])).alias("digest"))


_URL = "'https://' || CASE page_id % 3 WHEN 0 THEN 'Example.com:443' WHEN 1 THEN 'example.com' ELSE 'user@example.com:443' END || CASE page_id % 5 WHEN 0 THEN '/api/../a' WHEN 1 THEN '/a/./b' WHEN 2 THEN '/b/%2e%2e/a' WHEN 3 THEN '/a/../../x' ELSE '/b' END || CASE page_id % 7 WHEN 0 THEN '?q=1' ELSE '' END"


@query(f"""WITH u AS (SELECT page_id, {_URL} AS url, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1)) AS authority FROM pages) SELECT page_id, url, page_id % 3 = 0 AND page_id % 5 < 3 AND page_id % 7 <> 0 AS allowed, authority FROM u""")
def url_scope(spark, sf_dir):
    p, k = load(spark, sf_dir, "pages"), F.col("page_id")
    host = F.when(k % 3 == 0, "Example.com:443").when(k % 3 == 1, "example.com").otherwise("user@example.com:443")
    path = F.when(k % 5 == 0, "/api/../a").when(k % 5 == 1, "/a/./b").when(k % 5 == 2, "/b/%2e%2e/a").when(k % 5 == 3, "/a/../../x").otherwise("/b")
    url = F.concat(F.lit("https://"), host, path, F.when(k % 7 == 0, "?q=1").otherwise(""))
    u = p.select("page_id", url.alias("made"), F.lower(F.regexp_extract("url", r"^[a-zA-Z]+://([^/?#]+)", 1)).alias("authority"))
    return u.select("page_id", F.col("made").alias("url"), T.url_allowed(F.col("made"), "https://example.com:443", "/a").alias("allowed"), "authority")


@query("""SELECT c_custkey, upper(substr(sha256('us|equity|' || lower(trim(c_mktsegment)) || '|' || lower(trim(c_name))), 1, 20)) AS canonical_id FROM customer""")
def asset_identity_hash(spark, sf_dir):
    return load(spark, sf_dir, "customer").select("c_custkey", T.canonical_asset_id(F.lit(" US "), F.lit("EQUITY"), F.col("c_mktsegment"), F.col("c_name")).alias("canonical_id"))


@query("""SELECT o_orderkey, sha256(concat_ws(chr(31), o_orderkey::VARCHAR, o_custkey::VARCHAR, coalesce(o_orderstatus, ''), coalesce(o_orderpriority, ''))) AS content_id FROM orders""")
def content_hash(spark, sf_dir):
    return load(spark, sf_dir, "orders").select("o_orderkey", versions.content_id("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority").alias("content_id"))


@query("""WITH h AS (SELECT o_orderstatus, sha256(o_orderkey::VARCHAR) AS h FROM orders), b AS (SELECT o_orderstatus, substr(h, 1, 3) AS b, count(*) AS n, sha256(string_agg(h, ',' ORDER BY h)) AS d FROM h GROUP BY 1, 2)
SELECT o_orderstatus, sum(n)::BIGINT AS row_count, sha256(string_agg(d, ',' ORDER BY b)) AS checksum FROM b GROUP BY 1""")
def content_hash_manifest(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select("o_orderstatus", F.sha2(F.col("o_orderkey").cast("string"), 256).alias("h"))
    return scale.bucketed_digest(o, ["o_orderstatus"], "h", "checksum")


@query("""SELECT l_linestatus, count(*) FILTER (bad_low) AS n_low, count(*) FILTER (bad_high) AS n_high, count(*) FILTER (bad_low OR bad_high) AS n_any, count(*) AS n
FROM (SELECT l_linestatus, l_discount < 0.01 AS bad_low, l_quantity > 45 AS bad_high FROM lineitem) GROUP BY 1""")
def violations_summary(spark, sf_dir):
    codes = quality.violations(discount__low=F.col("l_discount") < 0.01, quantity__high=F.col("l_quantity") > 45)
    v = load(spark, sf_dir, "lineitem").select("l_linestatus", codes.alias("codes"))
    has = lambda c: F.count_if(F.array_contains("codes", c))
    return v.groupBy("l_linestatus").agg(has("discount.low").alias("n_low"), has("quantity.high").alias("n_high"), F.count_if(F.size("codes") > 0).alias("n_any"), F.count("*").alias("n"))


@query("""SELECT c_custkey, array_to_string(list_sort(list_filter([CASE WHEN c_acctbal < 0 THEN 'balance.negative' END, CASE WHEN c_acctbal > 9000 THEN 'balance.range' END, CASE WHEN NOT regexp_matches(c_mktsegment, '^[A-Z]{8,9}$') THEN 'segment.format' END], lambda x: x IS NOT NULL)), ',') AS codes FROM customer""")
def violations_array(spark, sf_dir):
    codes = quality.violations(balance__negative=F.col("c_acctbal") < 0, balance__range=F.col("c_acctbal") > 9000, segment__format=~F.col("c_mktsegment").rlike("^[A-Z]{8,9}$"))
    return load(spark, sf_dir, "customer").select("c_custkey", F.array_join(codes, ",").alias("codes"))


_RULES = [("r1", "numeric_ranges", "rejected", True), ("r2", "date_validity", "warning", True), ("r3", "required_fields", "valid", True), ("r4", "uniqueness", "warning", False)]


@query("""WITH f AS (SELECT user_id, unnest(list_filter([CASE WHEN value < 5 THEN 'rejected' END, CASE WHEN dayofmonth(ts) > 25 THEN 'warning' END, CASE WHEN props IS NULL OR value > 90 THEN 'valid' END], lambda x: x IS NOT NULL)) AS severity FROM events)
SELECT user_id, count(*) AS n_issues, count(*) FILTER (severity = 'valid') AS n_valid, count(*) FILTER (severity = 'warning') AS n_warning, count(*) FILTER (severity = 'rejected') AS n_rejected,
CASE WHEN bool_or(severity = 'rejected') THEN 'rejected' WHEN bool_or(severity = 'warning') THEN 'warning' ELSE 'valid' END AS status FROM f GROUP BY 1""")
def quality_report(spark, sf_dir):
    rules = spark.createDataFrame(_RULES, "rule_id string, rule_kind string, severity string, enabled boolean")
    e = load(spark, sf_dir, "events")
    checks = {"numeric_ranges": F.col("value") < 5, "date_validity": F.dayofmonth("ts") > 25, "required_fields": F.col("props").isNull() | (F.col("value") > 90)}
    return quality.report(quality.issues(e, rules, checks, "user_id"), ["user_id"])


@query("""SELECT event_id, CASE WHEN event_type = 'click' AND value > 50 THEN 'suspended' WHEN event_type = 'view' THEN 'delayed_valuation' WHEN value < 10 THEN 'unresolved' ELSE 'expected' END AS reason FROM events""")
def gap_reasons(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("event_id", ((F.col("event_type") == "click") & (F.col("value") > 50)).alias("suspended"), (F.col("event_type") == "view").alias("delayed_valuation"), (F.col("value") < 10).alias("unresolved"))
    return e.select("event_id", quality.gap_reason("suspended", "delayed_valuation", "unresolved").alias("reason"))


@query("""SELECT event_id, CAST((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS DATE) AS ny_date, CAST((ts AT TIME ZONE 'UTC') AT TIME ZONE 'Asia/Shanghai' AS DATE) AS sh_date FROM events""")
def market_local_date(spark, sf_dir):
    ts = F.col("ts").cast("timestamp")
    return load(spark, sf_dir, "events").select("event_id", T.market_date(ts, "America/New_York").alias("ny_date"), T.market_date(ts, "Asia/Shanghai").alias("sh_date"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, floor(l_quantity / 5)::BIGINT * 5 AS lots, (CAST(l_extendedprice / l_quantity AS DECIMAL(18,6)) * 1000000)::BIGINT // 50000 * 5 AS ticks_cents FROM lineitem""")
def lot_tick_floor(spark, sf_dir):
    from ..operators.trading import lots, tick_floor

    li = load(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", lots(F.col("l_quantity"), F.lit(5)).cast("long").alias("lots"), (tick_floor(F.col("l_extendedprice") / F.col("l_quantity"), F.lit("0.05")) * 100).cast("long").alias("ticks_cents"))


_METRIC = "CASE p_size % 6 WHEN 0 THEN 'price' WHEN 1 THEN 'cash.free' WHEN 2 THEN 'cost of sales' WHEN 3 THEN 'priced' WHEN 4 THEN 'net revenue' ELSE p_type END"


@query(f"""SELECT p_partkey, upper(trim(substr(p_name, 1, 3 + (p_partkey % 3)::INTEGER))) AS code, regexp_full_match(upper(trim(substr(p_name, 1, 3 + (p_partkey % 3)::INTEGER))), '[A-Z]{{3}}') AS valid, {_METRIC} AS metric, p_size % 6 < 3 AS money FROM part""")
def code_rules(spark, sf_dir):
    code = F.substring("p_name", F.lit(1), (3 + F.col("p_partkey") % 3).cast("int"))
    size = F.col("p_size") % 6
    metric = F.when(size == 0, "price").when(size == 1, "cash.free").when(size == 2, "cost of sales").when(size == 3, "priced").when(size == 4, "net revenue").otherwise(F.col("p_type"))
    return load(spark, sf_dir, "part").select("p_partkey", F.upper(F.trim(code)).alias("code"), T.currency_code(code).isNotNull().alias("valid"), metric.alias("metric"), T.money_metric(metric).alias("money"))


@query("""SELECT p_partkey, CASE WHEN CAST(p_retailprice AS DECIMAL(28,8)) > 0 THEN CAST(CAST(p_retailprice AS DECIMAL(28,2)) AS VARCHAR) END AS price FROM part""")
def decimal_parse(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", T.positive_decimal(F.col("p_retailprice").cast("string")).cast("decimal(28,2)").cast("string").alias("price"))


@query("""SELECT user_id, string_agg(event_type, ',' ORDER BY event_type) AS metrics FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY 1""")
def distinct_sorted_set(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("user_id", "event_type").distinct()
    return e.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("metrics"))


@query("""WITH r AS (SELECT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F'), c AS (SELECT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F' AND (o_custkey % 2 = 0 OR o_orderpriority <> '5-LOW') UNION ALL SELECT o_custkey, o_orderpriority FROM orders WHERE o_custkey % 5 = 0),
a AS (SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority)) AS s FROM r GROUP BY 1), b AS (SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority)) AS s FROM c GROUP BY 1)
SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, coalesce(len(a.s), 0) AS n_rejected, coalesce(len(b.s), 0) AS n_confirmed, a.s IS NOT DISTINCT FROM b.s AS confirmed FROM a FULL JOIN b ON a.o_custkey = b.o_custkey""")
def rejected_confirmation(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    r = o.filter("o_orderstatus = 'F'")
    c = r.filter((F.col("o_custkey") % 2 == 0) | (F.col("o_orderpriority") != "5-LOW")).unionByName(o.filter("o_custkey % 5 = 0"))
    return quality.confirmed(r, c, "o_custkey", "o_orderpriority")
