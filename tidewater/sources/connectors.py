"""Market-data sources as DataFrames over landed files: CSV and the JSON payload shapes of REST providers.

Fetching is out of scope: payloads are files in a folder, one per request, read with a declared schema. Each reader
returns normalised bars (or facts); rows that break a rule come back with codes, not as failures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import epoch_date, exchange_prefix, non_negative_decimal, positive_decimal, provenance_id, symbol_currency

STOOQ = "Symbol string, Date date, Open string, High string, Low string, Close string, Volume string"
YAHOO = "struct<chart: struct<result: array<struct<meta: struct<symbol: string, currency: string>, timestamp: array<bigint>, indicators: struct<quote: array<struct<open: array<double>, high: array<double>, low: array<double>, close: array<double>, volume: array<bigint>>>>>>>>"
SINA = "array<struct<day: string, open: string, high: string, low: string, close: string, volume: string>>"
TUSHARE = "struct<data: struct<fields: array<string>, items: array<array<string>>>>"
XBRL = "struct<cik: bigint, entityName: string, currencyCode: string, units: struct<USD: array<struct<start: string, end: string, val: string>>>>"
FRED = "struct<observations: array<struct<date: string, value: string>>>"
HKEX = "struct<result: array<struct<id: string, title: string>>>"

BAR = ("open", "high", "low", "close", "volume")

#: Where the rows lie in each REST payload, and the names of date, open, high, low, close, volume; where a
#: value has several names, the first one that is there counts.
ADJUSTED = (("open", "adjOpen"), ("high", "adjHigh"), ("low", "adjLow"), ("close", "adjClose"), ("volume", "adjVolume", "v"))
REST = {
    "financial-modeling-prep": ("historical", ("date",), ADJUSTED, "USD"),
    "tiingo": (None, ("date",), ADJUSTED, "USD"),
    "iex-cloud": (None, ("date",), ADJUSTED, "USD"),
    "twelve-data": ("values", ("datetime",), ADJUSTED, "USD"),
    "polygon-io": ("results", ("t",), (("o",), ("h",), ("l",), ("c",), ("v",)), "USD"),
}
#: Declared sources: provider, category, scope, frequency, whether a key is needed, documentation.
DECLARED = {
    "akshare": ("akshare", "market", "GLOBAL", "daily", False, "https://github.com/akfamily/akshare"),
    "stooq": ("stooq", "market", "GLOBAL", "daily", False, "https://stooq.com/q/d/"),
    "yahoo-finance": ("yfinance", "market", "GLOBAL", "daily", False, "https://pypi.org/project/yfinance/"),
    "sina-finance": ("sina-finance", "market", "A_SHARE", "daily", False, "https://finance.sina.com.cn"),
    "baostock": ("baostock", "market", "A_SHARE", "daily", False, "https://baostock.com"),
    "tushare": ("tushare", "market", "A_SHARE", "daily", True, "https://tushare.pro"),
    "alpha-vantage": ("alphavantage", "market", "UNITED_STATES", "daily", True, "https://www.alphavantage.co/documentation/"),
    "financial-modeling-prep": ("financialmodelingprep", "fundamental", "UNITED_STATES", "event", True, "https://site.financialmodelingprep.com/developer/docs"),
    "finnhub": ("finnhub", "fundamental", "GLOBAL", "event", True, "https://docs.official-finnhub.com"),
    "tiingo": ("tiingo", "market", "UNITED_STATES", "daily", True, "https://www.tiingo.com/about/pricing"),
    "polygon-io": ("polygon", "market", "UNITED_STATES", "daily", True, "https://polygon.io/docs"),
    "sec-edgar": ("sec-edgar", "fundamental", "UNITED_STATES", "event", False, "https://www.sec.gov/edgar"),
    "hkex-news": ("hkex", "corporate_action", "HONG_KONG", "event", False, "https://www.hkexnews.hk"),
    "fred": ("fred", "macro", "GLOBAL", "monthly", True, "https://fred.stlouisfed.org"),
    "ecb": ("ecb", "macro", "GLOBAL", "daily", False, "https://www.ecb.europa.eu/stats"),
    "exchange-calendars": ("exchange_calendars", "calendar", "GLOBAL", "reference", False, "https://github.com/gerrymanoim/exchange_calendars"),
    "pandas-market-calendars": ("pandas_market_calendars", "calendar", "GLOBAL", "reference", False, "https://github.com/rsheftel/pandas_market_calendars"),
    "iex-cloud": ("iexcloud", "market", "UNITED_STATES", "daily", True, "https://iexcloud.io"),
    "twelve-data": ("twelvedata", "market", "GLOBAL", "daily", True, "https://twelvedata.com/docs"),
    "nasdaq-data-link": ("nasdaq-data-link", "market", "GLOBAL", "daily", True, "https://docs.data.nasdaq.com"),
}
#: What a request to a source of each category must say.
REQUEST_FIELDS = {
    "market": ("market", "exchange", "symbol", "trading_date"),
    "macro": ("canonical_asset_id", "metric_code"),
    "fundamental": ("canonical_asset_id", "metric_code"),
    "corporate_action": ("canonical_asset_id",),
    "calendar": ("market", "start_date", "end_date"),
}


def _bar(df: DataFrame, provider: str) -> DataFrame:
    """provider_code, trading_date, open..volume (strings), trading_currency -> a typed bar with codes."""
    typed = df.select(
        "provider_code",
        "trading_date",
        *[positive_decimal(F.col(c)).alias(c) for c in ("open", "high", "low", "close")],
        non_negative_decimal(F.col("volume")).alias("volume"),
        F.lit(0).cast("decimal(38,8)").alias("turnover"),
        "trading_currency",
        F.lit(provider).alias("provider"),
        provenance_id(F.lit(provider), F.col("provider_code"), F.col("trading_date")).alias("provenance_id"),
    )
    bad = [F.when(F.col(c).isNull(), F.lit(f"{c}.numeric")) for c in ("open", "high", "low", "close", "volume")]
    return typed.withColumn("codes", F.array_compact(F.array(*bad, F.when(F.col("trading_currency").isNull(), F.lit("currency")))))


def stooq_csv(spark: SparkSession, path: str, on: str | None = None) -> DataFrame:
    raw = spark.read.csv(path, schema=STOOQ, header=True, mode="FAILFAST", enforceSchema=False)
    raw = raw.filter(F.col("Date") == F.lit(on).cast("date")) if on else raw
    return _bar(raw.select(F.col("Symbol").alias("provider_code"), F.col("Date").alias("trading_date"), F.col("Open").alias("open"), F.col("High").alias("high"), F.col("Low").alias("low"), F.col("Close").alias("close"), F.col("Volume").alias("volume"), symbol_currency(F.col("Symbol")).alias("trading_currency")), "stooq")


def payloads(spark: SparkSession, path: str) -> DataFrame:
    """Landed JSON payloads, one file each: request (file name without its ending) and payload."""
    return spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).alias("request"), F.col("value").alias("payload"))


def yahoo_chart(df: DataFrame, wanted: Column) -> DataFrame:
    """Parallel arrays by timestamp; the wanted day, else the last day before it."""
    r = df.select(F.from_json("payload", YAHOO)["chart"]["result"][0].alias("r"), wanted.cast("date").alias("wanted")).filter("r is not null")
    q = F.col("r.indicators.quote")[0]
    rows = r.select("wanted", F.col("r.meta.symbol").alias("provider_code"), F.col("r.meta.currency").alias("trading_currency"), F.explode(F.arrays_zip(F.col("r.timestamp").alias("t"), q["open"].alias("o"), q["high"].alias("h"), q["low"].alias("l"), q["close"].alias("c"), q["volume"].alias("v"))).alias("z"))
    days = rows.withColumn("trading_date", epoch_date(F.col("z.t"))).filter(F.col("trading_date") <= F.col("wanted"))
    best = days.groupBy("provider_code", "wanted").agg(F.max_by(F.struct("trading_date", "trading_currency", "z"), "z.t").alias("b"))
    return _bar(best.select("provider_code", "b.trading_date", "b.trading_currency", *[F.col(f"b.z.{k}").cast("string").alias(n) for k, n in (("o", "open"), ("h", "high"), ("l", "low"), ("c", "close"), ("v", "volume"))]), "yfinance")


def sina_kline(df: DataFrame, on: Column) -> DataFrame:
    rows = df.select(F.col("request").alias("provider_code"), F.explode(F.from_json("payload", SINA)).alias("k"), on.cast("date").alias("wanted"))
    hit = rows.filter(F.col("k.day").try_cast("date") == F.col("wanted"))
    return _bar(hit.select(F.coalesce(exchange_prefix(F.col("provider_code")), F.col("provider_code")).alias("provider_code"), F.col("wanted").alias("trading_date"), "k.open", "k.high", "k.low", "k.close", "k.volume", F.lit("CNY").alias("trading_currency")), "sina-finance")


def rest_bars(df: DataFrame, source: str) -> DataFrame:
    """Bars of a REST payload whose rows are objects in an array (see REST)."""
    at, (on,), names, currency = REST[source]
    rows = "array<map<string,string>>"
    body = F.from_json("payload", rows if at is None else f"struct<`{at}`: {rows}>")
    r = df.select(F.col("request").alias("provider_code"), F.explode(body if at is None else body[at]).alias("m"))
    when, m = F.col("m")[on], F.col("m")
    day = F.when(when.rlike("^[0-9]{10,}$"), F.to_date(F.timestamp_millis(when.try_cast("bigint")))).otherwise(F.coalesce(when.substr(1, 10).try_cast("date"), F.try_to_date(when, "yyyyMMdd")))
    values = [F.coalesce(*[m[n] for n in some]).alias(k) for some, k in zip(names, BAR, strict=True)]
    return _bar(r.select("provider_code", day.alias("trading_date"), *values, F.lit(currency).alias("trading_currency")), source)


def nasdaq_table(df: DataFrame) -> DataFrame:
    """The records of a data table, arrays of date (where the first value is one), open, high, low, close, volume."""
    r = df.select(F.col("request").alias("provider_code"), F.explode(F.from_json("payload", "struct<datatable: struct<data: array<array<string>>>>")["datatable"]["data"]).alias("a"))
    day = F.get("a", F.lit(0)).try_cast("date")
    first = F.when(day.isNull(), 0).otherwise(1)
    return _bar(r.select("provider_code", day.alias("trading_date"), *[F.get("a", first + i).alias(k) for i, k in enumerate(BAR)], F.lit("USD").alias("trading_currency")), "nasdaq-data-link")


def alpha_vantage(df: DataFrame) -> DataFrame:
    r = df.select(F.col("request").alias("provider_code"), F.explode(F.from_json("payload", "struct<`Time Series (Daily)`: map<string,map<string,string>>>")["Time Series (Daily)"]).alias("day", "m"))
    return _bar(r.select("provider_code", F.col("day").cast("date").alias("trading_date"), *[F.col("m")[f"{i}. {c}"].alias(c) for i, c in enumerate(("open", "high", "low", "close", "volume"), 1)], F.lit("USD").alias("trading_currency")), "alpha-vantage")


def finnhub(df: DataFrame) -> DataFrame:
    a = F.from_json("payload", "struct<t: array<bigint>, o: array<double>, h: array<double>, l: array<double>, c: array<double>, v: array<double>>")
    r = df.select(F.col("request").alias("provider_code"), a.alias("a")).select("provider_code", F.explode(F.arrays_zip(*[F.col(f"a.{k}").alias(k) for k in "tohlcv"])).alias("z"))
    return _bar(r.select("provider_code", epoch_date(F.col("z.t")).alias("trading_date"), *[F.col(f"z.{k}").cast("string").alias(n) for k, n in (("o", "open"), ("h", "high"), ("l", "low"), ("c", "close"), ("v", "volume"))], F.lit("USD").alias("trading_currency")), "finnhub")


def ecb_rates(df: DataFrame) -> DataFrame:
    r = df.select(F.col("request").alias("currency"), F.explode(F.from_json("payload", "struct<rates: map<string,string>>")["rates"]).alias("day", "rate"))
    return r.select(F.lit("EUR").alias("source_currency"), F.col("currency").alias("target_currency"), F.col("day").cast("date").alias("rate_date"), positive_decimal(F.col("rate"), "decimal(38,18)").alias("rate"))


def columnar_items(df: DataFrame) -> DataFrame:
    """Payloads of field names and item arrays: each item becomes a map."""
    d = F.from_json("payload", TUSHARE)["data"]
    r = df.select(d.alias("d")).select(F.explode(F.transform("d.items", lambda i: F.map_from_arrays(F.col("d.fields"), i))).alias("m"))
    m = F.col("m")
    return _bar(r.select(m["ts_code"].alias("provider_code"), F.try_to_date(m["trade_date"], "yyyyMMdd").alias("trading_date"), m["open"].alias("open"), m["high"].alias("high"), m["low"].alias("low"), m["close"].alias("close"), m["vol"].alias("volume"), F.lit("CNY").alias("trading_currency")), "tushare")


def data_frame_source(spark: SparkSession, pdf, provider: str, currency: str) -> DataFrame:
    """Bars of a package that returns pandas frames: date, code, open, high, low, close, volume."""
    df = spark.createDataFrame(pdf)
    return _bar(df.select(F.col("code").cast("string").alias("provider_code"), F.col("date").cast("date").alias("trading_date"), *[F.col(c).cast("string").alias(c) for c in ("open", "high", "low", "close", "volume")], F.lit(currency).alias("trading_currency")), provider)


def xbrl_fact(df: DataFrame, metric: str) -> DataFrame:
    """The first element of the USD series of a company concept."""
    p = df.select(F.from_json("payload", XBRL).alias("p"))
    u = F.get(F.col("p.units.USD"), F.lit(0))
    return p.select(F.concat(F.lit("SEC-EDGAR:"), F.col("p.cik")).alias("canonical_asset_id"), F.lit(f"us-gaap:{metric}").alias("metric_name"), u["val"].try_cast("decimal(38,8)").alias("value"), F.lit("USD").alias("unit"), F.upper(F.coalesce(F.col("p.currencyCode"), F.lit("USD"))).alias("currency"), u["start"].try_cast("date").alias("period_start"), u["end"].try_cast("date").alias("period_end"))


def last_observation(df: DataFrame) -> DataFrame:
    """The last observation of a macro series."""
    o = F.try_element_at(F.from_json("payload", FRED)["observations"], F.lit(-1))
    return df.select(F.col("request").alias("metric_name"), o["date"].try_cast("date").alias("period_end"), positive_decimal(o["value"]).alias("value"))


def announcement(df: DataFrame) -> DataFrame:
    """The first announcement with an id."""
    e = F.get(F.filter(F.from_json("payload", HKEX)["result"], lambda r: r["id"].isNotNull()), F.lit(0))
    return df.select(F.col("request").alias("provider_code"), e["id"].alias("announcement_id"), F.coalesce(e["title"], F.lit("announcement")).alias("event_type")).filter("announcement_id is not null")


def bounded_history(bars: DataFrame, keys: list[str], start: str, end: str, limit: int, order: list[str] | None = None) -> DataFrame:
    """The last `limit` distinct days in a range, oldest first. Of several rows of one day the first in `order` stays (by
    default in the order of all other columns), whatever the partitions."""
    rest = order or [c for c in bars.columns if c not in (*keys, "trading_date")]
    ranged = bars.filter(F.col("trading_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    first = F.row_number().over(Window.partitionBy(*keys, "trading_date").orderBy(*[F.col(c).asc_nulls_last() for c in rest]))
    days = ranged.withColumn("_f", first).filter("_f = 1").drop("_f")
    w = Window.partitionBy(*keys).orderBy(F.col("trading_date").desc())
    return days.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= limit).drop("_r").orderBy(*keys, "trading_date")


def calendar_source(days: DataFrame, provider: str) -> DataFrame:
    """Calendar versions of landed schedules (code, day): all given days are full days of one session, in UTC."""
    session = F.array(F.struct(F.lit("00:00").alias("start"), F.lit("23:59").alias("end"), F.lit("regular").alias("kind")))
    day = F.struct(F.col("day").alias("date"), F.col("code").alias("market"), F.col("code").alias("exchange"), F.lit("full").alias("kind"), session.alias("sessions"))
    v = days.filter("day is not null").distinct().groupBy(F.col("code").alias("market")).agg(F.min("day").alias("effective_from"), F.max("day").alias("effective_to"), F.array_sort(F.collect_list(day)).alias("days"))  # a calendar: 366 days a year
    version = provenance_id(F.lit(provider), F.col("market"), F.col("effective_from"), F.col("effective_to"))
    return v.select(version.alias("version_id"), "market", F.col("market").alias("exchange"), F.lit("UTC").alias("timezone"), "effective_from", "effective_to", "days")


def weekday_calendar(spark: SparkSession, start: str, end: str, markets: list[str]) -> DataFrame:
    """Weekdays with one session, 09:30 to 16:00, per market."""
    days = spark.sql(f"SELECT explode(sequence(DATE'{start}', DATE'{end}', INTERVAL 1 DAY)) AS day").filter("weekday(day) < 5")
    return days.withColumn("market", F.explode(F.array(*map(F.lit, markets)))).select("market", "day", F.lit("full").alias("kind"), F.array(F.struct(F.lit("09:30").alias("start"), F.lit("16:00").alias("end"))).alias("sessions"))


REGISTRY = {
    "stooq": stooq_csv,
    "yahoo-finance": yahoo_chart,
    "sina-finance": sina_kline,
    "alpha-vantage": alpha_vantage,
    "finnhub": finnhub,
    "ecb": ecb_rates,
    "tushare": columnar_items,
    "sec-edgar": xbrl_fact,
    "fred": last_observation,
    "hkex-news": announcement,
    "nasdaq-data-link": nasdaq_table,
    "akshare": data_frame_source,
    "baostock": data_frame_source,
    "exchange-calendars": calendar_source,
    "pandas-market-calendars": calendar_source,
    **{s: rest_bars for s in REST},
}


def catalogue(spark: SparkSession) -> DataFrame:
    """Declared sources, what a request to each must say, and whether there is a reader for its payloads."""
    rows = [(s, *DECLARED[s], list(REQUEST_FIELDS[DECLARED[s][1]]), s in REGISTRY) for s in sorted(DECLARED)]
    return spark.createDataFrame(rows, "source_id string, provider string, category string, scope string, frequency string, requires_auth boolean, documentation string, request_fields array<string>, executable boolean")
