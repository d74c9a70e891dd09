"""Every validator over derived rows: a sound row for each part, with one fault by its number.

A case is a fault: the columns to replace. The SQL lists the codes that must come of each case.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import quality as Q
from ..operators import versions
from ..tables import load
from .registry import query

D, S, L = (lambda v: F.lit(v).cast("date")), (lambda v: F.lit(v).cast("timestamp")), F.lit
N = lambda v: F.lit(v).cast("decimal(38,12)")
NAIVE = "2024-03-01T12:00:00"


def _rows(spark, sf_dir, base: dict[str, Column], cases: list[dict]):
    case = F.col("p_partkey") % len(cases)

    def value(name: str, sound: Column) -> Column:
        out = sound
        for i, fault in enumerate(cases):
            if name in fault:
                out = F.when(case == i, fault[name]).otherwise(out)
        return out.alias(name)

    return load(spark, sf_dir, "part").select("p_partkey", *[value(n, c) for n, c in base.items()])


def _named() -> list[dict]:
    return [{"canonical_asset_id": L(" ")}, {"provider": L("p" * 129)}, {"provenance_id": L("")}]


def _quoted(currency: str) -> list[dict]:
    return [*_named(), {"provider_available_at": L(NAIVE)}, {"retrieved_at": L("soon")}, {currency: L("US")}, {"provider_code": L("")}]


def _bars():
    base = {"canonical_asset_id": L("A"), "trading_date": D("2024-03-01"), "open": N("9.8"), "high": N("11.5"), "low": N("9.5"), "close": N("10.25"), "volume": N("1000"), "turnover": N("0"), "trading_currency": L("USD"), "provider_available_at": L(NAIVE + "Z"), "retrieved_at": L(NAIVE + "+08:00"), "provider": L("sim"), "provider_code": L("A"), "provenance_id": L("x")}
    cases = [
        {},
        *_quoted("trading_currency"),
        {"trading_date": D("2019-12-31")},
        {"open": N("0")},
        {"high": N("1000000000000")},
        {"volume": N("-1")},
        {"turnover": N("1000000000000000000")},
        {"high": N("10")},
        {"low": N("9.9")},
        {"close": F.lit(None).cast("decimal(38,12)"), "trading_date": F.lit(None).cast("date")},
    ]
    return base, cases


@query("""SELECT p_partkey, CASE p_partkey % 16 WHEN 1 THEN ['canonical_asset_id.missing'] WHEN 2 THEN ['provider.length'] WHEN 3 THEN ['provenance_id.missing'] WHEN 4 THEN ['provider_available_at.timezone'] WHEN 5 THEN ['retrieved_at.timezone'] WHEN 6 THEN ['trading_currency.currency'] WHEN 7 THEN ['provider_code.length']
WHEN 8 THEN ['trading_date.range'] WHEN 9 THEN ['low.relationship', 'open.range'] WHEN 10 THEN ['high.range'] WHEN 11 THEN ['volume.range'] WHEN 12 THEN ['turnover.range'] WHEN 13 THEN ['high.relationship'] WHEN 14 THEN ['low.relationship'] WHEN 15 THEN ['close.range', 'trading_date.range'] ELSE CAST([] AS VARCHAR[]) END AS codes FROM part""")
def daily_bar_validation(spark, sf_dir):
    df = _rows(spark, sf_dir, *_bars())
    return df.select("p_partkey", Q.daily_bar_violations(df).alias("codes"))


@query("""SELECT p_partkey, CASE p_partkey % 13 WHEN 1 THEN ['canonical_asset_id.missing'] WHEN 2 THEN ['provider.length'] WHEN 3 THEN ['provenance_id.missing'] WHEN 4 THEN ['provider_available_at.timezone'] WHEN 5 THEN ['retrieved_at.timezone'] WHEN 6 THEN ['pricing_currency.currency'] WHEN 7 THEN ['provider_code.length']
WHEN 8 THEN ['valuation_date.range'] WHEN 9 THEN ['unit_nav.range'] WHEN 10 THEN ['cumulative_nav.range', 'cumulative_nav.relationship'] WHEN 11 THEN ['cumulative_nav.relationship'] ELSE CAST([] AS VARCHAR[]) END AS codes FROM part""")
def fund_nav_validation(spark, sf_dir):
    base = {"canonical_asset_id": L("A"), "valuation_date": D("2024-03-01"), "unit_nav": N("10"), "cumulative_nav": N("11"), "pricing_currency": L("JPY"), "provider_available_at": L(NAIVE + "Z"), "retrieved_at": L(NAIVE + "+08:00"), "provider": L("sim"), "provider_code": L("A"), "provenance_id": L("x")}
    cases = [{}, *_quoted("pricing_currency"), {"valuation_date": D("2101-01-01")}, {"unit_nav": N("0")}, {"cumulative_nav": N("0")}, {"cumulative_nav": N("9")}, {"cumulative_nav": F.lit(None).cast("decimal(38,12)")}]
    df = _rows(spark, sf_dir, base, cases)
    return df.select("p_partkey", Q.fund_nav_violations(df).alias("codes"))


@query("""SELECT p_partkey, CASE p_partkey % 13 WHEN 1 THEN ['canonical_asset_id.missing'] WHEN 2 THEN ['provider.length'] WHEN 3 THEN ['provenance_id.missing'] WHEN 4 THEN ['announcement_at.timezone'] WHEN 5 THEN ['provider_available_at.timezone'] WHEN 6 THEN ['revision_version.length'] WHEN 7 THEN ['metric_name.length']
WHEN 8 THEN ['unit.length'] WHEN 9 THEN ['value.range'] WHEN 10 THEN ['currency.missing'] WHEN 11 THEN ['reporting_period.relationship'] ELSE CAST([] AS VARCHAR[]) END AS codes FROM part""")
def fact_validation(spark, sf_dir):
    base = {"canonical_asset_id": L("A"), "metric_name": L("Revenue total"), "value": N("-5"), "unit": L("USD"), "currency": L("USD"), "reporting_period_start": D("2024-01-01"), "reporting_period_end": D("2024-03-31"), "announcement_at": L(NAIVE + "Z"), "provider_available_at": L(NAIVE + "-05:00"), "provider": L("sim"), "revision_version": L("r1"), "provenance_id": L("x")}
    none = F.lit(None).cast("string")
    cases = [{}, *_named(), {"announcement_at": L(NAIVE)}, {"provider_available_at": none}, {"revision_version": L(" ")}, {"metric_name": L("m" * 129)}, {"unit": L("")}, {"value": N("1000000000000000000000001")}, {"currency": none}, {"reporting_period_end": D("2023-01-01")}, {"currency": none, "metric_name": L("headcount")}]
    df = _rows(spark, sf_dir, base, cases)
    return df.select("p_partkey", Q.fact_violations(df).alias("codes"))


_SESSION = "struct<start: string, end: string, kind: string>"
_DAY = f"array<struct<date: date, market: string, exchange: string, kind: string, sessions: array<{_SESSION}>>>"


def _days(*days: str) -> Column:
    return F.from_json(F.lit("[" + ",".join(days) + "]"), _DAY)


def _day(date="2024-03-01", market="A_SHARE", exchange="SSE", sessions=(("09:30", "11:30", "regular"), ("13:00", "15:00", "regular"))) -> str:
    each = ",".join(f'{{"start":"{a}","end":"{b}","kind":"{k}"}}' for a, b, k in sessions)
    return f'{{"date":"{date}","market":"{market}","exchange":"{exchange}","kind":"full","sessions":[{each}]}}'


@query("""SELECT p_partkey, CASE p_partkey % 15 WHEN 1 THEN ['version_id'] WHEN 2 THEN ['market'] WHEN 3 THEN ['timezone'] WHEN 4 THEN ['effective_to'] WHEN 5 THEN ['day.date'] WHEN 6 THEN ['day.date'] WHEN 7 THEN ['day.market'] WHEN 8 THEN ['day.exchange'] WHEN 9 THEN ['day.sessions']
WHEN 10 THEN ['day.session.time'] WHEN 11 THEN ['day.session.interval'] WHEN 12 THEN ['day.session.kind'] WHEN 13 THEN ['day.session.overlap'] ELSE CAST([] AS VARCHAR[]) END AS codes FROM part""")
def calendar_validation(spark, sf_dir):
    base = {"version_id": L("v"), "market": L("A_SHARE"), "exchange": L("SSE"), "timezone": L("Asia/Shanghai"), "effective_from": D("2024-01-01"), "effective_to": D("2024-12-31"), "days": _days(_day(), _day("2024-03-04"))}
    one = lambda *s: {"days": _days(_day(sessions=s))}
    many = [(f"{h:02d}:00", f"{h:02d}:30", "regular") for h in range(9)]
    cases = [
        {},
        {"version_id": L("")},
        {"market": L("MARS")},
        {"timezone": L("Asia/Tokyo")},
        {"effective_to": D("2023-12-31")},
        {"days": _days(_day(), _day(market="MARS"))},
        {"days": _days(_day("2025-01-01"))},
        {"days": _days(_day(market="HONG_KONG"))},
        {"days": _days(_day(exchange="X"))},
        one(*many),
        one(("9h", "10:00", "regular"), ("24:00", "25:00", "regular")),
        one(("10:00", "09:00", "regular")),
        one(("09:00", "10:00", "lunch")),
        one(("09:00", "11:00", "regular"), ("bad", "x", "regular"), ("10:59", "12:00", "regular")),
        {"days": _days()},
    ]
    # The 13th case has a session without a time as well; the time code is left out here to compare the overlap alone.
    df = _rows(spark, sf_dir, base, cases)
    codes = F.when(F.col("p_partkey") % 15 == 13, F.array_except(Q.calendar_violations(), F.array(F.lit("day.session.time")))).otherwise(Q.calendar_violations())
    return df.select("p_partkey", codes.alias("codes"))


@query("""SELECT p_partkey, CASE p_partkey % 18 WHEN 1 THEN ['version_id'] WHEN 2 THEN ['market'] WHEN 3 THEN ['exchange'] WHEN 4 THEN ['asset_type'] WHEN 5 THEN ['effective_to'] WHEN 6 THEN ['trading_lot'] WHEN 7 THEN ['tick_size'] WHEN 8 THEN ['price_limit_percent', 'price_limit_rule'] WHEN 9 THEN ['price_limit_percent'] WHEN 10 THEN ['price_limit_percent'] WHEN 11 THEN ['sell_availability_rule']
WHEN 12 THEN ['security_settlement_open_dates'] WHEN 13 THEN ['cash_settlement_open_dates'] WHEN 14 THEN ['permitted_session_types'] WHEN 15 THEN ['permitted_session_types'] WHEN 16 THEN ['tick_size', 'trading_lot'] ELSE CAST([] AS VARCHAR[]) END AS codes FROM part""")
def rule_profile_validation(spark, sf_dir):
    base = {"version_id": L("v"), "market": L("A_SHARE"), "exchange": L("SSE"), "asset_type": L("EQUITY"), "effective_from": D("2024-01-01"), "effective_to": D("2024-12-31"), "trading_lot": L(100), "tick_size": N("0.01"), "price_limit_rule": L("STATIC_PERCENTAGE_BASE_REFERENCE"), "price_limit_percent": N("0.1"), "sell_availability_rule": L("NEXT_OPEN_MARKET_DATE"), "security_settlement_open_dates": L(1), "cash_settlement_open_dates": L(1), "permitted_session_types": F.array(L("regular"))}
    none = F.lit(None).cast("decimal(38,12)")
    cases = [
        {},
        {"version_id": L(" ")},
        {"market": L("US")},
        {"exchange": L("")},
        {"asset_type": L("")},
        {"effective_to": D("2023-12-31")},
        {"trading_lot": L(0)},
        {"tick_size": N("0")},
        {"price_limit_rule": L("SOME")},
        {"price_limit_percent": none},
        {"price_limit_rule": L("NONE")},
        {"sell_availability_rule": L("LATER")},
        {"security_settlement_open_dates": L(9)},
        {"cash_settlement_open_dates": L(-1)},
        {"permitted_session_types": F.array().cast("array<string>")},
        {"permitted_session_types": F.array(L("lunch"))},
        {"trading_lot": L(1_000_000_001), "tick_size": N("1000000001")},
        {"price_limit_rule": L("PROVIDER_BAND_REQUIRED"), "price_limit_percent": none, "effective_to": F.lit(None).cast("date")},
    ]
    return _rows(spark, sf_dir, base, cases).select("p_partkey", Q.rule_profile_violations().alias("codes"))


@query("""SELECT p_partkey, CASE p_partkey % 8 WHEN 1 THEN ['action_type', 'event_id'] WHEN 2 THEN ['canonical_asset_id', 'provenance_id', 'version_id'] WHEN 3 THEN ['ex_date.before_announcement'] WHEN 4 THEN ['effective_date.before_ex_date', 'record_date.after_effective_date'] WHEN 5 THEN ['record_date.after_effective_date'] WHEN 6 THEN ['terms.missing'] ELSE CAST([] AS VARCHAR[]) END AS codes FROM part""")
def corporate_action_validation(spark, sf_dir):
    base = {"canonical_asset_id": L("A"), "event_id": L("e"), "action_type": L("SPIN_OFF"), "provenance_id": L("x"), "version_id": L("v"), "announcement_date": D("2024-01-01"), "ex_date": D("2024-02-01"), "effective_date": D("2024-02-05"), "record_date": D("2024-02-02"), "terms": F.create_map(L("ratio"), L("2"))}
    cases = [{}, {"event_id": L(""), "action_type": L(" ")}, {"canonical_asset_id": L(""), "provenance_id": L(""), "version_id": L("")}, {"ex_date": D("2023-12-31")}, {"effective_date": D("2024-01-15")}, {"record_date": D("2024-03-01")}, {"terms": F.create_map().cast("map<string,string>")}, {"record_date": F.lit(None).cast("date")}]
    return _rows(spark, sf_dir, base, cases).select("p_partkey", Q.corporate_action_violations().alias("codes"))


@query("""SELECT p_partkey, CASE p_partkey % 14 WHEN 1 THEN ['version_id'] WHEN 2 THEN ['source_currency'] WHEN 3 THEN ['target_currency'] WHEN 4 THEN ['currency_pair'] WHEN 5 THEN ['rate_date'] WHEN 6 THEN ['rate'] WHEN 7 THEN ['rate'] WHEN 8 THEN ['provider'] WHEN 9 THEN ['provider_pair'] WHEN 10 THEN ['retrieved_at'] WHEN 11 THEN ['provenance_id'] WHEN 12 THEN ['data_version_id'] ELSE CAST([] AS VARCHAR[]) END AS codes,
CASE p_partkey % 3 WHEN 1 THEN ['base_currency'] WHEN 2 THEN ['convention'] ELSE CAST([] AS VARCHAR[]) END AS policy_codes FROM part""")
def fx_validation(spark, sf_dir):
    R = lambda v: F.lit(v).cast("decimal(38,24)")
    base = {"version_id": L("v"), "source_currency": L("EUR"), "target_currency": L("USD"), "rate_date": D("2024-05-01"), "rate": R("1.25"), "provider": L("p"), "provider_pair": L("EURUSD"), "retrieved_at": S("2024-05-01 12:00:00"), "provenance_id": L("x"), "data_version_id": L("d")}
    cases = [{}, {"version_id": L("")}, {"source_currency": L("EU1")}, {"target_currency": L("US")}, {"target_currency": L("EUR")}, {"rate_date": D("2019-01-01")}, {"rate": R("0.0000000000009")}, {"rate": R("1000000000001")}, {"provider": L("p" * 129)}, {"provider_pair": L("")}, {"retrieved_at": F.lit(None).cast("timestamp")}, {"provenance_id": L(" ")}, {"data_version_id": L("d" * 129)}, {"rate": R("1000000000000")}]
    df = _rows(spark, sf_dir, base, cases)
    k = F.col("p_partkey") % 3
    df = df.withColumn("base_currency", F.when(k == 1, "E2R").otherwise("EUR")).withColumn("convention", F.when(k == 2, "ANY").otherwise("EXACT_DATE"))
    return df.select("p_partkey", Q.fx_violations(df).alias("codes"), Q.fx_policy_violations().alias("policy_codes"))


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 1 THEN ['membership_id', 'universe_version'] WHEN 2 THEN ['canonical_asset_id'] WHEN 3 THEN ['membership_source', 'source_version'] WHEN 4 THEN ['effective_to'] ELSE CAST([] AS VARCHAR[]) END AS codes FROM part""")
def membership_validation(spark, sf_dir):
    base = {"membership_id": L("m"), "universe_version": L("u"), "canonical_asset_id": L("A"), "membership_source": L("s"), "source_version": L("1"), "effective_from": D("2024-01-01"), "effective_to": D("2024-12-31")}
    cases = [{}, {"membership_id": L(""), "universe_version": L("")}, {"canonical_asset_id": L(" ")}, {"membership_source": L(""), "source_version": L("")}, {"effective_to": D("2023-12-31")}, {"effective_to": F.lit(None).cast("date")}]
    return _rows(spark, sf_dir, base, cases).select("p_partkey", Q.membership_violations().alias("codes"))


@query("""SELECT p_partkey, CASE p_partkey % 8 WHEN 1 THEN ['market'] WHEN 2 THEN ['asset_type', 'lifecycle_status'] WHEN 3 THEN ['exchange', 'local_code', 'name'] WHEN 4 THEN ['exchange', 'local_code', 'name'] WHEN 5 THEN ['trading_currency'] WHEN 6 THEN ['effective_to'] ELSE CAST([] AS VARCHAR[]) END AS codes FROM part""")
def asset_validation(spark, sf_dir):
    base = {"market": L("A_SHARE"), "asset_type": L("ETF"), "exchange": L("SSE"), "local_code": L("600000"), "name": L("n"), "trading_currency": L("CNY"), "lifecycle_status": L("ACTIVE"), "effective_from": D("2024-01-01"), "effective_to": D("2024-12-31")}
    cases = [{}, {"market": L("US")}, {"asset_type": L("BOND"), "lifecycle_status": L("GONE")}, {"exchange": L(""), "local_code": L(" "), "name": L("")}, {"exchange": L("e" * 65), "local_code": L("1" * 65), "name": L("n" * 257)}, {"trading_currency": L("QQQ")}, {"effective_to": D("2020-01-01")}, {"name": L("n" * 256)}]
    return _rows(spark, sf_dir, base, cases).select("p_partkey", Q.asset_violations(spark).alias("codes"))


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 1 THEN ['provider'] WHEN 2 THEN ['provider_code'] WHEN 3 THEN ['provider_code'] WHEN 4 THEN ['asset_id'] WHEN 5 THEN ['effective_to'] ELSE CAST([] AS VARCHAR[]) END AS codes FROM part""")
def mapping_validation(spark, sf_dir):
    base = {"provider": L("p"), "provider_code": L("c"), "asset_id": F.col("p_brand"), "effective_from": D("2024-01-01"), "effective_to": D("2024-12-31")}
    cases = [{}, {"provider": L(" ")}, {"provider_code": L("")}, {"provider_code": L("c" * 129)}, {"asset_id": L("none")}, {"effective_to": D("2023-12-31")}]
    assets = load(spark, sf_dir, "part").select(F.col("p_brand").alias("asset_id"))
    return Q.mapping_violations(_rows(spark, sf_dir, base, cases), assets).select("p_partkey", "codes")


@query("""SELECT p_partkey, CASE p_partkey % 16 WHEN 1 THEN ['r-life', 'r-map'] WHEN 6 THEN ['r-currency'] WHEN 8 THEN CASE WHEN p_partkey + 7 <= (SELECT max(p_partkey) FROM part) THEN ['r-date', 'r-unique'] ELSE ['r-date'] END WHEN 9 THEN ['r-range'] WHEN 10 THEN ['r-range'] WHEN 11 THEN ['r-range'] WHEN 12 THEN ['r-range'] WHEN 15 THEN ['r-date', 'r-range', 'r-required', 'r-unique'] ELSE CAST([] AS VARCHAR[]) END AS rules FROM part""")
def quality_rules(spark, sf_dir):
    """All kinds of rules over the bars above; one rule is off, one is for another dataset, two bars of sixteen share a key."""
    df = _rows(spark, sf_dir, *_bars()).withColumn("retrieved_at", F.lit("2024-03-01T13:00:00Z")).withColumn("provider_available_at", F.lit("2024-03-01T12:00:00Z"))
    df = df.withColumn("key", F.when(F.col("p_partkey") % 16 == 15, F.col("p_partkey") - 7).otherwise(F.col("p_partkey")))
    names = [("r-required", "required_fields"), ("r-range", "numeric_ranges"), ("r-date", "date_validity"), ("r-currency", "currency_consistency"), ("r-unit", "unit_consistency"), ("r-life", "lifecycle_consistency"), ("r-map", "mapping_resolution"), ("r-time", "provider_timestamp_order"), ("r-unique", "uniqueness")]
    rules = spark.createDataFrame([(r, k, "warning", True, ["DAILY_BAR"]) for r, k in names] + [("r-off", "numeric_ranges", "rejected", False, ["DAILY_BAR"]), ("r-nav", "numeric_ranges", "rejected", True, ["FUND_NAV"])], "rule_id string, rule_kind string, severity string, enabled boolean, applicable_to array<string>")
    found = Q.issues(df, rules, Q.bar_checks(), "p_partkey", F.lit("DAILY_BAR"), ["key"]).groupBy("p_partkey").agg(F.array_sort(F.collect_list("rule_id")).alias("rules"))
    return df.select("p_partkey").join(found, "p_partkey", "left").select("p_partkey", F.coalesce("rules", F.array().cast("array<string>")).alias("rules"))


@query("""WITH b AS (SELECT p_partkey, p_brand AS asset, '2024-03-' || lpad((1 + p_size % 28)::VARCHAR, 2, '0') AS day, CAST(p_retailprice AS DECIMAL(28,8)) AS x FROM part),
j AS (SELECT p_partkey, asset || '|' || day AS logical_key, '[' || array_to_string(list_transform([['canonical_asset_id', 'text', asset], ['trading_date', 'date', day], ['open', 'decimal', x::VARCHAR], ['high', 'decimal', x::VARCHAR], ['low', 'decimal', x::VARCHAR], ['close', 'decimal', x::VARCHAR], ['volume', 'decimal', '0.00000000'], ['turnover', 'decimal', '0.00000000'], ['trading_currency', 'text', 'USD'],
 ['provider_available_at', 'timestamp', '2024-03-01T12:00:00+00:00'], ['retrieved_at', 'timestamp', '2024-03-01T12:00:00.250000+00:00'], ['provider', 'text', 'sim'], ['provider_code', 'text', NULL], ['provenance_id', 'text', 'x"y']], lambda f: '{"field":"' || f[1] || '","type":"' || f[2] || '","value":' || coalesce('"' || replace(f[3], '"', '\\"') || '"', 'null') || '}'), ',') || ']' AS canonical FROM b)
SELECT p_partkey, logical_key, canonical, sha256(canonical) AS content_id FROM j""")
def canonical_content(spark, sf_dir):
    x = F.col("p_retailprice").cast("decimal(28,8)")
    day = F.make_date(F.lit(2024), F.lit(3), 1 + F.col("p_size") % 28)
    zero = F.lit(0).cast("decimal(38,8)")
    b = load(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("canonical_asset_id"), day.alias("trading_date"), *[x.alias(c) for c in ("open", "high", "low", "close")], zero.alias("volume"), zero.alias("turnover"), F.lit("USD").alias("trading_currency"), T.aware_timestamp(F.lit("2024-03-01T12:00:00Z")).alias("provider_available_at"), T.utc_timestamp(F.lit("2024-03-01T12:00:00.25")).alias("retrieved_at"), F.lit("sim").alias("provider"), F.lit(None).cast("string").alias("provider_code"), F.lit('x"y').alias("provenance_id"))
    return b.select("p_partkey", versions.logical_key("DAILY_BAR").alias("logical_key"), versions.canonical_json("DAILY_BAR").alias("canonical"), versions.canonical_content_id("DAILY_BAR").alias("content_id"))
