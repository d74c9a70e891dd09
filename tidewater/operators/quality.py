"""Validation as violation arrays, quality rules with evidence, and reports.

A validator is a column: the sorted distinct codes of everything that is wrong with a row. Columns are named as in the
data model; a null where a value is needed counts as wrong.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_aware, minutes, money_metric
from .scale import broadcast_if_small

#: Bounds of accepted observations.
PRICE_MIN, PRICE_MAX = "0.00000001", "999999999999.99999999"
VOLUME_MIN, VOLUME_MAX = "0", "999999999999999999.99999999"
YEAR_MIN, YEAR_MAX = 2020, 2100
FACT_LIMIT = "1000000000000000000000000"
FX_MIN, FX_MAX = "0.000000000001", "1000000000000"
NAME_MAX, METRIC_MAX, UNIT_MAX, PLACE_MAX, TITLE_MAX = 128, 128, 32, 64, 256
LOT_MAX, TICK_MAX, OFFSET_MAX, SESSIONS_MAX = 1_000_000_000, "1000000000", 8, 8
#: Markets and their time zones.
MARKET_ZONES = {"A_SHARE": "Asia/Shanghai", "HONG_KONG": "Asia/Hong_Kong", "UNITED_STATES": "America/New_York"}
#: Accepted names.
ASSET_TYPES = ("EQUITY", "ETF", "OPEN_END_FUND")
LIFECYCLE_STATUSES = ("UNLISTED", "ACTIVE", "SUSPENDED", "DELISTED", "EXPIRED", "UNKNOWN")
PRICE_LIMIT_RULES = ("NONE", "STATIC_PERCENTAGE_BASE_REFERENCE", "PROVIDER_BAND_REQUIRED")
SELL_RULES = ("SAME_MARKET_DATE", "NEXT_OPEN_MARKET_DATE")
SESSION_KINDS = ("regular", "non_regular")
FX_CONVENTIONS = ("EXACT_DATE", "LATEST_PRIOR_FALLBACK")
SEVERITIES = ("valid", "warning", "rejected")
#: Gap reasons, strongest first.
GAP_REASONS = ("suspended", "delayed_valuation", "unresolved", "expected")


def violations(**checks: Column) -> Column:
    """Sorted distinct codes of the checks that hold (a null check counts as a violation); `__` stands for a dot."""
    return _codes((code.replace("__", "."), bad) for code, bad in checks.items())


def _codes(checks: Iterable[tuple[str, Column]]) -> Column:
    one = [F.when(F.coalesce(bad, F.lit(True)), F.lit(code)) for code, bad in checks]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*one))))


def blank(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c)) == "", F.lit(True))


def longer(c: str, most: int) -> Column:
    return F.coalesce(F.length(c) > most, F.lit(False))


def outside(c: str, lo, hi, kind: str = "decimal(38,12)") -> Column:
    return F.coalesce(~F.col(c).between(F.lit(lo).cast(kind), F.lit(hi).cast(kind)), F.lit(True))


def reversed_interval() -> Column:
    return F.coalesce(F.col("effective_to") < F.col("effective_from"), F.lit(False))


def _years(c: str) -> Column:
    return ~F.year(c).between(YEAR_MIN, YEAR_MAX)


def _named(*columns: str) -> list[tuple[str, Column]]:
    return [x for c in columns for x in ((f"{c}.missing", blank(c)), (f"{c}.length", ~blank(c) & longer(c, NAME_MAX)))]


def _stamped(df: DataFrame, *columns: str) -> list[tuple[str, Column]]:
    return [(f"{c}.timezone", ~is_aware(df, c)) for c in columns]


def _quoted(df: DataFrame, currency: str) -> list[tuple[str, Column]]:
    """What bars and fund values have in common."""
    odd = blank(currency) | (F.length(currency) != 3)
    return [*_named("canonical_asset_id", "provider", "provenance_id"), *_stamped(df, "provider_available_at", "retrieved_at"), (f"{currency}.currency", odd), ("provider_code.length", blank("provider_code") | longer("provider_code", NAME_MAX))]


def daily_bar_violations(df: DataFrame) -> Column:
    prices = [(f"{c}.range", outside(c, PRICE_MIN, PRICE_MAX)) for c in ("open", "high", "low", "close")]
    amounts = [(f"{c}.range", outside(c, VOLUME_MIN, VOLUME_MAX)) for c in ("volume", "turnover")]
    shape = [("high.relationship", F.col("high") < F.greatest("open", "low", "close")), ("low.relationship", F.col("low") > F.least("open", "high", "close"))]
    return _codes([*_quoted(df, "trading_currency"), ("trading_date.range", _years("trading_date")), *prices, *amounts, *shape])


def fund_nav_violations(df: DataFrame, current_unit_nav: Column | None = None) -> Column:
    """A null cumulative value is allowed; one below the unit value, or below the current unit value, is not."""
    total = F.col("cumulative_nav")
    low = total < F.greatest(F.col("unit_nav"), current_unit_nav if current_unit_nav is not None else F.col("unit_nav"))
    return _codes(
        [
            *_quoted(df, "pricing_currency"),
            ("valuation_date.range", _years("valuation_date")),
            ("unit_nav.range", outside("unit_nav", PRICE_MIN, PRICE_MAX)),
            ("cumulative_nav.range", total.isNotNull() & outside("cumulative_nav", PRICE_MIN, PRICE_MAX)),
            ("cumulative_nav.relationship", F.coalesce(low, F.lit(False))),
        ]
    )


def fact_violations(df: DataFrame) -> Column:
    length = lambda c, most: ~F.coalesce(F.length(c), F.lit(0)).between(1, most)
    return _codes(
        [
            *_named("canonical_asset_id", "provider", "provenance_id"),
            *_stamped(df, "announcement_at", "provider_available_at"),
            ("revision_version.length", blank("revision_version") | longer("revision_version", NAME_MAX)),
            ("metric_name.length", length("metric_name", METRIC_MAX)),
            ("unit.length", length("unit", UNIT_MAX)),
            ("value.range", outside("value", f"-{FACT_LIMIT}", FACT_LIMIT)),
            ("currency.missing", F.col("currency").isNull() & F.coalesce(money_metric(F.lower("metric_name")), F.lit(False))),
            ("reporting_period.relationship", F.col("reporting_period_start") > F.col("reporting_period_end")),
        ]
    )


def calendar_violations(with_days: bool = True) -> Column:
    """Columns version_id, market, exchange, timezone, effective_from, effective_to, and (with_days) days array<struct<date,
    market, exchange, kind, sessions array<struct<start, end, kind>>>>. Days are looked at if the header is right; of days
    with one date the first is."""
    zones = F.create_map(*[F.lit(x) for pair in MARKET_ZONES.items() for x in pair])
    zone = F.try_element_at(zones, "market")
    known = F.col("market").isin(*MARKET_ZONES)
    header = _codes([("version_id", blank("version_id")), ("market", ~known), ("timezone", F.when(known, F.col("timezone") != zone).otherwise(blank("timezone"))), ("effective_to", reversed_interval())])
    if not with_days:
        return header
    days = F.coalesce("days", F.array().cast("array<struct<date: date, market: string, exchange: string, kind: string, sessions: array<struct<start: string, end: string, kind: string>>>>"))
    dates = F.transform(days, lambda d: d["date"])
    first = F.filter(days, lambda d, i: F.array_position(dates, d["date"]) == i + 1)
    any_day = lambda bad: F.exists(first, lambda d: F.coalesce(bad(d), F.lit(True)))
    timed = lambda s: s["start"].rlike(r"^([01]?\d|2[0-3]):[0-5]?\d$") & s["end"].rlike(r"^([01]?\d|2[0-3]):[0-5]?\d$")
    good = lambda d: F.transform(F.filter(d["sessions"], timed), lambda s: F.struct(minutes(s["start"]).alias("a"), minutes(s["end"]).alias("b"), s["kind"].alias("kind")))
    any_session = lambda bad: any_day(lambda d: F.exists(good(d), bad))
    crossed = lambda d: F.exists(F.transform(good(d), lambda s, i: F.struct(s["a"].alias("a"), F.get(good(d), i - 1)["b"].alias("before"))), lambda x: F.coalesce(x["before"] > x["a"], F.lit(False)))
    inside = [
        ("day.date", (F.size(first) < F.size(days)) | any_day(lambda d: (d["date"] < F.col("effective_from")) | F.coalesce(d["date"] > F.col("effective_to"), F.lit(False)))),
        ("day.market", any_day(lambda d: d["market"] != F.col("market"))),
        ("day.exchange", any_day(lambda d: d["exchange"] != F.col("exchange"))),
        ("day.sessions", any_day(lambda d: F.size(d["sessions"]) > SESSIONS_MAX)),
        ("day.session.time", any_day(lambda d: F.exists(d["sessions"], lambda s: ~F.coalesce(timed(s), F.lit(False))))),
        ("day.session.interval", any_session(lambda s: s["b"] <= s["a"])),
        ("day.session.kind", any_session(lambda s: ~F.coalesce(s["kind"].isin(*SESSION_KINDS), F.lit(False)))),
        ("day.session.overlap", any_day(crossed)),
    ]
    return F.when(F.size(header) > 0, header).otherwise(_codes(inside))


def rule_profile_violations() -> Column:
    static = F.coalesce(F.col("price_limit_rule") == "STATIC_PERCENTAGE_BASE_REFERENCE", F.lit(False))
    pct = F.col("price_limit_percent")
    sessions = F.coalesce("permitted_session_types", F.array().cast("array<string>"))
    offset = lambda c: (c, ~F.col(c).between(0, OFFSET_MAX))
    return _codes(
        [
            ("version_id", blank("version_id")),
            ("market", ~F.col("market").isin(*MARKET_ZONES)),
            ("exchange", blank("exchange")),
            ("asset_type", blank("asset_type")),
            ("effective_to", reversed_interval()),
            ("trading_lot", ~F.col("trading_lot").between(1, LOT_MAX)),
            ("tick_size", (F.col("tick_size") <= 0) | (F.col("tick_size") > F.lit(TICK_MAX).cast("decimal(38,12)"))),
            ("price_limit_rule", ~F.col("price_limit_rule").isin(*PRICE_LIMIT_RULES)),
            ("price_limit_percent", F.when(static, pct.isNull() | (pct <= 0)).otherwise(pct.isNotNull())),
            ("sell_availability_rule", ~F.col("sell_availability_rule").isin(*SELL_RULES)),
            offset("security_settlement_open_dates"),
            offset("cash_settlement_open_dates"),
            ("permitted_session_types", ~F.size(sessions).between(1, SESSIONS_MAX) | F.exists(sessions, lambda s: ~F.coalesce(s.isin(*SESSION_KINDS), F.lit(False)))),
        ]
    )


def corporate_action_violations() -> Column:
    names = ("canonical_asset_id", "event_id", "action_type", "provenance_id", "version_id")
    return _codes(
        [
            *((c, blank(c)) for c in names),
            ("ex_date.before_announcement", F.col("ex_date") < F.col("announcement_date")),
            ("effective_date.before_ex_date", F.col("effective_date") < F.col("ex_date")),
            ("record_date.after_effective_date", F.coalesce(F.col("record_date") > F.col("effective_date"), F.lit(False))),
            ("terms.missing", F.coalesce(F.size("terms"), F.lit(0)) < 1),
        ]
    )


def _letters(c: str) -> Column:
    return ~F.coalesce(F.col(c).rlike(r"^\p{L}{3}$"), F.lit(False))


def fx_violations(df: DataFrame) -> Column:
    named = ("provider", "provider_pair", "provenance_id", "data_version_id")
    return _codes(
        [
            ("version_id", blank("version_id")),
            ("source_currency", _letters("source_currency")),
            ("target_currency", _letters("target_currency")),
            ("currency_pair", F.col("source_currency") == F.col("target_currency")),
            ("rate_date", _years("rate_date")),
            ("rate", outside("rate", FX_MIN, FX_MAX, "decimal(38,24)")),
            *((c, blank(c) | longer(c, NAME_MAX)) for c in named),
            ("retrieved_at", ~is_aware(df, "retrieved_at")),
        ]
    )


def fx_policy_violations() -> Column:
    return _codes([("base_currency", _letters("base_currency")), ("convention", ~F.col("convention").isin(*FX_CONVENTIONS))])


def membership_violations() -> Column:
    names = ("membership_id", "universe_version", "canonical_asset_id", "membership_source", "source_version")
    return _codes([*((c, blank(c)) for c in names), ("effective_to", reversed_interval())])


def currency_codes(spark: SparkSession) -> list[str]:
    """The ISO 4217 codes that the runtime knows."""
    found = spark._jvm.java.util.Currency.getAvailableCurrencies().iterator()
    out = []
    while found.hasNext():
        out.append(found.next().getCurrencyCode())
    return sorted(out)


def asset_violations(spark: SparkSession) -> Column:
    named = (("exchange", PLACE_MAX), ("local_code", PLACE_MAX), ("name", TITLE_MAX))
    return _codes(
        [
            ("market", ~F.col("market").isin(*MARKET_ZONES)),
            ("asset_type", ~F.col("asset_type").isin(*ASSET_TYPES)),
            *((c, blank(c) | longer(c, most)) for c, most in named),
            ("trading_currency", ~F.col("trading_currency").isin(currency_codes(spark))),
            ("lifecycle_status", ~F.col("lifecycle_status").isin(*LIFECYCLE_STATUSES)),
            ("effective_to", reversed_interval()),
        ]
    )


def mapping_violations(mappings: DataFrame, assets: DataFrame) -> DataFrame:
    """mappings (provider, provider_code, asset_id, effective_from, effective_to) with their codes; assets: asset_id."""
    known = assets.select("asset_id", F.lit(True).alias("_known")).distinct()
    codes = _codes([("provider", blank("provider")), ("provider_code", blank("provider_code") | longer("provider_code", NAME_MAX)), ("asset_id", F.col("_known").isNull()), ("effective_to", reversed_interval())])
    return mappings.join(known, "asset_id", "left").withColumn("codes", codes).drop("_known")


def severity(ordinal: Column) -> Column:
    return F.get(F.array(*map(F.lit, SEVERITIES)), ordinal.cast("int"))


def issues(observations: DataFrame, rules: DataFrame, checks: dict[str, Column], id_col: str, dataset: Column | None = None, unique: list[str] | None = None) -> DataFrame:
    """Failing (rule, observation) pairs of enabled rules. rules (one row per rule, broadcast if they are few): rule_id, rule_kind,
    severity, enabled, and, if dataset is given, applicable_to, the datasets a rule is for. checks: kind -> what a failing
    row looks like. The kind `uniqueness` fails for every row whose `unique` columns another row has too. Each row explodes
    to the kinds it fails only."""
    rows = observations
    if unique:
        shared = observations.groupBy(*unique).agg(F.count("*").alias("_n")).filter("_n > 1").select(*[F.col(c).alias(f"_u_{c}") for c in unique])
        match = [F.col(c).eqNullSafe(F.col(f"_u_{c}")) for c in unique]
        rows = rows.join(shared.withColumn("_shared", F.lit(True)), match, "left")
        checks = checks | {"uniqueness": F.col("_shared").isNotNull()}
    failed = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(kind)) for kind, bad in checks.items()]))
    hit = rows.select(F.col(id_col), F.explode(failed).alias("rule_kind"), (F.lit(None).cast("string") if dataset is None else dataset).alias("_dataset"))
    found = hit.join(broadcast_if_small(rules.filter("enabled")), "rule_kind")
    if dataset is not None:
        found = found.filter(F.array_contains("applicable_to", F.col("_dataset")))
    return found.select("rule_id", "rule_kind", "severity", id_col)


#: The kinds of quality rules that look at one observation.
OBSERVATION_KINDS = ("required_fields", "numeric_ranges", "date_validity", "currency_consistency", "unit_consistency", "lifecycle_consistency", "mapping_resolution", "provider_timestamp_order")


def bar_checks() -> dict[str, Column]:
    """What a daily bar looks like that fails each kind of rule; volume and turnover have the bounds of ingestion."""
    numbers = ("open", "high", "low", "close", "volume", "turnover")
    any_of = lambda cols: F.greatest(*[c.cast("int") for c in cols]) == 1
    ranges = [outside(c, *((VOLUME_MIN, VOLUME_MAX) if c in ("volume", "turnover") else (PRICE_MIN, PRICE_MAX))) for c in numbers]
    return {
        "required_fields": any_of([F.col(c).isNull() for c in numbers]),
        "numeric_ranges": any_of(ranges),
        "date_validity": _years("trading_date"),
        "currency_consistency": F.col("trading_currency").isNotNull() & _letters("trading_currency"),
        "unit_consistency": F.lit(False),
        "lifecycle_consistency": blank("canonical_asset_id"),
        "mapping_resolution": blank("provider") | blank("canonical_asset_id"),
        "provider_timestamp_order": F.col("retrieved_at") < F.col("provider_available_at"),
    }


def confirmed(rejected: DataFrame, confirmations: DataFrame, key: str, version: str) -> DataFrame:
    """Per key: do the confirmed versions equal the rejected ones, neither more nor fewer? Exact set equality by a full join
    of distinct pairs; no set is gathered."""
    a, b = (x.select(key, version).distinct() for x in (rejected, confirmations))
    both = a.withColumn("_a", F.lit(1)).join(b.withColumn("_b", F.lit(1)), [key, version], "full")
    return both.groupBy(key).agg(F.count("_a").alias("n_rejected"), F.count("_b").alias("n_confirmed"), F.min((F.col("_a").isNotNull() & F.col("_b").isNotNull()).cast("int")).alias("_same")).select(key, "n_rejected", "n_confirmed", (F.col("_same") == 1).alias("confirmed"))


def report(found: DataFrame, keys: list[str]) -> DataFrame:
    """Counts per severity and the worst severity."""
    o = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity")).cast("int") - 1
    counts = [F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in SEVERITIES]
    return found.groupBy(*keys).agg(F.count("*").alias("n_issues"), *counts, severity(F.max(o)).alias("status"))


def gap_reason(*flags: str) -> Column:
    """The strongest reason whose flag column holds, else expected."""
    out = F.lit("expected")
    for f in reversed(flags):
        out = F.when(F.col(f), F.lit(f)).otherwise(out)
    return out
