"""Identity hashes, redaction, URL scope, currency and symbol rules, intent routing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Currency by symbol suffix, and the prefix rule of six-digit local codes.
SUFFIX_CURRENCY = ((".us", "USD"), (".hk", "HKD"), (".sh", "CNY"), (".sz", "CNY"))

#: Keyword groups in order, and the action each leads to.
INTENTS = (
    (("工作区", "新建", "路径"), "goto_overview"),
    (("回测", "研究运行", "实验"), "run_backtest"),
    (("数据", "快照", "资产", "净值", "基本面"), "query_dataset"),
    (("数据源", "供给", "provider"), "open_sources"),
    (("日历", "规则", "lot", "tick", "结算"), "open_sources"),
)
#: The dataset that a keyword names, first match wins.
DATASET_WORDS = (
    ("资产", "ASSET_MASTER"),
    ("日k", "DAILY_BAR"),
    ("日线", "DAILY_BAR"),
    ("净值", "FUND_NAV"),
    ("基本面", "FUNDAMENTAL_FACT"),
    ("交易历", "TRADING_CALENDAR"),
    ("日历", "TRADING_CALENDAR"),
    ("规则", "MARKET_RULE_PROFILE"),
    ("估值历", "VALUATION_CALENDAR"),
    ("分红", "CORPORATE_ACTION"),
    ("公司行为", "CORPORATE_ACTION"),
)


def canonical_asset_id(*parts: Column) -> Column:
    """Twenty upper-case hex digits of sha256 over the trimmed, lower-cased parts joined by |."""
    return F.upper(F.substring(F.sha2(F.concat_ws("|", *[F.lower(F.trim(p)) for p in parts]), 256), 1, 20))


def provenance_id(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("None")) for p in parts]), 256)


def redact(text: Column, secrets: list[str]) -> Column:
    """Literal secrets, longest first, to [REDACTED]."""
    return reduce(lambda t, s: F.replace(t, F.lit(s), F.lit("[REDACTED]")), sorted({s for s in secrets if s}, key=lambda s: (-len(s), s)), text)


def normalised_path(path: Column) -> Column:
    """Segments decoded, empty and `.` dropped, `..` resolved; null where `..` leaves the root."""
    parts = F.filter(F.split(path, "/"), lambda s: ~F.url_decode(s).isin("", "."))
    step = lambda acc, s: F.when(acc.isNull(), acc).when(F.url_decode(s) == "..", F.when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.size(acc) - 1))).otherwise(F.concat(acc, F.array(F.url_decode(s))))
    return F.concat(F.lit("/"), F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/"))


def url_allowed(url: Column, origin: str, scope: str) -> Column:
    """https with an explicit port, no user, query or fragment, of this origin, below this path."""
    host, part = F.try_parse_url(url, F.lit("HOST")), lambda p: F.try_parse_url(url, F.lit(p))
    authority = part("AUTHORITY")
    same = F.concat(F.lit("https://"), F.lower(authority)) == F.lower(F.lit(origin))
    ok = (part("PROTOCOL") == "https") & host.isNotNull() & part("USERINFO").isNull() & part("QUERY").isNull() & part("REF").isNull() & authority.rlike(":[0-9]+$") & same
    return F.coalesce(ok & F.startswith(normalised_path(part("PATH")), F.lit(scope)), F.lit(False))


def currency_code(c: Column) -> Column:
    """Trimmed upper case if three letters, else null."""
    u = F.upper(F.trim(c))
    return F.when(u.rlike("^[A-Z]{3}$"), u)


def symbol_currency(symbol: Column) -> Column:
    return reduce(lambda out, p: F.when(F.endswith(F.lower(symbol), F.lit(p[0])), p[1]).otherwise(out), reversed(SUFFIX_CURRENCY), F.lit(None).cast("string"))


def exchange_prefix(code: Column) -> Column:
    """Six digits with .SS or .SZ cut off, and sh or sz before them; null for other codes."""
    local = F.replace(F.replace(code, F.lit(".SS"), F.lit("")), F.lit(".SZ"), F.lit(""))
    return F.when(local.rlike("^[0-9]{6}$"), F.concat(F.when(F.startswith(local, F.lit("6")), "sh").otherwise("sz"), local))


def positive_decimal(c: Column, kind: str = "decimal(28,8)") -> Column:
    d = c.try_cast(kind)
    return F.when(d > 0, d)


def non_negative_decimal(c: Column, kind: str = "decimal(38,8)") -> Column:
    d = c.try_cast(kind)
    return F.when(d >= 0, d)


def canonical_decimal(c: Column, precision: int, scale: int) -> Column:
    """The value if it has at most `scale` digits after the point (half-even rounding changes nothing), else null."""
    wide = c.try_cast(f"decimal(38,{min(scale + 6, 18)})")
    return F.when(F.bround(wide, scale) == wide, wide.try_cast(f"decimal({precision},{scale})"))


def market_date(ts: Column, zone: str) -> Column:
    """Local calendar date in an IANA zone, daylight saving included."""
    return F.to_date(F.from_utc_timestamp(ts, zone))


#: An ISO 8601 date and time with an offset or Z.
AWARE = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}([.,]\d{1,9})?)?\s*(Z|[+-]\d{2}(:?\d{2})?)$"


def aware_timestamp(text: Column) -> Column:
    """ISO 8601 text with Z or an offset as a timestamp; null if it has none (a naive time) or can't be read."""
    return F.when(text.rlike(AWARE), F.replace(text, F.lit(","), F.lit(".")).try_cast("timestamp"))


def utc_timestamp(text: Column) -> Column:
    """ISO 8601 text as a timestamp; one without an offset is taken as UTC, whatever the session's zone."""
    return F.coalesce(aware_timestamp(text), F.when(~text.rlike(AWARE), F.concat(text, F.lit("Z")).try_cast("timestamp")))


def is_aware(df: DataFrame, c: str) -> Column:
    """A moment and not a naive time: timestamps are, timestamps without zone aren't, texts are if they have an offset."""
    kind = df.schema[c].dataType
    if isinstance(kind, T.TimestampType):
        return F.col(c).isNotNull()
    return F.coalesce(aware_timestamp(F.col(c)).isNotNull(), F.lit(False)) if isinstance(kind, T.StringType) else F.lit(False)


def minutes(hhmm: Column) -> Column:
    p = F.split(hhmm, ":")
    return p[0].cast("int") * 60 + p[1].cast("int")


def epoch_date(seconds: Column) -> Column:
    return F.to_date(F.timestamp_seconds(seconds))


def close_enough(a: Column, b: Column, tolerance: float = 1e-10) -> Column:
    return F.abs(a - b) <= tolerance * F.greatest(F.lit(1.0), F.abs(a), F.abs(b))


def money_metric(name: Column) -> Column:
    return name.rlike(r"^(price|revenue|profit|cash|cost|expense)($|[. ])")


def mentions(message: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(F.lower(message), F.lit(w.lower())) for w in words])


def intent(message: Column, intents=INTENTS, default: str = "show_quote") -> Column:
    return reduce(lambda out, i: F.when(mentions(message, i[0]), i[1]).otherwise(out), reversed(intents), F.lit(default))


def named_dataset(message: Column, words=DATASET_WORDS, default: str = "ASSET_MASTER") -> Column:
    return reduce(lambda out, w: F.when(F.contains(F.lower(message), F.lit(w[0])), w[1]).otherwise(out), reversed(words), F.lit(default))


def symbol_in(message: Column, default: str) -> Column:
    """A code with an exchange suffix, else the first word of letters, else six digits (as .SS). A word ends where letters,
    digits or _ of any script end."""
    found = F.filter(F.regexp_extract_all(message, F.lit(r"(?U)\b([A-Za-z0-9.-]{1,16})\b")), lambda c: ~F.lower(c).isin("a", "us", "hk", "ai"))
    pick = lambda test: F.get(F.filter(found, test), F.lit(0))
    return F.coalesce(F.upper(pick(lambda c: F.lower(c).rlike(r"\.(ss|sz|hk)"))), F.upper(pick(lambda c: c.rlike("^[A-Za-z]+$"))), F.concat(pick(lambda c: c.rlike(r"^\d{6}$")), F.lit(".SS")), F.lit(default))


def redact_nested(df: DataFrame, c: str, secrets: list[str]) -> Column:
    """redact() on every text in a column of structs, arrays and maps (keys and values), whatever its depth."""

    def walk(x: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StringType):
            return redact(x, secrets)
        if isinstance(kind, T.ArrayType):
            return F.transform(x, lambda v: walk(v, kind.elementType))
        if isinstance(kind, T.MapType):
            pairs = F.transform(F.map_entries(x), lambda e: F.struct(walk(e["key"], kind.keyType).alias("key"), walk(e["value"], kind.valueType).alias("value")))
            return F.map_from_entries(pairs)
        if isinstance(kind, T.StructType):
            return F.when(x.isNotNull(), F.struct(*[walk(x[f.name], f.dataType).alias(f.name) for f in kind]))
        return x

    return walk(F.col(c), df.schema[c].dataType)
