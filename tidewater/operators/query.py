"""Typed dataset queries: validation with every code, IN filters with aliases, null-first order, pages with counts."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_FILTERS, MAX_LIMIT, DEFAULT_LIMIT = 20, 10_000, 100

#: The queryable datasets and the fields each may be filtered by.
DATASETS = {
    "ASSET_MASTER": ("canonical_asset_id", "asset_type", "market", "name"),
    "DAILY_BAR": ("canonical_asset_id", "trading_currency", "provider", "provenance_id"),
    "FUND_NAV": ("canonical_asset_id", "pricing_currency", "provider", "provenance_id"),
    "FUNDAMENTAL_FACT": ("canonical_asset_id", "metric_name", "unit", "currency", "provider", "provenance_id"),
    "TRADING_CALENDAR": ("version_id", "market", "exchange", "timezone"),
    "MARKET_RULE_PROFILE": ("version_id", "market", "exchange", "asset_type"),
    "VALUATION_CALENDAR": ("version_id", "market", "timezone"),
    "CORPORATE_ACTION": ("version_id", "canonical_asset_id", "event_id", "action_type", "provider", "provenance_id"),
}
#: A filter on the first name also matches these fields.
ALIASES = {"trading_currency": ("currency",), "pricing_currency": ("currency",), "market": ("asset_type",)}
COMPARISONS = {"=": Column.__eq__, "==": Column.__eq__, "!=": Column.__ne__, "<>": Column.__ne__, ">": Column.__gt__, ">=": Column.__ge__, "<": Column.__lt__, "<=": Column.__le__}


@dataclass(frozen=True)
class QueryFilter:
    field: str
    values: tuple[str, ...]


@dataclass(frozen=True)
class TypedQuery:
    snapshot_id: str
    dataset: str
    filters: tuple[QueryFilter, ...] = field(default=())
    limit: int = DEFAULT_LIMIT
    offset: int = 0


class QueryError(ValueError):
    """All violations of a request: (code, field path)."""

    def __init__(self, errors: list[tuple[str, str]]):
        super().__init__(", ".join(f"{c} at {p}" for c, p in errors))
        self.errors = errors


def validate(q: TypedQuery, snapshots: set[str]) -> list[tuple[str, str]]:
    out = []
    if q.snapshot_id not in snapshots:
        out.append(("snapshot.unavailable", "snapshot_id"))
    if q.dataset not in DATASETS:
        out.append(("dataset.unsupported", "dataset"))
    if len(q.filters) > MAX_FILTERS:
        out.append(("filters.limit", "filters"))
    if not 1 <= q.limit <= MAX_LIMIT:
        out.append(("limit.range", "limit"))
    if q.offset < 0:
        out.append(("offset.range", "offset"))
    allowed = DATASETS.get(q.dataset, ())
    out += [("filter.unsupported", f"filters[{i}].field") for i, f in enumerate(q.filters, 1) if q.dataset in DATASETS and f.field not in allowed]
    return out


def in_filter(df: DataFrame, f: QueryFilter) -> Column:
    """The field or one of its aliases has one of the values (compared in the column's own type)."""
    names = [n for n in (f.field, *ALIASES.get(f.field, ())) if n in df.columns]
    if not names:
        return F.lit(False)
    one = lambda n: F.coalesce(F.col(n).isin([F.lit(v).try_cast(df.schema[n].dataType) for v in f.values]), F.lit(False))
    return reduce(or_, map(one, names))


def order_keys(df: DataFrame) -> list[Column]:
    pick = lambda *names: F.coalesce(*[F.col(n).cast("string") for n in names if n in df.columns], F.lit(None).cast("string")).asc_nulls_first()
    return [pick("canonical_asset_id"), pick("observation_date", "available_at"), pick("version_id", "data_version_id")]


def run(q: TypedQuery, views: dict, snapshots: set[str]) -> tuple[DataFrame, DataFrame]:
    """(page, counts): the ordered page, and matching_count, returned_count, additional_results."""
    if errors := validate(q, snapshots):
        raise QueryError(errors)
    df = views[q.dataset]
    hits = df.filter(reduce(and_, [in_filter(df, f) for f in q.filters])) if q.filters else df
    page = hits.orderBy(*order_keys(df)).offset(q.offset).limit(q.limit)
    counts = hits.agg(F.count("*").alias("matching_count")).select("matching_count", F.greatest(F.least(F.col("matching_count") - q.offset, F.lit(q.limit)), F.lit(0)).cast("long").alias("returned_count"), (F.col("matching_count") > q.offset + q.limit).alias("additional_results"))
    return page, counts


def predicate(conditions: list[tuple[str, str, object]]) -> Column:
    """AND of column comparisons with literals (str, int, float, Decimal, date)."""
    for _, op, _v in conditions:
        if op not in COMPARISONS:
            raise ValueError(f"operator {op}")
    return reduce(and_, [COMPARISONS[op](F.col(c), F.lit(v)) for c, op, v in conditions], F.lit(True))


def filter_map(conditions: dict) -> Column:
    """Scalar: equality; None: IS NULL; 2-tuple: inclusive BETWEEN."""
    one = lambda c, v: F.col(c).isNull() if v is None else F.col(c).between(*v) if isinstance(v, tuple) else F.col(c) == v
    return reduce(and_, [one(c, v) for c, v in conditions.items()], F.lit(True))


def optional(df: DataFrame, **equals) -> DataFrame:
    """(? IS NULL OR column = ?) for each argument."""
    for c, v in equals.items():
        df = df if v is None else df.filter(F.col(c) == v)
    return df


def search(df: DataFrame, text: str, columns: list[str], limit: int) -> DataFrame:
    """Case-insensitive substring in any column; the limit is clamped to 1..50."""
    q = text.strip().lower()
    return df.filter(reduce(or_, [F.lower(F.col(c)).contains(q) for c in columns])).orderBy(*columns).limit(max(1, min(50, limit)))


def trigrams(df: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """A posting table for substring search: one row (gram, id, column) for each run of three characters of the lower-cased
    columns, dealt by gram. Write it once, bucketed or sorted by gram, and a search reads the grams of its text only."""
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda i: F.substring(c, i, F.lit(3))))
    each = [F.struct(F.lit(c).alias("column"), F.when(F.length(c) >= 3, grams(F.lower(F.col(c)))).alias("grams")) for c in columns]
    rows = df.select(F.col(id_col).alias("id"), F.explode(F.array(*each)).alias("e")).select("id", "e.column", F.explode("e.grams").alias("gram"))
    return rows.repartition("gram").sortWithinPartitions("gram")


def candidates(df: DataFrame, postings: DataFrame, id_col: str, text: str) -> DataFrame:
    """The rows that hold every trigram of the text in one column; all rows, if it has none."""
    q = text.strip().lower()
    grams = sorted({q[i : i + 3] for i in range(len(q) - 2)})
    if not grams:
        return df
    held = postings.filter(F.col("gram").isin(grams)).groupBy("id", "column").agg(F.count("*").alias("_n")).filter(F.col("_n") == len(grams))
    return df.join(held.select(F.col("id").alias(id_col)).distinct(), id_col, "left_semi")


def search_indexed(df: DataFrame, postings: DataFrame, id_col: str, text: str, columns: list[str], limit: int) -> DataFrame:
    """search() on the rows alone that the trigram postings name; a text of under three characters is searched in all rows."""
    return search(candidates(df, postings, id_col, text), text, columns, limit)


def select(df: DataFrame, columns: list[str], conditions: list[tuple[str, str, object]], limit: int | None) -> DataFrame:
    """A single-table projection with comparison predicates; a limit is 1..10001 rows, None asks for all."""
    if limit is not None and not 1 <= limit <= MAX_LIMIT + 1:
        raise QueryError([("limit.range", "limit")])
    if missing := [c for c in [*columns, *(c for c, _, _ in conditions)] if c not in df.columns]:
        raise QueryError([("column.unknown", c) for c in missing])
    out = df.filter(predicate(conditions)).select(*columns)
    return out if limit is None else out.limit(limit)
