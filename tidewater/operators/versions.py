"""Immutable revision chains: publishing, current and historical views, point-in-time facts, manifests."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .temporal import latest_by


def content_id(*columns: str) -> Column:
    """sha256 of the fields, unit-separated; nulls count as empty."""
    return F.sha2(F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)


def chain(df: DataFrame, keys: list[str], order: list[str], content: str) -> DataFrame:
    """Rows in arrival order to revisions: equal content of neighbours is one version; position and predecessor."""
    w = Window.partitionBy(*keys).orderBy(*order)
    same = F.lag(F.struct(content)).over(w)
    changed = df.withColumn("_same", F.coalesce(same[content].eqNullSafe(F.col(content)) & same.isNotNull(), F.lit(False))).filter(~F.col("_same")).drop("_same")
    return changed.withColumn("revision_position", F.row_number().over(w)).withColumn("predecessor_content", F.lag(content).over(w))


def publish(store: DataFrame, incoming: DataFrame, keys: list[str], content: str) -> DataFrame:
    """The rows to append: incoming rows (one per key) whose content differs from the key's current version. Null is a
    content like any other."""
    now = latest_by(store.select(*keys, content, "revision_position"), keys, ["revision_position"]).select(*keys, F.col(content).alias("_now"), F.col("revision_position").alias("_at"))
    fresh = incoming.join(now, keys, "left").filter(F.col("_at").isNull() | ~F.col("_now").eqNullSafe(F.col(content)))
    return fresh.withColumn("revision_position", F.coalesce(F.col("_at"), F.lit(0)) + 1).withColumn("predecessor_content", F.col("_now")).drop("_now", "_at")


def with_ids(chained: DataFrame, dataset: str, keys: list[str], content_id_col: str, logical: str) -> DataFrame:
    """revision_id, version_id and predecessor_id of a chain(): each revision's id hashes its predecessor's version id, the
    dataset, the logical key and the content id; nulls are left out of a hash.

    The ids of a key follow from one another, so its revisions pass through one task in order; what is held of them is the
    last id, so a key may have any number."""
    cols = chained.columns
    added = T.StructType(list(chained.schema)).add("predecessor_id", "string").add("revision_id", "string").add("version_id", "string")
    sha = lambda *parts: sha256("\u001f".join(x for x in parts if x is not None).encode()).hexdigest()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, before = None, None
        for b in batches:
            ids: list[tuple] = []
            for key, k, cid in zip(zip(*(b.column(c).to_pylist() for c in keys), strict=True), b.column("_key").to_pylist(), b.column("_cid").to_pylist(), strict=True):
                if key != last:
                    last, before = key, None
                revision = sha(before or "", dataset, k, cid)
                version = sha(revision, cid)
                ids.append((before, revision, version))
                before = version
            new = [pa.array(x, pa.string()) for x in zip(*ids, strict=True)] or [pa.array([], pa.string())] * 3
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in cols), *new], names=[*cols, "predecessor_id", "revision_id", "version_id"])

    ordered = chained.withColumns({"_key": F.col(logical).cast("string"), "_cid": F.col(content_id_col).cast("string")}).repartition(*map(F.col, keys)).sortWithinPartitions(*keys, "revision_position")
    return ordered.mapInArrow(fold, added)


#: The fields of each dataset's content, and their kinds, in order.
CONTENT = {
    "DAILY_BAR": (("canonical_asset_id", "text"), ("trading_date", "date"), ("open", "decimal"), ("high", "decimal"), ("low", "decimal"), ("close", "decimal"), ("volume", "decimal"), ("turnover", "decimal"), ("trading_currency", "text"), ("provider_available_at", "timestamp"), ("retrieved_at", "timestamp"), ("provider", "text"), ("provider_code", "text"), ("provenance_id", "text")),
    "FUND_NAV": (("canonical_asset_id", "text"), ("valuation_date", "date"), ("unit_nav", "decimal"), ("cumulative_nav", "decimal"), ("pricing_currency", "text"), ("provider_available_at", "timestamp"), ("retrieved_at", "timestamp"), ("provider", "text"), ("provider_code", "text"), ("provenance_id", "text")),
    "FUNDAMENTAL_FACT": (("canonical_asset_id", "text"), ("metric_name", "text"), ("value", "decimal"), ("unit", "text"), ("currency", "text"), ("reporting_period_start", "date"), ("reporting_period_end", "date"), ("announcement_at", "timestamp"), ("provider_available_at", "timestamp"), ("provider", "text"), ("revision_version", "text"), ("provenance_id", "text")),
}
#: What names one observation of a dataset, and its date.
LOGICAL = {"DAILY_BAR": (("canonical_asset_id", "trading_date"), "trading_date"), "FUND_NAV": (("canonical_asset_id", "valuation_date"), "valuation_date"), "FUNDAMENTAL_FACT": (("canonical_asset_id", "metric_name", "reporting_period_start", "reporting_period_end"), "reporting_period_end")}


def logical_key(dataset: str) -> Column:
    return F.concat_ws("|", *[F.col(c).cast("string") for c in LOGICAL[dataset][0]])


def logical_date(dataset: str) -> Column:
    return F.col(LOGICAL[dataset][1])


def canonical_json(dataset: str) -> Column:
    """A row's content as one text: an array of {field, type, value}, decimals and dates as text, timestamps in UTC."""
    as_text = {"text": lambda c: F.col(c), "decimal": lambda c: F.col(c).cast("string"), "date": lambda c: F.date_format(c, "yyyy-MM-dd"), "timestamp": _iso_utc}
    rows = [F.struct(F.lit(c).alias("field"), F.lit(kind).alias("type"), as_text[kind](c).cast("string").alias("value")) for c, kind in CONTENT[dataset]]
    return F.to_json(F.array(*rows), {"ignoreNullFields": "false"})


def _iso_utc(c: str) -> Column:
    """2024-01-01T12:00:00+00:00, with microseconds where there are any."""
    t = F.to_utc_timestamp(c, F.current_timezone())
    whole = F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(t, "SSSSSS")
    return F.concat(whole, F.when(micros == "000000", "").otherwise(F.concat(F.lit("."), micros)), F.lit("+00:00"))


def canonical_content_id(dataset: str) -> Column:
    return F.sha2(canonical_json(dataset), 256)


def current(df: DataFrame, keys: list[str]) -> DataFrame:
    return latest_by(df, keys, ["revision_position"])


def history(df: DataFrame, keys: dict) -> DataFrame:
    for c, v in keys.items():
        df = df.filter(F.col(c) == v)
    return df.orderBy("revision_position")


def point_in_time(facts: DataFrame, keys: list[str], decision_at: Column, available_at: str, tie: str) -> tuple[DataFrame, DataFrame]:
    """(selected, excluded): the latest fact available at the decision; all later ones with the reason."""
    visible = F.col(available_at) <= decision_at
    return latest_by(facts.filter(visible), keys, [available_at, tie]), facts.filter(~visible).withColumn("reason", F.lit("decision-time-before-provider-available-at"))


def align(observations: DataFrame, decision_at: Column, available_at: str) -> DataFrame:
    """All observations, each included or not at a decision, and why not."""
    seen = F.coalesce(F.col(available_at) <= decision_at, F.lit(False))
    return observations.withColumn("included", seen).withColumn("exclusion_reason", F.when(~seen, "provider-available-after-decision"))


def manifest(df: DataFrame) -> DataFrame:
    """Order-insensitive content of a table: row count, sum and xor of row hashes."""
    h = F.xxhash64(*[F.col(c) for c in sorted(df.columns)])
    return df.agg(F.count("*").alias("row_count"), F.bit_xor(h).alias("checksum"), F.sum(h.cast("decimal(38,0)")).cast("string").alias("hash_sum"))


def changes(df: DataFrame, key: str, order: str, attributes: list[str]) -> DataFrame:
    """SCD-2: a version wherever an attribute changes; each ends the day before the next begins."""
    w = Window.partitionBy(key).orderBy(order)
    state = F.struct(*attributes)
    v = df.withColumn("_b", F.lag(state).over(w)).filter(~F.col("_b").eqNullSafe(state)).drop("_b")
    return v.withColumn("effective_from", F.col(order)).withColumn("effective_to", F.date_sub(F.lead(order).over(Window.partitionBy(key).orderBy(order)), 1))
