"""Append-only Parquet stores: content-addressed objects, keyed appends, checked manifests."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scale import bucketed_digest
from ..operators.versions import content_id, manifest


def content_address(df: DataFrame) -> str:
    """One id for equal rows in any order and equal schema."""
    m = manifest(df).first()
    return hashlib.sha256(f"{df.schema.simpleString()}|{m.row_count}|{m.checksum}|{m.hash_sum}".encode()).hexdigest()


def _is_whole(spark: SparkSession, path: str) -> bool:
    """A write leaves _SUCCESS when it is done; a folder without it is what a failed write left."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def publish(df: DataFrame, root: str) -> tuple[str, str]:
    """(path, id); publishing equal content again returns the same path and writes nothing, but over the leftovers of a
    write that failed."""
    cid = content_address(df)
    path = f"{root}/{cid[:2]}/{cid}.parquet"
    if not _is_whole(df.sparkSession, path):
        df.write.mode("overwrite").parquet(path)
    return path, cid


def read(spark: SparkSession, root: str, cid: str) -> DataFrame:
    df = spark.read.parquet(f"{root}/{cid[:2]}/{cid}.parquet")
    if content_address(df) != cid:
        raise ValueError("content.mismatch")
    return df


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at path; None before its first append."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.parquet(path) if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at) else None


def append_new(spark: SparkSession, incoming: DataFrame, path: str, keys: list[str]) -> int:
    """Append the rows whose keys aren't stored yet; returns how many. Of rows with one key the first in the order of all
    columns stays."""
    rest = [c for c in incoming.columns if c not in keys]
    fresh = incoming.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r")).select(*keys, "_r.*").select(incoming.columns) if rest else incoming.distinct()
    known = stored(spark, path)
    if known is not None:
        fresh = fresh.join(known.select(*keys), keys, "left_anti")
    n = fresh.count()
    if n:
        fresh.write.mode("append").parquet(path)
    return n


class StoreConflict(ValueError):
    """Rows that a store refuses: (code, key) pairs, at most a hundred of them."""

    def __init__(self, conflicts: list[tuple[str, str]]):
        super().__init__(", ".join(f"{c} {k}" for c, k in conflicts))
        self.conflicts = conflicts


MEMBERSHIP = ("membership_id", "universe_version", "canonical_asset_id", "effective_from", "effective_to", "membership_source", "source_version")


def add_memberships(spark: SparkSession, incoming: DataFrame, path: str) -> int:
    """Append memberships with their content ids. A membership that is stored already, or whose content is stored under
    another id, is a conflict, and then nothing is written."""
    rows = incoming.select(*MEMBERSHIP).withColumn("content_id", F.concat(F.lit("sha256:"), content_id(*MEMBERSHIP)))
    known = stored(spark, path)
    twice = [rows.groupBy("membership_id").count().filter("count > 1").select(F.lit("universe/membership-conflict").alias("code"), "membership_id")]
    if known is not None:
        same = rows.join(known.select("content_id", F.col("membership_id").alias("_other")), "content_id")
        code = F.when(F.col("_other") == F.col("membership_id"), "universe/membership-conflict").otherwise("universe/membership-content-conflict")
        twice += [same.select(code.alias("code"), "membership_id"), rows.join(known.select("membership_id"), "membership_id", "left_semi").select(F.lit("universe/membership-conflict").alias("code"), "membership_id")]
    found = reduce(DataFrame.union, twice).distinct().orderBy("code", "membership_id").limit(100).collect()
    if found:
        raise StoreConflict([tuple(r) for r in found])
    n = rows.count()
    rows.write.mode("append").parquet(path)
    return n


def list_memberships(spark: SparkSession, path: str) -> DataFrame:
    return stored(spark, path).orderBy("effective_from", "canonical_asset_id", "membership_id")


def add_definitions(spark: SparkSession, incoming: DataFrame, path: str) -> int:
    """Append factor definitions (definition_id, version_id, ...). One that is stored with the same version is left out; one
    with another version is a conflict, and then nothing is written."""
    known = stored(spark, path)
    fresh = incoming
    if known is not None:
        there = known.select("definition_id", F.col("version_id").alias("_stored"))
        joined = incoming.join(there, "definition_id", "left")
        found = joined.filter(F.col("_stored") != F.col("version_id")).select("definition_id").distinct().orderBy("definition_id").limit(100).collect()
        if found:
            raise StoreConflict([("factor/definition-conflict", r.definition_id) for r in found])
        fresh = joined.filter("_stored is null").drop("_stored")
    n = fresh.count()
    if n:
        fresh.write.mode("append").parquet(path)
    return n


def add_values(spark: SparkSession, incoming: DataFrame, path: str) -> int:
    """Append factor values, each named by definition, date and asset; a value that is stored already stays."""
    name = F.concat_ws(":", "definition_id", F.col("factor_date").cast("string"), "canonical_asset_id")
    return append_new(spark, incoming.withColumn("value_id", name), path, ["value_id"])


def values_of(spark: SparkSession, path: str, definition_id: str) -> DataFrame:
    return stored(spark, path).filter(F.col("definition_id") == definition_id)


def backup_manifest(records: DataFrame, dataset: str, column: str, version: str) -> DataFrame:
    """One row: dataset, record_count, a checksum of the records in any order (hashed in buckets, so that no task holds them
    all), and the distinct versions."""
    h = records.select(F.lit(dataset).alias("dataset"), F.sha2(F.col(column).cast("string"), 256).alias("h"))
    digest = bucketed_digest(h, ["dataset"], "h", "checksum", "\n").withColumnRenamed("row_count", "record_count")
    return digest.crossJoin(records.agg(F.array_sort(F.collect_set(version)).alias("versions")))  # one row


def verify_backup(manifest: DataFrame, records: DataFrame, dataset: str, column: str, version: str) -> int:
    """The number of records if they are what the manifest says; an error that names the dataset if not."""
    m = manifest.filter(F.col("dataset") == dataset).select("record_count", "checksum").first()
    now = backup_manifest(records, dataset, column, version).select("record_count", "checksum").first()
    if m is None or now is None or tuple(m) != tuple(now):
        raise ValueError(f"backup.mismatch {dataset}")
    return now.record_count


def json_sink(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
