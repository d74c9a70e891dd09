"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

import pandas as pd
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

#: Lower-cases A-Z only, on UTF-8 bytes; bytes.split() then cuts at \x20 and \x09-\x0D exactly.
ASCII_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session (tests) gets a
    folder of its own; on a cluster that would be no shared one, so the job ends there."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidewater-"))
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


class Stash:
    """Intermediate tables written to the shared folder: they cut lineage and outlive lost executors.

    A result may read them whenever it is asked for, so they stay until the session ends; clear() drops them before."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/stash-{uuid.uuid4().hex}", 0
        STASHES.append(self)

    def put(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._stash_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Remove a table that nothing will read again."""
        self._delete(df._stash_path)

    def clear(self) -> None:
        """Remove all tables of this stash."""
        self._delete(self.root)

    def _delete(self, at: str) -> None:
        jvm, sc = self.spark._jvm, self.spark.sparkContext._jsc
        path = jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(sc.hadoopConfiguration()).delete(path, True)


STASHES: list[Stash] = []


@atexit.register
def clear_stashes() -> None:
    """Remove what this process has stashed; a session that has ended already leaves its folder to its owner."""
    while STASHES:
        stash = STASHES.pop()
        if stash.spark.sparkContext._jsc is not None:
            with contextlib.suppress(Py4JError, ConnectionError):  # the JVM may end first
                stash.clear()


def numbered(rows: DataFrame, keys: list[str], out: str, buckets: int, order: tuple[str, ...] = ()) -> DataFrame:
    """rows (a written table with a unique column `_row`) with 0, 1, ... for the rows of each key, without gaps.

    A key's rows lie in hash buckets that are numbered by themselves; a bucket begins where the sums of those before it end.
    So no task holds a key, however many rows it has."""
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64("_row"), F.lit(buckets)))
    sums = rows.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    begin = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    begins = sums.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_bucket").alias("_b"), begin.alias("_begin"))
    inner = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order, "_row")) - 1
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [F.col("_bucket") == F.col("_b")]
    joined = rows.withColumn("_inner", inner).join(begins, same)
    return joined.withColumn(out, (F.col("_begin") + F.col("_inner")).cast("long")).drop("_bucket", "_b", "_begin", "_inner", *[f"_k_{k}" for k in keys])


HOT = 1024


def join_counted(rows: DataFrame, table: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """rows joined to a table with one row for each key, which says in column n how many rows have it. Keys of at least
    1/HOT of all rows (so HOT keys at most) are broadcast; the others' rows are shuffled."""
    hot = F.col(n) * HOT >= total
    few = table.filter(hot)
    return rows.join(F.broadcast(few), key).unionByName(rows.join(F.broadcast(few.select(key)), key, "left_anti").join(table.filter(~hot), key))


def fold(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 4 (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % 4


def held_out(id_col: Column) -> Column:
    return fold(id_col) == 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def even_share(sizes: list[int], most: int) -> int | None:
    """What each class may take so that all take `most` together, small ones leaving theirs; None if everything fits."""
    if sum(sizes) <= most:
        return None
    for i, s in enumerate(sorted(sizes)):
        share = most // (len(sizes) - i)
        if s > share:
            return share
        most -= s


def fitting(rows: pd.DataFrame, share: int) -> pd.DataFrame:
    """The keys of one class's rows in their order, without those that don't fit; the shortest if none does."""
    rows = rows.sort_values(["_h", "_t", "_size", "_key"])
    left, keys = share, []
    for k, s in zip(rows["_key"].tolist(), rows["_size"].tolist(), strict=True):
        if s <= left:
            left -= s
            keys.append(k)
    return pd.DataFrame({"_key": keys or rows.nsmallest(1, "_size")["_key"].tolist()}, dtype="int64")


def sampled(rows: DataFrame, class_col: str, most: Column, max_classes: int) -> DataFrame:
    """rows (_id, _text, class_col) -> (class_col, _text, _h): some `most` different rows of each class (an expression over
    it), by a hash of id and text; at least one. Equal rows count once, so no repeated row or shared id widens a class."""
    unit = F.pmod(F.xxhash64("_id", class_col, "_text"), F.lit(1 << 30)) / float(1 << 30)
    sizes = rows.groupBy(class_col).agg(F.count("*").alias("_n"), F.min(unit).alias("_least"))
    if sizes.limit(max_classes + 1).count() > max_classes:
        raise ValueError(f"over {max_classes} different values of {class_col}")
    taken = rows.join(F.broadcast(sizes), class_col).filter((unit < most / F.col("_n")) | (unit == F.col("_least")))  # max_classes rows are broadcast
    return taken.select(class_col, "_text", F.xxhash64("_id").alias("_h")).dropDuplicates()


def taken_bytes(rows: DataFrame, class_col: str, max_bytes: int) -> list[Row]:
    """Rows (class_col, _text, _h) with max_bytes of text; where they hold more, an even share of it for each class.

    A class takes its rows in the order of _h and skips only what does not fit its share; none stays empty.
    """
    stash = Stash(rows.sparkSession)
    kept = stash.put(rows.withColumns({"_size": F.length("_text"), "_t": F.xxhash64("_text"), "_key": F.monotonically_increasing_id()}))
    share = even_share([r.n for r in kept.groupBy(class_col).agg(F.sum("_size").alias("n")).collect()], max_bytes)  # a row a class
    taken = kept
    if share is not None:
        keys = kept.select(class_col, "_h", "_t", "_size", "_key").groupBy(class_col).applyInPandas(lambda r: fitting(r, share), "_key long")
        taken = kept.join(keys, "_key", "left_semi")
    out = list(taken.select(rows.columns).toLocalIterator())
    stash.drop(kept)
    return out


_kept: dict[str, object] = {}


def worker_keeps(key: str, make):
    """What a Python worker keeps from one task to the next: one thing, which goes when another is asked for."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def worker_lets_go() -> None:
    """For tasks that keep nothing: a worker outlives its stage, and what an earlier stage kept would take its memory on."""
    if _kept:
        _kept.clear()
        pa.default_memory_pool().release_unused()  # what Arrow has freed, its pool still holds
