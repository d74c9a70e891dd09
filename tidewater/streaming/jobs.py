"""Late-fact screening and evidence, idempotent increments, publishing to a revision chain and the running ledger, as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import versions
from ..operators.trading import fill
from ..sources.store import stored


def windowed_observations(stream: DataFrame, at: str, watermark: str, window: str, key: str, value: str) -> DataFrame:
    """Counts and sums per key and event-time window; rows later than the watermark are left out."""
    s = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, watermark)
    return s.groupBy(F.window(at, window), key).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("window_start"), key, "n", "total")


def screened(stream: DataFrame, key: str, at: str, delay: str) -> DataFrame:
    """Every row, with what became of it: `status` is on-time, or late if its time lies before what its key had reached at the
    end of the batches before, less the delay; `reached` is that time. Late rows stay as evidence, with their reason.

    Each key's state is the latest time it has reached, so no key's slowness or haste touches another's rows."""
    schema = T.StructType(list(stream.schema)).add("status", "string").add("reached", "timestamp")
    wait = pd.Timedelta(delay)

    def step(_, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        reached = pd.Timestamp(state.get[0], unit="us") if state.exists else None
        latest = reached
        for rows in frames:
            when = pd.to_datetime(rows[at])
            late = (when < reached - wait) if reached is not None else pd.Series(False, index=rows.index)
            yield rows.assign(status=late.map({True: "late", False: "on-time"}), reached=reached if reached is not None else pd.NaT)
            if when.notna().any():
                latest = when.max() if latest is None else max(latest, when.max())
        if latest is not None:
            state.update((int(latest.value // 1000),))

    return stream.groupBy(key).applyInPandasWithState(step, schema, "reached long", "append", GroupStateTimeout.NoTimeout)


def publish_batch(batch: DataFrame, batch_id: int, path: str, keys: list[str], order: list[str], content: str) -> int:
    """Append a batch to the revision chain at path, once: its revisions lie in a folder of their own, named by the batch, which
    a repeated batch writes anew from the chain before it; returns how many there are. One writer a path."""
    spark = batch.sparkSession
    known = stored(spark, path)
    before = known.filter(F.col("batch_id") < batch_id) if known is not None else None
    fresh = versions.chain(batch, keys, order, content)
    if before is not None:
        now = versions.current(before, keys).select(*(F.col(k).alias(f"_{k}") for k in keys), F.col(content).alias("_now"), F.col("revision_position").alias("_at"))
        j = fresh.join(now, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left").drop(*(f"_{k}" for k in keys))
        same = F.col("_at").isNotNull() & F.col("_now").eqNullSafe(F.col(content)) & (F.col("revision_position") == 1)
        first_same = F.max(F.when(same, 1).otherwise(0)).over(Window.partitionBy(*keys))
        j = j.withColumn("_skip", first_same).filter(~same)
        first = F.col("revision_position") == 1
        fresh = j.withColumn("predecessor_content", F.when(first & F.col("_at").isNotNull(), F.col("_now")).otherwise(F.col("predecessor_content"))).withColumn("revision_position", F.col("revision_position") + F.coalesce("_at", F.lit(0)) - F.col("_skip")).drop("_now", "_at", "_skip")
    fresh.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    return spark.read.parquet(f"{path}/batch_id={batch_id}").count()


def publish_stream(stream: DataFrame, path: str, checkpoint: str, keys: list[str], order: list[str], content: str):
    """The writer of a stream of observations into the revision chain at path: rows of a key that repeat its current content
    change nothing, others follow it. A batch that is run again after a restart changes nothing."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: publish_batch(df, n, path, keys, order, content))


def increments(stream: DataFrame, content: str, at: str, watermark: str) -> DataFrame:
    """Each content id once within the watermark."""
    return stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, watermark).dropDuplicatesWithinWatermark([content])


def running_ledger(stream: DataFrame, key: str, cash: float) -> DataFrame:
    """The ledger fold, carried from batch to batch per portfolio: the state is its cash and positions."""

    def step(k, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        money, held = (state.get[0], dict(zip(state.get[1], state.get[2], strict=True))) if state.exists else (cash, {})
        out = []
        rows = pd.concat(list(frames)).sort_values(["executed_at", "asset_id", "request_id"], kind="stable")
        for r in rows.itertuples(index=False):
            money, held[r.asset_id], n, why = fill(money, held.get(r.asset_id, 0), r.side, int(r.lots_wanted), int(r.lot), float(r.price), bool(r.halted), r.reference_price, 0.0, 1e9)
            out.append((k[0], str(r.request_id), n, money, why))
        state.update((money, list(held), [int(v) for v in held.values()]))
        yield pd.DataFrame(out, columns=[key, "request_id", "filled", "cash_after", "outcome"])

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, request_id string, filled long, cash_after double, outcome string", "cash double, assets array<string>, positions array<long>", "append", GroupStateTimeout.NoTimeout)
