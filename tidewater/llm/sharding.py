"""K-d tree sharding: near-equal bytes per shard, documents with like metadata together.

The items are distinct texts (equal texts share a shard). Their metadata are coordinates: size, source, language and
smallest doc_id. A node of the tree is cut at a weighted median along the dimension in which it is widest, until each
leaf has its share of the bytes: a node of m shards is cut in the proportion m//2 : m - m//2.

Medians are distributed: an item's coordinate and a hash make one 62-bit key, and the key of the cut is found digit by
digit (11 bits at a time) from sums of bytes per node and digit, at most nodes x 2048 sums a round. If the item on the
cut is so large that either side would be uneven, it is put on the left and the cut is sought among the rest.

Only a text whose copies outweigh a whole shard is divided among shards, row by row. A null text is a text of its own
with size 1. Slots number a shard's rows from 0 without gaps: sums over hash buckets give each bucket its first slot.
Of a text of any length only size and hashes are kept; an empty table gives no rows. Ids
that are no numbers count by their crc32. Null and repeated ids, and repeated rows, are rows like any other. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stash, join_counted, numbered

DIGIT, KEY_BITS, UNEVEN, BUCKET_ROWS = 11, 62, 0.005, 20_000
DIMS = ("d_size", "d_source", "d_lang", "d_id")


def _items(docs: DataFrame, shards: int, stash: Stash) -> tuple[DataFrame, DataFrame, int]:
    """The rows with their item, the items with coordinates in 0..1, and all bytes."""
    rows = stash.put(docs.withColumn("_row", F.monotonically_increasing_id()))
    total = rows.agg(F.sum("size")).first()[0] or 0
    bytes_of = rows.groupBy("t1", "t2").agg(F.sum("size").alias("all_bytes"))
    parts = bytes_of.filter(F.col("all_bytes") * shards > max(total, 1)).withColumn("parts", F.ceil(F.col("all_bytes") * shards * 8 / max(total, 1)))  # at most `shards` rows
    rows = rows.join(F.broadcast(parts.drop("all_bytes")), ["t1", "t2"], "left").withColumn("part", F.when(F.col("parts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("_row", F.lit(1)), "parts")).cast("long")).drop("parts")
    rows = rows.withColumn("item", F.when(F.col("part") > 0, F.xxhash64("t1", "t2", "part")).otherwise(F.xxhash64("t1", "t2")))
    items = rows.groupBy("item").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.log(F.max("size").cast("double")).alias("d_size"), (F.crc32(F.coalesce(F.min("source"), F.lit(""))) / float(1 << 32)).alias("d_source"), (F.crc32(F.coalesce(F.min("lang"), F.lit(""))) / float(1 << 32)).alias("d_lang"), F.coalesce(F.min("doc_id").cast("string").try_cast("double"), F.crc32(F.min("doc_id").cast("string")).cast("double"), F.lit(0.0)).alias("d_id"))
    items = stash.put(items)
    ends = items.agg(*(f(d).alias(f"{n}_{d}") for d in DIMS for n, f in (("lo", F.min), ("hi", F.max)))).first()
    for d in DIMS:
        lo, hi = ends[f"lo_{d}"] or 0.0, ends[f"hi_{d}"] or 0.0
        items = items.withColumn(d, (F.col(d) - lo) / (hi - lo) if hi > lo else F.lit(0.0))
    return rows, items, total


def _pick(cases: dict[int, object], default):
    """A column: the value of the row's node, from a small dict."""
    out = F.lit(default)
    for node, value in cases.items():
        out = F.when(F.col("node") == node, value if not isinstance(value, (int, float)) else F.lit(value)).otherwise(out)
    return out


def _cuts(keyed: DataFrame, goals: dict[int, float]) -> dict[int, tuple[int, int, int, float]]:
    """For each node the key at which the sum of bytes passes its goal, the bytes below it, and those of that key."""
    prefix, below, last = dict.fromkeys(goals, 0), dict.fromkeys(goals, 0), {}
    shift = KEY_BITS
    while shift > 0:
        step = min(DIGIT, shift)
        shift -= step
        here = keyed.filter(F.col("node").isin(list(goals)) & (F.shiftrightunsigned("key", shift + step) == _pick(prefix, -1).cast("long")))
        sums = here.groupBy("node", F.shiftrightunsigned("key", shift).alias("digit")).agg(F.sum("bytes").alias("b")).collect()  # nodes x 2048 rows at most
        by: dict[int, list] = {n: [] for n in goals}
        for r in sums:
            by[r.node].append((r.digit, r.b))
        for node, rows in by.items():
            for digit, b in sorted(rows):
                prefix[node], last[node] = digit, b
                if below[node] + b > goals[node] or digit == max(rows)[0]:
                    break
                below[node] += b
    return {n: (prefix[n], below[n], last.get(n, 0), goals[n]) for n in goals}


def assign_shards(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, shard (0..shards-1), slot."""
    stash = Stash(docs.sparkSession)
    text = F.col(text_col).cast("string")
    slim = docs.select(F.col(id_col).alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"), F.xxhash64(text, F.lit(7)).alias("t1"), F.xxhash64(F.md5(F.coalesce(text, F.lit("")))).alias("t2"), F.col(source_col).cast("string").alias("source"), F.col(lang_col).cast("string").alias("lang"))
    rows, items, total = _items(slim, shards, stash)
    items = items.withColumn("node", F.lit(0)).withColumn("low", F.pmod(F.xxhash64("item", F.lit(3)), F.lit(1 << 31)))
    spans = {0: (0, shards)}  # node -> its shards [a, b)
    while any(b - a > 1 for a, b in spans.values()) and total:
        todo = {n: ab for n, ab in spans.items() if ab[1] - ab[0] > 1}
        items = stash.put(items)
        stats = {r.node: r for r in items.filter(F.col("node").isin(list(todo))).groupBy("node").agg(F.sum("bytes").alias("b"), *((F.max(d) - F.min(d)).alias(d) for d in DIMS)).collect()}
        todo = {n: ab for n, ab in todo.items()}
        wide = {n: max(DIMS, key=lambda d, n=n: (stats[n][d] if n in stats else 0, -DIMS.index(d))) for n in todo}
        coord = _pick({n: F.col(d) for n, d in wide.items()}, 0.0)
        keyed = items.withColumn("key", F.shiftleft(F.least(F.floor(coord * float(1 << 31)), F.lit((1 << 31) - 1)).cast("long"), 31).bitwiseOR(F.col("low")))
        goals = {n: (stats[n].b if n in stats else 0) * ((b - a) // 2) / (b - a) for n, (a, b) in todo.items()}
        aside: dict[int, list[int]] = {n: [] for n in todo}
        found: dict[int, int] = {}
        pending = dict(goals)
        while pending:
            skip = [k for n in pending for k in aside[n]]
            cuts = _cuts(keyed.filter(~F.col("key").isin(skip)) if skip else keyed, pending)
            again = {}
            for n, (key, below, here, goal) in cuts.items():
                size = stats[n].b if n in stats else 0
                off = min(goal - below, below + here - goal)
                if size and off > UNEVEN * size and here <= goal and len(aside[n]) < 16:
                    aside[n].append(key)
                    again[n] = goal - here
                else:
                    found[n] = key if goal - below <= below + here - goal else key + 1
            pending = again
        left = (F.col("key") < _pick(found, 0).cast("long")) | F.coalesce(F.col("key").isin([k for ks in aside.values() for k in ks]) if any(aside.values()) else F.lit(False), F.lit(False))
        nxt, child = {}, {}
        for n, (a, b) in spans.items():
            if n not in todo:
                nxt[2 * n + 1] = (a, b)
                child[n] = None
            else:
                m = a + (b - a) // 2
                nxt[2 * n + 1], nxt[2 * n + 2] = (a, m), (m, b)
        split = F.col("node").isin(list(todo))
        items = keyed.withColumn("node", F.when(split & ~left, 2 * F.col("node") + 2).otherwise(2 * F.col("node") + 1)).drop("key")
        spans = nxt
    shard = _pick({n: a for n, (a, _) in spans.items()}, 0)
    placed = join_counted(rows, stash.put(items.select("item", "n", shard.cast("int").alias("shard"))), "item", "n", rows.count())
    placed = stash.put(placed.select("doc_id", "size", "text_crc32", "shard", "_row"))
    buckets = placed.count() // BUCKET_ROWS + 1
    return numbered(placed, ["shard"], "slot", buckets, ("doc_id",)).select("doc_id", "size", "text_crc32", "shard", "slot")
