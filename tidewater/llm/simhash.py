"""SimHash fingerprints and near-duplicate classes by pigeonhole blocks.

A fingerprint's 64 bits are cut into ``max_distance + 2`` blocks. Two fingerprints that differ in at most max_distance
bits differ in at most that many blocks, so they agree on two blocks at least: rows (pair of blocks, their bits) are
joined on equality and the Hamming distance is verified. Texts with one fingerprint are one class and enter the join once.

Blocks that more than ``max_block`` fingerprints share are not joined pair by pair. Their members go another exact way,
linear in their number: two fingerprints lie within 2 bits of each other exactly if some 64-bit word lies within 1 bit
of both, so each member is linked to the 65 words around it, and each word (which has 65 members at most) links its
members as a star. No pair is lost and no group is expanded into pairs.

A null text counts as empty; a text without words has fingerprint zero and is linked like any other. Null and repeated ids,
and repeated rows, are rows like any other: each gets a row. A very long text is hashed in slices; an empty table gives no
rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ASCII_LOWER, Stash, join_counted
from .graph import components


def slices(text: bytes, size: int) -> Iterator[list[bytes]]:
    """The text's lower-cased words, some `size` bytes of text at a time; no word is cut."""
    at = 0
    while at < len(text):
        stop = at + size
        while stop < len(text) and text[stop] not in b" \t\n\x0b\x0c\r":
            stop += 1
        yield text[at:stop].translate(ASCII_LOWER).split()
        at = stop


def shingle_hashes(text: bytes | None, width: int = 3, seed: int = 42, size: int = 1_000_000) -> Iterator[list[int]]:
    """Hashes of the word shingles, slice by slice; a slice's last words go before the next one's."""
    h, before, whole = xxhash.xxh64_intdigest, [], True
    for words in slices(text or b"", size):
        words = before + words
        if len(words) < width:
            before = words
            continue
        line, whole = b" ".join(words), False
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.concatenate([[0], ends[:-width]]).tolist()
        yield [h(line[a:b], seed) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)]
        before = words[len(words) - width + 1 :]
    if whole and before:
        yield [h(b" ".join(before), seed)]


def fingerprint(text: bytes | None, width: int = 3, seed: int = 42) -> int:
    """Bit i is 1 if it is set in over half of the shingles' hashes."""
    ones, n = np.zeros(64, dtype=np.int64), 0
    for some in shingle_hashes(text, width, seed):
        hs = np.array(some, dtype="<u8")
        n += len(hs)
        for i in range(0, len(hs), 65_536):
            ones += np.unpackbits(hs[i : i + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


@F.arrow_udf(T.LongType())
def fingerprint_3(texts: pa.Array) -> pa.Array:
    """Fingerprints of 3-word shingles, as signed 64-bit numbers."""
    return pa.array(np.array([fingerprint(t) for t in texts.cast(pa.binary()).to_pylist()], dtype=np.uint64).view(np.int64))


def hexadecimal(fp) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def close_pairs(fps: DataFrame, stash: Stash, max_block: int = 64) -> DataFrame:
    """fps (fp long, distinct) -> (a, b): enough links between fingerprints within 2 bits to connect all such pairs."""
    blocks = [F.shiftrightunsigned("fp", 16 * i).bitwiseAND(0xFFFF) for i in range(4)]
    keys = F.array(*(F.lit(n << 32).cast("long").bitwiseOR(F.shiftleft(blocks[i], 16)).bitwiseOR(blocks[j]) for n, (i, j) in enumerate(combinations(range(4), 2))))
    rows = fps.select("fp", F.explode(keys).alias("key"))
    sizes = rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = stash.put(rows.join(sizes, "key"))
    cold = shared.filter(F.col("n") <= max_block).select("key", "fp")
    joined = cold.select("key", F.col("fp").alias("a")).join(cold.select("key", F.col("fp").alias("b")), "key").filter((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)).select("a", "b")
    hot = shared.filter(F.col("n") > max_block).select("fp").distinct()
    around = F.array(F.lit(0).cast("long"), *(F.lit((1 << i) - (1 << 64) * (i == 63)).cast("long") for i in range(64)))
    stars = hot.select("fp", F.explode(around).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("word")).groupBy("word").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("members"))  # 65 members at most
    return joined.union(stars.filter(F.size("members") > 1).select("a", F.explode("members").alias("b")).filter("a != b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_block: int = 64) -> DataFrame:
    """One row per row of docs: doc_id, fp (long), fingerprint (16 hex digits), component_id, class_size.

    component_id is the smallest non-null id of the component (null if it has none); class_size counts the rows with
    the same fingerprint.
    """
    spark = docs.sparkSession
    stash = Stash(spark)
    marked = stash.put(docs.select(F.col(id_col).alias("doc_id"), fingerprint_3(F.col(text_col).cast("string")).alias("fp")))
    classes = stash.put(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("class_size")))
    edges = close_pairs(classes.select("fp"), stash, max_block)
    root = components(edges, stash).withColumnRenamed("node", "fp")
    named = classes.join(root, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = stash.put(named)
    first = named.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("n"))
    by_fp = stash.put(join_counted(named, first, "root", "n", named.count()).select("fp", "component_id", "class_size"))
    return join_counted(marked, by_fp, "fp", "class_size", marked.count()).select("doc_id", "fp", hexadecimal(F.col("fp")).alias("fingerprint"), "component_id", "class_size")
