"""Stupid-backoff language-model scores, computed relationally.

The model is a bigram model over every word of the corpus, and a document is scored by the rest of the corpus: a bigram's
own occurrences in the document are taken off its count first.

    S(w | v) = (c(vw) - n) / c(v)      if c(vw) > n
             = alpha * c(w) / N        otherwise

and the first word of a document scores c(w) / N.

A document's n-grams are exploded to rows (doc_id, r, o, n) and partitioned by the hash of r. There the n-gram counts are
sums over all rows of one key, and each row meets the counts of its key at once: c(vw) is the sum over (r, o), the count of
the word r the sum over r. So one shuffle serves as count table and as join. The scores are summed per document.

The code of one of the ``common`` most frequent words is its place among them (their counts are broadcast, a bounded
table); any other word's code is a 61-bit hash. A pair of two common words has its codes packed in r; else r is the code of
a rarer word, and o that of the other word and its side; a pair of two rarer words has a row for either, as each knows the
count of one. So a key is hot only if it is a pair of common words. The most frequent of these (``hot`` at most, found in a
sample of some ``sample_bytes`` of text, counted in all texts) are broadcast with their counts, and their part is summed
where the text is read. Which pairs these are changes no score, only where it is summed.

Texts are read in chunks of bounded bytes, and what a worker holds of words and pairs is bounded too.

Nulls and texts without words score 0 with no tokens; a very long text is one chunk. An empty table gives no rows. Rows that share a doc_id (null included) are scored one by one and
summed. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Stash

SHIFT = 17
MASK = (1 << SHIFT) - 1
RARE = 1 << 61
PACKED, FIRST = -1, -2  # what o says of r: two common words, the first word of a document
TOKENS, SEEN, SCORE = -3, -4, -5  # a document's own rows: n is a sum that is known already
ALPHA = 0.4
CHUNK, KEEP = 2_000_000, 200_000  # bytes of text, and words, that a worker holds at once


def hash_code(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word) >> 3 | RARE


def _chunks(batches, text: int):
    """Slices of the batches with about CHUNK bytes of text each, or one row."""
    for b in batches:
        ends = np.cumsum(pc.binary_length(b.column(text)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
        at = 0
        while at < b.num_rows:
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, side="right")))
            yield b.slice(at, stop - at)
            at = stop


def _record(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], list(columns))


class Coder:
    """Words to codes; keeps a bounded number of the codes it has made, those of common words always."""

    def __init__(self, common: dict[int, int] | None = None):
        self.common, self.known = common or {}, {}

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The codes of all words of the texts, and the text of each."""
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        words = lists.flatten().dictionary_encode()
        known, codes = self.known, []
        for w in words.dictionary.cast(pa.binary()).to_pylist():
            c = known.get(w)
            if c is None:
                c = hash_code(w) if w else 0
                c = known[w] = self.common.get(c, c) if w else -1
            codes.append(c)
        if len(known) > KEEP:
            self.known = {w: c for w, c in known.items() if c < RARE}
        x = np.array(codes, np.int64)[words.indices.to_numpy(zero_copy_only=False)] if codes else np.zeros(0, np.int64)
        d = np.repeat(np.arange(len(texts)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        there = x >= 0  # white space at an end leaves an empty word
        return x[there], d[there]


def _mixed(*keys: np.ndarray) -> np.ndarray:
    out = np.zeros(len(keys[0]), np.uint64)
    for k in keys:
        out = (out ^ k.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return out


def _counted(lead: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct rows of the key columns, and the number of each; `lead` (small numbers, in order) stays in order."""
    n = len(lead)
    if not n:
        return (lead, *keys, np.zeros(0, np.int64))
    low, high = max(1, (n - 1).bit_length()), int(lead[-1]).bit_length()
    hashed = (_mixed(*keys) >> np.uint64(low + high)) << np.uint64(low)
    packed = lead.astype(np.uint64) << np.uint64(64 - high) | hashed | np.arange(n, dtype=np.uint64) if high else hashed | np.arange(n, dtype=np.uint64)
    packed.sort()
    order = (packed & np.uint64((1 << low) - 1)).astype(np.int64)
    all_keys = (lead, *keys)
    changed = lambda: np.logical_or.reduce([k[order[1:]] != k[order[:-1]] for k in all_keys])
    new, same_hash = changed(), packed[1:] >> np.uint64(low) == packed[:-1] >> np.uint64(low)
    if (new & same_hash).any():  # two rows hash to one number: sort by the keys themselves
        order = np.lexsort(all_keys[::-1])
        new = changed()
    at = np.flatnonzero(np.r_[True, new])
    return (*(k[order[at]] for k in all_keys), np.diff(np.r_[at, n]).astype(np.int64))


def _summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, n = (np.concatenate(z) for z in zip(*held, strict=True))
    u, at = np.unique(keys, return_inverse=True)
    return u, np.bincount(at, weights=n).astype(np.int64)


def frequent_pairs(docs: DataFrame, most: int, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Up to `most` pairs of words (as hashes) that are frequent in a share of the documents."""

    def pairs(batches):
        coder = Coder()
        for b in _chunks(batches, 0):
            x, d = coder(b.column(0))
            same = d[1:] == d[:-1]
            v, w = x[:-1][same], x[1:][same]
            _, v, w, c = _counted(np.zeros(len(v), np.int64), v, w)
            yield _record(v=v, w=w, c=c)

    unit = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    found = docs.filter(unit < share).select("text").mapInArrow(pairs, "v long, w long, c long").groupBy("v", "w").agg(F.sum("c").alias("c")).filter("c > 1")
    found = most_frequent(Stash(docs.sparkSession).put(found), most).select("v", "w").toPandas()  # `most` rows at most
    return found["v"].to_numpy(np.int64), found["w"].to_numpy(np.int64)


def most_frequent(df: DataFrame, most: int) -> DataFrame:
    """The rows of the largest counts c, `most` at most: all down to a level, an eighth of a power of two. No sort, and only
    the levels' sizes go to the driver."""
    level = F.floor(F.log2(F.col("c").cast("double")) * 8)
    least, total = None, 0
    for r in sorted(df.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r.level):  # 504 levels at most
        total += r.n
        if total > most:
            break
        least = r.level
    return df.filter(F.lit(False) if least is None else level >= least)


def counts(docs: DataFrame, v: np.ndarray, w: np.ndarray) -> DataFrame:
    """(code, c, pair): the words' counts over all documents, and (pair) those of the given pairs, by their place."""
    order = np.argsort(_mixed(v, w))
    shared = docs.sparkSession.sparkContext.broadcast((v[order], w[order], order))

    def count(batches):
        coder, held, size = Coder(), [], 0
        v, w, place = shared.value
        keys, found = _mixed(v, w), np.zeros(len(v), np.int64)
        for b in _chunks(batches, 0):
            x, d = coder(b.column(0))
            held.append(np.unique(x, return_counts=True))
            size += len(held[-1][0])
            if len(keys):
                same = d[1:] == d[:-1]
                a, z = x[:-1][same], x[1:][same]
                m = _mixed(a, z)
                at = np.minimum(np.searchsorted(keys, m), len(keys) - 1)
                found += np.bincount(at[(v[at] == a) & (w[at] == z)], minlength=len(keys))
            if size > 4 * KEEP:
                held = [_summed(held)]
                size = len(held[0][0])
                if size > 2 * KEEP:
                    yield _record(code=held[0][0], c=held[0][1], pair=np.zeros(size, bool))
                    held, size = [], 0
        if held:
            code, c = _summed(held)
            yield _record(code=code, c=c, pair=np.zeros(len(code), bool))
        some = np.flatnonzero(found)
        yield _record(code=place[some], c=found[some], pair=np.ones(len(some), bool))

    return docs.select("text").mapInArrow(count, "code long, c long, pair boolean").groupBy("code", "pair").agg(F.sum("c").alias("c"))


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", alpha: float = ALPHA, common: int = 65_536, hot: int = 262_144, sample_bytes: float = 5e7) -> DataFrame:
    """One row per doc_id: n_tokens, n_seen (bigrams that other documents hold too), log_score, mean_log_score."""
    spark = docs.sparkSession
    stash = Stash(spark)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    all_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    hot_v, hot_w = frequent_pairs(docs, hot, sample_bytes / max(all_bytes, 1))
    counted = stash.put(counts(docs, hot_v, hot_w))
    words = counted.filter(~F.col("pair"))
    total = words.agg(F.sum("c")).first()[0] or 0
    top = sorted(most_frequent(words, common).collect(), key=lambda r: (-r.c, r.code))  # `common` rows at most
    log_c = np.log(np.array([r.c for r in top], dtype=np.float64))
    codes = {r.code: i for i, r in enumerate(top)}
    seen_pairs = counted.filter("pair").select("code", "c").toPandas()  # `hot` rows at most
    at = seen_pairs["code"].to_numpy(np.int64)
    hot_v, hot_w = (np.array([codes.get(c, -1) for c in z[at].tolist()], np.int64) for z in (hot_v, hot_w))
    both = (hot_v >= 0) & (hot_w >= 0)
    hot_r, hot_c = hot_v[both] << SHIFT | hot_w[both], seen_pairs["c"].to_numpy(np.int64)[both]
    order = np.argsort(hot_r)
    model = spark.sparkContext.broadcast((codes, hot_r[order], hot_c[order], log_c))
    log_n, log_alpha = float(np.log(max(total, 1))), float(np.log(alpha))
    back = log_alpha - log_n

    def exploded(batches):
        """Rows (doc_id, r, o, n): the n-grams, and what is known of each document here already."""
        codes, hot_r, hot_c, log_c = model.value
        coder = Coder(codes)
        for b in _chunks(batches, 1):
            who = b.column(0)
            x, d = coder(b.column(1))
            in_each = lambda at, weights=None: np.bincount(at, weights=weights, minlength=len(who))
            is_first = np.ones(len(d), bool)
            is_first[1:] = d[1:] != d[:-1]
            is_rare = x >= RARE
            known = in_each(d[~is_rare], log_c[x[~is_rare]] + np.where(is_first[~is_rare], -log_n, back))  # common words back off
            same = ~is_first[1:]
            v, w, k = x[:-1][same], x[1:][same], d[1:][same]
            rare_v, rare_w = is_rare[:-1][same], is_rare[1:][same]
            packs = ~(rare_v | rare_w)
            kp, r, n = _counted(k[packs], v[packs] << SHIFT | w[packs])
            left = np.zeros(len(r), np.int64)
            here = np.zeros(len(r), bool)
            if len(hot_r):
                at = np.minimum(np.searchsorted(hot_r, r), len(hot_r) - 1)
                here = hot_r[at] == r
                left = np.where(here, hot_c[at] - n, 0)
            won = left > 0
            gain = np.log(left[won]) - log_c[r[won] >> SHIFT] - log_c[r[won] & MASK] - back
            known += in_each(kp[won], n[won] * gain)
            seen = in_each(kp[won], n[won])
            own, size = np.arange(len(who)), in_each(d)
            spread = np.random.default_rng(len(x)).integers(0, RARE, len(who))  # dealt to all partitions
            fk, fr, fn = _counted(d[is_first & is_rare], x[is_first & is_rare])
            wk, wr, wo, wn = _counted(k[rare_w], w[rare_w], v[rare_w] << 1)
            vk, vr, vo, vn = _counted(k[rare_v], v[rare_v], w[rare_v] << 1 | 1)
            parts = [(kp[~here], r[~here], PACKED, n[~here]), (wk, wr, wo, wn), (vk, vr, vo, vn), (fk, fr, FIRST, fn), (own, spread, TOKENS, size)]
            parts += [(own[z != 0], spread[z != 0], what, z[z != 0]) for what, z in ((SEEN, seen), (SCORE, known))]
            k, r, n = (np.concatenate([p[i] for p in parts]) for i in (0, 1, 3))
            o = np.concatenate([np.broadcast_to(p[2], len(p[0])) for p in parts])
            yield _record(doc_id=who.take(pa.array(k)), r=r, o=o, n=n.astype(np.float64))

    rows = docs.mapInArrow(exploded, f"doc_id {id_type}, r long, o long, n double")
    return summed_scores(rows, spark.createDataFrame([(i, float(z)) for i, z in enumerate(log_c)], "code long, log_c double"), log_n, log_alpha)


def summed_scores(rows: DataFrame, common: DataFrame, log_n: float, log_alpha: float) -> DataFrame:
    """The scores of exploded rows; common (code, log_c): the bounded table of common words."""
    o, n, r = F.col("o"), F.col("n"), F.col("r")
    second = (o >= 0) & (o.bitwiseAND(1) == 0)  # r is the pair's second word
    by_key, by_word = Window.partitionBy("r", "o"), Window.partitionBy("r")
    rows = rows.repartition("r").withColumn("c", F.sum("n").over(by_key)).withColumn("c_r", F.sum(F.when(second | (o == FIRST), n)).over(by_word))
    other = F.when(o == PACKED, F.shiftright(r, SHIFT)).when(o >= 0, F.shiftright(o, 1))
    lookup = lambda name: F.broadcast(common.select(F.col("code").alias(f"{name}_code"), F.col("log_c").alias(name)))  # noqa: E731  `common` rows
    rows = rows.withColumn("other", other).withColumn("packed_w", F.when(o == PACKED, r.bitwiseAND(MASK)))
    rows = rows.join(lookup("log_o"), F.col("other") == F.col("log_o_code"), "left").join(lookup("log_w"), F.col("packed_w") == F.col("log_w_code"), "left")
    back = log_alpha - log_n
    won, rest, log_r = F.col("c") > n, F.log(F.col("c") - n), F.log("c_r")
    is_rare = F.col("other") >= RARE
    part = (
        F.when(o == SCORE, n)
        .when(o == FIRST, n * (log_r - log_n))
        .when(o == PACKED, F.when(won, n * (rest - F.col("log_o") - F.col("log_w") - back)))
        .when(second, F.when(won, n * (rest - F.coalesce("log_o", F.lit(0.0)))).otherwise(n * (log_r + back)))
        .when(o >= 0, F.when(won & is_rare, -n * log_r).when(won, n * (rest - log_r - F.col("log_o") - back)))
    )
    counts_here = won & ((o == PACKED) | second | ((o >= 0) & ~is_rare))
    parts = rows.select("doc_id", F.when(o == TOKENS, n).otherwise(0.0).alias("t"), F.when((o == SEEN) | counts_here, n).otherwise(0.0).alias("k"), F.coalesce(part, F.lit(0.0)).alias("s"))
    out = parts.groupBy("doc_id").agg(F.sum("t").cast("long").alias("n_tokens"), F.sum("k").cast("long").alias("n_seen"), F.sum("s").alias("log_score"))
    return out.withColumn("mean_log_score", F.when(F.col("n_tokens") > 0, F.col("log_score") / F.col("n_tokens")).otherwise(0.0))
