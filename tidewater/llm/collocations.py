"""Phrase collocations from suffix arrays over word ids.

Texts are read into shards of some ``SHARD`` words. A shard's words get ids, its suffixes are ordered by prefix doubling in
numpy (ranks of 1, 2, 4 words, each from two ranks of half the length), and the intervals of the suffix array over which the
longest common prefix stays n words or more are its n-grams with their counts. The shards' counts are merged by key.

What can't be frequent is not sent: a first pass counts words, a second hashes of pairs of words that are both frequent, a
third phrases in which every pair may be frequent, pairs included. A shard sends its pairs' hashes (20 to ``HASH_BITS`` bits,
as many as the corpus asks for) by ranges of 2 ** ``RANGE_BITS``, sorted, as differences, and a range is summed in as many
counters. Workers know frequent words and pairs by a bitmap over their hashes (at most 2 ** ``MOST_BITS`` bits, 32 MB). Hashes
that collide add up, so no frequent pair is missed, and what they keep too much the exact count of the third pass drops: no
result depends on them.

Words are told apart by language, so no language, source or word is ever gathered in a task: a shard sends one row for each
distinct n-gram, and merging is a sum.

A null text counts as empty, a null language as ``und``; repeated rows count as often as they are there. A text of any length
is cut into segments between words, and the last words of a segment are carried into the next one, so phrases across the cut
count. An empty table gives no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ASCII_LOWER, Stash, join_counted

SHARD, SEGMENT, LONGEST, MOST_BITS = 1_500_000, 4_000_000, 5, 28
HASH_BITS, RANGE_BITS = 32, 20
SPACE, END = 1, 2
#: What a byte is to the splitter: a space between words, the end of a piece, or part of a word.
KIND = np.zeros(256, np.uint8)
KIND[list(b" \t")] = SPACE
KIND[list(b".,;:!?\n\x0b\x0c\r")] = END
LOWER = np.frombuffer(ASCII_LOWER, np.uint8)
COUNTS = "lang string, phrase string, words int, n bigint"
HASHED = "part bigint, steps binary, counts binary"


def segments(text: np.ndarray, size: int = SEGMENT) -> Iterator[np.ndarray]:
    """A text's bytes, cut between words."""
    at = 0
    while len(text) - at > size:
        cuts, stop = np.flatnonzero(KIND[text[at : at + size]]), at + size
        if len(cuts):
            stop = at + int(cuts[-1]) + 1
        while not len(cuts) and stop < len(text):  # one word, longer than a segment
            cuts = np.flatnonzero(KIND[text[stop : stop + size]])
            stop = stop + int(cuts[0]) + 1 if len(cuts) else min(stop + size, len(text))
        yield text[at:stop]
        at = stop
    yield text[at:]


def words(segment: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """Bytes of the segment's words, one after the other; their lengths; whether a piece ends before each; and whether one
    ends after the last."""
    kind = KIND[segment]
    inside = kind == 0
    edge = np.diff(inside.astype(np.int8), prepend=0)
    starts = np.flatnonzero(edge == 1)
    ends = np.flatnonzero(edge == -1)
    if len(ends) < len(starts):
        ends = np.append(ends, len(segment))
    piece = np.cumsum(kind == END, dtype=np.int32)
    at = piece[starts] if len(starts) else np.zeros(0, np.int32)
    before = np.diff(at, prepend=0) > 0
    after = bool(len(segment)) and bool(piece[-1] > (at[-1] if len(at) else 0))
    return LOWER[segment[inside]], ends - starts, before, after


class Shard:
    """Words of many texts: bytes, lengths, language, whether a word goes on the piece of the word before it, and whether
    phrases that begin at it are counted here."""

    def __init__(self):
        self.langs: dict[str, int] = {}
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.n = 0

    def add(self, lang: str, data: np.ndarray, sizes: np.ndarray, joined: np.ndarray, own: np.ndarray) -> None:
        code = self.langs.setdefault(lang, len(self.langs))
        self.parts.append((data, sizes.astype(np.int32), np.full(len(sizes), code, np.int64), joined, own))
        self.n += len(sizes)


def read(text: np.ndarray, segment: int = SEGMENT) -> Iterator[tuple[np.ndarray, ...]]:
    """A text's (bytes, lengths, joined, own), segment by segment. The last words before a cut are seen by their segment
    (own = False there) and come again with the next one, where the phrases that begin at them are counted."""
    carried, broken = None, True
    parts = segments(text, segment)
    part = next(parts)
    while part is not None:
        following = next(parts, None)
        data, sizes, before, after = words(part)
        joined = ~before
        if len(sizes):
            joined[0] &= not broken
            broken = after
        else:
            broken = broken or after
        if carried is not None:
            data, sizes, joined = (np.concatenate(x) for x in zip(carried, (data, sizes, joined), strict=True))
            carried = None
        own = np.ones(len(sizes), bool)
        if following is not None and len(sizes):
            keep = min(LONGEST - 1, len(sizes))
            own[-keep:] = False
            again = joined[-keep:].copy()
            again[0] = False
            carried = (data[len(data) - int(sizes[-keep:].sum()) :], sizes[-keep:], again)
        if len(sizes):
            yield data, sizes, joined, own
        part = following


def shards(batches: Iterator[pa.RecordBatch], size: int = SHARD, segment: int = SEGMENT) -> Iterator[Shard]:
    """Batches (text, lang) -> shards of some `size` words."""
    shard = Shard()
    for batch in batches:
        texts = batch.column(0).cast(pa.binary())
        for i, lang in enumerate(batch.column(1).to_pylist()):
            if not texts[i].is_valid:
                continue
            for part in read(np.frombuffer(texts[i].as_buffer(), np.uint8), segment):
                shard.add(lang, *part)
                if shard.n >= size:
                    yield shard
                    shard = Shard()
    if shard.n:
        yield shard


class Bitmap:
    """Which hashes may be of frequent words or pairs: one bit for each value of their first `power` bits."""

    def __init__(self, power: int, rows: list[tuple[int, bytes]]):
        self.power, self.bits = power, np.zeros(1 << power - 3, np.uint8)
        for bucket, bits in rows:
            at = (bucket - 1) * 4096
            self.bits[at : at + 4096] = np.frombuffer(bits, np.uint8)[: len(self.bits) - at]

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = place(hashes, self.power)
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def place(hashes: np.ndarray, power: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - power)).astype(np.int64)


def word_hash(lang: str, word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, xxhash.xxh64_intdigest(lang))


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a * np.uint64(0x9E3779B97F4A7C15) ^ b) * np.uint64(0xC2B2AE3D27D4EB4F)
    return (h ^ h >> np.uint64(29)) * np.uint64(0x9FB21C651E98DF25)


def doubled(rank: np.ndarray, step: int, reach: np.ndarray) -> np.ndarray:
    """Ranks (from 1) of 2 * step words from ranks of step words; 0 follows where fewer words do."""
    then = np.zeros(len(rank), np.int64)
    more = max(0, len(rank) - step)
    then[:more] = np.where(reach[:more], rank[step:], 0)
    return np.unique(rank * (int(rank.max()) + 1) + then, return_inverse=True)[1] + 1


def reaches(joined: np.ndarray, most: int) -> list[np.ndarray]:
    """reaches()[d]: whether d words more follow a word in its piece."""
    on = np.append(joined[1:], False)
    out = [np.ones(len(joined), bool)]
    for d in range(1, most):
        then = np.zeros(len(joined), bool)
        then[: max(0, len(on) - d + 1)] = on[d - 1 :]
        out.append(out[-1] & then)
    return out


def intervals(words_: np.ndarray, joined: np.ndarray, own: np.ndarray, least: int, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each n from least to most: where one of each distinct n-gram begins, and how many of them begin at own words."""
    reach = reaches(joined, 2 * most)
    rank, step = np.unique(words_, return_inverse=True)[1] + 1, 1
    first = rank
    while step < most:
        rank, step = doubled(rank, step, reach[step]), 2 * step
    order = np.argsort(rank, kind="stable")
    common, alive = np.zeros(len(order), np.int8), np.ones(len(order) - 1, bool)
    for d in range(most):
        there = reach[d][order]
        alive &= there[1:] & there[:-1]
        alive[alive] = first[order[1:][alive] + d] == first[order[:-1][alive] + d]
        common[1:] += alive
    for n in range(least, most + 1):
        there = reach[n - 1][order]
        begins = np.flatnonzero(there & (common < n))
        if len(begins):
            yield n, order[begins], np.add.reduceat((there & own[order]).astype(np.int64), begins)


class Coded:
    """A shard's words as numbers of (language, word), without those that can't be in a frequent phrase."""

    def __init__(self, shard: Shard, frequent: list[Bitmap]):
        data, sizes, lang, joined, own = (np.concatenate(x) for x in zip(*shard.parts, strict=True))
        shard.parts.clear()
        ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(data)]).dictionary_encode()
        texts = coded.dictionary
        kinds, word = np.unique(lang * len(texts) + coded.indices.to_numpy(), return_inverse=True)
        kind_lang, kind_text = kinds // len(texts), kinds % len(texts)
        del data, coded, lang
        names = list(shard.langs)
        if frequent:
            seeds = [xxhash.xxh64_intdigest(x) for x in names]
            raw = texts.to_pylist()
            self.hashes = hashes = np.array([xxhash.xxh64_intdigest(raw[t], seeds[c]) for c, t in zip(kind_lang.tolist(), kind_text.tolist(), strict=True)], np.uint64)
            keep = frequent[0].has(hashes)[word]
            joined[1:] &= keep[:-1]
            word, joined, own = word[keep], joined[keep], own[keep]
            if len(frequent) > 1 and len(word):
                h = hashes[word]
                joined[1:] &= frequent[1].has(pair_hash(h[:-1], h[1:]))
                keep = joined | np.append(joined[1:], False)
                word, joined, own = word[keep], joined[keep], own[keep]
        joined[:1] = False
        self.word, self.joined, self.own = word, joined, own
        self.texts, self.names, self.kind_lang, self.kind_text = texts, names, kind_lang, kind_text

    def intervals(self, least: int, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        if len(self.word):
            for n, begin, count in intervals(self.word, self.joined, self.own, least, most):
                yield n, begin[count > 0], count[count > 0]


def counted(shard: Shard, least: int, most: int, frequent: list[Bitmap]) -> Iterator[pa.RecordBatch]:
    """The shard's n-grams of least to most words with their counts."""
    c = Coded(shard, frequent)
    texts, lang_names = c.texts.cast(pa.string()), pa.array(c.names, pa.string())
    for n, begin, count in c.intervals(least, most):
        for a in range(0, len(begin), 200_000):
            at = begin[a : a + 200_000]
            each = [texts.take(pa.array(c.kind_text[c.word[at + d]])) for d in range(n)]
            phrase = pc.binary_join_element_wise(*each, " ") if n > 1 else each[0]
            yield pa.RecordBatch.from_arrays([lang_names.take(pa.array(c.kind_lang[c.word[at]])), phrase, pa.array(np.full(len(at), n, np.int32)), pa.array(count[a : a + 200_000])], ["lang", "phrase", "words", "n"])


def planes(numbers: np.ndarray) -> bytes:
    """Numbers below 2 ** 32 as their lowest bytes, then their second ones, and so on: zeros lie together."""
    return numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def of_planes(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)


def paired(shard: Shard, frequent: list[Bitmap], bits: int) -> Iterator[pa.RecordBatch]:
    """How often the first `bits` bits of its pairs' hashes occur in the shard: a row for each range of them, with each one's
    distance from the one before it (the first's from where the range begins) and its count."""
    c = Coded(shard, frequent)
    for _, begin, count in c.intervals(2, 2):
        key = place(pair_hash(c.hashes[c.word[begin]], c.hashes[c.word[begin + 1]]), bits)
        order = np.argsort(key)
        key, count = key[order], count[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        if not len(first):
            continue
        key, count = key[first], np.add.reduceat(count, first)
        part = key >> RANGE_BITS
        cuts = np.flatnonzero(np.diff(part, prepend=-1))
        step = np.diff(key, prepend=0)
        step[cuts] = key[cuts] - (part[cuts] << RANGE_BITS)
        runs = list(zip(cuts.tolist(), [*cuts[1:].tolist(), len(key)], strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(part[cuts]), pa.array([planes(step[i:j]) for i, j in runs], pa.binary()), pa.array([planes(count[i:j]) for i, j in runs], pa.binary())], ["part", "steps", "counts"])


def _merged(source: DataFrame, least: int, most: int, frequent: list, shard: int, segment: int) -> DataFrame:
    """(lang, phrase, words, n) over all shards."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps = [b.value for b in frequent]
        for s in shards(batches, shard, segment):
            yield from counted(s, least, most, maps)

    return source.mapInArrow(count, COUNTS).groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n"))


def _power(n: int) -> int:
    return min(MOST_BITS, max(16, (16 * n).bit_length()))


def _bitmap(at: DataFrame, power: int):
    """A broadcast Bitmap of places (at, from 0)."""
    at = at.select((F.col("at") + 1).alias("at"))
    bits = at.groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    return at.sparkSession.sparkContext.broadcast(Bitmap(power, [(r.bucket, bytes(r.bits)) for r in bits.collect()]))  # 8,192 rows of 4 kB at most


def word_bitmap(frequent: DataFrame, n: int):
    """A broadcast Bitmap of n words (lang, phrase), of 16 to 32 bits for each of them, 2 ** MOST_BITS at most."""
    power = _power(n)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                each = [word_hash(lang, w.encode()) for lang, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(place(np.array(each, np.uint64), power))], ["at"])

    return _bitmap(frequent.select("lang", "phrase").mapInArrow(places, "at bigint"), power)


def pair_bitmap(source: DataFrame, words_: list, n: int, least: int, shard: int, segment: int, stash: Stash):
    """A broadcast Bitmap of hashes of pairs that occur `least` times or more; n words are in words_ (its one Bitmap), repeats
    included, so there are no more pairs than that."""
    bits = min(HASH_BITS, max(RANGE_BITS, (16 * n).bit_length()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps = [b.value for b in words_]
        for s in shards(batches, shard, segment):
            yield from paired(s, maps, bits)

    def enough(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(1 << RANGE_BITS, np.int64)
        for b in batches:
            for steps, counts in zip(b.column(1), b.column(2), strict=True):
                sums[np.cumsum(of_planes(steps.as_py()))] += of_planes(counts.as_py())
        yield pa.RecordBatch.from_arrays([pa.array((key[0].as_py() << RANGE_BITS) + np.flatnonzero(sums >= least))], ["hash"])

    hashes = stash.put(source.mapInArrow(count, HASHED).groupBy("part").applyInArrow(enough, "hash bigint"))
    power = min(bits, _power(hashes.count()))
    out = _bitmap(hashes.select(F.shiftright("hash", bits - power).alias("at")), power)
    stash.drop(hashes)
    return out


def _looked_up(rows: DataFrame, key: str, counts: DataFrame, out: str) -> DataFrame:
    """rows with the count of the phrase that they name by (lang, key); phrases that many rows name are broadcast."""
    uses = rows.groupBy("lang", key).agg(F.count("*").alias("_uses"))
    named = counts.select("lang", F.col("phrase").alias(key), F.col("n").alias(out)).join(uses, ["lang", key])
    joint = F.concat_ws("\n", "lang", key)  # a phrase has no line feed
    return join_counted(rows.withColumn("_key", joint), named.select(joint.alias("_key"), out, "_uses"), "_key", "_uses", rows.count()).drop("_key", "_uses")


SCORE = "cast(1000 as decimal(4,0)) * cast(a as decimal(16,0)) * cast(n as decimal(16,0)) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))"


def scored(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """counts (lang, phrase, words, n, all parts of a phrase included), totals (lang, n) -> each phrase of two words or more
    with the cut of lowest score: lang, phrase, words, a, l, r, n, score."""
    parts = F.split("phrase", " ")
    cuts = counts.filter("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.withColumns({"_first": F.array_join(F.slice(parts, 1, F.col("k")), " "), "_rest": F.array_join(F.slice(parts, F.col("k") + 1, F.col("words") - F.col("k")), " ")})
    both = _looked_up(_looked_up(cuts, "_first", counts, "l"), "_rest", counts, "r")
    lowest = both.join(totals, "lang")
    best = lowest.withColumn("score", F.expr(SCORE)).groupBy("lang", "phrase", "words", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("_m"))
    return best.select("lang", "phrase", "words", "a", "_m.l", "_m.r", "n", "_m.score")


def absorbed(phrases: DataFrame, percent: int = 100) -> DataFrame:
    """phrases without those that lie in a longer one with at least `percent` of their count. A longer phrase counts no more
    often than what it holds, so it is enough to look at phrases of one word more."""
    parts, n = F.split("phrase", " "), F.col("words") - 1
    inner = phrases.filter("words > 2").select("lang", F.explode(F.array_distinct(F.array(F.array_join(F.slice(parts, 1, n), " "), F.array_join(F.slice(parts, 2, n), " ")))).alias("phrase"), F.col("a").alias("_a"))
    longer = inner.groupBy("lang", "phrase").agg(F.max("_a").alias("_longer"))
    return phrases.join(longer, ["lang", "phrase"], "left").filter(F.col("_longer").isNull() | (100 * F.col("_longer") < percent * F.col("a"))).drop("_longer")


def count_phrases(docs: DataFrame, least: int, shard: int = SHARD, segment: int = SEGMENT) -> tuple[DataFrame, DataFrame]:
    """(counts, totals): phrases of 1 to LONGEST words that occur `least` times or more in their language, and the words of
    each language."""
    stash = Stash(docs.sparkSession)
    source = docs.select(F.col("text").cast("string").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    every = stash.put(_merged(source, 1, 1, [], shard, segment))
    totals = stash.put(every.groupBy("lang").agg(F.sum("n").alias("n")))
    enough = F.col("n") >= least
    single = stash.put(every.filter(enough))
    stash.drop(every)
    kinds, n = single.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    maps = [word_bitmap(single, kinds)]
    maps.append(pair_bitmap(source, maps, n, least, shard, segment, stash))
    longer = stash.put(_merged(source, 2, LONGEST, maps, shard, segment).filter(enough))
    return single.unionByName(longer), totals


def collocations(docs: DataFrame, least: int = 100, percent: int = 100, top: int = 2000, **sizes) -> DataFrame:
    """The `top` phrases of each language by score: lang, rank, phrase, a, l, r, n, score."""
    counts, totals = count_phrases(docs, least, **sizes)
    kept = absorbed(scored(counts, totals), percent)
    w = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = kept.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
    return best.select("lang", *(F.col(c).cast("long").alias(c) if c != "phrase" else F.col(c) for c in ("rank", "phrase", "a", "l", "r", "n", "score")))
