"""Every training-data operator beside SQL, a brute-force version, an exact round trip or held-out accuracy."""

import base64
import hashlib
import math
import os
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
import xxhash
from pyspark.sql import functions as F

from tests.compare import database, spark_rows, sql_rows
from tests.llm.conftest import SF, TEXTS
from tidewater.llm import avi, bpe, common, langid, lm_scoring, mixing, queries, sharding, simhash, token_counts, topk, toxicity
from tidewater.llm.common import sampled

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def words(text):
    return regex.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    assert spark_rows(queries.queries()[name](spark, SF)) == sql_rows(database(SF), queries.oracle_sql()[name])


def brute_lm(rows):
    toks = [(i, words(t)) for i, t in rows]
    uni, bi = Counter(w for _, ws in toks for w in ws), Counter(p for _, ws in toks for p in zip(ws, ws[1:]))
    total, out = sum(uni.values()), defaultdict(lambda: [0, 0, 0.0])
    for i, ws in toks:
        o = out[i]
        o[0] += len(ws)
        o[2] += math.log(uni[ws[0]] / total) if ws else 0
        for (v, w), n in Counter(zip(ws, ws[1:])).items():
            left = bi[v, w] - n
            o[1] += n if left > 0 else 0
            o[2] += n * (math.log(left / uni[v]) if left > 0 else math.log(0.4 * uni[w] / total))
    return out


@pytest.mark.parametrize("bounds", [{}, {"common": 40, "hot": 50}, {"common": 3, "hot": 1}])
@pytest.mark.parametrize("which", ["documents", "hard"])
def test_lm_scores(request, which, bounds):
    docs = request.getfixturevalue(which)
    want = brute_lm([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    got = {r.doc_id: r for r in lm_scoring.score_documents(docs, **bounds).collect()}
    assert got.keys() == want.keys()
    for i, (n, seen, s) in want.items():
        assert (got[i].n_tokens, got[i].n_seen) == (n, seen)
        assert got[i].log_score == pytest.approx(s, rel=1e-9, abs=1e-6)


def brute_tokens(text, scores, cut):
    tokens = total = 0
    for w in cut.findall(text or ""):
        b = w.encode()
        best = [(0, 0)] + [None] * len(b)
        for j in range(1, len(b) + 1):
            best[j] = max((best[i][0] + scores[b[i:j]], best[i][1] - 1) for i in range(j) if b[i:j] in scores)
        total, tokens = total + best[-1][0], tokens - best[-1][1]
    return tokens, total


def test_token_counts(hard):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    scores, cut = token_counts.piece_scores(token_counts.read_ranks(path)), regex.compile(public_tokenizers.PATTERN)
    for nodes in (1_500_000, 3):
        got = token_counts.count_tokens(hard, path, public_tokenizers.PATTERN, max_nodes=nodes).collect()
        want = [brute_tokens(r.text, scores, cut) for r in hard.select("text").collect()]
        assert [(r.n_tokens, r.score) for r in got] == want


def brute_fingerprint(text):
    ws = words(text)
    hs = [xxhash.xxh64_intdigest(" ".join(ws[i : i + 3]).encode(), 42) for i in range(max(1, len(ws) - 2))] if ws else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_classes(rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)] += [] if d is None else [d]
    return sorted((str(d), f"{fps[i]:016x}", min(least[find(i)], default=None)) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("which", ["documents", "hard"])
@pytest.mark.parametrize("max_block", [64, 2])
def test_near_duplicates(request, which, max_block):
    docs = request.getfixturevalue(which)
    got = simhash.near_duplicates(docs, max_block=max_block).collect()
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got) == brute_classes([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


@pytest.mark.parametrize("max_block", [64, 1])
def test_close_pairs_connect_all_pairs_within_two_bits(spark, max_block):
    from tidewater.llm.common import Stash
    from tidewater.llm.graph import components

    rng, fps = np.random.default_rng(3), set()
    for base in rng.integers(-(2**63), 2**63, 12).tolist():
        for _ in range(25):
            x = base & (2**64 - 1)
            for b in rng.integers(0, 64, rng.integers(0, 5)).tolist():
                x ^= 1 << b
            fps.add(x - 2**64 * (x >> 63))
    fps, stash = sorted(fps), Stash(spark)
    got = {r.node: r.root for r in components(simhash.close_pairs(spark.createDataFrame([(f,) for f in fps], "fp long"), stash, max_block), stash).collect()}
    group = {f: f for f in fps}
    for _ in fps:
        for a in fps:
            group[a] = min(group[b] for b in fps if ((a ^ b) & (2**64 - 1)).bit_count() <= 2)
        if all(group[a] == group[b] for a in fps for b in fps if ((a ^ b) & (2**64 - 1)).bit_count() <= 2):
            break
    assert {f: got.get(f, f) for f in fps} == group


def test_toxicity_on_held_out_rows(spark):
    """Some 330 toxic rows to learn from, and some labels that the text doesn't bear out."""
    at = "/root/testdata/sf0.1"
    marks = spark.read.parquet(f"{at}/labels.parquet").select("doc_id", "toxic")
    got = queries.op4_toxicity(spark, at).filter("held_out").join(marks, "doc_id").select("toxic", "score", "predicted").collect()
    toxic, clean = (np.array([r.score for r in got if r.toxic == y]) for y in (1, 0))
    assert ((toxic[:, None] > clean).mean() + (toxic[:, None] == clean).mean() / 2) >= 0.8
    assert (clean >= 0.3).mean() <= 0.05
    assert {(r.score >= 0.3, r.predicted) for r in got} == {(True, 1), (False, 0)}


def test_toxicity_needs_no_labels(spark, hard):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert [(r.score, r.predicted) for r in toxicity.score_documents(hard, labels).collect()] == [(0.0, 0)] * hard.count()
    some = spark.createDataFrame([(4, 1), (5, 1), (6, 0), (8, 0), (9, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    assert all(0 <= r.score <= 1 for r in toxicity.score_documents(hard, some).collect())


def test_top_k(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(0, 0.3, (400, 6))
    v[200:230] = v[0]
    rows = [(i // 2 if i > 390 else i, v[i].tolist(), i) for i in range(400)] + [(900, None, 0), (901, [], 0), (902, [0.1] * 5 + [None], 0), (950, [float("nan")] * 6, 0), (1000, [float("inf")] * 6, 0), (None, [0.0] * 6, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, row int")
    got = topk.top_k(df, F.col("vec_id") % 50 == 0, n_floor=8, cell_rows=30, group_rows=3).collect()
    ids, ints = np.array([r[0] for r in rows[:400]]), np.floor(256 * v).astype(np.int64)
    want = []
    for q in np.flatnonzero(ids % 50 == 0).tolist():
        best = sorted((-int(ints[q] @ ints[c]), int(ids[c])) for c in range(400) if c != q)[:5]
        want += [(int(ids[q]), k, i, -s) for k, (s, i) in enumerate(best, 1)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert topk.top_k(df.limit(0), F.lit(True)).collect() == []
    assert len(topk.top_k(df.limit(3), F.lit(True)).collect()) == 6


def assert_near_targets(rows):
    taken, target, largest = Counter(), {}, Counter()
    for r in rows:
        taken[r.source] += r.taken
        target[r.source] = r.target
        largest[r.source] = max(largest[r.source], r.size)
        assert r.taken <= 2 * r.size
    assert all(abs(taken[s] - t) <= largest[s] for s, t in target.items())


def test_mixing(documents, hard, empty):
    for docs in (documents, hard):
        got = mixing.mix(docs).collect()
        assert sorted(r.size for r in got) == sorted(len(words(r.text)) for r in docs.select("text").collect())
        assert_near_targets(got)
    assert mixing.mix(empty).collect() == []


def test_mixing_draws_rows_without_ids_one_by_one(spark):
    """Null ids, one id for many texts, and rows that are equal throughout; in any order of the rows."""
    rows = [(None, f"word{i} two three four five", "ab"[i % 2]) for i in range(40)] + [(7, f"six seven {i}", "c") for i in range(40)] + [(8, "nine ten", "d")] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    assert_near_targets(got)
    plain = lambda rs: sorted((str(r.doc_id), str(r.source), r.size, r.copies) for r in rs)
    assert plain(got) == plain(mixing.mix(df.orderBy(F.rand(3)).repartition(5)).collect())


def test_sharding(documents, hard, empty):
    for docs in (documents, hard):
        got = sharding.assign_shards(docs, 8).collect()
        rows = docs.select("doc_id", "text").collect()
        assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted((str(r.doc_id), len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in rows)
        for s in {r.shard for r in got}:
            slots = sorted(r.slot for r in got if r.shard == s)
            assert 0 <= s < 8 and slots == list(range(len(slots)))
    total = Counter()
    for r in (got := sharding.assign_shards(documents, 8).collect()):
        total[r.shard] += r.size
    largest = max(r.size for r in got)
    assert max(total.values()) - min(total[s] for s in range(8)) <= max(2 * largest, 0.05 * sum(total.values()) / 8)
    where = defaultdict(set)
    for r in got:
        where[r.size, r.text_crc32].add(r.shard)
    assert max(map(len, where.values())) == 1  # equal texts lie together
    assert sharding.assign_shards(empty, 8).collect() == []


def test_sharding_of_copies(spark):
    """A text with a third of all rows, the rows themselves equal too, is the only one that is divided."""
    rows = [(1, "the same words over and over " * 4, "a", "en")] * 300 + [(i, f"text {i} " * (1 + i % 40), "abc"[i % 3], "en") for i in range(600)]
    got = sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").repartition(7), 8).collect()
    total, where = Counter(), defaultdict(set)
    for r in got:
        total[r.shard] += r.size
        where[r.text_crc32].add(r.shard)
    assert len(where.pop(zlib.crc32(rows[0][1].encode()))) > 1
    assert max(map(len, where.values())) == 1
    assert max(total.values()) - min(total.values()) <= 0.05 * sum(total.values()) / 8
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_sharding_beside_a_plain_tree(spark, documents):
    """The same tree in plain Python: sort a node along its widest dimension, cut where the bytes come nearest the goal; an
    item on the cut that would leave the sides uneven goes to the left."""
    from tidewater.llm.common import Stash

    text = F.coalesce("text", F.lit(""))
    slim = documents.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.xxhash64("text", F.lit(7)).alias("t1"), F.xxhash64(F.md5(text)).alias("t2"), "source", "lang")
    rows, items, _ = sharding._items(slim, 8, Stash(spark))
    low = F.pmod(F.xxhash64("item", F.lit(3)), F.lit(1 << 31)).alias("low")
    leaves, todo = {}, [(items.select("*", low).collect(), 0, 8)]
    while todo:
        part, a, b = todo.pop()
        if b - a == 1:
            leaves |= {r["item"]: a for r in part}
            continue
        span = lambda d, part=part: max(r[d] for r in part) - min(r[d] for r in part)
        wide = max(sharding.DIMS, key=lambda d: (span(d), -sharding.DIMS.index(d)))
        part.sort(key=lambda r: min(int(r[wide] * 2**31), 2**31 - 1) << 31 | r["low"])
        m, whole = (b - a) // 2, sum(r["bytes"] for r in part)
        goal, left, rest = whole * m / (b - a), [], part
        while True:
            upto = np.cumsum([0] + [r["bytes"] for r in rest])
            at = min(int(np.argmax(upto[1:] > goal)) if (upto[1:] > goal).any() else len(rest) - 1, len(rest) - 1)  # the item on the cut
            here, under, over = rest[at]["bytes"], goal - upto[at], upto[at + 1] - goal
            if min(under, over) <= sharding.UNEVEN * whole or here > goal or len(left) == 16:
                break
            left, rest, goal = [*left, rest[at]], rest[:at] + rest[at + 1 :], goal - here
        cut = at if under <= over else at + 1
        todo += [(left + rest[:cut], a, a + m), (rest[cut:], a + m, b)]
    item_of = {r.doc_id: r["item"] for r in rows.select("doc_id", "item").collect()}
    assert {r.doc_id: r.shard for r in sharding.assign_shards(documents, 8).collect()} == {d: leaves[i] for d, i in item_of.items()}


def test_language_on_held_out_rows(spark, hard):
    at = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "lang").collect()}
    got = [r for r in queries.op8_langid(spark, at).collect() if r.held_out and r.lang_pred != "und" and truth[r.doc_id]]
    assert sum(r.lang_pred == truth[r.doc_id] for r in got) >= 0.95 * len(got)
    for r in langid.identify_documents(hard).join(hard.select("doc_id", "text"), "doc_id").collect():
        assert 0 <= r.score <= 1 and (r.lang_pred == "und" or any(map(str.isalpha, r.text)))
    assert {r.lang_pred for r in langid.identify_documents(hard.filter("lang is null")).collect()} == {"und"}


def library(path):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=token_counts.read_ranks(path), special_tokens={})


def test_bpe(documents, hard):
    coder = library(RANKS)
    for docs in (hard, documents):
        got = bpe.encode_documents(docs, RANKS, public_tokenizers.PATTERN).collect()
        for r, d in zip(got, docs.select("text").collect(), strict=True):
            ids = coder.encode_ordinary(d.text or "")
            assert (r.n_tokens, r.ids) == (len(ids), ",".join(map(str, ids)))
            assert bytes(r.decoded).decode() == (d.text or "")


def test_bpe_of_long_pretokens():
    with open(RANKS, "rb") as f:
        codec = bpe.Codec(f.read())
    coder = library(RANKS)
    for w in ("ab" * 190, "banana" * 100, "x" * 5000, "東京都" * 300):
        codec.learn([w])
        assert codec.known[w][0] == ",".join(map(str, coder.encode_ordinary(w)))


def test_avi(hard):
    media = {str(r.doc_id): bytes(r.media) for r in avi.media_column(hard.dropDuplicates(["doc_id"])).collect()}
    for r in avi.inspect_documents(hard).join(hard.select("doc_id", "text").distinct(), "doc_id").filter("doc_id is not null").collect():
        t = (r.text or "").encode()
        want = t + b" " * (-len(t) % 192 if t else 192)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(t), len(want), hashlib.sha256(want).hexdigest())
        assert r.tail_crc32 == zlib.crc32(want[-16:])
        assert (r.media_bytes, r.media_sha256) == (len(media[str(r.doc_id)]), hashlib.sha256(media[str(r.doc_id)]).hexdigest())
    clips = avi.clip_rows(avi.media_column(hard)).filter(f"doc_id = {TEXTS.index(TEXTS[6])}").orderBy("clip").collect()
    assert clips[0].first_frame == 0 and all(a.end_frame == b.first_frame for a, b in zip(clips, clips[1:]))


def test_avi_cuts_where_the_picture_changes():
    dark, light = bytes([10]) * 192, bytes([200]) * 192
    frames, fps = avi.decode_frames(avi.write_avi(dark * 12 + light * 12))
    assert [(a, b) for a, b, _, _ in avi.shots(frames, fps)] == [(0, 12), (12, 24)]


def test_every_operator_takes_an_empty_table(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    for df in (lm_scoring.score_documents(empty), token_counts.count_tokens(empty, RANKS, public_tokenizers.PATTERN), simhash.near_duplicates(empty), toxicity.score_documents(empty, labels), langid.identify_documents(empty), bpe.encode_documents(empty, RANKS, public_tokenizers.PATTERN), avi.inspect_documents(empty)):
        assert df.collect() == []


def test_bounded_samples_keep_every_class(spark):
    """Rows lie in files by class, the first text alone is over the bound, and only later ones would fit."""
    letters = ["abc ", "def ", "ghi "]
    rows = [(0, letters[0] * 3000, "l0", 0)]
    rows += [(i, f"{letters[i // 200]}{i} " * 5, f"l{i // 200}", int(i >= 400)) for i in range(1, 600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int").coalesce(1)
    model = langid.fit(docs, max_bytes=6000)
    assert model.langs == ("l0", "l1", "l2")
    assert [x for x, _ in langid.predict(model, [x * 9 for x in letters])] == ["l0", "l1", "l2"]
    toxic = toxicity.fit(docs, docs.select("doc_id", "toxic"), max_bytes=6000)
    assert toxic is not None and toxic == toxicity.fit(docs.orderBy(F.desc("doc_id")), docs.select("doc_id", "toxic"), max_bytes=6000)
    assert langid.fit(docs, max_bytes=3).langs == ("l0", "l1", "l2")  # no row fits: the shortest of each
    nameless = docs.filter("doc_id > 0").withColumn("doc_id", F.lit(None).cast("long"))
    assert langid.fit(nameless, per_lang=1).langs == ("l0", "l1", "l2")


def test_even_share():
    from tidewater.llm.common import even_share

    assert even_share([5, 5], 10) is None
    assert even_share([2, 100, 100], 20) == 9
    assert even_share([30, 30, 30], 30) == 10


def test_bpe_of_many_wide_pretokens():
    """Over 500 MB of rounds if all of them were merged at once."""
    with open(RANKS, "rb") as f:
        codec = bpe.Codec(f.read())
    coder, rng = library(RANKS), np.random.default_rng(4)
    many = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 390)) for _ in range(1500)]
    codec.learn(many)
    assert all(codec.known[w][0] == ",".join(map(str, coder.encode_ordinary(w))) for w in many)


def test_token_counts_of_long_pretokens(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    scores = token_counts.piece_scores(token_counts.read_ranks(path))
    trie, rng = token_counts.PrefixTrie(scores), np.random.default_rng(6)
    for n in (1, 1023, 1024, 1025, 3000):
        w = "".join(rng.choice(list("abcdefgh"), n))
        assert (-trie.insert(w.encode())[1], trie.insert(w.encode())[0]) == brute_tokens(w, scores, regex.compile(r"\w+"))
    before = len(trie.fwd)
    trie.insert(b"".join(rng.choice([b"a", b"b", b"c"], 200_000)))
    assert len(trie.fwd) <= before + token_counts.LONG
    docs = spark.createDataFrame([(1, "x" * 50_000 + " " + "yz" * 20_000)], "doc_id long, text string")
    assert token_counts.count_tokens(docs, path, public_tokenizers.PATTERN).first().n_pretokens == 2


def test_toxicity_beside_a_plain_version(spark, documents, hard):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(documents, labels)
    assert model.toxic != model.ordinary and len(model.toxic) == len(model.ordinary)
    judge = toxicity._compressor
    for docs in (documents, hard):
        score = toxicity.scorer(spark, model)
        for r in docs.select("text", score("text").alias("t")).collect():
            gains = [len(judge(model.ordinary).compress(w)) - len(judge(model.toxic).compress(w)) for w in toxicity.windows(r.text or "")] if r.text else []
            gains, n = [g for g in gains if g > 1], len(gains)
            x = toxicity.features(max(gains, default=0), sum(gains), n)
            s = 1 / (1 + math.exp(-sum(a * b for a, b in zip(x, model.weights))))
            assert (r.t.windows, r.t.gain, r.t.predicted) == (n, max(gains, default=0), int(r.t.score >= 0.3))
            assert r.t.score == pytest.approx(s, abs=1e-9)
            if n > 400:
                break


def plain_language(model, text):
    """Naive Bayes, one n-gram at a time."""
    text = f" {text.lower()} "
    sums = list(model.prior)
    for i in range(len(text)):
        h = 0
        for n, c in enumerate(text[i : i + 3]):
            h = (h * 31 + ord(c)) * int(langid.MULTIPLIERS[n]) % 2**32
            h ^= h >> 15
            for k in range(len(sums)):
                sums[k] += float(model.log_p[k, h % langid.BUCKETS])
    best = max(range(len(sums)), key=lambda k: (sums[k], -k))
    return model.langs[best], 1 / sum(math.exp(s - sums[best]) for s in sums)


def test_language_beside_a_plain_version(documents, monkeypatch):
    model = langid.fit(documents)
    texts = [r.text for r in documents.limit(20).collect()] + [None, "", "...", "a", "東京 x", "Straße İ"]
    for slices in (langid.LONG, 50):
        monkeypatch.setattr(langid, "LONG", slices)
        for (lang, score), t in zip(langid.predict(model, texts), texts, strict=True):
            if not t or not any(map(str.isalpha, t)):
                assert (lang, score) == ("und", 0.0)
            else:
                want = plain_language(model, t)
                assert lang == want[0] and score == pytest.approx(want[1], abs=1e-6)
    assert np.concatenate(list(langid.sliced("abc " * 1000, 7))).tolist() == langid.ngrams(["abc " * 1000])[0].tolist()


def test_avi_features_beside_a_plain_version(hard, documents, monkeypatch):
    monkeypatch.setattr(avi, "AT_ONCE", 3)
    for r in hard.select("text", avi.inspect(avi.to_avi("text")).alias("m")).union(documents.limit(20).select("text", avi.inspect(avi.to_avi("text")).alias("m"))).collect():
        pad = avi.payload_of((r.text or "").encode())
        hists = [Counter(b >> 4 for b in pad[i : i + 192]) for i in range(0, len(pad), 192)]
        d = [sum(abs(a[k] - b[k]) for k in range(16)) / 384 for a, b in zip(hists, hists[1:])]
        cuts = [0]
        for i, x in enumerate(d):
            last = d[max(0, i - 8) : i] or [0.0]
            mean = sum(last) / len(last)
            dev = math.sqrt(sum((y - mean) ** 2 for y in last) / len(last))
            if x > max(0.2, mean + 3 * dev) + 1e-12:
                cuts.append(i + 1)
        clips = [(a, b, a * 40, b * 40) for a, b in zip(cuts, [*cuts[1:], len(hists)])]
        timed = ";".join(f"{a}-{b}@{s}-{e}" for a, b, s, e in clips)
        assert r.m.feature == f"clips={len(clips)} longest={max(e - s for _, _, s, e in clips)}ms digest={zlib.crc32(timed.encode()):08x}"
        assert (r.m.payload_sha256, r.m.tail_crc32) == (hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-16:]))


def test_rows_of_one_key_are_numbered_without_gaps(spark):
    from tidewater.llm.common import Stash, numbered

    rows = Stash(spark).put(spark.range(500).select(F.when(F.col("id") % 5 > 0, F.lit("hot")).alias("k"), F.col("id").alias("_row")))
    got = defaultdict(list)
    for r in numbered(rows, ["k"], "i", 7).collect():
        got[r.k].append(r.i)
    assert {k: sorted(v) for k, v in got.items()} == {"hot": list(range(400)), None: list(range(100))}


def test_a_cluster_must_name_a_shared_folder(spark, monkeypatch):
    from types import SimpleNamespace

    from tidewater.llm.common import shared_dir

    lost = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(lost)
    assert shared_dir(spark)


@pytest.mark.parametrize("ids", [None, 4])
def test_fits_are_bounded_by_rows_not_by_ids(spark, documents, ids):
    """A shared id widens no class; repeated rows count once."""
    docs = documents.withColumn("doc_id", F.lit(ids).cast("long"))
    rows = docs.unionByName(docs).select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"), F.col("lang").alias("_lang"))
    taken = sampled(rows, "_lang", F.lit(5), 100)
    per = {r._lang: r["count"] for r in taken.groupBy("_lang").count().collect()}
    assert set(per) == {r.lang for r in documents.select("lang").distinct().collect()} and max(per.values()) < 25
    with pytest.raises(ValueError, match="over 2 different values"):
        sampled(rows, "_lang", F.lit(5), 2)


def test_many_languages_are_learnt(spark):
    rows = [(i * 4, chr(0x4E00 + i) * 9, f"x{i:03}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert len(langid.fit(docs).langs) == sum((zlib.crc32(str(i).encode()) % 4) != 2 for i, _, _ in rows)


def test_vectors_of_different_widths_are_an_error(spark):
    rows = [(i, [0.5] * (3 + i % 2)) for i in range(9)]
    with pytest.raises(ValueError, match="3 and of 4 components"):
        topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.lit(True))


def test_kept_pretokens_are_bounded_in_bytes():
    coder, long = bpe.Codec(open(RANKS, "rb").read()), "ab" * 50_000
    for i in range(6):
        used = {f"{i}-{j}{long}" for j in range(60)} | {"tide"}
        coder.learn(used)
        assert used <= coder.known.keys() and coder.held == sum(map(bpe.cost, coder.known))
        assert coder.held + sum(map(bpe.cost, coder.before)) <= bpe.CACHED + 2 * sum(map(bpe.cost, used))
    assert coder.before  # the older generation, of which what is used comes back
    again = set(list(coder.before)[:5])
    coder.learn(again)
    assert again <= coder.known.keys()


def test_a_kept_pretoken_takes_little_beside_itself():
    """90 bytes measured; with its decoded bytes and its number of ids, 196."""
    coder, rng = bpe.Codec(open(RANKS, "rb").read()), np.random.default_rng(9)
    words = {"".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 9)) for _ in range(20_000)}
    coder.learn(["tide"])
    tracemalloc.start()
    coder.learn(words)
    took = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert took < 130 * len(words)
    assert bpe.decoded(["a", "b", "ß"], {}) == "abß".encode() and bpe.decoded(["a", "b", "ß"], {"b": b"\xff"}) == b"a\xff\xc3\x9f"


def test_a_merge_round_keeps_lists_not_rows():
    """A round with a row for each token takes over 40 MB here."""
    coder, rng = bpe.Codec(open(RANKS, "rb").read()), np.random.default_rng(1)
    words = sorted({"".join(rng.choice(list("abcdefghij"), 100)) for _ in range(190)} | {"é" * 40, "東京" * 20})
    coder.con.execute("SET memory_limit = '30MB'")
    coder.learn(words)
    whole = library(RANKS)
    assert [coder.ids[w] for w in words] == [",".join(map(str, whole.encode_ordinary(w))) for w in words] and not coder.odd


def test_ids_decode_by_a_vocabulary_with_gaps():
    ranks = {bytes([i]): 2 * i for i in range(256)} | {b"ab": 900, b"abc": 1000}
    coder = bpe.Codec(b"\n".join(base64.b64encode(b) + b" %d" % r for b, r in ranks.items()))
    coder.learn(["abcab", "xé", "abc"])
    assert coder.ids == {"abcab": "1000,900", "xé": "240,390,338", "abc": "1000"} and not coder.odd
    decodes, at = coder._decode(np.array([900, 240, 1000]), np.array([0, 2, 2, 3]))
    assert (decodes, at.tolist()) == (b"abxabc", [0, 3, 3, 6])


def test_long_texts_are_encoded_bit_by_bit():
    coder, text = bpe.Codec(open(RANKS, "rb").read()), "naïve café 東京 🙂  it's 12345 tides\n\n" * 300
    for digest in (False, True):
        rows = next(bpe._each(iter([pa.array([text])]), open(RANKS, "rb").read(), public_tokenizers.PATTERN, digest)).to_pylist()[0]
        assert tuple(rows.values()) == bpe._long(text, coder, regex.compile(public_tokenizers.PATTERN), digest, at_once=7)


def test_a_batch_is_given_back_group_by_group(monkeypatch):
    monkeypatch.setattr(bpe, "AT_ONCE", 100)
    data, texts = open(RANKS, "rb").read(), [None, "", "naïve café 東京 🙂", *["tides rise and tides fall"] * 40, "harbour pilots " * 20]
    whole, checked = (list(bpe._each(iter([pa.array(texts), pa.array([], pa.string())]), data, public_tokenizers.PATTERN, False, *check)) for check in ((), (True,)))
    assert max(map(len, whole)) <= 6 and [len(a) for a in whole] == [len(a) for a in checked]
    rows = [r for a in whole for r in a.to_pylist()]
    assert [r["decoded"].decode() for r in rows] == [t or "" for t in texts]
    assert [r for a in checked for r in a.to_pylist()] == [{"ids": r["ids"], "n_tokens": r["n_tokens"], "round_trip": True} for r in rows]
    coder = bpe.codec(data)
    for cut, same in (("[a-z]+", False), (public_tokenizers.PATTERN, True)):
        for at_once in (1, 3, 1000):
            assert bpe._long("tides  rise", coder, regex.compile(cut), False, True, at_once)[2] is same
        assert bpe._rows(["tides  rise"], coder, regex.compile(cut), False, True)[0][2] is same


@pytest.mark.parametrize("size", [1, 5, 40, 10**6])
def test_fingerprints_in_slices(size):
    for t in [*TEXTS, "a bb ccc dddd " * 30]:
        b = None if t is None else t.encode()
        assert [x for s in simhash.shingle_hashes(b, size=size) for x in s] == [x for s in simhash.shingle_hashes(b) for x in s]


def test_ball_trees_of_several_levels(spark):
    """Clusters in clusters: the pairs left by descending both trees hold every pair of balls whose bound is high enough."""
    rng = np.random.default_rng(4)
    v = (rng.normal(size=(12, 1, 6)) * 900 + rng.normal(size=(12, 60, 6)) * 30).reshape(-1, 6).round().astype(int)
    df = spark.createDataFrame([(i, [float(x) / 256 for x in r]) for i, r in enumerate(v.tolist())], "vec_id long, embedding array<double>")
    got = topk.top_k(df, F.col("vec_id") % 4 == 0, n_floor=8, cell_rows=4, group_rows=4).collect()
    s = v @ v.T
    want = [(q, k + 1, i, int(s[q, i])) for q in range(0, len(v), 4) for k, i in enumerate(sorted((j for j in range(len(v)) if j != q), key=lambda j: (-s[q, j], j))[:5])]
    assert sorted(map(tuple, got)) == want
    plan = topk.top_k(df, F.col("vec_id") % 4 == 0, n_floor=8, cell_rows=4, group_rows=4)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_a_worker_keeps_one_thing_and_lets_it_go():
    data = open(RANKS, "rb").read()
    assert bpe.codec(data) is bpe.codec(data) and len(common._kept) == 1
    common.worker_keeps("other", list)
    assert list(common._kept) == ["other"]
    common.worker_lets_go()
    assert not common._kept


def test_a_stash_is_told_from_the_folders_of_a_factorisation(spark):
    stash = common.Stash(spark)
    for _ in range(9):
        stash.put(spark.range(1))
    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    assert not [f for f in os.listdir(shared) if f.startswith("tidewater-") and len(os.listdir(os.path.join(shared, f))) > 8]
    assert len([f for f in os.listdir(stash.root.removeprefix("file:")) if not f.startswith(".")]) == 9
