"""The Merkle manifest, phrase collocations and personal data beside brute-force versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.compare import spark_rows
from tidewater.llm import collocations, merkle, pii


def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def path(levels, i):
    out = []
    for row in levels[:-1]:
        a = i - i % 3
        out.append((row[a:i], row[i + 1 : a + 3]))
        i //= 3
    return out


def brute_manifest(rows):
    by = defaultdict(list)
    for r in rows:
        own, text = (lambda t, r=r: h([field(r.doc_id), field(r.source), field(r.lang), field(r.n_chars), field(t)])), r.text
        if r.doc_id is not None and text is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0:
            text = text.replace("\n", "")
        by[r.source].append(((r.doc_id is not None, r.doc_id or 0, own(r.text)), r.doc_id, own(r.text), own(text)))
    trees = {s: tree([x[2] for x in sorted(v)]) for s, v in by.items()}
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    top = tree([trees[s][-1][0] for s in names])
    out = []
    for s, v in by.items():
        for i, (_, doc_id, leaf, subject) in enumerate(sorted(v)):
            steps = path(trees[s], i) + path(top, names.index(s))
            for left, right in steps:
                subject = h([*left, subject, *right])
            out.append((doc_id, leaf, trees[s][-1][0], top[-1][0], h([x for left, right in steps for x in left + right]), subject, subject == top[-1][0]))
    return sorted(out, key=repr), sum(len(row) for t in trees.values() for row in t)


@pytest.mark.parametrize("per_block", [100_000, 3])
@pytest.mark.parametrize("which", ["some", "hard"])
def test_manifest(request, documents, which, per_block):
    docs = documents.filter("doc_id % 2 = 0") if which == "some" else request.getfixturevalue("hard").withColumn("n_chars", F.length("text"))
    want, n_nodes = brute_manifest(docs.collect())
    assert sorted(map(tuple, merkle.audit(docs, per_block).collect()), key=repr) == want
    nodes = merkle.node_records(docs, per_block)
    assert (nodes.count(), nodes.select("source", "level", "place").distinct().count()) == (n_nodes, n_nodes)


def test_one_source_over_many_merging_tasks(spark, documents):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("web").alias("source"), F.lit(None).cast("string").alias("lang"), F.lit(1).alias("n_chars"), F.concat(F.lit("a\nb"), "id").alias("text"))
    assert sorted(map(tuple, merkle.audit(docs, 4).collect()), key=repr) == brute_manifest(docs.collect())[0]  # 100 blocks: two merging rounds


def test_manifest_of_nothing(empty):
    assert merkle.audit(empty).count() == merkle.node_records(empty).count() == 0


def pieces(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def brute_collocations(rows, least, top):
    n, f = Counter(), defaultdict(Counter)
    for lang, text in rows:
        for ws in pieces(text):
            n[lang or "und"] += len(ws)
            for m in range(1, 6):
                f[lang or "und"].update(tuple(ws[i : i + m]) for i in range(len(ws) - m + 1))
    out = []
    for lang, c in f.items():
        held = {p: a for p, a in c.items() if a >= least and len(p) > 1}
        kept = []
        for p, a in held.items():
            if any(100 * b >= 100 * a for q, b in held.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))):
                continue
            score, k = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


@pytest.mark.parametrize("which, sizes", [("some", {}), ("some", {"shard": 300, "segment": 50}), ("hard", {}), ("hard", {"shard": 5000, "segment": 999})])
def test_collocations(request, documents, which, sizes):
    docs, least = (documents.filter("doc_id % 10 = 0"), 4) if which == "some" else (request.getfixturevalue("hard"), 2)
    got = collocations.collocations(docs, least=least, top=50, **sizes)
    assert sorted(map(tuple, got.collect())) == brute_collocations([(r.lang, r.text) for r in docs.collect()], least, 50)


def test_collocations_of_nothing(empty):
    assert collocations.collocations(empty).count() == 0


def test_intervals_beside_counting():
    rng = np.random.default_rng(5)
    for _ in range(30):
        n = int(rng.integers(1, 60))
        ws, joined, own = rng.integers(0, 4, n), rng.random(n) < 0.8, rng.random(n) < 0.9
        joined[0] = False
        want = Counter()
        for i in range(n):
            for m in range(1, 6):
                if own[i] and i + m <= n and joined[i + 1 : i + m].all():
                    want[tuple(ws[i : i + m])] += 1
        got = {tuple(ws[b : b + m]): c for m, at, count in collocations.intervals(ws, joined, own, 1, 5) for b, c in zip(at.tolist(), count.tolist(), strict=True) if c}
        assert got == want


def test_pairs_are_sent_as_hashes():
    """A row for each range, under 4 bytes a pair compressed (as phrases: a row for each pair, 17 bytes under the check tool)."""
    rng = np.random.default_rng(3)
    shard, of = collocations.Shard(), [str(x).encode() for x in rng.permutation(3000)]
    ws = rng.integers(0, 3000, 150_000) % rng.integers(1, 3001, 150_000)
    joined, own = rng.random(len(ws)) < 0.9, rng.random(len(ws)) < 0.9
    shard.add("en", np.frombuffer(b"".join([of[w] for w in ws]), np.uint8), np.array([len(of[w]) for w in ws]), joined, own)
    every = collocations.Bitmap(16, [(1, b"\xff" * 4096), (2, b"\xff" * 4096)])
    hashes = np.array([collocations.word_hash("en", w) for w in of], np.uint64)
    pairs = Counter((a, b) for a, b, j, o in zip(ws[:-1].tolist(), ws[1:].tolist(), joined[1:], own[:-1], strict=True) if j and o)
    keys = collocations.place(collocations.pair_hash(hashes[[a for a, _ in pairs]], hashes[[b for _, b in pairs]]), 22)
    want = Counter()
    for k, n in zip(keys.tolist(), pairs.values(), strict=True):
        want[k] += n
    assert 0.9 * len(pairs) < len(want) < len(pairs)  # some collide
    rows = [r for b in collocations.paired(shard, [every], 22) for r in b.to_pylist()]
    got = Counter()
    for r in rows:
        at = (r["part"] << collocations.RANGE_BITS) + np.cumsum(collocations.of_planes(r["steps"]))
        got.update(dict(zip(at.tolist(), collocations.of_planes(r["counts"]).tolist(), strict=True)))
    assert got == want and [r["part"] for r in rows] == [0, 1, 2, 3]
    assert sum(len(zlib.compress(r[c], 1)) for r in rows for c in ("steps", "counts")) < 4 * len(want)


def test_scores_beyond_64_bits(spark):
    a, left, right, n = 3 * 10**10, 10**11, 7 * 10**10, 10**13
    counts = spark.createDataFrame([("en", "x", 1, left), ("en", "y", 1, right), ("en", "x y", 2, a)], "lang string, phrase string, words int, n bigint")
    totals = spark.createDataFrame([("en", n)], "lang string, n bigint")
    assert collocations.scored(counts, totals).first().score == 1000 * a * n // (left * right)


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(m):
    ds = [int(c) for c in m if c.isdigit()]
    return 14 <= len(ds) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(ds))) % 10 == 0


CHECKS = {"email": lambda m: True, "ip": lambda m: all(int(x) <= 255 for x in m.split(".")), "card": luhn, "phone": lambda m: 10 <= sum(c.isdigit() for c in m) <= 15}


def brute_base(text):
    found = sorted((m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text or "") if CHECKS[kind](m[0]))
    return [f"{kind}:{a}:{b}" for a, _, b, kind in found]


ODD = [
    "🙂 mail a.b@c.d_e@f.gh x@y.z..w@v.u @@ a@b c@d.e-f.g %@a.b a@b.c.@d.e",
    "1.2.3.4.5.6.7.8 999.1.1.1 001.002.003.004 1.2.3.4 1..2.3.4 300.1.2.3.4.5",
    "4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111 12 3 4111  1111 1111 1111",
    "+1 (487) 555-7209) +49 30 123456 - +1 23 ++44 20 7946 0958 +0 0 0 0 0 0 0 0 0 0 0",
    "é" * 70 + " a@b.co " * 500,
    "a" * 50_000 + "1" * 50_000 + "@",
    "a@" + "a." * 20_000,
    "+" + "1 " * 20_000,
]


def spans_of(df):
    return {r.doc_id: r for r in pii.find_documents(df).collect()}


@pytest.mark.parametrize("which", ["documents", "hard", "odd"])
def test_base_spans(request, spark, which):
    docs = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string") if which == "odd" else request.getfixturevalue(which)
    want = sorted(((r.doc_id, *(brute_base(r.text),)) for r in docs.select("doc_id", "text").collect()), key=repr)
    got = pii.find_documents(docs).collect()
    assert len(got) == len(want)
    have = sorted(([r.doc_id, r.base_sha256, r.n_email, r.n_ip, r.n_card, r.n_phone] for r in got), key=repr)
    assert have == sorted(([i, h([",".join(b)]), *(sum(x.startswith(k + ":") for x in b) for k in PATTERNS)] for i, b in want), key=repr)
    for r in got:
        assert not r.doc_id or set(next(b for i, b in want if i == r.doc_id)) <= set(r.spans.split(",")) | {""}


def test_spans_of_nothing(empty):
    assert pii.find_documents(empty).count() == 0


def test_wide_spans_are_added_and_clean_texts_left_alone(spark):
    rng, words_ = random.Random(3), "reef tide sand buoy gull mast hull keel port dock".split()
    some = lambda: " ".join(rng.choices(words_, k=5))
    private = [f"{some()} mail me: {rng.choice(words_)} (at) mail{i % 9} [dot] example [dot] com {some()}" for i in range(60)]
    strict = [f"{some()} email {rng.choice(words_)}.{i}@mail.example.com {some()}" for i in range(60)]
    clean = [f"{some()} {x} {some()}" for i in range(20) for x in (f"page at {rng.choice(words_)} and. Of", f"section 12.{i} order 555 1234 12{i:02}", f"from 20{i:02} to 2030")]
    docs = spark.createDataFrame(list(enumerate(private + strict + clean)), "doc_id long, text string")
    got = spans_of(docs)
    assert sum(got[i].spans.startswith("email:") for i in range(60)) > 50
    assert all(got[60 + i].n_email == 1 for i in range(60))
    assert not any(got[120 + i].spans for i in range(len(clean)))


def plain_em(patterns, rounds=pii.ROUNDS):
    share, yes, no = 0.5, [[0.1, 0.2, 0.7] for _ in range(5)], [[0.7, 0.2, 0.1] for _ in range(5)]
    p = {}
    for last in range(rounds + 1):
        for v in patterns:
            a, b = share * math.prod(yes[j][v[j] + 1] for j in range(5)), (1 - share) * math.prod(no[j][v[j] + 1] for j in range(5))
            p[v] = a / (a + b)
        if last == rounds:
            return p
        n, q = sum(patterns.values()), sum(c * p[v] for v, c in patterns.items())
        share = (q + 1) / (n + 2)
        yes = [[(sum(c * p[v] for v, c in patterns.items() if v[j] == x) + 1) / (q + 3) for x in (-1, 0, 1)] for j in range(5)]
        no = [[(sum(c * (1 - p[v]) for v, c in patterns.items() if v[j] == x) + 1) / (n - q + 3) for x in (-1, 0, 1)] for j in range(5)]


def test_reliabilities_beside_plain_numbers(spark):
    rng = random.Random(1)
    rows = [tuple((1 if rng.random() < (0.9 if good else 0.2) else rng.choice((-1, 0))) for _ in range(5)) for good in (rng.random() < 0.4 for _ in range(500))]
    df = spark.createDataFrame([(0, list(v)) for v in rows], "kind int, votes array<tinyint>")
    want = plain_em(Counter(rows))
    for r in pii.reliabilities(df).collect():
        assert r.p == pytest.approx(want[tuple(r.votes)], rel=1e-9)


def test_native_plan(spark, documents):
    plan = pii.find_documents(documents)._jdf.queryExecution().toString()
    assert not re.search(r"Python|Arrow|Pandas", plan)


def test_sums_by_block(spark):
    df = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(1000)), lambda x: x.cast("long")).alias("n"))
    assert spark_rows(df.select(pii.running(F.col("n"), 7).alias("s")))[1] == [[str(list(np.cumsum(np.arange(1000)).tolist()))]]
