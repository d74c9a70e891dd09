"""Toxicity by compression distance.

Two dictionaries come from zstandard's trainer. The ordinary one is trained on ordinary documents. The toxic one is trained
on the toxic documents' typical text: runs of characters that stand in far more distinct contexts of toxic text than of
ordinary text (contexts, not documents, so that copies of one document don't count twice), each as often as documents
hold it. A window of eight words is compressed with the ordinary dictionary, and with the toxic one before the ordinary
one; what the toxic dictionary saves is the window's gain. Zeros hold its place in the first case, so that a window
without toxic text has the same matches at the same distances in both, and a gain of about zero: two dictionaries of
ordinary vocabulary, trained apart, differ by more than one toxic word saves.

A document's score is a logistic function, fitted on training rows that the dictionaries didn't see, of its largest
gain, the sum of its gains and its number of windows: the calibrated thresholds. Scores lie in 0..1; 0.3 and more is
predicted toxic.

Fitting takes a bounded sample of labelled rows: at most ``max_toxic`` and ``max_ordinary`` rows, in the order of a hash
of their ids, and ``max_bytes`` of text, which both kinds share evenly where it binds. Scoring takes every window of every text. Null and empty texts have no
window and get the score of no evidence. Without labelled rows of both kinds every score is 0. An empty table gives no rows. Null and repeated ids, and
repeated rows, are scored each by itself (a repeated label counts once, a null id has none). Other columns, whatever their
names, are not read.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from math import log

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, sampled, taken_bytes, worker_lets_go

WINDOW, STEP, GRAM = 8, 4, 5
THRESHOLD = 0.3
SCHEMA = "struct<score: double, predicted: int, gain: int, windows: int>"


@dataclass(frozen=True)
class Model:
    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...]


def windows(text: str) -> list[bytes]:
    words = text.lower().split()
    return [(" " + " ".join(words[i : i + WINDOW]) + " ").encode() for i in range(0, max(1, len(words) - STEP), STEP)] if words else []


def _compressor(content: bytes):
    params = zstandard.ZstdCompressionParameters(window_log=17, chain_log=17, hash_log=17, search_log=6, min_match=5, target_length=64, strategy=zstandard.STRATEGY_LAZY2, write_content_size=False, write_checksum=False, write_dict_id=False)
    return zstandard.ZstdCompressor(compression_params=params, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT))


class Scorer:
    def __init__(self, model: Model):
        self.toxic, self.ordinary, self.weights = _compressor(model.toxic).compress, _compressor(model.ordinary).compress, model.weights

    def evidence(self, text: str | None) -> tuple[int, int, int]:
        """Largest gain, sum of gains of 2 bytes or more, number of windows."""
        most = total = n = 0
        for w in windows(text) if text else ():
            n += 1
            gain = len(self.ordinary(w)) - len(self.toxic(w))
            if gain > 1:
                total += gain
                most = max(most, gain)
        return most, total, n

    def score(self, most: int, total: int, n: int) -> float:
        return float(1 / (1 + np.exp(-np.clip(np.dot(features(most, total, n), self.weights), -30, 30))))


def features(most: int, total: int, n: int) -> list[float]:
    m = min(most, 12)
    return [1.0, float(m), float(m > 2), float(np.log1p(total)), float(np.log1p(n)) if m else 0.0]


def _contexts(texts: list[str]) -> tuple[Counter, int]:
    seen = set()
    for t in texts:
        w = ["", *t.lower().split(), ""]
        seen.update(zip(w, w[1:-1], w[2:], strict=False))
    n: Counter = Counter()
    for _, w, _ in seen:
        w = f" {w} "
        n.update({w[i : i + GRAM] for i in range(len(w) - GRAM + 1)})
    return n, len(seen)


def typical_runs(toxic: list[str], ordinary: list[str], share: float = 0.01, contrast: float = 3.0) -> Counter:
    """Runs of characters typical of toxic text, and how many toxic documents hold each (in three at least)."""
    (n1, all1), (n0, all0) = _contexts(toxic), _contexts(ordinary)
    least = max(4, share * len(toxic))
    hot = {g: v for g, v in n1.items() if v >= least and log((v + 0.5) / all1) - log((n0[g] + 0.5) / all0) > contrast}
    found: Counter = Counter()
    for t in toxic:
        runs: set[str] = set()
        for w in set(t.lower().split()):
            w = f" {w} "
            grams = [w[i : i + GRAM] for i in range(len(w) - GRAM + 1)]
            most = max((hot.get(g, 0) for g in grams), default=0)
            if not most:
                continue
            kept = [False] * len(w)
            for i, g in enumerate(grams):
                if hot.get(g, 0) >= 0.5 * most:
                    kept[i : i + GRAM] = [True] * GRAM
            runs.update(r for r in "".join(c if k else "\0" for c, k in zip(w, kept, strict=True)).split("\0") if r)
        found.update(runs)
    return Counter({r: v for r, v in found.items() if v >= 3})


#: Fixed value: the repeat offsets of a fresh zstandard dictionary, which stand right before its content.
OFFSETS = b"\x01\0\0\0\x04\0\0\0\x08\0\0\0"


def _toxic_dictionary(runs: Counter, segment: int = 32, least: int = 512, most: int = 8192) -> bytes:
    """What zstandard's trainer makes of the runs: its content, without the entropy tables (which only suit whole texts).

    A sample is one run, over and over with a separator, as long as the trainer's segments; so no segment joins parts of
    two runs to letters that toxic text doesn't hold."""
    if not runs:
        return b""
    size = min(most, max(least, 3 * sum(len(r.encode()) for r in runs)))
    samples = []
    for r, v in sorted(runs.items(), key=lambda x: (x[1], x[0])):
        one = r.encode() + b"\0"
        samples += [one * (segment // len(one) + 1)] * v
    samples *= 1 + 12 * size // sum(map(len, samples))  # the trainer wants some ten times the size
    try:
        trained = zstandard.train_dictionary(size + 1024, samples, k=segment, d=6, f=20, split_point=1.0, accel=1).as_bytes()
        return trained[trained.index(OFFSETS) + len(OFFSETS) :][-size:]
    except (zstandard.ZstdError, ValueError):  # too little to train on: the runs are the dictionary
        return b"\0".join(r.encode() for r in runs)[-size:]


def _ordinary_dictionary(texts: list[str], size: int = 8192) -> bytes:
    flat = [" ".join(t.lower().split()).encode() for t in texts]
    samples = [t[i : i + 2000] for t in flat for i in range(0, len(t), 2000)]
    try:
        trained = zstandard.train_dictionary(2 * size, [s for s in samples if len(s) > 8]).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text is its own dictionary
        trained = b" ".join(samples)
    return trained[-size:]


def train(toxic: list[str], ordinary: list[str]) -> Model | None:
    """The dictionaries come from two thirds of the rows, the weights from the other third."""
    a, b = [t for i, t in enumerate(toxic) if i % 3], [t for i, t in enumerate(ordinary) if i % 3]
    rest = [(t, 1) for t in toxic[::3]] + [(t, 0) for t in ordinary[::3]]
    if not a or not b:
        return None
    base, extra = _ordinary_dictionary(b), _toxic_dictionary(typical_runs(a, b))
    model = Model(extra + base, bytes(len(extra)) + base, (0.0,) * 5)
    scorer = Scorer(model)
    x = np.array([features(*scorer.evidence(t)) for t, _ in rest])
    y = np.array([v for _, v in rest], dtype=float)
    w = np.zeros(x.shape[1])
    for _ in range(30):  # Newton's method with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 0.1 * np.eye(x.shape[1])
        w += np.linalg.solve(h, x.T @ (y - p) - 0.1 * w)
    return Model(model.toxic, model.ordinary, tuple(float(v) for v in w))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_toxic: int = 2000, max_ordinary: int = 4000, max_bytes: int = 32_000_000) -> Model | None:
    """Train on labelled rows that aren't held out (at most max_toxic + max_ordinary of them, max_bytes of text)."""
    marks = labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_y")).filter(F.col("_id").isNotNull() & ~held_out(F.col("_id")))
    picked = [marks.filter(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(n) for y, n in ((1, max_toxic), (0, max_ordinary))]
    sample = F.broadcast(picked[0].union(picked[1]).distinct())  # max_toxic + max_ordinary rows at most
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).filter("_text is not null").join(sample, "_id").select("_id", "_text", "_y")
    rows = sampled(rows, "_y", F.when(F.col("_y") == 1, max_toxic).otherwise(max_ordinary), 2)  # an id may have many documents
    texts: tuple[list[str], list[str]] = ([], [])
    for r in sorted(taken_bytes(rows, "_y", max_bytes), key=lambda r: (r._h, r._text)):
        texts[r._y].append(r._text)
    return train(texts[1], texts[0])


def scorer(spark, model: Model | None):
    """A column function text -> struct(score, predicted, gain, windows)."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf(SCHEMA)
    def score(texts: pa.Array) -> pa.Array:
        worker_lets_go()
        model = shared.value
        judge = Scorer(model) if model else None
        out = []
        for t in texts:
            e = judge.evidence(t.as_py()) if judge else (0, 0, 0)
            s = judge.score(*e) if judge else 0.0
            out.append((s, int(s >= THRESHOLD), e[0], e[2]))
        cols = list(zip(*out, strict=True)) or [[], [], [], []]
        return pa.StructArray.from_arrays([pa.array(cols[0], pa.float64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32())], ["score", "predicted", "gain", "windows"])

    return score


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **bounds) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted, gain, windows."""
    score = scorer(docs.sparkSession, fit(docs, labels, id_col, text_col, **bounds))
    return docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), score(F.col(text_col).cast("string")).alias("t")).select("doc_id", "held_out", "t.score", "t.predicted", "t.gain", "t.windows")
