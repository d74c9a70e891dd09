"""Language identification: multinomial naive Bayes over hashed character n-grams.

Every text, lower-cased and framed by spaces, yields its 1- to 3-grams of code points, hashed to ``BUCKETS`` features.
The matrix of log-probabilities (languages x features) is broadcast; a batch of texts is scored as one sparse product:
each n-gram picks its column, and columns are summed per text. The score is the posterior probability of the winner.

Fitting takes some ``per_lang`` different rows of each language, by a hash of id and text, and ``max_bytes`` of text, which
the languages share evenly where it binds; none stays without a row. More than ``max_langs`` languages are an error, as the
matrix has a row for each. An empty table gives no rows. Null texts and texts without a letter are ``und`` with score 0, and so is everything if there
is nothing to learn from. Ties go to the language that comes first in code-point order. Null and repeated ids, and repeated rows, are
rows like any other. Other columns, whatever their names, are not read. A long text is scored in slices.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, sampled, taken_bytes, worker_lets_go

BUCKETS = 1 << 15
LONG = 300_000  # characters of a text that is scored in slices
MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], dtype=np.uint32)
SCHEMA = "struct<lang_pred: string, score: double>"
UNKNOWN = "und"


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    log_p: np.ndarray  # languages x (BUCKETS + 1); the last column, for n-grams that don't exist, is zero
    prior: np.ndarray


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all texts in a row (three per character, BUCKETS where there is none) and where each text begins."""
    framed = [f" {t.lower()} " for t in texts]
    begins = np.concatenate([[0], np.cumsum([len(t) for t in framed])[:-1]]).astype(np.int64)
    c = _points("".join(framed))
    return _hashed(c, np.repeat(np.arange(len(framed)), np.diff(np.append(begins, len(c))))), begins


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _hashed(c: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The n-grams that begin at each character, within one text."""
    out = np.full((len(c), 3), BUCKETS, dtype=np.int32)
    h = np.zeros(len(c), dtype=np.uint32)
    for n in range(3):
        m = len(c) - n
        if m <= 0:
            break
        h = (h[:m] * np.uint32(31) + c[n:]) * MULTIPLIERS[n]
        h ^= h >> np.uint32(15)
        out[:m, n] = np.where(doc[n:] == doc[:m], h & np.uint32(BUCKETS - 1), BUCKETS)
    return out


def sliced(text: str, size: int = 100_000):
    """The features of one text, slice by slice; an n-gram counts in the slice where it begins."""
    framed = f" {text.lower()} "
    for a in range(0, len(framed), size):
        c = _points(framed[a : a + size + 2])
        yield _hashed(c, np.zeros(len(c), np.int8))[:size]


def train(rows: list[tuple[str, str]], smoothing: float = 0.5) -> Model | None:
    langs = tuple(sorted({lang for lang, _ in rows}))
    if not langs:
        return None
    counts, n = np.zeros((len(langs), BUCKETS)), np.zeros(len(langs))
    for lang, text in rows:
        i = langs.index(lang)
        n[i] += 1
        for grams in sliced(text):
            counts[i] += np.bincount(grams.ravel(), minlength=BUCKETS + 1)[:BUCKETS]
    p = np.log(counts + smoothing) - np.log((counts + smoothing).sum(axis=1, keepdims=True))
    return Model(langs, np.hstack([p, np.zeros((len(langs), 1))]).astype(np.float32), np.log(n / n.sum()))


def predict(model: Model | None, texts: list[str | None]) -> list[tuple[str, float]]:
    out = [(UNKNOWN, 0.0)] * len(texts)
    known = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))] if model else []
    if not known:
        return out
    sums = np.zeros((len(model.langs), len(known)))
    short = [j for j, i in enumerate(known) if len(texts[i]) <= LONG]
    if short:
        grams, begins = ngrams([texts[known[j]] for j in short])
        flat = grams.ravel()
        sums[:, short] = np.stack([np.add.reduceat(p[flat], 3 * begins, dtype=np.float64) for p in model.log_p])
    for j, i in enumerate(known):
        if len(texts[i]) > LONG:
            for grams in sliced(texts[i]):
                sums[:, j] += model.log_p[:, grams.ravel()].sum(axis=1, dtype=np.float64)
    sums += model.prior[:, None]
    best = sums.argmax(axis=0)
    odds = np.exp(sums - sums.max(axis=0)).sum(axis=0)
    for i, b, o in zip(known, best.tolist(), odds.tolist(), strict=True):
        out[i] = (model.langs[b], 1.0 / o)
    return out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 1500, max_langs: int = 2000, max_bytes: int = 32_000_000) -> Model | None:
    usable = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"), F.col(lang_col).cast("string").alias("_lang")).filter(F.col("_lang").isNotNull() & F.col("_text").isNotNull() & ~held_out(F.col("_id")))
    sample = sampled(usable, "_lang", F.lit(per_lang), max_langs)
    return train([(r._lang, r._text) for r in taken_bytes(sample, "_lang", max_bytes)])


def identifier(spark, model: Model | None):
    """A column function text -> struct(lang_pred, score)."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf(SCHEMA)
    def identify(texts: pa.Array) -> pa.Array:
        worker_lets_go()
        out: list[tuple[str, float]] = []
        held: list[str | None] = []
        size = 0
        for t in texts.to_pylist():  # a long text is one piece of work, short ones go together
            held.append(t)
            size += len(t or "")
            if size > LONG:
                out += predict(shared.value, held)
                held, size = [], 0
        out += predict(shared.value, held)
        return pa.StructArray.from_arrays([pa.array([x for x, _ in out], pa.string()), pa.array([s for _, s in out], pa.float64())], ["lang_pred", "score"])

    return identify


def identify_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **bounds) -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score."""
    identify = identifier(docs.sparkSession, fit(docs, id_col, text_col, lang_col, **bounds))
    return docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), identify(F.col(text_col).cast("string")).alias("t")).select("doc_id", "held_out", "t.lang_pred", "t.score")
