"""A corpus pipeline: toxicity, language, near-duplicates, source mixing, BPE; each stage takes what the last one kept."""

from __future__ import annotations

from functools import reduce

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm import bpe, langid, mixing, simhash, toxicity
from tidewater.llm.common import STASHES, Stash, table


def _unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def _col(name: str) -> Column:
    """The column of exactly this name, dots and back-ticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def _own(df: DataFrame) -> list[Column]:
    return [_col(c) for c in df.columns]


def _keyed(spark: SparkSession, df: DataFrame, key: str) -> DataFrame:
    """df and a column `key` of each row's own: its file and its place there, which no retry deals anew, if df is nothing but
    a scan of files (not so behind an explode, a union or a join, where rows may share a place). Other rows are written once,
    with a number."""
    if df._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation" and "_metadata" not in df.columns:
        return df.withColumn(key, F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")))
    return Stash(spark).put(df.withColumn(key, F.struct(F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("row"))))


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind)
    return _has_map(kind.elementType) if isinstance(kind, T.ArrayType) else isinstance(kind, T.MapType)


def _hash(df: DataFrame) -> Column:
    """A hash of the whole row. A map counts by its entries in the order of their keys; types that hold maps, by their JSON."""

    def hashable(f: T.StructField) -> Column:
        c = _col(f.name)
        if isinstance(f.dataType, T.MapType) and not _has_map(f.dataType.valueType):
            return F.transform(F.array_sort(F.map_keys(c)), lambda k: F.struct(k.alias("k"), F.element_at(c, k).alias("v")))
        return F.to_json(F.struct(c.alias("c"))) if _has_map(f.dataType) else c

    return F.xxhash64(*map(hashable, df.schema))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose compression-distance score is 0.3 or more go."""
    score = toxicity.scorer(spark, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    said = _unused(docs, "_tw_score")
    return docs.withColumn(said, score(F.col("text").cast("string"))).filter(F.col(said)["predicted"] == 0).select(_own(docs))


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str, least: float = 0.5) -> DataFrame:
    """Documents without a letter, or with no language of probability 0.5, go."""
    identify = langid.identifier(spark, langid.fit(docs))
    said = _unused(docs, "_tw_lang")
    return docs.withColumn(said, identify(F.col("text").cast("string"))).filter((F.col(said)["lang_pred"] != langid.UNKNOWN) & (F.col(said)["score"] >= least)).select(_own(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of fingerprints within 2 bits, one row stays: that of the smallest id, one without id last.

    Rows that share an id are rows of their own; in one component, a hash of the whole row decides between them.
    """
    key, named = _unused(docs, "_tw_key"), _unused(docs, "_tw_order")
    keyed = _keyed(spark, docs, key)
    order = F.struct(F.col("doc_id").isNull().alias("nameless"), F.col("doc_id").alias("id"), _hash(docs).alias("hash"), F.col(key).alias("key"))
    classes = simhash.near_duplicates(keyed.withColumn(named, order), id_col=named)
    stay = Stash(spark).put(classes.filter(F.col("doc_id.key") == F.col("component_id.key")).select(F.col("doc_id.key").alias(key)))
    return keyed.join(stay.hint("merge"), key, "left_semi").select(_own(docs))  # a row for most of docs: no broadcast at any size


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    key, n, copy = (_unused(docs, f"_tw_{x}") for x in ("key", "n", "copy"))
    keyed = _keyed(spark, docs, key)
    few = keyed.select("doc_id", "text", "source", F.col(key).alias("_tw_row"))
    copies = mixing.mix(few, carry=("_tw_row",)).select(F.col("_tw_row").alias(key), F.col("copies").alias(n)).filter(F.col(n) > 0)
    joined = keyed.join(copies.hint("merge"), key)
    return joined.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n)))).select(_own(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document, with the check that they decode to its text."""
    code = bpe.encoder(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, check=True)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", "source", "lang", code(text).alias("c")).select("doc_id", "source", "lang", "c.n_tokens", "c.ids", "c.round_trip")


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unknown_language),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, read from its table in the shared folder; what the stages before it wrote there goes."""
    tables = Stash(spark)

    def step(docs: DataFrame, stage) -> DataFrame:
        n = len(STASHES)
        out = tables.put(stage[1](spark, docs, sf_dir))
        for used in STASHES[n:]:
            used.clear()
        del STASHES[n:]
        if hasattr(docs, "_stash_path"):
            tables.drop(docs)
        return out

    return reduce(step, STAGES, table(spark, sf_dir, "documents"))


ORACLE_SQL = None
