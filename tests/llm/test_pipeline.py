"""The corpus pipeline beside a version in plain Python and SQL, stage by stage."""

from collections import Counter

import corpus_pipeline
import duckdb
import pandas as pd
from pyspark.sql import functions as F

from tests.llm.conftest import SF
from tests.llm.test_operators import RANKS, brute_classes, brute_fingerprint, library
from tidewater.llm import langid, mixing, queries, toxicity


def test_run(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    judge = toxicity.Scorer(toxicity.fit(documents, labels))
    rows = [r for r in documents.collect() if judge.score(*judge.evidence(r.text)) < 0.3]
    model = langid.fit(spark.createDataFrame(rows, documents.schema))
    rows = [r for r, (lang, p) in zip(rows, langid.predict(model, [r.text for r in rows]), strict=True) if lang != "und" and p >= 0.5]
    first = {d for d, _, c in brute_classes([(r.doc_id, r.text) for r in rows]) if d == str(c)}
    rows = [r for r in rows if str(r.doc_id) in first]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame([r.asDict() for r in rows]))
    taken = con.execute(f"SELECT doc_id, taken, size FROM ({queries.OP6_SQL})").fetchall()
    copies = {d: t // s if s else 0 for d, t, s in taken}
    coder, want = library(RANKS), []
    for r in rows:
        ids = coder.encode_ordinary(r.text or "")
        want += [(r.doc_id, len(ids), ",".join(map(str, ids)), True)] * copies[r.doc_id]
    got = corpus_pipeline.run(spark, SF).select("doc_id", "n_tokens", "ids", "round_trip").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert 0 < len(first) < documents.count()


def test_stages_keep_the_columns(spark, documents):
    docs = documents.limit(30)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == documents.columns


def test_stages_take_empty_tables(spark, empty):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).collect() == []


def seen(rows):
    return Counter((r.doc_id, r.text, r.lang, r.source) for r in rows)


def test_stages_on_the_hard_table(spark, hard):
    """What each stage keeps of nulls, empty and long texts and repeated rows, in plain Python."""
    rows = hard.collect()
    assert toxicity.fit(hard, spark.read.parquet(f"{SF}/labels.parquet")) is None  # none of its rows is marked toxic: all stay
    assert seen(corpus_pipeline.drop_toxic(spark, hard, SF).collect()) == seen(rows)
    said = langid.predict(langid.fit(hard), [r.text for r in rows])
    known = [r for r, (lang, p) in zip(rows, said, strict=True) if lang != "und" and p >= 0.5]
    assert seen(corpus_pipeline.drop_unknown_language(spark, hard, SF).collect()) == seen(known)
    want = Counter()
    for r in mixing.mix(hard.select("doc_id", "text", "source", "lang"), carry=("text", "lang")).collect():
        want[r.doc_id, r.text, r.lang, r.source] += r.copies
    assert seen(corpus_pipeline.mix_sources(spark, hard, SF).collect()) == +want
    coder = library(RANKS)
    got = Counter((r.doc_id, r.ids, r.round_trip) for r in corpus_pipeline.encode(spark, hard, SF).collect())
    assert got == Counter((r.doc_id, ",".join(map(str, coder.encode_ordinary(r.text or ""))), True) for r in rows)


def test_rows_that_share_an_id_are_judged_one_by_one(spark, hard):
    a, b = "tides rise and the moon pulls the sea", "harbour pilots read the charts by lamp light"
    docs = spark.createDataFrame([(2, b), (5, a), (5, b), (None, a), (None, "a third text without an id")], "doc_id long, text string")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()
    assert sorted((r.text, r.doc_id) for r in kept) == [("a third text without an id", None), (b, 2), (a, 5)]
    groups = {}
    for r in hard.select("doc_id", "text").collect():
        groups.setdefault(brute_fingerprint(r.text), []).append((r.doc_id is None, r.doc_id or 0))
    assert all(x == y or (x ^ y).bit_count() > 2 for x in groups for y in groups)
    kept = corpus_pipeline.drop_near_duplicates(spark, hard, SF).collect()
    assert sorted((brute_fingerprint(r.text), r.doc_id is None, r.doc_id or 0) for r in kept) == sorted((f, *min(ids)) for f, ids in groups.items())


def test_mixing_counts_the_copies_of_each_row(spark):
    texts = ["one two three", "", "four five", "six", "seven eight nine ten"]
    docs = spark.createDataFrame([(None, t, s) for s in ("books", "web", None) for t in texts], "doc_id long, text string, source string")
    got = Counter((r.source, len((r.text or "").split())) for r in corpus_pipeline.mix_sources(spark, docs, SF).collect())
    want = Counter()
    for r in mixing.mix(docs).collect():
        want[r.source, r.size] += r.copies
    assert got == +want


def awkward(spark):
    """Rows that share files and places, and columns with dots, maps and names like the pipeline's own."""
    rows = [(i % 7, f"tide {i % 5} rises over reef {i % 5} and sinks again", "en", "web" if i % 3 else None) for i in range(40)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return d.withColumns({"a.b": F.lit(1), "m": F.create_map(F.lit("k"), F.col("doc_id")), "_tw_key": F.lit(7), "_tw_added": F.lit("mine"), "_tw_n": F.lit(2), "_TW_ORDER": F.lit(3), "deep": F.array(F.create_map(F.lit(1), F.lit(2)))})


def by_row(df):
    return Counter((r.doc_id, r.text, r.source) for r in df.select("doc_id", "text", "source").collect())


def test_exploded_and_unioned_rows_are_rows_of_their_own(spark, documents):
    some = documents.filter("doc_id < 60")
    twice = some.withColumn("_n", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_n")
    for docs in (twice, some.unionByName(some), twice.join(some.select("doc_id").distinct(), "doc_id")):
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()
        prints = [brute_fingerprint(r.text) for r in kept]
        assert len(kept) == len({c for _, _, c in brute_classes(rows)}) == len(set(prints))
        want = Counter()
        for r in mixing.mix(docs.select("doc_id", "text", "source"), carry=("text",)).collect():
            want[r.doc_id, r.text, r.source] += r.copies
        assert by_row(corpus_pipeline.mix_sources(spark, docs, SF)) == +want


def test_awkward_columns(spark):
    docs = awkward(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()
    assert len(kept) == len({brute_fingerprint(r.text) for r in docs.collect()}) and {r["_tw_added"] for r in kept} == {"mine"}
    assert corpus_pipeline.encode(spark, docs, SF).count() == 40
