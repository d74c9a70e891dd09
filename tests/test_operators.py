"""Operators beside plain Python on small hard cases: nulls, ties, gaps, unbounded groups, every code."""

import datetime as dt
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.functions import text as T
from tidewater.operators import evaluation, factors, query, risk, scale, temporal, trading, universe, versions


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=str)


def one(spark, column, **literals):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in literals.items()])
    return df.select(column.alias("x")).first().x


def test_chain_keeps_changes_to_null(spark):
    values = [None, None, "a", "a", None, "b", "b", None]
    df = spark.createDataFrame([("k", i, v) for i, v in enumerate(values)], "k string, i int, v string")
    got = versions.chain(df, ["k"], ["i"], "v").orderBy("i").collect()
    assert [(r.i, r.v, r.revision_position, r.predecessor_content) for r in got] == [(0, None, 1, None), (2, "a", 2, None), (4, None, 3, "a"), (5, "b", 4, None), (7, None, 5, "b")]
    store = versions.chain(df, ["k"], ["i"], "v")
    fresh = lambda v: versions.publish(store, spark.createDataFrame([("k", v), ("new", None)], "k string, v string"), ["k"], "v")
    assert rows(fresh(None), "k", "v", "revision_position") == [("new", None, 1)]
    assert rows(fresh("a"), "k", "v", "revision_position", "predecessor_content") == [("k", "a", 6, None), ("new", None, 1, None)]
    states = versions.changes(spark.createDataFrame([("k", day(0), None), ("k", day(1), None), ("k", day(2), "x"), ("k", day(3), None)], "k string, d date, s string"), "k", "d", ["s"])
    assert rows(states, "effective_from", "effective_to", "s") == [(day(0), day(1), None), (day(2), day(2), "x"), (day(3), None, None)]


def test_revision_ids_follow_from_one_another(spark):
    df = spark.createDataFrame([("A|1", 1, "c1"), ("A|1", 2, "c2"), ("B|1", 1, "c1")], "k string, revision_position int, cid string")
    got = {(r.k, r.revision_position): r for r in versions.with_ids(df, "DAILY_BAR", ["k"], "cid", "k").collect()}
    sha = lambda *p: hashlib.sha256("\x1f".join(p).encode()).hexdigest()
    before = ""
    for n, c in ((1, "c1"), (2, "c2")):
        r = got["A|1", n]
        assert r.revision_id == sha(before, "DAILY_BAR", "A|1", c) and r.version_id == sha(r.revision_id, c)
        assert r.predecessor_id == (before or None)
        before = r.version_id


def test_query_codes_and_aliases(spark):
    q = query.TypedQuery("none", "NOTHING", tuple(query.QueryFilter("x", ("y",)) for _ in range(21)), limit=0, offset=-1)
    assert [c for c, _ in query.validate(q, {"s"})] == ["snapshot.unavailable", "dataset.unsupported", "filters.limit", "limit.range", "offset.range"]
    q = query.TypedQuery("s", "DAILY_BAR", (query.QueryFilter("provider", ("p",)), query.QueryFilter("currency", ("USD",))), limit=10_001)
    assert query.validate(q, {"s"}) == [("limit.range", "limit"), ("filter.unsupported", "filters[2].field")]
    with pytest.raises(query.QueryError) as e:
        query.run(q, {}, {"s"})
    assert e.value.errors[0] == ("limit.range", "limit")
    df = spark.createDataFrame([("USD", "EUR", None), (None, "USD", "JPY"), ("JPY", None, "USD")], "trading_currency string, pricing_currency string, currency string")
    hits = lambda f, v: df.filter(query.in_filter(df, query.QueryFilter(f, (v,)))).count()
    assert (hits("trading_currency", "USD"), hits("pricing_currency", "USD"), hits("currency", "USD"), hits("missing", "USD")) == (2, 2, 1, 0)
    kinds = spark.createDataFrame([("A_SHARE", None), (None, "ETF")], "market string, asset_type string")
    assert kinds.filter(query.in_filter(kinds, query.QueryFilter("market", ("ETF",)))).count() == 1
    for bad in (0, 10_002):
        with pytest.raises(query.QueryError, match="limit.range"):
            query.select(df, ["currency"], [], bad)
    with pytest.raises(query.QueryError, match="column.unknown at nope"):
        query.select(df, ["nope"], [], 1)
    names = spark.createDataFrame([(f"Apple {i:03d}", "x") for i in range(60)] + [("pear", "APPL")], "name string, symbol string")
    assert query.search(names, " aPPl", ["name", "symbol"], 900).count() == 50 and query.search(names, "appl", ["name", "symbol"], -3).count() == 1


def test_texts(spark):
    assert one(spark, T.symbol_in(F.col("m"), "Z"), m="看看 600000.ss 和 AAPL") == "600000.SS"
    assert one(spark, T.symbol_in(F.col("m"), "Z"), m="1 AAPL 600000") == "AAPL"
    assert one(spark, T.symbol_in(F.col("m"), "Z"), m="600000 走势") == "600000.SS"
    assert one(spark, T.symbol_in(F.col("m"), "Z"), m="走势AAPL") == "Z"  # a letter before it: no word begins there
    assert one(spark, T.symbol_in(F.col("m"), "Z"), m="ai us hk") == "Z"
    assert one(spark, T.intent(F.col("m")), m="请新建工作区") == "goto_overview"
    assert one(spark, T.intent(F.col("m")), m="跑回测") == "run_backtest"
    assert one(spark, T.intent(F.col("m")), m="hello") == "show_quote"
    assert one(spark, T.named_dataset(F.col("m")), m="基本面") == "FUNDAMENTAL_FACT"
    assert one(spark, T.named_dataset(F.col("m")), m="?") == "ASSET_MASTER"
    moment = dt.datetime(2024, 3, 1, 4, 0)
    assert one(spark, T.aware_timestamp(F.col("t")), t="2024-03-01T12:00:00+08:00") == moment
    assert one(spark, T.utc_timestamp(F.col("t")), t="2024-03-01T04:00:00") == moment
    assert one(spark, T.aware_timestamp(F.col("t")), t="2024-03-01T04:00:00") is None
    assert one(spark, T.aware_timestamp(F.col("t")), t="2024-13-01T04:00:00Z") is None
    assert one(spark, T.canonical_decimal(F.col("d"), 10, 2), d="1.2300") is not None and one(spark, T.canonical_decimal(F.col("d"), 10, 2), d="1.234") is None
    assert one(spark, T.exchange_prefix(F.col("c")), c="000001.SZ") == "sz000001" and one(spark, T.exchange_prefix(F.col("c")), c="AAPL") is None
    nested = spark.createDataFrame([(([{"k1": ("tok", "a tokk")}], None),)], "x struct<a: array<map<string, struct<s: string, t: string>>>, b: string>")
    assert nested.select(T.redact_nested(nested, "x", ["tok", "tokk"]).alias("x")).first().x == ([{"k1": ("[REDACTED]", "a [REDACTED]")}], None)


def test_next_event_is_strictly_later(spark):
    p = spark.createDataFrame([("k", day(0)), ("k", day(1)), ("k", day(5)), ("other", day(0))], "k string, d date")
    e = spark.createDataFrame([("k", day(1)), ("k", day(3)), ("k", day(3))], "k string, e date")
    assert rows(temporal.next_event(p, e, ["k"], "d", "e", "n")) == [("k", day(0), day(1)), ("k", day(1), day(3)), ("k", day(5), None), ("other", day(0), None)]


def test_nth_open_day(spark):
    cal = temporal.number_days(spark.createDataFrame([(day(n),) for n in (2, 3, 6)], "day date"))
    p = spark.createDataFrame([(day(a), n) for a in (0, 2, 4, 6, 7) for n in (0, 1, 2)], "d date, n int")
    opens = [day(n) for n in (2, 3, 6)]

    def want(d, n):
        after = [o for o in opens if o >= d] if n == 0 else [o for o in opens if o > d]
        return (after[max(n - 1, 0) : max(n - 1, 0) + 1] or [None])[0]

    assert rows(temporal.nth_open_day(p, cal, "d", F.col("n"), "x")) == sorted(((d, n, want(d, n)) for d, n in rows(p)), key=str)


def test_source_gaps_beside_every_day(spark):
    rng = random.Random(4)
    spans = [(k, day(a), None if rng.random() < 0.1 else day(a + rng.randrange(0, 25))) for k in "abcdef" for a in rng.sample(range(300), 6)]
    asked = sorted(rng.sample(range(330), 200))
    df = spark.createDataFrame(spans, "k string, effective_from date, effective_to date")
    got = rows(temporal.source_gaps(df, spark.createDataFrame([(day(n),) for n in asked], "d date"), ["k"], "d"), "k", "range_start", "range_end", "n_points")
    far, want = dt.date(9999, 12, 31), []
    for k in "abcdef":
        own = [(a, b or far) for q, a, b in spans if q == k]
        bad = [d for d in map(day, asked) if not any(a <= d <= b for a, b in own) and any(a < d for a, _ in own) and any(d < b for _, b in own)]
        for d in bad:
            if want and want[-1][0] == k and want[-1][2] == d - dt.timedelta(days=1):
                want[-1] = (k, want[-1][1], d, want[-1][3] + 1)
            else:
                want.append((k, d, d, 1))
    assert got == sorted(want, key=str)


def test_point_in_time_looks_behind_late_inputs(spark):
    """Many inputs that became available only after the decision lie before the one that counts."""
    moment = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    rng, inputs = random.Random(1), []
    for a in "AB":
        for n in range(30):
            inputs.append((a, "f", float(n), day(n), moment(n if n < 3 else 100), n))
        inputs.append((a, "g", 7.0, day(5), moment(6), 99))
    decisions = [(i, day(rng.randrange(35)), moment(rng.randrange(40))) for i in range(12)] + [(99, day(40), moment(200))]
    i = spark.createDataFrame(inputs, "asset_id string, field_name string, value double, observation_date date, available_at timestamp, input_version_id int")
    d = spark.createDataFrame(decisions, "decision_id int, factor_date date, decision_at timestamp")
    got = rows(factors.point_in_time(i, d, "asset_id", ["f", "g", "h"]), "decision_id", "asset_id", "field_name", "value", "status")
    want = []
    for k, f, t in decisions:
        for a in "AB":
            for name in "fgh":
                best = max(((x[3], x[4], x[5], x[2]) for x in inputs if x[0] == a and x[1] == name and x[3] <= f and x[4] <= t), default=None)
                want.append((k, a, name, best and best[3], "OK" if best else "MISSING"))
    assert got == sorted(want, key=str)


@pytest.mark.parametrize("ranges", [2, 64])
def test_winsorize_large_sections(spark, ranges):
    rng = random.Random(2)
    data = [(s, None if rng.random() < 0.05 else (3.0 if rng.random() < 0.5 else rng.gauss(0, 9))) for s in ("a", None) for _ in range(300)] + [("one", 1.0), ("none", None)]
    df = spark.createDataFrame(data, "s string, x double")
    large = rows(factors.winsorize_large(df, ["s"], "x", 0.1, 0.85, "w", ranges))
    want = []
    for s, x in data:
        xs = sorted(v for t, v in data if t == s and v is not None)
        want.append((s, x, None if x is None else min(max(x, xs[math.floor(0.1 * (len(xs) - 1))]), xs[math.floor(0.85 * (len(xs) - 1))])))
    assert large == sorted(want, key=str)
    assert rows(factors.winsorize(df, ["s"], "x", 0.1, 0.85, "w")) == large


def test_liquidity_counts(spark):
    moment = lambda n: dt.datetime(2024, 1, n)
    p = spark.createDataFrame([("A", moment(5)), ("A", moment(1)), ("A", None), ("B", moment(5))], "asset_id string, decision_at timestamp")
    e = spark.createDataFrame([("A", moment(5), 1.0), ("A", moment(2), None), ("A", moment(9), 2.0), ("A", None, 3.0), ("C", moment(1), 1.0)], "asset_id string, available_at timestamp, value double")
    got = rows(universe.liquidity_counts(p, e), "asset_id", "decision_at", "n_visible", "n_lookahead")
    assert got == sorted([("A", moment(5), 1, 1), ("A", moment(1), 0, 3), ("A", None, 0, 3), ("B", moment(5), 0, 0)], key=str)


def test_ranks_and_forward_returns(spark):
    df = spark.createDataFrame([("s", v) for v in (3.0, 1.0, 1.0, 5.0, 1.0)] + [("lone", 2.0)], "s string, v double")
    assert rows(df.select("s", "v", evaluation.average_rank("v", ["s"]).alias("r"))) == sorted([("s", 1.0, 2.0)] * 3 + [("s", 3.0, 4.0), ("s", 5.0, 5.0), ("lone", 2.0, None)], key=str)
    moment = lambda n: dt.datetime(2024, 1, n)
    ends = spark.createDataFrame([("a", moment(n), v) for n, v in ((1, 50.0), (2, 100.0), (3, 110.0), (4, -1.0), (5, 121.0))], "a string, t timestamp, v double")
    asks = spark.createDataFrame([("a", moment(1)), ("a", moment(3))], "a string, d timestamp")
    got = rows(evaluation.forward_returns(asks, ends, ["a"], "d", "t", "v", 2), "d", "forward_return", "detail")
    assert got[0][1] == pytest.approx(0.21) and got[1][1:] == (None, "insufficient-endpoints")


def test_total_order(spark):
    data = [(None if n % 7 == 0 else dt.datetime(2024, 1, 1 + n % 5, n % 24), n) for n in range(200)]
    df = spark.createDataFrame(data, "t timestamp, i int").repartition(9)
    got = scale.total_order(df, F.col("t").cast("date"), ["t", "i"], "seq").orderBy("seq").collect()
    want = sorted(data, key=lambda r: (r[0] is not None, r[0] or dt.datetime.min, r[1]))
    assert [(r.t, r.i) for r in got] == want and [r.seq for r in got] == list(range(1, 201))


def test_covariances(spark):
    rng = np.random.default_rng(3)
    x, w = rng.normal(size=(40, 5)), rng.random(5)
    df = spark.createDataFrame([(d, a, float(x[d, a])) for d in range(40) for a in range(5)] + [(0, 9, 1.0)], "d int, a int, x double")
    weights = spark.createDataFrame([(a, float(w[a])) for a in range(5)] + [(9, 0.1)], "i int, w double")
    m = np.cov(x.T) @ w
    got = {r.i: r for r in risk.panel_contributions(df, weights, "d", "a", "x").collect()}
    assert got[9].status == "INCOMPLETE" and got[9].marginal is None
    for a in range(5):
        assert got[a].marginal == pytest.approx(m[a]) and got[a].component_vol == pytest.approx(w[a] * m[a] / math.sqrt(w @ m))
    cov = risk.covariance_coo(df.filter("a < 9"), "d", "a", "x").withColumn("k", F.lit(1))
    r = risk.psd_check(cov, "k").first()
    assert (r.n_assets, r.symmetric, r.psd) == (5, True, True) and r.min_eigenvalue == pytest.approx(np.linalg.eigvalsh(np.cov(x.T))[0])
    odd = cov.withColumn("v", F.when((F.col("i") == 0) & (F.col("j") == 1), F.lit(9.0)).otherwise(F.col("v")))
    indefinite = spark.createDataFrame([(1, 0, 0, 1.0), (1, 0, 1, 2.0), (1, 1, 0, 2.0), (1, 1, 1, 1.0), (2, 0, 0, 0.0)], "k int, i int, j int, v double")
    for df, want in ((odd, [(1, False, False)]), (odd.filter("i <> 2 or j <> 3"), [(1, False, False)]), (indefinite, [(1, True, False), (2, True, True)])):
        assert rows(risk.psd_check(df, "k"), "k", "symmetric", "psd") == want
        assert rows(risk.symmetry(df, "k"), "k", "symmetric") == [z[:2] for z in want]


def test_multi_exposure_residuals(spark):
    rng = np.random.default_rng(5)
    a = rng.normal(size=(3, 20, 3))
    a[2, :, 2] = 2 * a[2, :, 1]  # rank failure
    df = spark.createDataFrame([(s, i, *map(float, a[s, i])) for s in range(3) for i in range(20)], "s int, i int, y double, p double, q double")
    got = {(r.s, r.i): r.residual for r in factors.neutralize_many(df, ["s"], "i", "y", ["p", "q"]).collect()}
    for s in range(2):
        m = np.column_stack([np.ones(20), a[s, :, 1:]])
        want = a[s, :, 0] - m @ np.linalg.lstsq(m, a[s, :, 0], rcond=None)[0]
        assert [got[s, i] for i in range(20)] == pytest.approx(list(want))
    assert all(got[2, i] is None for i in range(20))


def test_infeasible_subsets(spark):
    schema = "g int, constraint_id string, coefficients map<string,double>, lower double, upper double"
    data = [(1, "a", {"x": 1.0}, 0.6, None), (1, "b", {"y": 1.0}, 0.6, None), (1, "c", {"x": 1.0, "y": 1.0}, None, 1.0), (1, "d", {"z": 1.0}, 0.0, 1.0), (2, "a", {"x": 1.0}, 0.5, None), (2, "b", {"x": 1.0}, None, 0.5), (3, "b", {"x": 1.0}, 2.0, 1.0), (3, "a", {"x": 1.0}, 0.0, 0.5)]
    assert rows(trading.infeasible_subsets(spark.createDataFrame(data, schema), "g")) == [(1, "a,b,c"), (2, None), (3, "b")]


def test_ledger_beside_a_plain_fold(spark):
    rng = random.Random(8)
    data = [(k, rng.choice("AB"), str(i), dt.datetime(2024, 1, 1 + rng.randrange(20)), rng.choice(["BUY", "BUY", "SELL"]), rng.randrange(1, 6), 2, float(rng.randrange(5, 15)), rng.random() < 0.1, rng.choice([None, 10.0])) for k in (1, 2) for i in range(40)]
    df = spark.createDataFrame(data, "k int, asset_id string, request_id string, executed_at timestamp, side string, lots_wanted int, lot int, price double, halted boolean, reference_price double")
    got = trading.ledger(df, "k", 200.0, 0.01, 0.3)
    assert trading.invariant_breaches(got).count() == 0
    want = []
    for k in (1, 2):
        cash, held = 200.0, {"A": 0, "B": 0}
        for _, a, i, _, side, lots, lot, price, halted, ref in sorted((r for r in data if r[0] == k), key=lambda r: (r[3], r[1], r[2])):
            n = 0
            if not halted and (ref is None or abs(price - ref) / ref <= 0.3):
                if side == "SELL":
                    n = lots * lot if lots * lot <= held[a] else 0
                    cash, held[a] = cash + n * price * 0.99, held[a] - n
                else:
                    while n < lots * lot and (n + lot) * price * 1.01 <= cash + 1e-9:
                        n += lot
                    cash, held[a] = cash - n * price * 1.01, held[a] + n
            want.append((k, i, n, round(cash, 6)))
    assert sorted((r.k, r.request_id, r.filled, round(r.cash_after, 6)) for r in got.collect()) == sorted(want)


def test_digests_do_not_depend_on_order(spark):
    df = spark.createDataFrame([(i % 2, hashlib.sha256(str(i).encode()).hexdigest()) for i in range(300)] * 2, "k int, h string")
    a = rows(scale.bucketed_digest(df, ["k"], "h", "d"))
    assert a == rows(scale.bucketed_digest(df.orderBy(F.rand(1)).repartition(5), ["k"], "h", "d")) and [r[1] for r in a] == [300, 300]
    assert a != rows(scale.bucketed_digest(df.limit(599), ["k"], "h", "d"))
    m = versions.manifest(df).first()
    assert m == versions.manifest(df.repartition(7)).first() and m.row_count == 600
    assert m != versions.manifest(df.limit(599)).first()


def test_large_tables_are_not_broadcast(spark):
    plan = lambda most: scale.broadcast_if_small(spark.range(50), most)._jdf.queryExecution().logical().toString()
    assert "broadcast" in plan(50) and "broadcast" not in plan(49)


def test_definition_errors():
    assert factors.definition_errors([], 0, [{"kind": "winsorize", "lower": 0.9, "upper": 0.1}, {"kind": "x"}] + [{"kind": "rank"}] * 40) == ["fields.count", "transformations.count", "transformations.kind", "transformations.winsorize", "window.range"]
    assert factors.definition_errors(["a", "a"], 1, []) == ["fields.names"]
    assert factors.definition_errors(["a"], 2520, [{"kind": "zscore"}]) == []


def test_path_conflicts(spark):
    paths = ["/a", "/a/", "/a/b", "/ab", "/a/b/c", "/x"]
    got = rows(temporal.path_conflicts(spark.createDataFrame(list(enumerate(paths)), "id int, p string"), "id", "p"))
    clean = [p.rstrip("/") for p in paths]
    want = [(i, j, "equal-path") for i, a in enumerate(clean) for j, b in enumerate(clean) if i < j and a == b]
    want += [(i, j, "ancestor-or-descendant") for i, a in enumerate(clean) for j, b in enumerate(clean) if b.startswith(a + "/")]
    assert got == sorted(want, key=str)


def test_asof_of_one_key_in_many_tasks(spark):
    """One hot key (and null keys, null times, ties) in ranges of time: the rows of the plain search, in many tasks."""
    rng = random.Random(7)
    facts = [(rng.choice(["hot"] * 9 + ["cold", None]), rng.choice([None] + list(range(400))), i) for i in range(600)]
    probes = [(i, rng.choice(["hot"] * 9 + ["cold", None]), rng.choice([None] + list(range(-5, 410)))) for i in range(600)]
    f, p = spark.createDataFrame(facts, "k string, at int, v int"), spark.createDataFrame(probes, "id int, k string, t int")
    low = lambda x: -(10**9) if x is None else x
    last = {i: max(((low(a), v) for g, a, v in facts if g == k and low(a) <= low(t)), default=(0, None))[1] for i, k, t in probes}
    later = {i: min((a for g, a, v in facts if g == k and a is not None and low(a) > low(t)), default=None) for i, k, t in probes}
    for n in (10**6, 50, 7):
        got = temporal.asof_join(p, f, ["k"], "t", "at", "v", ["v"], range_rows=n)
        assert {r.id: r.v for r in got.collect()} == last
        if n == 7:
            assert got.filter("k = 'hot'").select(F.spark_partition_id().alias("s")).distinct().count() > 4
        assert {r.id: r.n for r in temporal.next_event(p, f, ["k"], "t", "at", "n", range_rows=n).collect()} == later


def test_overlaps_of_intervals(spark):
    rng = random.Random(2)
    data = []
    for i in range(200):
        a = rng.randrange(120)
        e = rng.choice([None, a, a + rng.randrange(40), a - 3])
        data.append((rng.choice("AAB"), i, day(a), None if e is None else day(e)))
    far = dt.date(9999, 12, 31)
    want = sorted((k, i, j) for k, i, s, e in data for m, j, t, f in data if k == m and i < j and s <= (e or far) and t <= (f or far) and max(s, t) <= min(e or far, f or far))
    schema = "k string, id int, effective_from date, effective_to date"
    assert sorted(map(tuple, temporal.conflicts(spark.createDataFrame(data, schema), "k", "id").collect())) == want
    apart = spark.range(100_000).select(F.lit("one").alias("k"), "id", F.expr("date_add(date'1900-01-01', cast(3 * id as int))").alias("effective_from"), F.expr("date_add(date'1900-01-01', cast(3 * id + 2 as int))").alias("effective_to"))
    assert temporal.conflicts(apart, "k", "id").count() == 0


def test_few_intervals_of_a_key_are_not_cut(spark, monkeypatch):
    """Keys of few intervals, beside those of many and of none, make a row for each interval; all cut to blocks gives the same."""
    rng = random.Random(6)
    sizes = {None: 5, "one": 1, "some": temporal.FEW, "more": temporal.FEW + 1, "many": 3 * temporal.FEW}
    begins = [(k, i, rng.randrange(200)) for k, n in sizes.items() for i in range(n)]
    spans = [(k, rng.randrange(a, 240) if i % 7 else None, a) for k, i, a in begins]
    data = [(k, i, day(a), None if e is None else day(e)) for i, (k, e, a) in enumerate(spans)] + [("one", 999, None, day(3)), ("some", 998, day(9), day(2))]
    far = dt.date(9999, 12, 31)
    want = sorted((k, i, j) for k, i, s, e in data for m, j, t, f in data if k == m and k is not None and i < j and None not in (s, t) and s <= (e or far) and t <= (f or far) and max(s, t) <= min(e or far, f or far))
    df = spark.createDataFrame(data, "k string, id int, effective_from date, effective_to date")
    for few in (temporal.FEW, 0):
        monkeypatch.setattr(temporal, "FEW", few)
        assert sorted(map(tuple, temporal.conflicts(df, "k", "id").collect())) == want


@pytest.mark.parametrize("n", [1, 2, 17, 64])
def test_latest_available_input(spark, n):
    """Any mixture of late inputs, ties of dates and moments, against a plain search."""
    rng = random.Random(n)
    moment = lambda x: dt.datetime(2024, 1, 1) + dt.timedelta(hours=x)
    inputs = [(rng.choice("AB"), "f", day(rng.randrange(9)), moment(rng.randrange(12)), i, float(i)) for i in range(n)]
    asked = [(i, rng.choice("ABC"), "f", day(rng.randrange(-1, 10)), moment(rng.randrange(-1, 13))) for i in range(40)]
    i = spark.createDataFrame(inputs, "a string, field_name string, observation_date date, available_at timestamp, input_version_id int, value double")
    d = spark.createDataFrame(asked, "decision_id int, a string, field_name string, factor_date date, decision_at timestamp")
    got = {r.decision_id: r._best and tuple(r._best) for r in factors.latest_available(d, i, ["a", "field_name"]).collect()}
    assert got == {k: max(((x[2], x[3], x[4], x[5]) for x in inputs if x[0] == a and x[2] <= f and x[3] <= t), default=None) for k, a, _, f, t in asked}


def test_three_exposures_of_hot_and_small_sections(spark):
    rng = np.random.default_rng(11)
    data = [(s, i, *map(float, rng.normal(size=4) * [1, 1, 100, 1e-3] + [0, 5, 1e4, 0])) for s, n in ((1, 300), (2, 5), (3, 4), (None, 50)) for i in range(n)]
    df = spark.createDataFrame(data, "s int, i int, y double, p double, q double, r double")
    got = {(r.s, r.i): r.residual for r in factors.neutralize_many(df, ["s"], "i", "y", ["p", "q", "r"]).collect()}
    for s in (1, 2, None):
        m = np.array([x[2:] for x in data if x[0] == s])
        a = np.column_stack([np.ones(len(m)), m[:, 1:]])
        assert [got[s, i] for i in range(len(m))] == pytest.approx(list(m[:, 0] - a @ np.linalg.lstsq(a, m[:, 0], rcond=None)[0]), abs=1e-7)
    assert [got[3, i] for i in range(4)] == pytest.approx([0] * 4, abs=1e-7)  # as many rows as unknowns
    assert all(r.residual is None for r in factors.neutralize_many(df.filter("s = 3 and i < 3"), ["s"], "i", "y", ["p", "q", "r"]).collect())


def test_a_long_chain_of_ids_streams(spark):
    n = 60_000
    df = spark.range(1, n + 1).select(F.lit("k").alias("k"), F.col("id").cast("int").alias("revision_position"), F.col("id").cast("string").alias("cid")).unionByName(spark.createDataFrame([(None, 1, "x")], "k string, revision_position int, cid string"))
    last = versions.with_ids(df, "D", ["k"], "cid", "k").filter(f"revision_position = {n} or k is null").collect()
    before = ""
    for i in range(1, n + 1):
        before = hashlib.sha256(f"{hashlib.sha256(chr(31).join((before, 'D', 'k', str(i))).encode()).hexdigest()}\x1f{i}".encode()).hexdigest()
    assert {r.k: r.version_id for r in last}["k"] == before and len(last) == 2


def test_negative_scores_costs_of_splits_and_faulty_factors(spark):
    w = trading.score_weights(spark.createDataFrame([(1, "a", 3.0), (1, "b", -1.0), (2, "a", 1.0), (2, "b", 3.0), (3, "a", 0.0)], "g int, a string, s double"), ["g"], "a", "s")
    assert [(r.g, r.a, r.status, r.weight and float(r.weight)) for r in w.orderBy("g", "a").collect()] == [(1, "a", "negative-score", None), (1, "b", "negative-score", None), (2, "a", "ok", 0.25), (2, "b", "ok", 0.75), (3, "a", "undefined", None)]
    p = spark.createDataFrame([("x", day(0), 10, 6.0), ("y", day(0), 10, 6.0)], "a string, held_from date, quantity int, unit_cost double")
    e = spark.createDataFrame([("e", "x", day(1), 2.0), ("f", "x", day(3), 1.5)], "event_id string, a string, effective_date date, ratio double")
    got = {r.a: (r.adjusted_quantity, r.adjusted_cost) for r in trading.apply_actions(p, e, "a").collect()}
    assert got == {"x": (30.0, 2.0), "y": (10.0, 6.0)}
    prices = spark.createDataFrame([(a, day(i), 1.0) for a in "xy" for i in range(4)], "a string, d date, p double")
    f = spark.createDataFrame([("x", day(i), 2.0) for i in range(4)] + [("y", day(0), 1e13), ("y", day(1), 1.0), ("y", day(1), 1.0), ("y", day(3), 1.0)], "a string, d date, factor double")
    got = factors.adjust_prices(prices, f, "a", "d", "p", "backward").orderBy("a", "d").collect()
    assert [(r.status, r.fault) for r in got] == [("OK", None)] * 4 + [("REJECTED", x) for x in ("out-of-range", "repeated", "missing", None)]


def test_search_by_trigrams(spark):
    df = spark.createDataFrame([(1, "Harbour Light", "HL"), (2, "harbor", "LIGHT"), (3, None, "ab"), (4, "a light harbour", ""), (5, "lig ght igh", "x")], "id int, name string, symbol string")
    postings = query.trigrams(df, "id", ["name", "symbol"])
    for text in ("light", "Harbour", "ab", "ghT h", "zzz", " light "):
        plain, fast = (query.search(df, text, ["name", "symbol"], 50), query.search_indexed(df, postings, "id", text, ["name", "symbol"], 50))
        assert fast.collect() == plain.collect()
    assert sorted(r.id for r in query.candidates(df, postings, "id", "light").collect()) == [1, 2, 4, 5]  # 5 has all grams and not the text
