"""Readers over landed payloads, stores over written tables, streams over files."""

import datetime as dt
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidewater.sources import connectors as C
from tidewater.sources import store
from tidewater.streaming import jobs

DAY = dt.date(2025, 1, 2)


@pytest.fixture
def landed(spark, tmp_path):
    """Payloads written as files, and read back."""

    def land(**payloads):
        for name, p in payloads.items():
            (tmp_path / f"{name}.json").write_text(json.dumps(p))
        return C.payloads(spark, str(tmp_path))

    return land


def bar(df):
    (r,) = df.collect()
    return r.provider_code, r.trading_date, *[str(r[c].normalize()) if r[c] is not None else None for c in C.BAR], r.trading_currency, r.codes


def test_stooq(spark, tmp_path):
    at = tmp_path / "a.csv"
    at.write_text("Symbol,Date,Open,High,Low,Close,Volume\nTIDE.US,2025-01-02,40.5,41.25,39.75,40.125,1234500\nTIDE.US,2025-01-03,1,2,0,x,-1\n")
    assert bar(C.stooq_csv(spark, str(at), "2025-01-02")) == ("TIDE.US", DAY, "40.5", "41.25", "39.75", "40.125", "1.2345E+6", "USD", [])
    assert bar(C.stooq_csv(spark, str(at), "2025-01-03"))[-1] == ["low.numeric", "close.numeric", "volume.numeric"]


def epoch(day):
    return int(dt.datetime(day.year, day.month, day.day, tzinfo=dt.timezone.utc).timestamp())


def test_chart(landed):
    days = [dt.date(2024, 12, 30), dt.date(2024, 12, 31), dt.date(2025, 1, 3)]
    quote = {"open": [1.0, 2.0, 3.0], "high": [1.5, 2.5, 3.5], "low": [0.5, 1.5, 2.5], "close": [1.2, 2.2, None], "volume": [10, 20, 30]}
    df = landed(x={"chart": {"result": [{"meta": {"symbol": "0700.HK", "currency": "HKD"}, "timestamp": list(map(epoch, days)), "indicators": {"quote": [quote]}}]}})
    assert bar(C.yahoo_chart(df, F.lit("2025-01-02"))) == ("0700.HK", days[1], "2", "2.5", "1.5", "2.2", "2E+1", "HKD", [])
    assert bar(C.yahoo_chart(df, F.lit("2025-01-03")))[-1] == ["close.numeric"]


def test_kline(landed):
    df = landed(**{"600000.SS": [{"day": "2025-01-01", "open": "1", "high": "1", "low": "1", "close": "1", "volume": "1"}, {"day": "2025-01-02", "open": "2", "high": "3", "low": "1", "close": "2.5", "volume": "7"}]})
    assert bar(C.sina_kline(df, F.lit("2025-01-02"))) == ("sh600000", DAY, "2", "3", "1", "2.5", "7", "CNY", [])


ROW = {"open": 1, "high": 3, "low": 0.5, "close": 2, "volume": 9}
WANT = ("A", DAY, "1", "3", "0.5", "2", "9", "USD", [])


@pytest.mark.parametrize(
    ("source", "payload"),
    [
        ("financial-modeling-prep", {"historical": [{"date": "2025-01-02", **ROW}]}),
        ("tiingo", [{"date": "2025-01-02T00:00:00.000Z", "adjOpen": 1, "adjHigh": 3, "adjLow": 0.5, "adjClose": 2, "adjVolume": 9}]),
        ("iex-cloud", [{"date": "20250102", **ROW}]),
        ("twelve-data", {"values": [{"datetime": "2025-01-02", **ROW}]}),
        ("polygon-io", {"results": [{"t": epoch(DAY) * 1000, "o": 1, "h": 3, "l": 0.5, "c": 2, "v": 9}]}),
    ],
)
def test_rest(landed, source, payload):
    assert bar(C.rest_bars(landed(A=payload), source)) == WANT


def test_other_payloads(landed):
    assert bar(C.alpha_vantage(landed(A={"Time Series (Daily)": {"2025-01-02": {"1. open": "1", "2. high": "3", "3. low": "0.5", "4. close": "2", "5. volume": "9"}}}))) == WANT
    assert bar(C.finnhub(landed(A={"t": [epoch(DAY)], "o": [1], "h": [3], "l": [0.5], "c": [2], "v": [9]}))) == WANT
    assert bar(C.nasdaq_table(landed(A={"datatable": {"data": [["2025-01-02", "1", "3", "0.5", "2", "9"]]}}))) == WANT
    assert bar(C.nasdaq_table(landed(A={"datatable": {"data": [["1", "3", "0.5", "2", "9"]]}}))) == ("A", None, *WANT[2:])
    assert bar(C.columnar_items(landed(A={"data": {"fields": ["ts_code", "trade_date", "open", "high", "low", "close", "vol"], "items": [["A", "20250102", "1", "3", "0.5", "2", "9"]]}})))[:7] == WANT[:7]
    (r,) = C.ecb_rates(landed(USD={"rates": {"2025-01-02": "1.03"}})).collect()
    assert (r.source_currency, r.target_currency, r.rate_date, float(r.rate)) == ("EUR", "USD", DAY, 1.03)


def test_facts(landed):
    (r,) = C.xbrl_fact(landed(A={"cik": 320193, "units": {"USD": [{"start": "2024-01-01", "end": "2024-12-31", "val": "5"}, {"val": "6"}]}}), "Assets").collect()
    assert (r.canonical_asset_id, r.metric_name, r.value, r.period_end) == ("SEC-EDGAR:320193", "us-gaap:Assets", Decimal(5), dt.date(2024, 12, 31))
    (r,) = C.last_observation(landed(A={"observations": [{"date": "2024-11-01", "value": "3"}, {"date": "2024-12-01", "value": "4.5"}]})).collect()
    assert (r.metric_name, r.period_end, float(r.value)) == ("A", dt.date(2024, 12, 1), 4.5)
    (r,) = C.announcement(landed(A={"result": [{"title": "no id"}, {"id": "7", "title": "Split"}]})).collect()
    assert (r.announcement_id, r.event_type) == ("7", "Split")


def test_frames_calendars_and_the_catalogue(spark):
    import pandas as pd

    pdf = pd.DataFrame({"code": ["A"], "date": [DAY], "open": [1.0], "high": [3.0], "low": [0.5], "close": [2.0], "volume": [9.0]})
    assert bar(C.data_frame_source(spark, pdf, "akshare", "USD")) == WANT
    days = spark.createDataFrame([("XNYS", DAY), ("XNYS", DAY), ("XNYS", dt.date(2025, 1, 3)), ("XHKG", DAY)], "code string, day date")
    got = {r.market: r for r in C.calendar_source(days, "exchange_calendars").collect()}
    assert [d.date for d in got["XNYS"].days] == [DAY, dt.date(2025, 1, 3)] and got["XHKG"].effective_to == DAY
    week = C.weekday_calendar(spark, "2024-01-01", "2024-01-14", ["A", "B"])
    assert week.count() == 20 and {r.day.isoweekday() for r in week.collect()} == {1, 2, 3, 4, 5}
    rows = C.catalogue(spark).collect()
    assert len(rows) == 20 and all(r.executable and r.request_fields for r in rows)


def test_bounded_history_does_not_depend_on_partitions(spark):
    rows = [("A", dt.date(2025, 1, 1 + i // 2), i) for i in range(20)]
    df = spark.createDataFrame(rows, "code string, trading_date date, v int")
    for n in (1, 7):
        got = C.bounded_history(df.repartition(n, "v"), ["code"], "2025-01-02", "2025-01-08", 3).collect()
        assert [(r.trading_date.day, r.v) for r in got] == [(6, 10), (7, 12), (8, 14)]


def test_content_store(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, v string")
    path, cid = store.publish(df, str(tmp_path))
    assert store.publish(df.orderBy(F.desc("id")), str(tmp_path)) == (path, cid)
    assert store.publish(df.limit(1), str(tmp_path))[1] != cid
    assert sorted(map(tuple, store.read(spark, str(tmp_path), cid).collect())) == [(1, "a"), (2, None)]
    for part in (tmp_path / cid[:2] / f"{cid}.parquet").iterdir():
        part.unlink()  # a write that failed: an empty folder, or parts without _SUCCESS
    store.publish(df, str(tmp_path))
    assert store.read(spark, str(tmp_path), cid).count() == 2
    df.limit(1).write.mode("overwrite").parquet(path)
    with pytest.raises(ValueError, match="content.mismatch"):
        store.read(spark, str(tmp_path), cid)


def test_append_new(spark, tmp_path):
    at = str(tmp_path / "t")
    one = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c")], "id long, v string")
    assert store.append_new(spark, one, at, ["id"]) == 2
    assert store.append_new(spark, one.union(spark.createDataFrame([(3, "d")], "id long, v string")), at, ["id"]) == 1
    assert sorted(map(tuple, spark.read.parquet(at).collect())) == [(1, "a"), (2, "c"), (3, "d")]


def members(spark, *rows):
    return spark.createDataFrame([(i, "u", a, DAY, None, "s", "1") for i, a in rows], "membership_id string, universe_version string, canonical_asset_id string, effective_from date, effective_to date, membership_source string, source_version string")


def test_membership_store(spark, tmp_path):
    at = str(tmp_path / "m")
    assert store.add_memberships(spark, members(spark, ("2", "B"), ("1", "B2"), ("0", "A")), at) == 3
    assert [r.membership_id for r in store.list_memberships(spark, at).collect()] == ["0", "2", "1"]
    with pytest.raises(store.StoreConflict) as e:
        store.add_memberships(spark, members(spark, ("2", "C"), ("9", "D"), ("9", "E")), at)
    assert e.value.conflicts == [("universe/membership-conflict", "2"), ("universe/membership-conflict", "9")]
    assert store.stored(spark, at).count() == 3


def test_factor_store(spark, tmp_path):
    at, schema = str(tmp_path / "d"), "definition_id string, version_id string"
    assert store.add_definitions(spark, spark.createDataFrame([("f", "1"), ("g", "1")], schema), at) == 2
    assert store.add_definitions(spark, spark.createDataFrame([("f", "1"), ("h", "1")], schema), at) == 1
    with pytest.raises(store.StoreConflict, match="factor/definition-conflict f"):
        store.add_definitions(spark, spark.createDataFrame([("f", "2"), ("i", "1")], schema), at)
    v = spark.createDataFrame([("f", DAY, "A", 1.0), ("g", DAY, "A", 2.0)], "definition_id string, factor_date date, canonical_asset_id string, value double")
    assert store.add_values(spark, v, str(tmp_path / "v")) == 2
    assert store.add_values(spark, v, str(tmp_path / "v")) == 0
    assert [r.value_id for r in store.values_of(spark, str(tmp_path / "v"), "f").collect()] == ["f:2025-01-02:A"]


def test_backup(spark, tmp_path):
    df = spark.createDataFrame([("a", "v1"), ("b", "v2"), ("a", "v1")], "r string, v string")
    m = store.backup_manifest(df, "bars", "r", "v")
    row = m.first()
    assert (row.dataset, row.record_count, row.versions) == ("bars", 3, ["v1", "v2"])
    assert store.verify_backup(m, df.orderBy(F.desc("r")), "bars", "r", "v") == 3
    for other in (df.limit(2), df.withColumn("r", F.lit("a"))):
        with pytest.raises(ValueError, match="backup.mismatch bars"):
            store.verify_backup(m, other, "bars", "r", "v")
    store.json_sink(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 3


def run_stream(spark, tmp_path, build, schema, batches):
    """Each batch is a file and a run over what is new; what the stream gave, all batches together."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = build(source).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).format("parquet").option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
    return spark.read.parquet(str(tmp_path / "out")).collect()


def at(minute):
    return dt.datetime(2025, 1, 2, 12) + dt.timedelta(minutes=minute)


def test_increments_stream(spark, tmp_path):
    got = run_stream(spark, tmp_path, lambda s: jobs.increments(s, "cid", "ts", "1 hour"), "cid string, ts timestamp", [[("a", at(0)), ("b", at(1)), ("a", at(2))], [("b", at(3)), ("c", at(4))]])
    assert sorted(r.cid for r in got) == ["a", "b", "c"]


def test_windowed_stream(spark, tmp_path):
    batches = [[("a", at(1), 1.0), ("a", at(2), 2.0)], [("a", at(60), 5.0)], [("a", at(3), 100.0), ("a", at(120), 7.0)], [("a", at(240), 0.0)]]
    got = run_stream(spark, tmp_path, lambda s: jobs.windowed_observations(s, "ts", "10 minutes", "30 minutes", "k", "v"), "k string, ts timestamp, v double", batches)
    assert sorted((r.window_start.hour, r.n, r.total) for r in got)[:2] == [(12, 2, 3.0), (13, 1, 5.0)]  # the late row counts nowhere


def test_late_rows_are_evidence(spark, tmp_path):
    """Rows on both sides of what their key has reached, less the delay; the other key's clock has no say."""
    batches = [[("a", at(60), 1.0), ("b", at(0), 1.0)], [("a", at(50), 2.0), ("a", at(49), 3.0), ("b", at(5), 2.0), ("a", None, 9.0)], [("a", at(300), 4.0), ("a", at(51), 5.0)], [("a", at(289), 6.0), ("a", at(290), 7.0)]]
    got = run_stream(spark, tmp_path, lambda s: jobs.screened(s, "k", "ts", "10 minutes"), "k string, ts timestamp, v double", batches)
    assert sorted((r.k, r.v, r.status, r.reached) for r in got if r.k == "a") == [("a", 1.0, "on-time", None), ("a", 2.0, "on-time", at(60)), ("a", 3.0, "late", at(60)), ("a", 4.0, "on-time", at(60)), ("a", 5.0, "on-time", at(60)), ("a", 6.0, "late", at(300)), ("a", 7.0, "on-time", at(300)), ("a", 9.0, "on-time", at(60))]
    assert [r.status for r in got if r.k == "b"] == ["on-time"] * 2


def test_a_stream_publishes_each_batch_once(spark, tmp_path):
    path, schema = str(tmp_path / "chain"), "k string, ts timestamp, v string"
    batches = [[("x", at(0), "a"), ("x", at(1), "a"), ("x", at(2), None), ("y", at(0), None)], [("x", at(3), None), ("x", at(4), "b"), ("y", at(1), None)], [("x", at(5), "b")], [("y", at(9), "c"), (None, at(9), "n")]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        q = jobs.publish_stream(source, path, str(tmp_path / "cp"), ["k"], ["ts"], "v").trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None

    def chain():
        return sorted(((r.k, r.revision_position, r.v, r.predecessor_content) for r in spark.read.parquet(path).collect()), key=str)

    want = [(None, 1, "n", None), ("x", 1, "a", None), ("x", 2, None, "a"), ("x", 3, "b", None), ("y", 1, None, None), ("y", 2, "c", None)]
    assert chain() == sorted(want, key=str)
    for n in (1, 3, 2):  # a replay
        jobs.publish_batch(spark.createDataFrame(batches[n], schema), n, path, ["k"], ["ts"], "v")
        assert chain() == sorted(want, key=str)


def test_ledger_stream(spark, tmp_path):
    schema = "p string, asset_id string, request_id string, executed_at timestamp, side string, lots_wanted long, lot long, price double, halted boolean, reference_price double"
    batches = [[("x", "A", "1", at(0), "BUY", 5, 1, 10.0, False, None)], [("x", "A", "2", at(1), "BUY", 9, 1, 10.0, False, None), ("x", "A", "3", at(2), "SELL", 99, 1, 10.0, False, None), ("x", "A", "4", at(3), "SELL", 2, 1, 10.0, True, None)]]
    got = run_stream(spark, tmp_path, lambda s: jobs.running_ledger(s, "p", 100.0), schema, batches)
    assert sorted((r.request_id, r.filled, r.cash_after, r.outcome) for r in got) == [("1", 5, 50.0, "filled"), ("2", 5, 0.0, "truncated"), ("3", 0, 0.0, "sell-unavailable"), ("4", 0, 0.0, "halt")]
