"""Interval, as-of, next-event and gap operators over dates and times.

Intervals are closed at both ends; a null end is open. Lookups never pick silently: the exactly-one resolution reports
missing, resolved or ambiguous.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scale import RANGE_ROWS, broadcast_if_small, carried


def contains(start: Column, end: Column, at: Column) -> Column:
    return (start <= at) & (end.isNull() | (at <= end))


def overlaps(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    far = F.lit("9999-12-31").cast("date")
    return F.greatest(start_a, start_b) <= F.least(F.coalesce(end_a, far), F.coalesce(end_b, far))


def interval_join(probes: DataFrame, spans: DataFrame, keys: list[str], at: str, start: str = "effective_from", end: str = "effective_to", how: str = "inner") -> DataFrame:
    """Equi-join on keys with the interval test as residual; Catalyst picks the join."""
    b = spans.select([F.col(k).alias(f"_{k}") for k in keys] + [c for c in spans.columns if c not in keys])
    on = [F.col(k) == F.col(f"_{k}") for k in keys] + [contains(F.col(start), F.col(end), F.col(at))]
    return probes.join(b, on, how).drop(*[f"_{k}" for k in keys])


def binned_interval_join(probes: DataFrame, spans: DataFrame, at: str, start: str = "effective_from", end: str = "effective_to") -> DataFrame:
    """Interval join without an equality key: spans are dealt to the months they touch, probes to theirs."""
    month = lambda c: F.year(c) * 12 + F.month(c)
    last = probes.agg(F.max(at).alias("_last"))
    binned = spans.crossJoin(F.broadcast(last)).withColumn("_bin", F.explode(F.sequence(month(F.col(start)), F.greatest(month(F.col(start)), month(F.least(F.coalesce(F.col(end), F.col("_last")), F.col("_last"))))))).drop("_last")
    return probes.withColumn("_bin", month(F.col(at))).join(binned, "_bin").filter(contains(F.col(start), F.col(end), F.col(at))).drop("_bin")


def resolve_exactly_one(probes: DataFrame, probe_keys: list[str], spans: DataFrame, keys: list[str], at: str, id_col: str, **names) -> DataFrame:
    """Per probe: status missing / resolved / ambiguous, the resolved id, and all matching ids in order."""
    j = interval_join(probes, spans, keys, at, how="left", **names)
    g = j.groupBy(*probe_keys).agg(F.count(id_col).alias("n_matches"), F.sort_array(F.collect_list(id_col)).alias("_ids"))
    status = F.when(F.col("n_matches") == 0, "missing").when(F.col("n_matches") == 1, "resolved").otherwise("ambiguous")
    return g.select(*probe_keys, "n_matches", status.alias("status"), F.when(F.col("n_matches") == 1, F.get("_ids", F.lit(0))).alias("resolved_id"), F.array_join(F.col("_ids").cast("array<string>"), ",").alias("candidate_ids"))


def latest_by(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The row of greatest order per key, by partial aggregation (no sort of the groups)."""
    cols = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def asof_join(probes: DataFrame, facts: DataFrame, keys: list[str], probe_at: str, fact_at: str, tie: str, value_cols: list[str], within_days: int | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Each probe with the last fact at or before it (greatest tie wins), null values if there is none.

    One union of both sides, scanned by key and range of time (scale.carried): linear in rows, and no key is one task.
    within_days keeps only facts that are at most so many days old (dates).
    """
    values = F.struct(*[F.col(c) for c in value_cols], F.col(fact_at).alias("_at"))
    f = facts.select(*keys, F.col(fact_at).alias("_t"), F.lit(0).alias("_side"), F.col(tie).alias("_tie"), values.alias("_v"), F.lit(None).cast(probes.select(F.struct("*")).schema[0].dataType).alias("_p"))
    p = probes.select(*keys, F.col(probe_at).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(facts.schema[tie].dataType).alias("_tie"), F.lit(None).cast(f.schema["_v"].dataType).alias("_v"), F.struct(*probes.columns).alias("_p"))
    got = carried(f.unionByName(p), keys, ["_t", "_side", "_tie"], "_v", "_v", range_rows=range_rows).filter("_side = 1")
    if within_days is not None:
        got = got.withColumn("_v", F.when(F.date_diff(F.col("_t"), F.col("_v._at")) <= within_days, F.col("_v")))
    return got.select("_p.*", *[F.col(f"_v.{c}").alias(c) for c in value_cols])


def scd2_lookup(df: DataFrame, probes: DataFrame, key: str, at: str, version: str) -> DataFrame:
    """The version in force: latest start, open-ended first, then the version id; nulls if none covers the day."""
    j = interval_join(probes, df, [key], at, how="left")
    w = Window.partitionBy(*probes.columns).orderBy(F.col("effective_from").desc_nulls_last(), F.col("effective_to").desc_nulls_first(), version)
    return j.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def number_days(days: DataFrame, day: str = "day") -> DataFrame:
    """Open days with their running number (a calendar is a small dimension: days, not rows)."""
    return days.select(day, F.row_number().over(Window.orderBy(day)).alias("idx"))


def open_index(calendar: DataFrame) -> DataFrame:
    """Every calendar day from the first open one to the last, with the number of the first open day at or after it."""
    ends = calendar.agg(F.min("day").alias("a"), F.max("day").alias("b"))
    every = ends.filter("a is not null").select(F.explode(F.sequence("a", "b")).alias("_day"))
    ahead = Window.orderBy(F.col("_day").desc()).rowsBetween(Window.unboundedPreceding, 0)  # a calendar: 366 days a year
    return every.join(calendar.select(F.col("day").alias("_open"), "idx"), F.col("_day") == F.col("_open"), "left").select("_day", F.min("idx").over(ahead).alias("_idx"), F.col("_open").isNotNull().alias("_is_open"))


def nth_open_day(probes: DataFrame, calendar: DataFrame, at: str, n: Column | int, out: str) -> DataFrame:
    """The n-th open day after the day `at` (n = 0: the first open day at or after it). calendar: day, idx (number_days())."""
    offset = n if isinstance(n, Column) else F.lit(n)
    first = calendar.agg(F.min("day").alias("_first"))
    clamped = probes.crossJoin(F.broadcast(first)).withColumn("_at", F.greatest(F.col(at), F.col("_first")))  # one row
    base = clamped.join(broadcast_if_small(open_index(calendar)), F.col("_at") == F.col("_day"), "left")
    early = F.col(at) < F.col("_first")
    want = F.when(F.col("_is_open") & ~early, F.col("_idx") + offset).when(offset == 0, F.col("_idx")).otherwise(F.col("_idx") + offset - 1)
    target = calendar.select(F.col("idx").alias("_target"), F.col("day").alias(out))
    got = base.withColumn("_want", F.when(F.col(at).isNotNull(), want)).join(broadcast_if_small(target), F.col("_want") == F.col("_target"), "left")
    return got.drop("_day", "_idx", "_is_open", "_first", "_at", "_want", "_target")


def within_open_days(df: DataFrame, calendar: DataFrame, earlier: str, later: str, most: int, out: str) -> DataFrame:
    """Whether at most `most` open days lie in (earlier, later]; null if a day is null. calendar: day, idx."""
    ends = calendar.agg(F.min("day").alias("_lo"), F.max("day").alias("_hi"))
    ahead = open_index(calendar)
    upto = broadcast_if_small(ahead.select("_day", (F.col("_idx") - F.when(F.col("_is_open"), 0).otherwise(1)).alias("_n")))
    n = df.crossJoin(F.broadcast(ends))  # one row
    for side, c in (("_x", earlier), ("_y", later)):
        clamped = F.least(F.greatest(F.col(c), F.col("_lo")), F.col("_hi"))
        n = n.withColumn("_at", clamped).join(upto.select(F.col("_day").alias("_at"), F.col("_n").alias(side)), "_at", "left").drop("_at")
        n = n.withColumn(side, F.when(F.col(c) < F.col("_lo"), 0).otherwise(F.col(side)))
    known = F.col(earlier).isNotNull() & F.col(later).isNotNull()
    return n.withColumn(out, F.when(known, F.col("_y") - F.col("_x") <= most)).drop("_x", "_y", "_lo", "_hi")


def next_permitted_date(probes: DataFrame, days: DataFrame, keys: list[str], at: str, permitted: str, out: str) -> DataFrame:
    """The first open day at or after `at` with a session of a permitted kind (an array column); null if there is none.

    days: keys, day, kind, sessions array<struct<kind>> (and more). One row for each day and kind of session meets one row
    for each probe and permitted kind in a window; the earliest day of a probe's kinds wins.
    """
    open_days = days.filter(F.col("kind").isin("full", "half")).select(*keys, "day", F.explode(F.array_distinct(F.transform("sessions", lambda s: s["kind"]))).alias("_kind")).distinct()
    numbered = probes.withColumn("_probe", F.struct(*probes.columns))
    asked = numbered.select(*keys, F.date_sub(F.col(at), 1).alias("_at"), F.explode(F.array_distinct(F.coalesce(permitted, F.array().cast("array<string>")))).alias("_kind"), "_probe").distinct()
    got = next_event(asked, open_days, [*keys, "_kind"], "_at", "day", "_next").groupBy("_probe").agg(F.min("_next").alias(out))
    return numbered.join(got, numbered["_probe"].eqNullSafe(got["_probe"]), "left").select(*[numbered[c] for c in probes.columns], out)


def sell_available(trades: DataFrame, calendar: DataFrame, at: str, rule: str, out: str) -> DataFrame:
    """When what is bought may be sold: on the trade's own date, or on the next open day after it, by the profile's rule."""
    later = nth_open_day(trades, calendar, at, 1, out)
    return later.withColumn(out, F.when(F.col(rule) == "SAME_MARKET_DATE", F.col(at)).otherwise(F.col(out)))


def next_event(probes: DataFrame, events: DataFrame, keys: list[str], probe_at: str, event_at: str, out: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The first event strictly after each probe, per key: the union of both, scanned by key and range of time from the latest
    backwards (scale.carried)."""
    p = probes.select(*keys, F.col(probe_at).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(events.schema[event_at].dataType).alias("_e"), F.struct(*probes.columns).alias("_p"))
    e = events.select(*keys, F.col(event_at).alias("_t"), F.lit(0).alias("_side"), F.col(event_at).alias("_e"), F.lit(None).cast(p.schema["_p"].dataType).alias("_p"))
    return carried(p.unionByName(e), keys, ["_t", "_side"], "_e", "_next", backwards=True, upto=-1, range_rows=range_rows).filter("_side = 1").select("_p.*", F.col("_next").alias(out))


def islands(df: DataFrame, keys: list[str], value: str, step: int | None = None) -> DataFrame:
    """Maximal runs of consecutive days (or, with step, of integers) per key: range_start, range_end, n_points. Without keys:
    of a dimension of days."""
    w = Window.partitionBy(*keys).orderBy(value)
    run = F.col(value) - F.row_number().over(w) if step else F.date_sub(F.col(value), F.row_number().over(w))
    return df.select(*keys, value).distinct().withColumn("_run", run).groupBy(*keys, "_run").agg(F.min(value).alias("range_start"), F.max(value).alias("range_end"), F.count("*").alias("n_points")).drop("_run")


def missing_ranges(expected: DataFrame, stored: DataFrame, keys: list[str], day: str) -> DataFrame:
    """Expected days that aren't stored, coalesced to maximal ranges of calendar days."""
    return islands(expected.join(stored, [*keys, day], "left_anti"), keys, day)


def source_gaps(spans: DataFrame, days: DataFrame, keys: list[str], day: str) -> DataFrame:
    """Requested days on which no interval holds though one starts earlier and one ends later; ranges of such days.

    A gap lies between the latest end so far and the next start. Gaps meet the runs of requested days (a small dimension)
    by the months that both touch; no key is spread over all days.
    """
    w = Window.partitionBy(*keys).orderBy("effective_from")
    far = F.lit("9999-12-31").cast("date")
    before = F.max(F.coalesce("effective_to", far)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    gaps = spans.select(*keys, "effective_from", "effective_to").withColumn("_before", before).filter(F.col("_before") < F.date_sub("effective_from", 1)).select(*keys, F.date_add("_before", 1).alias("_a"), F.date_sub("effective_from", 1).alias("_b"))
    runs = islands(days.select(day), [], day).select(F.col("range_start").alias("_s"), F.col("range_end").alias("_e"))
    ends = runs.agg(F.min("_s").alias("_lo"), F.max("_e").alias("_hi"))
    month = lambda c: F.year(c) * 12 + F.month(c)
    dealt = lambda df, a, b: df.withColumn("_bin", F.explode(F.sequence(month(a), month(b))))
    inside = gaps.crossJoin(F.broadcast(ends)).withColumn("_a", F.greatest("_a", "_lo")).withColumn("_b", F.least("_b", "_hi")).filter("_a <= _b").drop("_lo", "_hi")  # one row
    met = dealt(inside, F.col("_a"), F.col("_b")).join(broadcast_if_small(dealt(runs, F.col("_s"), F.col("_e"))), "_bin")
    start, end = F.greatest("_a", "_s"), F.least("_b", "_e")
    met = met.filter((start <= end) & (F.col("_bin") == month(start)))
    return met.select(*keys, start.alias("range_start"), end.alias("range_end"), (F.date_diff(end, start) + 1).cast("long").alias("n_points"))


def path_conflicts(paths: DataFrame, id_col: str, path: str, separator: str = "/") -> DataFrame:
    """Pairs of rows of which one's path is the other's (equal-path) or lies below it (ancestor-or-descendant), by an equality
    join of each path's ancestors with the paths. Short ancestors, which many paths share, are salted, and the few paths of
    that length stand in every salt; so no root is one key."""
    parts = F.split(F.regexp_replace(F.col(path), f"{separator}+$", ""), separator)
    p = paths.select(F.col(id_col).alias("_id"), F.array_join(parts, separator).alias("_path"), F.size(parts).alias("_n"), parts.alias("_parts"))
    ups = p.select(F.col("_id").alias("_below"), "_n", F.posexplode(F.transform(F.sequence(F.lit(1), F.col("_n")), lambda i: F.array_join(F.slice("_parts", 1, i), separator))).alias("_depth", "_path"))
    salts, shallow = 32, 3  # up to two parts below the root
    ups = ups.withColumn("_salt", F.when(F.col("_depth") < shallow, F.pmod(F.xxhash64("_below"), F.lit(salts))).otherwise(0).cast("int"))
    above = p.select(F.col("_id").alias("_above"), "_path", F.explode(F.when(F.col("_n") <= shallow, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))).alias("_salt"))
    j = ups.join(above, ["_path", "_salt"]).withColumn("_equal", F.col("_depth") + 1 == F.col("_n"))
    j = j.filter(F.when(F.col("_equal"), F.col("_above") < F.col("_below")).otherwise(F.col("_above") != F.col("_below")))
    return j.select(F.col("_above").alias("left_id"), F.col("_below").alias("right_id"), F.when(F.col("_equal"), "equal-path").otherwise("ancestor-or-descendant").alias("conflict"))


LEVELS = 22  # 2 ** 22 days from the year 0 reach beyond the year 9999


def _day(c: Column) -> Column:
    return F.unix_date(c) + 719528


def blocks_of(first: Column, last: Column) -> Column:
    """The fewest blocks (level, place), of 2 ** level days each, that make up the days first to last: two a level at most."""

    def at(level: Column) -> Column:
        size = F.call_function("shiftleft", F.lit(1).cast("long"), level)
        lo, hi = F.ceil(first / size).cast("long"), F.floor((last + 1) / size).cast("long")
        one = lambda there, place: F.when((lo < hi) & there, F.struct(level.alias("level"), place.alias("place")))
        return F.array(one(lo % 2 == 1, lo), one(hi % 2 == 1, hi - 1))

    return F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), at)))


FEW = 64  # intervals of a key that are compared with one another


def conflicts(spans: DataFrame, key: str, id_col: str, start: str = "effective_from", end: str = "effective_to") -> DataFrame:
    """Pairs of overlapping intervals of one key; an interval that ends before it begins overlaps none.

    Two intervals overlap if the later start lies in the other. A key of at most FEW intervals is joined with itself, a row for
    each interval. Of other keys each interval is cut into blocks of 2 ** level days, and each start is looked up in the blocks
    that hold it, one of each level that occurs: an equality join that meets each pair once and no other, so a key of any
    number of intervals that lie apart makes no pairs.
    """
    whole = spans.select(F.col(key).alias("_k"), F.col(id_col).alias("_id"), _day(F.col(start)).alias("_s"), _day(F.coalesce(F.col(end), F.lit("9999-12-31").cast("date"))).alias("_e")).filter("_s <= _e")
    large = whole.groupBy("_k").agg(F.count("*").alias("_n")).filter(F.col("_n") > FEW).select("_k")
    few, many = whole.join(large, "_k", "left_anti"), whole.join(large, "_k", "left_semi")
    later = (F.col("_sa") < F.col("_sc")) | ((F.col("_sa") == F.col("_sc")) & (F.col("_a") < F.col("_c")))

    near = few.select("_k", F.col("_id").alias("_a"), F.col("_s").alias("_sa"), F.col("_e").alias("_ea")).join(few.select("_k", F.col("_id").alias("_c"), F.col("_s").alias("_sc")), "_k")
    near = near.filter(later & (F.col("_sc") <= F.col("_ea")))

    held = many.select("_k", F.col("_id").alias("_a"), F.col("_s").alias("_sa"), F.explode(blocks_of(F.col("_s"), F.col("_e"))).alias("_b")).select("_k", "_a", "_sa", "_b.level", "_b.place")
    levels = held.agg(F.collect_set("level").alias("_levels"))  # one row, LEVELS values
    starts = many.crossJoin(F.broadcast(levels)).select("_k", F.col("_id").alias("_c"), F.col("_s").alias("_sc"), F.explode("_levels").alias("level"))
    starts = starts.withColumn("place", F.call_function("shiftright", F.col("_sc").cast("long"), F.col("level")))
    met = near.select("_k", "_a", "_c").unionByName(held.join(starts, ["_k", "level", "place"]).filter(later).select("_k", "_a", "_c"))
    return met.select(F.col("_k").alias(key), F.least("_a", "_c").alias("left_id"), F.greatest("_a", "_c").alias("right_id")).filter("left_id <> right_id")
