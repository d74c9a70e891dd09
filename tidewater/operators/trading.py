"""Market rules, costs, scheduling, the trade ledger, weights."""

from __future__ import annotations

from fractions import Fraction
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .linear import Unproven, portfolio, smallest_infeasible
from .scale import total_order
from .temporal import next_event, resolve_exactly_one


def lots(quantity: Column, lot: Column) -> Column:
    """Whole lots towards zero, sign kept."""
    return F.signum(quantity) * F.floor(F.abs(quantity) / lot) * lot


def tick_floor(price: Column, tick: Column) -> Column:
    """Down to a tick, in decimals."""
    p, t = price.cast("decimal(18,6)"), tick.cast("decimal(18,6)")
    return F.floor(p / t) * t


def outside_band(price: Column, reference: Column, pct: Column) -> Column:
    return F.abs(F.try_divide(price - reference, reference)) > pct


def rule_outcome() -> Column:
    """The first rule that stops a trade, or `fill`. Columns: profile_status, price, session_date, trade_date,
    has_session, lot_quantity, side, sellable, halt_status, market, reference_price, limit_pct, band_pct."""
    limit = F.when(F.col("market") == "A_SHARE", F.col("limit_pct")).otherwise(F.col("band_pct"))
    a = F.col("market") == "A_SHARE"
    return (
        F.when(F.col("profile_status") != "resolved", F.concat(F.lit("profile-"), F.col("profile_status")))
        .when(F.coalesce(F.col("price") <= 0, F.lit(True)), "invalid-price")
        .when(~F.col("has_session"), F.when(F.col("session_date").isNotNull(), F.concat(F.lit("deferred:"), F.col("session_date").cast("string"))).otherwise("session-not-permitted"))
        .when(F.col("lot_quantity") == 0, "invalid-lot")
        .when((F.col("side") == "SELL") & (F.col("lot_quantity") > F.col("sellable")), "sell-quantity-unavailable")
        .when(F.col("halt_status") != "ACTIVE", F.concat(F.lit("halt:"), F.col("halt_status")))
        .when(F.col("reference_price").isNull() | (F.col("reference_price") <= 0) | (a & limit.isNull()), "price-limit-source-missing")
        .when(~a & limit.isNull(), "provider-band-missing")
        .when(outside_band(F.col("price"), F.col("reference_price"), limit), F.when(a, "price-limit").otherwise("provider-price-band"))
        .otherwise("fill")
    )


def costs(gross: Column, commission: float, tax: float, platform: float, slippage: float, minimum: float) -> Column:
    """Struct of components; a shortfall to the minimum tops the commission up."""
    c = [gross * F.lit(r) for r in (commission, tax, platform, slippage)]
    total = c[0] + c[1] + c[2] + c[3]
    return F.struct((c[0] + F.greatest(F.lit(minimum) - total, F.lit(0.0))).alias("commission"), c[1].alias("tax"), c[2].alias("platform"), c[3].alias("slippage"), F.greatest(total, F.lit(minimum)).alias("total"))


def ledger(requests: DataFrame, key: str, cash: float, rate: float = 0.0, limit: float = 0.1) -> DataFrame:
    """The sequential fold of trades over cash and positions, one row per request, portfolios in parallel.

    requests: key, asset_id, request_id, executed_at, side, lots_wanted, lot, price, halted (boolean), reference_price.
    In order (executed_at, asset, request): no fill if halted, outside the band or selling more than held; a buy is cut
    to the most lots that cash pays for, costs included. Each portfolio's orders are one sorted group, as the fold is
    sequential in its cash; portfolios of more orders than a task holds are cut by date and carried on by the stream
    of the same name (streaming.jobs.running_ledger).
    """
    schema = f"{key} {requests.schema[key].dataType.simpleString()}, request_id string, filled long, cash_after double, position_after long, outcome string"

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["executed_at", "asset_id", "request_id"], kind="stable")
        money, held, out = cash, {}, []
        for r in pdf.itertuples(index=False):
            money, held[r.asset_id], filled, why = fill(money, held.get(r.asset_id, 0), r.side, int(r.lots_wanted), int(r.lot), float(r.price), bool(r.halted), r.reference_price, rate, limit)
            out.append((getattr(r, key), str(r.request_id), filled, money, held[r.asset_id], why))
        return pd.DataFrame(out, columns=[key, "request_id", "filled", "cash_after", "position_after", "outcome"])

    return requests.groupBy(key).applyInPandas(fold, schema)


def fill(money: float, held: int, side: str, want: int, lot: int, price: float, halted: bool, reference, rate: float, limit: float) -> tuple[float, int, int, str]:
    """One step: (cash, position, filled quantity, outcome)."""
    if halted:
        return money, held, 0, "halt"
    if reference is not None and not pd.isna(reference) and abs(price - reference) / reference > limit:
        return money, held, 0, "band"
    if side == "SELL":
        if want * lot > held:
            return money, held, 0, "sell-unavailable"
        n = want * lot
        return money + n * price * (1 - rate), held - n, n, "filled"
    unit = lot * price * (1 + rate)
    n = min(want, int(np.floor(money / unit + 1e-12))) * lot if unit > 0 else 0
    return (money - n * price * (1 + rate), held + n, n, "filled" if n == want * lot else "truncated") if n > 0 else (money, held, 0, "unaffordable")


def ledger_expr(requests: DataFrame, key: str, cash: float) -> DataFrame:
    """The cash-only part of the fold as one expression: final cash and positions where no sell is refused."""
    orders = F.array_sort(F.collect_list(F.struct("executed_at", "asset_id", "request_id", "side", "lots_wanted", "price")))
    step = lambda acc, x: F.struct(F.when(x["side"] == "SELL", acc["cash"] + x["lots_wanted"] * x["price"]).otherwise(acc["cash"] - F.least(x["lots_wanted"].cast("double"), F.floor(acc["cash"] / x["price"]).cast("double")) * x["price"]).alias("cash"), (acc["n"] + 1).alias("n"))
    return requests.groupBy(key).agg(F.aggregate(orders, F.struct(F.lit(float(cash)).alias("cash"), F.lit(0).alias("n")), step).alias("s")).select(key, F.col("s.cash").alias("final_cash"), F.col("s.n").alias("n_orders"))


def cash_settlement(fills: DataFrame, key: str, settles: str, amount: str) -> DataFrame:
    """Settled cash by day: the running sum of what is due until then."""
    by = fills.groupBy(key, settles).agg(F.sum(amount).alias("due"))
    return by.withColumn("settled_cash", F.sum("due").over(Window.partitionBy(key).orderBy(settles).rowsBetween(Window.unboundedPreceding, 0)))


def invariant_breaches(state: DataFrame) -> DataFrame:
    """Rows with negative cash or position: there must be none."""
    return state.filter((F.col("cash_after") < 0) | (F.col("position_after") < 0))


def weight_check(weights: DataFrame, key: str, asset: str, weight: str) -> DataFrame:
    g = weights.groupBy(key).agg(F.count("*").alias("n"), F.count_distinct(asset).alias("d"), F.min(weight).alias("lo"), F.sum(weight).alias("total"))
    return g.select(key, F.when(F.col("n") != F.col("d"), "duplicate-asset").when(F.col("lo") < 0, "negative-weight").when(F.abs(F.col("total") - 1) > 1e-12, "sum").otherwise("ok").alias("status"))


def score_weights(df: DataFrame, key: list[str], asset: str, score: str, places: int = 12) -> DataFrame:
    """Weights in proportion to scores, floored to `places` decimals; the residual goes to the largest (first asset on
    ties), so weights sum to exactly 1. Null scores drop out. status: ok, or, without weights, negative-score if a score of the
    section is below zero, undefined if they sum to zero."""
    every = Window.partitionBy(*key)
    unit = 10**places
    s = F.col(score).cast("double")
    ok = df.filter(F.col(score).isNotNull()).withColumn("_t", F.sum(s).over(every)).withColumn("status", F.when(F.min(s).over(every) < 0, "negative-score").when(F.col("_t") > 0, "ok").otherwise("undefined"))
    ok = ok.withColumn("_w", F.when(F.col("status") == "ok", F.floor(s / F.col("_t") * unit)))
    first = F.row_number().over(every.orderBy(F.col("_w").desc(), asset))
    w = F.col("_w") + F.when(first == 1, F.lit(unit) - F.sum("_w").over(every)).otherwise(0)
    return ok.withColumn("weight", (w / unit).cast("decimal(20,12)")).drop("_t", "_w")


def _exact(v) -> Fraction | None:
    """A number as it is written in decimals; None for null and for what is no number."""
    return None if v is None or not np.isfinite(float(v)) else Fraction(str(v))


@lru_cache(maxsize=65_536, typed=True)
def _written(v) -> Fraction:
    return Fraction(str(v))


def infeasible_subsets(rows: DataFrame, key: str) -> DataFrame:
    """The smallest subset (then first ids) of linear constraints without a solution, per group; null if feasible.

    rows: key, constraint_id, coefficients map<string,double>, lower, upper (nullable); rows that share an id in a group are one
    constraint. In exact rationals, groups in parallel (linear.smallest_infeasible); a group holds the constraints of one
    portfolio, tens of them.
    """
    bounds = [F.col(c).cast("string").cast("double").alias(c) if rows.schema[c].dataType.typeName() == "float" else F.col(c) for c in ("lower", "upper")]

    def first(group: pa.Scalar) -> str | None:
        sides: dict = {}
        for r in group.as_py():
            c = {e["key"]: _written(e["value"]) for e in r["c"] or ()}
            own = sides.setdefault(r["constraint_id"], [])
            if r["upper"] is not None and r["upper"] == r["upper"]:
                own.append((c, _written(r["upper"])))
            if r["lower"] is not None and r["lower"] == r["lower"]:
                own.append(({k: -v for k, v in c.items()}, -_written(r["lower"])))
        hit = smallest_infeasible(sides)
        return ",".join(hit) if hit else None

    @F.arrow_udf("string")
    def find(groups: pa.Array) -> pa.Array:
        return pa.array(map(first, groups), pa.string())

    one = F.struct("constraint_id", F.map_entries("coefficients").alias("c"), *bounds)
    return rows.groupBy(key).agg(F.collect_list(one).alias("_rows")).select(key, find("_rows").alias("subset"))


def target_weights(df: DataFrame, key: str, asset: str, score: str, cap: float, max_holdings: int = 10_000, group: str | None = None, lower: str | None = None, upper: str | None = None, current: str | None = None, cash: tuple[float, float] = (0.0, 1.0), turnover: float | None = None, penalty: float = 0.0) -> DataFrame:
    """Long-only weights that maximise sum(score * weight) - penalty * sum(|weight - current|), in exact rationals:

    weights and cash sum to 1, a weight is at most `cap`, cash lies in its bounds, each group's weights sum to between `lower`
    and `upper` (columns, equal within a group; null: none), at most max_holdings weights are above zero, and one-way turnover
    from the weights in `current` (null: none; what they leave is cash) is at most `turnover`. Of equal objectives the
    lexicographically greatest weights by asset, then cash, win.

    One row for each asset with a score, and one of a null asset for cash: weight, objective, status: OPTIMAL; INFEASIBLE if
    nothing satisfies all bounds, UNPROVEN if branch and bound ended before it knew the best (both without figures);
    INVALID if a lower bound is above its upper one or an asset stands twice. A held asset without a score is sold.
    Portfolios are solved in parallel, each in its own task.
    """
    kinds = {c: df.schema[c].dataType.simpleString() for c in (key, asset)}
    schema = f"{key} {kinds[key]}, {asset} {kinds[asset]}, weight double, objective double, status string"
    cols = {"_score": score, "_group": group, "_lower": lower, "_upper": upper, "_current": current}
    given = df.select(key, asset, *((F.col(c) if c else F.lit(None).cast("string" if n == "_group" else "double")).alias(n) for n, c in cols.items()))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(asset)
        rows = [(r[asset], r["_group"], *(_exact(r[c]) for c in ("_score", "_current", "_lower", "_upper"))) for r in pdf.to_dict("records")]
        used = [r for r in rows if r[2] is not None or (r[3] or 0) > 0]
        now = [r[3] or Fraction(0) for r in used]
        caps = [Fraction(str(cap)) if r[2] is not None else Fraction(0) for r in used]
        bounds = {g: (low or Fraction(0), Fraction(1) if high is None else high) for _, g, _, _, low, high in rows if g is not None}
        groups = [([i for i, r in enumerate(used) if r[1] == g], lo, hi) for g, (lo, hi) in bounds.items()]
        names, got, status = [r[0] for r in used], None, "OPTIMAL"
        if len(set(names)) < len(names) or any(lo > hi for _, lo, hi in groups):
            status = "INVALID"
        else:
            try:
                got = portfolio([r[2] or Fraction(0) for r in used], caps, now, groups, (Fraction(str(cash[0])), Fraction(str(cash[1]))), 1 - sum(now), max_holdings, None if turnover is None else Fraction(str(turnover)), Fraction(str(penalty)))
                status = "OPTIMAL" if got else "INFEASIBLE"
            except Unproven:
                status = "UNPROVEN"
        weights, value = ([float(w) for w in got[0]], float(got[1])) if got else ([None] * (len(names) + 1), None)
        return pd.DataFrame({key: [pdf[key].iloc[0]] * len(weights), asset: pd.Series([*names, None], dtype=object), "weight": pd.Series(weights, dtype=object), "objective": [value] * len(weights), "status": [status] * len(weights)})

    return given.groupBy(key).applyInPandas(solve, schema)


def affordable(cash: Column, price: Column, lot: Column, rate: float, minimum: float) -> Column:
    """The most whole lots that cash pays for when costs are max(rate * gross, minimum); 0 if not even one, or no price."""
    spend = F.least(cash / (1 + rate), cash - minimum)
    unit = F.when(price > 0, lot * price)
    return F.coalesce(F.greatest(F.floor(F.try_divide(spend, unit)), F.lit(0)) * lot, F.lit(0).cast("long"))


def request_violations(requests: DataFrame, inputs: DataFrame) -> DataFrame:
    """requests (request_id, asset_id, decision_at, requested_quantity, requested_price) with all their codes: a missing id, a
    quantity or price out of range, an input (request_id, available_at) that was not available at the decision, more than one
    decision for the asset on that date."""
    late = inputs.groupBy("request_id").agg(F.max("available_at").alias("_latest"))
    others = F.count("*").over(Window.partitionBy("asset_id", F.to_date("decision_at")))
    j = requests.withColumn("_same", others).join(late, "request_id", "left")
    checks = {
        "request_id.missing": F.coalesce(F.trim("request_id") == "", F.lit(True)),
        "requested_quantity.positive": F.coalesce(F.col("requested_quantity") <= 0, F.lit(True)),
        "requested_price.negative": F.coalesce(F.col("requested_price") < 0, F.lit(True)),
        "inputs.look_ahead": F.coalesce(F.col("_latest") > F.col("decision_at"), F.lit(False)),
        "decision.duplicate": F.col("_same") > 1,
    }
    return j.withColumn("codes", F.array_sort(F.array_compact(F.array(*[F.when(bad, F.lit(c)) for c, bad in checks.items()])))).drop("_same", "_latest")


#: What a backtest plan must pin.
PINS = ("experiment_id", "strategy_version_id", "data_snapshot_id", "universe_version_id", "portfolio_definition_version_id", "trading_calendar_version_id", "market_rule_profile_version_id", "fx_policy_version_id", "transaction_cost_model_version_id")


def missing_pins() -> Column:
    """The pins of PINS that are null or blank, sorted."""
    return F.array_sort(F.array_compact(F.array(*[F.when(F.coalesce(F.trim(c) == "", F.lit(True)), F.lit(c)) for c in PINS])))


def schedule(requests: DataFrame, rules: DataFrame, sessions: DataFrame) -> DataFrame:
    """Requests with the rule in force at their decision and the first regular session strictly after it, in the order of
    execution, asset and request.

    requests: request_id, asset_id, market, decision_at; rules: market, version_id, effective_from, effective_to; sessions:
    market, start_at, kind. status: scheduled, or rule-missing, rule-ambiguous, session-missing; seq numbers what is
    scheduled.
    """
    r = requests.withColumn("_on", F.to_date("decision_at"))
    found = resolve_exactly_one(r, ["request_id"], rules, ["market"], "_on", "version_id").select("request_id", F.col("status").alias("_rule"), F.col("resolved_id").alias("rule_version_id"))
    starts = sessions.filter("kind = 'regular'").select("market", "start_at")
    j = next_event(r.join(found, "request_id").drop("_on"), starts, ["market"], "decision_at", "start_at", "execution_at")
    status = F.when(F.col("_rule") != "resolved", F.concat(F.lit("rule-"), F.col("_rule"))).when(F.col("execution_at").isNull(), "session-missing").otherwise("scheduled")
    j = j.withColumn("status", status).drop("_rule")
    ready = total_order(j.filter("status = 'scheduled'"), F.to_date("execution_at"), ["execution_at", "asset_id", "request_id"], "seq")
    return ready.unionByName(j.filter("status <> 'scheduled'"), allowMissingColumns=True)


def cash_distributions(positions: DataFrame, actions: DataFrame, asset: str, withholding: float) -> DataFrame:
    """The credit of each cash distribution, once for each event and position held before its ex-date. positions: asset,
    held_from, quantity; actions: event_id, asset, ex_date, payment_date, per_share."""
    once = actions.groupBy("event_id", asset).agg(F.min(F.struct("ex_date", "payment_date", "per_share")).alias("_a")).select("event_id", asset, "_a.*")
    due = positions.join(once, asset).filter(F.col("held_from") < F.col("ex_date"))
    return due.groupBy(asset, "payment_date").agg(F.sum(F.col("quantity") * F.col("per_share") * (1 - withholding)).alias("credit"), F.count("*").alias("n_positions"))


def apply_actions(positions: DataFrame, actions: DataFrame, asset: str) -> DataFrame:
    """Positions after share-changing actions, each event once (of rows of one event the first), on positions held before
    its effective date; what a share cost is divided by what its quantity is multiplied by, so the position's whole cost
    stays (adjusted_cost is null where the ratio is not positive).
    positions: asset, held_from, quantity, unit_cost (may be absent); actions: event_id, asset, effective_date, ratio."""
    once = actions.groupBy("event_id").agg(F.min(F.struct(asset, "effective_date", "ratio")).alias("_a")).select("event_id", "_a.*")
    j = positions.join(once.select(asset, "effective_date", "ratio"), asset, "left").withColumn("_r", F.when(F.col("effective_date") > F.col("held_from"), F.col("ratio")).otherwise(1.0))
    cost = ["unit_cost"] if "unit_cost" in positions.columns else []
    out = j.groupBy(asset, "held_from", "quantity", *cost).agg(F.coalesce(F.product("_r"), F.lit(1.0)).alias("ratio"), F.count_if(F.col("_r") != 1).alias("n_events")).withColumn("adjusted_quantity", F.col("quantity") * F.col("ratio"))
    return out.withColumn("adjusted_cost", F.try_divide(F.col("unit_cost"), F.when(F.col("ratio") > 0, F.col("ratio")))) if cost else out


def optimise(df: DataFrame, key: str, asset: str, score: str, cap: float, max_holdings: int, group: str | None = None, group_cap: float = 1.0) -> DataFrame:
    """Long-only weights that maximise sum(score * weight) under a cap per asset, a number of holdings and, with `group`, a
    cap per group: the best scores (ties to the first asset) fill up in turn, first to what their group has left, then to
    what the whole has left. With caps on groups alone this greedy filling is exact; a number of holdings below what it
    would use keeps the first of them. Sections that cannot be filled get status INFEASIBLE.
    """
    section = Window.partitionBy(key)
    order = [F.col(score).desc(), F.col(asset)]
    before = lambda w: w.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    r = df.filter(F.col(score).isNotNull()).withColumn("_cap", F.lit(float(cap)))
    if group:
        used = F.coalesce(F.sum("_cap").over(before(Window.partitionBy(key, group))), F.lit(0.0))
        r = r.withColumn("_cap", F.greatest(F.least(F.lit(float(cap)), F.lit(float(group_cap)) - used), F.lit(0.0)))
    if not group:  # equal caps: the best scores are the best holdings
        r = r.withColumn("_cap", F.when(F.row_number().over(section.orderBy(*order)) <= max_holdings, F.col("_cap")).otherwise(0.0))
    left = 1.0 - F.coalesce(F.sum("_cap").over(before(section)), F.lit(0.0))
    r = r.withColumn("_w", F.greatest(F.least(F.col("_cap"), left), F.lit(0.0)))
    held = F.sum(F.when(F.col("_w") > 1e-12, 1).otherwise(0)).over(section)
    status = F.when(F.sum("_cap").over(section) < 1 - 1e-12, "INFEASIBLE").when(held > max_holdings, "COUNT-BINDS").otherwise("OPTIMAL")
    return r.withColumn("status", status).withColumn("weight", F.when(F.col("status") == "OPTIMAL", F.col("_w"))).drop("_w", "_cap")
