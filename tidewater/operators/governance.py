"""Compliance profiles, provider capabilities, run requests and experiment manifests, as filters and joins over tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scale import bucketed_digest
from .temporal import latest_by

#: The states of a capability, and the bounds of request limits.
CAPABILITY_STATES = ("supported", "unsupported", "unknown")
REQUESTS_MAX, PERIOD_MAX = 1_000_000, 86_400
#: What a run request must name.
RUN_IDENTIFIERS = ("snapshot_id", "factor_definition_version", "universe_version", "portfolio_definition_version", "strategy_version", "transaction_cost_model_version", "risk_model_version")


def compliance_gate(requests: DataFrame, profiles: DataFrame) -> DataFrame:
    """requests (provider, category, request_at, action: use, retain or export) with the outcome: `allowed`, or the first
    reason against it. profiles: provider, version_id, position, effective_from, effective_to (timestamps), categories
    array<string>, retention and export map<string, boolean>; a provider's profile of greatest position is current."""
    now = latest_by(profiles, ["provider"], ["position"])
    j = requests.join(now, "provider", "left")
    at, category = F.col("request_at"), F.col("category")
    active = (F.col("effective_from") <= at) & (F.col("effective_to").isNull() | (at <= F.col("effective_to")))
    permits = lambda m: F.coalesce(F.try_element_at(m, category), F.lit(False))
    outcome = (
        F.when(F.col("version_id").isNull(), "compliance/profile-missing")
        .when(~F.coalesce(active, F.lit(False)), "compliance/profile-inactive")
        .when(~F.coalesce(F.array_contains("categories", category), F.lit(False)), "compliance/category-unsupported")
        .when((F.col("action") == "retain") & ~permits("retention"), "compliance/retention-prohibited")
        .when((F.col("action") == "export") & ~permits("export"), "compliance/export-prohibited")
        .otherwise("allowed")
    )
    return j.select(*requests.columns, "version_id", outcome.alias("outcome"))


def capability_violations(contract: str, states: tuple[str, ...] = CAPABILITY_STATES) -> Column:
    """Codes of adapters' declared capabilities (adapter_id, provider_name, contract_version, normalized_response,
    provenance, categorized_errors, max_requests_per_period, measurement_period_seconds, the last two null together where
    no limit is declared). Another contract version is no violation: see adapter_status()."""
    own = F.col("contract_version") == contract
    state = lambda c: (c, own & ~F.coalesce(F.col(c).isin(*states), F.lit(False)))
    limited = F.col("max_requests_per_period").isNotNull() | F.col("measurement_period_seconds").isNotNull()
    inside = F.coalesce(F.col("max_requests_per_period").between(1, REQUESTS_MAX) & F.col("measurement_period_seconds").between(1, PERIOD_MAX), F.lit(False))
    checks = [
        ("adapter_id", F.coalesce(F.col("adapter_id") == "", F.lit(True))),
        ("provider_name", F.coalesce(F.trim("provider_name") == "", F.lit(True))),
        state("normalized_response"),
        state("provenance"),
        state("categorized_errors"),
        ("request_limits", own & limited & ~inside),
    ]
    return F.array_sort(F.array_compact(F.array(*[F.when(bad, F.lit(code)) for code, bad in checks])))


def adapter_status(adapters: DataFrame, displayed: DataFrame, contract: str) -> DataFrame:
    """adapters with codes, incompatible_reason, and whether each may be enabled: it must have no violation, speak this
    contract and have been displayed (displayed: adapter_id)."""
    seen = displayed.select("adapter_id").distinct().withColumn("_seen", F.lit(True))
    j = adapters.join(seen, "adapter_id", "left").withColumn("codes", capability_violations(contract))
    other = F.when(F.col("contract_version") != contract, F.concat(F.lit("unsupported-contract-version:"), F.col("contract_version")))
    ready = (F.size("codes") == 0) & other.isNull() & F.col("_seen").isNotNull()
    return j.withColumn("incompatible_reason", other).withColumn("may_enable", ready).drop("_seen")


def run_request_codes(snapshots: list[str]) -> Column:
    """Sorted distinct codes of run requests: RUN_IDENTIFIERS, start_date, end_date, base_currency."""
    unnamed = F.lit(False)
    for c in RUN_IDENTIFIERS:
        unnamed = unnamed | F.coalesce(F.trim(c) == "", F.lit(True))
    checks = [
        ("version.missing", unnamed),
        ("snapshot.unavailable", F.coalesce(F.col("snapshot_id") != "", F.lit(False)) & ~F.col("snapshot_id").isin(snapshots)),
        ("date_range.invalid", F.coalesce(F.col("start_date") > F.col("end_date"), F.lit(True))),
        ("base_currency.invalid", ~F.coalesce(F.col("base_currency").rlike(r"^\p{L}{3}$"), F.lit(False))),
    ]
    return F.array_sort(F.array_compact(F.array(*[F.when(bad, F.lit(code)) for code, bad in checks])))


def experiment_manifest(artifacts: DataFrame, run: str, position: str, content: Column, seed: int) -> DataFrame:
    """Per run the number of artifacts and the manifest id: a digest of their names (run:position) and contents and of the
    seed, in any order of the rows."""
    if seed < 0:
        raise ValueError("experiment.seed")
    name = F.concat_ws(":", F.col(run).cast("string"), F.col(position).cast("string"))
    h = artifacts.select(run, F.sha2(F.concat_ws("|", name, F.sha2(content, 256)), 256).alias("_h"))
    m = bucketed_digest(h, [run], "_h", "_d")
    return m.select(run, F.col("row_count").alias("n_artifacts"), F.sha2(F.concat_ws("|", "_d", F.lit(str(seed))), 256).alias("manifest_id"))


def replay_check(recorded: DataFrame, recreated: DataFrame, run: str) -> DataFrame:
    """Runs of two manifests side by side: same, mismatch, or missing on a side."""
    a = recorded.select(run, F.col("manifest_id").alias("recorded_id"))
    b = recreated.select(run, F.col("manifest_id").alias("recreated_id"))
    status = F.when(F.col("recorded_id").isNull() | F.col("recreated_id").isNull(), "missing").when(F.col("recorded_id") == F.col("recreated_id"), "same").otherwise("mismatch")
    return a.join(b, run, "full").select(run, "recorded_id", "recreated_id", status.alias("status"))
