"""Registration of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register a function (spark, folder) -> DataFrame under a name, with the SQL that gives the same rows."""

    def add(f: Callable) -> Callable:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


#: Columns that are int in Spark and would be BIGINT in DuckDB, by query; "seed view" for those that only have these.
INTS = {
    "S05_fingerprint": "file_size", "B01_states": "n", "B08_declared_size": "n", "B16_log_softmax": "seed view class", "E03_uniform_fusion": "seed class", "E04_weighted_fusion": "seed class",
    "B16_log_softmax_seeds": "seed view class", "E03_uniform_fusion_seeds": "seed class", "E04_weighted_fusion_seeds": "seed class",
    "A14_confusion": "seed view label predicted", "A15_per_class": "seed view label", "A28_equal_class_moments": "dim", "B15_z_scores": "dim", "W02_capped_reference": "rank", "W02_reference_128": "rank", "W01_hash_rank": "rank",
    "J03_canonical_order": "ordinal", "W05_evenly_spaced": "rank_index", "C01_class_index": "class_index", "S11_S12_S13_month_dataset": "class_index", "S15_episode_labels": "episode_label",
    **dict.fromkeys(("B17_argmax", "A16_A17_A18_summary", "A18_bins", "A21_balanced_loss", "E06_quality_weights", "E07_quality_drift_weights", "J16_complete_cells"), "seed view"),
    **dict.fromkeys(("P10_confidence_bin", "E08_forecast", "E10_residuals", "E24_A33_uncertainty", "A34_summaries"), "view"),
    **dict.fromkeys(("A22_fixed_support_f1", "A23_mean_and_worst", "W08_worst_months", "V01_strata", "V02_retained_status", "J04_aligned_views", "V08_V14_readback", "V16_package", "K09_K10_long_tables", "V06_point_evaluator", "W09_view_order"), "seed"),
    "V07_single_view_families": "seed view label", "A19_A20_second_metrics": "seed view", "E08_E10_forecast_seeds": "seed view", "S11_S12_S13_image_dataset": "class_index",
}


def typed(name: str) -> str:
    """The SQL of a query with the column types of its DataFrame."""
    if name not in INTS:
        return SQL[name]
    casts = ", ".join(f"{c}::INTEGER AS {c}" for c in INTS[name].split())
    return f"SELECT * REPLACE ({casts}) FROM ({SQL[name]})"


#: SQL spellings shared by the queries.
B = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"


def clean(c: str) -> str:
    return f"lower(trim({c}, {B}))"


def instant(c: str) -> str:
    t = f"trim({c}, {B})"
    return f"(CASE WHEN regexp_matches({t}, '(Z|[+-][0-9][0-9]:[0-9][0-9])$') THEN {t} ELSE {t} || 'Z' END)::TIMESTAMPTZ"


def month(c: str) -> str:
    return f"strftime(({instant(c)}) AT TIME ZONE 'UTC', '%Y-%m')"
