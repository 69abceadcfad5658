"""Spark plans vs their DuckDB twins on the sf0.001 tables (the same gate the
driver runs at sf0.01), for a representative query of every module."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as E
from agrolens.sources.fixtures import TABLES

FAST = ["grid_stats", "health_by_region", "component_terrain", "label_crop_suitability_rubber",
        "label_irrigation_need", "label_agricultural_gdp_forecast", "labels_all", "static_dynamic_join",
        "last_wins_join", "upsert", "coord_lookup", "contamination", "impute_two_level", "missing_report",
        "fallback_all", "fallback_labels", "crop_recommender", "risk_alerts", "alert_list", "backend_ranking",
        "region_rollup", "region_samples", "map_points", "clf_metrics", "reg_metrics", "bias_checks",
        "normalise_upload", "strict_validate", "region_inverse", "partitioned_roundtrip", "sample_weights",
        "split_summary",
        "incremental_ingest", "refresh"]


def _norm(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype == object:
            df[c] = df[c].astype(str)
        elif pd.api.types.is_numeric_dtype(df[c]) and not pd.api.types.is_bool_dtype(df[c]):
            df[c] = df[c].astype("float64")
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def test_every_query_has_a_builder_and_most_have_an_oracle():
    qs, orc = E.queries(), E.oracle_sql()
    assert set(orc) <= set(qs)
    assert len(orc) >= 0.85 * len(qs)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert set(df.columns) == {"region", "health_class", "n_grids", "mean_health"}
    assert df.count() > 0


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, sf, duck, name):
    got = _norm(E.queries()[name](spark, sf).toPandas())
    exp = _norm(duck.execute(E.oracle_sql()[name]).df())
    assert list(got.columns) == list(exp.columns)
    assert len(got) == len(exp)
    pd.testing.assert_frame_equal(got, exp, check_dtype=False, check_exact=True)
