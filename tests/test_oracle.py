"""Queries against their SQL on the smallest tables: one per family in each run
of the suite, all of them with SIEVELAKE_ALL=1."""

import math
import os

import duckdb
import pandas as pd
import pytest
from sievelake import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = (
    "agg_field_stats", "agg_change_points", "agg_id_field", "agg_crushability", "sel_outlier_struct", "det_diff", "det_line_score", "det_secret", "ret_limit", "ret_raw_span",
    "ret_resolve_markers", "rel_bm25_corpus", "srch_within", "srch_items_text", "enc_iso", "enc_decimal", "enc_dict", "enc_affix", "enc_render", "sel_anchors", "sel_knee", "sel_dup_counts",
    "src_log_lines", "log_dedup", "grep_select", "src_diff", "diff_score", "dedup_exact", "dedup_near_rows", "join_superseded", "join_cascade", "st_breaker", "st_spill", "met_savings",
    "fn_dates", "src_csv_rows", "src_dominant_array", "stream_tumbling", "stream_sessions", "api_recovery",
)


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA:
        return None
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return str([plain(x) for x in v]) if isinstance(v, (list, tuple)) else v


def rows(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted(([plain(x) for x in r] for r in df.itertuples(index=False, name=None)), key=str)


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(plans.oracles()) if os.environ.get("SIEVELAKE_ALL") else SOME)
def test_matches_sql(spark, sf, con, name):
    got = plans.queries()[name](spark, sf).toPandas()
    assert rows(got) == rows(con.execute(plans.oracles()[name]).df())
