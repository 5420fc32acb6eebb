"""Queries against their SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from assaylake import plans

SF = "/root/testdata/sf0.001"
SOME = ["src_align_check", "sink_wide_pivot", "qc_match_cascade", "qc_sample_metrics", "ctl_delta", "ctl_match_report", "split_inner_regimes", "leak_split_audit", "frz_mu_ctx", "fe_oof_group_mean", "en_pareto_front", "gr_degree", "sim_tanimoto_max", "sim_domain_shift", "kb_complex_penalty", "fe_flagged_zero_fill", "tg_map_channels", "tx_absence_survey"]


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return float(v) if type(v).__name__ == "Decimal" else v


def _rows(rows):
    return sorted(([_plain(v) for v in r] for r in rows), key=str)


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    df = plans.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    res = con.execute(plans.ORACLE[name])
    at = [[c[0] for c in res.description].index(c) for c in cols]
    want = _rows([[r[i] for i in at] for r in res.fetchall()])
    assert str(_rows(df.select(*[f"`{c}`" for c in cols]).collect())) == str(want)


def test_every_query_with_sql_is_registered():
    assert set(plans.ORACLE) <= set(plans.QUERIES)
