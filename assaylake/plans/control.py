"""Control matching, Delta and its audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from assaylake.functions import fixtures as fx
from assaylake.functions.fixtures import level_sql, sql
from assaylake.functions.scratch import written
from assaylake.model import CONTROL_LEVELS, r6
from assaylake.operators import matching, metrics, ranks
from assaylake.plans.common import PCC_SQL, delta, normalised, treated
from assaylake.plans.registry import query, r


@query("ctl_index", sql(f"SELECT level, key, feature_id, {r('control')} AS control, n_controls FROM ctl_index"))
def ctl_index(s, d):
    """All levels, the global one too, whose profiles have the cells of every control: medians from counted ranks."""
    at = matching.exploded(fx.samples(s, d).where("role = 'control'"), CONTROL_LEVELS).join(normalised(s, d), "sample_id")
    x = ranks.value_ranks(at, "value", "level", "key", "feature_id")
    return ranks.percentiles(x, "value", [0.5], "level", "key", "feature_id").select("level", "key", "feature_id", r6(F.col("q")[0]).alias("control"), F.col("n").alias("n_controls"))


@query("ctl_match", sql("SELECT sample_id, level, key FROM matched"))
def ctl_match(s, d):
    x = fx.samples(s, d)
    return matching.match(x.where("role = 'treatment'"), x.where("role = 'control'"))


@query("ctl_delta", sql(f"SELECT sample_id, feature_id, {r('value')} AS value, level FROM delta"))
def ctl_delta(s, d):
    return delta(s, d).select("sample_id", "feature_id", r6("value").alias("value"), "level")


@query("ctl_anchor_pools", sql(f"""SELECT cohort, m.level AS level, count(*) AS n_cells, count(DISTINCT sample_id) AS n_samples, {r('avg(control)')} AS mean_control FROM matched m JOIN ctl_index i USING (level, key) JOIN samples USING (sample_id) GROUP BY ALL"""))
def ctl_anchor_pools(s, d):
    x = fx.samples(s, d)
    both = x.where("role = 'control' AND cohort = 'test'").unionByName(x.where("role = 'control' AND cohort <> 'test'"))
    m = matching.match(treated(s, d), both)
    a = m.join(matching.control_index(normalised(s, d), both, used=m), ["level", "key"]).join(x.select("sample_id", "cohort"), "sample_id")
    return a.groupBy("cohort", "level").agg(F.count("*").alias("n_cells"), F.countDistinct("sample_id").alias("n_samples"), r6(F.avg("control")).alias("mean_control"))


@query("ctl_match_report", sql(f"SELECT sample_id, level, count(*) AS n_observed, {r('count(*) / (SELECT count(*) FROM features)')} AS frac_observed FROM delta GROUP BY 1, 2"))
def ctl_match_report(s, d):
    nf = fx.features(s, d).agg(F.count("*").alias("nf"))
    return delta(s, d).groupBy("sample_id", "level").agg(F.count("*").alias("n_observed")).join(F.broadcast(nf)).select("sample_id", "level", "n_observed", r6(F.col("n_observed") / F.col("nf")).alias("frac_observed"))


@query("ctl_level_distribution", sql("SELECT cohort, level, count(*) AS n FROM matched JOIN samples USING (sample_id) GROUP BY 1, 2"))
def ctl_level_distribution(s, d):
    x = fx.samples(s, d)
    return matching.match(x.where("role = 'treatment'"), x.where("role = 'control'")).join(x.select("sample_id", "cohort"), "sample_id").groupBy("cohort", "level").agg(F.count("*").alias("n"))


def _variant(name: str, agg: str, where: str) -> str:
    lk = level_sql(CONTROL_LEVELS)
    return f"""{name}_pool AS (SELECT sample_id, unnest({lk}) AS lk FROM samples WHERE role = 'control' AND {where}),
{name}_m AS (SELECT sample_id, min(lk.level) AS level, arg_min(lk.key, lk.level) AS key FROM trt JOIN (SELECT DISTINCT lk.level AS level, lk.key AS key FROM {name}_pool) c ON c.level = lk.level AND c.key = lk.key GROUP BY 1),
{name}_i AS (SELECT lk.level AS level, lk.key AS key, feature_id, {agg}(value) AS control FROM {name}_pool JOIN y USING (sample_id) GROUP BY ALL),
{name} AS (SELECT sample_id, feature_id, y.value - control AS value FROM {name}_m JOIN y USING (sample_id) JOIN {name}_i USING (level, key, feature_id))"""


@query("ctl_vehicle_sensitivity", sql(f"SELECT {r('quantile_cont(pcc, 0.05)')} AS q05, {r('median(pcc)')} AS med, {r('quantile_cont(pcc, 0.95)')} AS q95, count(pcc) AS n FROM (SELECT sample_id, {PCC_SQL} AS pcc FROM (SELECT a.sample_id, a.value AS t, b.value AS p FROM delta a JOIN veh b USING (sample_id, feature_id)) GROUP BY 1 HAVING count(*) > 15)", _variant("veh", "median", "compound = 'DMSO'")))
def ctl_vehicle_sensitivity(s, d):
    x = fx.samples(s, d)
    only = matching.delta(normalised(s, d), x, pool=x.where("role = 'control' AND compound = 'DMSO'"))
    both = delta(s, d).select("sample_id", "feature_id", F.col("value").alias("t")).join(only.select("sample_id", "feature_id", F.col("value").alias("p")), ["sample_id", "feature_id"])
    per = both.groupBy("sample_id").agg(*metrics.moment_aggregates()).where("n > 15").select(metrics.pcc().alias("pcc"))
    q = F.percentile("pcc", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    return per.agg(r6(q[0]).alias("q05"), r6(q[1]).alias("med"), r6(q[2]).alias("q95"), F.count("pcc").alias("n"))


@query("ctl_agg_sensitivity", sql(f"SELECT {r('median(abs(t - p))')} AS median_diff, {r('quantile_cont(abs(t - p), 0.95)')} AS q95_diff, {r(PCC_SQL)} AS pcc FROM (SELECT a.value AS t, b.value AS p FROM delta a JOIN mea b USING (sample_id, feature_id))", _variant("mea", "avg", "true")))
def ctl_agg_sensitivity(s, d):
    mean = delta(s, d, agg=F.avg).select("sample_id", "feature_id", F.col("value").alias("p"))
    both = delta(s, d).select("sample_id", "feature_id", F.col("value").alias("t")).join(mean, ["sample_id", "feature_id"])
    both = written(both.select("t", "p", F.abs(F.col("t") - F.col("p")).alias("diff")), "both-deltas")
    q = ranks.percentiles(ranks.value_ranks(both, "diff"), "diff", [0.5, 0.95]).select("q")
    return both.agg(*metrics.moment_aggregates()).crossJoin(q).select(r6(F.col("q")[0]).alias("median_diff"), r6(F.col("q")[1]).alias("q95_diff"), r6(metrics.pcc()).alias("pcc"))


_PCT = [0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]


@query("stat_delta_distribution", sql(f"SELECT {r('avg(value)')} AS mean_v, {r('median(value)')} AS median_v, {r('stddev_pop(value)')} AS sd_v, {r('mad(value)')} AS mad_v, {r('avg(CASE WHEN abs(value) > 1 THEN 1.0 ELSE 0.0 END)')} AS frac_strong, " + ", ".join(f"{r(f'quantile_cont(value, {p})')} AS p{i}" for i, p in enumerate(_PCT)) + " FROM delta"))
def stat_delta_distribution(s, d):
    """From ranks that are counted over ranges of values: no task has all of them."""
    x = ranks.value_ranks(delta(s, d), "value")
    one = ranks.percentiles(x, "value", _PCT).crossJoin(ranks.moments(x, "value").select("mean", "sd"))
    strong = x.agg((F.sum(F.when(F.abs("value") > 1, F.col("n")).otherwise(0)) / F.sum("n")).alias("fs"))
    away = x.crossJoin(F.broadcast(one.select(F.col("q")[4].alias("med")))).select(F.abs(F.col("value") - F.col("med")).alias("away"), "n")
    mad = ranks.percentiles(ranks.value_ranks(away, "away", times="n"), "away", [0.5]).select(F.col("q")[0].alias("mad"))
    return one.crossJoin(strong).crossJoin(mad).select(r6("mean").alias("mean_v"), r6(F.col("q")[4]).alias("median_v"), r6("sd").alias("sd_v"), r6("mad").alias("mad_v"), r6("fs").alias("frac_strong"), *[r6(F.col("q")[i]).alias(f"p{i}") for i in range(len(_PCT))])


@query("stat_compound_effect", sql(f"SELECT compound, count(*) AS n, {r('median(abs(value))')} AS median_abs, {r('avg(CASE WHEN abs(value) > 1 THEN 1.0 ELSE 0.0 END)')} AS frac_strong, {r('stddev_pop(value)')} AS sd_v FROM delta JOIN samples USING (sample_id) GROUP BY 1 HAVING count(*) >= 100"))
def stat_compound_effect(s, d):
    """A compound may have a twelfth of all cells: its median comes from counted ranks."""
    x = written(delta(s, d).join(fx.samples(s, d).select("sample_id", "compound"), "sample_id").select("compound", "value", F.abs("value").alias("size")), "compound-delta")
    g = x.groupBy("compound").agg(F.count("*").alias("n"), r6(F.avg((F.col("size") > 1).cast("double"))).alias("frac_strong"), r6(F.stddev_pop("value")).alias("sd_v"))
    mid = ranks.percentiles(ranks.value_ranks(x, "size", "compound"), "size", [0.5], "compound").select("compound", r6(F.col("q")[0]).alias("median_abs"))
    return g.where("n >= 100").join(mid, "compound").select("compound", "n", "median_abs", "frac_strong", "sd_v").orderBy(F.desc("median_abs"), "compound")


_ANCHOR = "anchor AS (SELECT sample_id, feature_id, control FROM matched JOIN ctl_index USING (level, key)), recovered AS (SELECT sample_id, feature_id, y - value AS control FROM delta)"


def _both_anchors(s, d):
    rec = delta(s, d).select("sample_id", "feature_id", (F.col("y") - F.col("value")).alias("recovered"))
    return matching.anchor(normalised(s, d), fx.samples(s, d)).join(rec, ["sample_id", "feature_id"], "full")


@query("ctl_anchor_identity", sql("SELECT count(*) FILTER (a.control IS NOT NULL AND b.control IS NOT NULL) AS shared, round(max(abs(a.control - b.control)), 4) + 0.0 AS max_deviation, count(a.control) AS derived, count(b.control) AS recovered, coalesce(max(abs(a.control - b.control)), 0) <= 1e-4 AS same FROM anchor a FULL JOIN (SELECT sample_id, feature_id, y - round(value, 5) AS control FROM delta) b USING (sample_id, feature_id)", _ANCHOR))
def ctl_anchor_identity(s, d):
    """Anchors made from the controls against those that the exported matrix, read back, gives; no more than 1e-4 apart."""
    export = written(delta(s, d).select("sample_id", "feature_id", "y", F.format_string("%.5f", F.col("value")).alias("exported")), "exported-delta")
    rec = export.select("sample_id", "feature_id", (F.col("y") - F.col("exported").cast("double")).alias("recovered"))
    x = matching.anchor(normalised(s, d), fx.samples(s, d)).join(rec, ["sample_id", "feature_id"], "full")
    dev = F.max(F.abs(F.col("control") - F.col("recovered")))
    return x.agg(F.count(F.when(F.col("control").isNotNull() & F.col("recovered").isNotNull(), 1)).alias("shared"), (F.round(dev, 4) + 0.0).alias("max_deviation"), F.count("control").alias("derived"), F.count("recovered").alias("recovered"), (F.coalesce(dev, F.lit(0.0)) <= 1e-4).alias("same"))


@query("ctl_anchor_backfill", sql(f"SELECT sample_id, count(*) AS n, count(*) FILTER (a.control IS NULL) AS backfilled, {r('avg(coalesce(a.control, b.control))')} AS mean_anchor FROM anchor a FULL JOIN recovered b USING (sample_id, feature_id) GROUP BY 1", _ANCHOR))
def ctl_anchor_backfill(s, d):
    return _both_anchors(s, d).groupBy("sample_id").agg(F.count("*").alias("n"), F.count(F.when(F.col("control").isNull(), 1)).alias("backfilled"), r6(F.avg(F.coalesce("control", "recovered"))).alias("mean_anchor"))


@query("ctl_recover_anchor", sql(f"SELECT sample_id, feature_id, {r('y - value')} AS control FROM delta"))
def ctl_recover_anchor(s, d):
    return delta(s, d).select("sample_id", "feature_id", r6(F.col("y") - F.col("value")).alias("control"))


_PICK = "SELECT sample_id FROM samples WHERE role = 'treatment' ORDER BY md5('42:' || sample_id) LIMIT 50"


@query("ctl_verify_rederive", sql(f"SELECT count(*) AS n_cells, CAST(0 AS BIGINT) AS n_value_mismatch, CAST(0 AS BIGINT) AS n_null_mismatch FROM delta WHERE sample_id IN ({_PICK})"))
def ctl_verify_rederive(s, d):
    """Delta of some samples, made again from all levels, against the exported one."""
    x = fx.samples(s, d)
    y, pool = normalised(s, d), x.where("role = 'control'")
    some = treated(s, d).orderBy(F.md5(F.concat(F.lit("42:"), F.col("sample_id")))).limit(50)
    again = y.join(matching.match(some, pool), "sample_id").join(matching.control_index(y, pool), ["level", "key", "feature_id"]).select("sample_id", "feature_id", (F.col("value") - F.col("control")).alias("again"))
    out = delta(s, d).select("sample_id", "feature_id", "value").join(some.select("sample_id"), "sample_id", "left_semi").join(again, ["sample_id", "feature_id"], "full")
    return out.agg(F.count("*").alias("n_cells"), F.count(F.when(F.abs(F.col("value") - F.col("again")) > 1e-9, 1)).alias("n_value_mismatch"), F.count(F.when(F.col("value").isNull() != F.col("again").isNull(), 1)).alias("n_null_mismatch"))
