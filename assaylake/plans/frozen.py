"""Splits, leakage audits, frozen statistics and baseline predictors."""

from __future__ import annotations

from pyspark.sql import functions as F

from assaylake.functions import fixtures as fx
from assaylake.functions.fixtures import sql
from assaylake.model import COMPOUND_LEVELS, CONTEXT_BATCH_LEVELS, CONTEXT_LEVELS, r6
from assaylake.operators import frozen, ranks, splits
from assaylake.plans.common import PRED_SQL, delta, hier_sql, hierarchical, normalised, predictions, treated
from assaylake.plans.registry import query, r


@query("split_masks", sql("SELECT split, count(*) AS n, CAST(sum(count(*)) FILTER (split LIKE 'val_%') OVER () AS BIGINT) AS all_val FROM samples GROUP BY 1"))
def split_masks(s, d):
    x = fx.samples(s, d).groupBy("split").agg(F.count("*").alias("n"))
    return x.join(F.broadcast(x.where("split LIKE 'val_%'").agg(F.sum("n").alias("all_val"))))


@query("split_unknown_labels", sql("SELECT split, count(*) AS n FROM samples WHERE split NOT IN ('train','val_time','val_both') GROUP BY 1"))
def split_unknown_labels(s, d):
    allowed = s.createDataFrame([("train",), ("val_time",), ("val_both",)], "split string")
    return fx.samples(s, d).join(F.broadcast(allowed), "split", "left_anti").groupBy("split").agg(F.count("*").alias("n"))


_NOV = "avg(CASE WHEN {} THEN 1.0 ELSE 0.0 END)"
_IN = "({0}) NOT IN (SELECT {0} FROM samples WHERE split = 'train')"
_PAIR = "strain || '/' || compound"
_COND = "strain || '/' || compound || '/' || medium || '/' || temperature || '/' || pert_time"


@query("leak_split_audit", sql(f"SELECT split, count(*) AS n, count(*) FILTER (sample_id IN (SELECT sample_id FROM samples WHERE split = 'train')) AS shared_ids, {r(_NOV.format(_IN.format('strain')))} AS novel_strain, {r(_NOV.format(_IN.format('compound')))} AS novel_compound, {r(_NOV.format(_IN.format(_PAIR)))} AS novel_pair, {r(_NOV.format(_IN.format(_COND)))} AS novel_condition FROM samples WHERE split <> 'train' GROUP BY 1"))
def leak_split_audit(s, d):
    return splits.leak_audit(fx.samples(s, d)).withColumns({c: r6(c) for c in ("novel_strain", "novel_compound", "novel_pair", "novel_condition")})


_K = "strain, compound, medium, temperature"


@query("leak_time_semantics", sql(f"""SELECT count(*) AS n, {r('avg(n_times)')} AS mean_times, min(n_times) AS min_times, count(*) FILTER (n_times IS NOT NULL AND seen IS NULL) AS unseen_times, count(*) FILTER (n_times IS NULL) AS new_conditions
  FROM samples LEFT JOIN (SELECT {_K}, count(DISTINCT pert_time) AS n_times FROM samples WHERE split = 'train' GROUP BY ALL) USING ({_K}) LEFT JOIN (SELECT DISTINCT {_K}, pert_time, 1 AS seen FROM samples WHERE split = 'train') USING ({_K}, pert_time) WHERE split = 'val_time'"""))
def leak_time_semantics(s, d):
    return splits.time_semantics(fx.samples(s, d), "val_time").withColumn("mean_times", r6("mean_times"))


_HELD = "e AS (SELECT DISTINCT compound FROM samples WHERE split = 'train' AND role = 'treatment'), held AS (SELECT compound, row_number() OVER (ORDER BY md5('42:' || compound), compound) <= (SELECT greatest(2, floor(count(*) * 0.25)) FROM e) AS held FROM e)"


@query("split_inner_holdout", sql("SELECT compound, held FROM held", _HELD))
def split_inner_holdout(s, d):
    return splits.inner_holdout(fx.samples(s, d))


@query("split_inner_regimes", sql("""SELECT part, count(*) AS n FROM (SELECT CASE WHEN h.held AND t.held THEN 'both_novel' WHEN h.held THEN 'chem_novel' WHEN t.held THEN 'strain_novel' WHEN rk <= greatest(30, floor(k * 0.08)) THEN 'full_dev' ELSE 'fit' END AS part
  FROM (SELECT *, row_number() OVER (ORDER BY md5('42:' || sample_id), sample_id) AS rk, count(*) OVER () AS k FROM samples WHERE split = 'train' AND role = 'treatment') JOIN held h USING (compound)
  JOIN (SELECT strain, row_number() OVER (ORDER BY md5('42:' || strain), strain) = 1 AS held FROM (SELECT DISTINCT strain FROM samples WHERE split = 'train' AND role = 'treatment')) t USING (strain)) GROUP BY 1""", _HELD))
def split_inner_regimes(s, d):
    x = fx.samples(s, d)
    train = x.where("split = 'train' AND role = 'treatment'")
    one = train.select("strain").distinct().orderBy(splits.seeded("strain"), "strain").limit(1).withColumn("sh", F.lit(True))
    size = train.agg(F.greatest(F.lit(30), F.floor(F.count("*") * 0.08)).alias("k"))
    order = ranks.value_ranks(train.select(F.concat(splits.seeded("sample_id"), F.col("sample_id")).alias("o")), "o")
    full = order.join(F.broadcast(size)).where("below < k").select(F.substring("o", 33, 2**31 - 1).alias("sample_id"), F.lit(True).alias("dev"))
    y = train.join(splits.inner_holdout(x), "compound").join(F.broadcast(one), "strain", "left").join(full, "sample_id", "left")
    part = F.when(F.col("held") & F.col("sh").isNotNull(), "both_novel").when(F.col("held"), "chem_novel").when(F.col("sh").isNotNull(), "strain_novel").when(F.col("dev").isNotNull(), "full_dev").otherwise("fit")
    return y.groupBy(part.alias("part")).agg(F.count("*").alias("n"))


@query("split_group_folds")
def split_group_folds(s, d):
    c, st = splits.group_folds(fx.samples(s, d))
    return c.select(F.lit("compound").alias("kind"), F.col("compound").alias("entity"), "fold").unionByName(st.select(F.lit("strain").alias("kind"), F.col("strain").alias("entity"), "fold"))


@query("split_fold_fit_masks")
def split_fold_fit_masks(s, d):
    return splits.fold_rows(fx.samples(s, d)).groupBy("fold", "use").agg(F.count("*").alias("n"))


@query("leak_fold_audit", sql("SELECT CAST(g AS INT) AS fold, CAST(0 AS BIGINT) AS compound_leaks, CAST(0 AS BIGINT) AS strain_leaks, count(*) AS n_rows FROM samples, generate_series(0, 4) t(g) WHERE split = 'train' AND role = 'treatment' GROUP BY 1"))
def leak_fold_audit(s, d):
    return splits.fold_audit(splits.fold_rows(fx.samples(s, d))).select("fold", F.coalesce("compound_leaks", F.lit(0)).alias("compound_leaks"), F.coalesce("strain_leaks", F.lit(0)).alias("strain_leaks"), (F.coalesce("n_fit", F.lit(0)) + F.coalesce("n_dev", F.lit(0))).alias("n_rows"))


_FIT = "(SELECT {0} FROM samples WHERE split = 'train' AND role = 'treatment')"
_ROUTE = f"routed AS (SELECT *, CASE WHEN compound NOT IN {_FIT.format('compound')} AND strain NOT IN {_FIT.format('strain')} THEN 'both_novel' WHEN compound NOT IN {_FIT.format('compound')} THEN 'chem_novel' WHEN strain NOT IN {_FIT.format('strain')} THEN 'strain_novel' ELSE 'full' END AS regime FROM samples WHERE role = 'treatment')"


def _routed(s, d):
    t = treated(s, d)
    return splits.route_regime(t, t.where("split = 'train'"))


@query("route_regime", sql("SELECT sample_id, regime FROM routed", _ROUTE))
def route_regime(s, d):
    return _routed(s, d).select("sample_id", "regime")


_REGIMES = ["both_novel", "chem_novel", "full", "strain_novel"]


@query("route_check", sql("SELECT split, " + ", ".join(f"count(*) FILTER (regime = '{g}') AS {g}" for g in _REGIMES) + " FROM routed GROUP BY 1", _ROUTE))
def route_check(s, d):
    return _routed(s, d).groupBy("split").pivot("regime", _REGIMES).agg(F.count(F.lit(1))).na.fill(0)


@query("split_relabel", sql("SELECT sample_id, CASE WHEN split LIKE 'test_%' THEN 'val_' || substr(split, 6) ELSE split END AS alias FROM samples WHERE split <> 'train'"))
def split_relabel(s, d):
    alias = s.createDataFrame([(f"test_{x}", f"val_{x}") for x in ("both", "chem_only", "strain_only", "time")] + [(f"val_{x}", f"val_{x}") for x in ("both", "chem_only", "strain_only", "time")], "split string, alias string")
    return fx.samples(s, d).join(F.broadcast(alias), "split").select("sample_id", "alias")


def _mean_query(name: str, levels, source: str):
    @query(name, sql(f"SELECT sample_id, feature_id, {r('mu')} AS mu, level FROM h", hier_sql("h", levels, source)))
    def run(s, d):
        return hierarchical(s, d, delta(s, d) if source == "delta" else normalised(s, d), levels).withColumn("mu", r6("mu"))

    run.__name__ = name


for _name, _levels, _source in (("frz_hier_mean", CONTEXT_LEVELS, "y"), ("frz_mu_ctx", CONTEXT_LEVELS, "delta"), ("frz_mu_drug", COMPOUND_LEVELS, "delta"), ("frz_mu_ctx_batch", CONTEXT_BATCH_LEVELS, "delta")):
    _mean_query(_name, _levels, _source)


@query("frz_level_usage", sql("SELECT level, count(*) AS n_samples, min(n_rows) AS min_rows FROM h_lv GROUP BY 1", hier_sql("h", CONTEXT_LEVELS, "y")))
def frz_level_usage(s, d):
    t = treated(s, d)
    return frozen.level_of(t, t.where("split = 'train'"), CONTEXT_LEVELS).groupBy("level").agg(F.count("*").alias("n_samples"), F.min("n_rows").alias("min_rows"))


@query("frz_leak_guard", sql("SELECT CAST(0 AS BIGINT) AS n_changed, count(*) AS n_cells FROM h", hier_sql("h", CONTEXT_LEVELS, "delta")))
def frz_leak_guard(s, d):
    """Fitted again with every row but train's blanked, the statistics (to 1e-9) are the same."""
    t, dl = treated(s, d), delta(s, d)
    blank = dl.join(t.select("sample_id", "split"), "sample_id").withColumn("value", F.when(F.col("split") == "train", F.col("value")))
    a = frozen.hierarchical_mean(dl, t, CONTEXT_LEVELS).withColumn("mu", F.round("mu", 9))
    b = frozen.hierarchical_mean(blank.where("value IS NOT NULL"), t, CONTEXT_LEVELS).select("sample_id", "feature_id", F.round("mu", 9).alias("again"))
    return a.join(b, ["sample_id", "feature_id"], "full").agg(F.count(F.when(~F.col("mu").eqNullSafe(F.col("again")), 1)).alias("n_changed"), F.count("mu").alias("n_cells"))


@query("frz_project", sql(f"SELECT sample_id, feature_id, {r('mu')} AS mu FROM h JOIN samples USING (sample_id) WHERE cohort = 'test'", hier_sql("h", CONTEXT_LEVELS, "y")))
def frz_project(s, d):
    t = treated(s, d)
    return frozen.hierarchical_mean(normalised(s, d), t, CONTEXT_LEVELS, serve=t.where("cohort = 'test'")).select("sample_id", "feature_id", r6("mu").alias("mu"))


_VALGRID = "SELECT sample_id, feature_id FROM samples, features WHERE role = 'treatment' AND split LIKE 'val_%'"


@query("frz_fallback_chain", sql(f"SELECT g.sample_id, g.feature_id, {r('coalesce(h.mu, fm, gm)')} AS value FROM ({_VALGRID}) g LEFT JOIN h USING (sample_id, feature_id) LEFT JOIN (SELECT feature_id, avg(value) AS fm FROM y JOIN samples USING (sample_id) WHERE split = 'train' AND role = 'treatment' GROUP BY 1) USING (feature_id), (SELECT median(value) AS gm FROM y JOIN samples USING (sample_id) WHERE split = 'train' AND role = 'treatment')", hier_sql("h", CONTEXT_LEVELS, "y")))
def frz_fallback_chain(s, d):
    t, y = treated(s, d), normalised(s, d)
    grid = t.where("split LIKE 'val_%'").select("sample_id").join(F.broadcast(fx.features(s, d).select("feature_id")))
    return frozen.fallback_chain(grid, frozen.hierarchical_mean(y, t, CONTEXT_LEVELS), y, t).withColumn("value", r6("value"))


@query("frz_fold_baselines")
def frz_fold_baselines(s, d):
    """mu_ctx and mu_drug fitted on each fold's fit rows and served to its held-out rows: all folds in one plan."""
    x = fx.samples(s, d)
    folds = splits.fold_rows(x).select("sample_id", "fold", "use").join(x, "sample_id")
    dl = delta(s, d)
    out = None
    for name, levels in (("mu_ctx", CONTEXT_LEVELS), ("mu_drug", COMPOUND_LEVELS)):
        within = [["fold", *k] for k in levels]
        as_text = folds.withColumn("fold", F.col("fold").cast("string")).withColumn("sample_id", F.concat_ws("@", "sample_id", "fold"))
        per_fold = dl.select("sample_id", "feature_id", "value").join(folds.select("sample_id", "fold"), "sample_id").withColumn("sample_id", F.concat_ws("@", "sample_id", "fold")).drop("fold")
        got = frozen.hierarchical_mean(per_fold, as_text, within, serve=as_text.where("use <> 'fit'"), fit=as_text.where("use = 'fit'"))
        part = got.groupBy(F.element_at(F.split("sample_id", "@"), 2).alias("fold")).agg(F.count("*").alias("n_cells"), F.countDistinct("sample_id").alias("n_rows"), r6(F.avg("mu")).alias("mean_mu")).withColumn("baseline", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def _predictor(name: str, model: str):
    @query(name, sql(f"SELECT sample_id, feature_id, {r('y_pred')} AS y_pred, {r('d_pred')} AS d_pred FROM preds WHERE model = '{model}'", PRED_SQL))
    def run(s, d):
        return predictions(s, d).where(F.col("model") == model).select("sample_id", "feature_id", r6("y_pred").alias("y_pred"), r6("d_pred").alias("d_pred"))

    run.__name__ = name


for _name, _model in (("prd_global_mean", "global_mean"), ("prd_context_mean", "context_mean"), ("prd_context_mean_batch", "context_mean_batch"), ("prd_control_anchor", "control_anchor")):
    _predictor(_name, _model)

