"""Masked metrics, modules, conventions, bootstrap."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from assaylake.functions import fixtures as fx
from assaylake.functions.fixtures import sql
from assaylake.functions.scratch import written
from assaylake.model import CONVENTIONS, MODULE_SPLITS, MODULE_WEIGHTS, r6
from assaylake.operators import metrics
from assaylake.plans.common import MODELS, PRED_SQL, as_predictions, by_sample, normalised, pairs, prediction_cells, predictions, scored_sql
from assaylake.plans.registry import query, r

_SC = PRED_SQL + ", sc AS (" + scored_sql("pairs", "model", "split", "family") + ")"
_COUNTS = """, pos AS (SELECT model, sample_id, feature_idx, CAST(abs(d) > 1 AS INT) AS y, CAST(abs(d_pred) > 1 AS INT) AS yh, abs(d_pred) AS score FROM preds WHERE d IS NOT NULL AND d_pred IS NOT NULL),
dep0 AS (SELECT model, sample_id, count(*) AS n, sum(y) AS n_pos, sum(y * yh) AS tp, sum((1 - y) * yh) AS fp, sum(y * (1 - yh)) AS fn FROM pos GROUP BY 1, 2 HAVING count(*) >= 3),
dep AS (SELECT *, CASE WHEN n_pos > 0 AND tp + fp > 0 THEN tp / (tp + fp) END AS prec, CASE WHEN n_pos > 0 THEN tp / n_pos END AS rec, CASE WHEN n_pos > 0 THEN 2 * tp / (2 * tp + fp + fn) END AS f1 FROM dep0),
ranked AS (SELECT model, sample_id, y, score, n_pos, row_number() OVER (PARTITION BY model, sample_id ORDER BY score DESC, feature_idx) AS rk FROM pos JOIN dep0 USING (model, sample_id) WHERE n_pos > 0 AND n_pos < n),
rk AS (SELECT model, sample_id, sum(CASE WHEN rk <= n_pos THEN y ELSE 0 END) / max(n_pos) AS rk_k, sum(CASE WHEN rk <= 100 THEN y ELSE 0 END) / max(n_pos) AS rk_f FROM ranked GROUP BY 1, 2),
st AS (SELECT model, sample_id, score, sum(y) AS p, count(*) AS k, max(n_pos) AS n_pos FROM ranked GROUP BY 1, 2, 3),
cv AS (SELECT *, sum(p) OVER w AS tp, sum(k) OVER w AS seen FROM st WINDOW w AS (PARTITION BY model, sample_id ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
ap AS (SELECT model, sample_id, sum(p / n_pos * tp / seen) AS auprc FROM cv GROUP BY 1, 2)"""


@query("sc_moments", sql(f"SELECT model, 'sample' AS grain, sample_id AS id, count(*) AS n, {r('covar_pop(t, p)')} AS cov, {r('var_pop(t)')} AS var_t, {r('var_pop(p)')} AS var_p, {r('sum((t - p) * (t - p))')} AS ss_res FROM pairs WHERE family = 'delta' AND split = 'all' GROUP BY 1, 3 UNION ALL SELECT model, 'feature', feature_id, count(*), {r('covar_pop(t, p)')}, {r('var_pop(t)')}, {r('var_pop(p)')}, {r('sum((t - p) * (t - p))')} FROM pairs WHERE family = 'delta' AND split = 'all' GROUP BY 1, 3 UNION ALL SELECT model, 'pooled', '', count(*), {r('covar_pop(t, p)')}, {r('var_pop(t)')}, {r('var_pop(p)')}, {r('sum((t - p) * (t - p))')} FROM pairs WHERE family = 'delta' AND split = 'all' GROUP BY 1", PRED_SQL))
def sc_moments(s, d):
    x = pairs(predictions(s, d), metric_split=False).where("family = 'delta'")
    return metrics.moments(x, "model").where("n > 0").select("model", "grain", "id", "n", *[r6(c).alias(c) for c in ("cov", "var_t", "var_p", "ss_res")])


def _scores(s, d, cells=None, preds=as_predictions):
    cells = prediction_cells(s, d) if cells is None else cells
    return metrics.scores_by_split(pairs(preds(cells), metric_split=False), "model", "family", dealt=pairs(preds(by_sample(cells)), metric_split=False))


def sample_moments(cells, families: tuple[str, ...]):
    """(model, family, sample_id, moments) with a shared cell: for queries that ask for no other grain. A sample has one
    split, so these are its moments there and in 'all'."""
    x = pairs(as_predictions(by_sample(cells)), metric_split=False)
    return x.where(F.col("family").isin(*families)).groupBy("model", "family", "sample_id").agg(*metrics.moment_aggregates()).where("n > 0")


@query("sc_pcc", sql(f"SELECT model, split, family, id, {r('pcc')} AS pcc FROM sc WHERE grain = 'sample'", _SC))
def sc_pcc(s, d):
    return _scores(s, d).where("grain = 'sample'").select("model", "split", "family", "id", r6("pcc").alias("pcc"))


@query("sc_r2", sql(f"SELECT model, split, family, id, {r('r2')} AS r2 FROM sc WHERE grain = 'feature' AND family = 'y'", _SC))
def sc_r2(s, d):
    return _scores(s, d).where("grain = 'feature' AND family = 'y'").select("model", "split", "family", "id", r6("r2").alias("r2"))


_SUMMARY = ", ".join(f"{r(f'avg({m})')} AS {m}_mean, {r(f'median({m})')} AS {m}_median, count({m}) AS {m}_defined, count(*) - count({m}) AS {m}_undefined" for m in ("pcc", "r2"))


def _summary_query(name: str, where: str):
    @query(name, sql(f"SELECT model, split, family, grain, {_SUMMARY} FROM sc WHERE {where} GROUP BY 1, 2, 3, 4", _SC))
    def run(s, d):
        out = metrics.summarise(_scores(s, d).where(where), "model", "split", "family")
        return out.withColumns({c: r6(c) for c in ("pcc_mean", "pcc_median", "r2_mean", "r2_median")})

    run.__name__ = name


for _n, _w in (("sc_summarise", "split = 'all'"), ("sc_abundance", "family = 'y'"), ("sc_fold_change", "family = 'delta'"), ("sc_residual", "family IN ('ctx', 'drug')"), ("sc_split_table", "split <> 'all'")):
    _summary_query(_n, _w)


def _by_model(s, d, f, cells=None, preds=as_predictions):
    """A per-sample metric of each model."""
    cells = prediction_cells(s, d) if cells is None else cells
    x = preds(by_sample(cells)).select("model", "sample_id", "feature_id", "feature_idx", F.col("d").alias("t"), F.col("d_pred").alias("p"))
    return f(x, keys=("sample_id", "model"))


@query("sc_dep_counts", sql(f"SELECT model, sample_id, n, CAST(n_pos AS BIGINT) AS n_pos, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, {r('prec')} AS \"precision\", {r('rec')} AS recall, {r('f1')} AS f1 FROM dep", PRED_SQL + _COUNTS))
def sc_dep_counts(s, d):
    return _by_model(s, d, metrics.dep_counts).withColumns({c: r6(c) for c in ("precision", "recall", "f1")})


@query("sc_dep_rank", sql(f"SELECT model, sample_id, {r('rk_k')} AS recall_at_k, {r('rk_f')} AS recall_at_fixed FROM rk", PRED_SQL + _COUNTS))
def sc_dep_rank(s, d):
    return _by_model(s, d, metrics.dep_rank).withColumns({c: r6(c) for c in ("recall_at_k", "recall_at_fixed")})


@query("sc_dep_auprc", sql(f"SELECT model, sample_id, {r('auprc')} AS auprc FROM ap", PRED_SQL + _COUNTS))
def sc_dep_auprc(s, d):
    return _by_model(s, d, metrics.dep_auprc).withColumn("auprc", r6("auprc"))


_LONG = _SC + _COUNTS + """, mlong AS (SELECT model, split, CASE WHEN family IN ('ctx', 'drug') THEN 'delta' ELSE family END AS family, CASE WHEN family IN ('ctx', 'drug') THEN family || '_' ELSE '' END || m || '_' || grain AS metric, value FROM
  (SELECT model, split, family, grain, 'pcc' AS m, avg(pcc) AS value FROM sc GROUP BY 1, 2, 3, 4 UNION ALL SELECT model, split, family, grain, 'r2', avg(r2) FROM sc GROUP BY 1, 2, 3, 4)
  UNION ALL SELECT model, 'all', 'dep', 'precision_macro', avg(prec) FROM dep GROUP BY 1 UNION ALL SELECT model, 'all', 'dep', 'f1_macro', avg(f1) FROM dep GROUP BY 1
  UNION ALL SELECT model, 'all', 'dep', 'precision_micro', CASE WHEN sum(tp + fp) > 0 THEN sum(tp) / sum(tp + fp) END FROM dep GROUP BY 1
  UNION ALL SELECT model, 'all', 'dep', 'f1_micro', CASE WHEN sum(tp) > 0 THEN 2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)) END FROM dep GROUP BY 1
  UNION ALL SELECT model, 'all', 'dep', 'recall_at_k', avg(rk_k) FROM rk GROUP BY 1 UNION ALL SELECT model, 'all', 'dep', 'auprc', avg(auprc) FROM ap GROUP BY 1)"""


def metric_rows(s, d, preds=as_predictions):
    """(model, split, family, metric, value): everything that a module can ask for, of what `preds` makes of the cells."""
    cells = prediction_cells(s, d)
    sm = metrics.summarise(_scores(s, d, cells, preds), "model", "split", "family")
    fam = F.col("family").isin("ctx", "drug")
    prefix = F.when(fam, F.concat(F.col("family"), F.lit("_"))).otherwise("")
    both = sm.select("model", "split", F.when(fam, "delta").otherwise(F.col("family")).alias("family"), F.inline(F.array(*[F.struct(F.concat(prefix, F.lit(f"{m}_"), F.col("grain")).alias("metric"), F.col(f"{m}_mean").alias("value")) for m in ("pcc", "r2")])))
    c = _by_model(s, d, metrics.dep_metrics, cells, preds).groupBy("model").agg(F.avg("precision").alias("precision_macro"), F.avg("f1").alias("f1_macro"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.avg("recall_at_k").alias("recall_at_k"), F.avg("auprc").alias("auprc"))
    dep = c.withColumns({"precision_micro": F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))), "f1_micro": F.when(F.col("tp") > 0, 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn")))})
    names = ["precision_macro", "f1_macro", "precision_micro", "f1_micro", "recall_at_k", "auprc"]
    dep = dep.select("model", F.lit("all").alias("split"), F.lit("dep").alias("family"), F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names])))
    return written(both.unionByName(dep), "metric-rows")  # a few hundred rows, which modules read more than once


_SPEC = ", spec AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{m}', '{MODULE_SPLITS[m]}', {MODULE_WEIGHTS[m]}, '{k}', {w!r}::DOUBLE, '{'y' if m == 'm1_abundance' else 'dep' if m == 'm4_dep' else 'delta'}')" for c, ms in CONVENTIONS.items() for m, ks in ms.items() for k, w in ks.items()) + """) t(convention, module, split, module_weight, metric, weight, family)),
assembled AS (SELECT convention, m.model, module, sum(greatest(0, least(1, coalesce(value, 0))) * weight) AS score, max(module_weight) AS mw FROM (SELECT DISTINCT model FROM mlong) m CROSS JOIN spec LEFT JOIN mlong l ON l.model = m.model AND l.split = spec.split AND l.family = spec.family AND l.metric = spec.metric GROUP BY 1, 2, 3)"""


@query("sc_module_assemble", sql(f"SELECT model, module, {r('score')} AS score, {r('score * mw')} AS contribution FROM assembled WHERE convention = 'per_sample_primary'", _LONG + _SPEC))
def sc_module_assemble(s, d):
    return metrics.assemble(metric_rows(s, d)).where("convention = 'per_sample_primary'").select("model", "module", r6("score").alias("score"), r6("contribution").alias("contribution"))


@query("sc_conventions", sql(f"SELECT convention, model, {r('total')} AS total, CAST(rank() OVER (PARTITION BY convention ORDER BY round(total, 6) DESC) AS INT) AS place FROM (SELECT convention, model, sum(score * mw) AS total FROM assembled GROUP BY 1, 2)", _LONG + _SPEC))
def sc_conventions(s, d):
    t = metrics.assemble(metric_rows(s, d)).groupBy("convention", "model").agg(r6(F.sum("contribution")).alias("total"))
    return t.withColumn("place", F.rank().over(Window.partitionBy("convention").orderBy(F.desc("total"))))


@query("sc_flatten", sql(f"SELECT model, split, family, metric, {r('value')} AS value FROM mlong", _LONG))
def sc_flatten(s, d):
    return metric_rows(s, d).withColumn("value", r6("value"))


@query("sc_module_gap", sql(f"SELECT a.module, {r('(b.score - a.score) * a.mw')} AS weighted_gap, {r('greatest(a.score, b.score)')} AS best FROM assembled a JOIN assembled b USING (convention, module) WHERE convention = 'per_sample_primary' AND a.model = 'global_mean' AND b.model = 'context_mean_batch'", _LONG + _SPEC))
def sc_module_gap(s, d):
    x = metrics.assemble(metric_rows(s, d)).where("convention = 'per_sample_primary'")
    both = x.groupBy("module").pivot("model", ["global_mean", "context_mean_batch"]).agg(F.first(F.struct("score", "contribution")))
    return both.select("module", r6(F.col("context_mean_batch.contribution") - F.col("global_mean.contribution")).alias("weighted_gap"), r6(F.greatest("global_mean.score", "context_mean_batch.score")).alias("best"))


@query("rpt_residual_confound", sql(f"SELECT model, split, {r('avg(pcc)')} AS resid_pcc, count(pcc) AS n_defined FROM sc WHERE family = 'ctx' AND grain = 'sample' GROUP BY 1, 2", _SC))
def rpt_residual_confound(s, d):
    """The control anchor among the models is the floor that a residual metric has by itself."""
    return _scores(s, d).where("family = 'ctx' AND grain = 'sample'").groupBy("model", "split").agg(r6(F.avg("pcc")).alias("resid_pcc"), F.count("pcc").alias("n_defined"))


_SUB = PRED_SQL + """, rate AS (SELECT feature_id, count(*) / (SELECT count(*) FROM samples WHERE split = 'train') AS rate FROM y JOIN samples USING (sample_id) WHERE split = 'train' GROUP BY 1),
cut AS (SELECT model, c, p.sample_id, p.feature_id, t, p FROM pairs p JOIN rate USING (feature_id), (SELECT unnest([0.0, 0.5, 0.9]) AS c) WHERE family = 'delta' AND split = 'all' AND rate >= c)"""


@query("sc_detection_subcohort", sql(f"SELECT model, CAST(c AS DOUBLE) AS cut, {r('avg(pcc)')} AS pcc_mean, count(*) AS n_samples FROM (" + scored_sql("cut", "model", "c") + ") WHERE grain = 'sample' GROUP BY 1, 2", _SUB))
def sc_detection_subcohort(s, d):
    train = fx.samples(s, d).where("split = 'train'")
    normal = written(normalised(s, d), "normalised")
    rate = normal.join(train.select("sample_id"), "sample_id").groupBy("feature_id").agg(F.count("*").alias("k")).join(F.broadcast(train.agg(F.count("*").alias("n")))).select("feature_id", (F.col("k") / F.col("n")).alias("rate"))
    x = by_sample(prediction_cells(s, d, normal).join(F.broadcast(rate), "feature_id")).withColumn("cut", F.explode(F.array(*[F.lit(c) for c in (0.0, 0.5, 0.9)]))).where("rate >= cut")
    x = x.select("cut", "sample_id", "d", "control", F.inline(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("y_pred")) for m in MODELS])))
    scored = x.select("model", "cut", "sample_id", F.col("d").alias("t"), (F.col("y_pred") - F.col("control")).alias("p")).groupBy("sample_id", "model", "cut").agg(*metrics.moment_aggregates()).where("n > 0")
    return scored.groupBy("model", "cut").agg(r6(F.avg(metrics.pcc())).alias("pcc_mean"), F.count("*").alias("n_samples"))


_HALVES = "0.5 * max(CASE WHEN family = 'delta' THEN m END) + 0.5 * max(CASE WHEN family = 'ctx' THEN m END)"


@query("sc_regime_objective", sql(f"SELECT model, {r(_HALVES)} AS objective FROM (SELECT model, family, avg(pcc) AS m FROM sc WHERE grain = 'sample' AND split = 'val_chem_only' GROUP BY 1, 2) GROUP BY 1", _SC))
def sc_regime_objective(s, d):
    m = sample_moments(prediction_cells(s, d).where("split = 'val_chem_only'"), ("delta", "ctx")).withColumn("pcc", metrics.pcc()).groupBy("model").pivot("family", ["delta", "ctx"]).agg(F.avg("pcc"))
    return m.select("model", r6(0.5 * F.col("delta") + 0.5 * F.col("ctx")).alias("objective"))


@query("sc_masked_losses", sql(f"SELECT model, {r('sum((t - p) * (t - p)) / count(*)')} AS mse, (SELECT {r('1 - avg(pcc)')} FROM sc WHERE sc.model = pairs.model AND family = 'delta' AND split = 'all' AND grain = 'sample') AS pcc_loss FROM pairs WHERE family = 'delta' AND split = 'all' GROUP BY 1", _SC))
def sc_masked_losses(s, d):
    m = sample_moments(prediction_cells(s, d), ("delta",)).groupBy("model")
    return m.agg(r6(F.sum("ss_res") / F.sum("n")).alias("mse"), r6(1 - F.avg(metrics.pcc())).alias("pcc_loss"))
