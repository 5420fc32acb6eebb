"""Tables that several queries share, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from assaylake.functions import fixtures as fx
from assaylake.functions.fixtures import level_sql
from assaylake.functions.scratch import drop, written
from assaylake.model import COMPOUND_LEVELS, CONTEXT_BATCH_LEVELS, CONTEXT_LEVELS
from assaylake.operators import frozen, matching, normalize


def normalised(s, d):
    return normalize.median_normalise(normalize.log2(fx.cells(s, d)), fx.samples(s, d))


def delta(s, d, y=None, **more):
    """Normalised cells are written once, if they are not given: they are both the treated side and the controls."""
    return matching.delta(written(normalised(s, d), "normalised") if y is None else y, fx.samples(s, d), **more)


def treated(s, d):
    return fx.samples(s, d).where("role = 'treatment'")


def hierarchical(s, d, cells, levels):
    """A frozen mean over train treated rows, served to every treated row."""
    t = treated(s, d)
    return frozen.hierarchical_mean(cells, t, levels)


def hier_sql(name: str, levels: list[list[str]], source: str) -> str:
    lk = level_sql(levels)
    return f"""
{name}_fit AS (SELECT sample_id, unnest({lk}) AS lk FROM samples WHERE split = 'train' AND role = 'treatment'),
{name}_sz AS (SELECT lk.level AS level, lk.key AS key, count(*) AS n FROM {name}_fit GROUP BY ALL HAVING count(*) >= 3 OR lk.level = {len(levels)}),
{name}_lv AS (SELECT sample_id, min(z.level) AS level, arg_min(z.key, z.level) AS key, arg_min(n, z.level) AS n_rows FROM (SELECT sample_id, unnest({lk}) AS lk FROM samples WHERE role = 'treatment') t JOIN {name}_sz z ON z.level = t.lk.level AND z.key = t.lk.key GROUP BY 1),
{name}_pf AS (SELECT lk.level AS level, lk.key AS key, feature_id, avg(value) AS mu FROM {name}_fit JOIN {source} USING (sample_id) GROUP BY ALL),
{name} AS (SELECT sample_id, feature_id, mu, level FROM {name}_lv JOIN {name}_pf USING (level, key))"""


MODELS = ["control_anchor", "context_mean", "context_mean_batch", "global_mean"]


#: Columns of prediction_cells() that are means of members; and those that residuals are taken from.
MEMBER_MEANS = [("context_mean", "in_context", "of_y"), ("context_mean_batch", "in_batch", "of_y"), ("global_mean", "in_all", "of_y")]
RESIDUAL_MEANS = [("mu_ctx", "in_context", "of_d"), ("mu_drug", "in_compound", "of_d")]


def prediction_cells(s, d, normal=None, wanted=(*RESIDUAL_MEANS, *MEMBER_MEANS), keep=True):
    """(sample_id, feature_id, feature_idx, split, y, d, control, mu_ctx, mu_drug, <MODELS>) for treated validation cells:
    the models' abundances, null where one has none. A written table, with a column for each model. `normal`, if given,
    are the normalised cells, written. Of the means only those in `wanted` are made; without `keep` the result, for what
    reads it once, is not written."""
    y = written(normalised(s, d), "normalised") if normal is None else normal  # each is read many times below
    t = written(treated(s, d), "treated")
    dl = written(matching.delta(y, fx.samples(s, d)), "delta")
    cells = dl.join(t.where("split LIKE 'val_%'").select("sample_id", "split"), "sample_id")
    cells = cells.select("sample_id", "feature_id", "split", "y", F.col("value").alias("d"), "control").join(F.broadcast(fx.features(s, d)), "feature_id")
    source = y.withColumnRenamed("value", "of_y")
    if any(of == "of_d" for _, _, of in wanted):
        source = source.join(dl.select("sample_id", "feature_id", F.col("value").alias("of_d")), ["sample_id", "feature_id"], "left")
    hierarchies = {"in_context": CONTEXT_LEVELS, "in_compound": COMPOUND_LEVELS, "in_batch": CONTEXT_BATCH_LEVELS, "in_all": [[]]}
    hierarchies = {h: levels for h, levels in hierarchies.items() if any(h == x for _, x, _ in wanted)}
    cells = frozen.with_hierarchical_means(cells, source, t, t.where("split LIKE 'val_%'"), hierarchies, wanted)
    cells = cells.withColumn("control_anchor", F.col("control"))
    if not keep:
        return cells
    out = written(cells, "prediction-cells")
    for x in (y if normal is None else None, t, dl):
        drop(x)
    return out


def as_predictions(cells):
    """(model, sample_id, feature_id, feature_idx, split, y, d, y_pred, d_pred, mu_ctx, mu_drug) of prediction_cells()."""
    keep = ["sample_id", "feature_id", "feature_idx", "split", "y", "d", "control", "mu_ctx", "mu_drug"]
    preds = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("y_pred")) for m in MODELS])
    return cells.select(*keep, F.inline(preds)).withColumn("d_pred", F.col("y_pred") - F.col("control"))


def predictions(s, d):
    return as_predictions(prediction_cells(s, d))


def by_sample(cells):
    """Cells dealt by sample while a cell is still one row: what is then made of them by model, family and sample, or
    ranked within a sample, is not shuffled again."""
    return cells.repartition("sample_id")


def pairs(preds, metric_split: bool = True):
    """(model, split, family, sample_id, feature_id, t, p): each cell as abundance, fold change and both residuals,
    in its split and in 'all'."""
    families = [("y", F.col("y"), F.col("y_pred")), ("delta", F.col("d"), F.col("d_pred")), ("ctx", F.col("d") - F.col("mu_ctx"), F.col("d_pred") - F.col("mu_ctx")), ("drug", F.col("d") - F.col("mu_drug"), F.col("d_pred") - F.col("mu_drug"))]
    out = preds.select("model", "split", "sample_id", "feature_id", F.inline(F.array(*[F.struct(F.lit(n).alias("family"), t.alias("t"), p.alias("p")) for n, t, p in families])))
    return out.withColumn("split", F.explode(F.array(F.col("split"), F.lit("all")))) if metric_split else out


PRED_SQL = ",".join([hier_sql("mctx", CONTEXT_LEVELS, "delta"), hier_sql("mdrug", COMPOUND_LEVELS, "delta"), hier_sql("pctx", CONTEXT_LEVELS, "y"), hier_sql("pctxb", CONTEXT_BATCH_LEVELS, "y"), hier_sql("pglob", [[]], "y")]) + """,
preds0 AS (SELECT d.sample_id, d.feature_id, feature_idx, split, d.y, d.value AS d, d.control, mctx.mu AS mu_ctx, mdrug.mu AS mu_drug, pctx.mu AS p_ctx, pctxb.mu AS p_ctxb, pglob.mu AS p_glob
  FROM delta d JOIN samples s ON s.sample_id = d.sample_id AND split LIKE 'val_%' JOIN features f ON f.feature_id = d.feature_id
  LEFT JOIN mctx ON mctx.sample_id = d.sample_id AND mctx.feature_id = d.feature_id LEFT JOIN mdrug ON mdrug.sample_id = d.sample_id AND mdrug.feature_id = d.feature_id
  LEFT JOIN pctx ON pctx.sample_id = d.sample_id AND pctx.feature_id = d.feature_id LEFT JOIN pctxb ON pctxb.sample_id = d.sample_id AND pctxb.feature_id = d.feature_id
  LEFT JOIN pglob ON pglob.sample_id = d.sample_id AND pglob.feature_id = d.feature_id),
preds AS (SELECT *, y_pred - control AS d_pred FROM (SELECT *, 'control_anchor' AS model, control AS y_pred FROM preds0 UNION ALL SELECT *, 'context_mean', p_ctx FROM preds0 UNION ALL SELECT *, 'context_mean_batch', p_ctxb FROM preds0 UNION ALL SELECT *, 'global_mean', p_glob FROM preds0)),
pairs0 AS (SELECT model, split, 'y' AS family, sample_id, feature_id, y AS t, y_pred AS p FROM preds UNION ALL SELECT model, split, 'delta', sample_id, feature_id, d, d_pred FROM preds
  UNION ALL SELECT model, split, 'ctx', sample_id, feature_id, d - mu_ctx, d_pred - mu_ctx FROM preds UNION ALL SELECT model, split, 'drug', sample_id, feature_id, d - mu_drug, d_pred - mu_drug FROM preds),
pairs AS (SELECT * FROM (SELECT * FROM pairs0 UNION ALL SELECT model, 'all', family, sample_id, feature_id, t, p FROM pairs0) WHERE t IS NOT NULL AND p IS NOT NULL)"""

#: n, pcc, r2 of t and p
PCC_SQL = "CASE WHEN count(*) >= 3 AND min(t) < max(t) AND min(p) < max(p) THEN greatest(-1, least(1, covar_pop(t, p) / sqrt(var_pop(t) * var_pop(p)))) END"
R2_SQL = "CASE WHEN count(*) >= 3 AND min(t) < max(t) THEN 1 - sum((t - p) * (t - p)) / (count(*) * var_pop(t)) END"


def scored_sql(source: str, *keys: str) -> str:
    ks = "".join(f"{k}, " for k in keys)
    return " UNION ALL ".join(f"SELECT {ks}'{g}' AS grain, {i} AS id, count(*) AS n, {PCC_SQL} AS pcc, {R2_SQL} AS r2 FROM {source} GROUP BY {ks}grain, id" .replace("GROUP BY " + ks + "grain, id", f"GROUP BY {ks}{i}" if i != "''" else "GROUP BY " + (ks.rstrip(", ") or "()")) for g, i in (("pooled", "''"), ("sample", "sample_id"), ("feature", "feature_id")))
