"""Cross-fitted predictions by regime and what is read off them."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from assaylake.functions import fixtures as fx
from assaylake.functions.scratch import written
from assaylake.model import r6
from assaylake.operators import crossfit
from assaylake.plans.common import delta
from assaylake.plans.registry import query


def _design(s, d, **more):
    return crossfit.design(delta(s, d), crossfit.dev_rows(fx.samples(s, d)), **more)


def _kept_design(s, d, **more):
    """The design as a written table, for what reads it more than once."""
    return written(_design(s, d, **more), "crossfit-design")


@query("ml_crossfit_predict")
def ml_crossfit_predict(s, d):
    """Each development cell's prediction by a model that has not seen its row, nor its compound or strain where these
    count as novel. No SQL: tests hold it against a plain fit of every fold and regime."""
    x = _kept_design(s, d)
    return crossfit.predict(x, crossfit.models(x)).select("sample_id", "feature_id", "fold", "regime", r6("pred").alias("pred"))


@query("ml_regime_gbt")
def ml_regime_gbt(s, d):
    """(regime, n, mse, mse_of_mean): a fold's development cells by gradient-boosted specialists, beside the error of the
    fit cells' mean. No SQL: a test holds that each cell is predicted once and that blank columns weigh nothing."""
    x = _kept_design(s, d, folds=[0])
    p, _ = crossfit.boosted(x, 0)
    mean = x.where("fold = 0 AND fit").agg(F.avg("value").alias("m"))
    error = lambda c: r6(F.avg((F.col(c) - F.col("value")) * (F.col(c) - F.col("value"))))
    return p.crossJoin(F.broadcast(mean)).groupBy("regime").agg(F.count("*").alias("n"), error("pred").alias("mse"), error("m").alias("mse_of_mean"))


@query("route_ablation")
def route_ablation(s, d):
    """By regime, what the specialists are worth: error and correlation of their predictions, and of those by the `full`
    model for every row."""
    x = _kept_design(s, d)
    p = crossfit.predict(x, crossfit.models(x))
    pcc = lambda c: F.try_divide(F.covar_pop("value", c), F.sqrt(F.var_pop("value") * F.var_pop(c)))
    mse = lambda c: F.avg((F.col(c) - F.col("value")) * (F.col(c) - F.col("value")))
    g = p.groupBy("regime").agg(F.count("*").alias("n"), *[f(c).alias(f"{n}_{c}") for c in ("pred", "forced") for n, f in (("pcc", pcc), ("mse", mse))])
    return g.select("regime", "n", *[r6(f"{n}_{c}").alias(f"{n}_{to}") for c, to in (("pred", "routed"), ("forced", "forced")) for n in ("pcc", "mse")], r6(F.col("mse_forced") - F.col("mse_pred")).alias("gain"))


PENALTIES = [0.0001, 0.001, 0.01, 0.1, 1.0, 10.0]


@query("ml_tuning_trials")
def ml_tuning_trials(s, d):
    """(regime, penalty, mse, n, place): every penalty for every regime by its error on development cells, best first."""
    rows = s.createDataFrame(crossfit.trials(_design(s, d), PENALTIES), "regime string, penalty double, mse double, n long")
    place = F.row_number().over(Window.partitionBy("regime").orderBy(F.round("mse", 9), "penalty"))  # over the candidates
    return rows.select("regime", "penalty", r6("mse").alias("mse"), "n", place.alias("place"))


@query("ml_importance_share")
def ml_importance_share(s, d):
    """(regime, column, share, place): each column's mean share of importance over the folds' models; shares add up to 1."""
    found = crossfit.models(_design(s, d))
    rows = s.createDataFrame([(g, c, float(v)) for (_, g), (_, shares) in found.items() for c, v in zip(crossfit.COLUMNS, shares, strict=True)], "regime string, column string, share double")
    mean = rows.groupBy("regime", "column").agg(F.avg("share").alias("share"))
    place = F.row_number().over(Window.partitionBy("regime").orderBy(F.desc(F.round("share", 9)), "column"))
    return mean.select("regime", "column", r6("share").alias("share"), place.alias("place"))
