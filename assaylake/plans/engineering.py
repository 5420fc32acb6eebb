"""Feature engineering queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from assaylake.functions import fixtures as fx
from assaylake.functions.fixtures import sql
from assaylake.model import r6
from assaylake.operators import features, matching, ranks
from assaylake.plans.common import delta, normalised, treated
from assaylake.plans.frozen import _ROUTE, _routed
from assaylake.plans.registry import query, r

TABLES = {"d_ctx": ["strain", "medium", "temperature", "pert_time"], "d_strain": ["strain"], "d_drug": ["compound"], "d_drug_time": ["compound", "pert_time"], "d_batch": ["batch"], "d_plate": ["plate"], "d_time": ["pert_time"], "d_mtt": ["medium", "temperature", "pert_time"]}


def _key(ks: list[str]) -> str:
    return " || '|' || ".join(ks)


def _fit(s, d):
    return treated(s, d).where("split = 'train'")


@query("fe_derived_columns", sql("SELECT sample_id, CAST(pert_time AS DOUBLE) AS time_num, CAST(temperature AS DOUBLE) AS temperature_num, ascii(upper(substr(well, 1, 1))) - 64 AS well_row, CAST(regexp_extract(well, '([0-9]+)$', 1) AS INT) AS well_col FROM samples"))
def fe_derived_columns(s, d):
    return features.derived_columns(fx.samples(s, d)).select("sample_id", "time_num", "temperature_num", "well_row", "well_col")


@query("fe_group_mean", sql(" UNION ALL ".join(f"SELECT '{n}' AS name, {_key(k)} AS key, feature_id, {r('avg(value)')} AS mean, count(value) AS n FROM delta JOIN samples USING (sample_id) WHERE split = 'train' GROUP BY 2, 3 HAVING count(value) >= 3" for n, k in TABLES.items())))
def fe_group_mean(s, d):
    dl, fit, out = delta(s, d).select("sample_id", "feature_id", "value"), _fit(s, d), None
    for name, keys in TABLES.items():
        one = features.group_mean(dl, fit, keys).select(F.lit(name).alias("name"), "key", "feature_id", r6("mean").alias("mean"), "n")
        out = one if out is None else out.unionByName(one)
    return out


_DETECT = "count(*) / (SELECT count(*) FROM samples WHERE split = 'train' AND role = 'treatment')"


@query("fe_feature_stats", sql(f"SELECT feature_id, {r('avg(y)')} AS mean_y, {r('stddev_pop(y)')} AS sd_y, {r(_DETECT)} AS detect, {r('avg(value)')} AS mean_d, {r('stddev_pop(value)')} AS sd_d, {r('avg(abs(value))')} AS mean_abs_d FROM delta JOIN samples USING (sample_id) WHERE split = 'train' GROUP BY 1"))
def fe_feature_stats(s, d):
    fit = _fit(s, d)
    n = fit.agg(F.count("*").alias("ns"))
    g = delta(s, d).join(fit.select("sample_id"), "sample_id").groupBy("feature_id").agg(F.avg("y").alias("a"), F.stddev_pop("y").alias("b"), F.count("*").alias("k"), F.avg("value").alias("c"), F.stddev_pop("value").alias("e"), F.avg(F.abs("value")).alias("f"))
    return g.join(F.broadcast(n)).select("feature_id", r6("a").alias("mean_y"), r6("b").alias("sd_y"), r6(F.col("k") / F.col("ns")).alias("detect"), r6("c").alias("mean_d"), r6("e").alias("sd_d"), r6("f").alias("mean_abs_d"))


@query("fe_sample_stats", sql(f"SELECT sample_id, {r('median(control)')} AS ctrl_median, {r('count(control) / (SELECT count(*) FROM features)')} AS ctrl_detect FROM matched JOIN ctl_index USING (level, key) GROUP BY 1"))
def fe_sample_stats(s, d):
    nf = fx.features(s, d).agg(F.count("*").alias("nf"))
    a = matching.anchor(normalised(s, d), fx.samples(s, d)).groupBy("sample_id").agg(F.median("control").alias("m"), F.count("control").alias("k"))
    return a.join(F.broadcast(nf)).select("sample_id", r6("m").alias("ctrl_median"), r6(F.col("k") / F.col("nf")).alias("ctrl_detect"))


_FOLD = "fold AS (SELECT sample_id, CAST((row_number() OVER (ORDER BY md5('42:' || sample_id), sample_id) - 1) % 5 AS INT) AS fold FROM samples WHERE split = 'train' AND role = 'treatment')"


@query("fe_oof_fold", sql("SELECT sample_id, coalesce(fold, -1) AS fold FROM samples LEFT JOIN fold USING (sample_id) WHERE role = 'treatment'", _FOLD))
def fe_oof_fold(s, d):
    return treated(s, d).join(features.folds(_fit(s, d)), "sample_id", "left").select("sample_id", F.coalesce("fold", F.lit(-1)).alias("fold"))


_OOF = _FOLD + """, place AS (SELECT sample_id, strain || '|' || medium AS key, coalesce(fold, -1) AS fold FROM samples LEFT JOIN fold USING (sample_id) WHERE role = 'treatment'),
oof AS (SELECT a.sample_id, feature_id, CASE WHEN count(value) >= 3 THEN avg(value) END AS "full", CASE WHEN count(value) FILTER (b.fold <> a.fold) >= 3 THEN avg(value) FILTER (b.fold <> a.fold) END AS oof
  FROM place a JOIN place b ON a.key = b.key AND b.fold >= 0 JOIN delta d ON d.sample_id = b.sample_id GROUP BY 1, 2)"""


def _oof(s, d):
    return features.oof_group_mean(delta(s, d).select("sample_id", "feature_id", "value"), treated(s, d), features.folds(_fit(s, d)), ["strain", "medium"])


@query("fe_oof_group_mean", sql(f"SELECT sample_id, feature_id, {r('"full"')} AS full_mean, {r('oof')} AS oof_mean FROM oof", _OOF))
def fe_oof_group_mean(s, d):
    return _oof(s, d).select("sample_id", "feature_id", r6("full").alias("full_mean"), r6("oof").alias("oof_mean"))


@query("fe_oof_audit", sql('SELECT count(*) AS n, (round(avg(abs("full" - oof)), 6) + 0.0) AS mean_diff, (round(max(abs("full" - oof)), 6) + 0.0) AS max_diff FROM oof JOIN samples USING (sample_id) WHERE split = \'train\'', _OOF))
def fe_oof_audit(s, d):
    x = _oof(s, d).join(_fit(s, d).select("sample_id"), "sample_id")
    diff = F.abs(F.col("full") - F.col("oof"))
    return x.agg(F.count("*").alias("n"), r6(F.avg(diff)).alias("mean_diff"), r6(F.max(diff)).alias("max_diff"))


_SEEN = "(SELECT {0} FROM samples WHERE split = 'train' AND role = 'treatment')"


@query("fe_vocab_unseen", sql(f"SELECT sample_id, CASE WHEN compound IN {_SEEN.format('compound')} THEN compound ELSE '__UNSEEN__' END AS compound, CASE WHEN strain IN {_SEEN.format('strain')} THEN strain ELSE '__UNSEEN__' END AS strain FROM samples WHERE role = 'treatment'"))
def fe_vocab_unseen(s, d):
    fit = _fit(s, d)
    return features.vocabulary(features.vocabulary(treated(s, d), fit, "compound"), fit, "strain").select("sample_id", "compound", "strain")


@query("fe_unseen_mapping", sql(f"SELECT split, {r('avg(CASE WHEN compound IN ' + _SEEN.format('compound') + ' THEN 0.0 ELSE 1.0 END)')} AS share_compound, {r('avg(CASE WHEN strain IN ' + _SEEN.format('strain') + ' THEN 0.0 ELSE 1.0 END)')} AS share_strain FROM samples WHERE role = 'treatment' GROUP BY 1"))
def fe_unseen_mapping(s, d):
    x = fe_vocab_unseen(s, d).join(treated(s, d).select("sample_id", "split"), "sample_id")
    share = lambda c: r6(F.avg((F.col(c) == features.UNSEEN).cast("double")))
    return x.groupBy("split").agg(share("compound").alias("share_compound"), share("strain").alias("share_strain"))


@query("fe_prior_flags", sql(f"SELECT sample_id, CAST(compound IN {_SEEN.format('compound')} AS INT) AS has_drug_prior, CAST(strain IN {_SEEN.format('strain')} AS INT) AS has_strain_prior FROM samples WHERE role = 'treatment'"))
def fe_prior_flags(s, d):
    return treated(s, d).select("sample_id").join(fe_vocab_unseen(s, d), "sample_id").select("sample_id", (F.col("compound") != features.UNSEEN).cast("int").alias("has_drug_prior"), (F.col("strain") != features.UNSEEN).cast("int").alias("has_strain_prior"))


_SUB = "('0x' || substr(md5('42:' || sample_id || ':' || feature_id), 1, 6))::INT % 1000 < 300"


@query("fe_cell_subsample", sql(f"SELECT sample_id, feature_id FROM delta WHERE {_SUB}"))
def fe_cell_subsample(s, d):
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit("42"), "sample_id", "feature_id")), 1, 6), 16, 10).cast("int")
    return delta(s, d).where(h % 1000 < 300).select("sample_id", "feature_id")


def _design(s, d):
    """Delta cells with the control, two encodings, feature statistics and flags; big tables join on (sample, feature)."""
    fit = _fit(s, d)
    dl = delta(s, d)
    drug = features.group_mean(dl.select("sample_id", "feature_id", "value"), fit, ["compound"]).select(F.col("key").alias("compound"), "feature_id", F.col("mean").alias("d_drug"))
    strain = features.group_mean(dl.select("sample_id", "feature_id", "value"), fit, ["strain"]).select(F.col("key").alias("strain"), "feature_id", F.col("mean").alias("d_strain"))
    x = features.derived_columns(treated(s, d))
    return dl.join(x, "sample_id").join(drug, ["compound", "feature_id"], "left").join(strain, ["strain", "feature_id"], "left")


_DRUG = ", ".join(f"{n} AS (SELECT {k} AS {k}, feature_id, avg(value) AS {c} FROM delta JOIN samples USING (sample_id) WHERE split = 'train' GROUP BY 1, 2 HAVING count(value) >= 3)" for n, k, c in (("gd", "compound", "d_drug"), ("gs", "strain", "d_strain")))
_DESIGN = _DRUG + ", design AS (SELECT d.sample_id, d.feature_id, split, value, control, d_drug, d_strain, CAST(pert_time AS DOUBLE) AS time_num FROM delta d JOIN samples s USING (sample_id) LEFT JOIN gd ON gd.compound = s.compound AND gd.feature_id = d.feature_id LEFT JOIN gs ON gs.strain = s.strain AND gs.feature_id = d.feature_id)"


@query("fe_design_matrix", sql(f"SELECT sample_id, feature_id, {r('value')} AS target, {r('control')} AS c_ctrl, {r('d_drug')} AS d_drug, {r('d_strain')} AS d_strain, time_num FROM design", _DESIGN))
def fe_design_matrix(s, d):
    return _design(s, d).select("sample_id", "feature_id", r6("value").alias("target"), r6("control").alias("c_ctrl"), r6("d_drug").alias("d_drug"), r6("d_strain").alias("d_strain"), "time_num")


@query("fe_coverage", sql(f"SELECT split, {r('count(control) / count(*)')} AS c_ctrl, {r('count(d_drug) / count(*)')} AS d_drug, {r('count(d_strain) / count(*)')} AS d_strain FROM design GROUP BY 1", _DESIGN))
def fe_coverage(s, d):
    return _design(s, d).groupBy("split").agg(r6(F.count("control") / F.count("*")).alias("c_ctrl"), r6(F.count("d_drug") / F.count("*")).alias("d_drug"), r6(F.count("d_strain") / F.count("*")).alias("d_strain"))


@query("fe_availability_loss", sql("SELECT split, name FROM (SELECT split, 'd_drug' AS name, count(d_drug) / count(*) AS v FROM design GROUP BY 1 UNION ALL SELECT split, 'd_strain', count(d_strain) / count(*) FROM design GROUP BY 1) a WHERE v <= 0.02 AND split <> 'train'", _DESIGN))
def fe_availability_loss(s, d):
    x = fe_coverage(s, d).select("split", F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("v")) for c in ("d_drug", "d_strain")])))
    train = x.where("split = 'train' AND v > 0.02").select("name")
    return x.where("split <> 'train' AND v <= 0.02").join(F.broadcast(train), "name", "left_semi").select("split", "name")


@query("fe_target_stats", sql(f"SELECT split, {r('avg(value)')} AS mean_v, {r('stddev_pop(value)')} AS sd_v, {r('quantile_cont(value, 0.01)')} AS q01, {r('quantile_cont(value, 0.99)')} AS q99, {r('avg(CASE WHEN abs(value) > 1 THEN 1.0 ELSE 0.0 END)')} AS frac FROM design GROUP BY 1", _DESIGN))
def fe_target_stats(s, d):
    x = ranks.value_ranks(delta(s, d).join(treated(s, d).select("sample_id", "split"), "sample_id"), "value", "split")
    q = ranks.percentiles(x, "value", [0.01, 0.99], "split").select("split", r6(F.col("q")[0]).alias("q01"), r6(F.col("q")[1]).alias("q99"))
    large = x.groupBy("split").agg(r6(F.sum(F.when(F.abs("value") > 1, F.col("n")).otherwise(0)) / F.sum("n")).alias("frac"))
    m = ranks.moments(x, "value", "split").select("split", r6("mean").alias("mean_v"), r6("sd").alias("sd_v"))
    return m.join(q, "split").join(large, "split").select("split", "mean_v", "sd_v", "q01", "q99", "frac")


@query("fe_missing_rate", sql(" UNION ALL ".join(f"SELECT '{c}' AS name, {r(f'1 - count({c}) / count(*)')} AS rate FROM design" for c in ("control", "d_drug", "d_strain")), _DESIGN))
def fe_missing_rate(s, d):
    x = _design(s, d).agg(*[(1 - F.count(c) / F.count("*")).alias(c) for c in ("control", "d_drug", "d_strain")])
    return x.select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), r6(c).alias("rate")) for c in ("control", "d_drug", "d_strain")])))


_NO = {"compound": "regime IN ('chem_novel', 'both_novel')", "strain": "regime IN ('strain_novel', 'both_novel')"}


@query("fe_regime_mask", sql(f"SELECT sample_id, feature_id, regime, CASE WHEN NOT {_NO['compound']} THEN (round(d_drug, 6) + 0.0) END AS d_drug, CASE WHEN NOT {_NO['strain']} THEN (round(d_strain, 6) + 0.0) END AS d_strain, " + ", ".join(f"CASE WHEN {_NO[c]} THEN '{features.UNSEEN}' ELSE {c} END AS {c}, CAST(NOT {_NO[c]} AS INT) AS {flag}" for c, flag in (("compound", "has_drug_prior"), ("strain", "has_strain_prior"))) + " FROM design JOIN routed USING (sample_id)", _DESIGN + ", " + _ROUTE))
def fe_regime_mask(s, d):
    """By route, that is by which of its entities the fit rows have, whatever a row's split is called."""
    x = _design(s, d).join(_routed(s, d).select("sample_id", "regime"), "sample_id")
    x = features.regime_mask(x, ["d_drug"], ["d_strain"])
    return x.select("sample_id", "feature_id", "regime", r6("d_drug").alias("d_drug"), r6("d_strain").alias("d_strain"), "compound", "has_drug_prior", "strain", "has_strain_prior")


@query("fe_standardise_frozen", sql(f"SELECT sample_id, feature_id, {r('(coalesce(d_drug, m) - m) / CASE WHEN sd > 1e-6 THEN sd ELSE 1 END')} AS d_drug, {r('(control - cm) / CASE WHEN csd > 1e-6 THEN csd ELSE 1 END')} AS control FROM design, (SELECT avg(d_drug) AS m, stddev_pop(d_drug) AS sd, avg(control) AS cm, stddev_pop(control) AS csd FROM design WHERE split = 'train')", _DESIGN))
def fe_standardise_frozen(s, d):
    x = _design(s, d).select("sample_id", "feature_id", "split", "d_drug", "control")
    return features.standardise(x, "split = 'train'", ["d_drug", "control"]).select("sample_id", "feature_id", r6("d_drug").alias("d_drug"), r6("control").alias("control"))


_WORDS = "bits AS (SELECT DISTINCT doc_id AS entity, w AS bit FROM (SELECT doc_id, unnest(string_split(lower(text), ' ')) AS w FROM documents) WHERE w <> '')"


def bits(s, d):
    return fx.table(s, d, "documents").select(F.col("doc_id").alias("entity"), F.explode(F.array_distinct(F.split(F.lower("text"), " "))).alias("bit")).where("bit <> ''")


@query("fe_bit_filter", sql("SELECT bit, count(*) AS k FROM bits WHERE entity % 5 <> 0 GROUP BY 1 HAVING count(*) >= 2 AND count(*) <= (SELECT count(DISTINCT entity) FROM bits WHERE entity % 5 <> 0) - 2", _WORDS))
def fe_bit_filter(s, d):
    b = bits(s, d)
    return features.bit_filter(b, b.where("entity % 5 <> 0"))
