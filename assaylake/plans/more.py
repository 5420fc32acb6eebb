"""Imputation, variance attribution, bootstrap, knowledge penalties, clusters and further checks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from assaylake.functions import fixtures as fx
from assaylake.functions.fixtures import sql
from assaylake.functions.scratch import written
from assaylake.model import r6
from assaylake.operators import features, helpers, metrics, normalize, profile
from assaylake.plans.common import PRED_SQL, normalised, treated
from assaylake.plans.qc import _RATES
from assaylake.plans.registry import query, r
from assaylake.plans.scoring import _COUNTS, _LONG, _SC, _SPEC, _by_model, _scores, metric_rows
from assaylake.plans.side import _ACT, _MAP, _potency
from assaylake.sources import tables


@query("tf_frozen_impute", sql(f"SELECT s.sample_id, f.feature_id, {r('coalesce(y.value, fill, (SELECT median(fill) FROM fills))')} AS value, y.value IS NULL AS imputed FROM samples s CROSS JOIN features f LEFT JOIN y ON y.sample_id = s.sample_id AND y.feature_id = f.feature_id LEFT JOIN fills ON fills.feature_id = f.feature_id", "fills AS (SELECT feature_id, median(value) AS fill FROM y JOIN samples USING (sample_id) WHERE split = 'train' GROUP BY 1)"))
def tf_frozen_impute(s, d):
    return normalize.frozen_impute(normalised(s, d), fx.samples(s, d), fx.features(s, d)).withColumn("value", r6("value"))


@query("pca_feature_filter", sql("SELECT feature_id FROM rates GROUP BY 1 HAVING min(rate) >= 0.75", _RATES))
def pca_feature_filter(s, d):
    return profile.detection_rates(fx.cells(s, d), fx.samples(s, d), fx.features(s, d)).groupBy("feature_id").agg(F.min("rate").alias("low")).where("low >= 0.75").select("feature_id")


_DENSE = "dense AS (SELECT vec_id AS sample, generate_subscripts(embedding, 1) - 1 AS feature, unnest(embedding)::DOUBLE AS value, label AS factor, vec_id % 4 <> 0 AS fit FROM embeddings)"


@query("stat_eta_squared", "WITH " + _DENSE + f", g AS (SELECT feature, factor, count(*) AS n, avg(value) AS m FROM dense GROUP BY 1, 2), t AS (SELECT feature, avg(value) AS gm, var_pop(value) * count(*) AS ss FROM dense GROUP BY 1) SELECT CAST(feature AS INT) AS feature, {r('sum(n * (m - gm) * (m - gm)) / max(ss)')} AS eta2 FROM g JOIN t USING (feature) GROUP BY 1")
def stat_eta_squared(s, d):
    x = fx.dense(s, d)
    g = x.groupBy("feature", "factor").agg(F.count("*").alias("n"), F.avg("value").alias("m"))
    t = x.groupBy("feature").agg(F.avg("value").alias("gm"), (F.var_pop("value") * F.count("*")).alias("ss"))
    return g.join(F.broadcast(t), "feature").groupBy("feature").agg(r6(F.sum(F.col("n") * (F.col("m") - F.col("gm")) * (F.col("m") - F.col("gm"))) / F.max("ss")).alias("eta2"))


@query("pca_fit_project")
def pca_fit_project(s, d):
    x = fx.dense(s, d)
    return helpers.pca(x, x.where("fit"))[0].withColumn("score", r6("score"))


_GROUPS = "mem AS (SELECT DISTINCT p_type AS grp, p_brand AS feature_id FROM part), kk AS (SELECT grp, count(*) AS k FROM mem GROUP BY 1), ed AS (SELECT grp, a.feature_id AS a, b.feature_id AS b, 1.0 / (k - 1) AS w FROM mem a JOIN mem b USING (grp) JOIN kk USING (grp) WHERE a.feature_id < b.feature_id AND k > 1)"


def _complexes(s, d):
    m = fx.table(s, d, "part").select(F.col("p_type").alias("grp"), F.col("p_brand").alias("feature_id")).distinct()
    k = m.groupBy("grp").agg(F.count("*").alias("k")).where("k > 1")
    a, b = m.toDF("grp", "a"), m.toDF("grp", "b")
    return a.join(b, "grp").where("a < b").join(F.broadcast(k), "grp").select("grp", "a", "b", (1.0 / (F.col("k") - 1)).alias("w"))


@query("kb_complex_edges", sql(f"SELECT grp, a, b, {r('w')} AS w FROM ed", _GROUPS))
def kb_complex_edges(s, d):
    return _complexes(s, d).withColumn("w", r6("w"))


@query("kb_complex_penalty", sql(f"SELECT {r('avg(p)')} AS penalty, count(*) AS n FROM (SELECT x.sample_id, sum(w * (x.value - z.value) * (x.value - z.value)) AS p FROM ed JOIN y x ON x.feature_id = a JOIN y z ON z.feature_id = b AND z.sample_id = x.sample_id GROUP BY 1)", _GROUPS))
def kb_complex_penalty(s, d):
    y = normalised(s, d)
    e = _complexes(s, d).groupBy("a", "b").agg(F.sum("w").alias("w"))  # a pair of several groups weighs their sum
    x = y.select("sample_id", F.col("feature_id").alias("a"), F.col("value").alias("xa")).join(e, "a").join(y.select("sample_id", F.col("feature_id").alias("b"), F.col("value").alias("xb")), ["sample_id", "b"])
    p = x.groupBy("sample_id").agg(F.sum(F.col("w") * (F.col("xa") - F.col("xb")) * (F.col("xa") - F.col("xb"))).alias("p"))
    return p.agg(r6(F.avg("p")).alias("penalty"), F.count("*").alias("n"))


@query("cl_order_by_mean", sql(f"SELECT cluster, CAST(dense_rank() OVER (ORDER BY m) AS INT) AS place, {r('m')} AS mean_value, n_features FROM (SELECT feature_idx % 4 AS cluster, avg(value) AS m, count(DISTINCT feature_id) AS n_features FROM y JOIN features USING (feature_id) GROUP BY 1)"))
def cl_order_by_mean(s, d):
    g = normalised(s, d).join(F.broadcast(fx.features(s, d)), "feature_id").groupBy((F.col("feature_idx") % 4).alias("cluster")).agg(F.avg("value").alias("m"), F.countDistinct("feature_id").alias("n_features"))
    return g.select("cluster", F.dense_rank().over(Window.orderBy("m")).alias("place"), r6("m").alias("mean_value"), "n_features")


@query("cl_feature_stats", sql(f"SELECT feature_id, {r('coalesce(m, median(m) OVER ())')} AS mean_v, {r('coalesce(sd, median(sd) OVER ())')} AS sd_v FROM (SELECT feature_id, avg(value) AS m, stddev_pop(value) AS sd FROM features LEFT JOIN y USING (feature_id) GROUP BY 1)"))
def cl_feature_stats(s, d):
    g = fx.features(s, d).select("feature_id").join(normalised(s, d), "feature_id", "left").groupBy("feature_id").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("sd"))
    return g.join(F.broadcast(g.agg(F.median("m").alias("mm"), F.median("sd").alias("ms")))).select("feature_id", r6(F.coalesce("m", "mm")).alias("mean_v"), r6(F.coalesce("sd", "ms")).alias("sd_v"))


_EXPECT = [("Brand#11", "n0", True), ("Brand#23", "n3", True), ("Brand#99", "n1", False)]


@query("tg_expectation_check", sql("SELECT e.entity, e.feature, positive, coalesce(max(pact), 0) > 0 AS hit, (coalesce(max(pact), 0) > 0) = positive AS holds FROM (VALUES " + ", ".join(f"('{a}', '{b}', {c})" for a, b, c in _EXPECT) + ") e(entity, feature, positive) LEFT JOIN mapped ON mapped.feature = e.feature LEFT JOIN best ON best.entity = e.entity AND best.target = mapped.target GROUP BY 1, 2, 3", _ACT + ", " + _MAP))
def tg_expectation_check(s, d):
    e = s.createDataFrame(_EXPECT, "entity string, feature string, positive boolean")
    hit = F.coalesce("pact", F.lit(0.0)) > 0
    return e.join(_potency(s, d), ["entity", "feature"], "left").select("entity", "feature", "positive", hit.alias("hit"), (hit == F.col("positive")).alias("holds"))


@query("fe_flagged_zero_fill", f"SELECT p_partkey AS feature, {r('coalesce(max(5 + l_tax * 10), 0)')} AS descriptor, CAST(count(l_partkey) > 0 AS INT) AS present FROM part LEFT JOIN lineitem ON l_partkey = p_partkey AND l_discount = 0 GROUP BY 1")
def fe_flagged_zero_fill(s, d):
    """The descriptor is a feature's largest curated value; some features have none and get zero and a flag."""
    curated = fx.table(s, d, "lineitem").where("l_discount = 0").groupBy(F.col("l_partkey").alias("feature")).agg(F.max(5 + F.col("l_tax") * 10).alias("v"))
    return fx.table(s, d, "part").select(F.col("p_partkey").alias("feature")).join(curated, "feature", "left").select("feature", r6(F.coalesce("v", F.lit(0.0))).alias("descriptor"), F.col("v").isNotNull().cast("int").alias("present"))


@query("fe_attach_entity_block", sql("SELECT sample_id, compound, n_train, n_unknown FROM samples JOIN (SELECT compound, count(*) AS n_train FROM samples WHERE split = 'train' AND role = 'treatment' GROUP BY 1) USING (compound), (SELECT count(*) AS n_unknown FROM samples WHERE role = 'treatment' AND compound NOT IN (SELECT compound FROM samples WHERE split = 'train' AND role = 'treatment')) WHERE role = 'treatment'"))
def fe_attach_entity_block(s, d):
    """The block of compounds comes from train rows, so held-out compounds are unknown to it: here they are counted."""
    t = treated(s, d)
    block = t.where("split = 'train'").groupBy("compound").agg(F.count("*").alias("n_train"))
    unknown = t.join(block, "compound", "left_anti").agg(F.count("*").alias("n_unknown"))
    return features.attach_block(t, block, "compound", strict=False).crossJoin(unknown).select("sample_id", "compound", "n_train", "n_unknown")


_TOTALS = ", tot AS (SELECT convention, model, sum(score * mw) AS total, bool_and(score BETWEEN 0 AND 1) AS in_range FROM assembled GROUP BY 1, 2)"


@query("vf_score_consistency", sql("SELECT convention, model, in_range, abs(total - CAST(printf('%.5f', total) AS DOUBLE)) <= 5.1e-6 AS csv_holds, total <= (SELECT sum(mw) FROM (SELECT DISTINCT module, mw FROM assembled a WHERE a.convention = tot.convention)) + 1e-9 AS adds_up FROM tot", _LONG + _SPEC + _TOTALS))
def vf_score_consistency(s, d):
    """Scores lie in [0, 1], contributions add up to the total made from the weights, and so does the exported CSV."""
    x = written(metrics.assemble(metric_rows(s, d)), "assembled")
    w = metrics.convention_table(s).select("convention", "module", "module_weight").distinct()
    total = F.sum(F.col("score") * F.col("module_weight"))
    y = x.join(F.broadcast(w), ["convention", "module"]).groupBy("convention", "model").agg(F.bool_and(F.col("score").between(0, 1)).alias("in_range"), total.alias("total"), F.sum("contribution").alias("parts"), F.sum("module_weight").alias("most"))
    back = tables.export_csv(y.select("convention", "model", F.format_string("%.5f", F.col("total")).alias("csv")))
    z = y.join(back, ["convention", "model"])
    adds_up = (F.abs(F.col("total") - F.col("parts")) < 1e-9) & (F.col("total") <= F.col("most") + 1e-9)
    return z.select("convention", "model", "in_range", (F.abs(F.col("total") - F.col("csv").cast("double")) <= 5.1e-6).alias("csv_holds"), adds_up.alias("adds_up"))


def boot_sql(source: str, *keys: str) -> str:
    """Tables boot_n and boot of the intervals of `source` (keys, sample_id, value), drawn as helpers.bootstrap_ci draws."""
    ks = ", ".join(keys)
    u = "CAST('0x' || substr(md5('42:' || rep || ':' || sample_id), 1, 8) AS BIGINT) / 4294967296.0"
    w = "CASE " + " ".join(f"WHEN u < {p!r}::DOUBLE THEN {k}" for k, p in enumerate(helpers.POISSON)) + f" ELSE {len(helpers.POISSON)} END"
    return f"""boot_n AS (SELECT {ks}, count(*) AS n, avg(value) AS mean FROM {source} WHERE value IS NOT NULL GROUP BY ALL),
boot_w AS (SELECT {ks}, rep, value, {w} AS w FROM (SELECT *, {u} AS u FROM {source}, range(1000) t(rep) WHERE value IS NOT NULL)),
boot_m AS (SELECT {ks}, rep, sum(w * value) / sum(w) AS m FROM boot_w GROUP BY ALL HAVING sum(w) > 0),
boot AS (SELECT {ks}, n, {r('mean')} AS mean, CASE WHEN n >= 3 THEN {r('lo')} END AS lo, CASE WHEN n >= 3 THEN {r('hi')} END AS hi
  FROM boot_n JOIN (SELECT {ks}, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM boot_m GROUP BY ALL) USING ({ks}))"""


def _rounded(x):
    return x.withColumns({c: r6(c) for c in ("mean", "lo", "hi")})


@query("sc_bootstrap_ci", sql("SELECT * FROM boot", _SC + ", per AS (SELECT model, split, id AS sample_id, pcc AS value FROM sc WHERE grain = 'sample' AND family = 'delta'), " + boot_sql("per", "model", "split")))
def sc_bootstrap_ci(s, d):
    """Intervals of the mean per-sample correlation, by model and split."""
    x = _scores(s, d).where("grain = 'sample' AND family = 'delta'").select("model", "split", F.col("id").alias("sample_id"), F.col("pcc").alias("value"))
    return _rounded(helpers.bootstrap_ci(x, "model", "split"))


_F1 = "f1s AS (SELECT sample_id, max(CASE WHEN model = 'context_mean_batch' THEN f1 END) - max(CASE WHEN model = 'context_mean' THEN f1 END) AS value FROM dep GROUP BY 1)"


@query("sc_paired_bootstrap", sql("SELECT * FROM boot", PRED_SQL + _COUNTS + ", " + _F1 + ", per AS (SELECT 'f1' AS metric, * FROM f1s), " + boot_sql("per", "metric")))
def sc_paired_bootstrap(s, d):
    """Interval of the mean difference of two models on samples where both are defined."""
    x = _by_model(s, d, metrics.dep_counts).groupBy("sample_id").pivot("model", ["context_mean", "context_mean_batch"]).agg(F.first("f1"))
    diff = x.select(F.lit("f1").alias("metric"), "sample_id", (F.col("context_mean_batch") - F.col("context_mean")).alias("value"))
    return _rounded(helpers.bootstrap_ci(diff, "metric"))
