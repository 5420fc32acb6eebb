"""Sources, sinks, profiling and quality control."""

from __future__ import annotations

from pyspark.sql import functions as F

from assaylake.functions import fixtures as fx
from assaylake.functions.fixtures import sql
from assaylake.model import CONTROL_LEVELS, r6
from assaylake.operators import matching, normalize, profile, ranks
from assaylake.plans.registry import query, r
from assaylake.sources import tables

BATCHES = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
SPLITS = ["test_both", "test_chem_only", "test_strain_only", "test_time", "train", "val_both", "val_chem_only", "val_strain_only", "val_time"]
META = ["sample_id", "cohort", "batch", "strain", "medium", "temperature", "pert_time", "compound", "plate", "well", "pert_id", "role", "split"]


def normalised(s, d):
    return normalize.median_normalise(normalize.log2(fx.cells(s, d)), fx.samples(s, d))


@query("src_metadata", sql(f"SELECT {', '.join(META)} FROM samples"))
def src_metadata(s, d):
    return tables.as_strings(fx.samples(s, d), META)


_WIDE = "wide AS (PIVOT (SELECT sample_id, feature_id, value FROM cells) ON feature_id USING first(value) GROUP BY sample_id)"


@query("src_matrix_wide_to_long", sql(f"SELECT sample_id, feature_id, {r('value')} AS value FROM cells WHERE value IS NOT NULL"))
def src_matrix_wide_to_long(s, d):
    names = [x[0] for x in fx.features(s, d).orderBy("feature_idx").select("feature_id").collect()]
    wide = tables.to_wide(fx.cells(s, d), names)
    return tables.to_long(wide, names).select("sample_id", "feature_id", r6("value").alias("value"))


@query("src_align_check", sql("""SELECT (SELECT count(*) FROM samples WHERE sample_id NOT IN (SELECT sample_id FROM cells)) AS metadata_only,
  (SELECT count(DISTINCT sample_id) FROM cells WHERE sample_id NOT IN (SELECT sample_id FROM samples)) AS matrix_only,
  (SELECT count(DISTINCT sample_id) FROM cells WHERE sample_id IN (SELECT sample_id FROM samples)) AS both_have"""))
def src_align_check(s, d):
    return tables.align_check(fx.samples(s, d).select("sample_id"), fx.cells(s, d).select("sample_id").distinct())


@query("src_column_contract", sql("""SELECT feature_id, max(CASE WHEN cohort = 'test' THEN 1 ELSE 0 END) AS in_test, max(CASE WHEN cohort <> 'test' THEN 1 ELSE 0 END) AS in_train_val
  FROM cells JOIN samples USING (sample_id) GROUP BY 1"""))
def src_column_contract(s, d):
    c = fx.cells(s, d).join(fx.samples(s, d).select("sample_id", "cohort"), "sample_id")
    return c.groupBy("feature_id").agg(F.max((F.col("cohort") == "test").cast("int")).alias("in_test"), F.max((F.col("cohort") != "test").cast("int")).alias("in_train_val"))


@query("src_schema_probe", "SELECT 'customer' AS name, count(*) AS n_rows, count(DISTINCT c_custkey) AS n_ids, 5 AS n_columns FROM customer UNION ALL SELECT 'part', count(*), count(DISTINCT p_partkey), 6 FROM part")
def src_schema_probe(s, d):
    return tables.schema_probe({n: (fx.table(s, d, n), k) for n, k in (("customer", "c_custkey"), ("part", "p_partkey"))})


@query("sink_long_parquet", sql(f"SELECT cohort, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(30,4))) AS DOUBLE) AS total FROM cells JOIN samples USING (sample_id) GROUP BY 1"))
def sink_long_parquet(s, d):
    annotated = fx.cells(s, d).join(fx.samples(s, d).select("sample_id", "cohort"), "sample_id")
    back = tables.long_parquet(annotated, "cohort")
    return back.groupBy("cohort").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(30,4)")).cast("double").alias("total"))


_BRANDS = [f"Brand#{i}{j}" for i in range(1, 6) for j in range(1, 6)]


@query("sink_wide_pivot", sql("SELECT sample_id, " + ", ".join(f"round(max(value) FILTER (feature_id = '{b}'), 4) AS \"{b}\"" for b in _BRANDS) + " FROM cells GROUP BY 1"))
def sink_wide_pivot(s, d):
    return tables.to_wide(fx.cells(s, d), _BRANDS)


@query("sink_csv_5dp", sql("SELECT sample_id, feature_id, printf('%.5f', value) AS value FROM cells"))
def sink_csv_5dp(s, d):
    return tables.csv_round_trip(fx.cells(s, d))


@query("sink_strict_json", sql("""SELECT sample_id, '{"sample_id":"' || sample_id || '","n":' || count(*) || ',"undefined":null}' AS report FROM cells GROUP BY 1"""))
def sink_strict_json(s, d):
    per = fx.cells(s, d).groupBy("sample_id").agg(F.count("*").alias("n")).withColumn("undefined", F.lit(float("nan")))
    return tables.strict_json(per, ["undefined"]).select("sample_id", "report")


@query("src_annotated_meta", sql("SELECT sample_id, compound, CASE WHEN compound IN ('Water','DMSO') THEN 'control' WHEN compound = 'Quality Control' THEN 'qc' ELSE 'treatment' END AS sample_role FROM samples"))
def src_annotated_meta(s, d):
    return tables.csv_annotated(fx.samples(s, d).select("sample_id", "compound"))


_COLS = ["batch", "strain", "compound", "plate", "well", "split"]


@query("qc_column_profile", sql(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS n_missing, count(DISTINCT {c}) AS n_unique FROM samples" for c in _COLS)))
def qc_column_profile(s, d):
    return profile.column_profile(fx.samples(s, d), _COLS)


@query("qc_column_levels", sql("SELECT \"column\", level, n FROM (SELECT *, row_number() OVER (PARTITION BY \"column\" ORDER BY n DESC, level) AS rk, count(*) OVER (PARTITION BY \"column\") AS k FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS level, count(*) AS n FROM samples GROUP BY 2" for c in _COLS) + ")) WHERE k <= 60 OR rk <= 20"))
def qc_column_levels(s, d):
    return profile.column_levels(fx.samples(s, d), _COLS)


@query("qc_key_checks", sql("SELECT cohort, count(*) AS n, count(DISTINCT sample_id) AS n_unique, count(*) - count(DISTINCT sample_id) AS n_duplicates FROM samples GROUP BY 1"))
def qc_key_checks(s, d):
    return profile.key_checks(fx.samples(s, d), "sample_id", "cohort")


@query("qc_crosstab", sql("SELECT split, " + ", ".join(f"count(*) FILTER (batch = '{b}') AS \"{b}\"" for b in BATCHES) + " FROM samples GROUP BY 1"))
def qc_crosstab(s, d):
    return profile.crosstab(fx.samples(s, d), "split", "batch", BATCHES)


@query("qc_entity_visibility", sql("SELECT compound, max(CAST(split = 'train' AS INT)) AS in_train, max(CAST(cohort = 'test' AS INT)) AS in_test, max(CAST(cohort <> 'test' AS INT)) AS in_train_val FROM samples GROUP BY 1"))
def qc_entity_visibility(s, d):
    return profile.entity_visibility(fx.samples(s, d), "compound")


@query("qc_split_novelty", sql("""SELECT split, count(*) AS n_samples, count(DISTINCT strain) AS n_strains, count(DISTINCT CASE WHEN strain NOT IN (SELECT strain FROM samples WHERE split = 'train') THEN strain END) AS novel_strains,
  count(DISTINCT compound) AS n_compounds, count(DISTINCT CASE WHEN compound NOT IN (SELECT compound FROM samples WHERE split = 'train') THEN compound END) AS novel_compounds FROM samples GROUP BY 1"""))
def qc_split_novelty(s, d):
    return profile.split_novelty(fx.samples(s, d))


@query("qc_role", sql("SELECT cohort, role, count(*) AS n FROM samples GROUP BY 1, 2"))
def qc_role(s, d):
    return fx.samples(s, d).groupBy("cohort", "role").agg(F.count("*").alias("n"))


_FD = "SELECT {k}, count(DISTINCT compound) AS n_values, string_agg(DISTINCT compound, ',' ORDER BY compound) AS vals FROM samples GROUP BY {k}"


@query("qc_functional_dependency", sql(_FD.format(k="pert_id")))
def qc_functional_dependency(s, d):
    return profile.functional_dependency(fx.samples(s, d), ["pert_id"], "compound")


@query("qc_functional_dependency_batch", sql(_FD.format(k="batch, pert_id")))
def qc_functional_dependency_batch(s, d):
    return profile.functional_dependency(fx.samples(s, d), ["batch", "pert_id"], "compound")


@query("qc_control_availability", sql(f"SELECT lk.level AS level, count(*) AS n_treated, count(c.level) AS n_with_control, {r('avg(CASE WHEN c.level IS NULL THEN 0.0 ELSE 1.0 END)')} AS share FROM trt LEFT JOIN ctl_keys c ON c.level = lk.level AND c.key = lk.key GROUP BY 1"))
def qc_control_availability(s, d):
    return profile.control_availability(fx.samples(s, d), CONTROL_LEVELS).withColumn("share", r6("share"))


def _matched(s, d):
    x = fx.samples(s, d)
    return x, matching.match(x.where("role = 'treatment'"), x.where("role = 'control'"))


@query("qc_match_cascade", sql("SELECT level, newly, CAST(sum(newly) OVER (ORDER BY level) AS BIGINT) AS cumulative, CAST((SELECT count(*) FROM samples WHERE role = 'treatment') - sum(newly) OVER (ORDER BY level) AS BIGINT) AS unmatched FROM (SELECT CAST(g AS INT) AS level, count(m.level) AS newly FROM generate_series(1, 6) t(g) LEFT JOIN matched m ON m.level = g GROUP BY 1)"))
def qc_match_cascade(s, d):
    x, m = _matched(s, d)
    return profile.match_cascade(m, x.where("role = 'treatment'"), 6)


@query("qc_fell_through", sql("SELECT batch || '|' || strain || '|' || medium || '|' || temperature || '|' || pert_time AS context, count(*) AS n FROM samples JOIN matched USING (sample_id) WHERE level > 1 GROUP BY 1 ORDER BY n DESC, context LIMIT 12"))
def qc_fell_through(s, d):
    x, m = _matched(s, d)
    return profile.fell_through(x.where("role = 'treatment'"), m, CONTROL_LEVELS[0])


_GROUPS = "g AS (SELECT batch, strain, string_agg(DISTINCT compound, '+' ORDER BY compound) AS vehicles, count(*) AS replicates FROM samples WHERE role = 'control' GROUP BY 1, 2)"


@query("qc_group_composition", sql("SELECT vehicles, count(*) AS n_groups, median(replicates) AS median_replicates, min(replicates) AS min_replicates, max(replicates) AS max_replicates FROM g GROUP BY 1", _GROUPS))
def qc_group_composition(s, d):
    return profile.group_composition(fx.samples(s, d), ["batch", "strain"])[0]


@query("qc_replicate_histogram", sql("SELECT replicates, count(*) AS n_groups FROM g GROUP BY 1", _GROUPS))
def qc_replicate_histogram(s, d):
    return profile.group_composition(fx.samples(s, d), ["batch", "strain"])[1]


def _possible(s, d):
    return fx.samples(s, d).agg(F.count("*").alias("ns")).join(fx.features(s, d).agg(F.count("*").alias("nf"))).select((F.col("ns") * F.col("nf")).alias("n_possible"))


@query("qc_value_probe", sql(f"""SELECT (SELECT count(*) FROM samples) * (SELECT count(*) FROM features) - count(value) AS n_missing, count(*) FILTER (value = 0) AS n_zero, count(*) FILTER (value < 0) AS n_negative,
  {r('quantile_cont(value, 0.01) FILTER (value <> 0)')} AS p01, {r('quantile_cont(value, 0.5) FILTER (value <> 0)')} AS p50, {r('quantile_cont(value, 0.99) FILTER (value <> 0)')} AS p99, max(value) < 64 AND count(*) FILTER (value < 0) = 0 AS looks_log FROM cells"""))
def qc_value_probe(s, d):
    return profile.value_probe(fx.cells(s, d), _possible(s, d)).withColumns({c: r6(c) for c in ("p01", "p50", "p99")})


@query("qc_missingness", sql("""SELECT cohort, median(n) AS median_detected, min(n) AS min_detected, max(n) AS max_detected, CAST(sum(n) AS BIGINT) AS n_cells, CAST(count(*) * (SELECT count(*) FROM features) - sum(n) AS BIGINT) AS n_missing
  FROM (SELECT s.sample_id, cohort, count(value) AS n FROM samples s LEFT JOIN cells USING (sample_id) GROUP BY 1, 2) GROUP BY 1"""))
def qc_missingness(s, d):
    per = fx.samples(s, d).select("sample_id", "cohort").join(fx.cells(s, d).groupBy("sample_id").agg(F.count("value").alias("n")), "sample_id", "left").na.fill(0, ["n"])
    nf = fx.features(s, d).agg(F.count("*").alias("nf"))
    g = per.groupBy("cohort").agg(F.median("n").alias("median_detected"), F.min("n").alias("min_detected"), F.max("n").alias("max_detected"), F.sum("n").alias("n_cells"), F.count("*").alias("ns"))
    return g.join(F.broadcast(nf)).select("cohort", "median_detected", "min_detected", "max_detected", "n_cells", (F.col("ns") * F.col("nf") - F.col("n_cells")).alias("n_missing"))


_RATES = "rates AS (SELECT cohort, f.feature_id, count(value) AS detected, count(*) AS n, count(value) / count(*) AS rate FROM samples CROSS JOIN features f LEFT JOIN cells c ON c.sample_id = samples.sample_id AND c.feature_id = f.feature_id GROUP BY 1, 2)"


@query("qc_feature_coverage", sql("SELECT feature_id, max(CAST(detected = n AS INT)) AS in_all, max(CAST(detected = 0 AS INT)) AS in_none FROM rates GROUP BY 1", _RATES))
def qc_feature_coverage(s, d):
    x = profile.detection_rates(fx.cells(s, d), fx.samples(s, d), fx.features(s, d))
    return x.groupBy("feature_id").agg(F.max((F.col("detected") == F.col("n")).cast("int")).alias("in_all"), F.max((F.col("detected") == 0).cast("int")).alias("in_none"))


@query("qc_detection_thresholds", sql("SELECT CAST(t AS DOUBLE) AS threshold, count(*) FILTER (low >= t) AS n_features FROM (SELECT feature_id, min(rate) AS low FROM rates GROUP BY 1), (SELECT unnest([0.5, 0.7, 0.9, 0.95, 0.99, 1.0]) AS t) GROUP BY 1", _RATES))
def qc_detection_thresholds(s, d):
    low = profile.detection_rates(fx.cells(s, d), fx.samples(s, d), fx.features(s, d)).groupBy("feature_id").agg(F.min("rate").alias("low"))
    return low.select("low", F.explode(F.array(*[F.lit(t) for t in (0.5, 0.7, 0.9, 0.95, 0.99, 1.0)])).alias("threshold")).groupBy("threshold").agg(F.sum((F.col("low") >= F.col("threshold")).cast("long")).alias("n_features"))


@query("tf_log2", sql(f"SELECT sample_id, feature_id, {r('value')} AS value FROM lg"))
def tf_log2(s, d):
    return normalize.log2(fx.cells(s, d)).withColumn("value", r6("value"))


@query("tf_median_normalise", sql(f"SELECT sample_id, feature_id, {r('value')} AS value FROM y"))
def tf_median_normalise(s, d):
    return normalised(s, d).withColumn("value", r6("value"))


_SM = f"sm AS (SELECT sample_id, count(value) AS n, median(value) AS med, avg(value) AS mean, stddev_pop(value) AS sd, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM lg GROUP BY 1)"


def _sample_metrics(s, d):
    q = F.percentile("value", F.array(F.lit(0.25), F.lit(0.75)))
    return normalize.log2(fx.cells(s, d)).groupBy("sample_id").agg(F.count("value").alias("n"), F.median("value").alias("med"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"), (q[1] - q[0]).alias("iqr"))


@query("qc_sample_metrics", sql(f"SELECT sample_id, batch, strain, role, n AS n_detected, {r('n / (SELECT count(*) FROM features)')} AS frac_detected, {r('med')} AS median_v, {r('mean')} AS mean_v, {r('sd')} AS sd_v, {r('iqr')} AS iqr_v FROM sm JOIN samples USING (sample_id)", _SM))
def qc_sample_metrics(s, d):
    nf = fx.features(s, d).agg(F.count("*").alias("nf"))
    x = _sample_metrics(s, d).join(fx.samples(s, d), "sample_id").join(F.broadcast(nf))
    return x.select("sample_id", "batch", "strain", "role", F.col("n").alias("n_detected"), r6(F.col("n") / F.col("nf")).alias("frac_detected"), r6("med").alias("median_v"), r6("mean").alias("mean_v"), r6("sd").alias("sd_v"), r6("iqr").alias("iqr_v"))


@query("qc_feature_metrics", sql(f"SELECT cohort, feature_id, {r('count(value) / (SELECT count(*) FROM samples t WHERE t.cohort = s.cohort)')} AS rate, {r('avg(value)')} AS mean_v, {r('stddev_pop(value)')} AS sd_v FROM lg JOIN samples s USING (sample_id) GROUP BY 1, 2"))
def qc_feature_metrics(s, d):
    x = fx.samples(s, d)
    sizes = x.groupBy("cohort").agg(F.count("*").alias("ns"))
    g = normalize.log2(fx.cells(s, d)).join(x.select("sample_id", "cohort"), "sample_id").groupBy("cohort", "feature_id").agg(F.count("value").alias("n"), F.avg("value").alias("m"), F.stddev_pop("value").alias("sd"))
    return g.join(F.broadcast(sizes), "cohort").select("cohort", "feature_id", r6(F.col("n") / F.col("ns")).alias("rate"), r6("m").alias("mean_v"), r6("sd").alias("sd_v"))


@query("qc_robust_outlier", sql(f"SELECT sample_id, n, {r('CASE WHEN mad = 0 THEN 0 ELSE 0.6745 * (n - c) / mad END')} AS robust_z, CASE WHEN mad = 0 THEN 0 ELSE 0.6745 * (n - c) / mad END < -3.5 AS outlier FROM sm, (SELECT median(n) AS c FROM sm), (SELECT median(abs(n - (SELECT median(n) FROM sm))) AS mad FROM sm)", _SM))
def qc_robust_outlier(s, d):
    return normalize.robust_outliers(_sample_metrics(s, d).select("sample_id", "n"), "n").withColumn("robust_z", r6("robust_z"))


@query("qc_tail_topk", sql(f"SELECT sample_id, feature_id, {r('value')} AS value FROM y ORDER BY y.value DESC, sample_id, feature_id LIMIT 8"))
def qc_tail_topk(s, d):
    return normalised(s, d).orderBy(F.desc("value"), "sample_id", "feature_id").limit(8).withColumn("value", r6("value"))


@query("qc_tail_range", sql(f"SELECT {r('min(value)')} AS lo, {r('max(value)')} AS hi, {r('quantile_cont(value, 0.001)')} AS q001, {r('quantile_cont(value, 0.999)')} AS q999, count(*) FILTER (value > 18) AS over_18, count(*) FILTER (value > 19) AS over_19 FROM y"))
def qc_tail_range(s, d):
    x = ranks.value_ranks(normalised(s, d), "value")
    over = lambda cut: F.sum(F.when(F.col("value") > cut, F.col("n")).otherwise(0))
    ends = x.agg(r6(F.min("value")).alias("lo"), r6(F.max("value")).alias("hi"), over(18).alias("over_18"), over(19).alias("over_19"))
    q = ranks.percentiles(x, "value", [0.001, 0.999]).select(r6(F.col("q")[0]).alias("q001"), r6(F.col("q")[1]).alias("q999"))
    return ends.crossJoin(q).select("lo", "hi", "q001", "q999", "over_18", "over_19")


@query("qc_id_patterns", "SELECT count(*) AS n, count(*) FILTER (regexp_matches(p_brand, '^Brand#[0-9]+$')) AS brand_form, count(*) FILTER (regexp_matches(p_name, '^[a-z]+ [a-z]+$')) AS two_words, count(*) FILTER (regexp_matches(p_type, '^[A-Z]+$')) AS upper_form FROM part")
def qc_id_patterns(s, d):
    one = lambda c, p: F.sum(F.col(c).rlike(p).cast("long"))
    return fx.table(s, d, "part").agg(F.count("*").alias("n"), one("p_brand", "^Brand#[0-9]+$").alias("brand_form"), one("p_name", "^[a-z]+ [a-z]+$").alias("two_words"), one("p_type", "^[A-Z]+$").alias("upper_form"))


@query("tf_id_repair", "SELECT p_partkey, CASE WHEN p_brand = 'Brand#13' THEN 'OCT1' ELSE p_brand END AS p_brand FROM part")
def tf_id_repair(s, d):
    return normalize.repair_ids(fx.table(s, d, "part").select("p_partkey", "p_brand"), "p_brand", {"Brand#13": "OCT1"})
