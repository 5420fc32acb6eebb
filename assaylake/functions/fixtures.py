"""Canonical tables of the jobs, from the star-schema tables, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_id, cohort, batch, strain, medium, temperature, pert_time, compound, plate, well, pert_id, role, split."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    base = c.select(
        F.col("c_custkey").alias("k0"), F.col("c_custkey").cast("string").alias("sample_id"),
        F.when(F.expr("c_custkey % 3 = 0"), "test").otherwise("train_val").alias("cohort"), F.col("c_mktsegment").alias("batch"), F.col("n_regionkey").cast("string").alias("strain"),
        F.expr("concat('M', c_custkey % 2)").alias("medium"), F.expr("if((c_custkey div 2) % 2 = 0, '30', '37')").alias("temperature"),
        F.expr("element_at(array('15','30','60','90','120','240'), cast((c_custkey div 4) % 6 as int) + 1)").alias("pert_time"),
        F.expr("(c_custkey * 5 + c_custkey div 11) % 12").alias("k"), F.expr("concat('P', c_custkey % 20)").alias("plate"),
        F.expr("concat(substr('ABCDEFGH', cast(c_custkey % 8 as int) + 1, 1), 1 + (c_custkey div 8) % 12)").alias("well"),
    )
    gap = F.expr("(batch = 'MACHINERY' and strain = '3') or (pert_time = '240' and strain = '1')")
    named = base.withColumn("compound", F.expr("case k when 0 then 'Water' when 1 then 'DMSO' when 2 then 'Quality Control' else concat('C', k) end"))
    named = named.withColumn("compound", F.when(gap & F.col("compound").isin("Water", "DMSO"), "Quality Control").otherwise(F.col("compound")))
    named = named.withColumn("pert_id", F.expr("concat('#', (k + length(batch)) % 12)")).withColumn("role", F.expr("case when compound in ('Water','DMSO') then 'control' when compound = 'Quality Control' then 'qc' else 'treatment' end"))
    split = F.expr("case when strain = '4' and compound in ('C10','C11') then 'both' when compound in ('C10','C11') then 'chem_only' when strain = '4' then 'strain_only' when k0 % 17 = 0 then 'time' else 'train' end")
    named = named.withColumn("s", split)
    full = F.expr("case when cohort = 'test' then concat('test_', if(s = 'train', 'time', s)) when s = 'train' then 'train' else concat('val_', s) end")
    return named.withColumn("split", full).select("sample_id", "cohort", "batch", "strain", "medium", "temperature", "pert_time", "compound", "plate", "well", "pert_id", "role", "split")


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """feature_id and its place on the axis, by name; a dimension table of a few rows."""
    from pyspark.sql import Window

    brands = table(spark, sf_dir, "part").select(F.col("p_brand").alias("feature_id")).distinct()
    return brands.withColumn("feature_idx", F.row_number().over(Window.orderBy("feature_id")) - 1)


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linear measurements (sample_id, feature_id, value); what was not detected has no row.

    Lines are dealt by sample: what is grouped or joined by sample afterwards is not shuffled again.
    """
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    joined = li.join(p, F.col("l_partkey") == F.col("p_partkey")).join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    lines = joined.select(F.col("o_custkey").cast("string").alias("sample_id"), F.col("p_brand").alias("feature_id"), "v").repartition("sample_id")
    return lines.groupBy("sample_id", "feature_id").agg(F.round(F.sum("v"), 4).alias("value"))


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample int, feature int, value, factor, fit) of the embeddings."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("sample"), F.posexplode("embedding").alias("feature", "value"), F.col("label").alias("factor"), (F.col("vec_id") % 4 != 0).alias("fit")).withColumn("value", F.col("value").cast("double"))


_SAMPLES = """
base0 AS (SELECT c_custkey AS k0, CAST(c_custkey AS VARCHAR) AS sample_id, CASE WHEN c_custkey % 3 = 0 THEN 'test' ELSE 'train_val' END AS cohort, c_mktsegment AS batch,
  CAST(n_regionkey AS VARCHAR) AS strain, 'M' || (c_custkey % 2) AS medium, CASE WHEN (c_custkey // 2) % 2 = 0 THEN '30' ELSE '37' END AS temperature,
  (['15','30','60','90','120','240'])[(c_custkey // 4) % 6 + 1] AS pert_time, (c_custkey * 5 + c_custkey // 11) % 12 AS k, 'P' || (c_custkey % 20) AS plate,
  substr('ABCDEFGH', c_custkey % 8 + 1, 1) || (1 + (c_custkey // 8) % 12) AS well FROM customer JOIN nation ON c_nationkey = n_nationkey),
base1 AS (SELECT *, CASE k WHEN 0 THEN 'Water' WHEN 1 THEN 'DMSO' WHEN 2 THEN 'Quality Control' ELSE 'C' || k END AS compound0 FROM base0),
base2 AS (SELECT *, CASE WHEN compound0 IN ('Water','DMSO') AND ((batch = 'MACHINERY' AND strain = '3') OR (pert_time = '240' AND strain = '1')) THEN 'Quality Control' ELSE compound0 END AS compound FROM base1),
base3 AS (SELECT *, '#' || ((k + length(batch)) % 12) AS pert_id, CASE WHEN compound IN ('Water','DMSO') THEN 'control' WHEN compound = 'Quality Control' THEN 'qc' ELSE 'treatment' END AS role,
  CASE WHEN strain = '4' AND compound IN ('C10','C11') THEN 'both' WHEN compound IN ('C10','C11') THEN 'chem_only' WHEN strain = '4' THEN 'strain_only' WHEN k0 % 17 = 0 THEN 'time' ELSE 'train' END AS s FROM base2),
samples AS (SELECT sample_id, cohort, batch, strain, medium, temperature, pert_time, compound, plate, well, pert_id, role,
  CASE WHEN cohort = 'test' THEN 'test_' || CASE WHEN s = 'train' THEN 'time' ELSE s END WHEN s = 'train' THEN 'train' ELSE 'val_' || s END AS split FROM base3),
features AS (SELECT p_brand AS feature_id, CAST(row_number() OVER (ORDER BY p_brand) - 1 AS INTEGER) AS feature_idx FROM (SELECT DISTINCT p_brand FROM part)),
cells AS (SELECT CAST(o_custkey AS VARCHAR) AS sample_id, p_brand AS feature_id, round(sum(l_extendedprice * (1 - l_discount)), 4) AS value FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
lg AS (SELECT sample_id, feature_id, CASE WHEN value > 0 THEN log2(value) END AS value FROM cells),
med AS (SELECT sample_id, median(value) AS m FROM lg GROUP BY 1),
ref AS (SELECT median(m) AS ref FROM med JOIN samples USING (sample_id) WHERE split = 'train'),
y AS (SELECT lg.sample_id, feature_id, value - m + ref AS value FROM lg JOIN med USING (sample_id), ref WHERE value IS NOT NULL)"""


def level_sql(levels: list[list[str]], alias: str = "") -> str:
    """A list of (level, key) structs, for unnest."""
    dot = f"{alias}." if alias else ""
    key = lambda ks: "'all'" if not ks else " || '|' || ".join(f"{dot}{k}" for k in ks)
    return "[" + ", ".join(f"{{'level': {i}, 'key': {key(ks)}}}" for i, ks in enumerate(levels, 1)) + "]"


def _control_sql() -> str:
    from assaylake.model import CONTROL_LEVELS

    return f"""
ctl_pool AS (SELECT sample_id, compound, unnest({level_sql(CONTROL_LEVELS)}) AS lk FROM samples WHERE role = 'control'),
ctl_keys AS (SELECT DISTINCT lk.level AS level, lk.key AS key FROM ctl_pool),
trt AS (SELECT sample_id, unnest({level_sql(CONTROL_LEVELS)}) AS lk FROM samples WHERE role = 'treatment'),
matched AS (SELECT sample_id, min(lk.level) AS level, arg_min(lk.key, lk.level) AS key FROM trt JOIN ctl_keys c ON c.level = lk.level AND c.key = lk.key GROUP BY 1),
ctl_index AS (SELECT lk.level AS level, lk.key AS key, feature_id, median(value) AS control, count(*) AS n_controls FROM ctl_pool JOIN y USING (sample_id) GROUP BY ALL),
delta AS (SELECT sample_id, feature_id, y.value - control AS value, control, y.value AS y, m.level AS level FROM matched m JOIN y USING (sample_id) JOIN ctl_index i USING (level, key, feature_id))"""


def sql(body: str, more: str = "") -> str:
    """`body` with the canonical tables as common table expressions; only those it names are evaluated."""
    return "WITH " + _SAMPLES.strip() + "," + _control_sql() + (", " + more if more else "") + "\n" + body
