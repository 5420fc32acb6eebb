"""Reconstruction, blends and co-moment tables of prediction members."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def reconstruct(control: str, predicted: str, fallback: str) -> Column:
    """Control plus predicted change; without a control the fallback plus what change there is."""
    return F.when(F.col(control).isNotNull() & F.col(predicted).isNotNull(), F.col(control) + F.col(predicted)).otherwise(F.col(fallback) + F.coalesce(predicted, F.lit(0.0)))


def weighted_blend(members: DataFrame, weights: DataFrame) -> DataFrame:
    """Sum of w[regime, role, cluster] times member; the weights are a small literal table."""
    return members.join(F.broadcast(weights), ["regime", "role", "cluster"]).groupBy("sample_id", "feature_id").agg(F.sum(F.col("w") * F.coalesce("value", F.lit(0.0))).alias("blend"))


def blend_of_wide(wide: DataFrame, weights: dict[str, Column]) -> DataFrame:
    """(sample_id, feature_id, blend): the same where a cell is one row with a column for each member; nothing is shuffled.
    `weights` has each member's, which may depend on the row; a null member counts as 0."""
    total = sum((w * F.coalesce(F.col(m), F.lit(0.0)) for m, w in weights.items()), F.lit(0.0))
    return wide.select("sample_id", "feature_id", total.alias("blend"))


def gram(wide: DataFrame, roles: list[str], *keys: str) -> DataFrame:
    """Sums that any weighting can be scored from: n, T, TT, and for each pair of members F, TF, FF. One aggregate."""
    t = F.col("t")
    aggs = [F.count("*").alias("n"), F.sum(t).alias("st"), F.sum(t * t).alias("stt")]
    for i, a in enumerate(roles):
        aggs += [F.sum(a).alias(f"s_{a}"), F.sum(t * F.col(a)).alias(f"st_{a}")]
        aggs += [F.sum(F.col(a) * F.col(b)).alias(f"s_{a}_{b}") for b in roles[i:]]
    return wide.groupBy(*keys).agg(*aggs)


def gram_pcc(g: DataFrame, roles: list[str], weights: dict[str, float]) -> DataFrame:
    """Pearson correlation of t with the weighted sum of members, from the sums alone."""
    s = sum((F.col(f"s_{a}") * w for a, w in weights.items()), F.lit(0.0))
    ts = sum((F.col(f"st_{a}") * w for a, w in weights.items()), F.lit(0.0))
    ss = F.lit(0.0)
    for i, a in enumerate(roles):
        for b in roles[i:]:
            ss = ss + F.col(f"s_{a}_{b}") * (weights.get(a, 0.0) * weights.get(b, 0.0) * (1 if a == b else 2))
    n = F.col("n")
    vt, vp = F.col("stt") - F.col("st") * F.col("st") / n, ss - s * s / n
    return g.withColumn("pcc", F.when((n >= 3) & (vt > 1e-9) & (vp > 1e-9), (ts - F.col("st") * s / n) / F.sqrt(vt * vp)))


def pareto_front(configs: DataFrame, score: str, cost: str) -> DataFrame:
    """Configurations that none beats on score at no more cost; over a table of configurations."""
    before = Window.orderBy(cost, F.desc(score)).rowsBetween(Window.unboundedPreceding, -1)
    return configs.withColumn("__best", F.max(score).over(before)).where(F.col("__best").isNull() | (F.col(score) > F.col("__best"))).drop("__best")


def promote_weights(clusters: DataFrame, weights: DataFrame) -> DataFrame:
    """(fine, coarse, n, role, w): the weights (role, coarse, w) for finer clusters (feature_id, fine, coarse), each with
    those of its features' most frequent coarse cluster, ties to the smaller."""
    counts = clusters.groupBy("fine", "coarse").agg(F.count("*").alias("k"))
    parent = counts.groupBy("fine").agg(F.max_by("coarse", F.struct("k", -F.col("coarse"))).alias("coarse"), F.sum("k").alias("n"))
    return parent.join(weights, "coarse").select("fine", "coarse", "n", "role", "w")
