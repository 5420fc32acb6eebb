"""Names, levels and weights that the jobs share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CONTROLS, QC = ("Water", "DMSO"), ("Quality Control",)
TRAIN = "train"

# Levels from fine to coarse, as names of key columns; no key is the global level.
CONTROL_LEVELS = [["batch", "strain", "medium", "temperature", "pert_time"], ["batch", "strain", "medium", "temperature"], ["strain", "medium", "temperature", "pert_time"], ["strain", "medium", "temperature"], ["strain"], []]
CONTEXT_LEVELS = [["strain", "medium", "temperature", "pert_time"], ["strain", "medium", "temperature"], ["medium", "temperature", "pert_time"], ["medium", "temperature"], []]
CONTEXT_BATCH_LEVELS = [["batch", "strain", "medium", "temperature", "pert_time"], ["batch", "strain", "medium", "temperature"], ["batch", "medium", "temperature", "pert_time"], ["batch", "medium", "temperature"], ["batch"], []]
COMPOUND_LEVELS = [["compound"], []]

# Weights of the seven modules, and of the metrics within each.
MODULE_WEIGHTS = {"m1_abundance": 0.20, "m2_fold_change": 0.25, "m3_s1_chem": 0.20, "m3_s2_strain": 0.20, "m3_s3_both": 0.05, "m3_time": 0.05, "m4_dep": 0.05}
MODULE_SPLITS = {"m1_abundance": "all", "m2_fold_change": "all", "m3_s1_chem": "val_chem_only", "m3_s2_strain": "val_strain_only", "m3_s3_both": "val_both", "m3_time": "val_time", "m4_dep": "all"}
THIRD = 1 / 3
CONVENTIONS = {
    "per_sample_primary": {
        "m1_abundance": {"pcc_pooled": 0.25, "pcc_feature": 0.25, "r2_pooled": 0.25, "r2_feature": 0.25},
        "m2_fold_change": {"pcc_sample": 0.75, "pcc_pooled": 0.25},
        "m3_s1_chem": {"ctx_pcc_sample": 0.75, "ctx_pcc_pooled": 0.25},
        "m3_s2_strain": {"drug_pcc_sample": 0.75, "drug_pcc_pooled": 0.25},
        "m3_s3_both": {"pcc_sample": THIRD, "ctx_pcc_sample": THIRD, "drug_pcc_sample": THIRD},
        "m3_time": {"pcc_sample": THIRD, "ctx_pcc_sample": THIRD, "drug_pcc_sample": THIRD},
        "m4_dep": {"precision_macro": 0.25, "recall_at_k": 0.25, "f1_macro": 0.25, "auprc": 0.25},
    },
    "pooled_only": {
        "m1_abundance": {"pcc_pooled": 0.5, "r2_pooled": 0.5},
        "m2_fold_change": {"pcc_pooled": 1.0},
        "m3_s1_chem": {"ctx_pcc_pooled": 1.0},
        "m3_s2_strain": {"drug_pcc_pooled": 1.0},
        "m3_s3_both": {"pcc_pooled": THIRD, "ctx_pcc_pooled": THIRD, "drug_pcc_pooled": THIRD},
        "m3_time": {"pcc_pooled": THIRD, "ctx_pcc_pooled": THIRD, "drug_pcc_pooled": THIRD},
        "m4_dep": {"precision_micro": 0.25, "recall_at_k": 0.25, "f1_micro": 0.25, "auprc": 0.25},
    },
    "per_sample_only": {
        "m1_abundance": {"pcc_sample": 0.5, "r2_sample": 0.5},
        "m2_fold_change": {"pcc_sample": 1.0},
        "m3_s1_chem": {"ctx_pcc_sample": 1.0},
        "m3_s2_strain": {"drug_pcc_sample": 1.0},
        "m3_s3_both": {"pcc_sample": THIRD, "ctx_pcc_sample": THIRD, "drug_pcc_sample": THIRD},
        "m3_time": {"pcc_sample": THIRD, "ctx_pcc_sample": THIRD, "drug_pcc_sample": THIRD},
        "m4_dep": {"precision_macro": 0.25, "recall_at_k": 0.25, "f1_macro": 0.25, "auprc": 0.25},
    },
    "per_feature_primary": {
        "m1_abundance": {"pcc_feature": 0.5, "r2_feature": 0.5},
        "m2_fold_change": {"pcc_feature": 1.0},
        "m3_s1_chem": {"ctx_pcc_feature": 1.0},
        "m3_s2_strain": {"drug_pcc_feature": 1.0},
        "m3_s3_both": {"pcc_feature": THIRD, "ctx_pcc_feature": THIRD, "drug_pcc_feature": THIRD},
        "m3_time": {"pcc_feature": THIRD, "ctx_pcc_feature": THIRD, "drug_pcc_feature": THIRD},
        "m4_dep": {"precision_macro": 0.25, "recall_at_k": 0.25, "f1_macro": 0.25, "auprc": 0.25},
    },
}


def r6(c: Column | str) -> Column:
    """Six decimals, without a negative zero."""
    return F.round(c, 6) + F.lit(0.0)


def level_key(keys: list[str]) -> Column:
    return F.concat_ws("|", *keys) if keys else F.lit("all")


def by_level(levels: list[list[str]]) -> Column:
    """An array of (level, key) structs, one for each level of a hierarchy, to explode."""
    return F.array(*[F.struct(F.lit(i).alias("level"), level_key(k).alias("key")) for i, k in enumerate(levels, 1)])


def missing_to_null(c: Column | str) -> Column:
    """NULL for what is not finite: a measurement is there or it is NULL, never NaN."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
