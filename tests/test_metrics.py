"""Hand-worked cases and degenerate inputs of the masked metrics."""

import math

from assaylake.operators import metrics


def _pairs(spark, rows):
    return spark.createDataFrame([(s, f, i, t, p) for s, cells in rows.items() for i, (f, t, p) in enumerate(cells)], "sample_id string, feature_id string, feature_idx int, t double, p double")


def _hand(spark):
    """Cut at 1: true changes are f0, f2, f4; f4 is just missed, f3 is called wrongly; f1 is no change at all."""
    cells = [("f0", -1.4, -2.0), ("f1", 0.0, 0.3), ("f2", 2.2, 1.1), ("f3", 0.9, -1.6), ("f4", 1.25, 0.99), ("f5", -0.4, 0.99)]
    return _pairs(spark, {"a": cells})


def test_dep_hand_case(spark):
    c = metrics.dep_counts(_hand(spark)).first()
    assert (c.tp, c.fp, c.fn) == (2, 1, 1)
    assert all(math.isclose(x, 2 / 3) for x in (c.precision, c.recall, c.f1))
    # the three largest predicted changes are f0, f3, f2: two of three true ones
    assert math.isclose(metrics.dep_rank(_hand(spark)).first().recall_at_k, 2 / 3)


def test_average_precision_groups_ties(spark):
    x = _pairs(spark, {"a": [("f0", 2.0, 1.0), ("f1", 0.0, 1.0), ("f2", 2.0, 0.5), ("f3", 0.0, 0.1)]})
    assert math.isclose(metrics.dep_auprc(x).first().auprc, 0.5 * 0.5 + 0.5 * 2 / 3)


def test_undefined_correlations(spark):
    x = _pairs(spark, {
        "short": [("f0", 1.0, 1.0), ("f1", 2.0, 2.0)], "flat": [("f0", 1.0, 1.0), ("f1", 1.0, 2.0), ("f2", 1.0, 3.0)],
        "masked": [("f0", 1.0, None), ("f1", None, 2.0), ("f2", 1.0, 3.0)], "good": [("f0", 1.0, 2.0), ("f1", 2.0, 4.0), ("f2", 3.0, 6.0)],
    })
    got = {r.id: (r.pcc, r.r2) for r in metrics.scores(x).where("grain = 'sample'").collect()}
    assert got["short"] == (None, None) and got["flat"] == (None, None) and got["masked"] == (None, None)
    assert math.isclose(got["good"][0], 1.0) and math.isclose(got["good"][1], 1 - 14 / 2)
