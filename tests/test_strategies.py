"""Scores of strategies: worked candidates, and which shuffles they need."""

import pytest

from evispark.operators import comparison as C
from evispark.plans import catalog

SF = "/root/testdata/sf0.001"
SCHEMA = "entry long, field_id string, track string, pos long, value string, status string, score double, want string"


def test_strategies_of_worked_candidates(spark):
    rows = [
        (1, "B.other", "translated", 1, "wrong", "found", 0.9, "right"), (1, "B.other", "original", 2, "RIGHT", "found", 0.1, "right"), (1, "B.other", "original", 0, "right", "missing", 0.1, "right"),
        (2, C.DISEASE_FIELD, "translated", 1, "wrong", "found", None, "ataxia type one"), (2, C.DISEASE_FIELD, "translated", 2, "ataxia type", "found", 0.0, "ataxia type one"), (3, "B.other", "original", 1, None, "not_found", 0.5, "x"),
        (4, "B.other", "original", 1, "extra", "found", 0.5, None), (5, C.RELATIONSHIP_FIELD, "original", 1, "no", "found", 0.5, "causative"), (5, C.RELATIONSHIP_FIELD, "original", 2, "causative", "found", 0.5, "causative"),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["strategy"]: (r["tp"], r["fp"], r["fn"]) for r in C.oracle_scores(df).collect()}
    assert got == {"oracle_best_dual_candidate": (3, 0, 1), "oracle_relationship_only": (1, 2, 1), "oracle_disease_only": (1, 2, 1), "oracle_no_over_extractions": (0, 3, 1)}
    got = {r["strategy"]: (r["tp"], r["fp"], r["fn"]) for r in C.ablation_scores(df).collect()}
    assert got == {"original_only": (1, 1, 2), "translated_only": (0, 2, 2), "first_found": (1, 2, 1), "best_score": (1, 2, 1)}
    only = df.filter("entry = 3 OR track = 'original'")
    assert {r["strategy"] for r in C.ablation_scores(only).collect()} == {"original_only", "first_found", "best_score"}


@pytest.mark.parametrize("name", ["j19_ablation", "j20_oracle_upper_bound"])
def test_lines_are_dealt_once_and_then_picks(spark, name):
    """Expected values, found ones and each strategy's were shuffled by themselves: 39 times the input was on disk."""
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2
