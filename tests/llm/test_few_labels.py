"""The quality classifier with few labels, ties and statistics that don't vary."""

import numpy as np
import pytest

from sparkloom.llm import quality, queries

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("n", [4, 12, 30, 79, 80, 200])
def test_few_rows_are_told_apart(n):
    rng = np.random.default_rng(n)
    y = np.arange(n) % 2.0
    x = np.stack([y * 2 + rng.random(n), rng.random(n), np.ones(n)], 1)
    bias, rules = quality.fit_rules(x, y)
    score = np.full(n, bias)
    for w, rule in rules:
        score[quality._matches(x, rule)] += w
    assert rules and ((score > 0) == (y > 0)).mean() >= 0.9


def test_nothing_to_tell_by():
    for x, y in ((np.ones((50, 2)), np.arange(50) % 2.0), (np.zeros((3, 1)), np.ones(3)), (np.zeros((0, 1)), np.zeros(0))):
        bias, rules = quality.fit_rules(x, y)
        assert not rules and np.isfinite(bias)
    x = np.repeat([[1.0], [2.0]], 20, 0)  # ties: only one cut there is
    _, rules = quality.fit_rules(x, np.repeat([0.0, 1.0], 20))
    assert {t for _, rule in rules for _, _, t in rule} == {1.5}


def test_smallest_tables_get_rules(spark):
    got = {r.doc_id: r for r in queries.op9_quality(spark, SMALL).collect()}
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()]
    right = [(got[i].score >= 0.5) == (y == 1) for i, y in labels if got[i].held_out]
    assert len({r.score for r in got.values()}) > 3 and np.mean(right) > 0.85
