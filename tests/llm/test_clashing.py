"""Pipeline stages over tables whose other columns have the names that the operators use inside."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

SMALL = "/root/testdata/sf0.001"
NAMES = ["__own", "__row", "__text", "__rest", "__t", "__chars", "__w", "row", "spans", "h", "y", "f", "key", "kept", "component_id", "score", "value", "at", "n", "block", "item_id", "rank"]


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(2, 6)))
    base = [word() for _ in range(90)]
    texts = [" ".join(word() for _ in range(50)) for _ in range(12)] + [" ".join(base), " ".join([*base[:80], "changed", *base[81:]]), None, "", "x"]
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").withColumns({n: F.concat(F.lit(n), "doc_id") for n in NAMES})


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_columns_go_along(spark, docs, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    got = stage(spark, docs, SMALL)
    assert got.columns == docs.columns
    rows = got.collect()
    assert rows and all(r[n] == f"{n}{r.doc_id}" for r in rows for n in NAMES)
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in stage(spark, docs.drop(*NAMES), SMALL).collect())
    assert stage(spark, docs.where("false"), SMALL).count() == 0


def test_last_stage(spark, docs):
    assert corpus_pipeline.bpe_stage(spark, docs, SMALL).count() == docs.count()
