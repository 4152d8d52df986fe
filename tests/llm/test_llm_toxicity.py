import numpy as np
import pytest
from pyspark.sql import functions as F

from readyscope.llm import registry, toxicity


def test_held_out_accuracy(spark):
    """Fit on half of the labels, judge the other half."""
    base = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{base}/documents.parquet")
    labels = spark.read.parquet(f"{base}/labels.parquet")
    half = F.pmod(F.hash("doc_id"), F.lit(2))
    model = toxicity.fit(docs, labels.where(half == 0))
    held = docs.join(labels.where(half == 1), "doc_id")
    rated = toxicity.with_severity(held, model).select("toxic", "severity").collect()
    caught = [r["severity"] >= model.rejected_from for r in rated if r["toxic"] == 1]
    accused = [r["severity"] >= model.rejected_from for r in rated if r["toxic"] == 0]
    assert np.mean(caught) > 0.8 and np.mean(accused) < 0.01


def test_ordinal_fit():
    """One feature whose count moves the grade: weights and thresholds are found."""
    rng = np.random.default_rng(1)
    x = rng.integers(0, 6, 4000).astype(float)
    noise = rng.logistic(size=4000)
    grades = np.digitize(1.5 * x + noise, [2.0, 4.0, 6.0])
    rows = np.arange(4000)
    weights, cuts = toxicity.fit_ordinal(
        rows, np.zeros(4000, int), x, grades, np.zeros(1), 4, penalty=1e-6, rounds=2000
    )
    assert weights[0] == pytest.approx(1.5, abs=0.15)
    assert cuts == pytest.approx([2, 4, 6], abs=0.4)
    assert (np.diff(cuts) > 0).all()


def test_expected_severity():
    model = toxicity.SeverityModel({"x": 2.0}, (0.0, 1.0))
    low, high = model.expected(np.array([0.0, 100.0]))
    assert low == pytest.approx(0.5 + 1 / (1 + np.e)) and high == pytest.approx(2)
    assert model.word_weight("x") == 2.0 and model.word_weight("y") == 0


def test_separating():
    severity = np.array([0.1, 0.1, 0.2, 0.9, 1.6])
    toxic = np.array([False, False, False, True, True])
    assert toxicity.separating(severity, toxic) == pytest.approx(np.sqrt(0.2 * 0.9))
    assert toxicity.separating(np.ones(3), np.array([True, False, True])) == float("inf")


def test_odd_rows(odd, empty, odd_rows, labels):
    rated = toxicity.grade_documents(odd, labels)
    assert rated.columns == odd.columns  # severity and toxic take the place of theirs
    rows = rated.collect()
    assert len(rows) == len(odd_rows)
    assert len({r["severity"] for r in rows if not (r["text"] or "").strip()}) == 1
    assert toxicity.grade_documents(empty, labels).count() == 0
    none = toxicity.grade_documents(odd, labels.where("false")).collect()
    assert {(r["severity"], r["toxic"]) for r in none} == {(0.0, False)}


def test_contradicting_labels_count_as_toxic(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "doc_id long, toxic int")
    found = {r["doc_id"]: r["toxic"] for r in toxicity.labelled_sample(docs, labels).collect()}
    assert found == {1: True, 2: False}


def test_feature_counts_of_batches_of_one_class(spark):
    """A batch without a toxic document, one without any other, one without words."""
    schema = "text string, toxic boolean"
    for rows in ([("aa bb", False), ("aa", False)], [("aa bb", True), ("aa", True)], [("", True)]):
        sample = spark.createDataFrame(rows, schema).coalesce(1)
        found = {tuple(r) for r in toxicity.feature_counts(sample).collect()}
        toxic = rows[0][1]
        wanted = [("aa", 2), ("bb", 1)] if rows[0][0] else []
        assert found == {(f, n if toxic else 0, 0 if toxic else n) for f, n in wanted}


def test_query(spark, sf_dir, texts):
    rows = registry.queries()["op8_toxicity"](spark, sf_dir).collect()
    assert {r["doc_id"] for r in rows} == {i for i, _ in texts}
    assert all(r["kept"] != r["toxic"] for r in rows)
