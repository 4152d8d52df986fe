import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from readyscope.llm import quality, registry

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {
        j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1
        for j in range(i, i + 3)
    }
    lines = [line for line in (text or "").split("\n") if WORD.search(line)]
    n = len(words)
    return (
        n, sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"),
        len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n,
    )


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_query_equals_plain_version(spark, sf_dir, texts):
    rows = {r["doc_id"]: r for r in registry.queries()["op7_quality"](spark, sf_dir).collect()}
    assert len(rows) == len(texts)
    for doc_id, text in texts:
        row = rows[doc_id]
        assert tuple(row[c] for c in COUNTS) == plain_counts(text)
        assert row["kept"] == (not row["base_failed"] and row["llr"] >= quality.THRESHOLD)


@pytest.mark.parametrize("text", [
    "a b c a b c", "a b c x a b c", "a a a a a", "a b a b a b", "a b", "", None, " \n \n",
    "x y\nx y\n \n \nx y ", "l\x85l\xa0l \x1c\x0b\x0c\r\tz", "#*$%&|<> 🙂🙂 é", "p q r " * 3000,
])
def test_counts(spark, text):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = quality.with_base_rules(docs).first()
    assert tuple(row[c] for c in COUNTS) == plain_counts(text)


def test_odd_rows(odd, empty, odd_rows, labels):
    rows = quality.rate_documents(odd, labels).collect()
    assert len(rows) == len(odd_rows)
    assert [r["n_words"] for r in rows] == [plain_counts(t)[0] for _, t in odd_rows]
    assert all(r["kept"] is not None for r in rows)
    assert {"_words", "_found"} <= set(quality.rate_documents(odd, labels).columns)
    assert quality.rate_documents(empty, labels).count() == 0
    nobody = labels.where("false")
    assert all(r["llr"] in (None, 0.0) for r in quality.rate_documents(odd, nobody).collect())


def test_ratio_by_hand(spark):
    """Two documents, one trusted: counts, smoothing and mean follow the definition."""
    docs = spark.createDataFrame([(1, "a b"), (2, "a c c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    size = 1 << 12
    table = quality.ratios(docs, labels, buckets=size, prior=8)
    hashed = docs.select(
        *[F.pmod(F.xxhash64(F.lit(w)), F.lit(size)).alias(w) for w in "abc"],
        F.pmod(F.xxhash64(F.lit("a"), F.lit("b")), F.lit(size)).alias("ab"),
    ).first()

    def ratio(trusted, corpus):
        return math.log((trusted + 8 * corpus / 10) / (4 + 8)) - math.log(corpus / 10)

    assert table[hashed["a"]] == pytest.approx(ratio(1, 2))
    assert table[hashed["b"]] == pytest.approx(ratio(1, 1))
    assert table[hashed["c"]] == pytest.approx(ratio(0, 2))
    assert table[size + hashed["ab"]] == pytest.approx(ratio(1, 1))
    score = docs.select(quality.score(quality.words_of(F.col("text")), table).alias("s")).first()["s"]
    # the last word pairs with nothing
    assert score == pytest.approx((ratio(1, 2) + 3 * ratio(1, 1)) / 4)


def test_junk_scores_below_text(spark, sf_dir):
    rows = registry.queries()["op7_quality"](spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rated = rows.where("NOT base_failed").join(labels, "doc_id").collect()
    good = [r["kept"] for r in rated if r["quality"] == 1]
    bad = [r["kept"] for r in rated if r["quality"] == 0]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.5 * len(bad)


def test_plan_is_native(spark, sf_dir):
    plan = registry.queries()["op7_quality"](spark, sf_dir)._jdf.queryExecution().executedPlan()
    text = plan.toString()
    assert "Python" not in text and "Pandas" not in text and "Exchange" not in text
