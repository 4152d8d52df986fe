import random
import re

import fleets
import pytest

from readyscope import category_list, category_lists, title_labels
from readyscope.functions.labels import relabel, title_label
from readyscope.model import BUSINESS_LINE, LEVEL, REGION
from pyspark.sql import functions as F


def expected(text):
    return re.sub(r"\bSrs\b", "SRS", text.title()) if text else text


def labels_of(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    return [r[0] for r in df.select(title_label(F.col("t"))).collect()]


@pytest.mark.parametrize(
    "text, label",
    [
        ("srs automotivo", "SRS Automotivo"),
        ("SISTEMA SRS", "Sistema SRS"),
        ("treinamento de srs operacional", "Treinamento De SRS Operacional"),
        ("SRS", "SRS"),
        ("", ""),
        (None, None),
    ],
)
def test_fixed_cases(spark, text, label):
    assert labels_of(spark, [text]) == [label]


def test_word_starts(spark):
    texts = [
        "a-b", "x_srs", "a1b", "they're", "ço.srs/ab", "  two  blanks ", "SRS-1", "1ª região",
        "nº 3", "são paulo interior", "ÉPOCA", "pré-srs", "srs2", "ss srs. SRS", "x\tsrs\ny",
        "3ªclasse",
    ]
    assert labels_of(spark, texts) == [expected(t) for t in texts]


def test_random_portuguese_texts(spark):
    rng = random.Random(7)
    alphabet = "abcsrxyzABCSRXYZáàâãçéêíóôõúÁÀÂÃÇÉÊÍÓÔÕÚªº 019-_/.'\t"
    texts = ["".join(rng.choices(alphabet, k=rng.randint(1, 24))) for _ in range(400)]
    texts += ["srs".join(rng.choices(alphabet, k=3)) for _ in range(100)]
    assert labels_of(spark, texts) == [expected(t) for t in texts]


def test_category_list_is_sorted_and_without_null(spark):
    edge = fleets.edge_equipment(spark)
    regions = [r[0] for r in category_list(edge, REGION).collect()]
    assert regions == ["Nordeste", "Sp Interior", "Sul", "São Paulo Interior"]
    assert [r[0] for r in category_list(edge, BUSINESS_LINE).collect()] == ["CT", "MR"]


def test_category_lists_equal_the_single_lists(spark):
    golden = fleets.golden_equipment(spark)
    together = category_lists(golden).collect()
    for column in (REGION, BUSINESS_LINE, LEVEL):
        single = [r[0] for r in category_list(golden, column).collect()]
        assert [r[1] for r in together if r[0] == column] == single


def test_title_labels_keep_values_that_share_a_label(spark):
    df = spark.createDataFrame([("sul",), ("SUL",), ("SUL",), (None,)], "service_region string")
    rows = title_labels(df, REGION).collect()
    assert {tuple(r) for r in rows} == {("sul", "Sul"), ("SUL", "Sul"), (None, None)}
    assert len(rows) == 3


def test_relabel(spark):
    df = spark.createDataFrame([("A",), ("B",), ("C",), (None,)], "x string").coalesce(1)
    out = df.select(relabel(F.col("x"), {"A": "1", "B": "2"})).collect()
    assert [r[0] for r in out] == ["1", "2", "C", None]
    assert [r[0] for r in df.select(relabel(F.col("x"), {})).collect()] == ["A", "B", "C", None]
