import fleets

from readyscope import describe_table


def same(df):
    found, expected = describe_table(df), df.describe()
    assert found.columns == expected.columns
    assert found.dtypes == expected.dtypes
    assert [tuple(r) for r in found.collect()] == [tuple(r) for r in expected.collect()]


def test_equals_describe_on_fleets(spark):
    for df in (fleets.golden_equipment(spark), fleets.golden_targets(spark),
               fleets.edge_equipment(spark), fleets.edge_targets(spark),
               fleets.edge_targets(spark).limit(0)):
        same(df.coalesce(1))


def test_equals_describe_on_number_like_texts(spark):
    texts = [
        "1", " 2 ", "-3.5", "+4", ".5", "1e3", "1E-2", "7d", "8f", "inf", "words", "NOT", "",
        None, "0x1p3", "12abc", "\t9", "١", "e5", "infinite", "5.",
        "\x7f6", "\x016", "INF", "Nothing", "-inf", "n", ":1", "{x}",
    ]
    df = spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "t string, i int")
    same(df.coalesce(1))
    for text in [*texts, "NaN", "-Infinity", "Infinity", "nan"]:
        if text is not None:
            same(df.where(df.i < 1).selectExpr("i").crossJoin(
                spark.createDataFrame([(text,)], "t string")))


def test_leaves_out_other_types(spark):
    df = spark.sql("SELECT true AS b, date'2024-01-01' AS d, 1.5BD AS x, 'a' AS `odd name?`")
    same(df)
    same(df.select("b", "d"))
