import pytest
from plan_text import plan
from pyspark.sql import functions as F

from readyscope.llm import common


def test_attach_is_an_inner_join(spark):
    """A key with a third of the rows, one just below the share, rare ones, and strangers."""
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 3 == 1, F.col("id")).otherwise(F.col("id") % 50)
        .cast("long").alias("key"),
        F.col("id").alias("row"),
    )
    rows = common.stored(rows, "test-rows")
    facts = rows.groupBy("key").agg(F.count("*").alias("key_rows")).where("key % 7 <> 1")
    facts = common.stored(facts.withColumn("fact", F.col("key") * 10), "test-facts")
    wanted = sorted(map(tuple, rows.join(facts.drop("key_rows"), "key").collect()))
    for share in (1, 10, 1000, 10**6):
        found = common.attach(rows, facts, ["key"], hot_share=share)
        assert found.columns == ["key", "row", "fact"]
        assert sorted(map(tuple, found.collect())) == wanted
    assert common.attach(rows, facts.limit(0), ["key"]).count() == 0


def test_hot_rows_are_not_shuffled(spark):
    rows = common.stored(spark.range(5000).select((F.col("id") % 2 * F.col("id")).alias("key")), "test-rows")
    facts = rows.groupBy("key").agg(F.count("*").alias("key_rows"))
    facts = common.stored(facts, "test-facts")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = common.attach(rows, facts, ["key"])
        parts = found.groupBy(F.spark_partition_id().alias("p"), "key").count()
        hot = parts.where("key = 0")
        assert hot.agg(F.sum("count")).first()[0] == 2500
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" in plan


def test_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], "`a.b` int, `c``d` int, X int")
    assert common.unused(df, "x") == "x_" and common.unused(df, "y") == "y"
    assert df.select(*common.columns_of(df)).columns == df.columns
    assert df.select(*common.columns_of(df, "x")).columns == ["a.b", "c`d"]


def test_stored_keeps_schema_and_rows(spark):
    df = spark.createDataFrame([(1, [1, 2], None)], "a long, b array<int>, c string")
    kept = common.stored(df, "test-kept")
    assert kept.schema == df.schema and kept.collect() == df.collect()
    assert spark.conf.get("spark.checkpoint.dir") in kept.inputFiles()[0]


@pytest.mark.parametrize("set_before", [None, "false", "true"])
def test_shuffle_files_go_only_within(spark, set_before):
    """The session is left as it was, after an error too."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    spark.conf.unset(name) if set_before is None else spark.conf.set(name, set_before)
    before = spark.conf.get(name, None)
    with pytest.raises(KeyError), common.freeing_shuffles(spark):
        assert spark.conf.get(name) == "true"
        raise KeyError
    assert spark.conf.get(name, None) == before
    spark.conf.unset(name)


def test_many_facts_are_not_broadcast(spark):
    """Their files are small, as rows they are ten times that."""
    rows = common.stored(spark.range(common.BROADCAST_ROWS + 1).withColumnRenamed("id", "key"), "test-rows")
    facts = common.stored(rows.withColumn("key_rows", F.lit(1).cast("long")), "test-facts")
    found = common.attach(rows, facts, ["key"])
    assert "SortMergeJoin" in plan(found) and found.count() == common.BROADCAST_ROWS + 1
    few = facts.where("key < 10")
    assert "SortMergeJoin" not in plan(common.attach(rows, few, ["key"]))
    assert plan(rows.join(common.sized(few, 10), "key")).count("BroadcastHashJoin") == 1
