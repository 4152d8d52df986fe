from types import SimpleNamespace

from readyscope.sources.scratch import clear, shared_directory, stored


def test_stored_rows_are_read_from_the_shared_folder(spark):
    rows = spark.range(10).selectExpr("id", "cast(NULL AS string) AS note")
    kept = stored(rows, "numbers")
    assert kept.dtypes == rows.dtypes and kept.count() == 10
    folder = shared_directory(spark, "x").rpartition("/")[0]
    assert spark.sparkContext.applicationId in folder
    assert all(folder.removeprefix("file:") in name for name in kept.inputFiles())


def test_clear_removes_this_application_only(spark, tmp_path):
    """With a shared folder of its own, so that no other test loses its tables."""
    settings = {"spark.checkpoint.dir": str(tmp_path), "spark.master": "local[2]"}
    own = SimpleNamespace(
        conf=settings, sparkContext=spark.sparkContext, _jvm=spark._jvm, _jsc=spark._jsc
    )
    (tmp_path / "readyscope" / "another").mkdir(parents=True)
    path = shared_directory(own, "numbers")
    spark.range(3).write.parquet(path)
    assert spark.read.parquet(path).count() == 3
    clear(own)
    assert [p.name for p in (tmp_path / "readyscope").iterdir()] == ["another"]
    clear(own)  # nothing left is no error
