import re

import fleets
import pytest
from plan_text import plan
from pyspark.sql import functions as F

from readyscope import ReadinessBoard, activation_list, export_month, read_months
from readyscope.model import BUSINESS_LINE
from readyscope.operators.enrich import enrich
from readyscope.sources.reports import KEPT_VERSIONS, current_month, published_months
from readyscope.sources.scratch import shared_directory

TITLES = ["Serial Number", "System", "Business Line", "City/State", "Service Region", "Status"]


def as_tuples(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_rows_and_titles(spark):
    edge = fleets.edge_equipment(spark)
    found = activation_list(edge)
    assert found.columns == TITLES
    assert as_tuples(found) == [
        ("3", "Model 1", "CT", None, "NORDESTE", "Connection OK"),
        ("4", "Model 2", "MR", "Santos/SP", "SÃO PAULO INTERIOR", None),
        ("5", "Model 2", "MR", None, "SÃO PAULO INTERIOR", "Connection Expired 30+ days"),
    ]
    fleet = enrich(edge, fleets.edge_targets(spark))
    assert as_tuples(activation_list(fleet)) == as_tuples(found)


def test_list_is_wider_than_the_kpi(spark):
    golden = fleets.golden_equipment(spark)
    assert activation_list(golden).count() == 229
    assert activation_list(golden, require_link_ok=True).count() == 68
    assert activation_list(golden, {BUSINESS_LINE: ["axa"]}).count() == 14


def test_export_replaces_only_its_month(spark, tmp_path):
    base = str(tmp_path / "report")
    edge = fleets.edge_equipment(spark)
    board = ReadinessBoard(edge, fleets.edge_targets(spark))
    board.export_activation_list(base, "202501")
    board.export_activation_list(base, "202502")
    months = read_months(spark, base)
    assert dict(months.groupBy("report_month").count().collect()) == {"202501": 3, "202502": 3}
    assert as_tuples(months.where("report_month = '202502'").select(*TITLES)) == as_tuples(
        activation_list(edge)
    )
    # a re-run with fewer rows, then with none, leaves the other month alone
    export_month(activation_list(edge, {BUSINESS_LINE: ["CT"]}), base, "202502")
    months = read_months(spark, base)
    assert dict(months.groupBy("report_month").count().collect()) == {"202501": 3, "202502": 1}
    export_month(activation_list(edge.limit(0)), base, "202502")
    assert dict(read_months(spark, base).groupBy("report_month").count().collect()) == {"202501": 3}


def test_a_failed_export_leaves_the_old_month(spark, tmp_path):
    """Rows fail midway: some tasks have written, nothing is published."""
    base = str(tmp_path / "report")
    good = spark.range(40).selectExpr("id", "cast(id as string) AS note")
    export_month(good, base, "202501")
    broken = spark.range(0, 4000, 1, 8).selectExpr(
        "id", "if(id = 3999, raise_error('lost'), cast(id as string)) AS note"
    )
    with pytest.raises(Exception, match="lost"):
        export_month(broken, base, "202501")
    assert as_tuples(read_months(spark, base).select("id", "note")) == as_tuples(good)
    # a first export that fails publishes no month
    with pytest.raises(Exception, match="lost"):
        export_month(broken, base, "202502")
    assert list(published_months(spark, base)) == ["202501"]
    export_month(good.limit(3), base, "202501")
    assert read_months(spark, base).count() == 3


def test_a_reader_finishes_on_the_version_it_began_with(spark, tmp_path):
    base = str(tmp_path / "report")
    for n in range(1, 6):
        path = export_month(spark.range(n), base, "202501")
        if n > 1:
            assert began.count() == n - 1
        began = read_months(spark, base)
        assert published_months(spark, base) == {"202501": path}
    assert len(list((tmp_path / "report" / "_versions").iterdir())) == KEPT_VERSIONS


def test_a_month_is_read_alone_and_plain_directories_count(spark, tmp_path):
    base = str(tmp_path / "report")
    spark.range(7).write.parquet(f"{base}/report_month=202412")
    export_month(spark.range(2), base, "202501")
    export_month(spark.range(3).withColumn("more", F.lit("x")), base, "202502")
    months = read_months(spark, base)
    assert dict(months.groupBy("report_month").count().collect()) == {"202412": 7, "202501": 2, "202502": 3}
    assert plan(months.where("report_month = '202501'")).count("FileScan") == 1
    export_month(spark.range(1), base, "202412")
    assert read_months(spark, base).where("report_month = '202412'").count() == 1
    with pytest.raises(FileNotFoundError):
        read_months(spark, str(tmp_path / "none"))


def test_month_defaults_to_the_current_one(spark, tmp_path):
    path = export_month(activation_list(fleets.edge_equipment(spark)), str(tmp_path / "r"))
    assert path.endswith(f"report_month={current_month()}")
    assert re.fullmatch(r"\d{6}", current_month())


@pytest.mark.parametrize("month", ["2025", "202513", "202500", "2025-01", "../x"])
def test_month_must_be_a_month(spark, tmp_path, month):
    with pytest.raises(ValueError):
        export_month(activation_list(fleets.edge_equipment(spark)), str(tmp_path), month)


class FakeSession:
    """Only the settings, as a session without a shared folder cannot be had at will."""

    def __init__(self, **settings):
        self.conf = self.sparkContext = self
        self.applicationId = "app"
        self.get = lambda key, default=None: settings.get(key, default)


def test_shared_directory(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    first, second = shared_directory(spark, "x"), shared_directory(spark, "x")
    assert first.startswith(base) and first != second
    local = {"spark.master": "local[2]", "spark.sql.warehouse.dir": "file:/warehouse"}
    assert shared_directory(FakeSession(**local), "x").startswith("file:/warehouse/readyscope/app/")
    with pytest.raises(ValueError):
        shared_directory(FakeSession(**local | {"spark.master": "yarn"}), "x")
    shared = {"spark.master": "yarn", "spark.checkpoint.dir": "hdfs://store/scratch"}
    assert shared_directory(FakeSession(**shared), "x").startswith("hdfs://store/scratch/")
