"""Tables stored for what is asked of them: buckets and footers."""

import fleets
import pytest
from plan_text import plan
from test_enrich import expected_rows, rows

from readyscope import to_parquet
from readyscope.model import LEVEL, MATERIAL_ID, SYSTEM_ID, TARGET
from readyscope.operators.enrich import DuplicateTargetError
from readyscope.sources.bucketed import ingest_bucketed
from readyscope.sources.footers import stored_rows


def skewed(spark):
    return spark.range(3000).selectExpr(
        "cast(id as string) AS equipment_serial_number",
        f"if(id % 2 = 0, 'SRS READY', 'NOT CONNECTED') AS {LEVEL}",
        f"CASE id % 3 WHEN 0 THEN 'M2' WHEN 1 THEN NULL ELSE concat('M', id % 50) END AS {SYSTEM_ID}",
    )


@pytest.fixture
def fleet(spark, tmp_path):
    yield ingest_bucketed(skewed(spark), fleets.edge_targets(spark), "bucketed_fleet", str(tmp_path), 8, hot_share=4)
    for part in ("cold", "hot", "hot_ids", "targets"):
        spark.sql(f"DROP TABLE IF EXISTS bucketed_fleet_{part}")


def test_bucketed_fleet_equals_the_plain_join(spark, fleet):
    assert rows(fleet.enriched()) == expected_rows(skewed(spark), fleets.edge_targets(spark))
    assert rows(fleet.equipment) == rows(skewed(spark))
    assert [r[0] for r in fleet.table("hot_ids").collect()] == ["M2"]
    assert fleet.table("cold").where(f"{SYSTEM_ID} = 'M2' OR {SYSTEM_ID} IS NULL").isEmpty()


def test_cold_rows_are_joined_and_counted_without_a_shuffle(spark, fleet):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cold, targets = fleet.table("cold"), fleet.targets
        joined = cold.join(targets, cold[SYSTEM_ID] == targets[MATERIAL_ID], "left")
        text = plan(joined)
        assert "SortMergeJoin" in text and "Exchange" not in text
        per_system = joined.groupBy(SYSTEM_ID, TARGET).count()
        assert "Exchange" not in plan(per_system) and per_system.count() == cold.select(SYSTEM_ID).distinct().count()
        whole = plan(fleet.enriched())
        assert "Exchange hashpartitioning" not in whole and whole.count("BroadcastExchange") >= 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_repeated_materials_are_an_error(spark, tmp_path):
    targets = fleets.edge_targets(spark)
    with pytest.raises(DuplicateTargetError):
        ingest_bucketed(skewed(spark), targets.union(targets), "twice", str(tmp_path), 4)


def test_footers_answer_without_reading_columns(spark, tmp_path):
    path = str(tmp_path / "fleet")
    to_parquet(fleets.golden_equipment(spark), path)
    total = stored_rows(spark, path)
    assert total.first()[0] == 2286 and "PushedAggregation: [COUNT(*)]" in plan(total, "formatted")
    # empty files and months count as nothing
    spark.range(0, 5, 1, 8).write.partitionBy().parquet(str(tmp_path / "few"))
    assert stored_rows(spark, str(tmp_path / "few")).first()[0] == 5
    spark.range(0).write.parquet(str(tmp_path / "none"))
    assert stored_rows(spark, str(tmp_path / "none")).first()[0] == 0
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"
