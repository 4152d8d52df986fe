"""What the physical plans must look like on a Parquet fleet."""

import fleets
import pytest
from plan_text import plan

import __spark_entry__ as entry_module
from readyscope import (
    ReadinessBoard,
    activation_list,
    adherence_by_business_line,
    category_lists,
    export_month,
    kpi_panel,
    problem_share_by_business_line,
    ready_pct,
    ready_share_by_business_line,
    to_parquet,
    total_equipment,
)
from readyscope.model import BUSINESS_LINE, REGION
from readyscope.operators.enrich import enrich

AXA = {BUSINESS_LINE: ["AXA"], REGION: ["Sul", "Centro"]}


@pytest.fixture(scope="module")
def board(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("fleet")
    to_parquet(fleets.golden_equipment(spark), str(base / "e"))
    to_parquet(fleets.golden_targets(spark), str(base / "t"))
    return ReadinessBoard.load(spark, str(base / "e"), str(base / "t"), fmt="parquet")


def test_panel_is_one_scan_of_the_columns_it_needs(board):
    text = plan(kpi_panel(board.equipment, AXA), "formatted")
    assert text.count("Scan parquet") == 2  # once in the tree, once in the details
    assert "Join" not in text
    read = text[text.index("ReadSchema"):].splitlines()[0]
    assert set(read.removeprefix("ReadSchema: struct<").rstrip(">").split(",")) == {
        "level_of_connection:string", "business_line:string", "service_region:string",
        "current_connectivity_status:string",
    }


def test_filters_reach_the_scan(board):
    text = plan(total_equipment(board.equipment, AXA), "formatted")
    assert "PushedFilters: [In(service_region, [CENTRO,SUL]), " in text or (
        "In(service_region" in text and "EqualTo(business_line,AXA)" in text
    )
    through_join = plan(total_equipment(board.fleet, AXA), "formatted")
    assert "Join" not in through_join and "EqualTo(business_line,AXA)" in through_join


def test_fleet_denominator_does_not_filter_the_scan(board):
    assert "PushedFilters" not in plan(ready_pct(board.equipment, AXA), "formatted")


RETAIL = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    "name",
    ["filtered_fleet", "filtered_fleet_all_token", "activation_list", "activation_list_filtered"],
)
def test_parts_are_looked_up_last(spark, name):
    """Filters on the order cut the lines before they are shuffled by part."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = plan(entry_module.queries()[name](spark, RETAIL)).splitlines()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    joins = [line for line in lines if "SortMergeJoin" in line]
    assert "p_partkey" in joins[0] and not any("p_partkey" in j for j in joins[1:])


@pytest.mark.parametrize("name", ["adherence_by_system", "not_connected_by_system", "metric_by_target"])
def test_system_reports_join_counts(spark, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = plan(entry_module.queries()[name](spark, RETAIL)).splitlines()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    part_join = max(i for i, line in enumerate(lines) if "Join" in line and ("material_id" in line or "system_id" in line))
    partial = next(i for i, line in enumerate(lines) if "partial_count(1)" in line)
    assert part_join < partial


def test_split_route_is_one_pass(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(entry_module.queries()["fleet_enriched_split"](spark, RETAIL))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # the lines themselves, and the two uses of the count of their ids
    assert text.count("l_returnflag") == 0 and "Union" not in text and "TakeOrdered" not in text
    assert text.count("FileScan parquet [l_orderkey") == 1


def test_export_has_no_shuffle_unless_asked(board, tmp_path, monkeypatch):
    seen = []
    monkeypatch.setattr("pyspark.sql.readwriter.DataFrameWriter.parquet", lambda w, p, **o: seen.append(plan(w._df)))
    for rebalance in (False, True):
        export_month(activation_list(board.equipment), str(tmp_path), "202501", rebalance)
    assert "Exchange" not in seen[0] and "REBALANCE" in seen[1]


def test_action_list_has_no_shuffle(board):
    assert "Exchange" not in plan(activation_list(board.equipment, AXA))


def test_reports_shuffle_counts_only(board):
    text = plan(ready_share_by_business_line(board.equipment))
    assert text.count("Exchange hashpartitioning") == 1
    assert "partial_count" in text
    assert plan(category_lists(board.equipment)).count("FileScan") == 1


def test_top_k_needs_no_full_sort(board):
    assert "TakeOrderedAndProject" in plan(problem_share_by_business_line(board.equipment))


def test_adherence_joins_counts_not_rows(board, spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = plan(adherence_by_business_line(board.equipment, board.targets)).splitlines()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    join = next(i for i, line in enumerate(lines) if "SortMergeJoin" in line)
    scan = next(i for i, line in enumerate(lines) if "FileScan" in line and "level_of" in line)
    between = "\n".join(lines[join:scan])
    assert "partial_count" in between and "HashAggregate(keys=[business_line" in between


@pytest.mark.parametrize(
    "name", [n for n in entry_module.queries() if n not in entry_module.TEXT_QUERIES]
)
def test_registered_plans_stay_in_the_engine(spark, name):
    text = plan(entry_module.queries()[name](spark, "/root/testdata/sf0.001"))
    for unwanted in ("Python", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert unwanted not in text


def test_a_hot_key_in_a_shuffle_join_is_split(spark, tmp_path):
    """Beyond the salts (repeated materials) AQE splits the hot partition."""
    path = str(tmp_path / "skewed")
    spark.range(0, 300_000, 1, 8).selectExpr(
        "cast(id AS string) AS equipment_serial_number",
        "CASE WHEN id % 3 = 0 THEN 'M2' ELSE concat('S', id % 5000) END AS system_id",
        "repeat('x', 40) AS note",
    ).write.parquet(path)
    equipment = spark.read.parquet(path)
    targets = fleets.edge_targets(spark).where("material_id IS NOT NULL")
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "256KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128KB",
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        # with a share of 1 no id is dealt over salts
        fleet = enrich(equipment, targets.union(targets), on_duplicate="fan_out",
                       broadcast_limit_bytes=0, hot_share=1)
        assert fleet.count() == 300_000 + 100_000
        per_system = fleet.groupBy("system_id").count()
        rows = dict(per_system.collect())
        assert rows["M2"] == 200_000
        fleet.collect()
        assert "skew=true" in plan(fleet)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
