"""Every KPI and report from a cube equals that from the equipment."""

import fleets
import pytest
from plan_text import plan

from readyscope import (
    ReadinessBoard,
    adherence_by_business_line,
    adherence_by_system,
    category_lists,
    connected_not_ready,
    disconnected,
    kpi_panel,
    metric_by,
    not_connected_by_business_line,
    not_connected_by_system,
    problem_share_by_business_line,
    ready_fraction,
    ready_pct,
    ready_share_by_business_line,
    service_distribution,
    status_counts,
    top_regions_by_ready_rate,
    total_equipment,
)
from readyscope.functions.counting import CUBE_ROWS
from readyscope.model import BUSINESS_LINE, LEVEL, REGION, SYSTEM_ID
from readyscope.operators.cube import CUBE_COLUMNS, count_cube, read_cube, store_cube

AXA = {BUSINESS_LINE: ["AXA"], REGION: ["sul", "são paulo interior"]}
ON_EQUIPMENT = {
    "total": lambda e: total_equipment(e), "total filtered": lambda e: total_equipment(e, AXA),
    "ready": lambda e: ready_pct(e), "ready of fleet": lambda e: ready_pct(e, AXA),
    "ready of filtered": lambda e: ready_pct(e, AXA, "filtered"), "fraction": ready_fraction,
    "connected": lambda e: connected_not_ready(e, AXA), "disconnected": lambda e: disconnected(e, AXA),
    "panel": kpi_panel, "panel filtered": lambda e: kpi_panel(e, AXA),
    "panel of nothing": lambda e: kpi_panel(e, {BUSINESS_LINE: ["none"]}),
    "status": status_counts, "distribution": service_distribution,
    "distribution filtered": lambda e: service_distribution(e, AXA),
    "not connected by system": not_connected_by_system,
    "not connected by line": not_connected_by_business_line,
    "ready by line": ready_share_by_business_line, "regions": lambda e: top_regions_by_ready_rate(e, 9),
    "problems": problem_share_by_business_line, "lists": category_lists,
    "metric": lambda e: metric_by(e, "taxa SRS", "estado"), "metric top": lambda e: metric_by(e, "problems", "city", 3),
}
WITH_TARGETS = {
    "line": adherence_by_business_line, "line filtered": lambda e, t: adherence_by_business_line(e, t, AXA),
    "system": adherence_by_system, "metric": lambda e, t: metric_by(e, "problem_rate", "target", targets=t),
}


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module", params=["edge", "golden", "empty"])
def fleet(request, spark, tmp_path_factory):
    make = {"edge": fleets.edge_equipment, "golden": fleets.golden_equipment}
    equipment = make.get(request.param, fleets.edge_equipment)(spark)
    if request.param == "empty":
        equipment = equipment.limit(0)
    base = str(tmp_path_factory.mktemp("cube"))
    store_cube(equipment, base, "202501")
    return equipment, read_cube(spark, base)


@pytest.mark.parametrize("name", list(ON_EQUIPMENT))
def test_reports_are_equal(fleet, name):
    equipment, cube = fleet
    report = ON_EQUIPMENT[name]
    assert report(cube).dtypes == report(equipment).dtypes
    found, wanted = rows(report(cube)), rows(report(equipment))
    assert found == wanted if name != "status" else sorted(found, key=repr) == sorted(wanted, key=repr)


@pytest.mark.parametrize("name", list(WITH_TARGETS))
def test_reports_with_targets_are_equal(spark, fleet, name):
    equipment, cube = fleet
    targets = fleets.golden_targets(spark) if equipment.count() > 100 else fleets.edge_targets(spark)
    assert rows(WITH_TARGETS[name](cube, targets)) == rows(WITH_TARGETS[name](equipment, targets))


def test_a_board_on_a_cube(spark):
    equipment, targets = fleets.golden_equipment(spark), fleets.golden_targets(spark)
    counted, board = ReadinessBoard(count_cube(equipment), targets), ReadinessBoard(equipment, targets)
    assert counted.kpis(AXA) == board.kpis(AXA)
    assert counted.choices(LEVEL) == board.choices(LEVEL)
    assert rows(counted.adherence_by_system()) == rows(board.adherence_by_system())


def test_months_are_merged_and_replaced(spark, tmp_path):
    base, equipment = str(tmp_path / "cube"), fleets.golden_equipment(spark)
    for month, part in (("202501", "A%"), ("202502", "[^A]%")):
        keep = equipment[BUSINESS_LINE].startswith("A")
        store_cube(equipment.where(keep if part == "A%" else ~keep), base, month)
    merged = read_cube(spark, base)
    assert rows(kpi_panel(merged)) == rows(kpi_panel(equipment))
    assert sorted(rows(merged), key=repr) == sorted(rows(count_cube(equipment).select(merged.columns)), key=repr)
    one = read_cube(spark, base, ["202502"])
    assert rows(total_equipment(one)) == rows(total_equipment(equipment.where(~keep)))
    assert "Exchange" not in plan(one)
    # a month counted twice is counted once
    store_cube(equipment.where(keep), base, "202501")
    assert rows(total_equipment(read_cube(spark, base))) == [(2286,)]


def test_one_scan_of_partial_counts(spark, tmp_path):
    path = str(tmp_path / "fleet")
    fleets.golden_equipment(spark).write.parquet(path)
    text = plan(count_cube(spark.read.parquet(path)))
    assert text.count("FileScan") == 1 and "partial_count" in text
    cube = count_cube(spark.read.parquet(path))
    assert cube.columns == [*CUBE_COLUMNS, CUBE_ROWS]
    assert count_cube(cube, [SYSTEM_ID]).groupBy().sum(CUBE_ROWS).first()[0] == 2286
