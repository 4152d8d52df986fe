import fleets
import pytest
from plan_text import plan
from pyspark.sql import functions as F

from readyscope.model import BUSINESS_LINE, LEVEL, MATERIAL_ID, MOBILITY, SYSTEM_ID, TARGET
from readyscope.operators.enrich import (
    DuplicateTargetError,
    enrich,
    hot_matches,
    hot_systems,
    profile_targets,
)

COLUMNS = [
    "equipment_serial_number", "level_of_connection", "system_id", "system_name",
    "business_line", "city", "state", "service_region", "current_connectivity_status",
    "equipment_installation_date", "material_id", "mobile_system_or_fixed_system?",
    "target_srs_ready",
]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def expected_rows(equipment, targets):
    """The left join, by hand."""
    listed = [tuple(r) for r in targets.select(MATERIAL_ID, f"`{MOBILITY}`", TARGET).collect()]
    out = []
    for row in equipment.collect():
        key = row[SYSTEM_ID]
        matches = [t for t in listed if key is not None and t[0] == key]
        out += [tuple(row) + t for t in matches or [(None, None, None)]]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def equipment(spark):
    return fleets.edge_equipment(spark).cache()


@pytest.fixture(scope="module")
def targets(spark):
    return fleets.edge_targets(spark).cache()


def test_columns_and_rows(equipment, targets):
    fleet = enrich(equipment, targets)
    assert fleet.columns == COLUMNS
    assert rows(fleet) == expected_rows(equipment, targets)


def test_profile(targets):
    profile = profile_targets(targets)
    assert (profile.rows, profile.duplicate_keys, profile.unique) == (6, 0, True)
    assert profile.bytes > 6 * 64
    empty = profile_targets(targets.limit(0))
    assert (empty.rows, empty.bytes, empty.unique) == (0, 0, True)


def test_repeated_material_is_reported(equipment, targets):
    twice = targets.union(targets.where(f"{MATERIAL_ID} = 'M2'"))
    with pytest.raises(DuplicateTargetError):
        enrich(equipment, twice)
    for limit in (0, 1 << 20):
        fleet = enrich(equipment, twice, on_duplicate="fan_out", broadcast_limit_bytes=limit)
        assert rows(fleet) == expected_rows(equipment, twice)
        assert fleet.count() == 11 + 5
    with pytest.raises(ValueError):
        enrich(equipment, targets, on_duplicate="ignore")


@pytest.mark.parametrize("ids", [[], ["M2"], ["ZZ"], ["M1", "M2", "M3", "ZZ", None], ["absent"]])
def test_split_route_equals_the_plain_join(spark, equipment, targets, ids):
    ids_from = spark.createDataFrame([(i,) for i in ids], f"{SYSTEM_ID} string")
    fleet = enrich(equipment, targets, ids_from=ids_from, broadcast_limit_bytes=0)
    assert fleet.columns == COLUMNS
    assert rows(fleet) == expected_rows(equipment, targets)


def test_split_route_on_a_skewed_fleet(spark, targets):
    """A third of the rows on one system, a third without any."""
    skewed = spark.range(3000).selectExpr(
        "cast(id as string) AS equipment_serial_number",
        "'SRS READY' AS level_of_connection",
        "CASE id % 3 WHEN 0 THEN 'M2' WHEN 1 THEN NULL ELSE concat('M', id % 50) END AS system_id",
    )
    assert [r[0] for r in hot_systems(skewed, 4).collect()] == ["M2"]
    fleet = enrich(skewed, targets, broadcast_limit_bytes=0)
    assert rows(fleet) == expected_rows(skewed, targets)
    text = plan(fleet)
    # one pass over the equipment beside the count of its ids
    assert text.count("SortMergeJoin") + text.count("ShuffledHashJoin") <= 1
    assert "Union" not in text and "TakeOrdered" not in text
    # of 2000 hot and null rows, no shuffle partition gets more than its share
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        dealt = enrich(skewed, targets, broadcast_limit_bytes=0)
        parts = dealt.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert max(r["count"] for r in parts) < 2 * 3000 / len(parts)


def test_route_follows_the_measured_size(spark, equipment, targets):
    size = profile_targets(targets).bytes
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        small = plan(enrich(equipment, targets, broadcast_limit_bytes=size))
        large = plan(enrich(equipment, targets, broadcast_limit_bytes=size - 1))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in small and "BroadcastHashJoin" in small
    assert "SortMergeJoin" in large


def test_unique_targets_let_counts_skip_the_join(equipment, targets):
    fleet = enrich(equipment, targets)
    assert "Join" not in plan(fleet.groupBy(BUSINESS_LINE).count())
    assert "Join" not in plan(fleet.where(f"{LEVEL} = 'SRS READY'").groupBy().count())
    assert "Join" in plan(fleet.groupBy(TARGET).count())


def repeated(targets, times):
    again = targets
    for _ in range(times - 1):
        again = again.union(targets)
    return again


def test_hot_ids_with_repeated_targets_are_salted(spark, targets):
    """A third of the rows on an id with three target rows, a third without an id."""
    skewed = spark.range(3000).selectExpr(
        "cast(id as string) AS equipment_serial_number",
        "CASE id % 3 WHEN 0 THEN 'M2' WHEN 1 THEN NULL ELSE concat('M', id % 50) END AS system_id",
    )
    thrice = targets.union(repeated(targets.where(f"{MATERIAL_ID} = 'M2'"), 2))
    hot = {r["hot_id"]: r["salts"] for r in hot_matches(skewed, thrice, 20).collect()}
    # 1000 rows meet 3 targets each, of some 4000 joined rows in all
    assert set(hot) == {"M2"} and 14 <= hot["M2"] <= 20
    fleet = enrich(skewed, thrice, on_duplicate="fan_out", broadcast_limit_bytes=0, hot_share=20)
    assert rows(fleet) == expected_rows(skewed, thrice)
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        dealt = enrich(skewed, thrice, on_duplicate="fan_out", broadcast_limit_bytes=0, hot_share=200)
        assert "SortMergeJoin" in plan(dealt) or "ShuffledHashJoin" in plan(dealt)
        parts = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for key in settings:
            spark.conf.unset(key)
    total = len(expected_rows(skewed, thrice))
    assert sum(parts) == total and max(parts) < 2 * total / len(parts)


def test_salts_never_exceed_the_rows_of_an_id(spark, targets):
    one = spark.createDataFrame([("1", "M2"), ("2", "M1")], "equipment_serial_number string, system_id string")
    many = repeated(targets.where(f"{MATERIAL_ID} = 'M2'"), 50).union(targets)
    assert {r["hot_id"]: r["salts"] for r in hot_matches(one, many, 10).collect()} == {"M2": 1}
    fleet = enrich(one, many, on_duplicate="fan_out", broadcast_limit_bytes=0, hot_share=10)
    assert rows(fleet) == expected_rows(one, many)
    empty = enrich(one.limit(0), many, on_duplicate="fan_out", broadcast_limit_bytes=0)
    assert empty.columns == ["equipment_serial_number", *COLUMNS[2:3], *COLUMNS[-3:]] and empty.count() == 0
