from readyscope.session import (
    ADVISORY_PARTITION_BYTES,
    partition_bytes_for,
    recommended_conf,
    shuffle_partitions_for,
)


def test_partitions_follow_the_shuffled_bytes():
    assert shuffle_partitions_for(0, 8) == 8
    assert shuffle_partitions_for(100 * ADVISORY_PARTITION_BYTES, 8) == 100
    assert shuffle_partitions_for(100 * ADVISORY_PARTITION_BYTES + 1, 8) == 101
    assert shuffle_partitions_for(100 * 10**12, 8000) == 40_000
    assert shuffle_partitions_for(100 * 10**12, 8000, many=400_000) == 400_000
    assert shuffle_partitions_for(10**12, 50_000) == 50_000


def test_partitions_grow_beyond_many_of_them():
    assert partition_bytes_for(10**12) == ADVISORY_PARTITION_BYTES
    assert partition_bytes_for(100 * 10**12) == 2_500_000_000
    conf = recommended_conf(100 * 10**12, 8000)
    assert conf["spark.sql.adaptive.advisoryPartitionSizeInBytes"] == "2500000000"


def test_settings_are_known_to_spark(spark):
    for key, value in recommended_conf(10**12, 4000).items():
        assert spark.conf.isModifiable(key), key
    assert spark.conf.get("spark.sql.adaptive.skewJoin.enabled") == "true"
    assert spark.conf.get("spark.ui.enabled") == "false"
