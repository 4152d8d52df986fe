"""A fleet stored so that its join and its reports by system need no shuffle of rows.

Equipment and targets become tables bucketed by the system id, with equally many buckets.
A system with a large share of all rows would make its bucket as large, so the rows of hot
ids, and those without an id, go to a plain table beside it and find their target in a
broadcast of fewer rows than the hot share, as in ``enrich``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readyscope.model import MATERIAL_ID, SYSTEM_ID, TARGET_ATTRIBUTES
from readyscope.operators.enrich import HOT_SHARE, DuplicateTargetError, hot_systems, profile_targets


@dataclass(frozen=True)
class BucketedFleet:
    """The tables of one ingest, by the name they have in common."""

    spark: SparkSession
    name: str

    def table(self, part: str) -> DataFrame:
        return self.spark.table(f"{self.name}_{part}")

    @property
    def targets(self) -> DataFrame:
        return self.table("targets")

    @property
    def equipment(self) -> DataFrame:
        """All rows; what groups or joins by system id alone should take ``cold`` and ``hot``."""
        return self.table("cold").unionByName(self.table("hot"))

    def enriched(self) -> DataFrame:
        """Equipment with its targets: ``cold`` rows meet theirs bucket by bucket."""
        attributes = self.targets.select(*[F.col(f"`{c}`") for c in TARGET_ATTRIBUTES])
        cold = self.table("cold")
        joined = cold.join(attributes, cold[SYSTEM_ID] == attributes[MATERIAL_ID], "left")
        hot = self.table("hot")
        ids = F.broadcast(self.table("hot_ids").withColumnRenamed(SYSTEM_ID, "hot_id"))
        known = F.broadcast(
            attributes.join(ids, F.col(MATERIAL_ID) == F.col("hot_id"), "left_semi")
        )
        return joined.unionByName(hot.join(known, hot[SYSTEM_ID] == known[MATERIAL_ID], "left"))


def ingest_bucketed(
    equipment: DataFrame,
    targets: DataFrame,
    name: str,
    path: str,
    buckets: int,
    hot_share: int | None = None,
) -> BucketedFleet:
    """Store both tables below ``path`` and register them as ``<name>_cold``, ``_hot``,
    ``_hot_ids`` and ``_targets``, replacing earlier ones. A material may be listed once.

    One shuffle by bucket; afterwards a task writes whole buckets, sorted by id.
    """
    profile = profile_targets(targets)
    if not profile.unique:
        raise DuplicateTargetError(f"{profile.duplicate_keys} value(s) of {MATERIAL_ID} occur more than once")
    spark, base = equipment.sparkSession, path.rstrip("/")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def save(rows: DataFrame, part: str, key: str | None = None) -> None:
        writer = rows.write.mode("overwrite").format("parquet").option("path", f"{base}/{part}")
        if key is not None:
            writer = writer.bucketBy(buckets, key).sortBy(key)
        writer.saveAsTable(f"{name}_{part}")

    save(hot_systems(equipment, hot_share or max(HOT_SHARE, partitions)), "hot_ids")
    ids = F.broadcast(spark.table(f"{name}_hot_ids"))
    # a null id is in no bucket, as it is in no join
    cold = equipment.where(F.col(SYSTEM_ID).isNotNull()).join(ids, SYSTEM_ID, "left_anti")
    hot = equipment.join(ids, SYSTEM_ID, "left_semi").unionByName(equipment.where(F.col(SYSTEM_ID).isNull()))
    columns = [F.col(f"`{c}`") for c in equipment.columns]
    save(cold.select(*columns).repartition(buckets, SYSTEM_ID), "cold", SYSTEM_ID)
    save(hot.select(*columns), "hot")
    save(targets.repartition(buckets, MATERIAL_ID), "targets", MATERIAL_ID)
    return BucketedFleet(spark, name)
