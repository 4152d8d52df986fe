"""Left join of equipment to its targets.

Equipment without a target stays, with null target columns. Aggregates that
only need the target per group should not use this row-level join: see
``rollups``, which count first and join the counts.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readyscope.model import MATERIAL_ID, SYSTEM_ID, TARGET_ATTRIBUTES

# A target table measured below this is broadcast. A task holds it in memory.
BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024

# Beyond it, a system id with more than one row in this many (or in as many as there are
# shuffle partitions, if those are more) is joined by broadcast. By arithmetic, no more ids
# than that can be so frequent.
HOT_SHARE = 1000

_ROW_OVERHEAD_BYTES = 64


class DuplicateTargetError(ValueError):
    """The target table lists a material more than once."""


@dataclass(frozen=True)
class TargetProfile:
    """Measured facts about a target table."""

    rows: int
    bytes: int
    duplicate_keys: int

    @property
    def unique(self) -> bool:
        return self.duplicate_keys == 0


def profile_targets(targets: DataFrame) -> TargetProfile:
    """Measure size and key uniqueness of the targets: one job, one row back.

    A null material never matches any equipment, so repeated nulls are no fault.
    """
    measured = _attributes(targets)
    row_bytes = reduce(
        lambda left, right: left + right,
        [_value_bytes(field) for field in measured.schema.fields],
        F.lit(_ROW_OVERHEAD_BYTES).cast("bigint"),
    )
    found = (
        measured.groupBy(MATERIAL_ID)
        .agg(F.count("*").alias("n"), F.sum(row_bytes).alias("bytes"))
        .agg(
            F.sum("n").alias("n_rows"),
            F.sum("bytes").alias("n_bytes"),
            F.count_if((F.col("n") > 1) & F.col(MATERIAL_ID).isNotNull()).alias("repeated"),
        )
        .first()
    )
    return TargetProfile(found["n_rows"] or 0, found["n_bytes"] or 0, found["repeated"])


def hot_systems(equipment: DataFrame, share: int = HOT_SHARE) -> DataFrame:
    """The system ids with more than one row in ``share``; fewer than ``share`` rows.

    Only picks the join route of a row; no row is dropped for not being listed. One job
    counts the rows.
    """
    listed = equipment.where(F.col(SYSTEM_ID).isNotNull())
    total = listed.count()
    counts = listed.groupBy(SYSTEM_ID).count()
    return counts.where(F.col("count") * share > total).select(SYSTEM_ID)


def hot_matches(ids: DataFrame, targets: DataFrame, share: int = HOT_SHARE) -> DataFrame:
    """hot_id and salts of the ids that make more than one joined row in ``share``.

    Counted are the rows that a left join gives: each row of an id meets every target row
    of it. An id gets as many salts as it has such shares, but no more than it has rows.
    Fewer than ``share`` ids come out, with fewer than twice as many salts in all.
    """
    rows = ids.where(F.col(SYSTEM_ID).isNotNull()).groupBy(F.col(SYSTEM_ID).alias("hot_id"))
    listed = targets.where(F.col(MATERIAL_ID).isNotNull()).groupBy(F.col(MATERIAL_ID).alias("hot_id"))
    both = rows.agg(F.count("*").alias("n")).join(
        listed.agg(F.count("*").alias("matches")), "hot_id", "left"
    )
    made = F.col("n").cast("double") * F.coalesce("matches", F.lit(1))
    both = both.select("hot_id", "n", made.alias("made"))
    total = both.agg(F.sum("made")).first()[0] or 1.0
    shares = F.ceil(F.col("made") * share / total)
    salts = F.least(F.col("n"), shares).cast("int").alias("salts")
    return both.where(F.col("made") * share > total).select("hot_id", salts)


def enrich(
    equipment: DataFrame,
    targets: DataFrame,
    *,
    on_duplicate: str = "error",
    ids_from: DataFrame | None = None,
    broadcast_limit_bytes: int = BROADCAST_LIMIT_BYTES,
    hot_share: int | None = None,
) -> DataFrame:
    """Equipment columns plus material, mobility class and target.

    One small job measures the targets while the plan is built. With a repeated
    material, ``on_duplicate="error"`` raises and ``"fan_out"`` repeats the equipment
    row per match, as any left join does.

    Targets measured under the limit are broadcast. A larger table is joined by
    shuffle, beside which hot system ids are joined by broadcast. Those are counted on
    ``ids_from`` if given: the same system ids from a source that is cheaper to scan.
    Where materials repeat, the matches of a hot id are not bounded; its target rows are
    repeated over salts instead, and its equipment is dealt over the same.

    An id is hot with more than one row in ``hot_share``; unless given, that is a
    thousandth, or the share of a shuffle partition if that is less.
    """
    if on_duplicate not in ("error", "fan_out"):
        raise ValueError(f"on_duplicate must be 'error' or 'fan_out', not {on_duplicate!r}")
    profile = profile_targets(targets)
    if not profile.unique and on_duplicate == "error":
        raise DuplicateTargetError(
            f"{profile.duplicate_keys} value(s) of {MATERIAL_ID} occur more than once"
        )

    attributes = _attributes(targets)
    if profile.bytes <= broadcast_limit_bytes:
        if profile.unique:
            # Removes nothing here, but tells the optimizer that the key is unique:
            # a query that uses no target column then skips the join altogether.
            attributes = attributes.dropDuplicates([MATERIAL_ID])
        return _left_join(equipment, F.broadcast(attributes))
    partitions = int(equipment.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = hot_share or max(HOT_SHARE, partitions)
    ids = equipment if ids_from is None else ids_from
    if not profile.unique:
        return _salted_join(equipment, attributes, hot_matches(ids, targets, share))
    return _spread_join(equipment, attributes, hot_systems(ids, share))


def _salted_join(equipment: DataFrame, attributes: DataFrame, hot: DataFrame) -> DataFrame:
    """Shuffle join in which the rows of a hot id are dealt over salts.

    Every target row of a hot id is there once per salt, so each equipment row, whatever
    its salt, meets all of them. Null ids match nothing and are dealt out by row.
    """
    columns, key = equipment.columns, F.col(SYSTEM_ID)
    hot = F.broadcast(hot)
    row_hash = F.xxhash64(*[F.col(f"`{c}`") for c in columns])
    dealt = equipment.join(hot, key == F.col("hot_id"), "left").withColumn(
        "row salt",
        F.when(key.isNull(), F.hash(row_hash))
        .when(F.col("salts").isNotNull(), F.pmod(row_hash, F.col("salts")).cast("int"))
        .otherwise(0),
    )
    every_salt = F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)
    repeated = attributes.join(hot, F.col(MATERIAL_ID) == F.col("hot_id"), "left").select(
        *[F.col(f"`{c}`") for c in attributes.columns], F.explode(every_salt).alias("salt")
    )
    joined = dealt.join(
        repeated,
        (dealt[SYSTEM_ID] == repeated[MATERIAL_ID]) & (F.col("row salt") == F.col("salt")),
        "left",
    )
    return joined.select(*[F.col(f"`{c}`") for c in [*columns, *attributes.columns]])


def _spread_join(equipment: DataFrame, attributes: DataFrame, hot: DataFrame) -> DataFrame:
    """Shuffle join in one pass, in which hot and null ids are spread evenly.

    Hot rows find their target in a broadcast table of fewer rows than the hot share.
    In the shuffle they match nothing: beside the id they are dealt out by a hash of the
    row, all others by a hash of the id, which a target has too.
    """
    columns, key = equipment.columns, F.col(SYSTEM_ID)
    ids = hot.select(F.col(SYSTEM_ID).alias("hot_id"))
    known = _left_join(
        ids.withColumnRenamed("hot_id", SYSTEM_ID),
        F.broadcast(
            attributes.join(F.broadcast(ids), F.col(MATERIAL_ID) == F.col("hot_id"), "left_semi")
        ),
    )
    names = {SYSTEM_ID: "hot_id"} | {c: f"hot {c}" for c in attributes.columns}
    known = known.withColumnsRenamed(names)
    equipment = equipment.join(F.broadcast(known), key == F.col("hot_id"), "left")
    alone = key.isNull() | F.col("hot_id").isNotNull()
    row_hash = F.xxhash64(*[F.col(f"`{c}`") for c in columns])
    id_hash = F.xxhash64(key.cast("string"))
    salted = equipment.withColumn("row salt", F.when(alone, row_hash).otherwise(id_hash))
    targets = attributes.withColumn("salt", F.xxhash64(F.col(MATERIAL_ID).cast("string")))
    joined = salted.join(
        targets,
        (salted[SYSTEM_ID] == targets[MATERIAL_ID]) & (F.col("row salt") == F.col("salt")),
        "left",
    )
    found = [
        F.coalesce(F.col(f"`{c}`"), F.col(f"`hot {c}`")).alias(c) for c in attributes.columns
    ]
    return joined.select(*[F.col(f"`{c}`") for c in columns], *found)


def _left_join(equipment: DataFrame, attributes: DataFrame) -> DataFrame:
    return equipment.join(
        attributes, equipment[SYSTEM_ID] == attributes[MATERIAL_ID], "left"
    )


def _attributes(targets: DataFrame) -> DataFrame:
    """The joined-in target columns; leaves out the model name, which equipment has itself."""
    return targets.select(*[F.col(f"`{name}`") for name in TARGET_ATTRIBUTES])


def _value_bytes(field: T.StructField):
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.StringType):
        return F.coalesce(F.octet_length(column), F.lit(0)) + F.lit(8)
    return F.lit(8)
