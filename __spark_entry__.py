"""

Each query runs over the whole retail tables, mapped to equipment and targets
by ``readyscope.sources.retail``; the oracles repeat that mapping in SQL.
"""

from __future__ import annotations

import importlib.util
import sys
import uuid
from collections.abc import Callable, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from readyscope.model import (  # noqa: E402
    BUSINESS_LINE,
    CITY,
    EQUIPMENT_COLUMNS,
    LEVEL,
    LINK_STATUS,
    MATERIAL_ID,
    MOBILITY,
    REGION,
    SERIAL,
    STATE,
    SYSTEM_ID,
    SYSTEM_NAME,
    TARGET,
)
from readyscope.operators import action_list, categories, cube, kpis, rollups, summary  # noqa: E402
from readyscope.operators.enrich import enrich  # noqa: E402
from readyscope.operators.filters import apply_filters, selections_to_filters  # noqa: E402
from readyscope.plans.metrics import metric_by  # noqa: E402
from readyscope.plans.sqlgate import SqlGate  # noqa: E402
from readyscope.sources import retail  # noqa: E402
from readyscope.sources.extracts import (  # noqa: E402
    ingest_extract,
    load_fleet,
    normalise_headers,
    read_extract,
    to_parquet,
    write_extract,
)
from readyscope.sources.bucketed import ingest_bucketed  # noqa: E402
from readyscope.sources.footers import stored_rows  # noqa: E402
from readyscope.sources.reports import export_month, read_months  # noqa: E402
from readyscope.sources.scratch import shared_directory  # noqa: E402

# The training-data operators are optional: without their folder, the rest works
if importlib.util.find_spec("readyscope.llm") and importlib.util.find_spec("corpus_pipeline"):
    import corpus_pipeline  # noqa: E402
    from readyscope.llm import registry  # noqa: E402

    TEXT_QUERIES = registry.queries() | {"pipeline": corpus_pipeline.run}
    TEXT_ORACLES = registry.oracle_sql()
else:
    TEXT_QUERIES, TEXT_ORACLES = {}, {}

SMOKE_DIR = "/root/testdata/sf0.001"

# Values in any case: requested values are upper-cased by the filter
ASIA_BUILDING = {REGION: ["Asia"], BUSINESS_LINE: ["Building"]}
ASIA_BUILDING_VERBATIM = {REGION: "ASIA", BUSINESS_LINE: "BUILDING"}
FILTER_COLUMNS = [REGION, BUSINESS_LINE]
ACTION_COLUMNS = [SERIAL, LEVEL, SYSTEM_NAME, BUSINESS_LINE, CITY, STATE, REGION, LINK_STATUS]
EXPORT_MONTH = "202501"

READY_BY_LINE_SQL = """
    SELECT business_line, COUNT(*) AS total,
           ROUND(AVG(target_srs_ready), 4) AS mean_target,
           MIN(equipment_installation_date) AS first_installed
    FROM df_merged
    WHERE level_of_connection = 'SRS READY'
    GROUP BY business_line
    ORDER BY total DESC, business_line;
"""


PER_SYSTEM_SQL = """
    SELECT system_id, COUNT(*) AS n, COUNT(target_srs_ready) AS n_target
    FROM df_merged GROUP BY system_id ORDER BY n DESC, system_id
"""

# The two most frequent business lines of every region
BEST_LINES_SQL = """
    SELECT service_region, business_line, n
    FROM (SELECT service_region, business_line, COUNT(*) AS n,
                 ROW_NUMBER() OVER (PARTITION BY service_region
                                    ORDER BY COUNT(*) DESC, business_line) AS place
          FROM df_merged GROUP BY service_region, business_line)
    WHERE place <= 2
    ORDER BY service_region, n DESC, business_line
"""

# Cities of ready equipment that have none of the first business line
SET_OPERATION_SQL = """
    (SELECT city, state FROM df_merged WHERE level_of_connection = 'SRS READY'
     INTERSECT SELECT city, state FROM df_merged WHERE level_of_connection = 'NOT CONNECTED')
    EXCEPT SELECT city, state FROM df_merged WHERE service_region = 'ASIA'
    ORDER BY city, state
"""

# More cities than a plan should carry one by one
LONG_CITY_LIST = ["Nation_2", "NATION_12", "nation_7", *[f"no city {i}" for i in range(20_000)]]


def _fleet(
    spark: SparkSession, sf_dir: str, columns: Sequence[str] = EQUIPMENT_COLUMNS
) -> DataFrame:
    return enrich(
        retail.equipment(spark, sf_dir, columns),
        retail.targets(spark, sf_dir),
        ids_from=retail.equipment(spark, sf_dir, [SYSTEM_ID]),
    )


def _on_equipment(columns: list[str], operator: Callable[..., DataFrame], *args, **kwargs):
    """A query that applies an operator to the equipment columns it reads."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return operator(retail.equipment(spark, sf_dir, columns), *args, **kwargs)

    return query


def _with_targets(columns: list[str], operator: Callable[..., DataFrame], *args):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = retail.equipment(spark, sf_dir, columns)
        return operator(rows, retail.targets(spark, sf_dir), *args)

    return query


def _adherence_by_system(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = retail.equipment(spark, sf_dir, [SYSTEM_ID, LEVEL])
    names = retail.names(spark, sf_dir)
    return rollups.adherence_by_system(rows, retail.targets(spark, sf_dir), names=names)


def _not_connected_by_system(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = retail.equipment(spark, sf_dir, [SYSTEM_ID, LEVEL])
    return rollups.not_connected_by_system(rows, retail.names(spark, sf_dir))


def _metric_by_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, targets = retail.equipment(spark, sf_dir, [SYSTEM_ID, LEVEL]), retail.targets(spark, sf_dir)
    return metric_by(rows, "problem_rate", "meta SRS", targets=targets)


def _fleet_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The enriched fleet by the route for targets that are too large to broadcast."""
    columns = [SERIAL, SYSTEM_ID, LEVEL]
    rows = retail.equipment(spark, sf_dir, columns)
    ids = retail.equipment(spark, sf_dir, [SYSTEM_ID])
    return enrich(rows, retail.targets(spark, sf_dir), ids_from=ids, broadcast_limit_bytes=0)


def _fleet_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every mobile system listed twice: its equipment appears twice."""
    targets = retail.targets(spark, sf_dir)
    again = targets.where(F.col(f"`{MOBILITY}`") == "MOBILE SYSTEM")
    rows = retail.equipment(spark, sf_dir, [SERIAL, SYSTEM_ID])
    return enrich(rows, targets.unionByName(again), on_duplicate="fan_out")


def _fan_out_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the route for targets that are too large to broadcast, with salts for
    every system of more than one row in a hundred."""
    targets = retail.targets(spark, sf_dir)
    again = targets.where(F.col(f"`{MOBILITY}`") == "MOBILE SYSTEM")
    rows = retail.equipment(spark, sf_dir, [SERIAL, SYSTEM_ID])
    return enrich(
        rows, targets.unionByName(again), on_duplicate="fan_out",
        ids_from=retail.equipment(spark, sf_dir, [SYSTEM_ID]), broadcast_limit_bytes=0, hot_share=100,
    )


def _quarantined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of an extract with bad lines, and those lines as they are."""
    key, target = F.col(MATERIAL_ID), F.col(TARGET).cast("string")
    line = F.when(key % 10 == 3, F.concat(key, F.lit(",high")))
    line = line.when(key % 10 == 5, F.concat(key, F.lit(",0.5,0.5"))).when(key % 10 == 7, key.cast("string"))
    lines = retail.targets(spark, sf_dir).select(line.otherwise(F.concat(key, F.lit(","), target)).alias("line"))
    path = shared_directory(spark, "extract")
    # one column whose name and values are whole lines, without quotes: any line can be made
    whole_lines = lines.toDF("Material ID,TARGET (SRS READY)")
    whole_lines.write.options(header=True, sep="\x01", quote="").csv(path)
    found = ingest_extract(spark, path, shared_directory(spark, "ingest"))
    nothing = [F.lit(None).cast(kind).alias(c) for c, kind in found.rows.dtypes]
    bad = found.quarantine.select(*nothing, "record")
    return found.rows.withColumn("record", F.lit(None).cast("string")).unionByName(bad)


def _from_cube(report: Callable[..., DataFrame], *args, targets: bool = False, **kwargs):
    """A query that stores a cube of the fleet and reports on it."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        base = shared_directory(spark, "cube")
        cube.store_cube(retail.equipment(spark, sf_dir, cube.CUBE_COLUMNS), base, EXPORT_MONTH)
        counts = cube.read_cube(spark, base)
        if targets:
            return report(counts, retail.targets(spark, sf_dir), *args, **kwargs)
        return report(counts, *args, **kwargs)

    return query


def _sql_query(text: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return SqlGate(_fleet(spark, sf_dir), row_cap=None).query(text)

    return query


def _stored_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the ingested equipment, from the footers of its files."""
    path = shared_directory(spark, "ingest")
    to_parquet(retail.equipment(spark, sf_dir), path)
    return stored_rows(spark, path)


def _fleet_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The enriched fleet from tables that are bucketed by system."""
    rows = retail.equipment(spark, sf_dir, [SERIAL, SYSTEM_ID, LEVEL])
    targets = retail.targets(spark, sf_dir)
    path = shared_directory(spark, "bucketed")
    return ingest_bucketed(rows, targets, f"fleet_{uuid.uuid4().hex}", path, buckets=16).enriched()


def _targets_inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_directory(spark, "extract")
    write_extract(_raw_targets(spark, sf_dir), path)
    return read_extract(spark, path, infer=True)


def _awkward_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with quotes, blanks around them, commas, backslashes and line breaks, and back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr(
        "doc_id", "text", "concat('\"', source, '\", ', lang) AS quoted",
        "concat(' ', lang, '\\t ') AS blanks", "concat(source, '\\\\', lang, '\\\\') AS slashed",
        "concat('a\\r\\n', source, '\\n') AS broken", "if(doc_id % 2 = 0, '', NULL) AS empty",
    )
    path = shared_directory(spark, "extract")
    write_extract(docs, path)
    return read_extract(spark, path, multi_line=True)


def _export_this_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = shared_directory(spark, "activation")
    rows = action_list.activation_list(retail.equipment(spark, sf_dir, ACTION_COLUMNS))
    export_month(rows, base)
    months = read_months(spark, base)
    return months.groupBy("report_month").agg(F.count("*").alias("n"))


def _sql_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """More systems than an answer has rows."""
    return SqlGate(_fleet(spark, sf_dir, [SYSTEM_ID, LEVEL])).query(PER_SYSTEM_SQL)


def _sql_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SqlGate(_fleet(spark, sf_dir, [SYSTEM_ID, LEVEL]), row_cap=None).query(PER_SYSTEM_SQL)


def _raw_equipment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equipment under spreadsheet headers."""
    rows = retail.equipment(spark, sf_dir)
    return rows.toDF(*[c.replace("_", " ").title() for c in rows.columns])


def _raw_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    headers = ["Material ID", "SYSTEM NAME", MOBILITY.replace("_", " ").upper(), "TARGET (SRS READY)"]
    return retail.targets(spark, sf_dir).toDF(*headers)


def _scan_fleet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalise_headers(_raw_equipment(spark, sf_dir))


def _csv_round_trip(raw: Callable[[SparkSession, str], DataFrame]):
    """A query that writes a CSV extract under raw headers and scans it back."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = shared_directory(spark, "extract")
        write_extract(raw(spark, sf_dir), path)
        return read_extract(spark, path)

    return query


def _ingested_adherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Convert both tables to Parquet, load them, and report on the result."""
    base = shared_directory(spark, "ingest")
    to_parquet(_raw_equipment(spark, sf_dir), f"{base}/equipment")
    to_parquet(_raw_targets(spark, sf_dir), f"{base}/targets")
    fleet = load_fleet(spark, f"{base}/equipment", f"{base}/targets", fmt="parquet")
    return rollups.adherence_by_business_line(*fleet)


def _all_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = {REGION: ["Todas as Regionais", "Asia"], BUSINESS_LINE: ["Building"], LEVEL: []}
    return apply_filters(retail.equipment(spark, sf_dir), selections_to_filters(chosen))


def _filtered_by_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_filters(_fleet(spark, sf_dir), {MOBILITY: ["mobile system"], REGION: "asia"})


def _activation_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the month's list and read it back."""
    base = shared_directory(spark, "activation")
    rows = action_list.activation_list(retail.equipment(spark, sf_dir, ACTION_COLUMNS))
    export_month(rows, base, EXPORT_MONTH)
    return read_months(spark, base)


def _sql_where_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = retail.equipment(spark, sf_dir, [LEVEL, LINK_STATUS]).where(
        "level_of_connection = 'CONNECTED BUT NOT SRS READY'"
        " AND current_connectivity_status = 'Connection OK'"
    )
    return rows.agg(F.count("*").alias("n"))


def _sql_guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SqlGate(_fleet(spark, sf_dir)).query(READY_BY_LINE_SQL)


def _sql_records_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SqlGate(_fleet(spark, sf_dir)).records(READY_BY_LINE_SQL)


def _describe_fleet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary statistics; mean and deviation to nine significant digits, for the order of
    summing shows in the last ones."""
    numeric = [SERIAL, SYSTEM_ID]
    statistics = summary.describe_table(retail.equipment(spark, sf_dir))
    return statistics.select(
        *[
            F.format_string("%.8e", F.col(c).cast("double")).alias(c) if c in numeric else F.col(c)
            for c in statistics.columns
        ]
    )


def entry(spark: SparkSession) -> DataFrame:
    """Adherence to target by business line."""
    return queries()["adherence_by_business_line"](spark, SMOKE_DIR)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    line_level = [BUSINESS_LINE, LEVEL]
    return {
        # sources and the enriched fleet
        "scan_fleet": _scan_fleet,
        "scan_fleet_csv": _csv_round_trip(_raw_equipment),
        "scan_targets_csv": _csv_round_trip(_raw_targets),
        "ingested_adherence": _ingested_adherence,
        "fleet_enriched": _fleet,
        "fleet_enriched_split": _fleet_split,
        "fleet_fan_out": _fleet_fan_out,
        "fleet_fan_out_split": _fan_out_split,
        "fleet_bucketed": _fleet_bucketed,
        "total_equipment_stored": _stored_total,
        "scan_targets_inferred": _targets_inferred,
        "scan_awkward_text": _awkward_text,
        "scan_quarantine": _quarantined,
        # filters
        "filtered_fleet": _on_equipment(EQUIPMENT_COLUMNS, apply_filters, ASIA_BUILDING),
        "filtered_fleet_all_token": _all_token,
        "filtered_fleet_by_target": _filtered_by_target,
        "filtered_fleet_long_list": _on_equipment(
            EQUIPMENT_COLUMNS, apply_filters, {CITY: LONG_CITY_LIST, BUSINESS_LINE: ["Building"]}
        ),
        # KPIs
        "total_equipment": _on_equipment([SERIAL], kpis.total_equipment),
        "total_equipment_filtered": _on_equipment(
            FILTER_COLUMNS, kpis.total_equipment, ASIA_BUILDING
        ),
        "ready_pct": _on_equipment([LEVEL], kpis.ready_pct),
        "ready_pct_filtered": _on_equipment(
            [LEVEL, *FILTER_COLUMNS], kpis.ready_pct, ASIA_BUILDING
        ),
        "ready_pct_within_filter": _on_equipment(
            [LEVEL, *FILTER_COLUMNS], kpis.ready_pct, ASIA_BUILDING, "filtered"
        ),
        "ready_pct_verbatim_filter": _on_equipment(
            [LEVEL, *FILTER_COLUMNS], kpis.ready_pct, ASIA_BUILDING_VERBATIM, upper_values=False
        ),
        "ready_fraction": _on_equipment([LEVEL], kpis.ready_fraction),
        "connected_not_ready": _on_equipment([LEVEL, LINK_STATUS], kpis.connected_not_ready),
        "disconnected": _on_equipment([LEVEL, LINK_STATUS], kpis.disconnected),
        "connected_not_ready_filtered": _on_equipment(
            [LEVEL, LINK_STATUS, *FILTER_COLUMNS], kpis.connected_not_ready, ASIA_BUILDING
        ),
        "disconnected_filtered": _on_equipment(
            [LEVEL, LINK_STATUS, *FILTER_COLUMNS], kpis.disconnected, ASIA_BUILDING
        ),
        "kpi_panel": _on_equipment([LEVEL, LINK_STATUS], kpis.kpi_panel),
        "kpi_panel_filtered": _on_equipment(
            [LEVEL, LINK_STATUS, *FILTER_COLUMNS], kpis.kpi_panel, ASIA_BUILDING
        ),
        # category lists and labels
        "category_list": _on_equipment([REGION], categories.category_list, REGION),
        "category_lists": _on_equipment([LEVEL, *FILTER_COLUMNS], categories.category_lists),
        "title_labels": _on_equipment([LEVEL], categories.title_labels, LEVEL),
        # grouped reports
        "status_counts": _on_equipment([LEVEL], rollups.status_counts),
        "service_distribution": _on_equipment(
            [LEVEL, REGION],
            rollups.service_distribution,
            labels=retail.RETAIL_REGION_LABELS,
        ),
        "service_distribution_filtered": _on_equipment(
            [LEVEL, *FILTER_COLUMNS],
            rollups.service_distribution,
            {BUSINESS_LINE: ["Building", "Machinery"]},
            retail.RETAIL_REGION_LABELS,
        ),
        "adherence_by_business_line": _with_targets(
            [SYSTEM_ID, *line_level], rollups.adherence_by_business_line
        ),
        "adherence_by_business_line_filtered": _with_targets(
            [SYSTEM_ID, REGION, *line_level],
            rollups.adherence_by_business_line,
            {REGION: ["asia", "europe"], MOBILITY: ["fixed system"]},
        ),
        "adherence_by_system": _adherence_by_system,
        "not_connected_by_system": _not_connected_by_system,
        "not_connected_by_business_line": _on_equipment(
            line_level, rollups.not_connected_by_business_line
        ),
        "ready_share_by_business_line": _on_equipment(
            line_level, rollups.ready_share_by_business_line
        ),
        "top_region_by_ready_rate": _on_equipment(
            [REGION, LEVEL], rollups.top_regions_by_ready_rate
        ),
        "problem_share_by_business_line": _on_equipment(
            line_level, rollups.problem_share_by_business_line
        ),
        "describe_fleet": _describe_fleet,
        # registered metrics, by name and by business term
        "metric_by_state": _on_equipment([STATE, LEVEL], metric_by, "ready_rate", "state"),
        "metric_by_city": _on_equipment([CITY, LEVEL], metric_by, "problemas SRS", "cidade"),
        "metric_by_target": _metric_by_target,
        # action list and export
        "activation_list": _on_equipment(ACTION_COLUMNS, action_list.activation_list),
        "activation_list_filtered": _on_equipment(
            ACTION_COLUMNS, action_list.activation_list, ASIA_BUILDING, require_link_ok=True
        ),
        "activation_export": _activation_export,
        "activation_export_this_month": _export_this_month,
        # the same reports from a stored cube of counts
        "cube_kpi_panel": _from_cube(kpis.kpi_panel, ASIA_BUILDING),
        "cube_service_distribution": _from_cube(
            rollups.service_distribution, labels=retail.RETAIL_REGION_LABELS
        ),
        "cube_adherence_by_business_line": _from_cube(rollups.adherence_by_business_line, targets=True),
        "cube_adherence_by_system": _from_cube(rollups.adherence_by_system, targets=True),
        "cube_not_connected_by_system": _from_cube(rollups.not_connected_by_system),
        "cube_top_region_by_ready_rate": _from_cube(rollups.top_regions_by_ready_rate),
        "cube_problem_share_by_business_line": _from_cube(rollups.problem_share_by_business_line),
        "cube_metric_by_city": _from_cube(metric_by, "problemas SRS", "cidade"),
        # SQL
        "sql_where_count": _sql_where_count,
        "sql_guarded": _sql_guarded,
        "sql_records_json": _sql_records_json,
        "sql_capped": _sql_capped,
        "sql_whole": _sql_whole,
        "sql_ranked_window": _sql_query(BEST_LINES_SQL),
        "sql_set_operation": _sql_query(SET_OPERATION_SQL),
    } | TEXT_QUERIES


_EQUIPMENT_CTE = """
WITH equipment AS (
    SELECT l_orderkey * 10 + l_linenumber AS equipment_serial_number,
           CASE o_orderstatus WHEN 'F' THEN 'SRS READY'
                WHEN 'P' THEN 'CONNECTED BUT NOT SRS READY'
                ELSE 'NOT CONNECTED' END AS level_of_connection,
           CASE WHEN l_linenumber = 7 THEN -l_partkey - 1 ELSE l_partkey END AS system_id,
           lp.p_name AS system_name,
           c_mktsegment AS business_line,
           n_name AS city,
           substr(r_name, 1, 2) AS state,
           r_name AS service_region,
           CASE l_returnflag WHEN 'N' THEN 'Connection OK'
                WHEN 'A' THEN 'Connection Expired 30+ days' END AS current_connectivity_status,
           CAST(l_shipdate AS DATE) AS equipment_installation_date
    FROM lineitem
    LEFT JOIN orders ON l_orderkey = o_orderkey
    LEFT JOIN customer ON o_custkey = c_custkey
    LEFT JOIN nation ON c_nationkey = n_nationkey
    LEFT JOIN region ON n_regionkey = r_regionkey
    LEFT JOIN part lp ON l_partkey = lp.p_partkey AND l_linenumber <> 7
),
targets AS (
    SELECT p_partkey AS material_id,
           p_name AS system_name,
           CASE WHEN p_type IN ('SMALL', 'ECONOMY') THEN 'MOBILE SYSTEM'
                ELSE 'FIXED SYSTEM' END AS "mobile_system_or_fixed_system?",
           CASE WHEN p_type IN ('SMALL', 'ECONOMY') THEN CAST(0.25 AS DOUBLE)
                ELSE CAST(0.87 AS DOUBLE) END AS target_srs_ready
    FROM part
),
fleet AS (
    SELECT equipment.*, material_id, "mobile_system_or_fixed_system?", target_srs_ready
    FROM equipment LEFT JOIN targets ON system_id = material_id
)
"""

# SQL pieces shared by several oracles
_READY = "level_of_connection = 'SRS READY'"
_LINK_OK = (
    "level_of_connection = 'CONNECTED BUT NOT SRS READY'"
    " AND current_connectivity_status = 'Connection OK'"
)
_DISCONNECTED = (
    "(level_of_connection = 'NOT CONNECTED'"
    " OR current_connectivity_status LIKE 'Connection Expired%')"
)
_ASIA_BUILDING = "service_region = 'ASIA' AND business_line = 'BUILDING'"


def _count(condition: str = "TRUE") -> str:
    return f"CAST(COUNT(*) FILTER (WHERE {condition}) AS BIGINT)"


def _pct(part: str, total: str = "COUNT(*)") -> str:
    """A KPI percentage: the two digits that printing gives, which go by the binary value."""
    return f"CAST(printf('%.2f', {part}::DOUBLE / {total} * 100) AS DOUBLE)"


def _half_up(part: str, total: str) -> str:
    """part / total with two digits, half up, in integers so that ties are exact."""
    return f"((200 * {part} + {total}) // (2 * {total})) / 100.0::DOUBLE"


def _share_oracle(groups: str, condition: str, part: str, rate: str) -> str:
    return f"""
        SELECT {groups}, total_equipment, {part},
               {_half_up(part, 'total_equipment')} AS {rate}
        FROM (SELECT {groups}, COUNT(*) AS total_equipment, {_count(condition)} AS {part}
              FROM equipment GROUP BY {groups})
    """


def _template_oracle(group: str, condition: str, part: str, rate: str, k: int) -> str:
    return f"""
        SELECT {group}, COUNT(*) AS total_equipamentos, {_count(condition)} AS {part},
               round({_count(condition)} * 100.0::DOUBLE / COUNT(*), 2) AS {rate}
        FROM equipment GROUP BY {group} ORDER BY {rate} DESC, {group} LIMIT {k}
    """


def _distribution_oracle(where: str) -> str:
    return f"""
        SELECT level_of_connection,
               CASE service_region WHEN 'MIDDLE EAST' THEN 'ME' ELSE service_region END
                   AS service_region,
               equipment_count
        FROM (SELECT level_of_connection, service_region, COUNT(*) AS equipment_count
              FROM equipment WHERE {where} GROUP BY 1, 2)
    """


def _adherence_oracle(where: str) -> str:
    return f"""
        SELECT *, COALESCE(adherence_pct >= target_srs_ready, FALSE) AS meets_target
        FROM (SELECT business_line, round(target_srs_ready * 100) AS target_srs_ready,
                     COUNT(*) AS total_count, {_count(_READY)} AS srs_ready_count,
                     round({_count(_READY)}::DOUBLE / COUNT(*) * 100) AS adherence_pct
              FROM fleet WHERE {where}
              GROUP BY business_line, fleet.target_srs_ready)
    """


def _action_oracle(condition: str, extra: str = "") -> str:
    return f"""
        SELECT equipment_serial_number AS "Serial Number", system_name AS "System",
               business_line AS "Business Line", city || '/' || state AS "City/State",
               service_region AS "Service Region", current_connectivity_status AS "Status"{extra}
        FROM equipment WHERE {condition}
    """


def _panel_oracle(within: str) -> str:
    return f"""
        SELECT {_count(within)} AS total_equipment,
               {_pct(_count(f'{within} AND {_READY}'))} AS ready_pct,
               {_count(f'{within} AND {_LINK_OK}')} AS connected_not_ready,
               {_count(f'{within} AND {_DISCONNECTED}')} AS disconnected
        FROM equipment
    """


def _title(column: str) -> str:
    """Title case for the ASCII words of the retail tables."""
    words = (
        f"list_transform(string_split({column}, ' '),"
        " lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2)))"
    )
    return f"regexp_replace(array_to_string({words}, ' '), '\\bSrs\\b', 'SRS', 'g')"


def _describe_oracle() -> str:
    text_columns = [LEVEL, SYSTEM_NAME, BUSINESS_LINE, CITY, STATE, REGION, LINK_STATUS]
    statistics = {
        "count": ("COUNT({c})", "CAST(COUNT({c}) AS VARCHAR)"),
        "mean": ("AVG({c})", "CAST(NULL AS VARCHAR)"),
        "stddev": ("STDDEV_SAMP({c})", "CAST(NULL AS VARCHAR)"),
        "min": ("MIN({c})", "MIN({c})"),
        "max": ("MAX({c})", "MAX({c})"),
    }
    parts = []
    for name, (number, text) in statistics.items():
        columns = [
            f"printf('%.8e', CAST({number.format(c=c)} AS DOUBLE)) AS {c}" for c in (SERIAL, SYSTEM_ID)
        ] + [f"{text.format(c=c)} AS {c}" for c in text_columns]
        parts.append(f"SELECT '{name}' AS summary, {', '.join(columns)} FROM equipment")
    return " UNION ALL ".join(parts)


_PER_SYSTEM = """
    SELECT system_id, COUNT(*) AS n, COUNT(target_srs_ready) AS n_target
    FROM fleet GROUP BY system_id ORDER BY n DESC, system_id
"""


def _gate_oracle() -> str:
    return """
        SELECT business_line, COUNT(*) AS total,
               ROUND(AVG(target_srs_ready), 4) AS mean_target,
               MIN(equipment_installation_date) AS first_installed
        FROM fleet WHERE level_of_connection = 'SRS READY'
        GROUP BY business_line ORDER BY total DESC, business_line LIMIT 20
    """


def oracle_sql() -> dict[str, str]:
    bodies = {
        "scan_fleet": "SELECT * FROM equipment",
        "scan_fleet_csv": "SELECT * REPLACE (CAST(equipment_serial_number AS VARCHAR)"
        " AS equipment_serial_number, CAST(system_id AS VARCHAR) AS system_id) FROM equipment",
        "scan_targets_csv": "SELECT * REPLACE (CAST(material_id AS VARCHAR) AS material_id)"
        " FROM targets",
        "ingested_adherence": _adherence_oracle("TRUE"),
        "fleet_enriched": "SELECT * FROM fleet",
        "fleet_enriched_split": "SELECT equipment_serial_number, system_id, level_of_connection,"
        ' material_id, "mobile_system_or_fixed_system?", target_srs_ready FROM fleet',
        "fleet_fan_out": """
            SELECT equipment_serial_number, system_id, t.material_id,
                   t."mobile_system_or_fixed_system?", t.target_srs_ready
            FROM equipment LEFT JOIN (
                SELECT * FROM targets
                UNION ALL SELECT * FROM targets
                WHERE "mobile_system_or_fixed_system?" = 'MOBILE SYSTEM'
            ) t ON system_id = t.material_id
        """,
        "scan_targets_inferred": "SELECT * REPLACE (CAST(material_id AS INTEGER) AS material_id)"
        " FROM targets",
        "scan_awkward_text": """
            SELECT CAST(doc_id AS VARCHAR) AS doc_id, text,
                   '"' || source || '", ' || lang AS quoted,
                   ' ' || lang || chr(9) || ' ' AS blanks,
                   source || chr(92) || lang || chr(92) AS slashed,
                   'a' || chr(13) || chr(10) || source || chr(10) AS broken,
                   CASE WHEN doc_id % 2 = 0 THEN '' END AS "empty"
            FROM documents
        """,
        "activation_export_this_month": f"""
            SELECT strftime(current_date, '%Y%m') AS report_month, COUNT(*) AS n
            FROM ({_action_oracle("level_of_connection = 'CONNECTED BUT NOT SRS READY'")})
        """,
        "scan_quarantine": """
            SELECT CASE WHEN m NOT IN (3, 5, 7) THEN k END AS material_id,
                   CASE WHEN m NOT IN (3, 5, 7) THEN target_srs_ready END AS target_srs_ready,
                   CASE m WHEN 3 THEN k || ',high' WHEN 5 THEN k || ',0.5,0.5' WHEN 7 THEN k END
                       AS record
            FROM (SELECT CAST(material_id AS VARCHAR) AS k, material_id % 10 AS m, target_srs_ready
                  FROM targets)
        """,
        "filtered_fleet_long_list": "SELECT * FROM equipment"
        " WHERE city IN ('NATION_2', 'NATION_12', 'NATION_7') AND business_line = 'BUILDING'",
        "sql_ranked_window": BEST_LINES_SQL.replace("df_merged", "fleet"),
        "sql_set_operation": SET_OPERATION_SQL.replace("df_merged", "fleet"),
        "sql_capped": f"{_PER_SYSTEM} LIMIT 20",
        "sql_whole": _PER_SYSTEM,
        "filtered_fleet": f"SELECT * FROM equipment WHERE {_ASIA_BUILDING}",
        "filtered_fleet_all_token": "SELECT * FROM equipment WHERE business_line = 'BUILDING'",
        "filtered_fleet_by_target": "SELECT * FROM fleet WHERE service_region = 'ASIA'"
        " AND \"mobile_system_or_fixed_system?\" = 'MOBILE SYSTEM'",
        "total_equipment": "SELECT COUNT(*) AS total_equipment FROM equipment",
        "total_equipment_filtered": "SELECT COUNT(*) AS total_equipment FROM equipment"
        f" WHERE {_ASIA_BUILDING}",
        "ready_pct": f"SELECT {_pct(_count(_READY))} AS ready_pct FROM equipment",
        "ready_pct_filtered": f"SELECT {_pct(_count(f'{_READY} AND {_ASIA_BUILDING}'))}"
        " AS ready_pct FROM equipment",
        "ready_pct_within_filter": f"SELECT {_pct(_count(_READY))} AS ready_pct"
        f" FROM equipment WHERE {_ASIA_BUILDING}",
        "ready_pct_verbatim_filter": f"SELECT {_pct(_count(f'{_READY} AND {_ASIA_BUILDING}'))}"
        " AS ready_pct FROM equipment",
        "ready_fraction": f"""
            SELECT f AS ready_fraction, CAST(printf('%.2f', f) AS DOUBLE) AS ready_fraction_rounded
            FROM (SELECT {_count(_READY)}::DOUBLE / COUNT(*) AS f FROM equipment)
        """,
        "connected_not_ready": f"SELECT {_count(_LINK_OK)} AS connected_not_ready FROM equipment",
        "disconnected": f"SELECT {_count(_DISCONNECTED)} AS disconnected FROM equipment",
        "connected_not_ready_filtered": f"SELECT {_count(f'{_LINK_OK} AND {_ASIA_BUILDING}')}"
        " AS connected_not_ready FROM equipment",
        "disconnected_filtered": f"SELECT {_count(f'{_DISCONNECTED} AND {_ASIA_BUILDING}')}"
        " AS disconnected FROM equipment",
        "kpi_panel": _panel_oracle("TRUE"),
        "kpi_panel_filtered": _panel_oracle(_ASIA_BUILDING),
        "category_list": f"""
            SELECT {_title('service_region')} AS category
            FROM (SELECT DISTINCT service_region FROM equipment WHERE service_region IS NOT NULL)
        """,
        "category_lists": f"""
            SELECT DISTINCT 'service_region' AS column_name, {_title('service_region')} AS category
            FROM equipment
            UNION ALL SELECT DISTINCT 'business_line', business_line FROM equipment
            UNION ALL SELECT DISTINCT 'level_of_connection', {_title('level_of_connection')}
            FROM equipment
        """,
        "title_labels": f"""
            SELECT DISTINCT level_of_connection AS value, {_title('level_of_connection')} AS label
            FROM equipment
        """,
        "status_counts": "SELECT level_of_connection, COUNT(*) AS equipment_count"
        " FROM equipment GROUP BY 1",
        "service_distribution": _distribution_oracle("TRUE"),
        "service_distribution_filtered": _distribution_oracle(
            "business_line IN ('BUILDING', 'MACHINERY')"
        ),
        "adherence_by_business_line": _adherence_oracle("TRUE"),
        "adherence_by_business_line_filtered": _adherence_oracle(
            "service_region IN ('ASIA', 'EUROPE')"
            " AND \"mobile_system_or_fixed_system?\" = 'FIXED SYSTEM'"
        ),
        "adherence_by_system": f"""
            SELECT *, CASE WHEN srs_ready_pct_display >= target_srs_ready_pct THEN 1 ELSE 0 END
                       AS on_target
            FROM (SELECT system_id, system_name, COUNT(*) AS total_equipment,
                         {_count(_READY)} AS srs_ready_equipment,
                         {_count(_READY)}::DOUBLE / COUNT(*) * 100 AS srs_ready_pct_display,
                         target_srs_ready * 100 AS target_srs_ready_pct
                  FROM fleet GROUP BY system_id, system_name, target_srs_ready)
        """,
        "not_connected_by_system": _share_oracle(
            "system_id, system_name",
            "level_of_connection = 'NOT CONNECTED'",
            "srs_disconnected_equipment",
            "disconnected_percentage",
        ),
        "not_connected_by_business_line": _share_oracle(
            "business_line",
            "level_of_connection = 'NOT CONNECTED'",
            "srs_disconnected_equipment",
            "disconnected_percentage",
        ),
        "ready_share_by_business_line": _share_oracle(
            "business_line", _READY, "srs_ready_equipment", "ready_pct"
        ),
        "top_region_by_ready_rate": _template_oracle(
            "service_region", _READY, "equipamentos_srs_ready", "taxa_srs", 1
        ),
        "problem_share_by_business_line": _template_oracle(
            "business_line",
            "level_of_connection <> 'SRS READY'",
            "equipamentos_com_problema",
            "percentual_com_problema",
            10,
        ),
        "describe_fleet": _describe_oracle(),
        "metric_by_state": f"""
            SELECT state, round({_count(_READY)} * 100.0::DOUBLE / COUNT(*), 2) AS ready_rate
            FROM equipment GROUP BY state
        """,
        "metric_by_city": f"""
            SELECT city, {_count("level_of_connection <> 'SRS READY'")} AS problems
            FROM equipment GROUP BY city
        """,
        "metric_by_target": f"""
            SELECT target_srs_ready,
                   round({_count("level_of_connection <> 'SRS READY'")} * 100.0::DOUBLE / COUNT(*), 2)
                       AS problem_rate
            FROM fleet GROUP BY target_srs_ready
        """,
        "activation_list": _action_oracle("level_of_connection = 'CONNECTED BUT NOT SRS READY'"),
        "activation_list_filtered": _action_oracle(f"{_LINK_OK} AND {_ASIA_BUILDING}"),
        "activation_export": _action_oracle(
            "level_of_connection = 'CONNECTED BUT NOT SRS READY'",
            f", '{EXPORT_MONTH}' AS report_month",
        ),
        "sql_where_count": f"SELECT {_count(_LINK_OK)} AS n FROM equipment",
        "sql_guarded": _gate_oracle(),
        "sql_records_json": f"""
            SELECT CAST(to_json({{
                'business_line': business_line, 'total': total, 'mean_target': mean_target,
                'first_installed': date_diff('day', DATE '1970-01-01', first_installed) * 86400000
            }}) AS VARCHAR) AS record
            FROM ({_gate_oracle()})
        """,
    }
    # other routes to the same rows
    same = {name: name.removeprefix("cube_") for name in queries() if name.startswith("cube_")}
    same |= {"fleet_bucketed": "fleet_enriched_split", "total_equipment_stored": "total_equipment"}
    same |= {"cube_kpi_panel": "kpi_panel_filtered", "fleet_fan_out_split": "fleet_fan_out"}
    bodies |= {name: bodies[other] for name, other in same.items()}
    return {name: f"{_EQUIPMENT_CTE}{body.strip()}" for name, body in bodies.items()} | TEXT_ORACLES
