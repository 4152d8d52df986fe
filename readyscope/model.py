"""Column names, schemas and the fixed vocabulary of the readiness data model."""

from __future__ import annotations

from pyspark.sql import types as T

# Equipment (fact) columns
SERIAL = "equipment_serial_number"
LEVEL = "level_of_connection"
SYSTEM_ID = "system_id"
SYSTEM_NAME = "system_name"
BUSINESS_LINE = "business_line"
CITY = "city"
STATE = "state"
REGION = "service_region"
LINK_STATUS = "current_connectivity_status"
INSTALLED_ON = "equipment_installation_date"

# Target (dimension) columns; the question mark is part of the documented name
MATERIAL_ID = "material_id"
MOBILITY = "mobile_system_or_fixed_system?"
TARGET = "target_srs_ready"

# Connection levels, link states
READY = "SRS READY"
CONNECTED_NOT_READY = "CONNECTED BUT NOT SRS READY"
NOT_CONNECTED = "NOT CONNECTED"
LINK_OK = "Connection OK"
LINK_EXPIRED_PREFIX = "Connection Expired"

# The "everything" entry of each filter list
ALL_TOKENS = {
    REGION: "Todas as Regionais",
    BUSINESS_LINE: "Todas as Linhas",
    LEVEL: "Todos os Status",
}

# Region label shortened in the distribution report
REGION_LABELS = {"SÃO PAULO INTERIOR": "SP INTERIOR"}

EQUIPMENT_SCHEMA = T.StructType(
    [
        T.StructField(SERIAL, T.StringType()),
        T.StructField(LEVEL, T.StringType()),
        T.StructField(SYSTEM_ID, T.StringType()),
        T.StructField(SYSTEM_NAME, T.StringType()),
        T.StructField(BUSINESS_LINE, T.StringType()),
        T.StructField(CITY, T.StringType()),
        T.StructField(STATE, T.StringType()),
        T.StructField(REGION, T.StringType()),
        T.StructField(LINK_STATUS, T.StringType()),
        T.StructField(INSTALLED_ON, T.DateType()),
    ]
)

TARGET_SCHEMA = T.StructType(
    [
        T.StructField(MATERIAL_ID, T.StringType()),
        T.StructField(SYSTEM_NAME, T.StringType()),
        T.StructField(MOBILITY, T.StringType()),
        T.StructField(TARGET, T.DoubleType()),
    ]
)

EQUIPMENT_COLUMNS = EQUIPMENT_SCHEMA.fieldNames()

# What the enriched fleet adds to each equipment row
TARGET_ATTRIBUTES = [MATERIAL_ID, MOBILITY, TARGET]

# Canonical column name -> type, for reading header-named extracts
COLUMN_TYPES = {f.name: f.dataType for f in [*EQUIPMENT_SCHEMA, *TARGET_SCHEMA]}
