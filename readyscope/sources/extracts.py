"""Header-named extracts (CSV), their conversion to Parquet, and the fleet loader."""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readyscope.model import BUSINESS_LINE, COLUMN_TYPES, REGION

# Fixed value: the one header whose column name does not follow the rule
SPECIAL_HEADERS = {"TARGET (SRS READY)": "target_srs_ready"}


# The common dialect: quotes are doubled, nothing is trimmed
_DIALECT = {
    "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
}


def _new_mark() -> str:
    """What a quoted empty text is read as for once; no text can be expected to hold it."""
    return f"\x00{uuid.uuid4().hex}"


# Columns of the quarantine table
RECORD, RECORD_FILE = "record", "file"
_CORRUPT, _IS_BAD = "corrupt record", "quarantined"


def canonical_name(header: str) -> str:
    return SPECIAL_HEADERS.get(header, header.replace(" ", "_").lower())


def normalise_headers(df: DataFrame) -> DataFrame:
    """Rename all columns at once: blanks to underscores, lower case.

    Headers that end up with one name cannot be told apart any more and are an error.
    """
    names = [canonical_name(header) for header in df.columns]
    if twice := sorted({name for name in names if names.count(name) > 1}):
        raise ValueError(f"several headers become {', '.join(twice)}")
    return df.toDF(*names)


def read_extract(
    spark: SparkSession,
    path: str,
    types: Mapping[str, T.DataType] = COLUMN_TYPES,
    infer: bool = False,
    mode: str = "FAILFAST",
    multi_line: bool = False,
) -> DataFrame:
    """Scan a CSV extract with a header line and normalise its column names.

    Only the header is read to build the schema; types come from ``types`` by
    normalised name (string where unknown), so the data is read once, by the
    query. ``infer=True`` scans the data for types instead. A value that does
    not fit its type stops the read rather than turn into null.

    Values are read as they were written: blanks around them stay, a doubled quote is a
    quote, an empty text in quotes is empty and one without is null. Line breaks within
    quotes need ``multi_line``; such a file is read by one task, so large data should
    come as Parquet.
    """
    mark = _new_mark()
    reader = spark.read.options(header=True, multiLine=multi_line, emptyValue=mark, **_DIALECT)
    if infer:
        return _with_empty_texts(normalise_headers(reader.option("inferSchema", True).csv(path)), mark)
    schema = _schema(reader.csv(path).columns, types)
    # enforceSchema=False: every file's own header must agree with the schema
    scan = reader.schema(schema).option("enforceSchema", False).option("mode", mode)
    return _with_empty_texts(normalise_headers(scan.csv(path)), mark)


def _schema(headers: list[str], types: Mapping[str, T.DataType]) -> T.StructType:
    return T.StructType(
        [T.StructField(h, types.get(canonical_name(h), T.StringType())) for h in headers]
    )


@dataclass(frozen=True)
class Ingested:
    """What an extract held: its rows, and the records that are none."""

    rows: DataFrame
    quarantine: DataFrame


def ingest_extract(
    spark: SparkSession,
    path: str,
    target: str,
    types: Mapping[str, T.DataType] = COLUMN_TYPES,
    multi_line: bool = False,
) -> Ingested:
    """Convert a CSV extract to Parquet at ``target``, with what does not fit set apart.

    A record with a value that does not fit its type, or with more or fewer values than
    the header, goes to the quarantine table as it stands in the file, beside the file's
    name. All others are the rows, read as ``read_extract`` does. One scan of the extract
    writes both, as two partitions of ``target``, so no record is in both or in neither.
    """
    mark = _new_mark()
    reader = spark.read.options(header=True, multiLine=multi_line, emptyValue=mark, **_DIALECT)
    headers = reader.csv(path).columns
    schema = _schema(headers, types).add(_CORRUPT, T.StringType())
    scan = reader.schema(schema).options(
        enforceSchema=False, mode="PERMISSIVE", columnNameOfCorruptRecord=_CORRUPT
    )
    named = [canonical_name(header) for header in headers]
    if RECORD in named or RECORD_FILE in named or _IS_BAD in named or len(set(named)) < len(named):
        raise ValueError(f"headers may not repeat, nor be {RECORD}, {RECORD_FILE} or {_IS_BAD}")
    found = scan.csv(path).withColumn(RECORD_FILE, F.input_file_name())
    bad = F.col(f"`{_CORRUPT}`").isNotNull()
    values = [F.when(~bad, F.col(_quoted(h))).alias(canonical_name(h)) for h in headers]
    found = found.select(*values, F.col(f"`{_CORRUPT}`").alias(RECORD), RECORD_FILE)
    found = _with_empty_texts(found, mark)
    found = found.withColumn(_IS_BAD, F.col(RECORD).isNotNull())
    found.write.mode("overwrite").partitionBy(_IS_BAD).parquet(target)
    stored = spark.read.schema(found.schema).parquet(target)
    return Ingested(
        stored.where(~F.col(_IS_BAD)).select(*[F.col(_quoted(name)) for name in named]),
        stored.where(_IS_BAD).select(RECORD_FILE, RECORD),
    )


def _quoted(name: str) -> str:
    return "`{}`".format(name.replace("`", "``"))


def _with_empty_texts(df: DataFrame, mark: str) -> DataFrame:
    """Quoted empty texts, which the reader marks to tell them from nulls."""
    texts = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}

    def value(name: str) -> Column:
        column = F.col(_quoted(name))
        return F.when(column == mark, "").otherwise(column).alias(name)

    return df.select(*[value(n) if n in texts else F.col(_quoted(n)) for n in df.columns])


def write_extract(df: DataFrame, path: str) -> None:
    """Write a CSV extract with a header line, replacing an earlier one."""
    df.write.mode("overwrite").options(header=True, emptyValue='""', **_DIALECT).csv(path)


def to_parquet(df: DataFrame, path: str, cluster_by=(BUSINESS_LINE, REGION)) -> None:
    """Convert an extract once, so that queries read columns instead of text.

    Rows are sorted within their partition by the usual filter columns (no
    shuffle), which lets filters skip row groups by their statistics.
    """
    present = [name for name in cluster_by if name in df.columns]
    rows = df.sortWithinPartitions(*present) if present else df
    rows.write.mode("overwrite").parquet(path)


def load_fleet(
    spark: SparkSession, equipment_path: str, targets_path: str, fmt: str = "csv"
) -> tuple[DataFrame, DataFrame]:
    """Equipment and targets from CSV extracts or Parquet, with normalised names."""
    if fmt == "csv":
        return read_extract(spark, equipment_path), read_extract(spark, targets_path)
    if fmt == "parquet":
        return (
            normalise_headers(spark.read.parquet(equipment_path)),
            normalise_headers(spark.read.parquet(targets_path)),
        )
    raise ValueError(f"fmt must be 'csv' or 'parquet', not {fmt!r}")
