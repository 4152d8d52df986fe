"""Monthly export of the action list: staged in a directory of its own, then published.

Below the base directory, each export writes to ``_versions/<version>/report_month=<month>``
and, once that is whole, publishes it by creating an empty file of the version's name in
``_published/report_month=<month>``. Creating a file is one atomic step on any file system.
The greatest name there is the month. A run that fails or is killed before has published
nothing: readers go on with the version before.
"""

from __future__ import annotations

import re
import uuid
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MONTH_COLUMN = "report_month"
# Versions of a month that stay, so that a reader who has begun can finish
KEPT_VERSIONS = 2
_PUBLISHED, _VERSIONS = "_published", "_versions"


def current_month() -> str:
    return date.today().strftime("%Y%m")


class _Folder:
    """A directory on the file system that Spark reads and writes it with."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._files = self._path().getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, *below: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *below]))

    def names(self, *below: str) -> list[str]:
        place = self._path(*below)
        if not self._files.exists(place):
            return []
        return sorted(status.getPath().getName() for status in self._files.listStatus(place))

    def create(self, *below: str) -> None:
        if not self._files.createNewFile(self._path(*below)):
            raise FileExistsError("/".join(below))

    def delete(self, *below: str) -> None:
        self._files.delete(self._path(*below), True)


def _directory(month: str) -> str:
    return f"{MONTH_COLUMN}={month}"


def export_month(
    report: DataFrame, base_path: str, month: str | None = None, rebalance: bool = False
) -> str:
    """Write a report as its month's new version, publish it, and return its directory.

    A re-run replaces that month only, also when it has no rows. Nothing that readers see
    is touched before all rows are written. With ``rebalance``, one shuffle of the list
    makes files of the advisory size; otherwise there is a file per task.
    """
    month = month or current_month()
    if not re.fullmatch(r"\d{4}(0[1-9]|1[0-2])", month):
        raise ValueError(f"report month must be YYYYMM, not {month!r}")
    folder = _Folder(report.sparkSession, base_path)
    earlier = folder.names(_PUBLISHED, _directory(month))
    # versions are counted up; two exports at once get the same count and go by the rest
    count = int(earlier[-1].partition("-")[0]) + 1 if earlier else 1
    version = f"{count:09d}-{uuid.uuid4().hex}"
    path = "/".join([folder.path, _VERSIONS, version, _directory(month)])
    rows = report.hint("rebalance") if rebalance else report
    rows.write.parquet(path)
    folder.create(_PUBLISHED, _directory(month), version)
    for old in earlier[: 1 - KEPT_VERSIONS]:
        folder.delete(_PUBLISHED, _directory(month), old)
        folder.delete(_VERSIONS, old)
    return path


def published_months(spark: SparkSession, base_path: str) -> dict[str, str]:
    """The directory of each published month.

    Months that were written straight to ``report_month=<month>`` count as long as no
    version of them is published.
    """
    folder = _Folder(spark, base_path)
    prefix = f"{MONTH_COLUMN}="
    found = {
        name.removeprefix(prefix): f"{folder.path}/{name}"
        for name in folder.names() if re.fullmatch(rf"{prefix}\d{{6}}", name)
    }
    for name in folder.names(_PUBLISHED):
        if versions := folder.names(_PUBLISHED, name):
            found[name.removeprefix(prefix)] = "/".join([folder.path, _VERSIONS, versions[-1], name])
    return dict(sorted(found.items()))


def read_months(spark: SparkSession, base_path: str) -> DataFrame:
    """All published months, with the month as text; a filter on it reads only that month."""
    months = None
    for month, path in published_months(spark, base_path).items():
        rows = spark.read.parquet(path).withColumn(MONTH_COLUMN, F.lit(month))
        months = rows if months is None else months.unionByName(rows, allowMissingColumns=True)
    if months is None:
        raise FileNotFoundError(f"no month is published in {base_path}")
    return months
