"""Snapshot refresh of the golden record (A4).

A refresh that overwrites a folder breaks its readers and rewrites every year.
Here a store is a folder of

* ``data/v=<n>/OrderYear=<y>/`` — the years that version n changed, and
* ``log/`` — one small file per version, a row per year: where the year lies,
  its row count and content mark, and the additive states of the statistics
  that plans put in as literals (calendar, latest date, spread of revenue).

The log's largest version is the pointer.  Its file appears by one rename when
the version's data is complete, so a reader sees the version before or the one
after, and a DataFrame read earlier keeps its own files.  A refresh computes the
record once: its years are written below the new version, marked by content
from there, and those whose mark did not change are removed again, as the log
goes on naming their older files.  With a high-water mark, years before it are
taken as unchanged and not even read.  Statistics come from the version's rows, so
they are never those of another version.  One writer at a time.
"""

from __future__ import annotations

import datetime
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..operators.stats import remember
from ..session import remove
from .golden import GOLDEN_COLUMNS

REV = "GrossRevenueUSD"
LOG = ("version int, year int, at int, rows long, mark long, first date, last date, first_ship date, last_ship date, "
       "n long, total decimal(38,6), squares decimal(38,12)")


class GoldenStore:
    """Versions of the golden record below ``path`` (a folder all of Spark sees)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _log(self) -> list:
        try:
            return self.spark.read.schema(LOG).parquet(f"{self.path}/log").collect()  # a row per version and year
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e):
                return []
            raise

    def versions(self) -> list[int]:
        return sorted({r.version for r in self._log()})

    def _years(self, version: int | None = None) -> list:
        log = self._log()
        if not log:
            return []
        last = max(r.version for r in log) if version is None else version
        return [r for r in log if r.version == last]

    def _folder(self, version: int, year: int | None) -> str:
        return f"{self.path}/data/v={version}/OrderYear=" + ("__HIVE_DEFAULT_PARTITION__" if year is None else str(year))

    def _marks(self, rows: DataFrame) -> list:
        """A row per year: count, content mark and states of the statistics."""
        square = F.col(REV).cast("decimal(18,6)")
        return rows.groupBy("OrderYear").agg(
            F.count(F.lit(1)).alias("rows"),
            # equal rows would cancel in one xor: a sum of 31-bit parts beside it
            (F.bit_xor(F.xxhash64(*GOLDEN_COLUMNS)) + F.sum(F.xxhash64(*GOLDEN_COLUMNS, F.lit(1)).bitwiseAND(F.lit(0x7FFFFFFF)))).alias("mark"),
            F.min("OrderDate").alias("first"), F.max("OrderDate").alias("last"), F.min("ShipDate").alias("first_ship"),
            F.max("ShipDate").alias("last_ship"), F.count(REV).alias("n"), F.sum(REV).alias("total"),
            F.sum((square * square).cast("decimal(38,12)")).alias("squares")).collect()

    def refresh(self, g: DataFrame, since: int | None = None) -> int:
        """Write the years of ``g`` that changed as a new version; returns its
        number (the current one if nothing changed).

        ``since``: the high-water mark, the first year that can have changed;
        ``g`` is then read from that year on only."""
        current = self._years()
        old = {r.year: r for r in current if r.at >= 0}
        kept = {y: r for y, r in old.items() if since is not None and y is not None and y < since}
        fresh = g if since is None else g.where((F.col("OrderYear") >= since) | F.col("OrderYear").isNull())
        version = current[0].version if current else 0
        # Tasks write their own rows, without a shuffle of whole lines; below a
        # version that the log does not name yet, nobody reads.
        folder = f"{self.path}/data/v={version + 1}"
        (fresh.sortWithinPartitions("OrderYear", "OrderMonth")
         .write.mode("overwrite").option("compression", "zstd").partitionBy("OrderYear").parquet(folder))
        marks = self._marks(self.spark.read.schema(fresh.schema).parquet(folder))
        changed = [r.OrderYear for r in marks if r.OrderYear not in old or old[r.OrderYear].mark != r.mark
                   or old[r.OrderYear].rows != r.rows]
        if not changed and {r.OrderYear for r in marks} | kept.keys() == old.keys():
            remove(self.spark, folder)
            return version
        version += 1
        for r in marks:
            if r.OrderYear not in changed:
                remove(self.spark, self._folder(version, r.OrderYear))
        rows = [(version, r.OrderYear, version if r.OrderYear in changed else old[r.OrderYear].at, *tuple(r)[1:]) for r in marks]
        rows += [(version, *tuple(r)[1:]) for r in kept.values()]
        if not rows:  # an empty record is a version without years
            rows = [(version, None, -1, 0, 0, None, None, None, None, 0, None, None)]
        self.spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(f"{self.path}/log")
        return version

    def read(self, version: int | None = None) -> DataFrame:
        """A version of the record (None: the current one), with its statistics."""
        years = self._years(version)
        if not years:
            raise ValueError(f"no such version below {self.path}: {version}")
        held = [r for r in years if r.at >= 0]
        if not held:
            raise ValueError(f"version {years[0].version} below {self.path} holds no rows")
        folders = [self._folder(r.at, r.year) for r in held]
        out = self.spark.read.option("basePath", f"{self.path}/data").parquet(*folders).select(*GOLDEN_COLUMNS)
        days = [d for r in held for d in (r.first, r.last, r.first_ship, r.last_ship) if d is not None]
        latest = max((r.last for r in held if r.last is not None), default=None)
        if latest is None:
            return out
        n, total = sum(r.n for r in held), float(sum(r.total or 0 for r in held))
        squares = float(sum(r.squares or 0 for r in held))
        spread = (total / n, math.sqrt(max(squares - total * total / n, 0.0) / n)) if n else None
        return remember(out, calendar=(datetime.date(min(days).year, 1, 1), datetime.date(max(days).year, 12, 31)),
                        latest=latest, spread=spread)
