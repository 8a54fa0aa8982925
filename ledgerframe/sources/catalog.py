"""``Sources``: the raw operational tables by two-part name (``Schema.Table``).

Tables come from a folder of Parquet files (``<root>/<Schema>.<Table>``, or
``<root>/<Schema>/<Table>``, with or without the format's suffix), from a JDBC
connection, or from DataFrames handed in directly (tests, adapters).  Every cleaning dataset reads its
inputs through this mapping, so column pruning and predicate pushdown reach
the scans.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Tables read by the cleaning scripts (42 scan clauses over 35 tables).
RAW_TABLES = (
    "Person.Person", "Person.EmailAddress", "Person.PersonPhone", "Person.PhoneNumberType",
    "Person.BusinessEntityAddress", "Person.Address", "Person.AddressType", "Person.StateProvince",
    "Person.CountryRegion",
    "HumanResources.Department", "HumanResources.Employee", "HumanResources.EmployeeDepartmentHistory",
    "HumanResources.EmployeePayHistory", "HumanResources.JobCandidate", "HumanResources.Shift",
    "Production.Product", "Production.ProductSubcategory", "Production.ProductCategory",
    "Production.ProductModel", "Production.ProductInventory", "Production.Location",
    "Production.WorkOrder", "Production.ScrapReason", "Production.TransactionHistory",
    "Purchasing.Vendor", "Purchasing.PurchaseOrderHeader", "Purchasing.PurchaseOrderDetail",
    "Purchasing.ShipMethod", "Purchasing.ProductVendor",
    "Sales.SalesOrderHeader", "Sales.SalesOrderDetail", "Sales.CurrencyRate", "Sales.Customer",
    "Sales.Store", "Sales.SalesTerritory",
)


# Layouts tried in this order below the root when none is declared.
LAYOUTS = ("{schema}.{table}", "{schema}.{table}.{fmt}", "{schema}/{table}", "{schema}/{table}.{fmt}")
PARTITION_OPTIONS = ("partitionColumn", "lowerBound", "upperBound", "numPartitions")


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in its own file system (local, cluster or object
    store), as Spark's readers see it."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


class Sources:
    """Name -> DataFrame mapping for the raw tables.

    ``tables``: DataFrames, or functions that build them when first asked for.

    ``root``/``fmt``: a folder, by path or URI; ``layout`` declares where a
    table lies below it (one of LAYOUTS, or any pattern with {schema} and
    {table}); without it the layouts are tried in turn.

    ``jdbc``: options of the connection; ``table_options`` adds options for
    single tables, such as the four partition options of a large table's
    parallel read (they must come together: Spark needs all of them).
    """

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame | Callable[[], DataFrame]] | None = None,
                 root: str | None = None, fmt: str = "parquet", jdbc: dict | None = None,
                 layout: str | None = None, table_options: dict[str, dict] | None = None):
        self.spark = spark
        self._tables = dict(tables or {})
        self.root, self.fmt, self.jdbc, self.layout = root, fmt, jdbc, layout
        self.table_options = dict(table_options or {})

    def __contains__(self, name: str) -> bool:
        return name in self._tables or self.jdbc is not None or self._path(name) is not None

    def _path(self, name: str) -> str | None:
        if not self.root:
            return None
        schema, table = name.split(".", 1)
        for layout in (self.layout,) if self.layout else LAYOUTS:
            p = f"{self.root.rstrip('/')}/{layout.format(schema=schema, table=table, fmt=self.fmt)}"
            if _exists(self.spark, p):
                return p
        return None

    def read_options(self, name: str) -> dict[str, str]:
        """The JDBC options of one table."""
        own = self.table_options.get(name, {})
        given = [o for o in PARTITION_OPTIONS if o in own]
        if given and len(given) < len(PARTITION_OPTIONS):
            raise ValueError(f"{name}: a partitioned read needs {', '.join(PARTITION_OPTIONS)}; given: {given}")
        shared = [o for o in PARTITION_OPTIONS if o in (self.jdbc or {})]
        if shared:
            raise ValueError(f"{shared} belong to single tables: put them in table_options")
        return {**(self.jdbc or {}), "dbtable": name, **own}

    def __getitem__(self, name: str) -> DataFrame:
        if name in self._tables:
            if not isinstance(self._tables[name], DataFrame):
                self._tables[name] = self._tables[name]()
            return self._tables[name]
        if self.jdbc is not None:
            return self.spark.read.format("jdbc").options(**self.read_options(name)).load()
        p = self._path(name)
        if p is None:
            raise KeyError(f"raw table {name!r} is not available (dependency missing: "
                           f"build order is Person, HR, Production, Purchasing, Sales, then the golden record)")
        return self.spark.read.format(self.fmt).options(**self.table_options.get(name, {})).load(p)

    def with_tables(self, **more: DataFrame) -> "Sources":
        t = dict(self._tables)
        t.update({k.replace("__", "."): v for k, v in more.items()})
        return Sources(self.spark, t, self.root, self.fmt, self.jdbc, self.layout, self.table_options)


def split_predicates(keys: DataFrame, column: str, parts: int) -> list[str]:
    """Predicates that cut a table into ``parts`` reads of about equal rows, for
    ``spark.read.jdbc(..., predicates=...)``.

    ``partitionColumn`` with bounds cuts the key's *range* evenly, so a skewed key
    gives one long read.  Here the cuts are the quantiles of ``keys`` (the key
    column, or a sample of it): a value that fills a whole part or more becomes
    a part of its own, and nulls are one more.  Every row fits exactly one
    predicate, whatever the sample missed.  Keys are numbers.
    """
    if parts < 2:
        return ["1 = 1"]
    steps = [i / parts for i in range(1, parts)]
    row = keys.agg(F.percentile_approx(column, steps, 100 * parts).alias("cuts")).first()
    cuts = list(row.cuts or [])
    if not cuts:
        return [f"{column} IS NULL", f"{column} IS NOT NULL"]
    out, low = [], None
    for cut in sorted(set(cuts)):
        alone = cuts.count(cut) > 1
        below = f"{column} < {cut}" if alone else f"{column} <= {cut}"
        out.append(below if low is None else f"{low} AND {below}")
        if alone:
            out.append(f"{column} = {cut}")
        low = f"{column} > {cut}"
    return [*out, low, f"{column} IS NULL"]
