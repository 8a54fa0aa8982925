"""Adapter: the driver's TPC-H-shaped tables -> the four cleaned views the
golden record reads (sales performance, product master, customer profile,
person).

The mapping is deterministic and integer-exact so an independent SQL engine
can reproduce every value (see FIXTURES.md §3).  Money is derived from
integer cents, so every decimal below is exact.

At scale the adapter keeps one pass over each table:

* ``customer`` is enriched with ``nation``/``region`` (25 and 5 rows by the
  TPC-H definition, broadcast) and yields both the profile and the person
  rows, so the golden record joins the customer side once;
* ``part`` is joined once, to the lines alone, for both the unit price (needs
  ``p_size``) and the product master columns.  Spark/AQE broadcasts ``part``
  when its measured size is under the broadcast threshold and sort-merge joins
  it otherwise;
* the per-order customer columns are attached to ``orders`` *before* the line
  join, so lines with their part are shuffled once on ``l_orderkey``;
* ``*_rows`` are the columns that joins carry, ``*_columns`` what is derived
  from them: the golden record derives after its last join, so that no shuffle
  moves a column that its key or another column gives.
"""

from __future__ import annotations

import datetime as _dt
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lit_date

# Fixed values of the adapter (our own synthetic mapping of TPC-H keys to
# sales-BI attributes; FIXTURES.md §3).
STATUS_BY_ORDERSTATUS = {"F": 5, "O": 1}            # 'P' -> by key % 4
STATUS_P_BY_KEY_MOD4 = [2, 3, 4, 6]
ONLINE_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM"]
CURRENCY_BY_KEY_MOD11 = [None, None, None, "USD", "CAD", "GBP", "FRF", "DEM", "EUR", "AUD", "JPY"]
COUNTRY_BY_NATION_MOD6 = ["US", "CA", "GB", "AU", "FR", "DE"]
CUSTOMER_TYPE_BY_KEY_MOD3 = ["B2B (Store)", "B2C (Individual)", "Unknown"]
SHIPDATE_NULL_MODULUS = 17
PERSON_NULL_MODULUS = 5
EMAIL_DOMAIN = "@x.test"
SELL_END_BY_KEY_MOD4 = [_dt.date(1999, 1, 1), _dt.date(2090, 1, 1), None, None]
SELL_START = _dt.date(1990, 1, 1)
AS_OF = _dt.date(2001, 12, 31)

# Sales order status names (sql cleaning of the sales header, codes 1..6).
ORDER_STATUS_NAMES = {1: "In Process", 2: "Approved", 3: "Backordered",
                      4: "Rejected", 5: "Shipped", 6: "Cancelled"}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders",
          "lineitem", "events", "documents", "embeddings", "pages",
          "benchmark", "labels", "conversations")


# Lines that one task of a join on the order key holds: a fixed amount, so that
# a task's sorts and hash maps do not grow with the tables.
ROWS_PER_TASK = 500_000

_SCHEMAS: dict[tuple[str, str], object] = {}
_ROWS: dict[tuple[str, str], int] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one driver table.  The schema inferred on the first read of a
    path is reused for later reads in the same application, so repeated
    plans skip the footer-inference job."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    key = (spark.sparkContext.applicationId, path)
    schema = _SCHEMAS.get(key)
    if schema is None:
        df = spark.read.parquet(path)
        _SCHEMAS[key] = df.schema
        return df
    return spark.read.schema(schema).parquet(path)


def line_tasks(spark: SparkSession, sf_dir: str) -> int | None:
    """Partitions that hold about ROWS_PER_TASK lines each, or None where the
    session's own parallelism already gives as many.  The rows are counted from
    the file footers, once a path and application (an older count only changes
    how evenly the work is cut)."""
    key = (spark.sparkContext.applicationId, f"{sf_dir.rstrip('/')}/lineitem.parquet")
    if key not in _ROWS:
        _ROWS[key] = read_table(spark, sf_dir, "lineitem").count()
    n = -(-_ROWS[key] // ROWS_PER_TASK)
    return n if n > spark.sparkContext.defaultParallelism else None


def dealt(df: DataFrame, n: int | None, *keys: str) -> DataFrame:
    """``df`` hashed by ``keys`` into n partitions (None: as Spark plans it)."""
    return df.repartition(n, *keys) if n else df


def _pick(key: Column, values: list) -> Column:
    """``values[key]`` for a small fixed list, as a CASE ladder (codegen)."""
    out = None
    for i, v in enumerate(values):
        lit = F.lit(v)
        out = F.when(key == i, lit) if out is None else out.when(key == i, lit)
    return out


def _cents(x: Column) -> Column:
    return F.round(x * 100).cast("bigint")


def _dec_from_units(units: Column, scale: int, out: str) -> Column:
    """Exact decimal ``units / 10**scale`` (integer units, no division)."""
    step = F.lit(Decimal(1).scaleb(-scale)).cast(f"decimal({scale + 1},{scale})")
    return (units.cast("decimal(18,0)") * step).cast(out)


# ---------------------------------------------------------------- customer
def customer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(c_custkey, c_name, c_nationkey, n_name, r_name): what the customer columns derive from."""
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    # nation/region are fixed-size TPC-H dimensions (25 and 5 rows)
    n = F.broadcast(read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"))
    r = F.broadcast(read_table(spark, sf_dir, "region").select("r_regionkey", "r_name"))
    return (c.join(n, c.c_nationkey == n.n_nationkey, "left")
             .join(r, F.col("n_regionkey") == r.r_regionkey, "left")
             .select("c_custkey", "c_name", "c_nationkey", "n_name", "r_name"))


def customer_columns() -> dict[str, Column]:
    ctype = _pick(F.col("c_custkey") % 3, CUSTOMER_TYPE_BY_KEY_MOD3)
    full = F.when(F.col("c_custkey") % PERSON_NULL_MODULUS != 0, F.col("c_name"))
    return {
        "CustomerID": F.col("c_custkey"),
        "AccountNumber": F.concat(F.lit("AW"), F.lpad(F.col("c_custkey").cast("string"), 8, "0")),
        "CustomerType": ctype,
        "StoreName": F.when(ctype == "B2B (Store)", F.col("c_name")).otherwise(F.lit("Individual Customer")),
        "TerritoryName": F.col("n_name"),
        "TerritoryRegion": F.col("r_name"),
        "CountryRegionCode": _pick(F.col("c_nationkey") % 6, COUNTRY_BY_NATION_MOD6),
        "PersonFullName": full,
        "PersonCleanEmail": F.when(full.isNotNull(), F.lower(F.concat(F.col("c_name"), F.lit(EMAIL_DOMAIN)))),
    }


def customer_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer with the profile (B16) and person (B1) columns.

    Columns: CustomerID, AccountNumber, CustomerType, StoreName, TerritoryName,
    TerritoryRegion, CountryRegionCode, PersonFullName, PersonCleanEmail.
    """
    return customer_rows(spark, sf_dir).select(*[v.alias(k) for k, v in customer_columns().items()])


def customer_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``Sales.vCleanCustomerProfile`` shape (B16) from the driver tables."""
    return customer_side(spark, sf_dir).select(
        "CustomerID", "AccountNumber", "CustomerType", "StoreName",
        "TerritoryName", "TerritoryRegion", "CountryRegionCode")


def person(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``Person.vCleanPerson`` columns the golden record reads (B1 subset)."""
    return customer_side(spark, sf_dir).select(
        F.col("CustomerID").alias("BusinessEntityID"),
        F.col("PersonFullName").alias("FullName"),
        F.col("PersonCleanEmail").alias("CleanEmail"))


# ---------------------------------------------------------------- product
def product_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of ``part`` that the product columns derive from."""
    return read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")


def product_columns(as_of=AS_OF) -> dict[str, Column]:
    cost_c = F.call_function("div", _cents(F.col("p_retailprice")), F.col("p_size").cast("bigint"))
    std_cost = _dec_from_units(cost_c, 2, "decimal(19,4)")
    list_price = _dec_from_units(_cents(F.col("p_retailprice")), 2, "decimal(19,4)")
    sell_end = _pick(F.col("p_partkey") % 4, SELL_END_BY_KEY_MOD4).cast("date")
    status = (F.when(sell_end.isNull(), F.lit("Active"))
               .when(sell_end <= lit_date(as_of), F.lit("Discontinued"))
               .otherwise(F.lit("Active")))
    color = F.split(F.col("p_name"), " ").getItem(0)
    return {
        "ProductID": F.col("p_partkey"),
        "ProductName": F.col("p_name"),
        "ProductNumber": F.concat(F.lit("PN-"), F.col("p_partkey").cast("string")),
        "CategoryName": F.col("p_type"),
        "SubcategoryName": F.col("p_brand"),
        "ModelName": F.lit(None).cast("string"),
        "Color": F.coalesce(color, F.lit("No Color")),
        "Size": F.col("p_size").cast("string"),
        "StandardCost": std_cost,
        "ListPrice": list_price,
        "ProfitMargin": (list_price - std_cost).cast("decimal(19,4)"),
        "SellStartDate": lit_date(SELL_START),
        "SellEndDate": F.coalesce(sell_end, lit_date("9999-12-31")),
        "ProductStatus": status,
        "_p_size": F.col("p_size"),
    }


def product_master(spark: SparkSession, sf_dir: str, as_of=AS_OF) -> DataFrame:
    """``Production.vCleanProductMaster`` shape (B8) plus ``p_size``."""
    return product_rows(spark, sf_dir).select(*[v.alias(k) for k, v in product_columns(as_of).items()])


# ---------------------------------------------------------------- sales
def order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of ``orders`` that the header columns derive from."""
    return read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", F.col("o_orderdate").cast("date").alias("o_orderdate"),
        F.col("o_orderpriority").isin(*ONLINE_PRIORITIES).alias("o_online"), "o_totalprice")


def order_columns() -> dict[str, Column]:
    code = (F.when(F.col("o_orderstatus") == "F", F.lit(STATUS_BY_ORDERSTATUS["F"]))
             .when(F.col("o_orderstatus") == "O", F.lit(STATUS_BY_ORDERSTATUS["O"]))
             .otherwise(_pick(F.col("o_orderkey") % 4, STATUS_P_BY_KEY_MOD4)))
    status = None
    for k, v in ORDER_STATUS_NAMES.items():
        status = F.when(code == k, F.lit(v)) if status is None else status.when(code == k, F.lit(v))
    return {
        "SalesOrderID": F.col("o_orderkey"),
        "SalesOrderNumber": F.concat(F.lit("SO"), F.col("o_orderkey").cast("string")),
        "CustomerID": F.col("o_custkey"),
        "OrderDate": F.col("o_orderdate"),
        "OrderStatus": status,
        "IsOnlineOrder": F.col("o_online"),
        "TotalDue": _dec_from_units(_cents(F.col("o_totalprice")), 2, "decimal(19,4)"),
        "CurrencyCode": _pick(F.col("o_orderkey") % 11, CURRENCY_BY_KEY_MOD11),
    }


def order_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header-level sales columns (one row per order)."""
    return order_rows(spark, sf_dir).select(*[v.alias(k) for k, v in order_columns().items()])


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate")
    return li.select(
        F.col("l_orderkey").alias("_line_order"),
        F.col("l_partkey").alias("ProductID"),
        F.col("l_quantity").cast("int").alias("OrderQty"),
        F.when(F.col("l_orderkey") % SHIPDATE_NULL_MODULUS != 0,
               F.col("l_shipdate").cast("date")).alias("ShipDate"),
        _cents(F.col("l_extendedprice")).alias("_ext_cents"),
        (_cents(F.col("l_discount")) * 4).alias("_disc_pct"),
    )


def price_columns(qty: Column, ext_cents: Column, disc_pct: Column, p_size: Column) -> dict[str, Column]:
    """UnitPrice, UnitPriceDiscount and LineTotal from integer units."""
    unit_c = F.call_function("div", ext_cents, qty.cast("bigint") * p_size.cast("bigint"))
    line_units = unit_c * qty.cast("bigint") * (F.lit(100) - disc_pct)   # 1e-4 units
    return {
        "UnitPrice": _dec_from_units(unit_c, 2, "decimal(19,4)"),
        "UnitPriceDiscount": _dec_from_units(disc_pct, 2, "decimal(19,4)"),
        "LineTotal": _dec_from_units(line_units, 4, "decimal(38,6)"),
    }


def sales_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``Sales.vCleanSalesPerformance`` shape (B15) from the driver tables."""
    h = order_header(spark, sf_dir)
    d = order_lines(spark, sf_dir)
    p = product_master(spark, sf_dir).select(F.col("ProductID").alias("_pid"), "_p_size")
    j = (d.hint("merge").join(h, d._line_order == h.SalesOrderID, "inner")
          .join(p, F.col("ProductID") == F.col("_pid"), "left"))
    px = price_columns(F.col("OrderQty"), F.col("_ext_cents"), F.col("_disc_pct"), F.col("_p_size"))
    return j.select(
        "SalesOrderID", "SalesOrderNumber", "CustomerID", "OrderDate", "ShipDate", "OrderStatus",
        "IsOnlineOrder", "ProductID", "OrderQty",
        px["UnitPrice"].alias("UnitPrice"), px["UnitPriceDiscount"].alias("UnitPriceDiscount"),
        px["LineTotal"].alias("LineTotal"),
        F.lit(None).cast("decimal(19,4)").alias("SubTotal"),
        F.lit(None).cast("decimal(19,4)").alias("TaxAmt"),
        F.lit(None).cast("decimal(19,4)").alias("Freight"),
        "TotalDue",
        F.lit(None).cast("int").alias("TerritoryID"),
        "CurrencyCode",
    )


# ------------------------------------------------------------ raw AW tables
def aw_sources(spark: SparkSession, sf_dir: str):
    """The driver tables re-shaped as the raw operational tables the cleaning
    datasets read, so B1-B18 run unchanged on driver data: the product and
    customer families here, all others in ``raw_tables``.

    Dimension tables derived from ``part`` (subcategory = type × brand,
    category = type) are DISTINCT projections: their size is bounded by the
    number of types and brands, not by the number of parts.
    """
    from functools import cache

    from .catalog import Sources
    from .raw_tables import raw_tables

    @cache
    def read(name: str) -> DataFrame:
        return read_table(spark, sf_dir, name)

    cat_id = F.xxhash64(F.col("p_type"))
    sub_id = F.xxhash64(F.col("p_type"), F.col("p_brand"))
    sell_end = _pick(F.col("p_partkey") % 4, SELL_END_BY_KEY_MOD4).cast("timestamp")
    kind = F.col("c_custkey") % 3

    def product() -> DataFrame:
        return read("part").select(
            F.col("p_partkey").alias("ProductID"), F.col("p_name").alias("Name"),
            F.concat(F.lit("PN-"), F.col("p_partkey").cast("string")).alias("ProductNumber"),
            F.split(F.col("p_name"), " ").getItem(0).alias("Color"),
            F.col("p_size").cast("string").alias("Size"),
            _dec_from_units(F.call_function("div", _cents(F.col("p_retailprice")), F.col("p_size").cast("bigint")),
                            2, "decimal(19,4)").alias("StandardCost"),
            _dec_from_units(_cents(F.col("p_retailprice")), 2, "decimal(19,4)").alias("ListPrice"),
            lit_date(SELL_START).cast("timestamp").alias("SellStartDate"),
            sell_end.alias("SellEndDate"),
            sub_id.alias("ProductSubcategoryID"),
            F.lit(None).cast("bigint").alias("ProductModelID"),
            (F.col("p_size") * 10).alias("SafetyStockLevel"))

    def subcategory() -> DataFrame:
        return read("part").select(sub_id.alias("ProductSubcategoryID"), F.col("p_brand").alias("Name"),
                                   cat_id.alias("ProductCategoryID")).distinct()

    def category() -> DataFrame:
        return read("part").select(cat_id.alias("ProductCategoryID"), F.col("p_type").alias("Name")).distinct()

    def customer() -> DataFrame:
        return read("customer").select(
            F.col("c_custkey").alias("CustomerID"),
            F.when(kind == 0, F.col("c_custkey")).alias("StoreID"),
            F.when(kind == 1, F.col("c_custkey")).alias("PersonID"),
            F.col("c_nationkey").alias("TerritoryID"),
            F.concat(F.lit("AW"), F.lpad(F.col("c_custkey").cast("string"), 8, "0")).alias("AccountNumber"))

    def store() -> DataFrame:
        return read("customer").where(kind == 0).select(F.col("c_custkey").alias("BusinessEntityID"), F.col("c_name").alias("Name"))

    def territory() -> DataFrame:
        n, r = F.broadcast(read("nation")), F.broadcast(read("region"))  # 25 and 5 rows at every scale
        return n.join(r, n.n_regionkey == r.r_regionkey, "left").select(
            F.col("n_nationkey").alias("TerritoryID"), F.col("n_name").alias("Name"),
            F.col("r_name").alias("Group"),
            _pick(F.col("n_nationkey") % 6, COUNTRY_BY_NATION_MOD6).alias("CountryRegionCode"))

    # Built when they are asked for: a dataset reads a few of the 35 tables.
    return Sources(spark, {
        "Production.Product": product, "Production.ProductSubcategory": subcategory, "Production.ProductCategory": category,
        "Production.ProductModel": lambda: spark.createDataFrame([], "ProductModelID bigint, Name string"),
        "Sales.Customer": customer, "Sales.Store": store, "Sales.SalesTerritory": territory,
        **raw_tables(read)})
