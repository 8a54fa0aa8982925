"""B15-B17 — sales cleaning views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...operators.stats import remember
from ...sources.catalog import Sources

# Sales order status codes (no ELSE -> NULL), customer types.
ORDER_STATUS = {1: "In Process", 2: "Approved", 3: "Backordered", 4: "Rejected", 5: "Shipped", 6: "Cancelled"}
B2B, B2C, UNKNOWN = "B2B (Store)", "B2C (Individual)", "Unknown"
NO_STORE = "Individual Customer"


def order_status(code) -> "F.Column":
    c = F.col(code) if isinstance(code, str) else code
    out = None
    for k, v in ORDER_STATUS.items():
        out = F.when(c == k, F.lit(v)) if out is None else out.when(c == k, F.lit(v))
    return out


def sales_performance(src: Sources) -> DataFrame:
    """B15 — header ⋈ detail (line grain) ⟕ currency rate; no status filter.

    Header and detail are both large and shuffled once on SalesOrderID; the
    currency-rate table is small (Spark broadcasts it by measured size).
    The view notes its two sides: a plan that joins further tables on a column
    of one side joins them there, before both sides meet.
    """
    h = src["Sales.SalesOrderHeader"].alias("h")
    d = src["Sales.SalesOrderDetail"].alias("d")
    cr = src["Sales.CurrencyRate"].alias("cr")
    headers = h.join(cr, F.col("h.CurrencyRateID") == F.col("cr.CurrencyRateID"), "left").select(
        F.col("h.SalesOrderID").alias("SalesOrderID"), F.col("h.SalesOrderNumber").alias("SalesOrderNumber"),
        F.col("h.CustomerID").alias("CustomerID"),
        F.col("h.OrderDate").cast("date").alias("OrderDate"),
        F.col("h.ShipDate").cast("date").alias("ShipDate"),
        order_status(F.col("h.Status")).alias("OrderStatus"),
        F.col("h.OnlineOrderFlag").cast("boolean").alias("IsOnlineOrder"),
        F.col("h.SubTotal").alias("SubTotal"), F.col("h.TaxAmt").alias("TaxAmt"),
        F.col("h.Freight").alias("Freight"), F.col("h.TotalDue").alias("TotalDue"),
        F.col("h.TerritoryID").alias("TerritoryID"), F.col("cr.ToCurrencyCode").alias("CurrencyCode"))
    lines = d.select(
        "d.SalesOrderID", F.col("d.ProductID").alias("ProductID"), F.col("d.OrderQty").alias("OrderQty"),
        F.col("d.UnitPrice").alias("UnitPrice"), F.col("d.UnitPriceDiscount").alias("UnitPriceDiscount"),
        F.col("d.LineTotal").alias("LineTotal"))
    view = headers.join(lines, "SalesOrderID").select(
        "SalesOrderID", "SalesOrderNumber", "CustomerID", "OrderDate", "ShipDate", "OrderStatus", "IsOnlineOrder",
        "ProductID", "OrderQty", "UnitPrice", "UnitPriceDiscount", "LineTotal", "SubTotal", "TaxAmt", "Freight",
        "TotalDue", "TerritoryID", "CurrencyCode")
    return remember(view, sides=(headers, lines))


def sales_person(src: Sources) -> DataFrame:
    """B17 — identical body to B15 in the reference (quotas are promised but
    not computed); kept as the same dataset."""
    return sales_performance(src)


def customer_profile(src: Sources) -> DataFrame:
    """B16 — StoreID first (B2B), then PersonID (B2C), else 'Unknown'."""
    c = src["Sales.Customer"].alias("c")
    s = src["Sales.Store"].alias("s")
    t = src["Sales.SalesTerritory"].alias("t")
    j = (c.join(s, F.col("c.StoreID") == F.col("s.BusinessEntityID"), "left")
          .join(t, F.col("c.TerritoryID") == F.col("t.TerritoryID"), "left"))
    ctype = (F.when(F.col("c.StoreID").isNotNull(), F.lit(B2B))
              .when(F.col("c.PersonID").isNotNull(), F.lit(B2C)).otherwise(F.lit(UNKNOWN)))
    return j.select(
        F.col("c.CustomerID").alias("CustomerID"), F.col("c.AccountNumber").alias("AccountNumber"),
        ctype.alias("CustomerType"),
        F.coalesce(F.col("s.Name"), F.lit(NO_STORE)).alias("StoreName"),
        F.col("t.Name").alias("TerritoryName"), F.col("t.Group").alias("TerritoryRegion"),
        F.col("t.CountryRegionCode").alias("CountryRegionCode"))
