"""B8-B11 — production cleaning views."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions import day_diff, lit_date
from ...sources.catalog import Sources

# Transaction type codes (no ELSE -> NULL), sentinel end date.
TRANSACTION_TYPES = {"W": "Work Order", "S": "Sales Order", "P": "Purchase Order"}
OPEN_END = _dt.date(9999, 12, 31)


def product_master(src: Sources, as_of: _dt.date) -> DataFrame:
    """B8 — product hierarchy, costs and lifecycle status.

    The status compares the *raw* SellEndDate (a timestamp) with ``as_of``.
    The subcategory / category / model tables are small dimensions; Spark
    broadcasts them by measured size.
    """
    p = src["Production.Product"].alias("p")
    psc = src["Production.ProductSubcategory"].alias("psc")
    pc = src["Production.ProductCategory"].alias("pc")
    pm = src["Production.ProductModel"].alias("pm")
    j = (p.join(psc, F.col("p.ProductSubcategoryID") == F.col("psc.ProductSubcategoryID"), "left")
          .join(pc, F.col("psc.ProductCategoryID") == F.col("pc.ProductCategoryID"), "left")
          .join(pm, F.col("p.ProductModelID") == F.col("pm.ProductModelID"), "left"))
    end_raw = F.col("p.SellEndDate")
    status = (F.when(end_raw.isNull(), F.lit("Active"))
               .when(end_raw.cast("timestamp") <= lit_date(as_of).cast("timestamp"), F.lit("Discontinued"))
               .otherwise(F.lit("Active")))
    return j.select(
        F.col("p.ProductID").alias("ProductID"), F.col("p.Name").alias("ProductName"),
        F.col("p.ProductNumber").alias("ProductNumber"), F.col("pc.Name").alias("CategoryName"),
        F.col("psc.Name").alias("SubcategoryName"), F.col("pm.Name").alias("ModelName"),
        F.coalesce(F.col("p.Color"), F.lit("No Color")).alias("Color"),
        F.coalesce(F.col("p.Size"), F.lit("N/A")).alias("Size"),
        F.col("p.StandardCost").alias("StandardCost"), F.col("p.ListPrice").alias("ListPrice"),
        (F.col("p.ListPrice") - F.col("p.StandardCost")).alias("ProfitMargin"),
        F.col("p.SellStartDate").cast("date").alias("SellStartDate"),
        F.coalesce(end_raw.cast("date"), lit_date(OPEN_END)).alias("SellEndDate"),
        status.alias("ProductStatus"),
    )


def inventory(src: Sources) -> DataFrame:
    """B9 — stock below the safety level is 'Low Stock' (NULL compares -> 'Safe')."""
    pi = src["Production.ProductInventory"].alias("pi")
    p = src["Production.Product"].alias("p")
    loc = src["Production.Location"].alias("l")
    j = (pi.join(p, F.col("pi.ProductID") == F.col("p.ProductID"))
           .join(loc, F.col("pi.LocationID") == F.col("l.LocationID")))
    return j.select(
        F.col("pi.ProductID").alias("ProductID"), F.col("p.Name").alias("ProductName"),
        F.col("l.Name").alias("LocationName"), F.col("pi.Shelf").alias("Shelf"),
        F.col("pi.Bin").alias("Bin"), F.col("pi.Quantity").alias("Quantity"),
        F.when(F.col("pi.Quantity") < F.col("p.SafetyStockLevel"), F.lit("Low Stock"))
         .otherwise(F.lit("Safe")).alias("StockStatus"))


def work_order(src: Sources) -> DataFrame:
    """B10."""
    wo = src["Production.WorkOrder"].alias("wo")
    p = src["Production.Product"].alias("p")
    sr = src["Production.ScrapReason"].alias("sr")
    j = (wo.join(p, F.col("wo.ProductID") == F.col("p.ProductID"))
           .join(sr, F.col("wo.ScrapReasonID") == F.col("sr.ScrapReasonID"), "left"))
    return j.select(
        F.col("wo.WorkOrderID").alias("WorkOrderID"), F.col("p.Name").alias("ProductName"),
        F.col("wo.OrderQty").alias("OrderQty"), F.col("wo.StockedQty").alias("StockedQty"),
        F.col("wo.ScrappedQty").alias("ScrappedQty"), F.col("sr.Name").alias("ScrapReasonName"),
        F.col("wo.StartDate").cast("date").alias("StartDate"),
        F.col("wo.EndDate").cast("date").alias("EndDate"),
        day_diff(F.col("wo.StartDate"), F.col("wo.EndDate")).alias("ProductionDays"))


def transaction_history(src: Sources) -> DataFrame:
    """B11."""
    t = src["Production.TransactionHistory"]
    code = F.col("TransactionType")
    desc = None
    for k, v in TRANSACTION_TYPES.items():
        desc = F.when(code == k, F.lit(v)) if desc is None else desc.when(code == k, F.lit(v))
    return t.select("TransactionID", "ProductID", "ReferenceOrderID", "TransactionDate",
                    desc.alias("TransactionTypeDesc"), "Quantity", "ActualCost")
