"""B12-B14 — purchasing cleaning views."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions import lit_date
from ...sources.catalog import Sources

# Code maps of the purchasing script (no ELSE -> NULL).
CREDIT_RATING = {1: "Superior", 2: "Excellent", 3: "Above Average", 4: "Average", 5: "Below Average"}
PO_STATUS = {1: "Pending", 2: "Approved", 3: "Rejected", 4: "Complete"}
OPEN_END = _dt.date(9999, 12, 31)


def _map(c, mapping):
    out = None
    for k, v in mapping.items():
        out = F.when(c == k, F.lit(v)) if out is None else out.when(c == k, F.lit(v))
    return out


def vendor_master(src: Sources) -> DataFrame:
    """B12."""
    v = src["Purchasing.Vendor"]
    return v.select(
        F.col("BusinessEntityID").alias("VendorID"), "AccountNumber", F.col("Name").alias("VendorName"),
        _map(F.col("CreditRating"), CREDIT_RATING).alias("CreditRatingDesc"),
        F.when(F.col("PreferredVendorStatus").cast("int") == 1, F.lit("Preferred"))
         .otherwise(F.lit("Regular")).alias("VendorStatus"),
        F.when(F.col("ActiveFlag").cast("int") == 1, F.lit("Active")).otherwise(F.lit("Inactive")).alias("AccountStatus"),
        F.coalesce(F.col("PurchasingWebServiceURL"), F.lit("No URL")).alias("WebserviceURL"))


def purchase_orders(src: Sources) -> DataFrame:
    """B13 — line grain; header totals repeat on every line (do not sum them)."""
    h = src["Purchasing.PurchaseOrderHeader"].alias("h")
    d = src["Purchasing.PurchaseOrderDetail"].alias("d")
    v = src["Purchasing.Vendor"].alias("v")
    sm = src["Purchasing.ShipMethod"].alias("sm")
    j = (h.join(d, F.col("h.PurchaseOrderID") == F.col("d.PurchaseOrderID"))
          .join(v, F.col("h.VendorID") == F.col("v.BusinessEntityID"))
          .join(sm, F.col("h.ShipMethodID") == F.col("sm.ShipMethodID")))
    rec, rej = F.col("d.ReceivedQty"), F.col("d.RejectedQty")
    reject = F.when(rec == 0, F.lit(0)).otherwise(
        F.round(rej.cast("decimal(18,6)") / rec.cast("decimal(18,6)") * 100, 2))
    return j.select(
        F.col("h.PurchaseOrderID").alias("PurchaseOrderID"), F.col("h.VendorID").alias("VendorID"),
        F.col("v.Name").alias("VendorName"), F.col("h.OrderDate").cast("date").alias("OrderDate"),
        F.coalesce(F.col("h.ShipDate").cast("date"), lit_date(OPEN_END)).alias("ShipDate"),
        _map(F.col("h.Status"), PO_STATUS).alias("OrderStatus"),
        F.col("h.SubTotal").alias("SubTotal"), F.col("h.TaxAmt").alias("TaxAmt"),
        F.col("h.Freight").alias("Freight"), F.col("h.TotalDue").alias("TotalDue"),
        F.col("d.ProductID").alias("ProductID"), F.col("d.OrderQty").alias("OrderQty"),
        F.col("d.UnitPrice").alias("UnitPrice"), F.col("d.LineTotal").alias("LineTotal"),
        rec.alias("ReceivedQty"), rej.alias("RejectedQty"),
        reject.alias("RejectRatePercentage"), F.col("sm.Name").alias("ShippingMethod"))


def product_vendor(src: Sources) -> DataFrame:
    """B14."""
    pv = src["Purchasing.ProductVendor"].alias("pv")
    v = src["Purchasing.Vendor"].alias("v")
    j = pv.join(v, F.col("pv.BusinessEntityID") == F.col("v.BusinessEntityID"))
    return j.select(
        F.col("pv.ProductID").alias("ProductID"), F.col("v.Name").alias("VendorName"),
        F.col("pv.AverageLeadTime").alias("AverageLeadTime"), F.col("pv.StandardPrice").alias("StandardPrice"),
        F.col("pv.LastReceiptCost").alias("LastReceiptCost"),
        F.col("pv.LastReceiptDate").cast("date").alias("LastReceiptDate"),
        F.col("pv.MinOrderQty").alias("MinOrderQty"), F.col("pv.MaxOrderQty").alias("MaxOrderQty"),
        F.coalesce(F.col("pv.OnOrderQty"), F.lit(0)).alias("OnOrderQty"))
