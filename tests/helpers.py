"""Tiny golden-record fixtures (schema of FIXTURES.md §2)."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("CustomerID", T.LongType()), T.StructField("SalesOrderID", T.LongType()),
    T.StructField("SalesOrderNumber", T.StringType()), T.StructField("OrderDate", T.DateType()),
    T.StructField("OrderYear", T.IntegerType()), T.StructField("OrderMonth", T.IntegerType()),
    T.StructField("ShipDate", T.DateType()), T.StructField("DaysToShip", T.IntegerType()),
    T.StructField("OrderStatus", T.StringType()), T.StructField("IsOnlineOrder", T.BooleanType()),
    T.StructField("ProductName", T.StringType()), T.StructField("ProductNumber", T.StringType()),
    T.StructField("CategoryName", T.StringType()), T.StructField("SubcategoryName", T.StringType()),
    T.StructField("ProductColor", T.StringType()), T.StructField("ProductStatus", T.StringType()),
    T.StructField("CustomerType", T.StringType()), T.StructField("StoreName", T.StringType()),
    T.StructField("CustomerName", T.StringType()), T.StructField("CustomerEmail", T.StringType()),
    T.StructField("TerritoryName", T.StringType()), T.StructField("TerritoryRegion", T.StringType()),
    T.StructField("CountryRegionCode", T.StringType()), T.StructField("OrderQty", T.IntegerType()),
    T.StructField("UnitPrice", T.DecimalType(19, 4)), T.StructField("UnitPriceDiscount", T.DecimalType(19, 4)),
    T.StructField("GrossRevenue", T.DecimalType(38, 6)), T.StructField("EstimatedNetProfit", T.DecimalType(38, 6)),
    T.StructField("RawCurrencyCode", T.StringType()), T.StructField("CurrencyCode", T.StringType()),
    T.StructField("ExchangeRateToUSD", T.DecimalType(3, 2)), T.StructField("GrossRevenueUSD", T.DecimalType(38, 6)),
    T.StructField("EstimatedNetProfitUSD", T.DecimalType(38, 6)), T.StructField("CurrencyDataQualityFlag", T.StringType()),
])


def line(order, date, product="P1", customer="Cust A", revenue="100", profit="40", qty=1, price="100",
         discount="0", currency="USD", category="Cat", customer_id=1, status="Shipped", territory="T1"):
    d = date if isinstance(date, dt.date) else dt.date.fromisoformat(date)
    rev, prof = Decimal(revenue), Decimal(profit)
    return {
        "CustomerID": customer_id, "SalesOrderID": order, "SalesOrderNumber": f"SO{order}", "OrderDate": d,
        "OrderYear": d.year, "OrderMonth": d.month, "ShipDate": d + dt.timedelta(days=3), "DaysToShip": 3,
        "OrderStatus": status, "IsOnlineOrder": True, "ProductName": product, "ProductNumber": product,
        "CategoryName": category, "SubcategoryName": "Sub", "ProductColor": "Red", "ProductStatus": "Active",
        "CustomerType": "B2C (Individual)", "StoreName": "Individual Customer", "CustomerName": customer,
        "CustomerEmail": "x@y", "TerritoryName": territory, "TerritoryRegion": "R1", "CountryRegionCode": "US",
        "OrderQty": qty, "UnitPrice": Decimal(price), "UnitPriceDiscount": Decimal(discount), "GrossRevenue": rev,
        "EstimatedNetProfit": prof, "RawCurrencyCode": currency, "CurrencyCode": currency,
        "ExchangeRateToUSD": Decimal("1.00"), "GrossRevenueUSD": rev, "EstimatedNetProfitUSD": prof,
        "CurrencyDataQualityFlag": "OK",
    }


def golden_df(spark, rows):
    return spark.createDataFrame([tuple(r[f.name] for f in SCHEMA.fields) for r in rows], SCHEMA)
