"""Raw operational tables derived from the driver's tables.

Each table is a projection (or union, or grouping) of driver tables written
as SQL expressions that Spark and other SQL engines read alike, so a check in
another engine starts from the same rows.  The mapping is ours (synthetic): it
only has to reach the branches of the cleaning datasets.  Every row of a
driver table is used; nothing is filtered or sampled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cents(x: str) -> str:
    return f"CAST(ROUND({x} * 100) AS BIGINT)"


def whole(a: str, b: str) -> str:
    """Integer quotient of non-negative integers."""
    return f"CAST(({a} - {a} % {b}) / {b} AS BIGINT)"


def scaled(units: str, scale: int, kind: str) -> str:
    """Exact decimal of integer units of 10 ** -scale."""
    step = "0." + "0" * (scale - 1) + "1"
    return f"CAST(CAST({units} AS DECIMAL(18,0)) * CAST({step} AS DECIMAL({scale + 1},{scale})) AS {kind})"


MONEY, TOTAL = "DECIMAL(19,4)", "DECIMAL(38,6)"
_QTY = "CAST(l_quantity AS BIGINT)"
_UNIT = whole(cents("l_extendedprice"), _QTY)
_OFF = f"{cents('l_discount')} * 4"
_DUE = cents("o_totalprice")
_TAX, _FREIGHT = whole(_DUE, "10"), whole(_DUE, "50")
_SHIPPED = "CASE WHEN {key} % 17 <> 0 THEN {when} END"
_STAMP = "CAST('2001-01-01 00:00:00' AS TIMESTAMP)"
_LINE_ID = "l_orderkey * 10 + l_linenumber"
_HIRED = "DATE '1995-01-01' + CAST(c_custkey % 2500 AS INT)"

# name -> parts to union: (driver table, {column: expression}, grouped columns or None)
SPECS: dict[str, list[tuple[str, dict[str, str], list[str] | None]]] = {
    "Sales.SalesOrderHeader": [("orders", {
        "SalesOrderID": "o_orderkey", "SalesOrderNumber": "'SO' || o_orderkey", "CustomerID": "o_custkey",
        "TerritoryID": "CAST(o_custkey % 25 AS INT)",
        "CurrencyRateID": "CASE WHEN o_orderkey % 11 > 2 THEN CAST(o_orderkey % 11 AS INT) END",
        "Status": "CAST(o_orderkey % 7 + 1 AS INT)", "OrderDate": "o_orderdate",
        "ShipDate": _SHIPPED.format(key="o_orderkey", when="CAST(o_orderdate AS DATE) + CAST(o_orderkey % 9 AS INT)"),
        "OnlineOrderFlag": "o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM')",
        "SubTotal": scaled(f"({_DUE} - {_TAX} - {_FREIGHT})", 2, MONEY), "TaxAmt": scaled(_TAX, 2, MONEY),
        "Freight": scaled(_FREIGHT, 2, MONEY), "TotalDue": scaled(_DUE, 2, MONEY)}, None)],
    "Sales.SalesOrderDetail": [("lineitem", {
        "SalesOrderID": "l_orderkey", "ProductID": "l_partkey", "OrderQty": "CAST(l_quantity AS INT)",
        "UnitPrice": scaled(_UNIT, 2, MONEY), "UnitPriceDiscount": scaled(f"({_OFF})", 2, MONEY),
        "LineTotal": scaled(f"({_UNIT} * {_QTY} * (100 - {_OFF}))", 4, TOTAL)}, None)],
    "Sales.CurrencyRate": [("nation", {
        "CurrencyRateID": "CASE WHEN n_nationkey BETWEEN 3 AND 10 THEN n_nationkey ELSE n_nationkey + 100 END",
        "ToCurrencyCode": "CASE n_nationkey WHEN 3 THEN 'USD' WHEN 4 THEN 'CAD' WHEN 5 THEN 'GBP' WHEN 6 THEN 'FRF' "
                          "WHEN 7 THEN 'DEM' WHEN 8 THEN 'EUR' WHEN 9 THEN 'AUD' ELSE 'JPY' END"}, None)],
    "Production.Location": [("region", {"LocationID": "r_regionkey", "Name": "r_name"}, None)],
    "Production.ProductInventory": [("lineitem", {
        "ProductID": "l_partkey", "LocationID": "CAST(l_suppkey % 6 AS INT)",
        "Shelf": "CASE l_suppkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'N/A' END", "Bin": "CAST(l_suppkey % 10 AS INT)",
        "Quantity": "CAST(SUM(CAST(l_quantity AS BIGINT)) AS INT)"}, ["ProductID", "LocationID", "Shelf", "Bin"])],
    "Production.WorkOrder": [("lineitem", {
        "WorkOrderID": _LINE_ID, "ProductID": "l_partkey", "OrderQty": "CAST(l_quantity AS INT)",
        "StockedQty": f"CAST({_QTY} - CASE WHEN l_orderkey % 13 = 0 THEN {whole(_QTY, '10')} ELSE 0 END AS INT)",
        "ScrappedQty": f"CAST(CASE WHEN l_orderkey % 13 = 0 THEN {whole(_QTY, '10')} ELSE 0 END AS INT)",
        "ScrapReasonID": "CASE WHEN l_orderkey % 13 = 0 THEN l_linenumber * 4 END", "StartDate": "l_shipdate",
        "EndDate": _SHIPPED.format(key="l_orderkey", when="CAST(l_shipdate AS DATE) + CAST(l_quantity AS INT)")}, None)],
    "Production.ScrapReason": [("nation", {"ScrapReasonID": "n_nationkey", "Name": "n_name"}, None)],
    "Production.TransactionHistory": [("lineitem", {
        "TransactionID": _LINE_ID, "ProductID": "l_partkey", "ReferenceOrderID": "l_orderkey", "TransactionDate": "l_shipdate",
        "TransactionType": "CASE WHEN l_linenumber = 7 THEN 'X' WHEN l_returnflag = 'A' THEN 'W' "
                           "WHEN l_returnflag = 'N' THEN 'S' ELSE 'P' END",
        "Quantity": "CAST(l_quantity AS INT)", "ActualCost": scaled(cents("l_extendedprice"), 2, MONEY)}, None)],
    "Purchasing.Vendor": [("supplier", {
        "BusinessEntityID": "s_suppkey", "AccountNumber": "'V' || s_suppkey", "Name": "s_name",
        "CreditRating": "CAST(s_suppkey % 6 + 1 AS INT)", "PreferredVendorStatus": "s_acctbal > 0",
        "ActiveFlag": "s_suppkey % 7 <> 0",
        "PurchasingWebServiceURL": "CASE WHEN s_suppkey % 2 = 1 THEN 'http://x.test/' || s_suppkey END"}, None)],
    "Purchasing.ShipMethod": [("region", {"ShipMethodID": "r_regionkey", "Name": "r_name"}, None)],
    "Purchasing.PurchaseOrderHeader": [("orders", {
        "PurchaseOrderID": "o_orderkey", "VendorID": "o_custkey % 120", "ShipMethodID": "CAST(o_orderkey % 6 AS INT)",
        "Status": "CAST(o_orderkey % 5 + 1 AS INT)", "OrderDate": "o_orderdate",
        "ShipDate": _SHIPPED.format(key="o_orderkey", when="o_orderdate"),
        "SubTotal": scaled(f"({_DUE} - {_TAX} - {_FREIGHT})", 2, MONEY), "TaxAmt": scaled(_TAX, 2, MONEY),
        "Freight": scaled(_FREIGHT, 2, MONEY), "TotalDue": scaled(_DUE, 2, MONEY)}, None)],
    "Purchasing.PurchaseOrderDetail": [("lineitem", {
        "PurchaseOrderID": "l_orderkey", "ProductID": "l_partkey", "OrderQty": "CAST(l_quantity AS INT)",
        "UnitPrice": scaled(_UNIT, 2, MONEY), "LineTotal": scaled(cents("l_extendedprice"), 2, MONEY),
        "ReceivedQty": "CASE WHEN l_orderkey % 19 = 0 THEN CAST(0 AS DECIMAL(8,2)) "
                       "WHEN l_orderkey % 23 <> 0 THEN CAST(l_quantity AS DECIMAL(8,2)) END",
        "RejectedQty": f"CAST(CASE WHEN l_linenumber % 3 = 0 THEN {whole(_QTY, '3')} ELSE 0 END AS DECIMAL(8,2))"}, None)],
    "Purchasing.ProductVendor": [("lineitem", {
        "ProductID": "l_partkey", "BusinessEntityID": "l_suppkey", "AverageLeadTime": "CAST(l_suppkey % 30 + 1 AS INT)",
        "StandardPrice": f"MIN({scaled(_UNIT, 2, MONEY)})", "LastReceiptCost": f"MAX({scaled(_UNIT, 2, MONEY)})",
        "LastReceiptDate": "MAX(l_shipdate)", "MinOrderQty": "CAST(MIN(l_quantity) AS INT)",
        "MaxOrderQty": "CAST(MAX(l_quantity) AS INT)",
        "OnOrderQty": "CASE WHEN COUNT(*) > 1 THEN CAST(COUNT(*) AS INT) END"},
        ["ProductID", "BusinessEntityID", "AverageLeadTime"])],
    "Person.Person": [("customer", {
        "BusinessEntityID": "c_custkey", "PersonType": "CASE c_custkey % 3 WHEN 0 THEN 'SC' WHEN 1 THEN 'IN' ELSE 'EM' END",
        "Title": "CASE WHEN c_custkey % 3 = 1 THEN 'Ms.' END", "FirstName": "c_name",
        "MiddleName": "CASE WHEN c_custkey % 2 = 1 THEN 'M' END", "LastName": "c_mktsegment",
        "Suffix": "CASE WHEN c_custkey % 8 = 1 THEN 'Jr.' END", "EmailPromotion": "CAST(c_custkey % 4 AS INT)",
        "ModifiedDate": _STAMP}, None)],
    "Person.EmailAddress": [("customer", {
        "BusinessEntityID": "c_custkey",
        "EmailAddress": "CASE WHEN c_custkey % 6 <> 0 THEN '  ' || c_name || '@X.Test ' END"}, None)],
    # Keys below the number of suppliers have a second telephone and address.
    "Person.PersonPhone": [
        ("customer", {"BusinessEntityID": "c_custkey", "PhoneNumber": "'555-' || c_custkey",
                      "PhoneNumberTypeID": "CAST(c_custkey % 6 AS INT)"}, None),
        ("supplier", {"BusinessEntityID": "s_suppkey", "PhoneNumber": "'556-' || s_suppkey",
                      "PhoneNumberTypeID": "CAST(s_suppkey % 6 AS INT)"}, None)],
    "Person.PhoneNumberType": [("region", {"PhoneNumberTypeID": "r_regionkey", "Name": "r_name"}, None)],
    "Person.BusinessEntityAddress": [
        ("customer", {"BusinessEntityID": "c_custkey + 3", "AddressID": "c_custkey * 2",
                      "AddressTypeID": "CAST(c_custkey % 6 AS INT)"}, None),
        ("supplier", {"BusinessEntityID": "s_suppkey * 2", "AddressID": "s_suppkey * 2 + 1",
                      "AddressTypeID": "CAST(s_suppkey % 6 AS INT)"}, None)],
    "Person.Address": [
        ("customer", {"AddressID": "c_custkey * 2", "AddressLine1": "' ' || c_mktsegment || ' 1 '",
                      "AddressLine2": "CASE c_custkey % 3 WHEN 1 THEN ' ' WHEN 2 THEN ' Apt ' END", "City": "c_mktsegment",
                      "PostalCode": "lpad('' || c_custkey, 5, '0')", "StateProvinceID": "c_nationkey"}, None),
        ("supplier", {"AddressID": "s_suppkey * 2 + 1", "AddressLine1": "s_name", "AddressLine2": "'Dock'",
                      "City": "'Harbour'", "PostalCode": "lpad('' || s_suppkey, 5, '9')",
                      "StateProvinceID": "s_nationkey"}, None)],
    "Person.AddressType": [("region", {"AddressTypeID": "r_regionkey", "Name": "r_name"}, None)],
    "Person.StateProvince": [("nation", {"StateProvinceID": "n_nationkey", "Name": "n_name",
                                         "CountryRegionCode": "'R' || n_regionkey"}, None)],
    "Person.CountryRegion": [("region", {"CountryRegionCode": "'R' || r_regionkey", "Name": "r_name"}, None)],
    "HumanResources.Department": [("nation", {
        "departmentID": "n_nationkey", "Name": "'  ' || n_name || ' '", "groupName": "' Group ' || n_regionkey || '  '",
        "ModifiedDate": _STAMP}, None)],
    "HumanResources.Employee": [("customer", {
        "BusinessEntityID": "c_custkey", "NationalIDNumber": "lpad('' || c_custkey, 9, '0')", "JobTitle": "c_mktsegment",
        # December 31st and January 1st come up: ages count year borders.
        "BirthDate": "DATE '1960-12-31' + CAST(c_custkey % 9000 AS INT)", "HireDate": _HIRED,
        "MaritalStatus": "CASE c_custkey % 4 WHEN 0 THEN 'M' WHEN 1 THEN 'S' WHEN 2 THEN 'X' END",
        "Gender": "CASE c_custkey % 3 WHEN 0 THEN 'M' WHEN 1 THEN 'F' END",
        "SalariedFlag": "CASE WHEN c_custkey % 11 <> 0 THEN c_acctbal > 0 END", "CurrentFlag": "c_custkey % 5 <> 0"}, None)],
    "HumanResources.EmployeeDepartmentHistory": [("customer", {
        "BusinessEntityID": "c_custkey", "DepartmentID": "c_nationkey", "ShiftID": "CAST(c_custkey % 3 + 1 AS INT)",
        "StartDate": _HIRED,
        "EndDate": f"CASE WHEN c_custkey % 2 = 1 THEN {_HIRED} + CAST(c_custkey % 700 AS INT) END"}, None)],
    "HumanResources.EmployeePayHistory": [("orders", {
        "BusinessEntityID": "o_custkey", "RateChangeDate": "o_orderdate",
        "Rate": scaled(f"({_DUE} % 1000000)", 4, MONEY), "PayFrequency": "CAST(o_orderkey % 3 AS INT)"}, None)],
    "HumanResources.JobCandidate": [("supplier", {
        "JobCandidateID": "s_suppkey", "BusinessEntityID": "CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey END",
        "Resume": "CASE WHEN s_acctbal > 0 THEN s_name END", "ModifiedDate": _STAMP}, None)],
    # Shifts of eight hours, one of them over midnight.
    "HumanResources.Shift": [("region", {
        "ShiftID": "r_regionkey", "Name": "r_name",
        "StartTime": "CAST('1900-01-01 ' || lpad('' || (7 + 8 * r_regionkey) % 24, 2, '0') || ':00:00' AS TIMESTAMP)",
        "EndTime": "CAST('1900-01-01 ' || lpad('' || (15 + 8 * r_regionkey) % 24, 2, '0') || ':30:00' AS TIMESTAMP)"}, None)],
}


def raw_table(read, name: str) -> DataFrame:
    """The raw table over ``read(driver table) -> DataFrame``."""
    out = None
    for table, columns, keys in SPECS[name]:
        df = read(table)
        if keys:
            part = (df.groupBy(*[F.expr(columns[k]).alias(k) for k in keys])
                    .agg(*[F.expr(e).alias(c) for c, e in columns.items() if c not in keys]).select(*columns))
        else:
            part = df.select(*[F.expr(e).alias(c) for c, e in columns.items()])
        out = part if out is None else out.unionByName(part)
    return out


def raw_sql(name: str) -> str:
    """The same table as a SELECT over the driver's tables."""
    def one(table, columns, keys):
        group = f" GROUP BY {', '.join(str(list(columns).index(k) + 1) for k in keys)}" if keys else ""
        return f"SELECT {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM {table}{group}"
    return " UNION ALL ".join(one(*part) for part in SPECS[name])


def raw_tables(read) -> dict[str, Callable[[], DataFrame]]:
    """Every table, built when it is called for."""
    return {name: (lambda name=name: raw_table(read, name)) for name in SPECS}
