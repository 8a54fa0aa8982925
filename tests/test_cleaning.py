"""Cleaning datasets B1-B17 on tiny hand-made fixtures (FIXTURES.md §1)."""

import datetime as dt
from decimal import Decimal

import pytest

from ledgerframe.plans.cleaning import hr, person, production, purchasing, sales
from ledgerframe.sources.catalog import Sources

AS_OF = dt.date(2024, 1, 1)
TS = dt.datetime


@pytest.fixture(scope="module")
def src(spark):
    c = spark.createDataFrame
    t = {
        "Person.Person": c([
            (1, "IN", None, "Ann", None, "Lee", None, 0, TS(2020, 1, 1)),
            (2, "EM", "Mr.", "Bo", "X", "Ng", "Jr.", 3, TS(2020, 1, 1)),
            (3, "IN", None, "Cy", None, "Oz", None, 2, TS(2020, 1, 1))],
            "BusinessEntityID int, PersonType string, Title string, FirstName string, MiddleName string, "
            "LastName string, Suffix string, EmailPromotion int, ModifiedDate timestamp"),
        "Person.EmailAddress": c([(1, "  Ann@X.COM "), (3, "cy@x.com")], "BusinessEntityID int, EmailAddress string"),
        "Person.PersonPhone": c([(1, "111", 1), (1, "222", 2)], "BusinessEntityID int, PhoneNumber string, PhoneNumberTypeID int"),
        "Person.PhoneNumberType": c([(1, "Cell"), (2, "Home")], "PhoneNumberTypeID int, Name string"),
        "Person.BusinessEntityAddress": c([(1, 10, 1), (1, 11, 2), (3, 12, 1)],
                                          "BusinessEntityID int, AddressID int, AddressTypeID int"),
        "Person.Address": c([(10, " 1 Main ", None, "Town", "111", 5), (11, "2 Side", "", "Town", "111", 5),
                             (12, "3 Rd", " Apt 4 ", "City", "222", 5)],
                            "AddressID int, AddressLine1 string, AddressLine2 string, City string, "
                            "PostalCode string, StateProvinceID int"),
        "Person.AddressType": c([(1, "Home"), (2, "Billing")], "AddressTypeID int, Name string"),
        "Person.StateProvince": c([(5, "Ohio", "US")], "StateProvinceID int, Name string, CountryRegionCode string"),
        "Person.CountryRegion": c([("US", "United States")], "CountryRegionCode string, Name string"),
        "HumanResources.Department": c([(1, " Sales ", " Ops ", TS(2020, 1, 1))],
                                       "departmentID int, Name string, groupName string, ModifiedDate timestamp"),
        "HumanResources.Employee": c([
            (1, "N1", "Rep", dt.date(1990, 12, 31), dt.date(2023, 12, 31), "M", "F", True, True),
            (2, "N2", "Mgr", dt.date(1980, 1, 1), dt.date(2010, 6, 1), "X", "M", False, None)],
            "BusinessEntityID int, NationalIDNumber string, JobTitle string, BirthDate date, HireDate date, "
            "MaritalStatus string, Gender string, SalariedFlag boolean, CurrentFlag boolean"),
        "HumanResources.EmployeeDepartmentHistory": c([
            (1, 1, 1, dt.date(2023, 11, 30), None), (2, 1, 2, dt.date(2020, 1, 15), dt.date(2021, 3, 1))],
            "BusinessEntityID int, DepartmentID int, ShiftID int, StartDate date, EndDate date"),
        "HumanResources.EmployeePayHistory": c([(1, TS(2020, 1, 1), Decimal("12.3456"), 2),
                                                (2, TS(2021, 1, 1), Decimal("40.0000"), 3)],
                                               "BusinessEntityID int, RateChangeDate timestamp, Rate decimal(19,4), "
                                               "PayFrequency int"),
        "HumanResources.JobCandidate": c([(1, None, "<xml/>", TS(2020, 1, 1)), (2, 5, None, TS(2020, 1, 1))],
                                         "JobCandidateID int, BusinessEntityID int, Resume string, ModifiedDate timestamp"),
        "HumanResources.Shift": c([(1, "Night", "23:00:00", "07:00:00"), (2, "Day", "07:00:00", "15:00:00")],
                                  "ShiftID int, Name string, StartTime string, EndTime string"),
        "Production.Product": c([
            (1, "Bike", "BK-1", "Red", "58", Decimal("100.0000"), Decimal("150.0000"), TS(2020, 1, 1), None, 10, 1, 5),
            (2, "Helmet", "HL-1", None, None, Decimal("10.0000"), Decimal("30.0000"), TS(2020, 1, 1),
             TS(2023, 6, 1), 20, None, 5),
            (3, "Glove", "GL-1", "Black", "M", Decimal("5.0000"), Decimal("9.0000"), TS(2020, 1, 1),
             TS(2030, 1, 1), None, None, 5),
            (4, "Sock", "SK-1", "White", "S", Decimal("1.0000"), Decimal("2.0000"), TS(2020, 1, 1),
             TS(2024, 1, 1), None, None, 5)],
            "ProductID int, Name string, ProductNumber string, Color string, Size string, StandardCost decimal(19,4), "
            "ListPrice decimal(19,4), SellStartDate timestamp, SellEndDate timestamp, ProductSubcategoryID int, "
            "ProductModelID int, SafetyStockLevel int"),
        "Production.ProductSubcategory": c([(10, "Road", 100), (20, "Helmets", 200)],
                                           "ProductSubcategoryID int, Name string, ProductCategoryID int"),
        "Production.ProductCategory": c([(100, "Bikes"), (200, "Accessories")], "ProductCategoryID int, Name string"),
        "Production.ProductModel": c([(1, "Road-150")], "ProductModelID int, Name string"),
        "Production.ProductInventory": c([(1, 1, "A", 1, 5), (2, 1, "B", 2, 4)],
                                         "ProductID int, LocationID int, Shelf string, Bin int, Quantity int"),
        "Production.Location": c([(1, "Main")], "LocationID int, Name string"),
        "Production.WorkOrder": c([(1, 1, 10, 9, 1, 3, TS(2020, 1, 1, 8), TS(2020, 1, 3, 1)),
                                   (2, 2, 5, 5, 0, None, TS(2020, 2, 1), TS(2020, 2, 1))],
                                  "WorkOrderID int, ProductID int, OrderQty int, StockedQty int, ScrappedQty int, "
                                  "ScrapReasonID int, StartDate timestamp, EndDate timestamp"),
        "Production.ScrapReason": c([(3, "Paint")], "ScrapReasonID int, Name string"),
        "Production.TransactionHistory": c([(1, 1, 9, TS(2020, 1, 1), "W", 1, Decimal("1.0")),
                                            (2, 1, 9, TS(2020, 1, 1), "Z", 1, Decimal("1.0"))],
                                           "TransactionID int, ProductID int, ReferenceOrderID int, "
                                           "TransactionDate timestamp, TransactionType string, Quantity int, "
                                           "ActualCost decimal(19,4)"),
        "Purchasing.Vendor": c([(1, "V1", "Acme", 5, True, True, None), (2, "V2", "Beta", 9, False, False, "http://b")],
                               "BusinessEntityID int, AccountNumber string, Name string, CreditRating int, "
                               "PreferredVendorStatus boolean, ActiveFlag boolean, PurchasingWebServiceURL string"),
        "Purchasing.PurchaseOrderHeader": c([(1, 1, 1, 4, TS(2020, 1, 1), None, Decimal("1"), Decimal("1"),
                                              Decimal("1"), Decimal("3"))],
                                            "PurchaseOrderID int, VendorID int, ShipMethodID int, Status int, "
                                            "OrderDate timestamp, ShipDate timestamp, SubTotal decimal(19,4), "
                                            "TaxAmt decimal(19,4), Freight decimal(19,4), TotalDue decimal(19,4)"),
        "Purchasing.PurchaseOrderDetail": c([
            (1, 1, 3, Decimal("1"), Decimal("3"), Decimal("0"), Decimal("0")),
            (1, 2, 3, Decimal("1"), Decimal("3"), None, Decimal("1")),
            (1, 3, 3, Decimal("1"), Decimal("3"), Decimal("3"), Decimal("1"))],
            "PurchaseOrderID int, ProductID int, OrderQty int, UnitPrice decimal(19,4), LineTotal decimal(19,4), "
            "ReceivedQty decimal(8,2), RejectedQty decimal(8,2)"),
        "Purchasing.ShipMethod": c([(1, "Truck")], "ShipMethodID int, Name string"),
        "Purchasing.ProductVendor": c([(1, 1, 10, Decimal("5"), Decimal("5"), TS(2020, 1, 1), 1, 10, None)],
                                      "ProductID int, BusinessEntityID int, AverageLeadTime int, "
                                      "StandardPrice decimal(19,4), LastReceiptCost decimal(19,4), "
                                      "LastReceiptDate timestamp, MinOrderQty int, MaxOrderQty int, OnOrderQty int"),
        "Sales.SalesOrderHeader": c([(1, "SO1", 1, TS(2020, 1, 5), TS(2020, 1, 9), 5, True, Decimal("1"),
                                      Decimal("1"), Decimal("1"), Decimal("3"), 1, 7),
                                     (2, "SO2", 2, TS(2020, 2, 5), None, 9, False, Decimal("1"), Decimal("1"),
                                      Decimal("1"), Decimal("3"), 1, None)],
                                    "SalesOrderID int, SalesOrderNumber string, CustomerID int, OrderDate timestamp, "
                                    "ShipDate timestamp, Status int, OnlineOrderFlag boolean, SubTotal decimal(19,4), "
                                    "TaxAmt decimal(19,4), Freight decimal(19,4), TotalDue decimal(19,4), "
                                    "TerritoryID int, CurrencyRateID int"),
        "Sales.SalesOrderDetail": c([(1, 1, 2, Decimal("10"), Decimal("0"), Decimal("20")),
                                     (1, 2, 1, Decimal("5"), Decimal("0.1"), Decimal("4.5")),
                                     (2, 1, 1, Decimal("10"), Decimal("0"), Decimal("10"))],
                                    "SalesOrderID int, ProductID int, OrderQty int, UnitPrice decimal(19,4), "
                                    "UnitPriceDiscount decimal(19,4), LineTotal decimal(38,6)"),
        "Sales.CurrencyRate": c([(7, "EUR")], "CurrencyRateID int, ToCurrencyCode string"),
        "Sales.Customer": c([(1, 50, 1, 1, "AW1"), (2, None, None, None, "AW2"), (3, None, 3, 1, "AW3")],
                            "CustomerID int, StoreID int, PersonID int, TerritoryID int, AccountNumber string"),
        "Sales.Store": c([(50, "Bike Shop")], "BusinessEntityID int, Name string"),
        "Sales.SalesTerritory": c([(1, "Northwest", "North America", "US")],
                                  "TerritoryID int, Name string, `Group` string, CountryRegionCode string"),
    }
    return Sources(spark, t)


def test_b1_person_fans_out_and_cleans(src):
    rows = person.clean_person(src).collect()
    assert len([r for r in rows if r.BusinessEntityID == 1]) == 4       # 2 phones x 2 addresses
    p2 = [r for r in rows if r.BusinessEntityID == 2][0]
    assert (p2.FullName, p2.Suffix, p2.Title, p2.MarketingPreference, p2.CleanEmail) == \
        ("Bo X Ng", "Jr.", "Mr.", None, None)
    p1 = [r for r in rows if r.BusinessEntityID == 1]
    assert {r.CleanEmail for r in p1} == {"ann@x.com"} and {r.FullName for r in p1} == {"Ann Lee"}
    assert {r.SecondaryAddress for r in p1} == {"-", ""}                 # NULL -> '-', blank stays ''
    assert {r.MainAddress for r in p1} == {"1 Main", "2 Side"}
    assert len([r for r in person.clean_person(src, dedupe=True).collect() if r.BusinessEntityID == 1]) == 1


def test_b2_b7_hr(src):
    assert hr.department(src).first().DeptName == "Sales"
    e = {r.BusinessEntityID: r for r in hr.employee(src, AS_OF).collect()}
    assert (e[1].Age, e[1].TenureYears, e[1].MaritalStatus, e[1].Gender) == (34, 1, "Married", "Female")
    assert (e[2].MaritalStatus, e[2].PaymetType, e[2].EmploymetStatus) == ("N/A", "Hourly Wage", "Inactive")
    h = {r.BusinessEntityID: r for r in hr.department_history(src, AS_OF).collect()}
    assert (h[1].EndDateClean, h[1].AssignmentStatus, h[1].MonthsInRole) == (dt.date(9999, 12, 31), "Active Assignment", 2)
    assert (h[2].AssignmentStatus, h[2].MonthsInRole) == ("Previous Assignment", 14)
    p = {r.BusinessEntityID: r for r in hr.pay_history(src).collect()}
    assert (p[1].HourlyRate, p[1].EstimatedAnnualSalary, p[1].PayFrequencyDesc) == \
        (Decimal("12.35"), Decimal("25678.85"), "Bi-Weekly")
    assert p[2].PayFrequencyDesc is None
    j = {r.JobCandidateID: r.ApplicationStatus for r in hr.job_candidate(src).collect()}
    assert j == {1: "Resume Uploaded", 2: "No Resume"}
    s = {r.ShiftName: r.ShiftHours for r in hr.shift(src).collect()}
    assert s == {"Night": 8, "Day": 8}


def test_b8_b11_production(src):
    pm = {r.ProductID: r for r in production.product_master(src, AS_OF).collect()}
    assert (pm[1].CategoryName, pm[1].SubcategoryName, pm[1].ModelName, pm[1].ProductStatus) == \
        ("Bikes", "Road", "Road-150", "Active")
    assert (pm[2].Color, pm[2].Size, pm[2].ProductStatus, pm[2].SellEndDate) == \
        ("No Color", "N/A", "Discontinued", dt.date(2023, 6, 1))
    assert pm[3].ProductStatus == "Active" and pm[4].ProductStatus == "Discontinued"   # future / = as_of
    assert pm[1].SellEndDate == dt.date(9999, 12, 31) and pm[1].ProfitMargin == Decimal("50.0000")
    inv = {r.Quantity: r.StockStatus for r in production.inventory(src).collect()}
    assert inv == {5: "Safe", 4: "Low Stock"}
    wo = {r.WorkOrderID: r for r in production.work_order(src).collect()}
    assert (wo[1].ProductionDays, wo[1].ScrapReasonName, wo[2].ScrapReasonName) == (2, "Paint", None)
    th = {r.TransactionID: r.TransactionTypeDesc for r in production.transaction_history(src).collect()}
    assert th == {1: "Work Order", 2: None}


def test_b12_b14_purchasing(src):
    v = {r.VendorID: r for r in purchasing.vendor_master(src).collect()}
    assert (v[1].CreditRatingDesc, v[1].VendorStatus, v[1].WebserviceURL) == ("Below Average", "Preferred", "No URL")
    assert (v[2].CreditRatingDesc, v[2].AccountStatus) == (None, "Inactive")
    po = {r.ProductID: r for r in purchasing.purchase_orders(src).collect()}
    assert po[1].RejectRatePercentage == 0 and po[2].RejectRatePercentage is None
    assert float(po[3].RejectRatePercentage) == 33.33
    assert (po[1].OrderStatus, po[1].ShipDate, po[1].ShippingMethod) == ("Complete", dt.date(9999, 12, 31), "Truck")
    assert purchasing.product_vendor(src).first().OnOrderQty == 0


def test_b15_b17_sales(src):
    sp = sales.sales_performance(src).collect()
    assert len(sp) == 3
    o2 = [r for r in sp if r.SalesOrderID == 2][0]
    assert (o2.OrderStatus, o2.CurrencyCode, o2.ShipDate) == (None, None, None)
    o1 = [r for r in sp if r.SalesOrderID == 1][0]
    assert (o1.OrderStatus, o1.CurrencyCode, o1.IsOnlineOrder) == ("Shipped", "EUR", True)
    assert sorted(map(tuple, sales.sales_person(src).collect())) == sorted(map(tuple, sp))
    cp = {r.CustomerID: r for r in sales.customer_profile(src).collect()}
    assert (cp[1].CustomerType, cp[1].StoreName, cp[1].TerritoryRegion) == ("B2B (Store)", "Bike Shop", "North America")
    assert (cp[2].CustomerType, cp[2].StoreName, cp[2].TerritoryName) == ("Unknown", "Individual Customer", None)
    assert cp[3].CustomerType == "B2C (Individual)"


def test_missing_dependency_is_a_clear_error(spark):
    with pytest.raises(KeyError, match="dependency missing"):
        Sources(spark, {})["Sales.SalesOrderHeader"]


def test_views_registered_in_build_order(spark, src):
    from ledgerframe.plans.views import GOLDEN_VIEW, register_views
    views = register_views(src, AS_OF)
    assert GOLDEN_VIEW in views
    n = spark.sql(f"SELECT COUNT(*) AS n FROM {GOLDEN_VIEW} WHERE DaysToShip IS NOT NULL").first().n
    assert n == 8        # 2 lines x 4 contact rows of person 1: the person-join fan-out (quirk Q3)
    top = spark.sql(f"SELECT SalesOrderNumber, OrderDate, ShipDate, DaysToShip, OrderStatus, GrossRevenueUSD, "
                    f"CustomerName, TerritoryName FROM {GOLDEN_VIEW} ORDER BY SalesOrderNumber LIMIT 10").collect()
    assert top[0].DaysToShip == 4 and top[0].TerritoryName == "Northwest"


def test_sources_read_parquet_folder(spark, src, tmp_path):
    for name in ("Sales.Customer", "Sales.Store", "Sales.SalesTerritory"):
        src[name].write.parquet(str(tmp_path / name))
    disk = Sources(spark, root=str(tmp_path))
    assert "Sales.Customer" in disk
    got = sorted(map(tuple, sales.customer_profile(disk).collect()))
    assert got == sorted(map(tuple, sales.customer_profile(src).collect()))


def test_b7_shift_time_kinds(spark):
    from ledgerframe.plans.cleaning.hr import shift
    from ledgerframe.sources.catalog import Sources
    text = spark.createDataFrame([(1, "N", "23:00:00.0000000", "07:00:00"), (2, "D", "07:00:00", "15:30:00.5")],
                                 "ShiftID int, Name string, StartTime string, EndTime string")
    stamp = text.selectExpr("ShiftID", "Name", "to_timestamp(concat('1900-01-01 ', StartTime)) AS StartTime",
                            "to_timestamp(concat('1900-01-01 ', EndTime)) AS EndTime")
    for df in (text, stamp):
        got = {r.ShiftID: (r.StartTime, r.EndTime, r.ShiftHours)
               for r in shift(Sources(spark, {"HumanResources.Shift": df})).collect()}
        assert got == {1: ("23:00:00", "07:00:00", 8), 2: ("07:00:00", "15:30:00", 8)}
