"""Oracle SQL for the cleaning datasets B1-B7, B9-B15, B17 and the golden
record over them, on the raw tables of ``ledgerframe.sources.raw_tables``."""

from ledgerframe.plans.cleaning import hr, person, production, purchasing, sales
from ledgerframe.sources.raw_tables import raw_sql

from . import measures as M
from .common import AS_OF, GOLDEN_CTES, RATE, _quoted, d, lookup

OPEN_END = "DATE '9999-12-31'"


def over(*tables: str) -> str:
    """WITH the raw tables, each under its name without the schema."""
    return "WITH " + ", ".join(f"{t.split('.')[1]} AS ({raw_sql(t)})" for t in tables) + " "


def code(column: str, names: dict) -> str:
    """The name of a code; NULL for unknown codes."""
    return f"CASE {column} " + " ".join(f"WHEN {k!r} THEN '{v}'" for k, v in names.items()) + " END"


def flag(condition: str, yes: str, no: str) -> str:
    return f"if({condition}, '{yes}', '{no}')"


_PRODUCT = "(SELECT p_partkey AS ProductID, p_name AS ProductName, p_size * 10 AS SafetyStockLevel FROM part)"

_PERSON_TABLES = ("Person.Person", "Person.EmailAddress", "Person.PersonPhone", "Person.PhoneNumberType",
                  "Person.BusinessEntityAddress", "Person.Address", "Person.AddressType", "Person.StateProvince",
                  "Person.CountryRegion")
_PERSON = f"""
SELECT BusinessEntityID, PersonType, COALESCE(Title, 'N/A') AS Title,
  FirstName || COALESCE(' ' || MiddleName, '') || COALESCE(' ' || LastName, '') AS FullName,
  COALESCE(Suffix, '') AS Suffix, lower(trim(EmailAddress)) AS CleanEmail, PhoneNumber, t.Name AS PhoneType,
  trim(AddressLine1) AS MainAddress, COALESCE(trim(AddressLine2), '-') AS SecondaryAddress, City,
  s.Name AS StateProvince, c.Name AS CountryRegion, PostalCode, k.Name AS AddressType,
  {code('EmailPromotion', person.MARKETING_PREFERENCE)} AS MarketingPreference, ModifiedDate
FROM Person LEFT JOIN EmailAddress USING (BusinessEntityID) LEFT JOIN PersonPhone USING (BusinessEntityID)
LEFT JOIN PhoneNumberType t USING (PhoneNumberTypeID) LEFT JOIN BusinessEntityAddress USING (BusinessEntityID)
LEFT JOIN Address USING (AddressID) LEFT JOIN AddressType k USING (AddressTypeID)
LEFT JOIN StateProvince s USING (StateProvinceID) LEFT JOIN CountryRegion c USING (CountryRegionCode)"""

_SALES_TABLES = ("Sales.SalesOrderHeader", "Sales.SalesOrderDetail", "Sales.CurrencyRate")


def _sales(show) -> str:
    return f"""
SELECT SalesOrderID, SalesOrderNumber, CustomerID, CAST(OrderDate AS DATE) AS OrderDate, CAST(ShipDate AS DATE) AS ShipDate,
  {code('Status', sales.ORDER_STATUS)} AS OrderStatus, OnlineOrderFlag AS IsOnlineOrder, ProductID, OrderQty,
  {', '.join(f'{show(c)} AS {c}' for c in ('UnitPrice', 'UnitPriceDiscount', 'LineTotal', 'SubTotal', 'TaxAmt', 'Freight', 'TotalDue'))},
  TerritoryID, ToCurrencyCode AS CurrencyCode
FROM SalesOrderDetail JOIN SalesOrderHeader USING (SalesOrderID) LEFT JOIN CurrencyRate USING (CurrencyRateID)"""


_REJECTED = "round(CAST(RejectedQty AS DOUBLE) * 100 / CAST(NULLIF(ReceivedQty, 0) AS DOUBLE), 2)"

SQL = {
    "clean_person": over(*_PERSON_TABLES) + _PERSON,
    "clean_sales": over(*_SALES_TABLES) + _sales(d),
    "clean_sales_person": over(*_SALES_TABLES) + _sales(d),
    "clean_inventory": over("Production.ProductInventory", "Production.Location") + f"""
SELECT ProductID, ProductName, Name AS LocationName, Shelf, Bin, Quantity,
  {flag('Quantity < SafetyStockLevel', 'Low Stock', 'Safe')} AS StockStatus
FROM ProductInventory JOIN {_PRODUCT} USING (ProductID) JOIN Location USING (LocationID)""",
    "clean_work_order": over("Production.WorkOrder", "Production.ScrapReason") + f"""
SELECT WorkOrderID, ProductName, OrderQty, StockedQty, ScrappedQty, Name AS ScrapReasonName,
  CAST(StartDate AS DATE) AS StartDate, CAST(EndDate AS DATE) AS EndDate,
  CAST(CAST(EndDate AS DATE) - CAST(StartDate AS DATE) AS INT) AS ProductionDays
FROM WorkOrder JOIN {_PRODUCT} USING (ProductID) LEFT JOIN ScrapReason USING (ScrapReasonID)""",
    "clean_transaction": over("Production.TransactionHistory") + f"""
SELECT TransactionID, ProductID, ReferenceOrderID, TransactionDate,
  {code('TransactionType', production.TRANSACTION_TYPES)} AS TransactionTypeDesc, Quantity, {d('ActualCost')} AS ActualCost
FROM TransactionHistory""",
    "clean_vendor": over("Purchasing.Vendor") + f"""
SELECT BusinessEntityID AS VendorID, AccountNumber, Name AS VendorName,
  {code('CreditRating', purchasing.CREDIT_RATING)} AS CreditRatingDesc,
  {flag('PreferredVendorStatus', 'Preferred', 'Regular')} AS VendorStatus,
  {flag('ActiveFlag', 'Active', 'Inactive')} AS AccountStatus, COALESCE(PurchasingWebServiceURL, 'No URL') AS WebserviceURL
FROM Vendor""",
    "clean_purchase_orders": over("Purchasing.PurchaseOrderHeader", "Purchasing.PurchaseOrderDetail", "Purchasing.Vendor",
                                  "Purchasing.ShipMethod") + f"""
SELECT PurchaseOrderID, VendorID, v.Name AS VendorName, CAST(OrderDate AS DATE) AS OrderDate,
  COALESCE(CAST(ShipDate AS DATE), {OPEN_END}) AS ShipDate, {code('Status', purchasing.PO_STATUS)} AS OrderStatus,
  {', '.join(f'{d(c)} AS {c}' for c in ('SubTotal', 'TaxAmt', 'Freight', 'TotalDue'))}, ProductID, OrderQty,
  {', '.join(f'{d(c)} AS {c}' for c in ('UnitPrice', 'LineTotal', 'ReceivedQty', 'RejectedQty'))},
  if(ReceivedQty = 0, 0.0, {_REJECTED})::DOUBLE AS RejectRatePercentage, m.Name AS ShippingMethod
FROM PurchaseOrderDetail JOIN PurchaseOrderHeader USING (PurchaseOrderID)
JOIN Vendor v ON v.BusinessEntityID = VendorID JOIN ShipMethod m USING (ShipMethodID)""",
    "clean_product_vendor": over("Purchasing.ProductVendor", "Purchasing.Vendor") + f"""
SELECT ProductID, Name AS VendorName, AverageLeadTime, {d('StandardPrice')} AS StandardPrice,
  {d('LastReceiptCost')} AS LastReceiptCost, CAST(LastReceiptDate AS DATE) AS LastReceiptDate, MinOrderQty, MaxOrderQty,
  COALESCE(OnOrderQty, 0) AS OnOrderQty
FROM ProductVendor JOIN Vendor USING (BusinessEntityID)""",
    "clean_department": over("HumanResources.Department") +
    "SELECT departmentID, trim(Name) AS DeptName, trim(groupName) AS Division, ModifiedDate FROM Department",
    "clean_employee": over("HumanResources.Employee") + f"""
SELECT BusinessEntityID, NationalIDNumber, JobTitle, BirthDate, HireDate,
  CAST(year({AS_OF}) - year(BirthDate) AS INT) AS Age, CAST(year({AS_OF}) - year(HireDate) AS INT) AS TenureYears,
  {lookup('MaritalStatus', _quoted(hr.MARITAL.items()), "'N/A'")} AS MaritalStatus,
  {lookup('Gender', _quoted(hr.GENDER.items()), "'N/A'")} AS Gender,
  {flag('SalariedFlag IS TRUE', 'Monthly Salary', 'Hourly Wage')} AS PaymetType,
  {flag('CurrentFlag IS TRUE', 'Active', 'Inactive')} AS EmploymetStatus
FROM Employee""",
    "clean_department_history": over("HumanResources.EmployeeDepartmentHistory") + f"""
SELECT BusinessEntityID, DepartmentID, ShiftID, StartDate, COALESCE(EndDate, {OPEN_END}) AS EndDateClean,
  {flag('EndDate IS NULL', 'Active Assignment', 'Previous Assignment')} AS AssignmentStatus,
  CAST((year(COALESCE(EndDate, {AS_OF})) - year(StartDate)) * 12 + month(COALESCE(EndDate, {AS_OF})) - month(StartDate) AS INT)
    AS MonthsInRole
FROM EmployeeDepartmentHistory""",
    "clean_pay_history": over("HumanResources.EmployeePayHistory") + f"""
SELECT BusinessEntityID, CAST(RateChangeDate AS DATE) AS RateChangeDate, {d('round(Rate, 2)')} AS HourlyRate,
  {d(f'round(Rate * {hr.HOURS_PER_WEEK * hr.WEEKS_PER_YEAR}, 2)')} AS EstimatedAnnualSalary,
  {code('PayFrequency', hr.PAY_FREQUENCY)} AS PayFrequencyDesc
FROM EmployeePayHistory""",
    "clean_job_candidate": over("HumanResources.JobCandidate") + f"""
SELECT JobCandidateID, BusinessEntityID, {flag('Resume IS NULL', 'No Resume', 'Resume Uploaded')} AS ApplicationStatus,
  ModifiedDate FROM JobCandidate""",
    "clean_shift": over("HumanResources.Shift") + """
SELECT ShiftID, Name AS ShiftName, strftime(StartTime, '%H:%M:%S') AS StartTime, strftime(EndTime, '%H:%M:%S') AS EndTime,
  CAST((hour(EndTime) - hour(StartTime) + 24) % 24 AS INT) AS ShiftHours FROM Shift""",
}

# The golden record over the views above: its projection is that of the fused
# record, from `priced`; the person side may repeat lines.
_PROJECTION = GOLDEN_CTES[GOLDEN_CTES.index("golden AS ("):].replace("golden AS (", "SELECT * FROM (", 1)
_SHOWN = ("UnitPrice", "UnitPriceDiscount", "GrossRevenue", "EstimatedNetProfit", "ExchangeRateToUSD", "GrossRevenueUSD",
          "EstimatedNetProfitUSD")
SQL["golden_generic"] = over(*_SALES_TABLES, *_PERSON_TABLES) + f""",
sold AS ({_sales(str)}),
named AS ({_PERSON}),
goods AS (SELECT * REPLACE (CAST(StandardCost AS DECIMAL(19,4)) AS StandardCost) FROM ({M.CLEAN_PRODUCT})),
profile AS ({M.CLEAN_CUSTOMER}),
priced AS (
  SELECT sold.* EXCLUDE (CustomerID, CurrencyCode), sold.CustomerID AS S_CustomerID, sold.CurrencyCode AS S_CurrencyCode,
    goods.ProductName AS P_ProductName, goods.ProductNumber AS P_ProductNumber, goods.CategoryName AS P_CategoryName,
    goods.SubcategoryName AS P_SubcategoryName, goods.Color AS P_Color, goods.ProductStatus AS P_ProductStatus,
    goods.StandardCost AS P_StandardCost, profile.CustomerID AS C_CustomerID, profile.CustomerType AS C_CustomerType,
    profile.StoreName AS C_StoreName, profile.TerritoryName AS C_TerritoryName,
    profile.TerritoryRegion AS C_TerritoryRegion, profile.CountryRegionCode AS C_CountryRegionCode,
    named.FullName AS PE_FullName, named.CleanEmail AS PE_CleanEmail, {RATE.replace('S_CurrencyCode', 'sold.CurrencyCode').replace('C_CountryRegionCode', 'profile.CountryRegionCode')} AS Rate
  FROM sold LEFT JOIN goods USING (ProductID) LEFT JOIN profile ON profile.CustomerID = sold.CustomerID
  LEFT JOIN named ON named.BusinessEntityID = sold.CustomerID
)
SELECT * REPLACE ({', '.join(f'{d(c)} AS {c}' for c in _SHOWN)}) FROM ({_PROJECTION})"""
