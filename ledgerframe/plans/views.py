"""Create-or-replace named views for SQL users (A3), in the reference's
build order: Person, HumanResources, Production, Purchasing, Sales, then the
golden record last.

View names replace the schema dot with an underscore
(``Sales.vMasterBusinessAnalytics`` -> ``Sales_vMasterBusinessAnalytics``);
the HR queries, bare SELECTs in the reference, get ``HumanResources_<Table>``
names.  A missing raw table raises the dependency error of ``Sources``.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame

from ..sources.catalog import Sources
from .cleaning import hr, person, production, purchasing, sales
from .golden import golden

BUILD_ORDER = [
    ("Person_vCleanPerson", lambda s, d: person.clean_person(s)),
    ("HumanResources_Department", lambda s, d: hr.department(s)),
    ("HumanResources_Employee", lambda s, d: hr.employee(s, d)),
    ("HumanResources_EmployeeDepartmentHistory", lambda s, d: hr.department_history(s, d)),
    ("HumanResources_EmployeePayHistory", lambda s, d: hr.pay_history(s)),
    ("HumanResources_JobCandidate", lambda s, d: hr.job_candidate(s)),
    ("HumanResources_Shift", lambda s, d: hr.shift(s)),
    ("Production_vCleanProductMaster", lambda s, d: production.product_master(s, d)),
    ("Production_vCleanInventory", lambda s, d: production.inventory(s)),
    ("Production_vCleanWorkOrder", lambda s, d: production.work_order(s)),
    ("Production_vCleanTransactionHistory", lambda s, d: production.transaction_history(s)),
    ("Purchasing_vCleanVendorMaster", lambda s, d: purchasing.vendor_master(s)),
    ("Purchasing_vCleanPurchaseOrders", lambda s, d: purchasing.purchase_orders(s)),
    ("Purchasing_vCleanProductVendor", lambda s, d: purchasing.product_vendor(s)),
    ("Sales_vCleanSalesPerformance", lambda s, d: sales.sales_performance(s)),
    ("Sales_vCleanCustomerProfile", lambda s, d: sales.customer_profile(s)),
    ("Sales_vCleanSalesPerson", lambda s, d: sales.sales_person(s)),
]
GOLDEN_VIEW = "Sales_vMasterBusinessAnalytics"


def register_views(src: Sources, as_of: _dt.date, only: list[str] | None = None) -> dict[str, DataFrame]:
    """Register the cleaning views and the golden view as temp views; returns
    them by name.  ``only`` restricts the cleaning views (the golden view is
    added when its four inputs are registered)."""
    out: dict[str, DataFrame] = {}
    for name, build in BUILD_ORDER:
        if only is not None and name not in only:
            continue
        df = build(src, as_of)
        df.createOrReplaceTempView(name)
        out[name] = df
    needed = ["Sales_vCleanSalesPerformance", "Production_vCleanProductMaster",
              "Sales_vCleanCustomerProfile", "Person_vCleanPerson"]
    if all(n in out for n in needed):
        g = golden(*(out[n] for n in needed))
        g.createOrReplaceTempView(GOLDEN_VIEW)
        out[GOLDEN_VIEW] = g
    return out
