"""B1 — ``Person.vCleanPerson``: identity, contact and address in one row per
(person × email × phone × address) — the left joins fan out when a person
has several contact rows, as in the reference; ``dedupe=True`` keeps one row
per person (lowest email / phone / address)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ...sources.catalog import Sources

# Marketing preference codes (no ELSE branch -> NULL).
MARKETING_PREFERENCE = {0: "No Promotion", 1: "Internal Only", 2: "All Promotions"}

COLUMNS = ["BusinessEntityID", "PersonType", "Title", "FullName", "Suffix", "CleanEmail", "PhoneNumber",
           "PhoneType", "MainAddress", "SecondaryAddress", "City", "StateProvince", "CountryRegion",
           "PostalCode", "AddressType", "MarketingPreference", "ModifiedDate"]


def clean_person(src: Sources, dedupe: bool = False) -> DataFrame:
    p = src["Person.Person"].alias("p")
    e = src["Person.EmailAddress"].alias("e")
    ph = src["Person.PersonPhone"].alias("ph")
    pnt = src["Person.PhoneNumberType"].alias("pnt")
    bea = src["Person.BusinessEntityAddress"].alias("bea")
    a = src["Person.Address"].alias("a")
    at = src["Person.AddressType"].alias("at")
    sp = src["Person.StateProvince"].alias("sp")
    cr = src["Person.CountryRegion"].alias("cr")
    j = (p.join(e, F.col("p.BusinessEntityID") == F.col("e.BusinessEntityID"), "left")
          .join(ph, F.col("p.BusinessEntityID") == F.col("ph.BusinessEntityID"), "left")
          .join(pnt, F.col("ph.PhoneNumberTypeID") == F.col("pnt.PhoneNumberTypeID"), "left")
          .join(bea, F.col("p.BusinessEntityID") == F.col("bea.BusinessEntityID"), "left")
          .join(a, F.col("bea.AddressID") == F.col("a.AddressID"), "left")
          .join(at, F.col("bea.AddressTypeID") == F.col("at.AddressTypeID"), "left")
          .join(sp, F.col("a.StateProvinceID") == F.col("sp.StateProvinceID"), "left")
          .join(cr, F.col("sp.CountryRegionCode") == F.col("cr.CountryRegionCode"), "left"))
    promo = F.col("p.EmailPromotion")
    pref = None
    for k, v in MARKETING_PREFERENCE.items():
        pref = F.when(promo == k, F.lit(v)) if pref is None else pref.when(promo == k, F.lit(v))
    out = j.select(
        F.col("p.BusinessEntityID").alias("BusinessEntityID"),
        F.col("p.PersonType").alias("PersonType"),
        F.coalesce(F.col("p.Title"), F.lit("N/A")).alias("Title"),
        F.concat_ws(" ", F.col("p.FirstName"), F.col("p.MiddleName"), F.col("p.LastName")).alias("FullName"),
        F.coalesce(F.col("p.Suffix"), F.lit("")).alias("Suffix"),
        F.lower(F.trim(F.col("e.EmailAddress"))).alias("CleanEmail"),
        F.col("ph.PhoneNumber").alias("PhoneNumber"),
        F.col("pnt.Name").alias("PhoneType"),
        F.trim(F.col("a.AddressLine1")).alias("MainAddress"),
        F.coalesce(F.trim(F.col("a.AddressLine2")), F.lit("-")).alias("SecondaryAddress"),
        F.col("a.City").alias("City"),
        F.col("sp.Name").alias("StateProvince"),
        F.col("cr.Name").alias("CountryRegion"),
        F.col("a.PostalCode").alias("PostalCode"),
        F.col("at.Name").alias("AddressType"),
        pref.alias("MarketingPreference"),
        F.col("p.ModifiedDate").alias("ModifiedDate"),
    )
    if dedupe:
        w = Window.partitionBy("BusinessEntityID").orderBy(
            F.col("CleanEmail").asc_nulls_last(), F.col("PhoneNumber").asc_nulls_last(),
            F.col("MainAddress").asc_nulls_last())
        out = out.select("*", F.row_number().over(w).alias("_r")).where("_r = 1").drop("_r")
    return out
