"""Raw table sources: layouts, URIs, JDBC options; collation; as-of dates."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerframe.sources.catalog import LAYOUTS, Sources


@pytest.mark.parametrize("layout", LAYOUTS)
@pytest.mark.parametrize("scheme", ["", "file://"])
def test_layouts_by_path_and_uri(spark, tmp_path, layout, scheme):
    root = f"{scheme}{tmp_path}"
    spark.range(3).write.parquet(f"{root}/" + layout.format(schema="Sales", table="Store", fmt="parquet"))
    for src in (Sources(spark, root=root), Sources(spark, root=root, layout=layout)):
        assert "Sales.Store" in src and "Sales.Customer" not in src
        assert src["Sales.Store"].count() == 3
        with pytest.raises(KeyError, match="Sales.Customer"):
            src["Sales.Customer"]


def test_jdbc_options_per_table(spark):
    part = {"partitionColumn": "SalesOrderID", "lowerBound": "1", "upperBound": "100", "numPartitions": "8"}
    src = Sources(spark, jdbc={"url": "jdbc:x"}, table_options={"Sales.SalesOrderDetail": part})
    assert src.read_options("Sales.SalesOrderDetail") == {"url": "jdbc:x", "dbtable": "Sales.SalesOrderDetail", **part}
    assert src.read_options("Sales.Store") == {"url": "jdbc:x", "dbtable": "Sales.Store"}
    with pytest.raises(ValueError, match="numPartitions"):
        Sources(spark, jdbc={}, table_options={"A.B": {"partitionColumn": "x"}}).read_options("A.B")
    with pytest.raises(ValueError, match="table_options"):
        Sources(spark, jdbc=part).read_options("A.B")


def test_pairs_under_a_collation(spark):
    from ledgerframe.operators.pairs import basket_items, item_pairs
    rows = spark.createDataFrame([(1, "a", 1.0), (1, "B", 1.0), (1, "b", 1.0)], "b int, p string, v double")
    items = basket_items(rows, "b", ["p"], "v")

    def pairs(collation):
        return sorted((r.p1, r.p2) for r in item_pairs(items, "b", ["p"], "p", collation=collation).collect())
    assert pairs(None) == [("B", "a"), ("B", "b"), ("a", "b")]
    assert pairs("UTF8_LCASE") == [("a", "B"), ("a", "b")]


def test_as_of_defaults_to_today(spark):
    from helpers import golden_df, line

    from ledgerframe.plans.reports import customer, operations
    g = golden_df(spark, [line(1, "2020-01-01", customer="Two"), line(2, "2020-02-01", customer="Two")])
    days = (dt.date.today() - dt.date(2020, 2, 1)).days
    assert abs(customer.churn_risk(g, top=None).first().DaysSinceLastOrder - days) <= 1
    assert operations.status_fulfilment(g).first().AvgDaysSinceOrder >= days - 1


def test_isnull_takes_the_type_of_its_first_argument(spark):
    from ledgerframe.functions import isnull_typed
    df = spark.range(1).select(isnull_typed(F.lit(None).cast("decimal(9,2)"), "7", "decimal(9,2)").alias("x"))
    assert df.dtypes == [("x", "decimal(9,2)")] and str(df.first().x) == "7.00"


def test_split_predicates_cut_rows_evenly(spark):
    """Half of the rows in one key, a long sparse tail, and nulls."""
    from ledgerframe.sources.catalog import split_predicates
    keys = [7] * 5000 + list(range(100, 3100)) + [10 ** 9 + i * 10 ** 6 for i in range(1000)] + [None] * 50
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    parts = split_predicates(df, "k", 8)
    sizes = [df.where(p).count() for p in parts]
    assert sum(sizes) == len(keys) and df.where(" OR ".join(f"({p})" for p in parts)).count() == len(keys)
    assert sizes[parts.index("k = 7")] == 5000 and max(x for p, x in zip(parts, sizes) if p != "k = 7") <= 2 * len(keys) / 8
    # even ranges would put all but the tail into one read
    assert df.where("k < 250000000").count() == 8000
    assert split_predicates(df.where("k IS NULL"), "k", 4) == ["k IS NULL", "k IS NOT NULL"] and split_predicates(df, "k", 1) == ["1 = 1"]
    few = split_predicates(spark.createDataFrame([(1,), (2,)], "k long"), "k", 4)
    assert [spark.createDataFrame([(1,), (2,), (None,)], "k long").where(p).count() for p in few if p] .count(1) >= 2


def test_tables_are_built_when_asked_for(spark):
    from ledgerframe.sources.catalog import Sources
    built = []
    src = Sources(spark, {"A.B": lambda: built.append(1) or spark.range(3), "A.C": lambda: 1 / 0})
    assert "A.C" in src and src["A.B"].count() == 3 and src["A.B"].count() == 3 and built == [1]


def test_intermediate_tables_go_with_their_context(spark):
    from ledgerframe.session import intermediate_tables, materialized
    from ledgerframe.sources.catalog import _exists
    kept = materialized(spark.range(5), "kept")
    with intermediate_tables(spark) as outer:
        a = materialized(spark.range(3), "t")
        with intermediate_tables(spark) as inner:
            assert materialized(spark.range(4), "t").count() == 4
        assert a.count() == 3 and not _exists(spark, inner[0]) and _exists(spark, outer[0])
    assert not _exists(spark, outer[0]) and kept.count() == 5
