"""The golden record as versions: refresh, readers, statistics."""

import datetime as dt

import pytest
from helpers import golden_df, line
from pyspark.sql import functions as F

from ledgerframe.operators.stats import known
from ledgerframe.plans.snapshot import GoldenStore


def _rows(df):
    return sorted((r.SalesOrderID, r.OrderYear, r.OrderQty) for r in df.collect())


@pytest.fixture
def store(spark, tmp_path):
    return GoldenStore(spark, f"file://{tmp_path}/store")


def _record(spark, *more):
    return golden_df(spark, [line(1, "2019-05-01", revenue="10"), line(2, "2020-05-01", revenue="20"), line(2, "2020-05-01", revenue="20"), *more])


def test_a_reader_sees_one_version(spark, store):
    assert store.refresh(_record(spark)) == 1
    before = store.read()
    rows = _rows(before)
    changed = _record(spark, line(3, "2021-02-01", revenue="30")).withColumn("OrderQty", F.when(F.col("OrderYear") == 2020, 9).otherwise(1))
    assert store.refresh(changed) == 2
    assert _rows(before) == rows == _rows(store.read(1))  # read after the refresh: still the old rows
    assert _rows(store.read()) == [(1, 2019, 1), (2, 2020, 9), (2, 2020, 9), (3, 2021, 1)]


def test_only_changed_years_are_written(spark, store):
    store.refresh(_record(spark))
    store.refresh(_record(spark, line(3, "2021-02-01")))
    at = {r.year: r.at for r in store._years()}
    assert at == {2019: 1, 2020: 1, 2021: 2}
    assert store.refresh(_record(spark, line(3, "2021-02-01"))) == 2  # nothing changed: no version
    assert store.refresh(_record(spark)) == 3 and {r.year for r in store._years()} == {2019, 2020}  # a year less
    # a repeated row more is a change, although it cancels in a xor
    twice = _record(spark, line(2, "2020-05-01", revenue="20"), line(2, "2020-05-01", revenue="20"))
    assert store.refresh(twice) == 4 and {r.year: r.at for r in store._years()} == {2019: 1, 2020: 4}


def test_high_water_mark(spark, store):
    """Years before the mark are taken as they are, not as the record has them."""
    store.refresh(_record(spark))
    store.refresh(_record(spark).withColumn("OrderQty", F.lit(5)), since=2020)
    assert _rows(store.read()) == [(1, 2019, 1), (2, 2020, 5), (2, 2020, 5)]


def test_statistics_belong_to_the_version(spark, store):
    store.refresh(_record(spark))
    old = store.read()
    store.refresh(_record(spark, line(3, "2022-12-30", revenue="90")))
    new = store.read()
    assert known(old, "latest") == dt.date(2020, 5, 1) and known(new, "latest") == dt.date(2022, 12, 30)
    assert known(new, "calendar") == (dt.date(2019, 1, 1), dt.date(2023, 12, 31))  # shipped in January 2023
    mu, sd = known(new, "spread")
    plain = new.agg(F.avg("GrossRevenueUSD"), F.stddev_pop("GrossRevenueUSD")).first()
    assert mu == pytest.approx(float(plain[0])) and sd == pytest.approx(plain[1])


def test_overwritten_folders_note_nothing(spark, tmp_path):
    from ledgerframe.plans.golden import materialize
    assert known(materialize(_record(spark), f"file://{tmp_path}/g"), "latest") is None
    assert known(materialize(_record(spark)), "latest") == dt.date(2020, 5, 1)


def test_missing_and_empty_versions(spark, store):
    with pytest.raises(ValueError):
        store.read()
    none = _record(spark).limit(0)
    assert store.refresh(none) == 0  # nothing yet, nothing changed
    assert [store.refresh(x) for x in (_record(spark), none, none, _record(spark))] == [1, 2, 2, 3]
    with pytest.raises(ValueError):
        store.read(2)
    assert len(_rows(store.read())) == len(_rows(store.read(1))) == 3


def test_a_refresh_computes_the_record_once(spark, store, tmp_path):
    """Marks come from what was written; only changed years stay below the new version."""
    store.refresh(_record(spark))
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b
    g = _record(spark, line(3, "2021-02-01"))
    assert store.refresh(g.mapInArrow(counted, g.schema)) == 2
    assert read.value == 4
    assert {p.name for p in (tmp_path / "store/data/v=2").glob("OrderYear=*")} == {"OrderYear=2021"}
    assert store.refresh(g) == 2 and not (tmp_path / "store/data/v=3").exists()
