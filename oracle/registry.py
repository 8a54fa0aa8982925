"""Oracle SQL per registered query key."""

from . import cleaning as C
from . import evaluate as E
from . import measures as M
from . import pages as P
from . import reports as R

SQL: dict[str, str] = {
    "clean_product": M.CLEAN_PRODUCT,
    "clean_customer": M.CLEAN_CUSTOMER,
    "golden": R.GOLDEN_SELECT,
    "d1_1": R.D1_1,
    "d1_2": R.D1_2,
    "d1_3": R.D1_3,
    "d2_1": R.D2_1,
    "d2_2": R.D2_2,
    "d2_3": R.D2_3,
    "d3_1": R.D3_1,
    "d3_2": R.D3_2,
    "d3_3": R.D3_3,
    "d4_1": R.D4_1,
    "d4_2": R.D4_2,
    "d5_1": R.D5_1,
    "d5_2": R.D5_2,
    "d6_1": R.D6_1,
    "d6_2": R.D6_2,
    "d7_1": R.D7_1,
    "d8_1": R.D8_1,
    "cal": M.CAL,
    "m_core": M.M_CORE,
    "m_time": M.M_TIME,
    "m_time_category": M.M_TIME_CATEGORY,
    "m_time_year": M.M_TIME_YEAR,
    "m_ma": M.M_MA,
    "m_ma_year": M.M_MA_YEAR,
    "m_customer": M.M_CUSTOMER,
    "m_rfm": M.M_RFM,
    "m_ltv": M.M_LTV,
    "m_product": M.M_PRODUCT,
    "m_pareto": M.M_PARETO,
    "m_lifecycle": M.M_LIFECYCLE,
    "m_ops": M.M_OPS,
    "m_buckets": M.M_BUCKETS,
    "m_anomaly": M.M_ANOMALY,
    "m_forecast": M.M_FORECAST,
    "m_scenario": M.M_SCENARIO,
    "m_season": M.M_SEASON,
    "m_weekpart": M.M_WEEKPART,
    "m_territory": M.M_TERRITORY,
    "page_1": P.PAGE_1,
    "page_2": P.PAGE_2,
    "page_3": P.PAGE_3,
    "page_4": P.PAGE_4,
    "page_5": P.PAGE_5,
    "page_6": P.PAGE_6,
    "page_7": P.PAGE_7,
    "page_8": P.PAGE_8,
    "page_9": P.PAGE_9,
}
SQL.update(R.WITHOUT_LIMIT)
SQL.update(C.SQL)
SQL.update(P.DATASETS)
SQL.update({"m_time_years": M.M_TIME_YEARS, "m_eval_category": M.M_EVAL_CATEGORY,
            "m_eval_segment_year": M.M_EVAL_SEGMENT_YEAR, "m_eval_region_month": M.M_EVAL_REGION_MONTH})
SQL.update(E.SQL)
