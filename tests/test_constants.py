"""The fixed values of the measures, written out once more: the oracle takes
its labels and thresholds from the same constants, so a wrong one would be
green there."""

from decimal import Decimal

from ledgerframe.plans import measures as M


def test_growth_and_scores():
    assert (M.HEALTH_STATUS, M.HEALTH_STATUS_ELSE) == (
        [(5, "📈 Excellent Growth"), (0, "✅ Positive Growth"), (-5, "⚠️ Warning - Slight Decline")], "🔴 Critical - Significant Decline")
    assert M.FIXED_YEARS == (2022, 2023, 2024, 2025)
    assert M.R_SCORE == [(30, 5), (90, 4), (180, 3), (365, 2)]
    assert M.F_SCORE == [(20, 5), (10, 4), (5, 3), (2, 2)]
    assert M.M_SCORE == [(100_000, 5), (50_000, 4), (25_000, 3), (10_000, 2)]


def test_segments_by_their_conditions():
    """The ladder, read as conditions on (R, F, M)."""
    def of(r, f, m):
        def fits(x, lo_hi):
            lo, hi = lo_hi
            return (lo is None or x >= lo) and (hi is None or x <= hi)
        return next((n for n, a, b, c in M.DAX_SEGMENTS if fits(r, a) and fits(f, b) and fits(m, c)), M.DAX_SEGMENT_ELSE)

    def written(r, f, m):
        if r >= 4 and f >= 4 and m >= 4:
            return "Champions"
        if r >= 3 and f >= 3 and m >= 4:
            return "Loyal Customers"
        if r >= 4 and f <= 2 and m >= 3:
            return "Big Spenders"
        if r <= 2 and f >= 3 and m >= 3:
            return "At Risk"
        if r <= 2 and f >= 4:
            return "Can't Lose Them"
        return "Lost" if r <= 2 else "Regular"
    scores = range(1, 6)
    assert all(of(r, f, m) == written(r, f, m) for r in scores for f in scores for m in scores)


def test_products_orders_and_discounts():
    assert M.PARETO_SHARE == Decimal("0.2") and M.LIFECYCLE_RECENT_DAYS == 180
    assert M.LIFECYCLE_GROWTH == [(0.20, "Growth"), (0.05, "Mature/Stable"), (0, "Declining")] and M.LIFECYCLE_ELSE == "Stagnant/No Growth"
    assert M.ORDER_SIZE == [(100, "Small (<$100)"), (500, "Medium ($100-$500)"), (2000, "Large ($500-$2K)")]
    assert M.ORDER_SIZE_ELSE == "Extra Large (>$2K)" and M.FULFILLED_STATUS == "Shipped"
    assert [(Decimal(t), label) for t, label, _ in M.DAX_DISCOUNT] == [
        (Decimal("0"), "No Discount"), (Decimal("0.05"), "Small (0-5%)"), (Decimal("0.15"), "Medium (5-15%)"), (Decimal("0.30"), "Large (15-30%)")]
    assert M.DAX_DISCOUNT_ELSE == "Very Large (>30%)"


def test_scenarios_and_outliers():
    assert [float(x) for x in M.scenario_series()] == [round(-0.5 + 0.05 * i, 2) for i in range(21)]
    assert M.Z_OUTLIER == 2 and M.Z_CRITICAL == 3
    assert M.CONFIDENCE == [(0.1, "🟢 High Confidence"), (0.3, "🟡 Medium Confidence")] and M.CONFIDENCE_ELSE == "🔴 Low Confidence"
    assert [(Decimal(x), label) for x, label in M.TREND] == [
        (Decimal("1.10"), "Strong Growth"), (Decimal("1.05"), "Moderate Growth"), (Decimal("0.95"), "Stable"), (Decimal("0.90"), "Moderate Decline")]
    assert M.TREND_ELSE == "Strong Decline"
