"""Band and segment labels.

Ladders are read top to bottom; the first step that holds gives the label. A
NULL input meets no step and falls to the ladder's last label.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# Each pair is (bound, label). *_BELOW ladders hold while value < bound,
# *_UP_TO ladders while value <= bound, *_FROM ladders while value >= bound.

AGE_BELOW = ((20, "Under 20"), (30, "20-29"), (40, "30-39"), (50, "40-49"))
AGE_OTHERWISE = "50+"

COST_BELOW = ((100, "Below $100"), (500, "$100-$499"), (1001, "$500-$1000"))
COST_OTHERWISE = "Above $1000"

REPORT_COST_BELOW = ((100, "Below 100"), (500, "100-499"), (1001, "500-1000"))
REPORT_COST_OTHERWISE = "Above 1000"

RECENCY_UP_TO = ((3, "Active"), (6, "At Risk"), (12, "Dormant"))
CUSTOMER_RECENCY_OTHERWISE = "Churned"
PRODUCT_RECENCY_OTHERWISE = "Inactive"

VALUE_FROM = ((10000, "High Value"), (5000, "Medium Value"), (1000, "Low Value"))
VALUE_OTHERWISE = "Entry Level"

FREQUENCY_FROM = ((10, "Frequent Buyer"), (5, "Regular Buyer"), (2, "Occasional Buyer"))
FREQUENCY_OTHERWISE = "One-Time Buyer"

LIFECYCLE = ("VIP", "Regular", "New")
PERFORMANCE = ("High Performance", "Mid Range", "Low Performance")
HEALTH = ("Excellent", "Good", "Fair", "Poor")


@dataclass(frozen=True)
class Thresholds:
    """Business limits a caller may move."""

    product_mid_sales: int = 200_000
    product_high_sales: int = 750_000
    loyal_months: int = 12
    vip_spending: int = 5_000


# --- ladders ----------------------------------------------------------------

Ladder = tuple[tuple[int, str], ...]


def _ladder(steps: list[tuple[Column, str]], otherwise: str | None) -> Column:
    (first, label), *rest = steps
    chain = F.when(first, label)
    for condition, label in rest:
        chain = chain.when(condition, label)
    return chain if otherwise is None else chain.otherwise(otherwise)


def below(x: Column, steps: Ladder, otherwise: str) -> Column:
    return _ladder([(x < bound, label) for bound, label in steps], otherwise)


def up_to(x: Column, steps: Ladder, otherwise: str) -> Column:
    return _ladder([(x <= bound, label) for bound, label in steps], otherwise)


def at_least(x: Column, steps: Ladder, otherwise: str) -> Column:
    return _ladder([(x >= bound, label) for bound, label in steps], otherwise)


def label_order(label: Column, labels: list[str] | tuple[str, ...]) -> Column:
    """Position of a label in its ladder, for sorting; NULL labels come first."""
    return F.nullif(F.array_position(F.array(*map(F.lit, labels)), label), F.lit(0))


def age_group(age: Column) -> Column:
    return below(age, AGE_BELOW, AGE_OTHERWISE)


def cost_range(cost: Column) -> Column:
    return below(cost, COST_BELOW, COST_OTHERWISE)


def report_cost_range(cost: Column) -> Column:
    return below(cost, REPORT_COST_BELOW, REPORT_COST_OTHERWISE)


def engagement_status(recency_months: Column) -> Column:
    return up_to(recency_months, RECENCY_UP_TO, CUSTOMER_RECENCY_OTHERWISE)


def recency_status(recency_months: Column) -> Column:
    return up_to(recency_months, RECENCY_UP_TO, PRODUCT_RECENCY_OTHERWISE)


def value_tier(total_sales: Column) -> Column:
    return at_least(total_sales, VALUE_FROM, VALUE_OTHERWISE)


def purchase_frequency(total_orders: Column) -> Column:
    return at_least(total_orders, FREQUENCY_FROM, FREQUENCY_OTHERWISE)


def lifecycle_segment(lifespan_months: Column, spending: Column, limits: Thresholds) -> Column:
    vip, regular, new = LIFECYCLE
    loyal = lifespan_months >= limits.loyal_months
    return _ladder(
        [
            (loyal & (spending > limits.vip_spending), vip),
            (loyal & (spending <= limits.vip_spending), regular),
        ],
        new,
    )


def performance_segment(total_sales: Column, limits: Thresholds) -> Column:
    """NULL sales have no segment."""
    high, mid, low = PERFORMANCE
    return _ladder(
        [
            (total_sales >= limits.product_high_sales, high),
            (total_sales >= limits.product_mid_sales, mid),
            (total_sales < limits.product_mid_sales, low),
        ],
        None,
    )


def customer_health(total_sales: Column, recency_months: Column, total_orders: Column) -> Column:
    excellent, good, fair, poor = HEALTH
    return _ladder(
        [
            ((total_sales >= 5000) & (recency_months <= 3) & (total_orders >= 5), excellent),
            ((total_sales >= 2000) & (recency_months <= 6), good),
            ((total_sales >= 1000) | (recency_months <= 6), fair),
        ],
        poor,
    )


def product_health(total_sales: Column, recency_months: Column, limits: Thresholds) -> Column:
    excellent, good, fair, poor = HEALTH
    solid = total_sales >= limits.product_mid_sales
    return _ladder(
        [
            ((total_sales >= limits.product_high_sales) & (recency_months <= 3), excellent),
            (solid & (recency_months <= 6), good),
            (solid | (recency_months <= 6), fair),
        ],
        poor,
    )
