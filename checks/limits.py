"""Bounds and labels of the SQL twins, written out here and not taken from the jobs they check."""

from __future__ import annotations

from datetime import date
from typing import NamedTuple

# --- fixed values -----------------------------------------------------------

Ladder = tuple[tuple[int, str], ...]

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
LOYAL_MONTHS, VIP_SPENDING = 12, 5_000
PERFORMANCE = ("High Performance", "Mid Range", "Low Performance")
HEALTH = ("Excellent", "Good", "Fair", "Poor")

AS_OF = date(2001, 8, 1)


class ProductLimits(NamedTuple):
    product_mid_sales: int
    product_high_sales: int


REGISTERED_LIMITS = ProductLimits(7_000, 9_000)
DEFAULT_LIMITS = ProductLimits(200_000, 750_000)
