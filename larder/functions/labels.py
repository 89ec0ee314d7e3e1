"""Labels, cut-offs and constants that results must carry exactly."""

# Value classes by running share of total value, in percent.
ABC_BANDS = (
    (80, "A - High Value (Top 80%)"),
    (95, "B - Medium Value (80-95%)"),
)
ABC_REST = "C - Low Value (Bottom 5%)"

# Turns per year.
TURNOVER_BANDS = ((12, "Fast Moving"), (6, "Medium Moving"), (2, "Slow Moving"))
TURNOVER_REST = "Very Slow / Obsolete"

# Days of stock.
STOCK_NO_SALES = "No Sales (Obsolete)"
STOCK_BANDS = ((180, "Excess (>180 days)"), (90, "Slow Moving (90-180 days)"))
STOCK_REST = "Normal"
STOCK_DAYS_UNKNOWN = 999.0

# Coefficient of variation in percent.
VOLATILITY_BANDS = (
    (100, "Very High Volatility"),
    (50, "High Volatility"),
    (25, "Medium Volatility"),
)
VOLATILITY_REST = "Low Volatility"

# Supplier tiers.
TIER_1 = "Tier 1 - Excellent"
TIER_2 = "Tier 2 - Good"
TIER_3 = "Tier 3 - Acceptable"
TIER_4 = "Tier 4 - Poor (Review Required)"
# On-time percent and quality percent, from purchase orders.
ORDER_TIERS = ((95, 98, TIER_1), (85, 95, TIER_2), (70, 90, TIER_3))
# On-time rate and quality rating, from master data.
MASTER_TIERS = ((0.95, 4.5, TIER_1), (0.85, 4.0, TIER_2), (0.70, 3.5, TIER_3))
# The same for charts, where the third tier does not look at quality.
CHART_TIERS = ((0.95, 4.5, "Tier 1"), (0.85, 4.0, "Tier 2"), (0.70, 0.0, "Tier 3"))
CHART_TIER_REST = "Tier 4"

# Standard deviation of lead time in days.
LEAD_TIME_BANDS = ((20, "High Variability"), (10, "Medium Variability"))
LEAD_TIME_REST = "Low Variability"

# Fill rate in percent.
SERVICE_BANDS = ((95, "Meeting Target (>=95%)"), (90, "Below Target (90-95%)"))
SERVICE_REST = "Critical (<90%)"

# Share of stockouts due to late deliveries, in percent.
CAUSE_BANDS = ((70, "Supplier Issue"), (30, "Mixed (Supplier + Forecast)"))
CAUSE_REST = "Forecast Error"

# Warehouse use in percent of capacity.
WAREHOUSE_LOW = (50, "Underutilized - Consolidation Candidate")
WAREHOUSE_HIGH = (90, "Over Capacity - Expansion Needed")
WAREHOUSE_REST = "Optimal Utilization"

# Warehouse use as a rate, for charts.
UTILIZATION_BANDS = ((0.90, "Over Capacity"), (0.70, "Optimal"), (0.50, "Acceptable"))
UTILIZATION_REST = "Underutilized"

# Loss probability.
RISK_BANDS = ((0.7, "HIGH RISK"), (0.4, "MEDIUM RISK"))
RISK_REST = "LOW RISK"

# Costs in currency units.
ORDER_COST = 50
DEFECT_COST = 50
LATE_COST = 500
