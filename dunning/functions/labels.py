"""Label texts and thresholds: fixed values in their natural order.

They follow the reference's output, but for the word in its title, for which
the three late statuses and the limit explanation say "arrears" and "default".
"""

# Aging status labels, least to most severe.
STATUS_CURRENT = "Current (0-30 days)"
STATUS_EARLY = "Early Warning (31-60 days)"
STATUS_MODERATE = "Moderate Arrears (61-90 days)"
STATUS_HIGH = "High Arrears (91-120 days)"
STATUS_SEVERE = "Severe Arrears (+120 days)"
STATUSES = (STATUS_CURRENT, STATUS_EARLY, STATUS_MODERATE, STATUS_HIGH, STATUS_SEVERE)

# Risk segment labels, lowest to highest risk.
SEGMENT_LOW = "Low (0-30%)"
SEGMENT_MODERATE = "Moderate (30-60%)"
SEGMENT_HIGH = "High (60-80%)"
SEGMENT_EXTREME = "Extreme (80-100%)"
SEGMENTS = (SEGMENT_LOW, SEGMENT_MODERATE, SEGMENT_HIGH, SEGMENT_EXTREME)

# Per-segment action plan and follow-up frequency.
SEGMENT_ACTIONS = (
    (SEGMENT_LOW, "Automatic credit renewal", "Quarterly"),
    (SEGMENT_MODERATE, "Additional verification, reduced limit", "Monthly"),
    (SEGMENT_HIGH, "Guarantees required, advance payments", "Weekly"),
    (SEGMENT_EXTREME, "Preventive collection, cash payment", "Daily"),
)

# Words used for each segment inside the limit explanation.
SEGMENT_WORDS = (
    (SEGMENT_LOW, "low risk"),
    (SEGMENT_MODERATE, "moderate risk"),
    (SEGMENT_HIGH, "high risk"),
    (SEGMENT_EXTREME, "extreme risk"),
)

# Customer types for the what-if simulator and their risk factors.
CUSTOMER_TYPES = (("New", 1.2), ("Occasional", 1.1), ("Recurrent", 0.9), ("Preferred", 0.8))

# Payment method columns and their display names.
PAYMENT_METHODS = (("cash", "Cash"), ("cheque", "Cheque"), ("card", "Card"), ("transfer", "Transfer"))

# Aging bucket columns and their display names.
AGING_BUCKETS = (
    ("aging_0_30", "0-30 days"),
    ("aging_31_60", "31-60 days"),
    ("aging_61_90", "61-90 days"),
    ("aging_91_120", "91-120 days"),
    ("aging_over_120", "Over 120 days"),
)

# Compliance states of the weekly collection plan.
PLAN_PAID = "Paid"
PLAN_NOT_FULFILLED = "Planned - Not fulfilled"
PLAN_FUTURE = "\U0001F4C5 Planned"

NO_DATA = "No data"

# The sentence that explains a credit limit, part by part in its order.
EXPLANATION = {
    "customer": "Customer classified as ",
    "risk": ". Based on: Default risk of ",
    "history": "History of ",
    "payments": " payments with average $",
    "no_history": "No payment history",
    "seniority": "Seniority of ",
    "days": " days as customer",
    "new": "New customer",
    "behavior": "Current behavior: ",
    "average": " (average ",
    "overdue": " days overdue)",
    "advice": ". Recommendation: ",
    "reduce": "reduce",
    "keep": "maintain/increase",
    "limit": " limit.",
}

# Simulator risk bands (code, display label, 7 recommended actions).
SCENARIO_BANDS = (
    (
        "critical",
        "High Risk",
        (
            "Do not approve additional credit without solid guarantees",
            "Require advance payments (minimum 50%)",
            "Maximum term: 7 days",
            "Review complete payment history",
            "Consider preventive legal actions",
            "Reduce credit limit by 75%",
            "Daily case supervision",
        ),
    ),
    (
        "high",
        "High Risk",
        (
            "Reduce credit limit by 50%",
            "Require guarantor or guarantee",
            "Maximum term: 15 days",
            "Weekly follow-up",
            "Early payment discounts (max 5%)",
            "Require recent banking history",
            "Automated early alerts",
        ),
    ),
    (
        "moderate",
        "Moderate Risk",
        (
            "Maintain current limit or moderate increase (10-20%)",
            "Maximum term: 30 days",
            "Monthly follow-up",
            "Structured payment plans",
            "Automatic reminders at 5 and 2 days before",
            "Quarterly behavior review",
            "Consider guarantees for high amounts",
        ),
    ),
    (
        "low",
        "Low Risk",
        (
            "Consider line increase (20-30%)",
            "Flexible terms (up to 60 days)",
            "Semi-annual review",
            "Loyalty benefits (2% discount)",
            "Simplified approval process",
            "Include in preferred programs",
            "Evaluate special credits with preferential rates",
        ),
    ),
)
