"""These must equal the source system's for results to agree."""

# Sensor bands per type: alert range, warn range, display range.
SENSOR_BANDS = [
    # sensor_type, alert_min, alert_max, warn_min, warn_max, disp_min, disp_max
    ("temperature", 12.0, 30.0, 15.0, 27.0, 5.0, 40.0),
    ("humidity", 40.0, 95.0, 50.0, 90.0, 20.0, 100.0),
    ("soil_moisture", 35.0, 97.0, 50.0, 88.0, 20.0, 100.0),
    ("light", 80.0, 650.0, 150.0, 500.0, 0.0, 800.0),
    ("co2", 350.0, 2200.0, 600.0, 1600.0, 250.0, 2500.0),
    ("ph", 4.0, 8.5, 5.0, 7.0, 3.5, 9.0),
    ("ec", 0.3, 4.5, 0.8, 3.2, 0.0, 6.0),
]

# Grow input that drives the cost of each crop type.
CROP_INPUTS = [
    ("lettuce", "rockwool"),
    ("basil", "rockwool"),
    ("kale", "rockwool"),
    ("arugula", "rockwool"),
    ("spinach", "rockwool"),
    ("herb", "rockwool"),
    ("asian-green", "rockwool"),
    ("microgreens", "coco_coir"),
]

# Model input columns, in model order.
FEATURES = [
    "usd_per_gram", "pack_size_g", "lead_time_days", "min_qty",
    "on_time_pct", "quality_score",
    "demand_1h_trays", "input_pct_24h", "organic_cert_int",
]

# Values a missing feature takes.
FEATURE_DEFAULTS = {
    "demand_1h_trays": 0,
    "input_pct_24h": 0.0,
    "on_time_pct": 0.85,
    "quality_score": 0.85,
    "organic_cert_int": 0.0,
}

# Weights of the procurement score terms.
SCORE_WEIGHTS = {
    "price": 0.30,
    "pack": 0.10,
    "lead": 0.15,
    "reliability": 0.20,
    "urgency": 0.10,
    "trend": 0.10,
    "organic": 0.05,
}

# Weights of the supplier onboarding rubric.
ONBOARD_WEIGHTS = {"relevance": 0.40, "organic": 0.25, "years": 0.20, "country": 0.15}

# Catalogue words the onboarding rubric looks for.
CATALOGUE = ["lettuce", "basil", "kale", "microgreens", "herbs", "arugula", "asian greens"]

MONTHLY_BUDGET_USD = 25000.0
SEED_CATEGORY = "SEED"

DECISIONS = ["BUY_NOW", "WAIT", "REVIEW"]
PO_DRAFT_STATUSES = ["DRAFT", "APPROVED", "REJECTED", "SENT", "RECEIVED"]
APPLICATION_STATUSES = ["NEW", "SCREENING", "APPROVED", "REJECTED"]
REPLY_INTENTS_FOR_PO = ["QUOTE", "ACCEPT", "COUNTER"]
OPEN_APPLICATIONS = ["NEW", "SCREENING"]
