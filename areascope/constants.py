"""Configuration values of the analytics engine.

Everything below the "fixed values" marker must stay equal to the published
behaviour of the original application (names, thresholds, texts), otherwise
results stop being comparable. Tunables for Spark itself live in ``session``.
"""

from __future__ import annotations

AREA = ["state", "district", "pincode"]
KEYS = ["year_month"] + AREA

# ---------------------------------------------------------------------------
# Fixed values (must equal the original application's values)
# ---------------------------------------------------------------------------

# Deprecated or variant state spellings -> canonical name (exact whole value).
STATE_ALIASES = {
    "orissa": "odisha",
    "pondicherry": "puducherry",
    "uttaranchal": "uttarakhand",
    "dadra and nagar haveli": "dadra and nagar haveli and daman and diu",
    "daman and diu": "dadra and nagar haveli and daman and diu",
    "jammu & kashmir": "jammu and kashmir",
    "jammu and kasmir": "jammu and kashmir",
    "kasmir": "jammu and kashmir",
}

# The 28 states and 8 union territories, lower case.
VALID_STATES = [
    "andhra pradesh", "arunachal pradesh", "assam", "bihar", "chhattisgarh",
    "goa", "gujarat", "haryana", "himachal pradesh", "jharkhand", "karnataka",
    "kerala", "madhya pradesh", "maharashtra", "manipur", "meghalaya",
    "mizoram", "nagaland", "odisha", "punjab", "rajasthan", "sikkim",
    "tamil nadu", "telangana", "tripura", "uttar pradesh", "uttarakhand",
    "west bengal",
    "andaman and nicobar islands", "chandigarh",
    "dadra and nagar haveli and daman and diu", "delhi", "jammu and kashmir",
    "ladakh", "lakshadweep", "puducherry",
]

# Raw measure column -> common measure name, per feed.
RAW_MEASURES = {
    "bio": {"bio_age_5_17": "updates_age_5_17", "bio_age_17_": "updates_age_18_plus"},
    "demo": {"demo_age_5_17": "updates_age_5_17", "demo_age_17_": "updates_age_18_plus"},
    "enrol": {
        "age_0_5": "enrollments_age_0_5",
        "age_5_17": "enrollments_age_5_17",
        "age_18_greater": "enrollments_age_18_plus",
    },
}

CAP_PERCENTILE = 0.99
REPORT_PERCENTILE = 0.95
MIN_CLUSTERS = 3
MAX_CLUSTERS = 8
KMEANS_SEED = 42
KMEANS_N_INIT = 10
FOREST_TREES = 100
FOREST_CONTAMINATION = 0.10
FOREST_MAX_SAMPLES = 256
FOREST_SEED = 42
ROLLING_WINDOW = 3
ZSCORE_THRESHOLD = 2.0
DROP_THRESHOLD = -0.30
SPIKE_THRESHOLD = 0.50
MIN_QUALITY_SCORE = 50.0
RISK_CRITICAL_PCT = 0.05
RISK_MEDIUM_PCT = 0.15
RISK_LOW_PCT = 0.30
PROFILE_TOP_SHARE = 0.2
INSIGHT_LOW = 0.5
INSIGHT_HIGH = 1.5
PINCODE_TREND_UP = 1.2
PINCODE_TREND_DOWN = 0.8
OVERALL_TREND_PCT = 10.0
DATA_VERSION = "v1.0_cleaned"
MODEL_VERSION = "v1.0.0"

# Profile id -> (name, description, policy action). Unknown ids use profile 2.
CLUSTER_PROFILES = {
    0: ("High Activity - Well Maintained",
        "Regions with consistently high Aadhaar service activity across all categories",
        "Maintain current service levels; can serve as model regions"),
    1: ("Update-Heavy - Established",
        "Regions with high update activity relative to new enrollments",
        "Focus on maintaining biometric update infrastructure"),
    2: ("Enrollment-Focused - Growing",
        "Regions with high new enrollment activity, lower updates",
        "Plan for increased update demand in 3-5 years"),
    3: ("Low Activity - At Risk",
        "Regions with consistently low Aadhaar service activity",
        "Investigate barriers; consider mobile enrollment camps"),
    4: ("Volatile - Unstable",
        "Regions with high month-to-month variability in service usage",
        "Stabilize service delivery; investigate seasonal patterns"),
}
DEFAULT_PROFILE = 2

RISK_EXPLANATIONS = {
    "CRITICAL": "Severe service gap detected. Immediate attention required.",
    "HIGH": "Significant deviation from expected service patterns.",
    "MEDIUM": "Moderate service concerns. Monitor closely.",
    "LOW": "Minor variations from normal patterns.",
    "NORMAL": "Service activity within expected range.",
}
RISK_LEVELS = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "NORMAL"]
TREND_LEVELS = ["DECLINING", "SURGING", "UNUSUAL", "STABLE"]

REASON_BELOW_DISTRICT = "Activity significantly below district average"
REASON_NO_BIO = "No biometric updates recorded"
REASON_NO_ENROL = "No new enrollments recorded"
REASON_DROP = "Sharp decline in activity (>30% drop)"
REASON_SPIKE = "Unusual activity spike (>50% increase)"
REASON_NONE = "No specific concerns"
INSIGHT_BELOW = "Below district average activity"
INSIGHT_ABOVE = "Above district average activity"

# Place names that betray a city typed into the state column (substring, case-sensitive).
SUSPICIOUS_PLACES = ["Jaipur", "Nagpur", "Delhi", "Chandigarh", "Darbhanga", "Madanapalle",
                     "Puttenahalli", "Raja", "Balanagar"]

# Deprecated state names reported by the profiler (exact case) -> current name.
DEPRECATED_STATES = {"Orissa": "Odisha", "Pondicherry": "Puducherry", "Uttaranchal": "Uttarakhand"}

# The fifteen model features, in order.
FEATURE_COLUMNS = [
    "total_bio_updates", "total_demo_updates", "total_enrollments", "total_activity",
    "bio_ratio", "demo_ratio", "enrol_ratio", "update_to_enrol_ratio",
    "activity_vs_district_mean",
    "total_activity_mom_growth", "total_activity_rolling_avg", "total_activity_volatility",
    "quality_weight", "child_enrol_proportion", "bio_child_proportion",
]

OUTPUT_FILES = [
    "ml_full_output.csv", "cluster_summary.csv", "high_risk_regions.csv",
    "monthly_alerts.csv", "state_summary.csv",
]

# CSV tokens pandas reads as missing.
NULL_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
               "NULL", "NaN", "None", "n/a", "nan", "null"]
