"""Constants of the case model.

Everything under "fixed values" must equal the reference application's
settings for results to agree; it is stated here once, in natural order.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# fixed values (must match the reference for identical results)
# ---------------------------------------------------------------------------
RISK_LOW_CUT = 0.40          # p < 0.40 -> Low
RISK_MEDIUM_CUT = 0.70       # p < 0.70 -> Medium, else High

AGE_BINS = [0, 12, 18, 35, 50, 65, 80, 120]
AGE_LABELS = ["Child", "Teen", "Young Adult", "Adult", "Older Adult", "Senior", "Elderly"]

POLYPHARMACY_THRESHOLD = 5
ELDERLY_THRESHOLD = 65
ADULT_THRESHOLD = 40         # profile: Adult from here, Young below

# explanation rules: feature, least value that triggers it, weight (in this order on ties)
RULES = [("drug_count", 5, 0.6), ("unique_drug_count", 5, 0.6), ("reaction_count", 3, 0.6), ("polypharmacy", 1, 1.0), ("elderly", 1, 1.0),
         ("drug_repeat_flag", 1, 0.6), ("risk_score", 50, 1.0), ("age", 65, 0.6)]
# feature intensity: (value - start) / span, within 0 and 1
INTENSITY = {"age": (40.0, 50.0), "drug_count": (0.0, 15.0), "unique_drug_count": (0.0, 12.0), "reaction_count": (0.0, 10.0), "risk_score": (0.0, 80.0)}

MAX_TRAIN_ROWS = 70000
TEST_SIZE = 0.3
VALIDATION_SPLIT = 0.5
RANDOM_STATE = 42
N_CLUSTERS = 3
THRESHOLD_GRID_START = 0.2
THRESHOLD_GRID_END = 0.81
THRESHOLD_GRID_STEP = 0.02
PERMUTATION_REPEATS = 5

FEATURE_COLS = [
    "age",
    "sex_code",
    "drug_count",
    "unique_drug_count",
    "drug_repeat_flag",
    "reaction_count",
    "polypharmacy",
    "elderly",
    "risk_score",
]

FEATURE_LABELS = {
    "age": "Age",
    "sex_code": "Sex",
    "drug_count": "Drug count",
    "unique_drug_count": "Unique drug count",
    "drug_repeat_flag": "Repeated drug entries",
    "reaction_count": "Reaction count",
    "polypharmacy": "Polypharmacy",
    "elderly": "Elderly patient",
    "risk_score": "Composite risk score",
}

# drug names treated as missing after upper(strip())
MISSING_DRUG_NAMES = ["", "NAN", "UNK", "UNKNOWN"]

# composite risk score: (column, clip upper bound, weight)
RISK_SCORE_TERMS = [
    ("age", 100.0, 25.0),
    ("drug_count", 20.0, 30.0),
    ("unique_drug_count", 20.0, 15.0),
    ("reaction_count", 10.0, 20.0),
]
POLYPHARMACY_POINTS = 7
REPEAT_POINTS = 3

# explanation
DRIVER_FEATURES = [
    "risk_score",
    "drug_count",
    "unique_drug_count",
    "reaction_count",
    "age",
    "polypharmacy",
    "elderly",
    "drug_repeat_flag",
]
EXPLAIN_TOP_N = 4

ACTIONS = {
    "High": (
        "Immediate attention",
        "High",
        "Prioritize review, validate case details, and consider escalation for safety assessment.",
    ),
    "Medium": (
        "Review",
        "Medium",
        "Review contributing factors and monitor for additional seriousness indicators.",
    ),
    "Low": (
        "Monitor",
        "Low",
        "Continue routine monitoring unless new risk factors appear.",
    ),
}

# source tables and the columns each one must provide (first match wins)
SOURCE_COLUMNS = {
    "demo": {"primaryid": ["primaryid"], "age": ["age"], "sex": ["sex", "gender"]},
    "drug": {"primaryid": ["primaryid"], "drugname": ["drugname"]},
    "outc": {"primaryid": ["primaryid"]},
    "reac": {"primaryid": ["primaryid"]},
}
QUALITY_MONITORED = {
    "DEMO": ["primaryid", "age", "sex"],
    "DRUG": ["primaryid", "drugname"],
    "OUTC": ["primaryid", "outc_cod"],
    "REAC": ["primaryid", "pt"],
}
SUMMARY_FEATURES = ["age", "drug_count", "unique_drug_count", "reaction_count", "risk_score"]
CORRELATION_COLS = [
    "age",
    "sex_code",
    "drug_count",
    "unique_drug_count",
    "reaction_count",
    "risk_score",
    "serious",
    "polypharmacy",
    "elderly",
]

CASE_COLUMNS = [
    "primaryid",
    "age",
    "sex",
    "drug_count",
    "unique_drug_count",
    "drug_repeat_flag",
    "reaction_count",
    "serious",
    "polypharmacy",
    "elderly",
    "age_group",
    "sex_code",
    "risk_score",
    "severity_label",
]

MODEL_NAMES = ["ANN (MLPClassifier)", "Logistic Regression", "Decision Tree", "Random Forest"]

# ---------------------------------------------------------------------------
# fixed values: texts (must match the reference word for word)
# Templates use Python format fields; numbers are rendered with Python's rules.
# ---------------------------------------------------------------------------
SEVERITY_LABELS = {0: "Non-serious", 1: "Serious"}
RISK_LEVELS = ["Low", "Medium", "High"]
CONFIDENCE_LEVELS = ["High", "Moderate", "Low"]
PROFILE_AGE_BANDS = ["Elderly", "Adult", "Young"]
WHAT_IF_DIRECTIONS = ["Increase", "Decrease", "No material change"]
PREDICTION_RESULTS = ["Correct", "Mismatch"]

VALIDATION_MESSAGES = {
    "missing_columns": "Missing required columns: {missing}",
    "no_sex": "Must include either 'sex' or 'sex_code' column.",
    "not_numeric": "Age and drug_count must contain numeric values.",
    "age_range": "Age values must be between 1 and 119.",
    "negative_drugs": "Drug count cannot be negative.",
    "no_valid_sex": "Sex values must contain at least one valid 'F' or 'M' entry.",
    "passed": "Data validation passed.",
}

INTERPRETATION_TEXT = {
    "high_burden": "high drug burden increases risk",
    "elderly": "age-related vulnerability in elderly patients raises adverse-event risk",
    "no_flags": "no strong risk flags were detected from age and drug burden",
    "elevated": "Risk is elevated due to {parts}.",
    "lower": "Risk appears lower because {part}.",
}

STORY_TEXT = {
    "flow": "Age {age} + Drug Count {drug_count} → {risk} Risk",
    "high_load": "high medication load",
    "age_vulnerability": "age-related vulnerability",
    "balanced": "balanced age and medication profile",
}

INSIGHT_TEXT = ("**AI Insight:** Based on the patient's profile, the system detects **{risk} risk** "
                "driven by {because}. Closer monitoring may be required if risk factors persist.")
DECISION_TEXT = ("**AI Decision Summary**  \nRisk level: **{risk}** | Predicted label: **{label}** | "
                 "Risk confidence: **{confidence:.2f}%**  \nKey drivers: **{drivers}**  \n{interpretation}")
NO_DRIVERS_TEXT = "No major risk drivers"

DRIVER_MESSAGES = {
    "drug_count": "drug count is high ({value:.0f} drugs)",
    "unique_drug_count": "unique medication burden is high ({value:.0f} unique drugs)",
    "reaction_count": "reaction count is elevated ({value:.0f} reactions)",
    "polypharmacy": "polypharmacy is detected",
    "elderly": "the patient is in an elderly age band",
    "drug_repeat_flag": "the case contains repeated drug entries",
    "risk_score": "composite risk score is elevated ({value:.1f})",
    "age": "age is elevated ({value:.0f} years)",
}
DRIVER_MESSAGE_OTHER = "{label} is {value}"
QUANTIFIED_MESSAGE = "{message} ({impact:.1f}% of explanation weight)"
EXPLANATION_SUMMARY = "This case is {risk} risk because {drivers}."
EXPLANATION_NO_DRIVERS = "This case is {risk} risk with no strong rule-based risk flags from the available features."

CLINICAL_INSIGHTS = {
    "polypharmacy": ("Polypharmacy is associated with {phrase} versus non-polypharmacy cases "
                     "({rate_true:.1f}% vs {rate_false:.1f}%, {delta:+.1f} percentage points)."),
    "elderly": ("Elderly status is associated with {phrase} versus non-elderly patients "
                "({rate_true:.1f}% vs {rate_false:.1f}%, {delta:+.1f} percentage points)."),
    "high_reaction": ("Cases with at least {cutoff:.0f} reactions show {phrase} compared with lower-reaction cases "
                      "({rate_true:.1f}% vs {rate_false:.1f}%)."),
    "drug_repeat": ("Repeated drug entries appear in {share:.1f}% of cases; they are associated with {phrase} "
                    "versus non-repeated drug lists ({rate_true:.1f}% vs {rate_false:.1f}%)."),
    "overall": "The current filtered cohort has an overall serious outcome rate of {overall:.1f}%.",
}
RELATIVE_PHRASE = "{rel:+.1f}% relative risk change"
UNDEFINED_RELATIVE_PHRASE = ("an undefined relative increase because the comparison group has "
                             "0.0% serious outcomes")

MODEL_DIGEST = {
    "f1": "{model} is the most balanced model by F1-score ({value:.3f}).",
    "recall": "{model} has the strongest serious-case capture with recall {value:.3f}.",
    "precision": "{model} is the most selective model with precision {value:.3f}.",
    "roc_auc": "{model} separates serious and non-serious cases best by ROC-AUC ({value:.3f}).",
    "low_threshold": "Low selected thresholds for {models} indicate the system is prioritizing recall over precision.",
}
EMPTY_SEGMENT_TEXT = "No patients in segment"
UPLOAD_SOURCE_NAME = "Uploaded CSV"
# ---------------------------------------------------------------------------


def threshold_grid() -> list[float]:
    """The 31 decision thresholds, generated the way a NumPy ``arange`` does.

    ``arange`` computes ``start + i * delta`` with ``delta = (start + step) - start``,
    which drifts from ``start + i*step`` in the last bits; ties on 2-decimal
    scores depend on those bits, so the grid is reproduced value for value.
    """
    import math

    start, stop, step = THRESHOLD_GRID_START, THRESHOLD_GRID_END, THRESHOLD_GRID_STEP
    n = int(math.ceil((stop - start) / step))
    delta = (start + step) - start
    return [start + i * delta for i in range(n)]
