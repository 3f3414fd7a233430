"""Fixed values shared by the operators."""

# Hazard ranks from lowest to highest.
RISK_ORDER = ("very_low", "low", "moderate", "high", "very_high")

# Members of the screening group.
HIGH_RISK = ("high", "very_high")

# Class names used when a dataset card declares none.
DEFAULT_CLASSES = (
    "high",
    "low",
    "moderate",
    "non-burnable",
    "very_high",
    "very_low",
    "water",
)

# Split names.
SPLITS = ("train", "validation", "test")

# Scalars of one evaluation, in report order.
SCALARS = (
    "accuracy",
    "balanced_accuracy",
    "macro_f1",
    "weighted_f1",
    "nll",
    "brier",
    "ece",
)

# Metrics compared across training seeds.
REPORT_METRICS = (
    "accuracy",
    "balanced_accuracy",
    "macro_f1",
    "weighted_f1",
    "macro_auroc",
    "nll",
    "brier",
    "ece",
    "high_risk_recall",
)

ECE_BINS = 15
PROBABILITY_FLOOR = 1e-15
TEMPERATURE_BOUNDS = (0.05, 20.0)
FORMAT_VERSION = 1

# Texts of the documents that other readers of runs expect.
BOOTSTRAP_METHOD = "stratified percentile bootstrap"
ENSEMBLE_NAME = "equal_weight_probability_ensemble"
CONFIDENCE_LEVEL = 0.95
