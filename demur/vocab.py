"""Fixed vocabularies of the benchmark.

Everything in this module is a fixed value: names that occur in the data and
therefore have to be spelled exactly like this for results to be comparable.
"""

from __future__ import annotations

# --- fixed values: perturbation grid -----------------------------------------
CLASSES = (
    "P-Ambiguity",
    "P-Contradiction",
    "P-MissingInfo",
    "P-FalsePremise",
    "P-GranularityMismatch",
    "P-EpistemicMismatch",
)
INTENSITIES = ("LOW", "MEDIUM", "HIGH")
CELLS = tuple((c, i) for c in CLASSES for i in INTENSITIES)
STRATA = tuple(f"{c}_{i}" for c, i in CELLS)

# --- fixed values: labels -----------------------------------------------------
ANSWER_LABEL = "ANSWER_CORRECTLY"
ATTEMPT = "answer_attempt"
ERROR = "ERROR"
REFUSAL_CODES = (
    "REFUSE_AMBIGUOUS_QUERY",
    "REFUSE_CONTRADICTORY_CONTEXT",
    "REFUSE_INFO_MISSING_IN_CONTEXT",
    "REFUSE_FALSE_PREMISE_IN_QUERY",
    "REFUSE_GRANULARITY_MISMATCH",
    "REFUSE_NONFACTUAL_QUERY",
    "REFUSE_OTHER",
)
# the six codes that belong to a perturbation class (REFUSE_OTHER belongs to none)
CLASS_CODES = REFUSAL_CODES[:6]
CODE_OF_CLASS = dict(zip(CLASSES, CLASS_CODES))

# what a class may modify, for one passage and for several passages
TARGET_SINGLE = {
    "P-Ambiguity": "Query<->Context",
    "P-Contradiction": "Context",
    "P-MissingInfo": "Context",
    "P-FalsePremise": "Query",
    "P-GranularityMismatch": "Query<->Context",
    "P-EpistemicMismatch": "Query<->Context",
}
TARGET_MULTI = {
    "P-Ambiguity": "Query/Context",
    "P-Contradiction": "Context",
    "P-MissingInfo": "Context",
    "P-FalsePremise": "Query",
    "P-GranularityMismatch": "Context",
    "P-EpistemicMismatch": "Context",
}

# --- fixed values: models -----------------------------------------------------
# verifier short name -> model id, in the order that decides "first verifier"
VERIFIER_IDS = {
    "claude": "bedrock/us.anthropic.claude-sonnet-4-20250514-v1:0",
    "nova": "bedrock/us.amazon.nova-pro-v1:0",
    "gpt": "openai/gpt-4o-2024-08-06",
    "deepseek": "bedrock/converse/us.deepseek.r1-v1:0",
}
VERIFIERS = tuple(VERIFIER_IDS)

# input folder -> generator full name, and full name -> short name
GENERATOR_FOLDERS = {
    "dataset_claude": "claude-sonnet-4",
    "dataset_deepseek": "deepseek-r1",
    "dataset_gpt": "gpt-4o",
    "dataset_nova": "amazon-nova-pro",
}
GENERATOR_SHORT = {
    "claude-sonnet-4": "claude",
    "deepseek-r1": "deepseek",
    "gpt-4o": "gpt",
    "amazon-nova-pro": "nova",
}

# --- fixed values: calibration ------------------------------------------------
# stated confidence level -> probability range
CONFIDENCE_RANGES = {
    "VERY_UNCERTAIN": (0.0, 0.3),
    "UNCERTAIN": (0.3, 0.5),
    "SOMEWHAT_CONFIDENT": (0.5, 0.7),
    "CONFIDENT": (0.7, 0.9),
    "VERY_CONFIDENT": (0.9, 1.0),
}

# --- fixed values: multi-document curation -------------------------------------
TARGET_DOMAINS = (
    "Science",
    "Health",
    "Business & Industrial",
    "Law & Government",
    "Finance",
)
SIGNAL_LABEL = "ANSWER-THE-QUESTION"
RELATED_LABEL = "RELATED-INFORMATION"
SIMPLE_COMPLEXITIES = ("Simple", "Simple w. condition", "Comparison", "Set")
STABLE_TYPES = ("SLOW-CHANGING", "")

# --- fixed values: sampling ----------------------------------------------------
SEED = 42
PER_STRATUM = 22
PER_GENERATOR = 400
PER_DOMAIN = 20
TOTAL_PASSAGES = 10
SIGNAL_PASSAGES = 5

# --- fixed values: field names of the model replies ----------------------------
GENERATOR_KEYS = (
    "perturbed_query",
    "perturbed_context",
    "lever_selected",
    "implementation_reasoning",
    "intensity_achieved",
    "answer_constraint_satisfied",
    "expected_rag_behavior",
)
GENERATOR_KEYS_MULTI = (
    "perturbed_query",
    "perturbed_signal_passages",
    "perturbed_noise_passages",
    "lever_selected",
    "implementation_reasoning",
    "intensity_achieved",
    "answer_constraint_satisfied",
    "expected_rag_behavior",
)
VERIFIER_KEYS = (
    "verification_result",
    "lever_correctly_implemented",
    "intensity_correctly_achieved",
    "target_correctly_modified",
    "uncertainty_successfully_induced",
    "implementation_quality_sound",
    "answer_constraint_satisfied",
    "ground_truth_alignment",
    "refusal_class_correct",
    "predicted_rag_behavior",
    "refusal_reasoning_analysis",
    "constraint_analysis",
    "identified_issues",
    "actual_intensity_observed",
    "final_ground_truth_label",
)
# the multi-document verifier is also asked whether the strategy was followed
VERIFIER_KEYS_MULTI = VERIFIER_KEYS + ("strategy_compliance",)
