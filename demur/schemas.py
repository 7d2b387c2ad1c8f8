"""Explicit schemas of the records the engine reads and writes. Nothing is inferred."""

from __future__ import annotations

# base question, one passage
BASE_INSTANCE = (
    "line_no bigint, qid string, query string, answer array<string>, gold_docs array<string>, "
    "retrieved_docs array<string>, retrieved_docs_ids array<string>"
)

# base question, several labelled passages
MULTI_INSTANCE = (
    "line_no bigint, sample_id string, question string, answer_generate string, answer_validate string, "
    "question_category string, question_type string, question_complexity string, question_popularity string, "
    "topic_tag string, question_tag string, grounding array<map<string,string>>, evidence_correct array<string>, "
    "evidence_cited array<string>, evidence_relevant array<string>, "
    "curation_notes struct<source_dataset:string,status:string,passages_normalized_to:int,normalization_strategy:string>"
)

# rewrite of a single-passage question
REWRITE = (
    "line_no bigint, source_qid string, source_line bigint, original_query string, original_context string, "
    "original_answers array<string>, perturbation_class string, intensity string, generation_successful boolean, "
    "parsing_successful boolean, perturbed_query string, perturbed_context string, lever_selected string, "
    "implementation_reasoning string, intensity_achieved string, answer_constraint_satisfied string, "
    "expected_rag_behavior string, error string, raw_response string"
)

_VERDICT_FIELDS = {
    "verification_result": "string",
    "lever_correctly_implemented": "boolean",
    "intensity_correctly_achieved": "boolean",
    "target_correctly_modified": "boolean",
    "strategy_compliance": "boolean",
    "uncertainty_successfully_induced": "boolean",
    "implementation_quality_sound": "boolean",
    "answer_constraint_satisfied": "boolean",
    "ground_truth_alignment": "boolean",
    "refusal_class_correct": "boolean",
    "predicted_rag_behavior": "string",
    "refusal_reasoning_analysis": "string",
    "constraint_analysis": "string",
    "identified_issues": "array<string>",
    "actual_intensity_observed": "string",
    "final_ground_truth_label": "string",
    "parsing_successful": "boolean",
}
VERDICT = ", ".join(f"{n} {t}" for n, t in _VERDICT_FIELDS.items())
_VERDICT_STRUCT = "struct<" + ",".join(f"{n}:{t}" for n, t in _VERDICT_FIELDS.items()) + ">"

# one verifier's verdict on a rewrite
VERIFICATION = (
    REWRITE + ", verification_model string, verification_successful boolean, verification_error string, "
    "verification_response " + _VERDICT_STRUCT
)

_PATCHES = "array<struct<original_index:int,perturbed_text:string>>"
_MULTI_STRUCT = "struct<" + ",".join(f.strip().replace(" ", ":", 1) for f in MULTI_INSTANCE.split(", ")[1:]) + ">"

# reversible rewrite of a multi-passage question
MULTI_REWRITE = (
    f"line_no bigint, original_data {_MULTI_STRUCT}, passage_mapping struct<signal_indices:array<int>,noise_indices:array<int>>, "
    "perturbation_metadata struct<perturbation_class:string,intensity:string,generation_successful:boolean,source_qid:string,"
    "source_line:bigint,generation_timestamp:string>, "
    f"perturbation_results struct<perturbed_query:string,perturbed_signal_passages:{_PATCHES},perturbed_noise_passages:{_PATCHES},"
    "lever_selected:string,implementation_reasoning:string,intensity_achieved:string,answer_constraint_satisfied:string,"
    "expected_rag_behavior:string,parsing_successful:boolean,error:string,raw_response:string>"
)
MULTI_VERIFICATION = (
    MULTI_REWRITE + ", verification_model string, verification_successful boolean, verification_error string, "
    "verification_response " + _VERDICT_STRUCT
)

# evaluation results as CSV; pandas writes nullable integers as decimals, so they are read as double
RESULTS_SINGLE = (
    "model_id string, entry_idx bigint, unique_id string, generator_model string, perturbation_class string, intensity string, "
    "query string, ground_truth_label string, ground_truth_answer string, model_raw_output string, model_predicted_type string, "
    "answer_quality_score double, refusal_match_correct boolean, llm_evaluation_explanation string"
)
RESULTS_MULTI = (
    "model_id string, entry_idx bigint, sample_id string, original_sample_id string, query string, model_answer string, "
    "judge_explanation string, expected_behavior string, perturbation_class string, intensity string, generator_model string, "
    "lever_selected string, is_answerable boolean, question_category string, topic_tag string, question_tag string, "
    "question_type string, question_complexity string, question_popularity string, source_dataset string, "
    "refusal_classification string, eligibility_score double, unadjusted_factuality_score double, raf_score double, "
    "refusal_match_correct boolean, false_refusal boolean, missed_refusal boolean"
)
RESPONSES = "request_id string, response string, error string"
