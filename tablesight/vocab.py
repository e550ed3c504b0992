"""Controlled vocabularies and cut-offs shared by profiling, contract and validation jobs."""

# --- Fixed values: these must equal the published vocabulary for results to agree. ---

LOGICAL_TYPES = (
    "identifier", "categorical_code", "nominal_category", "ordinal_category", "boolean_flag",
    "date", "datetime", "numeric_measure", "free_text", "mixed_or_ambiguous",
)
STORAGE_TYPES = ("string", "integer", "decimal", "boolean", "date", "datetime")

# Logical type -> storage types it may use.
STORAGE_FOR_LOGICAL = {
    "identifier": ("string",),
    "categorical_code": ("string",),
    "nominal_category": ("string",),
    "ordinal_category": ("string",),
    "free_text": ("string",),
    "mixed_or_ambiguous": ("string",),
    "boolean_flag": ("boolean",),
    "date": ("date",),
    "datetime": ("datetime",),
    "numeric_measure": ("integer", "decimal"),
}

TRANSFORM_ACTIONS = (
    "trim_whitespace", "normalize_missing_tokens", "normalize_boolean_tokens", "cast_to_string",
    "cast_to_integer", "cast_to_decimal", "cast_to_date", "cast_to_datetime",
    "strip_numeric_formatting", "normalize_decimal_separator", "lowercase_values",
    "uppercase_values", "titlecase_values", "normalize_category_tokens",
    "extract_numeric_component", "strip_unit_suffix", "standardize_percent_scale",
)
STRUCTURAL_HINTS = (
    "split_multiselect_tokens", "requires_multiselect_modeling_decision",
    "split_range_into_start_end", "requires_range_semantics_review",
    "requires_unit_normalization_review", "requires_wide_to_long_review",
    "requires_child_table_review", "requires_multi_column_derivation",
    "requires_start_end_pair_review", "requires_codebook_or_label_mapping_review",
)
CHILD_FORBIDDEN_HINTS = ("requires_child_table_review", "requires_wide_to_long_review")
INTERPRETATION_HINTS = (
    "leading_zero_risk", "identifier_not_measure", "code_not_quantity",
    "time_index_not_identifier", "repeat_context_do_not_use_as_base_key",
    "skip_logic_protected", "mixed_content_high_risk", "free_text_high_cardinality",
    "numeric_parse_is_misleading", "light_contract_override_applied",
)

MISSINGNESS_DISPOSITIONS = (
    "no_material_missingness", "token_missingness_present", "structurally_valid_missingness",
    "partially_structural_missingness", "unexplained_high_missingness", "mixed_missingness_risk",
)
MISSINGNESS_HANDLING = (
    "no_action_needed", "protect_from_null_penalty", "retain_with_caution",
    "review_before_drop", "candidate_drop_review",
)
STRUCTURAL_VALIDITY = (
    "confirmed_structural", "plausible_structural", "not_structurally_explained", "not_applicable",
)
STRUCTURAL_DISPOSITIONS = ("structurally_valid_missingness", "partially_structural_missingness")

# Disposition -> handling values it may carry.
HANDLING_FOR_DISPOSITION = {
    "no_material_missingness": ("no_action_needed",),
    "token_missingness_present": ("retain_with_caution", "review_before_drop"),
    "structurally_valid_missingness": ("protect_from_null_penalty", "retain_with_caution"),
    "partially_structural_missingness": ("retain_with_caution", "review_before_drop"),
    "unexplained_high_missingness": ("candidate_drop_review", "review_before_drop"),
    "mixed_missingness_risk": ("retain_with_caution", "review_before_drop"),
}
# Disposition -> structural validity values it may carry.
VALIDITY_FOR_DISPOSITION = {
    "no_material_missingness": ("not_applicable", "not_structurally_explained"),
    "token_missingness_present": ("not_applicable", "not_structurally_explained", "plausible_structural"),
    "structurally_valid_missingness": ("confirmed_structural", "plausible_structural"),
    "partially_structural_missingness": ("plausible_structural",),
    "unexplained_high_missingness": ("not_structurally_explained",),
    "mixed_missingness_risk": ("not_structurally_explained", "plausible_structural"),
}

MODELING_STATUSES = (
    "base_field", "child_repeat_member", "reference_field", "event_field",
    "excluded_from_outputs", "unresolved",
)
ASSIGNMENT_ROLES = (
    "base_key", "base_attribute", "reference_key", "reference_attribute", "repeat_parent_key",
    "repeat_index", "melt_member", "reference_value", "exclude_from_outputs", "unresolved",
)
TABLELESS_ROLES = ("exclude_from_outputs", "unresolved")
TYPE_SOURCES = (
    "reviewed_type_worker", "scale_mapping_resolver", "family_default", "a17_baseline",
    "unresolved_no_a2_evidence",
)
STRUCTURE_SOURCES = ("table_layout_worker", "light_contract_fallback", "unresolved")
MISSINGNESS_SOURCES = (
    "reviewed_missingness_worker", "family_default", "a17_baseline", "unresolved_no_a2_evidence",
)
SEMANTIC_SOURCES = ("semantic_context_worker", "family_worker", "scale_mapping_resolver", "unknown")

PATCHABLE_STRING_ENUMS = {
    "canonical_modeling_status": MODELING_STATUSES,
    "canonical_assignment_role": ASSIGNMENT_ROLES,
    "recommended_logical_type": LOGICAL_TYPES,
    "recommended_storage_type": STORAGE_TYPES,
    "missingness_disposition": MISSINGNESS_DISPOSITIONS,
    "missingness_handling": MISSINGNESS_HANDLING,
}
PATCHABLE_STRINGS = (
    "canonical_table_name", "source_family_id", "semantic_meaning", "codebook_note",
    "normalization_notes",
)
PATCHABLE_LISTS = {
    "transform_actions": TRANSFORM_ACTIONS,
    "structural_transform_hints": STRUCTURAL_HINTS,
    "interpretation_hints": INTERPRETATION_HINTS,
}
PATCHABLE_NUMBERS = ("confidence",)
PATCHABLE_BOOLEANS = ("needs_human_review",)
PATCHABLE_FIELDS = (
    *PATCHABLE_STRING_ENUMS, *PATCHABLE_STRINGS, *PATCHABLE_LISTS,
    *PATCHABLE_NUMBERS, *PATCHABLE_BOOLEANS,
)
SUMMARY_COUNTS = (
    "total_source_columns", "included_column_count", "excluded_column_count",
    "unresolved_column_count", "reviewed_override_count", "family_default_count",
    "deterministic_baseline_count", "reviewed_type_count", "fallback_type_count",
)

TABLE_KINDS = ("base_entity", "child_repeat", "reference_lookup", "event_table")
SOURCE_BASIS_KINDS = (
    "primary_grain", "accepted_reference", "accepted_family", "reference_block", "residual_grouping",
)
FAMILY_LIKE_BASIS = ("accepted_family", "residual_grouping")
BUILD_STRATEGIES = ("direct_select", "wide_to_long_family", "reference_extract", "event_projection")
MODEL_SHAPES = (
    "single_base_table", "base_plus_references", "base_plus_children",
    "base_plus_references_plus_children", "mixed_with_reference_tables",
)
ANALYSIS_TABLE_KINDS = ("long_response_table", "score_table", "analysis_mart", "reference_passthrough")
ANALYSIS_STRATEGIES = (
    "merge_sibling_families_with_wave", "aggregate_scores", "join_reference_and_score",
    "assemble_analysis_mart", "pass_through",
)
DERIVATION_KINDS = ("family_merge", "answer_key_scoring", "score_aggregation", "analysis_mart_join")
NULL_POLICIES = (
    "preserve_structural_missing", "exclude_from_score", "treat_as_incorrect", "needs_review",
)
FAMILY_ROLES = (
    "repeated_survey_block", "repeated_measure_set", "event_sequence",
    "answer_key_or_reference_block", "other_repeat_family",
)
FAMILY_HANDLING = ("retain_as_child_table", "retain_with_review", "needs_manual_confirmation")
GRAIN_TYPES = ("single_column", "composite", "no_clear_key")
REFERENCE_KINDS = (
    "descriptive_entity", "code_list", "answer_key_or_lookup", "external_entity", "other_reference",
)
RELATIONSHIPS = ("many_to_one", "one_to_one", "unknown")
TABLE_PLAN_STATUSES = ("recommended", "candidate")
FAMILY_REVIEW_STATUSES = ("confirm_detected", "needs_user_input")
ANSWER_TYPES = ("boolean", "enum", "free_text")
ENCODING_HINTS = ("wide_or_mixed", "likely_long_or_simple", "unknown")
SCALE_TARGET_KINDS = ("family", "column")
SCALE_STATUSES = ("codebook_confirmed", "unresolved")
SCALE_SKIP_REASONS = ("no_mapping_evidence",)
SEMANTIC_KINDS = (
    "condition_column", "status_or_flag", "code_column", "family_context", "date_or_phase_context",
    "business_key_context", "placeholder_value_context", "other",
)
SEMANTIC_SKIP_REASONS = ("light_contract_accepted", "blank_semantic_input")
RETENTION_DAYS = 14

# --- Values of our own choosing (the published material names the feature, not the number). ---

MISSING_TOKENS = ("na", "n/a", "null", "none", "nan", "missing", "-", "?", "unknown")
TRUE_TOKENS = ("y", "yes", "true", "t", "1")
FALSE_TOKENS = ("n", "no", "false", "f", "0")
HIGH_MISSING_PCT = 40.0
TYPE_SHARE = 0.95
MULTI_SHARE = 0.5
LOW_CARDINALITY = 50
LOW_UNIQUE_RATIO = 0.2
CODED_LEVELS = 12
ANCHOR_SHARE = 0.5
DRIFT_DISTANCE = 0.2
SKIP_EXPLAINED_PCT = 90.0
SKIP_SHARE = 0.95
MASTER_SWITCH_TARGETS = 5
BASELINE_SHARE_FLAG = 0.4
