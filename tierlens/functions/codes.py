"""Reason codes of the decision stages: fixed values that users filter on."""

# fixed value: a decoded character that its tier can't have
WRONG_GLYPH = "DECODED_UNSUPPORTED_OR_WRONG_TIER_GLYPH"

# fixed values: segmentation (D1) and recognition (E1)
D1_NO_SAFE_PROPOSAL = "D1_NO_SAFE_PROPOSAL"
D1_PROPOSAL_E1_OUTPUT = "D1_PROPOSAL_E1_OUTPUT"
D1_OR_OCR_NOT_READY = "D1_OR_OCR_NOT_READY"
D1_ROLE_CONFIDENCE_NOT_SUPPORTED = "D1_ROLE_CONFIDENCE_NOT_SUPPORTED"
D1_REJECTION_PRESENT = "D1_REJECTION_PRESENT"
D1_ROW_TIER_METADATA_CONFLICT = "D1_ROW_TIER_METADATA_CONFLICT"
D1_CROP_METADATA_CONFLICT = "D1_CROP_METADATA_CONFLICT"
D1_PATH_ROLE_CONFLICT = "D1_PATH_ROLE_CONFLICT"

# fixed values: role-aware interpretation (T1)
T1_DISABLED = "T1_DISABLED"
T1_MISSING_OR_UNKNOWN_ROLE = "T1_MISSING_OR_UNKNOWN_ROLE"
T1_CONFLICTING_EVIDENCE = "T1_CONFLICTING_EVIDENCE"
T1_ROLE_NOT_RELIABLY_ESTABLISHED = "T1_ROLE_NOT_RELIABLY_ESTABLISHED"
T1_NO_VERIFIED_ROLE_EQUIVALENT = "T1_NO_VERIFIED_ROLE_EQUIVALENT"
T1_MULTIPLE_ROLE_EQUIVALENTS = "T1_MULTIPLE_ROLE_EQUIVALENTS"
T1_RESULT_NOT_ROLE_LEGAL = "T1_RESULT_NOT_ROLE_LEGAL"
T1_VERIFIED_GLYPH_ROLE_DISAMBIGUATION = "T1_VERIFIED_GLYPH_ROLE_DISAMBIGUATION"
T1_NO_CHANGE_NEEDED = "T1_NO_CHANGE_NEEDED"
T1_CONTEXT_UNCERTAIN = "T1_CONTEXT_UNCERTAIN"
VERIFIED_IN_SCOPE = "verified_exact_in_scope"
CANONICAL_RENDERING = "canonical_source_rendering_metadata"

# fixed values: count gaps (R2), alignment of texts (R3) and measured positions (R3.1)
R2_INTERNAL_DECODED_COUNT_GAP = "R2_INTERNAL_DECODED_COUNT_GAP"
R3_OCR_OR_SEGMENTATION_UNAVAILABLE = "R3_OCR_OR_SEGMENTATION_UNAVAILABLE"
R3_COMPLETE_TEXT_CONTRADICTION = "R3_COMPLETE_TEXT_CONTRADICTION"
R3_UNSUPPORTED_REPRESENTATION = "R3_UNSUPPORTED_REPRESENTATION"
R3_CANONICAL_INTERPRETATION_UNCERTAIN = "R3_CANONICAL_INTERPRETATION_UNCERTAIN"
R3_SEARCH_CAP_REACHED = "R3_SEARCH_CAP_REACHED"
R3_INSUFFICIENT_ALIGNMENT_EVIDENCE = "R3_INSUFFICIENT_ALIGNMENT_EVIDENCE"
R3_1_ALIGNMENT_UNAVAILABLE = "R3_1_ALIGNMENT_UNAVAILABLE"
R3_1_MEASURED_POSITION_MISMATCH = "R3_1_MEASURED_POSITION_MISMATCH"
R3_1_AMBIGUOUS_AFTER_MEASUREMENT = "R3_1_AMBIGUOUS_AFTER_MEASUREMENT"
R3_1_POSITION_UNAVAILABLE = "R3_1_POSITION_UNAVAILABLE"

# fixed values: why a row's texts can't be searched
COUNT_TIER_UNAVAILABLE = "COUNT_TIER_UNAVAILABLE"
EMPTY_COUNT_OCR_NOT_IMAGE_ABSENCE = "EMPTY_COUNT_OCR_NOT_IMAGE_ABSENCE"
NON_ASCII_OR_CONTROL_WHITESPACE = "NON_ASCII_OR_CONTROL_WHITESPACE"
OPTIONAL_TIER_WHITESPACE_ONLY_IS_NOT_KNOWN_EMPTY = "OPTIONAL_TIER_WHITESPACE_ONLY_IS_NOT_KNOWN_EMPTY"
COUNT_WHITESPACE_ONLY = "COUNT_WHITESPACE_ONLY"
OBSERVED_LEADING_BLANKS_REQUIRE_UNPROVEN_COMMON_CROP_NORMALIZATION = "OBSERVED_LEADING_BLANKS_REQUIRE_UNPROVEN_COMMON_CROP_NORMALIZATION"
