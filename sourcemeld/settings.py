"""Thresholds and vocabularies shared by the operators."""

from __future__ import annotations

from dataclasses import dataclass

# Decision thresholds of the data contract.
AUTO_SCORE = 0.86
AUTO_MARGIN = 0.08
FALLBACK_SCORE = 0.60
VECTOR_MARGIN = 0.06
PLAUSIBLE_SCORE = 0.40
UNCERTAIN_MARGIN = 0.15
COVERED_SCORE = 0.72
PAIR_SCORE = 0.90
PAIR_MARGIN = 0.08
PAIR_REVIEW_SCORE = 0.72
TOP_CANDIDATES = 5

# Contract types.
TYPES = ("string", "integer", "number", "boolean", "date", "datetime", "array", "object")

# Record status.
TRANSFORMED = "TRANSFORMED"
IN_REVIEW = "CONSULTANT_REVIEW"
READY = "READY_TO_PUSH"
RECONCILED = "RECONCILED"
PUSHED = "PUSHED"
PUSH_FAILED = "PUSH_FAILED"
ROLLED_BACK = "ROLLED_BACK"

# Review reasons.
AMBIGUOUS_MAPPING = "ambiguous_mapping"
CONFLICTING_VALUES = "conflicting_values"
INVALID_RECORD = "invalid_record"
AMBIGUOUS_MATCH = "ambiguous_match"
NEW_TRANSFORMATION = "new_transformation"
PROPOSER_UNAVAILABLE = "llm_unavailable"
UNSUPPORTED_OPERATION = "unsupported_operation"
UNMAPPED_VALUE = "unmapped_value"
TARGET_FAILURE = "target_api_failure"
FIELD_LEVEL_REASONS = (
    AMBIGUOUS_MAPPING,
    PROPOSER_UNAVAILABLE,
    NEW_TRANSFORMATION,
    UNSUPPORTED_OPERATION,
    UNMAPPED_VALUE,
)

# Texts a CSV reader takes as missing.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


@dataclass(frozen=True)
class Limits:
    """Row counts that switch a plan, never the result."""

    # A key with at least this many rows is hot; at most N / hot_rows keys can be.
    hot_rows: int = 1_000_000
    # A lookup table of at most this many rows is broadcast; larger ones are shuffled.
    broadcast_rows: int = 100_000
    # Rows of one tile of a fuzzy block; larger blocks are compared tile by tile.
    tile_rows: int = 2_000


LIMITS = Limits()

# Wording of review titles, violations and step errors, which readers of the output rely on.
ASK_ENTITY = "Choose the target entity for "
ASK_REQUIRED = "Required target field "
NO_SAFE_SOURCE = " has no safe source mapping"
ASK_MAPPING = "No safe automatic mapping for "
ASK_STEP = "Transformation requires approval for "
ASK_MATCH = "Record match requires review"
ASK_CONFLICT = "Conflicting values for "
ASK_MISSING = "Missing required field for "
ASK_INVALID = "Validation failed for "
SAY_REQUIRED = "Required field is missing"
SAY_ENUM = "Value must be one of"
SAY_TYPE = "Value does not match type"
SAY_NO_NUMBER = "No number found in"
SAY_NO_DATE = "Unable to parse date"
SAY_NO_DATETIME = "Unable to parse datetime"
SAY_NO_BOOLEAN = "Unable to normalize boolean value"
