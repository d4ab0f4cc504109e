"""Structured refusals: codes, sentences, paths and remedies."""

from __future__ import annotations

from typing import Any

#: How this dialect of the query language calls itself in messages.
DIALECT = "Millrace"

# The codes and sentences of the contract; {language} is the dialect's name.
MESSAGES = {
    "ENCODING_ANCHOR_FORBIDDEN": "{language}-YAML anchors and aliases are forbidden.",
    "ENCODING_MERGE_KEY_FORBIDDEN": "{language}-YAML merge keys are forbidden.",
    "ENCODING_DUPLICATE_KEY": "The input contains a duplicate object key.",
    "ENCODING_MULTIDOC_FORBIDDEN": "{language} accepts exactly one document.",
    "ENCODING_TAG_FORBIDDEN": "{language}-YAML custom tags are forbidden.",
    "ENCODING_INVALID": "The input is not a well-formed document.",
    "SCHEMA_REQUIRED_MEMBER": "A required member is missing.",
    "SCHEMA_UNKNOWN_MEMBER": "This member is not part of the {language} v0 schema.",
    "SCHEMA_TYPE_MISMATCH": "The value has the wrong JSON type.",
    "SCHEMA_INVALID_VALUE": "The value is not in the closed {language} v0 vocabulary.",
    "VERSION_UNSUPPORTED": "The query language version is not supported.",
    "STRUCTURAL_LIMIT_EXCEEDED": "The request exceeds an {language} v0 structural limit.",
    "LIMIT_OUT_OF_RANGE": "The bounded integer is outside the permitted range.",
    "REFERENCE_NOT_AVAILABLE": "The referenced catalog item is not available in this scope.",
    "ENUM_VALUE_INVALID": "The value is not a declared enum code.",
    "OUTPUT_ID_INVALID": "The output id does not use the {language} v0 safe identifier grammar.",
    "OUTPUT_ID_COLLISION": "The output id is already used by another dimension or metric.",
    "NUMERIC_SCALE_MISMATCH": "The decimal has non-zero digits beyond the declared scale.",
    "NUMERIC_OVERFLOW": "The exact numeric result exceeds the declared precision or integer range.",
    "INSTANT_PRECISION_MISMATCH": "The instant does not use the field's declared precision.",
    "COLLATION_UNAVAILABLE": "The source cannot reproduce the catalog's pinned collation.",
    "CALENDAR_UNAVAILABLE": "The source cannot reproduce the catalog's pinned calendar data.",
    "MONEY_CURRENCY_MIXED": "The money aggregate contains more than one currency.",
    "POLICY_DENIED": "The requested operation is not permitted in this channel.",
    "SCOPE_INVALID": "The resolved scope cannot be applied to this dataset.",
    "SCOPE_EXPIRED": "The resolved scope has expired.",
    "QUERY_WRITE_FORBIDDEN": "The {language} Query Core cannot perform writes.",
    "NATIVE_PASSTHROUGH_FORBIDDEN": "Native backend query passthrough is forbidden.",
    "REGEX_FORBIDDEN": "Regular-expression predicates are forbidden in {language} v0.",
    "UDF_FORBIDDEN": "User-defined functions are forbidden in {language} v0.",
    "EVALUABLE_CONSTRUCT_FORBIDDEN": "Evaluable expressions are forbidden in {language} v0.",
    "UNSUPPORTED_IN_V0": "This construct is reserved and unsupported in {language} v0.",
    "PROFILE_UNSUPPORTED": "The source does not advertise the required capability profile.",
    "SCOPE_UNENFORCEABLE": "The source cannot enforce the resolved scope before content crosses the trust boundary.",
    "EXACT_SCAN_LIMIT_EXCEEDED": "The exact eligible set exceeds the admitted scan limit.",
    "COST_LIMIT_EXCEEDED": "The query exceeds the resolved cost budget.",
    "FRESHNESS_UNAVAILABLE": "The selected binding cannot certify the requested afterWrite guarantee.",
    "EMBEDDING_UNINDEXED": "The required EmbeddingSpec is not indexed on the selected binding.",
    "QUALITY_UNCERTIFIED": "The requested quality profile has no valid certification for this execution.",
    "FILTER_SHAPE_UNCERTIFIED": "The selected binding has no quality certification for this filter shape.",
    "CURSOR_INVALID": "The cursor does not match this query, scope, channel, or snapshot.",
    "CURSOR_EXPIRED": "The cursor has expired.",
    "CURSOR_UNAVAILABLE": "The source cannot preserve a snapshot for cursor pagination.",
    "RECEIPT_INVALID": "The write receipt does not match this query scope or source.",
    "RECEIPT_EXPIRED": "The write receipt has expired.",
    "RECEIPT_FAILED": "A required write representation failed.",
    "RECEIPT_SUPERSEDED": "A required write representation was superseded.",
    "AFTER_WRITE_TIMEOUT": "The afterWrite deadline elapsed before every required visibility state was observable.",
    "RECORD_EXISTS": "A record with this id already exists.",
    "RECORD_NOT_FOUND": "No record with this id exists.",
    "VERSION_CONFLICT": "The record's current version differs from the required one.",
    "IDEMPOTENCY_CONFLICT": "The idempotency key was used with other content.",
    "BACKEND_FAILED": "The source could not complete the request.",
}
# Repair phrases.
PHRASES = {
    "ENCODING_ANCHOR_FORBIDDEN": "Inline the value without anchors or aliases.",
    "ENCODING_MERGE_KEY_FORBIDDEN": "Write every mapping member explicitly.",
    "ENCODING_DUPLICATE_KEY": "Keep exactly one occurrence of each key.",
    "ENCODING_MULTIDOC_FORBIDDEN": "Submit one document.",
    "ENCODING_TAG_FORBIDDEN": "Use a YAML 1.2 core scalar without a tag.",
    "OUTPUT_ID_INVALID": "Choose an id matching [A-Za-z][A-Za-z0-9_]{0,63} and not reserved by v0.",
    "OUTPUT_ID_COLLISION": "Choose a unique output id matching [A-Za-z][A-Za-z0-9_]{0,63}.",
    "NUMERIC_OVERFLOW": "Use a value within the declared precision or integer range.",
    "MONEY_CURRENCY_MIXED": "Group by a catalog field that separates currencies.",
    "SCOPE_INVALID": "Obtain a corrected scope.",
    "SCOPE_EXPIRED": "Obtain a fresh scope.",
    "QUERY_WRITE_FORBIDDEN": "Use the separate Ingest contract.",
    "NATIVE_PASSTHROUGH_FORBIDDEN": "Remove the native-query member.",
    "REGEX_FORBIDDEN": "Use contains or startsWith.",
    "UDF_FORBIDDEN": "Use a closed {language} v0 predicate.",
    "EVALUABLE_CONSTRUCT_FORBIDDEN": "Use a closed {language} v0 predicate.",
    "UNSUPPORTED_IN_V0": "Remove the construct.",
    "AFTER_WRITE_TIMEOUT": "Retry with the same receipt and requirements.",
}
#: Several phrases, which the remedy's details hold as well; all but the first two codes' are this engine's own.
REMEDIES = {
    "EXACT_SCAN_LIMIT_EXCEEDED": ["Add a selective where predicate.", "Request approximate accuracy if policy permits."],
    "FRESHNESS_UNAVAILABLE": ["Choose a binding certified for afterWrite.", "Remove the freshness requirement explicitly."],
    "PROFILE_UNSUPPORTED": ["Choose a dataset that offers the profile.", "Remove the feature."],
    "EMBEDDING_UNINDEXED": ["Choose an indexed EmbeddingSpec.", "Wait for indexing."],
    "QUALITY_UNCERTIFIED": ["Choose a certified quality profile.", "Measure this profile."],
    "FILTER_SHAPE_UNCERTIFIED": ["Choose a certified quality profile.", "Measure this filter shape."],
    "RECEIPT_EXPIRED": ["Issue a new write.", "Run without the requirement."],
}
ACTIONS = {
    "PROFILE_UNSUPPORTED": "chooseSourceOrRemoveFeature",
    "SCOPE_UNENFORCEABLE": "chooseCertifiedSource",
    "EXACT_SCAN_LIMIT_EXCEEDED": "narrowEligibleSetOrRequestApproximate",
    "COST_LIMIT_EXCEEDED": "narrowQuery",
    "FRESHNESS_UNAVAILABLE": "chooseAfterWriteBindingOrRemoveRequirement",
    "EMBEDDING_UNINDEXED": "chooseIndexedSpecOrWaitForIndexing",
    "QUALITY_UNCERTIFIED": "chooseCertifiedProfileOrMeasure",
    "FILTER_SHAPE_UNCERTIFIED": "chooseCertifiedProfileOrMeasure",
    "CURSOR_INVALID": "restartPagination",
    "CURSOR_EXPIRED": "restartPagination",
    "CURSOR_UNAVAILABLE": "chooseSnapshotCapableSource",
    "RECEIPT_INVALID": "supplyMatchingReceipt",
    "RECEIPT_EXPIRED": "issueNewWriteOrRunWithoutRequirement",
    "RECEIPT_FAILED": "issueNewWrite",
    "RECEIPT_SUPERSEDED": "useNewerReceipt",
    "AFTER_WRITE_TIMEOUT": "retryAfterWrite",
}


def pointer(*parts: Any) -> str:
    """An RFC 6901 pointer."""
    return "".join("/" + str(p).replace("~", "~0").replace("/", "~1") for p in parts)


def error(code: str, path: str = "", alternatives: list[str] | None = None, details: dict | None = None) -> dict:
    phrase = PHRASES.get(code)
    if alternatives is None:
        alternatives = REMEDIES.get(code) or ([phrase.replace("{language}", DIALECT)] if phrase else [])
    if code in REMEDIES:
        details = {**(details or {}), "alternatives": alternatives}
    remedy = {"action": ACTIONS[code], "details": details or {}} if code in ACTIONS else None
    return {"code": code, "message": MESSAGES[code].replace("{language}", DIALECT), "path": path, "alternatives": alternatives, "remedy": remedy}


class Refusal(Exception):
    """One or more errors that end a request; never crosses the engine's edge."""

    def __init__(self, *errors: dict, status: str = "refused"):
        super().__init__("; ".join(f"{e['code']} at {e['path']!r}" for e in errors))
        self.errors = list(errors)
        self.status = status


def refuse(code: str, path: str = "", alternatives: list[str] | None = None, details: dict | None = None) -> Refusal:
    return Refusal(error(code, path, alternatives, details))
