"""Schemas, keys, domains and defaults of the engine's tables."""

from __future__ import annotations

from pyspark.sql import types as T

# The domains of the enumerated columns, in their declared order, and the labels of the lists.
AGREEMENT_STATUS = ["PENDING", "PROCESSING", "COMPLETED", "FAILED"]
ANALYSIS_STATUS = ["QUEUED", "PROCESSING", "COMPLETED", "FAILED"]
COMPLIANCE = ["COMPLIANT", "NON_COMPLIANT", "NEEDS_REVIEW"]
SEVERITY = ["LOW", "MEDIUM", "HIGH"]
STATUS_LABEL = {"PENDING": "To analyze", "PROCESSING": "Analyzing", "COMPLETED": "Completed", "FAILED": "Failed"}
STATUS_VARIANT = {"PENDING": "secondary", "PROCESSING": "default", "COMPLETED": "outline", "FAILED": "destructive"}
MAX_UPLOAD_BYTES = 20 * 1024 * 1024
MIN_PASSWORD = 8


def _table(text: str) -> T.StructType:
    """A schema of "name type" items; a "?" behind the type lets the column be null."""
    kinds = {"string": T.StringType(), "boolean": T.BooleanType(), "int": T.IntegerType(), "timestamp": T.TimestampNTZType(), "strings": T.ArrayType(T.StringType())}
    fields = [item.split() for item in text.split(",")]
    return T.StructType([T.StructField(name, kinds[kind.rstrip("?")], kind.endswith("?")) for name, kind in fields])


SCHEMAS = {
    "users": _table("id string, email string, name string?, image string?, password_hash string?, email_verified boolean, created_at timestamp, updated_at timestamp"),
    "accounts": _table("id string, user_id string, account_id string, provider_id string, access_token string?, refresh_token string?, access_token_expires_at timestamp?, scope string?, created_at timestamp, updated_at timestamp"),
    "sessions": _table("id string, user_id string, token string, expires_at timestamp, ip_address string?, user_agent string?, created_at timestamp, updated_at timestamp"),
    "verifications": _table("id string, identifier string, value string, expires_at timestamp, created_at timestamp, updated_at timestamp"),
    "agreements": _table("id string, user_id string, file_name string, s3_key string, s3_url string?, status string, is_generated boolean, prev_doc string?, uploaded_at timestamp, updated_at timestamp"),
    "analyses": _table("id string, agreement_id string, status string, overall_summary string?, risk_score int?, error_message string?, started_at timestamp?, completed_at timestamp?, created_at timestamp, updated_at timestamp"),
    "clause_results": _table("id string, analysis_id string, clause_index int, clause_title string, clause_text string, compliance string, explanation string, rta_citations strings, severity string?, issue string?, legal_basis string?, suggestion string?, created_at timestamp"),
    "presets": _table("id string, user_id string, title string, content string, is_active boolean, created_at timestamp"),
}

UNIQUE = {
    "users": [["id"], ["email"]],
    "accounts": [["id"], ["provider_id", "account_id"]],
    "sessions": [["id"], ["token"]],
    "verifications": [["id"]],
    "agreements": [["id"], ["s3_key"]],
    "analyses": [["id"], ["agreement_id"]],
    "clause_results": [["id"], ["analysis_id", "clause_index"]],
    "presets": [["id"]],
}

#: child table, its column, parent table; the parent's column is id, and a deleted parent takes its children with it
FOREIGN = [
    ("accounts", "user_id", "users"),
    ("sessions", "user_id", "users"),
    ("agreements", "user_id", "users"),
    ("presets", "user_id", "users"),
    ("analyses", "agreement_id", "agreements"),
    ("clause_results", "analysis_id", "analyses"),
]

DOMAINS = {("agreements", "status"): AGREEMENT_STATUS, ("analyses", "status"): ANALYSIS_STATUS, ("clause_results", "compliance"): COMPLIANCE, ("clause_results", "severity"): SEVERITY}

DEFAULTS = {
    "users": {"email_verified": False},
    "agreements": {"status": "PENDING", "is_generated": False},
    "analyses": {"status": "QUEUED"},
    "presets": {"is_active": False},
}
