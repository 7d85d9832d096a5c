"""Fixed vocabularies and table shapes."""

from __future__ import annotations

# Keys, statuses, kinds and limits of the data model.
HEADER_KEYS = ("company", "contact_person", "email", "phone", "requested_delivery_date", "additional_requirements")
ITEM_KEYS = ("description", "quantity", "unit", "material", "dimensions")
FIELD_KIND = {"email": "email", "phone": "phone", "requested_delivery_date": "date", "quantity": "number", "unit": "unit"}
REQUEST_STATUS = ("NEW", "PROCESSING", "REVIEW", "APPROVED", "REJECTED", "EXPORTED", "ERROR")
FIELD_STATUS = ("found", "missing", "uncertain", "unverified")
STATUS_RANK = {"found": 3, "uncertain": 2, "unverified": 1, "missing": 0}
PAGE = 50
LIMITS = {"subject": 300, "field": 500, "items": 200, "body": 64 * 1024}
PERMISSIONS = {
    "admin": ("requests.process", "requests.ingest", "users.invite", "users.manage"),
    "clerk": ("requests.process", "requests.ingest"),
    "guest": ("requests.process",),
}
TRANSITIONS = (
    ("processing.started", "NEW", "PROCESSING"), ("processing.started", "PROCESSING", "PROCESSING"),
    ("processing.succeeded", "PROCESSING", "REVIEW"), ("processing.failed", "NEW", "ERROR"), ("processing.failed", "PROCESSING", "ERROR"),
    ("reprocess.processing", "ERROR", "NEW"), ("approve", "REVIEW", "APPROVED"), ("reject", "REVIEW", "REJECTED"),
    ("reject.duplicate", "NEW", "REJECTED"), ("reject.duplicate", "REVIEW", "REJECTED"), ("reject.duplicate", "ERROR", "REJECTED"),
    ("export.succeeded", "APPROVED", "EXPORTED"), ("export.failed", "APPROVED", "ERROR"), ("reprocess.export", "ERROR", "APPROVED"),
    ("sample.retired", "NEW", "REJECTED"), ("sample.retired", "PROCESSING", "REJECTED"), ("sample.retired", "ERROR", "REJECTED"),
)
UNIT_SPELLINGS = {
    "mm": ("mm", "millimeter", "millimetre"),
    "cm": ("cm", "zentimeter", "centimeter", "centimetre"),
    "m": ("m", "meter", "metre"),
    "kg": ("kg", "kilogramm", "kilogram"),
    "t": ("t", "tonne", "tonnen", "tonnes"),
    "pcs": ("pcs", "pc", "piece", "pieces", "stk", "stck", "st", "stück", "stueck"),
}

# Shapes of the application's tables.
REQUESTS = (
    "id string, company_id string, status string, created_at timestamp, source string, created_by string, subject string, message_id string, "
    "fingerprint string, possible_duplicate boolean, duplicate_of_id string, duplicate_decision string, error_stage string, error_message string, "
    "attempts int, next_retry_at timestamp, rejection_reason string"
)
SEGMENTS = "document_id string, segment_id string, position int, text string, kind string, part string, line int, ocr boolean"
CLAIMS = "document_id string, field_key string, item_index int, value string, status string, segment_id string, quote string"
CORRECTIONS = "id string, company_id string, request_id string, field_key string, item_index int, old_value string, new_value string, corrected_by string, created_at timestamp"
EXPORTS = "id string, company_id string, request_id string, idempotency_key string, status string, erp_reference string, attempts int, last_error string, created_at timestamp, exported_at timestamp"
EXPECTED = "case_id string, field string, item_index int, value string, status string"
BASELINE = "field string, metric string, value double"
