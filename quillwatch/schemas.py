"""Column layouts of the stored and exchanged tables; nothing is inferred."""

from __future__ import annotations

AUDIT_ROW = (
    "event_time timestamp, query_text string, username string, database_name string, "
    "client_ip string, duration_ms double, rows_affected bigint"
)

EVENT = (
    "event_id string, query string, username string, database string, source_system string, "
    "client_ip string, duration_ms double, rows_affected bigint, timestamp timestamp"
)

# Nine-column flat record used for exports and as input of alert building.
DETECTION_COLUMNS = (
    "timestamp",
    "username",
    "database",
    "source_system",
    "client_ip",
    "query",
    "risk_score",
    "severity",
    "classification",
)

# Fields that make two detections the same alert, already in alphabetical order.
FINGERPRINT_FIELDS = (
    "classification",
    "client_ip",
    "database",
    "query",
    "source_system",
    "username",
)

ALERT = (
    "alert_id string, fingerprint string, status string, occurrence_count bigint, "
    "first_seen timestamp, last_seen timestamp, severity string, risk_score double, "
    "database string, username string, client_ip string, classification string, "
    "source_system string, query string, batch_id string, generated_at timestamp, "
    "updated_by string, status_note string, status_updated_at timestamp, last_action string, "
    "extra map<string,string>"
)
ALERT_COLUMNS = tuple(part.split()[0] for part in ALERT.split(", "))

ALERT_EVENT = (
    "event_key string, alert_id string, event_type string, timestamp timestamp, "
    "batch_id string, actor string, note string, payload_json string"
)

LOG_RECORD = (
    "type string, alert_id string, fingerprint string, batch_id string, generated_at string, "
    "timestamp string, status string, occurrence_count string, first_seen string, "
    "last_seen string, username string, database string, source_system string, "
    "client_ip string, query string, risk_score string, severity string, "
    "classification string, updated_by string, status_note string, "
    "status_updated_at string, last_action string, action string, actor string, note string"
)

RECOMMENDATION = (
    "recommendation_id string, incident_id string, proposed_action string, rationale string, "
    "learning_score double, status string, requires_human_approval boolean, "
    "auto_apply boolean, created_at timestamp, previous_recommendation_id string"
)

FEEDBACK = (
    "feedback_id string, recommendation_id string, incident_id string, analyst string, "
    "decision string, rationale string, created_at timestamp"
)

PROBE = (
    "name string, url string, required boolean, healthy boolean, status_code int, "
    "duration_seconds double, detail string, checked_at_epoch double"
)

ACCESS_LOG = "method string, path string, status_code int, duration_seconds double, ts timestamp"
