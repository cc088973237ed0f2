"""Row shapes shared by sources, operators and streams."""

LABELS = "map<string,string>"

LOG_SCHEMA = (
    "insert_id string, log_name string, ts timestamp, receive_ts timestamp, severity string, "
    "resource struct<type:string, labels:map<string,string>>, text_payload string, json_payload variant"
)

ENVELOPE_SCHEMA = (
    "subscription string, message struct<data:string, messageId:string, publishTime:string, "
    "attributes:map<string,string>>"
)

ACTION_PLAN = "array<struct<step:int, action:string, warning:string>>"

# What an analyzer returns for one incident.
INCIDENT_FIELDS = (
    "operational_summary string, service_name string, business_impact string, root_cause string, "
    "ai_suggestion string, first_seen_timestamp string, last_seen_timestamp string, "
    f"action_plan {ACTION_PLAN}"
)

INCIDENT_COLUMNS = [
    "operational_summary",
    "service_name",
    "business_impact",
    "root_cause",
    "ai_suggestion",
    "first_seen_timestamp",
    "last_seen_timestamp",
    "action_plan",
]

REPORT_SCHEMA = (
    f"id string, {INCIDENT_FIELDS}, severity string, signature string, log_message string, "
    "last_insert_id string, incident_count bigint, created_at timestamp"
)

SIGNATURE_SCHEMA = (
    "signature string, status string, count bigint, created_at timestamp, updated_at timestamp, "
    "log_message string, severity string, report_id string"
)

LEDGER_SCHEMA = "insert_id string, status string, processed_timestamp timestamp"

DEAD_LETTER_SCHEMA = "raw string, reason string, attempts int, failed_at timestamp"
