"""Column layouts of the tables the engine reads and writes.

EVENTS may carry extra *promoted* columns next to the JSON text: ``f_<key>`` (top-level value),
``d_<key>`` (top level, else the nested ``data`` object) and the source attributes ``log_type``,
``artifact_type`` and ``host``.  Every operator uses a promoted column when it is there, so a stored
table with the hot keys promoted is read column by column and never parsed.
"""

EVENTS = (
    "case_id string, source_id string, line_no bigint, ts timestamp, "
    "kind string, fields string, raw string"
)
SOURCES = (
    "case_id string, source_id string, path string, sha256 string, size_bytes bigint, kind string, "
    "artifact_type string, log_type string, host string, package string, detect_format string, "
    "detect_confidence double, detect_status string, created_at timestamp"
)
ENTITIES = (
    "case_id string, host string, entity_type string, raw_value string, canonical_key string, "
    "qualifier string, source_id string, line_no bigint"
)
HITS = (
    "case_id string, source_id string, line_no bigint, rule_id string, severity string, "
    "matched_field string, matched_value string, snippet string, ts timestamp, status string, "
    "round_no int, evidence_grade string, detail string"
)
LINES = "source_id string, line_no bigint, raw string"
NODES = (
    "id string, case_id string, kind string, text string, status string, created_by string, "
    "parent_id string, depth int, created_at timestamp"
)
EDGES = "case_id string, from_id string, to_id string, kind string"
ANCHORS = "case_id string, node_id string, source_id string, line_no bigint, role string"
AUDIT = (
    "seq bigint, case_id string, ts timestamp, actor string, action string, scope string, "
    "detail_json string, prev_hash string, entry_hash string"
)
