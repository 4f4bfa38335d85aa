"""These must equal the published data contract for results to match."""

# --- label values -----------------------------------------------------------
LABEL_TRUE_STRINGS = (
    "1", "true", "yes", "y", "attack", "attacked", "malicious", "threat",
    "suspicious", "anomaly", "incident", "compromised",
)
LABEL_FALSE_STRINGS = ("0", "false", "no", "n", "benign", "normal", "clean", "safe")

# --- label keys, in probe order ----------------------------------------------
LABEL_KEYS = (
    "label", "is_malicious", "malicious", "attack", "scenario_label",
    "ground_truth", "ground_truth_label", "truth_label", "attack_family", "scenario_type",
)
EXPLICIT_LABEL_KEYS = (
    "label", "is_malicious", "malicious", "attack", "scenario_label",
    "ground_truth", "ground_truth_label", "truth_label",
)
FAMILY_KEYS = (
    "attack_family", "family", "scenario", "scenario_name", "scenario_type", "primary_scenario",
)
FAMILY_LIST_KEYS = ("component_scenarios", "scenario_signature", "campaign_signature")
FAMILY_MAP_KEYS = ("simulation_counts_by_attack_family", "simulation_counts_by_scenario")
NESTED_OBJECT_KEYS = ("metadata", "simulation", "scenario", "ground_truth", "labels")

# --- label provenance ----------------------------------------------------------
TIER_BY_SOURCE = {
    "metadata": "high",
    "dataset_ground_truth": "high",
    "external_heuristic": "medium",
    "legacy_rule": "low",
    "unknown": "low",
}
WEIGHT_BY_TIER = {"high": 1.0, "medium": 0.5, "low": 0.25}
WEAK_LABEL_SOURCES = ("legacy_rule", "unknown", "external_heuristic")
UNVERIFIED_LABEL_SOURCES = ("legacy_rule", "unknown")
MIN_HOLDOUT_NEGATIVE_RECALL = 0.40
MIN_HOLDOUT_POSITIVE_F1 = 0.6

# --- window schema ---------------------------------------------------------------
FEATURE_SCHEMA = "network_flow_v1"
NUMERIC_FIELDS = (
    "dur", "sport", "dsport", "spkts", "dpkts", "sbytes", "dbytes", "rate",
    "sttl", "dttl", "sload", "dload", "sloss", "dloss", "sinpkt", "dinpkt",
    "sjit", "djit", "swin", "stcpb", "dtcpb", "dwin", "tcprtt", "synack",
    "ackdat", "smean", "dmean", "trans_depth", "response_body_len",
    "ct_srv_src", "ct_state_ttl", "ct_dst_ltm", "ct_src_dport_ltm",
    "ct_dst_sport_ltm", "ct_dst_src_ltm", "is_ftp_login", "ct_ftp_cmd",
    "ct_flw_http_mthd", "ct_src_ltm", "ct_srv_dst", "is_sm_ips_ports",
)
CATEGORY_FIELDS = ("proto", "service", "state")
COUNT_MAPS = (
    "counts_by_source_ip", "counts_by_destination_ip", "counts_by_proto",
    "counts_by_service", "counts_by_state",
)
UNIQUE_COUNTS = (
    "unique_source_ip_count", "unique_destination_ip_count", "unique_proto_count",
    "unique_service_count", "unique_state_count",
)
OPTIONAL_TEXT_FIELDS = (
    "ct_srv_src", "ct_srv_dst", "ct_dst_ltm", "ct_src_ltm", "ct_dst_src_ltm", "is_sm_ips_ports",
)
DATASET_ORIGIN = "unsw_nb15"
FALLBACK_START_MS = 1_700_000_000_000

# --- flow CSV column aliases ------------------------------------------------------
SOURCE_IP_ALIASES = ("srcip", "src_ip", "sip")
DEST_IP_ALIASES = ("dstip", "dst_ip", "dip")
ID_ALIASES = ("id", "record_id", "row_id")
START_TIME_ALIASES = ("stime", "start_time")
END_TIME_ALIASES = ("ltime", "end_time")

# --- models -------------------------------------------------------------------------
MODEL_TYPES = ("structured_baseline", "distilbert", "tfidf_fallback")
LEGACY_MODEL_TYPES = {
    "tfidf": "tfidf_fallback",
    "tfidf_text": "tfidf_fallback",
    "council": "structured_baseline",
    "ensemble": "structured_baseline",
    "structured": "structured_baseline",
}
INVESTIGATION_STATUSES = ("open", "investigating", "resolved", "false_positive")
GROUP_KEYS = (
    "campaign_signature", "scenario_signature", "window_group_id",
    "actor_signature", "dominant_actor_id",
)

# --- secret scanning -------------------------------------------------------------------
SECRET_PATTERNS = (
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    r"\bAKIA[0-9A-Z]{16}\b",
    r"\bASIA[0-9A-Z]{16}\b",
    r"\bghp_[A-Za-z0-9]{20,}\b",
    r"\bgithub_pat_[A-Za-z0-9_]{20,}\b",
    r"\bsk-[A-Za-z0-9]{20,}\b",
    r"\bxox[baprs]-[A-Za-z0-9-]{10,}\b",
)
# Text without which the pattern of the same place cannot match.
SECRET_LITERALS = ("PRIVATE KEY-----", "AKIA", "ASIA", "ghp_", "github_pat_", "sk-", "xox")
PLACEHOLDER_MARKERS = (
    "change-me", "replace-with", "example", "localhost", "127.0.0.1",
    "postgres", "admin", "dev-internal-api-key", "${",
)
SENSITIVE_KEYS = (
    "POSTGRES_PASSWORD", "JWT_SECRET_KEY", "INTERNAL_API_KEY", "DEMO_ADMIN_PASSWORD",
    "DEMO_ANALYST_PASSWORD", "DEMO_VIEWER_PASSWORD", "AWS_SECRET_ACCESS_KEY",
)
CONTROL_CHARACTERS = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
IDENTIFIER_PATTERN = r"^[A-Za-z0-9._:@/-]+$"
