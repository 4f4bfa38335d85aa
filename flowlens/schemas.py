"""Struct types of records, windows, alerts and the alert-store tables."""

from pyspark.sql import Column, functions as F, types as T

from .constants import CATEGORY_FIELDS, COUNT_MAPS, EXPLICIT_LABEL_KEYS, FAMILY_KEYS, LABEL_KEYS
from .constants import NUMERIC_FIELDS, UNIQUE_COUNTS

STRING, LONG, DOUBLE = T.StringType(), T.LongType(), T.DoubleType()
BOOLEAN, TIMESTAMP = T.BooleanType(), T.TimestampType()
COUNTS = T.MapType(STRING, LONG)
FEATURES = T.MapType(STRING, DOUBLE)

SIMULATION_MAPS = (
    "simulation_counts_by_type", "simulation_counts_by_attack_family", "simulation_counts_by_scenario",
)


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


# Keys that may sit in any nested object: labels and attack families, kept as text.
TAG_KEYS = tuple(dict.fromkeys(EXPLICIT_LABEL_KEYS + LABEL_KEYS + FAMILY_KEYS))

TAG_SCHEMA = _struct(**{key: STRING for key in TAG_KEYS})
# As read from JSON: labels with their JSON types.
JSON_TAG_SCHEMA = _struct(**{key: T.VariantType() for key in TAG_KEYS})

METADATA_SCHEMA = _struct(
    dataset_origin=STRING, dataset_source=STRING, feature_schema=STRING, label_source=STRING,
    attack_cat=STRING, campaign_signature=STRING, scenario_signature=STRING, window_group_id=STRING,
    actor_signature=STRING, dominant_actor_id=STRING, component_scenarios=T.ArrayType(STRING),
    **{key: STRING for key in TAG_KEYS},
)

# `scenario` and `ground_truth` may hold a scalar or an object, so every nested
# object other than `metadata` stays JSON text and is parsed where it is needed.
WINDOW_SCHEMA = _struct(
    id=STRING, feature_schema=STRING, window_start_ms=LONG, window_end_ms=LONG, event_count=LONG,
    **{name: DOUBLE for name in NUMERIC_FIELDS},
    **{name: STRING for name in CATEGORY_FIELDS},
    srcip=STRING, dstip=STRING,
    **{name: LONG for name in UNIQUE_COUNTS},
    **{name: COUNTS for name in COUNT_MAPS},
    counts_by_user=COUNTS, failed_no_mfa_by_user=COUNTS,
    simulation_malicious_event_count=LONG, simulation_benign_event_count=LONG,
    **{name: COUNTS for name in SIMULATION_MAPS},
    metadata=METADATA_SCHEMA, simulation=STRING, labels=STRING,
    **{key: STRING for key in TAG_KEYS},
)

RECORD_SCHEMA = _struct(
    id=STRING, label=STRING, label_source=STRING, label_quality_tier=STRING, dataset_source=STRING,
    window_start_ms=LONG, window_end_ms=LONG, text=STRING, window=WINDOW_SCHEMA,
)

ALERT_MESSAGE_SCHEMA = _struct(
    alert_type=STRING, timestamp=LONG, window_id=STRING, window=WINDOW_SCHEMA, feature_schema=STRING,
    model_label=T.IntegerType(), model_type=STRING, model_score=DOUBLE, threshold=DOUBLE,
    explanation_summary=STRING,
)

STORE_SCHEMAS = {
    "alerts": _struct(
        id=LONG, timestamp=LONG, window_id=STRING, model_type=STRING, feature_schema=STRING,
        model_score=DOUBLE, threshold=DOUBLE, triggered=BOOLEAN, explanation_summary=STRING,
        created_at=TIMESTAMP, updated_at=TIMESTAMP,
    ),
    "alert_investigations": _struct(
        id=LONG, alert_id=LONG, user_id=STRING, status=STRING, notes=STRING,
        created_at=TIMESTAMP, updated_at=TIMESTAMP,
    ),
    "audit_log": _struct(
        id=LONG, user_id=STRING, action=STRING, target=STRING, details=STRING, created_at=TIMESTAMP,
    ),
    "models": _struct(
        id=LONG, model_type=STRING, version=STRING, accuracy=DOUBLE, f1_score=DOUBLE, roc_auc=DOUBLE,
        n_samples=LONG, active=BOOLEAN, model_metadata=STRING, created_at=TIMESTAMP,
    ),
    "performance_metrics": _struct(
        id=LONG, hour_timestamp=LONG, alert_count=LONG, avg_score=DOUBLE, model_type=STRING,
        created_at=TIMESTAMP,
    ),
}


def as_text_leaves(kind: T.DataType) -> T.DataType:
    """The same shape with every scalar as text, so that JSON of any scalar type parses; labels and counts keep their JSON type."""
    if isinstance(kind, T.StructType):
        return T.StructType([
            T.StructField(f.name, T.VariantType() if f.name in TAG_KEYS else as_text_leaves(f.dataType)) for f in kind.fields
        ])
    if isinstance(kind, T.MapType):
        return T.MapType(STRING, T.VariantType())
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(STRING)
    return STRING


def build_struct(schema: T.StructType, values: dict[str, Column]) -> Column:
    """A struct column of `schema`; fields without a value are null."""
    unknown = set(values) - set(schema.fieldNames())
    if unknown:
        raise ValueError(f"not in the schema: {sorted(unknown)}")
    return F.struct(*[
        (values[f.name] if f.name in values else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ])
