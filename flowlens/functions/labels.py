"""Labels, their sources and quality tiers, attack families.

`window` arguments are struct columns of `WINDOW_SCHEMA`.
"""

from pyspark.sql import Column, functions as F, types as T

from ..constants import (
    FAMILY_KEYS, FAMILY_MAP_KEYS, LABEL_FALSE_STRINGS, LABEL_KEYS, LABEL_TRUE_STRINGS,
    NESTED_OBJECT_KEYS, TIER_BY_SOURCE, WEIGHT_BY_TIER,
)
from ..schemas import JSON_TAG_SCHEMA, TAG_SCHEMA
from .columns import as_column, clean_count_map, label_text, non_empty, parse_label, strip


def tagged_objects(window) -> Column:
    """The window and its nested objects in probe order, as an array of label and family fields.

    Each object held as JSON text is parsed once; a missing object is a null entry.
    """
    w = as_column(window)
    fields = lambda obj: F.struct(*[obj[key].alias(key) for key in TAG_SCHEMA.fieldNames()])
    metadata = F.when(w["metadata"].isNotNull(), fields(w["metadata"]))
    # A lambda's argument is evaluated once, whatever refers to it; a column would be parsed again for every field.
    objects = F.filter(F.array(*[w[key] for key in NESTED_OBJECT_KEYS if key != "metadata"]), lambda text: text.isNotNull())
    parsed = F.transform(F.transform(objects, lambda text: F.from_json(text, JSON_TAG_SCHEMA)), lambda o: F.when(
        o.isNotNull(), F.struct(*[label_text(o[k], k not in FAMILY_KEYS).alias(k) for k in TAG_SCHEMA.fieldNames()])))
    return F.array_compact(F.concat(F.array(fields(w), metadata), parsed))


def _tags(window, keys: tuple[str, ...]) -> Column:
    """All non-null values under `keys`, object by object, in key order."""
    values = F.transform(tagged_objects(window), lambda obj: F.array(*[obj[key] for key in keys]))
    return F.filter(F.flatten(values), lambda value: value.isNotNull())


def _total(counts: Column, words: tuple[str, ...]) -> Column:
    chosen = F.map_filter(counts, lambda k, _: F.lower(strip(k)).isin(*words))
    return F.aggregate(F.map_values(chosen), F.lit(0).cast("bigint"), lambda acc, v: acc + v)


def metadata_label(window) -> Column:
    """Label found in the window's own fields, its nested objects or its simulation counts."""
    w = as_column(window)
    parsed = F.transform(_tags(w, LABEL_KEYS), parse_label)
    tagged = F.get(F.filter(parsed, lambda x: x.isNotNull()), 0)

    malicious = F.coalesce(w["simulation_malicious_event_count"], F.lit(-1))
    benign = F.coalesce(w["simulation_benign_event_count"], F.lit(-1))
    by_type = clean_count_map(w["simulation_counts_by_type"])
    families = clean_count_map(w["simulation_counts_by_attack_family"])
    return F.coalesce(
        tagged,
        F.when(malicious > 0, 1).when(benign >= 0, 0),
        F.when(_total(by_type, LABEL_TRUE_STRINGS) > 0, 1).when(_total(by_type, LABEL_FALSE_STRINGS) > 0, 0),
        F.when(F.exists(F.map_values(families), lambda v: v > 0), 1),
    )


def window_label(window) -> Column:
    """Struct of label and label source; windows without a label count as benign, source unknown."""
    label = metadata_label(window)
    return F.struct(
        F.coalesce(label, F.lit(0)).alias("label"),
        F.when(label.isNotNull(), "dataset_ground_truth").otherwise("unknown").alias("label_source"),
    )


def resolved_label(label, window_label_value: Column) -> Column:
    """Record label, else the given label of its window, else 0."""
    return F.coalesce(parse_label(label), window_label_value, F.lit(0))


def record_label(label, window) -> Column:
    return resolved_label(label, metadata_label(window))


def resolved_source(source, label, window_label_value: Column) -> Column:
    """Explicit source; without one, only a label found in the window counts as ground truth."""
    from_window = as_column(label).isNull() & window_label_value.isNotNull()
    return F.coalesce(non_empty(source), F.when(from_window, "dataset_ground_truth").otherwise("unknown"))


def label_source(source, label, window) -> Column:
    return resolved_source(source, label, metadata_label(window))


def _lookup(key: Column, table: dict, default) -> Column:
    pairs = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, key), F.lit(default))


def source_tier(source) -> Column:
    return _lookup(as_column(source), TIER_BY_SOURCE, "low")


def label_tier(tier, resolved_source) -> Column:
    """Explicit tier when valid, otherwise the tier of the resolved label source."""
    explicit = F.lower(strip(tier))
    return F.when(explicit.isin(*WEIGHT_BY_TIER), explicit).otherwise(source_tier(resolved_source))


def sample_weight(tier) -> Column:
    return _lookup(as_column(tier), WEIGHT_BY_TIER, WEIGHT_BY_TIER["low"])


def family_name(attack_cat) -> Column:
    return F.coalesce(
        F.concat(F.lit("network_"), F.lower(non_empty(attack_cat))), F.lit("network_intrusion")
    )


def threat_family(window) -> Column:
    """Threat family from the attack category, which is itself label information."""
    return family_name(as_column(window)["metadata"]["attack_cat"])


def attack_family_candidates(window) -> Column:
    """Sorted distinct family and scenario names of a window."""
    w = as_column(window)

    def names(value: Column) -> Column:
        listed = F.from_json(value, T.ArrayType(T.StringType()))
        return F.when(F.startswith(value, F.lit("[")), listed).otherwise(F.array(value))

    texts = _tags(w, FAMILY_KEYS)
    counted = [
        F.map_keys(F.map_filter(clean_count_map(w[key]), lambda _, v: v > 0)) for key in FAMILY_MAP_KEYS
    ]
    found = F.concat(F.flatten(F.transform(texts, names)), *counted)
    cleaned = F.filter(F.transform(found, lambda x: F.lower(strip(x))), lambda x: F.length(x) > 0)
    return F.array_sort(F.array_distinct(cleaned))


def window_event_count(window) -> Column:
    w = as_column(window)
    users = F.map_values(clean_count_map(w["counts_by_user"]))
    return F.coalesce(w["event_count"], F.aggregate(users, F.lit(0).cast("bigint"), lambda a, v: a + v))


def is_fractured(label, window, min_event_count: int = 2) -> Column:
    """An attack-labeled window with fewer than `min_event_count` events."""
    attack = F.coalesce(parse_label(label) == 1, F.lit(False)) | F.coalesce(
        metadata_label(window) == 1, F.lit(False)
    )
    return (window_event_count(window) < min_event_count) & attack
