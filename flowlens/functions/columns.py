"""Scalar column functions."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..constants import (
    DATASET_ORIGIN, FALLBACK_START_MS, FEATURE_SCHEMA, LABEL_FALSE_STRINGS, LABEL_TRUE_STRINGS,
)

WHITESPACE = " \t\n\r\x0b\x0c"


def as_column(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def strip(col) -> Column:
    """Trims all ASCII white space, not only blanks."""
    return F.btrim(as_column(col).cast("string"), F.lit(WHITESPACE))


def non_empty(col) -> Column:
    """Trimmed text, or null when nothing is left."""
    return F.nullif(strip(col), F.lit(""))


def normalize_headers(df: DataFrame) -> DataFrame:
    """Trimmed lower-case column names without byte-order mark, trimmed values."""
    renamed = df.toDF(*[name.strip().lstrip("\ufeff").lower() for name in df.columns])
    return renamed.select(*[strip(F.col(f"`{name}`")).alias(name) for name in renamed.columns])


def first_non_empty(*cols) -> Column:
    return F.coalesce(*[non_empty(c) for c in cols]) if cols else F.lit(None).cast("string")


def to_int(col, default: int | None = None) -> Column:
    """Integer text or a truncated number; anything else gives `default`."""
    value = as_column(col).try_cast("bigint")
    return value if default is None else F.coalesce(value, F.lit(default).cast("bigint"))


def to_float(col, default: float | None = None) -> Column:
    """Any number text, `nan` and `inf` included; anything else gives `default`."""
    text = F.lower(strip(col))
    # Java also reads a type suffix such as `1.5d`, which is no number here.
    value = F.when(~text.rlike("[0-9.][df]$"), text.try_cast("double"))
    return value if default is None else F.coalesce(value, F.lit(default))


def parse_label(col) -> Column:
    """1 or 0 from a boolean, a number or one of the known words; otherwise null. Text of other numbers is no label."""
    value = as_column(col)
    text = F.lower(strip(value))
    number = F.when(F.typeof(value) != "string", text.try_cast("double"))
    return (
        F.when(text.isin(*LABEL_TRUE_STRINGS), 1)
        .when(text.isin(*LABEL_FALSE_STRINGS), 0)
        .when(number.isNotNull(), (number != 0).cast("int"))
    )


_NUMBER_KINDS = r"^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)"


def label_text(value: Column, as_label: bool = True) -> Column:
    """Text of a JSON value that keeps what its type says of a label: a number becomes `1` or `0`.

    Without `as_label` a number keeps its own text. Objects and arrays become JSON text, JSON null becomes null.
    """
    kind = F.schema_of_variant(value)
    number = F.try_variant_get(value, "$", "double")
    own = F.try_variant_get(value, "$", "string")
    counted = F.when(number != 0, "1").otherwise("0") if as_label else own
    return (
        F.when(value.isNull() | (kind == "VOID"), None)
        .when(kind.rlike(_NUMBER_KINDS), counted)
        .when(kind.rlike("^(OBJECT|ARRAY)"), F.to_json(value)).otherwise(own)
    )


def json_count_map(col) -> Column:
    """Counts of a map of JSON values: numbers are truncated, true is 1, text must be an integer; others are dropped."""
    def count(value):
        kind = F.schema_of_variant(value)
        text = F.try_variant_get(value, "$", "string")
        return (
            F.when(kind.rlike(_NUMBER_KINDS), F.try_variant_get(value, "$", "double").try_cast("bigint"))
            .when(kind == "BOOLEAN", (text == "true").cast("bigint"))
            .when(kind == "STRING", F.when(text.rlike(r"^\s*[+-]?\d+\s*$"), strip(text).try_cast("bigint")))
        )

    counts = F.transform_values(as_column(col), lambda _, v: count(v))
    known = F.map_filter(counts, lambda _, n: n.isNotNull())
    positive = F.transform_values(known, lambda _, n: F.greatest(n, F.lit(0).cast("bigint")))
    return F.coalesce(positive, F.create_map().cast("map<string,bigint>"))


def binary_label(col) -> Column:
    """1 when the number has a non-zero integer part, 0 otherwise; null when it is no number."""
    value = to_float(col)
    finite = ~F.isnan(value) & (F.abs(value) != float("inf"))
    return F.when(finite, (F.abs(value) >= 1).cast("int"))


def clean_count_map(col) -> Column:
    """Counts as non-negative integers; values that are no integers are dropped, null becomes empty."""
    known = F.map_filter(as_column(col), lambda _, v: v.try_cast("bigint").isNotNull())
    counts = F.transform_values(known, lambda _, v: F.greatest(v.cast("bigint"), F.lit(0).cast("bigint")))
    return F.coalesce(counts, F.create_map().cast("map<string,bigint>"))


def category(col) -> Column:
    return F.coalesce(F.lower(non_empty(col)), F.lit("unknown"))


def safe_ratio(numerator, denominator) -> Column:
    n, d = as_column(numerator).cast("double"), as_column(denominator).cast("double")
    return F.when(d == 0, F.lit(0.0)).otherwise(F.try_divide(n, d))


def bucketize(col, low: float, high: float) -> Column:
    value = as_column(col)
    return F.when(value >= high, "high").when(value >= low, "medium").otherwise("low")


def epoch_ms(col) -> Column:
    """Milliseconds: values above 1e12 already are, smaller ones are seconds."""
    value = to_float(col)
    return F.when(value > 1e12, value).otherwise(value * 1000).try_cast("bigint")


def window_bounds(start, end, duration, row_index) -> tuple[Column, Column]:
    """Start and end in ms with fallbacks to the row index and to the duration in seconds."""
    start_ms = F.coalesce(epoch_ms(start), F.lit(FALLBACK_START_MS) + as_column(row_index))
    seconds = to_float(duration)
    length = F.when(seconds >= 0, F.greatest(F.lit(1).cast("bigint"), (seconds * 1000).try_cast("bigint")))
    end_ms = F.coalesce(epoch_ms(end), start_ms + F.coalesce(length, F.lit(1)))
    return start_ms, F.greatest(end_ms, start_ms + 1)


def feature_schema(window) -> Column:
    """Schema tag of the window, then of its metadata, then the default."""
    w = as_column(window)
    return F.coalesce(
        F.lower(non_empty(w["feature_schema"])),
        F.lower(non_empty(w["metadata"]["feature_schema"])),
        F.lit(FEATURE_SCHEMA),
    )


def dataset_source(record_source, window) -> Column:
    return F.coalesce(
        non_empty(record_source),
        non_empty(as_column(window)["metadata"]["dataset_source"]),
        F.lit("unknown"),
    )


def severity(score) -> Column:
    s = as_column(score)
    return F.when(s > 0.8, "threat").when(s > 0.6, "anomaly").otherwise("insight")


def severity_level(score) -> Column:
    """The two-level form used in compact lists."""
    return F.when(as_column(score) > 0.8, "threat").otherwise("anomaly")


def age_label(ts_ms, now_ms) -> Column:
    """`5m ago`, `3h ago` or `2d ago`."""
    age = (as_column(now_ms) if not isinstance(now_ms, int) else F.lit(now_ms)) - as_column(ts_ms)
    minutes, hours, days = (F.floor(age / F.lit(float(unit))) for unit in (60_000, 3_600_000, 86_400_000))
    return (
        F.when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m ago")))
        .when(hours < 24, F.concat(hours.cast("string"), F.lit("h ago")))
        .otherwise(F.concat(days.cast("string"), F.lit("d ago")))
    )


def parse_explanation(col) -> Column:
    """`a=1 | b` as an array of key/value structs; a part without `=` has an empty value."""
    def pair(part):
        at = F.instr(part, "=")
        key = F.when(at == 0, part).otherwise(F.substring_index(part, "=", 1))
        value = F.when(at == 0, F.lit("")).otherwise(F.substring(part, at + F.lit(1), F.length(part)))
        return F.struct(key.alias("key"), value.alias("value"))

    text = as_column(col)
    parts = F.filter(F.split(text, r" \| "), lambda _: F.length(text) > 0)
    return F.coalesce(F.transform(parts, pair), F.array().cast("array<struct<key:string,value:string>>"))


def opaque(udf):
    """Keeps the optimizer from copying a Python function into inferred filters, which would run it twice."""
    return udf.asNondeterministic()


def settled(col) -> Column:
    """The same value, computed where it stands: a filter on it is not moved below its step, with the whole expression copied into each use."""
    return F.when(F.spark_partition_id() >= 0, as_column(col))


def fixed_text(*numbers: tuple[Column, int | None]) -> Column:
    """Texts of (column, digits) pairs as one array, in C `%.nf` rounding.

    Digits of None give the shortest text that reads back as the same number.
    Spark's `format_string` rounds the decimal text half up instead of the exact
    binary value, so the numbers are formatted by one Arrow function.
    """
    digits = tuple(d for _, d in numbers)

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def render(*columns: pa.Array) -> pa.Array:
        rows, texts, places, before = len(columns[0]), [], [], 0
        for column, count in zip(columns, digits):
            # Equal numbers are written once; they are told apart by their bits, as -0.0 has a text of its own.
            coded = column.view(pa.int64()).dictionary_encode()
            values = coded.dictionary.view(pa.float64()).to_numpy(zero_copy_only=False).tolist()
            texts.append(pa.array([*map(repr, values)] if count is None else ((f"%.{count}f\n" * len(values)) % tuple(values)).split("\n")[:-1], pa.string()))
            places.append(pc.add(coded.indices, before).to_numpy(zero_copy_only=False))
            before += len(values)
        # Nulls have no place; as numbers they come as NaN.
        at = pa.array(np.column_stack(places).ravel(), pa.int64(), from_pandas=True)
        offsets = np.arange(0, rows * len(columns) + 1, len(columns), dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.concat_arrays(texts).take(at))

    return opaque(render)(*[c.cast("double") for c, _ in numbers])


def alert_explanation(window, model_type, score, texts: Column) -> Column:
    """One sentence about a flagged flow; `texts` is `explanation_numbers` of the same row."""
    w = as_column(window)
    attack = w["metadata"]["attack_cat"]
    return F.concat(
        as_column(model_type), F.lit(" flagged anomalous network flow"),
        F.when(F.length(attack) > 0, F.concat(F.lit(" ["), attack, F.lit("]"))).otherwise(""),
        F.lit(" (proto="), F.coalesce(w["proto"], F.lit("unknown")),
        F.lit(", service="), F.coalesce(w["service"], F.lit("-")),
        F.lit(", state="), F.coalesce(w["state"], F.lit("-")),
        F.lit(", sbytes="), F.coalesce(texts[0], F.lit("0")),
        F.lit(", dbytes="), F.coalesce(texts[1], F.lit("0")),
        F.lit(", score="), texts[2], F.lit(")"),
    )


def explanation_numbers(window, score) -> Column:
    w = as_column(window)
    return fixed_text((w["sbytes"], None), (w["dbytes"], None), (as_column(score), 2))


def with_alert_explanation(
    df: DataFrame, window="window", model_type="model_type", score="model_score",
    output="explanation_summary",
) -> DataFrame:
    numbers = df.withColumn("_numbers", explanation_numbers(window, score))
    text = alert_explanation(window, model_type, score, F.col("_numbers"))
    return numbers.withColumn(output, text).drop("_numbers")


def flow_metadata(source, attack_cat) -> dict[str, Column]:
    """Metadata fields of a window built from a labeled flow."""
    return {
        "dataset_origin": F.lit(DATASET_ORIGIN), "dataset_source": as_column(source),
        "feature_schema": F.lit(FEATURE_SCHEMA), "label_source": F.lit("dataset_ground_truth"),
        "attack_cat": as_column(attack_cat),
    }
