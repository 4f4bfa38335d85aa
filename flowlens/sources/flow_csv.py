"""Labeled flow CSV files to window records."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..constants import (
    CATEGORY_FIELDS, DEST_IP_ALIASES, END_TIME_ALIASES, FEATURE_SCHEMA, ID_ALIASES, NUMERIC_FIELDS,
    SOURCE_IP_ALIASES, START_TIME_ALIASES,
)
from ..functions.columns import (
    binary_label, category, first_non_empty, flow_metadata, non_empty, normalize_headers, to_float, window_bounds,
)
from ..functions.labels import source_tier
from ..operators.features import window_text
from ..operators.ordering import with_file_row_index
from ..schemas import METADATA_SCHEMA, WINDOW_SCHEMA, build_struct
from ..session import prepare
from .records import file_stem


def build_flow_windows(df: DataFrame, dataset_source: Column | str, row_index: str = "row_index") -> DataFrame:
    """Adds `label`, `window` and `record_id` to rows of normalized flow columns (all text).

    Rows without a readable label are dropped. Unreadable numbers are left null.
    """
    def pick(*names: str) -> Column:
        return first_non_empty(*[n for n in names if n in df.columns])

    source = F.col(dataset_source) if isinstance(dataset_source, str) else dataset_source
    src, dst = pick(*SOURCE_IP_ALIASES), pick(*DEST_IP_ALIASES)
    cats = {name: category(pick(name)) for name in CATEGORY_FIELDS}
    start, end = window_bounds(pick(*START_TIME_ALIASES), pick(*END_TIME_ALIASES), pick("dur"), row_index)
    one = F.lit(1).cast("bigint")
    none = F.create_map().cast("map<string,bigint>")
    single = lambda key: F.when(key.isNotNull(), F.create_map(key, one)).otherwise(none)
    known = lambda flag: F.when(flag, 1).otherwise(0)
    window = build_struct(WINDOW_SCHEMA, {
        "feature_schema": F.lit(FEATURE_SCHEMA), "window_start_ms": start, "window_end_ms": end,
        "event_count": one,
        "srcip": F.coalesce(src, F.lit("unknown")), "dstip": F.coalesce(dst, F.lit("unknown")),
        **cats,
        "unique_source_ip_count": known(src.isNotNull()),
        "unique_destination_ip_count": known(dst.isNotNull()),
        **{f"unique_{n}_count": known(c != "unknown") for n, c in cats.items()},
        "counts_by_source_ip": single(src), "counts_by_destination_ip": single(dst),
        **{f"counts_by_{n}": F.create_map(c, one) for n, c in cats.items()},
        "metadata": build_struct(METADATA_SCHEMA, flow_metadata(source, non_empty(pick("attack_cat")))),
        **{n: to_float(pick(n)) for n in NUMERIC_FIELDS if n in df.columns},
    })
    record_id = F.coalesce(pick(*ID_ALIASES), F.concat_ws("-", source, F.col(row_index)))
    labeled = df.withColumn("_label", binary_label(pick("label"))).filter(F.col("_label").isNotNull())
    return labeled.select("*", record_id.alias("record_id"), window.alias("window")) \
        .withColumn("label", F.col("_label")).drop("_label")


def flow_records(windows: DataFrame) -> DataFrame:
    """Dataset rows from the output of `build_flow_windows`."""
    w = F.col("window")
    source = F.lit("dataset_ground_truth")
    return window_text(windows, output="_text").select(
        F.col("record_id").alias("id"), w["window_start_ms"].alias("window_start_ms"),
        w["window_end_ms"].alias("window_end_ms"), F.col("_text").alias("text"), "label",
        source.alias("label_source"), source_tier(source).alias("label_quality_tier"),
        w["metadata"]["dataset_source"].alias("dataset_source"), "window",
    )


def read_flow_csv(
    spark: SparkSession, path: str | list[str], dataset_source: str | None = None, max_rows: int = 0,
) -> DataFrame:
    """Labeled window records of flow CSV files with any header case.

    The row index counts every line of a file from 1, dropped ones included; it only
    serves as fallback id and time. `max_rows` keeps the first accepted rows.
    """
    prepare(spark)
    raw = with_file_row_index(spark.read.csv(path, header=True, inferSchema=False, encoding="UTF-8"))
    names = [c for c in raw.columns if c not in ("_path", "row_index")]
    clean = normalize_headers(raw.select(*names, F.col("_path").alias("_source_path"), F.col("row_index").alias("_row")))
    named = F.lit(dataset_source.strip()) if dataset_source and dataset_source.strip() else file_stem(F.col("_source_path"))
    rows = clean.withColumns({"_row": F.col("_row").cast("bigint"), "_source": named})
    windows = build_flow_windows(rows, "_source", "_row")
    if max_rows > 0:
        windows = windows.orderBy("_source_path", "_row").limit(max_rows)
    return flow_records(windows)
