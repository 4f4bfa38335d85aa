"""Labeled window records: JSONL files, window and alert streams, dataset sinks."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..constants import FAMILY_KEYS
from ..functions.columns import json_count_map, label_text, settled, to_float
from ..functions.labels import source_tier, window_label
from ..operators.features import window_text
from ..operators.ordering import first_rows
from ..schemas import ALERT_MESSAGE_SCHEMA, RECORD_SCHEMA, TAG_KEYS, WINDOW_SCHEMA, as_text_leaves
from ..session import prepare

RECORD_FIELDS = [f for f in RECORD_SCHEMA.fields if f.name != "window"]
# A line is either a record holding a window, or the bare window itself.
LINE_SCHEMA = as_text_leaves(RECORD_SCHEMA)
BARE_SCHEMA = as_text_leaves(WINDOW_SCHEMA)


def _typed(text: Column, kind: T.DataType, name: str) -> Column:
    """A value of `kind` from its JSON text; a present but unreadable float is 0."""
    if name in TAG_KEYS:
        return label_text(text, as_label=name not in FAMILY_KEYS)
    if isinstance(kind, T.StructType):
        return F.when(text.isNotNull(), F.struct(*[_typed(text[f.name], f.dataType, f.name).alias(f.name) for f in kind.fields]))
    if isinstance(kind, T.DoubleType):
        return F.when(text.isNotNull(), to_float(text, 0.0))
    if isinstance(kind, T.LongType):
        return F.coalesce(text.try_cast("bigint"), text.try_cast("double").try_cast("bigint"))
    if isinstance(kind, T.IntegerType):
        return text.try_cast("int")
    if isinstance(kind, T.MapType):
        return F.when(text.isNotNull(), json_count_map(text))
    return text


def typed_window(field) -> Column:
    """The window struct from `field(name)`, the JSON text of each of its fields."""
    return F.struct(*[_typed(field(f.name), f.dataType, f.name).alias(f.name) for f in WINDOW_SCHEMA.fields])


def _is_object(value: Column) -> Column:
    return F.startswith(F.ltrim(value), F.lit("{")) & F.try_parse_json(value).isNotNull()


def undecodable(messages: DataFrame, value: str = "value") -> DataFrame:
    """Messages that are blank, malformed or no JSON object."""
    return messages.filter(~F.coalesce(_is_object(F.col(value).cast("string")), F.lit(False)))


def parse_records(messages: DataFrame, value: str = "value", *keep: str) -> DataFrame:
    """Records from JSON text; blank, malformed and non-object lines are dropped.

    A line without a `window` object is taken as the window itself.
    """
    text = F.col(value).cast("string")
    lines = messages.filter(_is_object(text)).select(F.from_json(text, LINE_SCHEMA).alias("_l"), text.alias("_t"), *keep)
    line = F.col("_l")
    # The window's texts are chosen once, not field by field; only a line without a window is read as one.
    chosen = lines.select("_l", F.coalesce(line["window"], F.from_json("_t", BARE_SCHEMA)).alias("_w"), *keep)
    return chosen.select(
        *[_typed(line[f.name], f.dataType, f.name).alias(f.name) for f in RECORD_FIELDS],
        typed_window(lambda name: F.col("_w")[name]).alias("window"), *keep
    )


def file_stem(path: Column) -> Column:
    """File name without folder and last extension; `unknown` when blank."""
    name = F.regexp_extract(path, "([^/]+)$", 1)
    plain = F.try_url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))
    stem = F.btrim(F.regexp_replace(plain, r"(?<=.)\.[^.]+$", ""))
    return F.coalesce(F.nullif(stem, F.lit("")), F.lit("unknown"))


# Where a line was read: number of its path, file and file split.
PLACE = ("_at", "_path", "_block")


def read_records(spark: SparkSession, paths: str | list[str], max_samples: int = 0, placed: bool = False) -> DataFrame:
    """JSONL records; `dataset_source` is the file stem and replaces any value in the line.

    `max_samples` keeps the first accepted records in path, then line order; every file split is still a task of its own. `placed` keeps the
    columns PLACE, by which write_dataset knows that order.
    """
    prepare(spark)
    paths = [paths] if isinstance(paths, str) else list(paths)
    parts = [
        spark.read.text(path).select("value", F.lit(at).alias("_at"), F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"))
        for at, path in enumerate(paths)]
    lines = union_sources(*parts)
    if max_samples > 0:
        lines = first_rows(lines.filter(_is_object(F.col("value"))), max_samples, PLACE)
    records = parse_records(lines, "value", *PLACE).withColumn("dataset_source", file_stem(F.col("_path")))
    return records if placed else records.drop(*PLACE)


def union_sources(*sources: DataFrame) -> DataFrame:
    """All rows of all sources; columns a source lacks are null."""
    union = sources[0]
    for source in sources[1:]:
        union = union.unionByName(source, allowMissingColumns=True)
    return union


def _messages(spark: SparkSession, source: str, starting: str, options: dict) -> DataFrame:
    if source == "kafka":
        settings = {"startingOffsets": starting, **options}
        return spark.readStream.format("kafka").options(**settings).load().select(
            F.col("value").cast("string").alias("value")
        )
    return spark.readStream.format("text").options(**options).load(source)


def read_window_stream(spark: SparkSession, source: str, starting: str = "latest", **options) -> DataFrame:
    """Window messages from Kafka (`source="kafka"`) or from a folder of JSONL files.

    Detection starts at the newest message, exports pass `starting="earliest"`.
    Undecodable messages are dropped; offsets live in the query's checkpoint.
    """
    return parse_records(_messages(prepare(spark), source, starting, options))


def parse_alerts(messages: DataFrame, value: str = "value") -> DataFrame:
    text = F.col(value).cast("string")
    parsed = messages.filter(_is_object(text)).select(F.from_json(text, as_text_leaves(ALERT_MESSAGE_SCHEMA)).alias("_a"))
    a = F.col("_a")
    fields = [
        (typed_window(lambda name: a["window"][name]) if f.name == "window" else _typed(a[f.name], f.dataType, f.name)).alias(f.name)
        for f in ALERT_MESSAGE_SCHEMA.fields
    ]
    return parsed.select(*fields).withColumn("timestamp", settled(F.col("timestamp"))).filter(F.col("timestamp").isNotNull())


def read_alert_stream(spark: SparkSession, source: str, starting: str = "earliest", **options) -> DataFrame:
    """Alert messages; malformed ones are dropped."""
    return parse_alerts(_messages(prepare(spark), source, starting, options))


def labeled_rows(records: DataFrame, *keep: str) -> DataFrame:
    """Dataset rows of raw windows: id from the bounds, text, label with source and tier, and columns to keep."""
    w = F.col("window")
    rows = window_text(records.withColumn("_l", window_label("window")), output="_text")
    return rows.select(
        F.concat_ws("-", w["window_start_ms"], w["window_end_ms"]).alias("id"),
        w["window_start_ms"].alias("window_start_ms"), w["window_end_ms"].alias("window_end_ms"),
        F.col("_text").alias("text"), F.col("_l.label").alias("label"),
        F.col("_l.label_source").alias("label_source"),
        source_tier(F.col("_l.label_source")).alias("label_quality_tier"), "window", *keep,
    )


def write_dataset(rows: DataFrame, path: str, max_rows: int = 0) -> None:
    """JSONL dataset; `max_rows` above 0 keeps the first rows: in path and line order if `rows` have the columns PLACE, else in their own order.

    Every task writes what it read. The columns PLACE are not written.
    """
    place = PLACE if all(c in rows.columns for c in PLACE) else ()
    (first_rows(rows, max_rows, place) if max_rows > 0 else rows).drop(*PLACE).write.mode("overwrite").json(path)


def write_alerts(alerts: DataFrame, sink: str, **options) -> None:
    """Alert messages to Kafka (`sink="kafka"`) or to a folder of JSONL files; `options` are those of the writer, such as `compression`."""
    if sink == "kafka":
        message = F.to_json(F.struct(*alerts.columns)).alias("value")
        alerts.select(message).write.format("kafka").options(**options).save()
    else:
        alerts.write.options(**options).mode("append").json(sink)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def write_report(report: DataFrame, path: str) -> None:
    """A small report as one JSON document per row, in one file."""
    report.coalesce(1).write.mode("overwrite").json(path)
