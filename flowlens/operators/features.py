"""Feature maps and text summaries of flow windows; tumbling windows over raw events."""

from pyspark.sql import Column, DataFrame, functions as F

from ..constants import CATEGORY_FIELDS, FEATURE_SCHEMA, NUMERIC_FIELDS, OPTIONAL_TEXT_FIELDS
from ..functions.columns import category, clean_count_map, fixed_text, strip
from ..session import prepare

STATS = ("total", "unique", "peak", "mean", "std", "concentration")
MAP_PREFIXES = ("source_ip", "destination_ip", "proto", "service", "state")


# The expressions below are SQL text: one call builds each, where column objects
# would take thousands of calls into the JVM.
STATS_SQL = """
transform(array(struct(map_values({0}) AS v, aggregate(map_values({0}), 0D, (acc, x) -> acc + x) AS t)), s ->
  transform(array(if(size(s.v) = 0, 0D, try_divide(s.t, size(s.v)))), mean -> array(
    s.t, CAST(size(s.v) AS DOUBLE), CAST(coalesce(array_max(s.v), 0) AS DOUBLE), mean,
    if(size(s.v) = 0, 0D, sqrt(try_divide(aggregate(s.v, 0D, (acc, x) -> acc + (x - mean) * (x - mean)), size(s.v)))),
    if(s.t = 0, 0D, try_divide(CAST(coalesce(array_max(s.v), 0) AS DOUBLE), s.t))))[0])[0]
"""

COUNT_CELLS_SQL = """
flatten(transform(sort_array(map_entries({counts})), e -> transform(
  array(coalesce(nullif(btrim(e.key, ' \\t\\n\\r'), ''), 'unknown')), k -> array(
    named_struct('key', concat('{prefix}=', k), 'value', CAST(e.value AS DOUBLE)),
    named_struct('key', concat('{prefix}_rate=', k), 'value', if({total} = 0, 0D, try_divide(CAST(e.value AS DOUBLE), {total}))))
  )[0]))
"""


def map_stats(counts: str) -> Column:
    """Total, distinct keys, peak, mean, population deviation and peak share, in the order of `STATS`.

    All are 0 for an empty map. The one-element `transform`s compute total and mean once
    per row, where a plain column expression would be repeated in each use.
    """
    return F.expr(STATS_SQL.format(counts))


def sparse_count_features(prefix: str, counts: str) -> Column:
    """Map of `prefix=key` counts and `prefix_rate=key` shares.

    Keys are trimmed; when two keys fall together the one sorting last wins.
    """
    total = f"aggregate(map_values({counts}), 0D, (acc, x) -> acc + x)"
    return F.expr(f"map_from_entries({COUNT_CELLS_SQL.format(prefix=prefix, counts=counts, total=total)})")


PARTS = "_p_"


def part(name: str) -> Column:
    return F.col(PARTS + name)


def _with_parts(df: DataFrame, parts: dict[str, Column]) -> DataFrame:
    """Adds helper columns, each computed once per row whatever its number of uses.

    They are top-level columns: Spark copies the fields of a helper struct into every use.
    """
    return df.withColumns({PARTS + name: value for name, value in parts.items()})


def _without_parts(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(PARTS)])


def _with_flow_parts(df: DataFrame, window: str) -> DataFrame:
    """Adds cleaned counts, categories and derived numbers of each window as helper columns."""
    w = F.col(window)

    def or_single(counts: Column, key: Column) -> Column:
        single = F.when(F.length(key) > 0, F.create_map(key, F.lit(1).cast("bigint")))
        return F.when(F.size(counts) > 0, counts).otherwise(F.coalesce(single, counts))

    events = F.greatest(F.lit(1).cast("bigint"), F.coalesce(w["event_count"], F.lit(1).cast("bigint")))
    first = _with_parts(df, {
        "event_count": events.cast("double"),
        **{n: category(w[n]) for n in CATEGORY_FIELDS},
        **{n: F.coalesce(w[n], F.lit(0.0)) for n in ("sbytes", "dbytes", "spkts", "dpkts", "dur")},
        **{f"{n}_clean": clean_count_map(w[f"counts_by_{n}"]) for n in MAP_PREFIXES},
    })
    keys = {"source_ip": strip(w["srcip"]), "destination_ip": strip(w["dstip"]), **{n: part(n) for n in CATEGORY_FIELDS}}
    second = _with_parts(first, {
        "bytes_total": part("sbytes") + part("dbytes"), "packets_total": part("spkts") + part("dpkts"),
        "seconds": F.greatest(part("dur"), F.lit(1e-6)),
        **{f"{n}_counts": or_single(part(f"{n}_clean"), keys[n]) for n in MAP_PREFIXES},
    })
    return _with_parts(second, {
        "sbytes_ratio": part("sbytes") / F.greatest(part("bytes_total"), F.lit(1.0)),
        "spkts_ratio": part("spkts") / F.greatest(part("packets_total"), F.lit(1.0)),
        "bytes_per_packet": part("bytes_total") / F.greatest(part("packets_total"), F.lit(1.0)),
        "packets_per_second": part("packets_total") / part("seconds"),
        "bytes_per_second": part("bytes_total") / part("seconds"),
        **{f"{n}_distinct": F.coalesce(w[f"unique_{n}_count"], F.size(part(f"{n}_counts")).cast("bigint")).cast("double")
           for n in MAP_PREFIXES},
    })


RATIOS = (
    "bytes_total", "packets_total", "sbytes_ratio", "spkts_ratio", "bytes_per_packet",
    "packets_per_second", "bytes_per_second",
)


def _spread(prefix: str) -> Column:
    return part(f"{prefix}_distinct") / part("event_count")


def flow_features(df: DataFrame, window: str = "window", output: str = "features") -> DataFrame:
    """Adds the sparse feature map of each flow window; missing numeric fields are left out.

    A category's count replaces its one-hot value, because both share the name `proto=x`.
    Filter rows before this step: later filters are not moved below it.
    """
    prepare(df.sparkSession)
    # The steps of `map_stats` as columns of their own: lambdas are interpreted, so they do the sums and nothing else.
    values = _with_parts(_with_flow_parts(df, window), {
        **{f"{n}_values": F.map_values(part(f"{n}_counts")) for n in MAP_PREFIXES},
        **{f"{n}_sorted": F.sort_array(F.map_entries(part(f"{n}_counts"))) for n in CATEGORY_FIELDS}})
    sums = _with_parts(values, {
        name: F.expr(value.format(f"{PARTS}{n}_values")) for n in MAP_PREFIXES for name, value in (
            (f"{n}_total", "aggregate({0}, 0D, (acc, x) -> acc + x)"), (f"{n}_unique", "CAST(size({0}) AS DOUBLE)"),
            (f"{n}_peak", "CAST(coalesce(array_max({0}), 0) AS DOUBLE)"))})
    means = _with_parts(sums, {
        name: F.expr(value.format(PARTS + n)) for n in MAP_PREFIXES for name, value in (
            (f"{n}_mean", "if({0}_unique = 0D, 0D, try_divide({0}_total, {0}_unique))"),
            (f"{n}_concentration", "if({0}_total = 0D, 0D, try_divide({0}_peak, {0}_total))"))})
    names = _with_parts(means, {
        name: F.expr(value.format(f"{PARTS}{n}_sorted")) for n in CATEGORY_FIELDS for name, value in (
            (f"{n}_names", "transform({0}.key, k -> coalesce(nullif(btrim(k, ' \\t\\n\\r'), ''), 'unknown'))"),
            (f"{n}_numbers", "CAST({0}.value AS ARRAY<DOUBLE>)"))})
    parts = _with_parts(names, {
        f"{n}_std": F.expr("if({0}_unique = 0D, 0D, sqrt(try_divide(aggregate({0}_values, 0D, (acc, x) -> acc + (x - {0}_mean) * (x - {0}_mean)), {0}_unique)))"
                           .format(PARTS + n)) for n in MAP_PREFIXES})
    always = {
        "event_count": f"{PARTS}event_count",
        **{name: PARTS + name for name in RATIOS},
        **{f"unique_{n}_count": f"greatest(0D, {PARTS}{n}_distinct)" for n in MAP_PREFIXES},
        **{f"{n}_spread": f"{PARTS}{n}_distinct / {PARTS}event_count" for n in ("source_ip", "destination_ip")},
        **{f"{n}_{stat}": f"{PARTS}{n}_{stat}" for n in MAP_PREFIXES for stat in STATS},
    }
    # Names and values lie in two arrays, as structs of cells would be built one by one; no lambda goes over the fixed cells.
    given = lambda n, value: f"if(`{window}`.{n} IS NULL, array(), array({value}))"
    keys = [f"flatten(array({', '.join(given(n, repr(n)) for n in NUMERIC_FIELDS)}))",
            f"array({', '.join([*map(repr, always), *(f"concat('{n}=', {PARTS}{n})" for n in CATEGORY_FIELDS)])})"]
    numbers = [f"flatten(array({', '.join(given(n, f'`{window}`.{n}') for n in NUMERIC_FIELDS)}))",
               f"array({', '.join([*always.values(), *('1D' for _ in CATEGORY_FIELDS)])})"]
    for n in CATEGORY_FIELDS:
        keys += [f"transform({PARTS}{n}_names, k -> concat('{n}=', k))", f"transform({PARTS}{n}_names, k -> concat('{n}_rate=', k))"]
        numbers += [f"{PARTS}{n}_numbers", f"transform({PARTS}{n}_numbers, v -> if({PARTS}{n}_total = 0D, 0D, try_divide(v, {PARTS}{n}_total)))"]
    cells = f"map_from_arrays(concat({', '.join(keys)}), concat({', '.join(numbers)}))"
    # A filter on the map would otherwise be moved below it, with the whole expression copied
    # into each use; a value that depends on the partition id stays where it is.
    kept = F.expr(f"if(spark_partition_id() < 0, NULL, {cells})")
    return _without_parts(parts.withColumn(output, kept))


def window_text(df: DataFrame, window: str = "window", output: str = "window_text") -> DataFrame:
    """Adds the one-line text summary of each flow window; labels never enter it."""
    w = F.col(window)
    numbers = (
        ("dur", part("dur"), 6), ("sbytes", part("sbytes"), 3), ("dbytes", part("dbytes"), 3),
        ("spkts", part("spkts"), 3), ("dpkts", part("dpkts"), 3),
        ("bytes_total", part("bytes_total"), 3), ("packets_total", part("packets_total"), 3),
        ("bytes_per_second", part("bytes_per_second"), 3), ("packets_per_second", part("packets_per_second"), 3),
        ("source_ip_spread", _spread("source_ip"), 3), ("destination_ip_spread", _spread("destination_ip"), 3),
    )
    optional = tuple((name, w[name], 3) for name in OPTIONAL_TEXT_FIELDS)
    rendered = _with_parts(
        _with_flow_parts(df, window), {"texts": fixed_text(*[(c, n) for _, c, n in numbers + optional])}
    )
    text = lambda at: part("texts")[at]
    pieces = [F.lit(f"feature_schema={FEATURE_SCHEMA}"),
              F.concat(F.lit("event_count="), part("event_count").cast("bigint").cast("string"))]
    pieces += [F.concat(F.lit(f"{name}="), text(at)) for at, (name, _, _) in enumerate(numbers)]
    pieces += [F.concat(F.lit(f"{name}="), part(name)) for name in CATEGORY_FIELDS]
    pieces += [
        F.concat(F.lit(f"{name}="), text(at)) for at, (name, _, _) in enumerate(optional, len(numbers))
    ]
    return _without_parts(rendered.withColumn(output, F.concat_ws(" ", *pieces)))


def _key_counts(events: DataFrame, time: Column, dims: dict[str, str]) -> DataFrame:
    """Counts per (window, dimension, value): a hot value is summed before the shuffle."""
    pairs = F.array(*[
        F.struct(F.lit(dim).alias("dim"), category(col).alias("key")) for dim, col in dims.items()
    ])
    return (
        events.select(time.alias("_w"), F.explode(pairs).alias("_pair"))
        .groupBy("_w", F.col("_pair.dim").alias("dim"), F.col("_pair.key").alias("key"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def window_rows(counts: DataFrame, dims: dict[str, str]) -> DataFrame:
    """One row per window from its (dimension, key, n) counts."""
    per_dim = []
    for dim in dims:
        entry = F.when(F.col("dim") == dim, F.struct("key", "n"))
        per_dim.append(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias(f"counts_by_{dim}"))
        per_dim.append(F.count(F.when(F.col("dim") == dim, 1)).alias(f"unique_{dim}_count"))
    first = next(iter(dims))
    rows = counts.groupBy("_w").agg(
        F.sum(F.when(F.col("dim") == first, F.col("n"))).alias("event_count"), *per_dim
    )
    start, end = F.unix_millis(F.col("_w.start")), F.unix_millis(F.col("_w.end"))
    return rows.select(
        F.concat_ws("-", start, end).alias("id"), start.alias("window_start_ms"), end.alias("window_end_ms"),
        F.lit(FEATURE_SCHEMA).alias("feature_schema"), "event_count",
        *[f"{part}_{dim}{tail}" for dim in dims for part, tail in (("counts_by", ""), ("unique", "_count"))],
    )


def build_windows(
    events: DataFrame, window_ms: int, dims: dict[str, str], time: str = "ts",
) -> DataFrame:
    """Tumbling windows over raw events: one count map and distinct count per dimension.

    `dims` names each dimension and its event column. The same call works on a
    watermarked stream, where a window comes out once the watermark has passed it.
    """
    prepare(events.sparkSession)
    bucket = F.window(F.col(time).cast("timestamp"), f"{window_ms} milliseconds")
    return window_rows(_key_counts(events, bucket, dims), dims)
