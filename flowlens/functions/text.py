"""Text checks: normalization, identifiers, secrets, credentials in URLs."""

import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..constants import (
    CONTROL_CHARACTERS, IDENTIFIER_PATTERN, PLACEHOLDER_MARKERS, SECRET_LITERALS, SECRET_PATTERNS,
    SENSITIVE_KEYS,
)
from .columns import as_column, strip

UNICODE_WHITESPACE = " \t\n\r\x0b\x0c\x85\u1680\u2028\u2029"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


@F.arrow_udf(T.StringType())
def nfkc(values: pa.Array) -> pa.Array:
    # Arrow's own NFKC leaves letters and accents apart.
    return pa.array([None if v is None else unicodedata.normalize("NFKC", v) for v in values.to_pylist()], pa.string())


def normalized(col) -> Column:
    """NFKC, line feeds only, no control characters, trimmed."""
    text = F.regexp_replace(nfkc(as_column(col)), "\r\n?", "\n")
    text = F.regexp_replace(text, CONTROL_CHARACTERS, "")
    return F.btrim(text, F.lit(UNICODE_WHITESPACE))


def normalize_text(df: DataFrame, col: str, max_length: int = 5000, allow_empty: bool = False) -> DataFrame:
    """Adds `<col>_normalized` and `violation`: `empty`, `too_long` or null."""
    value = F.col(f"{col}_normalized")
    violation = (
        F.when(value.isNull() | ((F.length(value) == 0) & F.lit(not allow_empty)), "empty")
        .when(F.length(value) > max_length, "too_long")
    )
    return df.withColumn(f"{col}_normalized", normalized(col)).withColumn("violation", violation)


def check_identifier(df: DataFrame, col: str, max_length: int = 255) -> DataFrame:
    """As `normalize_text`, with the further violations `whitespace` and `unsupported`."""
    value = F.col(f"{col}_normalized")
    violation = (
        F.when(F.col("violation").isNotNull(), F.col("violation"))
        .when(value.rlike(r"(?U)\s"), "whitespace")
        .when(~value.rlike(IDENTIFIER_PATTERN), "unsupported")
    )
    return normalize_text(df, col, max_length).withColumn("violation", violation)


def secret_scan(df: DataFrame, text_col: str, *keep: str) -> DataFrame:
    """One row per (row, line, finding): known secret patterns and sensitive `KEY=value` lines.

    Plain substring tests drop rows and lines that cannot hold a finding; a pattern only
    runs on lines with its fixed part.
    """
    def has_any(col: Column, words) -> Column:
        found = F.lit(False)
        for word in words:
            found = found | F.contains(col, F.lit(word))
        return found

    clues = SECRET_LITERALS + SENSITIVE_KEYS
    lines = df.filter(has_any(F.col(text_col), clues)).select(
        *keep, F.posexplode(F.split(F.col(text_col), LINE_BREAK)).alias("_at", "_line")
    ).filter(has_any(F.col("_line"), clues))
    line = F.col("_line")
    stripped = strip(line)
    key = strip(F.substring_index(stripped, "=", 1))
    value = strip(F.substring(stripped, F.instr(stripped, "=") + F.lit(1), F.length(stripped)))
    placeholder = has_any(F.lower(value), PLACEHOLDER_MARKERS)
    assigned = (
        F.contains(stripped, F.lit("=")) & ~F.startswith(stripped, F.lit("#"))
        & key.isin(*SENSITIVE_KEYS) & (F.length(value) > 0) & ~placeholder
    )
    findings = F.array(
        *[F.when(F.contains(line, F.lit(clue)) & line.rlike("(?U)" + p),
                 F.struct(F.lit("pattern").alias("kind"), F.lit(p).alias("name")))
          for clue, p in zip(SECRET_LITERALS, SECRET_PATTERNS)],
        F.when(assigned, F.struct(F.lit("assignment").alias("kind"), key.alias("name"))),
    )
    return (
        # `explode` would add a filter that runs every pattern a second time.
        lines.select(*keep, (F.col("_at") + 1).alias("line_no"), F.explode_outer(F.array_compact(findings)).alias("f"))
        .filter(F.col("f").isNotNull()).select(*keep, "line_no", "f.kind", "f.name")
    )


def redact_credentials(col) -> Column:
    """Replaces the first `:secret@` of a URL by `:****@`."""
    return F.regexp_replace(as_column(col), r"(?s)^(.*?):[^:@/]+@", r"$1:\*\*\*\*@")
