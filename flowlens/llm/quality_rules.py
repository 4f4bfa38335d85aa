"""Quality rules by distribution divergence.

A document's histograms of character classes and of common words are compared with its language's by the
Jensen-Shannon distance. The references are mean histograms of each language over all documents that pass the
base rules and lie near the first such means; a language of few documents is drawn towards the mean of all. Short texts, whose
histograms say little, are held to wider distances, and below a length of its own for each histogram to none. SQL functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from flowlens.llm.common import stored
from flowlens.session import broadcast_if_small

# Base rules.
LEAST_WORDS = 50
MOST_REPEATED = 50
# Words a text needs for each histogram to be compared, and largest distances; slack over the root of the words is added.
GUARDS = {"characters": 60, "common": 100}
CHARACTER_DISTANCE = 0.13
WORD_DISTANCE = 0.35
SLACK = 0.5
# Weight of the mean of all documents, in documents, in a language's reference.
SHARED_DOCUMENTS = 100

# The commonest words of English, German, French and Spanish.
COMMON = (
    "the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "with", "was", "der", "die", "und", "das", "von", "zu", "mit", "den", "ist",
    "le", "les", "des", "et", "un", "une", "la", "de", "en", "que", "el", "y", "los", "se",
)
_WHITE = " \t\n\x0b\x0c\r"
_WORDS = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
# Character classes by the pattern of all other characters.
CLASSES = {"upper": "[^A-Z]+", "digit": "[^0-9]+", "stops": r"[^.,;:!?'\"()\-]+", "symbol": r"[^#*$%&|<>~^=+\\{}\[\]@_/`]+"}

# Histograms and their classes.
SIZES = {"characters": len(CLASSES) + 2, "common": len(COMMON) + 1}


def words(text: Column) -> Column:
    """Runs without ASCII white space."""
    bare = F.trim(text, F.lit(_WHITE))
    return F.when(F.octet_length(bare) > 0, F.split(bare, _WORDS)).otherwise(F.array().cast("array<string>"))


def repeated_words(w: Column) -> Column:
    """Words in runs of three that the text has twice or more, the first included; all runs are sorted by hash once."""
    runs = F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.struct(
        F.xxhash64(F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2)).alias("h"), i.alias("i")))
    twice = F.flatten(F.transform(F.array(F.sort_array(runs)), lambda s: F.transform(
        F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"])), lambda x: x["i"])))
    # Each place covers three words, less what the next one covers as well.
    covered = F.aggregate(
        F.sort_array(twice), F.struct(F.lit(0).alias("n"), F.lit(-2).alias("last")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])
    return F.when(F.size(w) >= 4, covered).otherwise(0).cast("long")


def _added(shares: Column) -> Column:
    return F.aggregate(shares, F.lit(0.0), lambda a, x: a + x)


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance, 0 to 1, of two histograms of shares."""
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    divergence = _added(F.zip_with(p, q, lambda a, b: (part(a, (a + b) / 2) + part(b, (a + b) / 2)) / 2))
    return F.sqrt(F.greatest(divergence, F.lit(0.0)))


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, characters, common) of each whole text.

    characters and common are histograms of shares: of the character classes, and of COMMON and all other words.
    """
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[lang_col].cast("string").alias("lang"), text.alias("text"), F.array(words(text)).alias("list"))
    text = F.col("text")
    lines = F.filter(F.split(text, "\n"), lambda x: F.octet_length(F.trim(x, F.lit(_WHITE))) > 0)
    # Each text is cut into words once; two blanks between words let each stand alone between its own.
    cut = rows.select(
        "doc_id", "lang", F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x)))[0].cast("long").alias("n_dup_lines"),
        F.length(text).alias("n_chars"), *(F.length(F.regexp_replace(text, others, "")).alias(name) for name, others in CLASSES.items()),
        F.inline(F.transform("list", lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_words(w).alias("n_repeat_words"),
            F.lower(F.concat(F.lit(" "), F.array_join(w, "  "), F.lit(" "))).alias("apart")))))
    share = lambda n, of: F.coalesce(n / F.nullif(of, F.lit(0)), F.lit(0.0))
    named = [F.col(c) for c in CLASSES]
    white = F.col("n_chars") - F.col("word_chars")
    apart, n = F.col("apart"), F.col("n_words")
    found = F.array(*((F.octet_length(apart) - F.octet_length(F.replace(apart, F.lit(f" {x} "), F.lit("")))) / (len(x) + 2) for x in COMMON))
    return cut.select(
        "doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.array(*(share(c, F.col("n_chars")) for c in [*named, white, F.col("n_chars") - white - sum(named[1:], named[0])])).alias("characters"),
        F.transform(F.array(found), lambda c: F.concat(F.transform(c, lambda x: share(x, n)), F.array(share(n - _added(c), n))))[0].alias("common"))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def references(measured: DataFrame) -> DataFrame:
    """(lang, documents, characters, common): mean histograms of each language over the rows of `measured`."""
    means = [F.array(*(F.avg(F.col(c)[i]) for i in range(n))).alias(c) for c, n in SIZES.items()]
    return measured.groupBy("lang").agg(F.count("*").alias("documents"), *means)


def distances(measured: DataFrame, known: DataFrame) -> DataFrame:
    """`measured` with its character_distance and word_distance from the references `known`.

    The reference of a language with n documents is its own mean with weight n and the mean of all with weight SHARED_DOCUMENTS, so that it
    does not jump as documents come in; a null language, and one without a mean, is held to the mean of all. The references are one row per
    language; they are sent to all tasks if a count shows that they are few.
    """
    total = F.sum("documents")
    overall = known.agg(*(F.array(*(F.sum(F.col(c)[i] * F.col("documents")) / total for i in range(n))).alias(c) for c, n in SIZES.items())).first()
    everyone = {c: F.array(*(F.lit(x) for x in (overall[c] if overall[c][0] is not None else [0.0] * n))) for c, n in SIZES.items()}
    n = F.col("documents")
    blended = lambda c: F.zip_with(c, everyone[c], lambda own, all: (own * n + all * SHARED_DOCUMENTS) / (n + SHARED_DOCUMENTS))
    own = known.where(F.col("lang").isNotNull()).select("lang", *(blended(c).alias(f"own_{c}") for c in SIZES))
    against = lambda c: js_distance(F.col(c), F.coalesce(f"own_{c}", everyone[c]))
    return measured.join(broadcast_if_small(own), "lang", "left").select(
        *measured.columns, against("characters").alias("character_distance"), against("common").alias("word_distance"))


def near() -> Column:
    """Whether the distances of the histograms that the text is long enough for are within their bounds, which widen for short texts."""
    slack = SLACK / F.sqrt(F.greatest(F.col("n_words"), F.lit(1)))
    short = lambda c: F.col("n_words") < GUARDS[c]
    return (short("characters") | (F.col("character_distance") <= CHARACTER_DISTANCE + slack)) & (
        short("common") | (F.col("word_distance") <= WORD_DISTANCE + slack))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, character_distance, word_distance).

    One row per row of `docs`. A text that passes the base rules is kept if each histogram that it is long enough for (GUARDS) lies within
    its bound of the language's reference. References are taken twice: from all documents that pass the base rules, then from those
    of them that lie near the first ones, so that a share of odd documents does not shape them. Null and empty texts have no
    words and fail; a null language is held to the mean of all; repeated rows and null ids keep their rows; an empty
    table gives an empty result.
    """
    measured = stored(measures(docs, id_col, text_col, lang_col))
    good = measured.where(~base_failed() & (F.col("n_words") >= max(GUARDS.values())))
    known = stored(references(good))
    known = stored(references(distances(good, known).where(near())))
    judged = distances(measured, known)
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"),
        (~base_failed() & near()).alias("kept"), "character_distance", "word_distance")
