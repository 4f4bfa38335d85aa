"""Quality scores by Bradley-Terry ranking of preference pairs.

A document of quality 1 is preferred to one of quality 0: the probability that one wins is the logistic function of
the difference of two scores, which are linear in the documents' features. The weights minimise the logistic loss on
feature differences. Documents are accepted above a quantile of the scores, chosen on the rows of the fit: all labelled ones that
fitting may see. Moments, pairs, Newton steps and the quantile are passes of Spark over them.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from flowlens.llm.common import free_name, held_out, small_batches, stored
from flowlens.llm.linear import fit_logistic_rows, labelled_rows, sigmoid, sum_over
from flowlens.operators.ordering import prefix_sums, with_row_index

# Preference pairs of a small table, and pairs of each document of the larger class in a large one.
PAIRS = 24_000
ROUNDS = 6
# Characters that are measured at once; the features of longer texts are means over their parts.
PART = 1 << 21
FEATURES = (
    "log_words", "word_length", "upper", "digits", "symbols", "bangs", "stops", "commas", "high_bytes", "new_lines", "bars", "symbol_words",
    "distinct_words", "top_word", "same_as_before", "distinct_pairs", "distinct_triples", "distinct_lines", "short_words", "line_length", "packed",
    "any_symbol_words", "any_bars", "any_bangs", "mostly_upper", "few_words",
)
_SYMBOLS = np.frombuffer(b"#*$%&|<>~^=+\\{}[]@_", np.uint8)


def _measure(text: str) -> list[float]:
    data = text.encode("utf-8", "surrogatepass")
    size = max(1, len(data))
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    letters = max(1, int(counts[65:91].sum() + counts[97:123].sum()))
    words = text.split()
    n = len(words)
    some = max(1, n)
    often = Counter(words)
    pairs = set(zip(words, words[1:]))
    triples = set(zip(words, words[1:], words[2:]))
    lines = [x for x in text.split("\n") if x.strip()]
    symbols = int(counts[_SYMBOLS].sum())
    symbol_words = sum(c for w, c in often.items() if w[-1] in "#*$%&|<>~^=+")
    bars, bangs, upper = int(counts[124]), int(counts[33]), int(counts[65:91].sum()) / letters
    return [
        np.log1p(n), len(data) / some / 10, upper, counts[48:58].sum() / size * 10, symbols / size * 10, bangs / some, counts[46] / some, counts[44] / some,
        counts[128:].sum() / size, counts[10] / some * 10, bars / some, symbol_words / some,
        np.log1p(len(often)) / np.log1p(some + 1), max(often.values(), default=0) / some, sum(a == b for a, b in zip(words, words[1:])) / some,
        len(pairs) / max(1, n - 1), len(triples) / max(1, n - 2), len(set(lines)) / max(1, len(lines)),
        sum(c for w, c in often.items() if len(w) <= 3) / some, np.log1p(len(data) / max(1, len(lines))),
        len(zlib.compress(data, 1)) / size,
        min(1.0, symbol_words / some * 5), min(1.0, bars / some * 5), min(1.0, bangs / some * 5), float(upper > 0.5), max(0.0, 1 - n / 20),
    ]


def features(text: str) -> np.ndarray:
    """FEATURES of a whole text."""
    parts = [text[i:i + PART] for i in range(0, len(text), PART)] or [""]
    return np.average([_measure(p) for p in parts], axis=0, weights=[len(p) or 1 for p in parts])


@dataclass(frozen=True)
class RankModel:
    """Score of a text: weights times scaled features; `scale` and `shift` lay the cut of the raw scores at `cut`."""

    centre: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    scale: float
    shift: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.centre) / self.spread, -6, 6) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.scale * self.raw(x) + self.shift)


def preference_pairs(good: int, bad: int, most: int = PAIRS) -> tuple[np.ndarray, np.ndarray]:
    """Places of the preferred and the other documents of at most `most` pairs, dealt evenly over both sides."""
    n = min(most, good * bad)
    i = np.arange(n)
    larger, smaller = max(good, bad), min(good, bad)
    a = i % max(1, larger)
    b = (a + i // max(1, larger)) % max(1, smaller)
    return (a, b) if good >= bad else (b, a)


def _pair_rows(good: DataFrame, bad: DataFrame, sizes: tuple[int, int]) -> DataFrame:
    """(x, y, weight): the feature differences of the pairs of `preference_pairs`, by a join over the places in both classes.

    Every document is in some pair: there are PAIRS of them or ROUNDS for each document of the larger class, or all that there are.
    """
    larger, smaller = max(sizes), min(sizes)
    n = min(larger * smaller, max(PAIRS, ROUNDS * larger))
    one, other = (good, bad) if sizes[0] >= sizes[1] else (bad, good)
    dealt = one.select("place", F.col("z").alias("_one"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit((n - 1) // larger).cast("long"))).alias("_round"))
    dealt = dealt.where(F.col("_round") * larger + F.col("place") < n).withColumn("place", (F.col("place") + F.col("_round")) % smaller)
    sign = 1.0 if one is good else -1.0
    joined = dealt.join(other.select("place", F.col("z").alias("_other")), "place")
    return stored(joined.select(F.zip_with("_one", "_other", lambda a, b: (a - b) * sign).alias("x"), F.lit(1.0).alias("y"), F.lit(1.0).alias("weight")))


def best_quantile(rows: DataFrame, sizes: tuple[int, int]) -> float:
    """The raw score at the quantile that, as a cut, gives the best mean of both classes' hit rates; midway to the next score.

    `rows` has raw and label; `sizes` are the counts of labels 1 and 0.
    """
    counts = rows.groupBy("raw").agg(F.count_if(F.col("label") == 1).alias("good"), F.count_if(F.col("label") == 0).alias("bad"))
    through = prefix_sums(counts, (), [F.col("raw")], ("good", "bad"))
    gain = F.col("bad_through") / F.lit(float(max(1, sizes[1]))) - F.col("good_through") / F.lit(float(max(1, sizes[0])))
    at = through.orderBy(gain.desc(), "raw").first()["raw"]
    after = counts.where(F.col("raw") > F.lit(at)).agg(F.min("raw")).first()[0]
    return (at + (at if after is None else after)) / 2


def fit(docs: DataFrame, labels: DataFrame, cut: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> RankModel:
    """The model of all labelled rows that fitting may see, never the held-out ones.

    The driver gets sums, one short vector a task. Without rows of both classes every text scores 0.5.
    """
    small_batches(docs.sparkSession)

    @F.pandas_udf("array<double>")
    def measured(text: pd.Series) -> pd.Series:
        return pd.Series([features(t).tolist() for t in text])

    width = len(FEATURES)
    rows = stored(labelled_rows(docs, labels, "quality", id_col, text_col).select("doc_id", "label", measured("text").alias("x")))
    found = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    zero = np.zeros(width)
    if set(found) != {0, 1}:
        return RankModel(zero, zero + 1, zero, 0.0, 0.0)
    sizes, n = (found[1], found[0]), found[0] + found[1]
    centre = sum_over(rows, ["x"], lambda x: x.sum(0)) / n
    spread = np.sqrt(sum_over(rows, ["x"], lambda x: ((x - centre) ** 2).sum(0)) / n) + 1e-6

    @F.pandas_udf("array<double>")
    def scaled(x: pd.Series) -> pd.Series:
        return pd.Series(list(np.clip((np.stack(x.to_numpy()) - centre) / spread, -6, 6)) if len(x) else [])

    z = rows.select("doc_id", "label", scaled("x").alias("z"), F.xxhash64("doc_id").alias("_hash"))
    good, bad = (with_row_index(z.where(F.col("label") == y), ["_hash", "doc_id"], "place") for y in (1, 0))
    weights = fit_logistic_rows(_pair_rows(good, bad, sizes), width, ridge=3.0)

    @F.pandas_udf("double")
    def raw(z: pd.Series) -> pd.Series:
        return pd.Series([float(v @ weights) for v in z], dtype="float64")

    ranked = stored(good.unionByName(bad).select("label", raw("z").alias("raw")))
    at = best_quantile(ranked, sizes)
    # A slope for the probability of label 1; the cut of the scores lies at the chosen quantile.
    balance = F.when(F.col("label") == 1, n / 2 / sizes[0]).otherwise(n / 2 / sizes[1])
    sides = stored(ranked.select(F.array(F.col("raw") - F.lit(at)).alias("x"), F.col("label").cast("double").alias("y"), balance.alias("weight")))
    slope = float(np.clip(fit_logistic_rows(sides, 1)[0], 0.05, 5.0))
    return RankModel(centre, spread, weights, slope, float(np.log(cut / (1 - cut)) - slope * at))


def scored(docs: DataFrame, model: RankModel, out: str, text_col: str = "text") -> DataFrame:
    """`docs` with the score of each whole text, 0 to 1; a null text is empty. Rows and columns stay as they are."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def of(text: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([features(t or "") for t in text]).reshape(-1, len(FEATURES))), dtype="float64")

    return docs.withColumn(out, of(F.coalesce(docs[text_col].cast("string"), F.lit(""))))


def classify(docs: DataFrame, model: RankModel, cut: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted): predicted is 1 from a score of `cut` on.

    One row per row of `docs`; repeated and null ids keep their rows, a null or empty text is scored as a text
    without words, an empty table gives an empty result.
    """
    key = docs[id_col].cast("long")
    rows = docs.select(key.alias("doc_id"), docs[text_col].alias("text"))
    return scored(rows, model, "score").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: RankModel, cut: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of `docs` whose score is `cut` or more, with all their columns."""
    name = free_name(docs, "quality_score")
    return scored(docs, model, name, text_col).where(F.col(name) >= cut).drop(name)
