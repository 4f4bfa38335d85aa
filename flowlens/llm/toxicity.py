"""Toxicity by weak supervision.

Many voters look at a text: one per lexicon word or stem, and patterns around the words that were found (several of them,
dense, repeated, aimed at a person, shouted, spelled with signs, none at all). Each votes toxic, not toxic or abstains.
A generative label model estimates from a bounded sample how often each voter speaks and errs in either class,
and how voters go together within a class; voters that repeat each other count for less. Its posterior labels
train a linear classifier over the votes and the strength of what was found, which scores every text.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from flowlens.llm.common import free_name, held_out, small_batches, stored, worker_state
from flowlens.llm.linear import bounded_rows, class_weights, fit_logistic, labelled_sample, sigmoid

# Labelled documents of each class that a fit sees at most, and words or stems it may add to the lexicon.
PER_CLASS = 2000
MINED = 60
# Candidates for them whose toxic rows the driver sees.
CANDIDATES = 2000
# Letters of a stem.
STEMS = (4, 5, 6, 7, 8)
# Common insults of four languages, the first lexicon.
LEXICON = (
    "asshole bastard bitch clown coward creep cretin degenerate disgusting dumbass failure filth fool freak garbage idiot idiotic imbecile jerk "
    "loser lowlife moron moronic parasite pathetic scum scumbag slut stupid trash ugly useless vermin whore worthless "
    "abschaum arschloch dreckig dummkopf hurensohn schlampe trottel versager widerlich wichser "
    "connard connasse debile merde pourriture salaud salope "
    "basura cabron estupido gilipollas imbecil mierda pendejo"
).split()
# Letters for the signs that stand in for them.
SIGNS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"})
PATTERNS = ("two_kinds", "three_kinds", "dense", "repeated", "aimed", "shouted", "masked", "single", "none", "none_long")
_AIMED = re.compile(r"\b(?:you|your|u|are|is|an?|the|that|such|du|sie|ihr|ein|eine|tu|vous|un|une|eres|es|el|la)\s+(?:\w+\s+)?$")


class Voters:
    """Counts of lexicon entries in a text and the votes they lead to. An entry is a word, or a stem that ends in an asterisk."""

    def __init__(self, lexicon: tuple[str, ...]):
        import ahocorasick

        self.lexicon = lexicon
        self.search = ahocorasick.Automaton()
        for i, word in enumerate(lexicon):
            stem = word.rstrip("*")
            self.search.add_word(stem, (i, len(stem), stem != word))
        if lexicon:
            self.search.make_automaton()

    def found(self, text: str) -> list[tuple[int, int, int]]:
        """(entry, begin, end) of whole words."""
        out = []
        for last, (word, size, stem) in self.search.iter(text) if self.lexicon else ():
            begin, end = last + 1 - size, last + 1
            if begin and text[begin - 1].isalpha():
                continue
            while stem and end < len(text) and text[end].isalpha():
                end += 1
            if end == len(text) or not text[end].isalpha():
                out.append((word, begin, end))
        return out

    def measure(self, text: str) -> np.ndarray:
        """Votes of the lexicon words, then of PATTERNS, then four strengths."""
        lower = text.lower()
        if len(lower) != len(text):
            text = lower
        hits = self.found(lower)
        plain = lower.translate(SIGNS)
        masked = len({(b, e) for _, b, e in self.found(plain)} - {(b, e) for _, b, e in hits}) if plain != lower else 0
        votes = np.zeros(len(self.lexicon) + len(PATTERNS) + 4)
        for w, _, _ in hits:
            votes[w] = 1
        # A place counts once, whatever entries cover it.
        places = {(b, e) for _, b, e in hits}
        counts = Counter(lower[b:e] for b, e in places)
        words = max(1, len(text.split()))
        n, kinds = len(places), len(counts)
        aimed = sum(bool(_AIMED.search(lower, max(0, b - 30), b)) for b, _ in places)
        shouted = sum(text[b:e].isupper() or text[e:e + 1] == "!" for b, e in places)
        density = n / words
        votes[len(self.lexicon):] = [
            kinds >= 2, kinds >= 3, density >= 0.01, max(counts.values(), default=0) >= 2, aimed > 0, shouted > 0, masked > 0,
            -1 if n == 1 and words >= 300 else 0, -1 if not n else 0, -1 if not n and words >= 50 else 0,
            np.log1p(n), np.log1p(kinds), min(1.0, 20 * density), float(n > 0),
        ]
        return votes


def _voters(lexicon: tuple[str, ...]) -> Voters:
    return worker_state("voters " + " ".join(lexicon), lambda: Voters(lexicon))


@dataclass(frozen=True)
class ToxicModel:
    lexicon: tuple[str, ...]
    accuracies: dict[str, float]
    weights: np.ndarray

    def score(self, texts) -> np.ndarray:
        voters = _voters(self.lexicon)
        x = np.array([voters.measure(t or "") for t in texts]).reshape(-1, len(self.weights) - 1)
        return sigmoid(x @ self.weights[:-1] + self.weights[-1])


def label_model(votes: np.ndarray, start: np.ndarray, rounds: int = 30, weight: np.ndarray | None = None, share_of_one: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posteriors, accuracies, weights of the voters) of votes in -1, 0, 1, by expectation and maximisation.

    For each voter and class the shares of its three answers are estimated; `start` are the first beliefs. Within the classes
    voters that agree beyond chance share their weight: a voter's weight is one over one plus its correlations.
    A row counts by its `weight`, 1 on average. `share_of_one` is the share of class 1 if it is known, else it is estimated.
    """
    weight = np.ones(len(votes)) if weight is None else weight
    answers = [votes == v for v in (-1, 0, 1)]
    mean = lambda x, rows=slice(None): np.average(x[rows], axis=0, weights=weight[rows])
    belief, share = start, np.ones(votes.shape[1])
    for _ in range(rounds):
        tables = []
        for b in (weight * (1 - belief), weight * belief):
            # Shares lean to those of all rows, so that a voter that never speaks says nothing.
            tables.append(np.array([(b @ a + 2 * mean(a) + 1e-6) / (b.sum() + 2 + 3e-6) for a in answers]))
        odds = np.log(tables[1]) - np.log(tables[0])
        prior = np.clip(mean(belief) if share_of_one is None else share_of_one, 0.01, 0.99)
        # What a voter says beyond its likelier class, and how far voters say it together.
        rest = votes.astype(float)
        for side in (belief >= 0.5, belief < 0.5):
            if side.any():
                rest[side] -= mean(rest, side)
        size = np.sqrt(mean(rest ** 2))
        together = np.clip((rest.T @ (rest * weight[:, None])) / weight.sum() / np.maximum(np.outer(size, size), 1e-6), 0, 1)
        np.fill_diagonal(together, 0)
        together[together < 0.1] = 0
        share = 1 / (1 + together.sum(1))
        total = np.log(prior / (1 - prior)) + sum(a @ (o * share) for a, o in zip(answers, odds))
        new = sigmoid(total)
        if np.abs(new - belief).max() < 1e-6:
            belief = new
            break
        belief = new
    sure = [(weight * belief) @ (votes[:, j] > 0) + (weight * (1 - belief)) @ (votes[:, j] < 0) for j in range(votes.shape[1])]
    right = np.array([s / max(1e-9, weight @ (votes[:, j] != 0)) for j, s in enumerate(sure)])
    return belief, right, share


def _entries(text: str) -> list[str]:
    """The distinct words of a text and their stems."""
    words = {w.strip("#*$%&|<>.,;:!?\"'()[]") for w in text.lower().split()} - {""}
    return [*words, *{w[:n] + "*" for w in words if w.isalpha() for n in STEMS if len(w) > n}]


def telling_entries(holders: dict[str, set], known: dict[str, set], least: int, most: int = MINED) -> list[str]:
    """Entries that explain toxic rows, the most telling first: `holders` has the toxic rows of each candidate, `known` those of the lexicon.

    A row counts fully for the first entry it has and half for the second; so the other words of copied rows, which
    have an entry already, add nothing. Words come before stems where equal.
    """
    seen, chosen = Counter(i for ids in known.values() for i in ids), []
    gain = lambda ids: sum((1.0, 0.5)[seen[i]] for i in ids if seen[i] < 2)
    left = dict(holders)
    while left and len(chosen) < most:
        # Gains only fall, so candidates that are too small now stay so.
        gains = {e: g for e, ids in left.items() if (g := gain(ids)) >= least}
        if not gains:
            break
        entry = min(gains, key=lambda e: (-gains[e], e.endswith("*"), -len(e), e))
        chosen.append(entry)
        seen.update(left[entry])
        left = {e: left[e] for e in gains if e != entry}
    return chosen


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> ToxicModel:
    """The model of a bounded sample of labelled rows, never the held-out ones.

    The labels of the sample add words to the lexicon, give the share of toxic rows and the label model's first beliefs;
    the classifier is trained on its posteriors. Sampled rows are weighted so that both classes count as in all labels that
    fitting may see: a score means the same whatever part of them `per_class` takes. The driver gets the votes and word statistics of at most
    2 * `per_class` rows. Without rows of both classes the fixed lexicon alone decides.
    """
    spark = docs.sparkSession
    small_batches(spark)
    sample = stored(labelled_sample(docs, labels, "toxic", per_class, id_col, text_col))

    @F.pandas_udf("array<string>")
    def entries(text: pd.Series) -> pd.Series:
        return text.map(_entries)

    n = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    lexicon = list(dict.fromkeys(LEXICON))
    if n.get(0) and n.get(1):
        listed = sample.select("doc_id", "label", F.explode(entries("text")).alias("entry"))
        found = listed.groupBy("entry").agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("other"))
        rate = (F.col("toxic") / n[1]) / ((F.col("other") + 0.5) / n[0])
        least = max(5, int(0.01 * n[1]))
        fixed = F.col("entry").isin(lexicon)
        # Of the first lexicon, words that other rows have as well are dropped.
        found = stored(found.where(fixed | (F.col("toxic") >= least) & (rate >= 8)))
        common = {r["entry"] for r in found.where(fixed & (rate < 4) & (F.col("other") >= 2)).collect()}
        lexicon = [w for w in lexicon if w not in common]
        candidates = found.where(~fixed).orderBy((F.col("toxic") * F.log(rate)).desc(), "entry").limit(CANDIDATES).select("entry")
        names = spark.createDataFrame([(w,) for w in lexicon], "entry string").union(candidates)
        sets = {r["entry"]: set(r["ids"]) for r in listed.where("label = 1").join(F.broadcast(names), "entry").groupBy("entry").agg(F.collect_set("doc_id").alias("ids")).collect()}
        known = {w: sets.pop(w) for w in lexicon if w in sets}
        lexicon += telling_entries(sets, known, least)
    words = tuple(lexicon)

    @F.pandas_udf("array<double>")
    def measured(text: pd.Series) -> pd.Series:
        voters = _voters(words)
        return text.map(lambda t: voters.measure(t).tolist())

    frame = bounded_rows(sample.select("doc_id", "label", measured("text").alias("x")), 2 * per_class)
    y = frame["label"].to_numpy(float)
    width = len(words) + len(PATTERNS)
    if not (0 < y.sum() < len(y)):
        weights = np.zeros(width + 5)
        weights[width + 1], weights[width + 3], weights[-1] = 2.0, 1.0, -2.5
        return ToxicModel(words, {}, weights)
    x = np.array(frame["x"].tolist())
    # The given label is one more voter, whose errors are estimated like the others'.
    votes = np.column_stack([x[:, :width], 2 * y - 1])
    mix = class_weights(labels, "toxic", per_class)
    weight = np.where(y == 1, mix[1], mix[0])
    belief, right, share = label_model(votes, np.where(y == 1, 0.9, 0.1), weight=weight, share_of_one=float(np.average(y, weights=weight)))
    weights = fit_logistic(np.column_stack([x, np.ones(len(x))]), belief, weight, ridge=1.0)
    return ToxicModel(words, dict(zip([*words, *PATTERNS, "label"], right.tolist())), weights)


def scored(docs: DataFrame, model: ToxicModel, out: str, text_col: str = "text") -> DataFrame:
    """`docs` with the toxicity of each whole text, 0 to 1; a null text is empty. Rows and columns stay as they are."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def of(text: pd.Series) -> pd.Series:
        return pd.Series(model.score(text), dtype="float64")

    return docs.withColumn(out, of(F.coalesce(docs[text_col].cast("string"), F.lit(""))))


def classify(docs: DataFrame, model: ToxicModel, cut: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted): predicted is 1 from a score of `cut` on.

    One row per row of `docs`; repeated and null ids keep their rows, a null or empty text is scored as one without
    any hit, an empty table gives an empty result.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return scored(rows, model, "score").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def clean(docs: DataFrame, model: ToxicModel, cut: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of `docs` whose score is below `cut`, with all their columns."""
    name = free_name(docs, "toxic_score")
    return scored(docs, model, name, text_col).where(F.col(name) < cut).drop(name)
