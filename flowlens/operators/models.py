"""Linear detectors on MLlib: fitting, scoring, routing, persistence."""

import json
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.labels import threat_family
from ..session import materialize, shared_dir
from . import fold_fit
from .explain import explain_linear
from .features import flow_features, window_text
from .vectorize import NgramTfidf, NgramTfidfModel, SparseFeatureVectorizer, SparseFeatureVectorizerModel

STRUCTURED, TEXT, EXTERNAL = "structured_baseline", "tfidf_fallback", "distilbert"


@dataclass(frozen=True)
class LinearModel:
    """A vectorizer with its logistic regression and alert threshold."""

    vectorizer: SparseFeatureVectorizerModel | NgramTfidfModel
    classifier: LogisticRegressionModel
    threshold: float = 0.5

    def coefficients(self) -> dict[str, float]:
        return dict(zip(self.vectorizer.getVocabulary(), map(float, self.classifier.coefficients)))

    def coefficient_table(self, spark: SparkSession) -> DataFrame:
        """(feature, coefficient), without a list of the features on the driver where the vectorizer keeps them in a table."""
        if isinstance(self.vectorizer, NgramTfidfModel):
            return spark.createDataFrame(list(self.coefficients().items()), "feature string, coefficient double")
        values = np.asarray(self.classifier.coefficients.toArray(), float)

        @F.arrow_udf("double")
        def at(index: pa.Array) -> pa.Array:
            return pa.array(values[index.to_numpy()])

        return self.vectorizer.names(spark).select(F.col("name").alias("feature"), at("index").alias("coefficient"))

    def score(self, df: DataFrame, output: str = "score") -> DataFrame:
        """Adds the attack probability, by the classifier's own formula in the function that looks up the names."""
        products = self.vectorizer.products(np.asarray(self.classifier.coefficients.toArray(), float))
        if products is not None:
            benign = F.lit(1.0) / (F.lit(1.0) + F.exp(products + F.lit(float(self.classifier.intercept))))
            return df.withColumn(output, F.lit(1.0) - benign)
        vectors = self.vectorizer.transform(df)
        scored = self.classifier.transform(vectors)
        probability = vector_to_array(F.col(self.classifier.getProbabilityCol()))[1]
        return scored.select(*[F.col(c) for c in df.columns], probability.alias(output))

    def save(self, path: str) -> None:
        self.vectorizer.write().overwrite().save(f"{path}/vectorizer")
        self.classifier.write().overwrite().save(f"{path}/classifier")


@dataclass(frozen=True)
class Detector:
    """The fitted models of one training run; any of them may be missing."""

    structured: LinearModel | None = None
    text: LinearModel | None = None
    families: dict[str, LinearModel] = field(default_factory=dict)
    manifest: dict = field(default_factory=dict)

    def available(self) -> list[str]:
        return [n for n, m in ((STRUCTURED, self.structured), (TEXT, self.text)) if m is not None]

    def save(self, spark: SparkSession, path: str) -> None:
        parts = {"structured": self.structured, "text": self.text}
        parts.update({f"family_{n}": m for n, m in self.families.items()})
        index = {n: m.threshold for n, m in parts.items() if m is not None}
        for name in index:
            parts[name].save(f"{path}/{name}")
        row = [(json.dumps(index), json.dumps(self.manifest, default=str))]
        spark.createDataFrame(row, "thresholds string, manifest string").coalesce(1) \
            .write.mode("overwrite").json(f"{path}/manifest")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Detector":
        row = spark.read.json(f"{path}/manifest").first()
        parts = {}
        for name, threshold in json.loads(row["thresholds"]).items():
            reader = NgramTfidfModel if name == "text" else SparseFeatureVectorizerModel
            parts[name] = LinearModel(
                reader.load(f"{path}/{name}/vectorizer"),
                LogisticRegressionModel.load(f"{path}/{name}/classifier"), threshold,
            )
        families = {n.removeprefix("family_"): m for n, m in parts.items() if n.startswith("family_")}
        return Detector(parts.get("structured"), parts.get("text"), families, json.loads(row["manifest"]))


def fit_linear(
    df: DataFrame, vector: str, label: str = "label", weight: str | None = None, C: float = 1.5,
    max_iter: int = 2000, tol: float = 1e-4,
) -> LogisticRegressionModel:
    """L2 logistic regression with balanced classes.

    Minimizing ½‖w‖² + C·Σ uᵢ·lossᵢ equals minimizing the weighted mean loss with
    penalty 1 / (C·Σ uᵢ). Here uᵢ = n / (2·rows of the class) · sample weight, on
    unscaled features; the intercept is not penalized.
    """
    w = F.col(weight) if weight else F.lit(1.0)
    # Many passes follow: written once, each reads vectors instead of computing them, and a
    # lost executor costs a read.
    rows = materialize(df.select(F.col(vector), F.col(label).cast("int").alias("_y"), w.alias("_u")))
    sums = {
        r["_y"]: (r["n"], r["w"])
        for r in rows.groupBy("_y").agg(F.count(F.lit(1)).alias("n"), F.sum("_u").alias("w")).collect()
    }
    if set(sums) != {0, 1}:
        raise ValueError("fitting needs rows of both classes")
    n = sums[0][0] + sums[1][0]
    balance = {y: n / (2 * count) for y, (count, _) in sums.items()}
    total = sum(balance[y] * weight_sum for y, (_, weight_sum) in sums.items())
    weighted = rows.select(
        vector, F.col("_y").cast("double").alias("_y"),
        (F.when(F.col("_y") == 1, balance[1]).otherwise(balance[0]) * F.col("_u")).alias("_w"),
    )
    # Each of many iterations is a job: few rows are not worth many tasks. Larger tables keep their splits.
    weighted = weighted.coalesce(max(1, n // 20_000))
    fitted = LogisticRegression(
        featuresCol=vector, labelCol="_y", weightCol="_w", regParam=1.0 / (C * total),
        elasticNetParam=0.0, standardization=False, maxIter=max_iter, tol=tol,
    ).fit(weighted)
    # A fresh fit carries its training summary and with it the session, which tasks cannot take
    # along; a stored model is read back without them.
    path = f"{shared_dir(df.sparkSession)}/models/{uuid.uuid4().hex}"
    fitted.save(path)
    return LogisticRegressionModel.load(path)


def fit_structured(
    df: DataFrame, label: str = "label", weight: str | None = None, features: str = "features", **options,
) -> LinearModel:
    """Structured detector over feature maps; computes them from `window` where they are missing."""
    if features not in df.columns:
        df = flow_features(df, output=features)
    vectorizer = SparseFeatureVectorizer(features, "feature_vector").fit(df)
    classifier = fit_linear(vectorizer.transform(df), "feature_vector", label, weight, **options)
    return LinearModel(vectorizer, classifier)


def fit_text(
    df: DataFrame, label: str = "label", weight: str | None = None, text: str = "window_text", **options,
) -> LinearModel:
    """Text detector with threshold 0.5; computes the window text where it is missing."""
    if text not in df.columns:
        df = window_text(df, output=text)
    vectorizer = NgramTfidf(text, "text_vector").fit(df)
    classifier = fit_linear(vectorizer.transform(df), "text_vector", label, weight, **options)
    return LinearModel(vectorizer, classifier)


def penalized_gradient(
    df: DataFrame, model: LinearModel, label: str = "label", weight: str | None = None, C: float = 1.5,
) -> dict[str, float]:
    """Slope of the fit's objective at the fitted coefficients, one per feature: all are 0 at the optimum.

    `df` are the training rows. Slopes are for columns scaled to deviation 1, so that they compare; `(intercept)` is the intercept's.
    """
    u = F.col(weight).cast("double") if weight else F.lit(1.0)
    source = model.vectorizer.getOutputCol()
    cells = F.unwrap_udt(source)
    rows = materialize(model.vectorizer.transform(df).select(
        F.col(label).cast("int").alias("y"), u.alias("u"), cells["indices"].alias("indices"), cells["values"].alias("values")))
    sums = {r["y"]: (r["n"], r["u"]) for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.sum("u").alias("u")).collect()}
    n = sum(count for count, _ in sums.values())
    balance = {y: n / (2 * count) for y, (count, _) in sums.items()}
    total = sum(balance[y] * u for y, (_, u) in sums.items())
    share = F.array(F.when(F.col("y") == 1, balance[1]).otherwise(balance[0]) * F.col("u") / total)
    w = np.array(model.classifier.coefficients.toArray(), float)
    point = fold_fit.Linear(w[None], np.array([model.classifier.intercept]))
    _, slope, shift = fold_fit.loss_and_gradient(rows, share, point, np.array([0]), rows.rdd.getNumPartitions())
    mean, spread = fold_fit.column_moments(rows, len(w))
    by_column = (slope[0] - shift[0] * mean + w / (C * total)) / spread
    return {**dict(zip(model.vectorizer.getVocabulary(), by_column.tolist())), "(intercept)": float(shift[0])}


def _result(df: DataFrame, model: str, threshold: Column) -> DataFrame:
    """Adds `model`, `threshold` and `prediction` next to `score`."""
    return df.withColumns({"model": F.lit(model), "threshold": threshold}).withColumn(
        "prediction", (F.col("score") >= F.col("threshold")).cast("int")
    )


def score_structured(df: DataFrame, detector: Detector) -> DataFrame:
    """Attack probability of each window.

    Windows of a family with its own model use that model and its threshold. The
    family comes from the attack category, a label field, so by default there are none.
    """
    base = detector.structured
    if base is None:
        raise ValueError("the structured model is missing")
    source = base.vectorizer.getInputCol()
    featured = df if source in df.columns else flow_features(df, output=source)
    scored = base.score(featured)
    threshold = F.lit(base.threshold)
    if detector.families:
        scored = scored.withColumn("_family", threat_family("window"))
        score = F.col("score")
        for at, (name, model) in enumerate(detector.families.items()):
            scored = model.score(scored, f"_score{at}")
            score = F.when(F.col("_family") == name, F.col(f"_score{at}")).otherwise(score)
            threshold = F.when(F.col("_family") == name, model.threshold).otherwise(threshold)
        scored = scored.withColumn("score", score)
    scored = _result(scored, STRUCTURED, threshold)
    extra = [c for c in scored.columns if c == "_family" or c.startswith("_score")]
    return scored.drop(*extra, *(() if source in df.columns else (source,)))


def score_text(df: DataFrame, detector: Detector) -> DataFrame:
    if detector.text is None:
        raise ValueError("the text model is missing")
    source = detector.text.vectorizer.getInputCol()
    texts = df if source in df.columns else window_text(df, output=source)
    scored = _result(detector.text.score(texts), TEXT, F.lit(detector.text.threshold))
    return scored.drop(*(() if source in df.columns else (source,)))


def positive_share(logits: Column) -> Column:
    """Softmax of class 1; a single output is taken as it is."""
    shifted = F.transform(logits, lambda x: F.exp(x - logits[1]))
    total = F.aggregate(shifted, F.lit(0.0), lambda acc, v: acc + v)
    return F.when(F.size(logits) >= 2, F.lit(1.0) / total).otherwise(logits[0])


def score_external(
    df: DataFrame, make_predict_fn, text: str = "text", batch_size: int = 64, model: str = EXTERNAL,
) -> DataFrame:
    """Scores texts with any model: `make_predict_fn()` returns a function from texts to class logits."""
    predict = predict_batch_udf(make_predict_fn, return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size)
    scored = df.withColumn("_logits", predict(F.col(text))).withColumn("score", positive_share(F.col("_logits")))
    return _result(scored.drop("_logits"), model, F.lit(0.5))


FALLBACKS = {
    STRUCTURED: (STRUCTURED, TEXT, EXTERNAL),
    EXTERNAL: (EXTERNAL, STRUCTURED, TEXT),
    TEXT: (TEXT, STRUCTURED, EXTERNAL),
}


def choose_model(available, requested: str = STRUCTURED) -> str:
    """The requested model when it is there, otherwise the next one in its order."""
    name = STRUCTURED if requested == "structured" else requested
    for candidate in FALLBACKS.get(name, ()):
        if candidate in available:
            return candidate
    raise ValueError(f"no model available for {requested}")


def scorers(detector: Detector, make_predict_fn=None, text: str = "window_text") -> dict:
    """model name → function that scores a DataFrame."""
    found = {}
    if detector.structured is not None:
        found[STRUCTURED] = lambda df: score_structured(df, detector)
    if detector.text is not None:
        found[TEXT] = lambda df: score_text(df, detector)
    if make_predict_fn is not None:
        def external(df):
            texts = df if text in df.columns else window_text(df, output=text)
            return score_external(texts, make_predict_fn, text).select(*df.columns, "score", "model", "threshold", "prediction")
        found[EXTERNAL] = external
    return found


def score_with_fallback(df: DataFrame, available: dict, requested: str = STRUCTURED) -> DataFrame:
    return available[choose_model(available, requested)](df)


def compare_models(df: DataFrame, available: dict, keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """The same rows scored by every model, one row per (row, model).

    The structured model only scores rows that have a window.
    """
    parts = []
    for name, scorer in available.items():
        rows = df.filter(F.col("window").isNotNull()) if name == STRUCTURED and "window" in df.columns else df
        parts.append(scorer(rows).select(*keep, "model", "score", "threshold", "prediction"))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def constant_baseline(df: DataFrame) -> DataFrame:
    """Every row benign with score 0."""
    return df.withColumns({"score": F.lit(0.0), "prediction": F.lit(0), "model": F.lit("always_normal")})


def explain_model(df: DataFrame, model: LinearModel, k: int = 5, output: str = "top_features") -> DataFrame:
    """Adds the strongest features (structured) or terms (text) of each row."""
    source = model.vectorizer.getInputCol()
    if isinstance(model.vectorizer, NgramTfidfModel):
        texts = df if source in df.columns else window_text(df, output=source)
        weighted = model.vectorizer.weights(texts, "_weights")
        explained = explain_linear(weighted, model.coefficients(), k, "_weights", output).drop("_weights")
        return explained if source in df.columns else explained.drop(source)
    featured = df if source in df.columns else flow_features(df, output=source)
    explained = explain_linear(featured, model.coefficients(), k, source, output)
    return explained if source in df.columns else explained.drop(source)


def score_with_explanation(df: DataFrame, detector: Detector, requested: str = STRUCTURED, k: int = 5) -> DataFrame:
    """Score and explanation of the chosen linear model in one pass."""
    name = choose_model(detector.available(), requested)
    scored = score_structured(df, detector) if name == STRUCTURED else score_text(df, detector)
    if name == STRUCTURED and detector.families:
        raise ValueError("explanations cover the global model only")
    return explain_model(scored, detector.structured if name == STRUCTURED else detector.text, k)


def model_info(models: DataFrame, family_thresholds: DataFrame | None = None) -> DataFrame:
    """Active model, available models and how its threshold is set.

    `models` has `model`, `available`, `requested` (bool) and `threshold`, one row per model.
    """
    order = F.when(F.col("model") == STRUCTURED, 0).when(F.col("model") == TEXT, 1).otherwise(2)
    on = F.col("available")
    active = F.min_by("model", F.when(on, F.when(F.col("requested"), -1).otherwise(order)))
    info = models.agg(
        active.alias("active_model"),
        F.transform(
            F.array_sort(F.collect_list(F.when(on, F.struct(order.alias("o"), F.col("model").alias("m"))))),
            lambda e: e["m"],
        ).alias("available_models"),
        F.max(F.when(on, F.struct(F.when(F.col("requested"), 9).otherwise(-order).alias("o"), "threshold"))).alias("_t"),
    )
    info = info.withColumn("_families", F.lit(None).cast("map<string,double>"))
    if family_thresholds is not None:
        # One row per family; all of them make one map.
        named = family_thresholds.filter(F.col("family").isNotNull()).groupBy("family").agg(F.max("threshold").alias("threshold"))
        entries = F.array_sort(F.collect_list(F.struct("family", F.col("threshold").cast("double").alias("threshold"))))
        families = named.agg(F.map_from_entries(entries).alias("_families"))
        info = info.drop("_families").withColumn("_one", F.lit(1)).join(families.withColumn("_one", F.lit(1)), "_one")
    per_family = F.when((F.col("active_model") == STRUCTURED) & (F.size("_families") > 0), F.col("_families"))
    return info.select("active_model", "available_models", per_family.alias("active_family_thresholds"), "_t").select(
        "active_model", "available_models",
        F.when(F.col("active_family_thresholds").isNotNull(), "per_family").otherwise("global").alias("active_threshold_mode"),
        F.when(F.col("active_family_thresholds").isNull(), F.col("_t.threshold")).alias("active_threshold"),
        "active_family_thresholds",
    )
