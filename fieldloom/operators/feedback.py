"""Corrections, classifiers that learn from them, and what to ask about next."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import HashingTF, IDF, CountVectorizer, RegexTokenizer, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.names import blank
from fieldloom.session import Workspace

#: Fewer labelled rows than this train nothing.
LEAST_ROWS = 50
#: A prediction less sure than this is for review.
REVIEW_BELOW = 0.70


def training_rows(corrections: DataFrame, text_col: str = "text", label: str = "corrected") -> DataFrame:
    return corrections.where((blank(text_col) != "") & (blank(label) != "")).select(F.col(text_col).alias("text"), F.col(label).alias("label"))


def fit_types(rows: DataFrame, least: int = LEAST_ROWS, seed: int = 7) -> PipelineModel | None:
    """A TF-IDF model with two classifiers, fitted once for training and prediction; none for too few rows or one label."""
    if rows.limit(least).count() < least or rows.select("label").distinct().count() < 2:
        return None
    labels = StringIndexer(inputCol="label", outputCol="__y", stringOrderType="alphabetAsc", handleInvalid="keep")
    steps = [labels, RegexTokenizer(inputCol="text", outputCol="__w", pattern=r"\W+"), HashingTF(inputCol="__w", outputCol="__tf", numFeatures=1 << 12), IDF(inputCol="__tf", outputCol="__x")]
    steps += [LogisticRegression(featuresCol="__x", labelCol="__y", probabilityCol="__p1", rawPredictionCol="__r1", predictionCol="__c1", maxIter=30)]
    steps += [RandomForestClassifier(featuresCol="__x", labelCol="__y", probabilityCol="__p2", rawPredictionCol="__r2", predictionCol="__c2", numTrees=20, seed=seed)]
    return Pipeline(stages=steps).fit(rows)


def predict_types(model: PipelineModel, df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with predicted, confidence, probabilities (mean of the classifiers) and needs_review."""
    names = model.stages[0].labels
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.lit(names[0]).alias("label"))
    scored = model.transform(rows)
    mean = F.zip_with(vector_to_array("__p1"), vector_to_array("__p2"), lambda a, b: (a + b) / 2)
    p = F.slice(mean, 1, len(names))
    best = F.array_position(p, F.array_max(p)).cast("int")
    out = scored.withColumn("probabilities", p)
    out = out.withColumns({"confidence": F.array_max("probabilities"), "predicted": F.element_at(F.array(*map(F.lit, names)), best)})
    keep = [c for c in df.columns if c not in ("probabilities", "confidence", "predicted", "needs_review")]
    return out.withColumn("needs_review", F.col("confidence") < REVIEW_BELOW).select(*[F.col("__row")[c].alias(c) for c in keep], "predicted", "confidence", "probabilities", "needs_review")


@dataclass
class Ensemble:
    """labels; features and forest; per label a boosted model and the scale and shift that calibrate its margin."""

    labels: list[str]
    forest: PipelineModel
    boosted: list[tuple[GBTClassificationModel, float, float]]
    dims: int


#: Words of the ensemble; labels at most; share of rows (in fourths) that calibrate.
ENSEMBLE_WORDS, MOST_LABELS, FOLDS = 100, 20, 4


def _with_vector(df: DataFrame, vector: str | None, dims: int) -> DataFrame:
    """df with __v: its vector, zeros where it has none of that length."""
    zeros = F.array_repeat(F.lit(0.0), dims)
    given = F.col(vector).cast("array<double>") if vector else F.lit(None).cast("array<double>")
    return df.withColumn("__v", array_to_vector(F.when(F.size(given) == dims, given).otherwise(zeros)))


def fit_ensemble(rows: DataFrame, vector: str | None = None, least: int = LEAST_ROWS, trees: int = 40, rounds: int = 10, seed: int = 7) -> Ensemble | None:
    """A forest and boosted trees over the weights of 100 words and a vector, fitted to rows (text, label, vector).

    Boosting tells each label from all others. On a fourth of the rows, drawn by
    hash and kept from it, a logistic curve turns its margin into a probability.
    None for too few rows or one label; ValueError for more than 20 labels.
    """
    if rows.limit(least).count() < least:
        return None
    labels = sorted(r[0] for r in rows.select("label").where("label IS NOT NULL").distinct().limit(MOST_LABELS + 1).collect())
    if len(labels) < 2:
        return None
    if len(labels) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels")
    dims = (rows.agg(F.max(F.size(vector))).first()[0] or 0) if vector else 0
    dims = max(dims, 1)
    # every pass of the fit reads them, so what made them runs once
    work = Workspace(rows.sparkSession, "ensemble")
    given = rows.where("label IS NOT NULL").select("label", F.coalesce("text", F.lit("")).alias("text"), *([vector] if vector else []))
    data = _with_vector(work.save(given, "rows"), vector, dims)
    steps = [StringIndexer(inputCol="label", outputCol="__y", stringOrderType="alphabetAsc", handleInvalid="keep"), RegexTokenizer(inputCol="text", outputCol="__w", pattern=r"\W+", minTokenLength=2)]
    steps += [CountVectorizer(inputCol="__w", outputCol="__tf", vocabSize=ENSEMBLE_WORDS), IDF(inputCol="__tf", outputCol="__x"), VectorAssembler(inputCols=["__x", "__v"], outputCol="__f")]
    steps += [RandomForestClassifier(featuresCol="__f", labelCol="__y", probabilityCol="__forest", rawPredictionCol="__fr", predictionCol="__fp", numTrees=trees, seed=seed)]
    forest = Pipeline(stages=steps).fit(data)
    told = forest.transform(data).select("label", "__f", F.pmod(F.xxhash64("text", "label"), F.lit(FOLDS)).alias("__fold")).cache()
    boosted = []
    for label in labels:
        one = told.withColumn("__is", (F.col("label") == label).cast("double"))
        # a label that a share lacks is learned from all
        fit_on, check_on = one.where("__fold <> 0"), one.where("__fold = 0")
        whole = any(x.select("__is").distinct().count() < 2 for x in (fit_on, check_on))
        model = GBTClassifier(featuresCol="__f", labelCol="__is", predictionCol="__c", maxIter=rounds, maxDepth=3, seed=seed).setRawPredictionCol("__m").setProbabilityCol("__p").fit(one if whole else fit_on)
        scale, shift = 2.0, 0.0
        if not whole:
            margins = model.transform(check_on).select("__is", array_to_vector(F.slice(vector_to_array("__m"), 2, 1)).alias("__one"))
            curve = LogisticRegression(featuresCol="__one", labelCol="__is", maxIter=50, regParam=1e-4).fit(margins)
            scale, shift = float(curve.coefficients[0]), float(curve.intercept)
        boosted.append((model, scale, shift))
    told.unpersist()
    work.clear()
    return Ensemble(labels, forest, boosted, dims)


def predict_ensemble(ensemble: Ensemble, df: DataFrame, text_col: str = "text", vector: str | None = None) -> DataFrame:
    """df with predicted, confidence, probabilities (mean of forest and boosting, in the order of labels, sums to 1) and needs_review."""
    keep = [c for c in df.columns if c not in ("probabilities", "confidence", "predicted", "needs_review")]
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.lit(ensemble.labels[0]).alias("label"), *([F.col(vector).alias("__given")] if vector else []))
    scored = ensemble.forest.transform(_with_vector(rows, "__given" if vector else None, ensemble.dims))
    for i, (model, scale, shift) in enumerate(ensemble.boosted):
        own = model.copy()
        own.setRawPredictionCol(f"__m{i}").setProbabilityCol(f"__q{i}").setPredictionCol(f"__c{i}")
        scored = own.transform(scored).withColumn(f"__b{i}", 1 / (1 + F.exp(-(F.lit(scale) * F.get(vector_to_array(f"__m{i}"), F.lit(1)) + shift))))
    n = len(ensemble.labels)
    boost = F.array(*[F.col(f"__b{i}") for i in range(n)])
    total = F.aggregate(boost, F.lit(0.0), lambda a, x: a + x)
    woods = F.slice(vector_to_array("__forest"), 1, n)
    woods_total = F.aggregate(woods, F.lit(0.0), lambda a, x: a + x)
    mean = F.zip_with(F.transform(woods, lambda x: x / woods_total), F.transform(boost, lambda x: x / total), lambda a, b: (a + b) / 2)
    out = scored.withColumn("probabilities", mean)
    best = F.array_position("probabilities", F.array_max("probabilities")).cast("int")
    out = out.withColumns({"confidence": F.array_max("probabilities"), "predicted": F.element_at(F.array(*map(F.lit, ensemble.labels)), best)})
    return out.withColumn("needs_review", F.col("confidence") < REVIEW_BELOW).select(*[F.col("__row")[c].alias(c) for c in keep], "predicted", "confidence", "probabilities", "needs_review")


def feature_vector(df: DataFrame, columns: list[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol=out, handleInvalid="keep").transform(df)


def correction(df: DataFrame, predicted: str, corrected: str, **extra) -> DataFrame:
    """Rows of a correction log: what was predicted, what is right, and when."""
    return df.select("*", F.col(predicted).alias("was"), F.col(corrected).alias("is"), (F.col(predicted) != F.col(corrected)).alias("changed"), *[F.lit(v).alias(k) for k, v in extra.items()])


def due_for_training(corrections: DataFrame, every: int = 10) -> DataFrame:
    """One row: how many corrections there are and whether another round of training is due."""
    return corrections.agg(F.count(F.lit(1)).alias("n")).withColumn("due", (F.col("n") > 0) & (F.col("n") % every == 0))


def example_block(examples: DataFrame, order: str, shown: str, right: str) -> DataFrame:
    """One row: examples as text, one line each."""
    line = F.concat(F.lit("- "), F.col(shown), F.lit(" -> "), F.col(right))
    return examples.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))), lambda s: s["l"]), "\n").alias("block"))


def changed_cells(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, field, was, is: cells of a table that an editor changed."""
    a = before.select(key, *[F.col(c).cast("string").alias(f"a_{c}") for c in columns])
    b = after.select(key, *[F.col(c).cast("string").alias(f"b_{c}") for c in columns])
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"a_{c}").alias("was"), F.col(f"b_{c}").alias("is")) for c in columns]))
    return a.join(b, key).select(key, cells.alias("c")).select(key, "c.*").where(~F.col("was").eqNullSafe(F.col("is")))


