"""Models as fit -> predict functions on DataFrames, with out-of-fold scoring."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkgauge.operators.encoding import column_kinds, feature_names, fit_encoder, known_fills
from linkgauge.operators.splitting import training_rows
from linkgauge.session import materialize

Predictor = Callable[[DataFrame], DataFrame]


@dataclass
class Fitted:
    """A fitted model: ``predict`` adds ``y_pred``; importances by encoded feature if it has any."""

    predict: Predictor
    importances: dict[str, float] = field(default_factory=dict)


@dataclass
class ModelSpec:
    name: str
    fit: Callable[[DataFrame, str, list[str]], Fitted] | None
    skip_reason: str = ""
    # models on encoded inputs: fit with an encoder of the training rows, and whether that standardises
    fit_encoded: Callable[[DataFrame, str, list[str], PipelineModel], Fitted] | None = None
    scale: bool = False


class Encoders:
    """Encoders of the training rows, each fitted once however many models use it. One table, one list of inputs."""

    def __init__(self, features: list[str]):
        self.features, self.known = features, {}

    def of(self, name, train: DataFrame, scale: bool = False) -> PipelineModel:
        """The encoder of the training rows called ``name``; its fill values are found once, scaled or not."""
        fills = self.known.get((name, "fills"))
        if fills is None:
            fills = self.known[name, "fills"] = known_fills(train, self.features)
        if (name, scale) not in self.known:
            self.known[name, scale] = fit_encoder(train, self.features, scale, fills=fills)
        return self.known[name, scale]


def fit_model(spec: ModelSpec, name, train: DataFrame, target: str, features: list[str], encoders: Encoders | None) -> Fitted:
    """``spec`` fitted on the training rows called ``name``, with a shared encoder where it uses one."""
    if encoders is None or spec.fit_encoded is None:
        return spec.fit(train, target, features)
    return spec.fit_encoded(train, target, features, encoders.of(name, train, spec.scale))


def mean_model() -> ModelSpec:
    """Predicts the training mean (a scalar subquery, nothing reaches the driver)."""

    def fit(train: DataFrame, target: str, features: list[str]) -> Fitted:
        mean = train.agg(F.avg(target)).scalar()
        return Fitted(lambda df: df.withColumn("y_pred", mean))

    return ModelSpec("mean", fit)


def _encoded_model(name: str, fit_encoded, scale: bool) -> ModelSpec:
    def fit(train: DataFrame, target: str, features: list[str]) -> Fitted:
        return fit_encoded(train, target, features, fit_encoder(train, features, scale))

    return ModelSpec(name, fit, fit_encoded=fit_encoded, scale=scale)


def _estimator_model(name: str, make, scale: bool) -> ModelSpec:
    def fit(train: DataFrame, target: str, features: list[str], encoder: PipelineModel) -> Fitted:
        model = make().setLabelCol(target).setFeaturesCol("features").setPredictionCol("y_pred").fit(
            encoder.transform(train).select("features", target)
        )

        def predict(df: DataFrame) -> DataFrame:
            return model.transform(encoder.transform(df)).select(*df.columns, "y_pred")

        found = getattr(model, "featureImportances", None)
        names = feature_names(encoder, *column_kinds(train, features))
        return Fitted(predict, dict(zip(names, map(float, found.toArray()))) if found is not None else {})

    return _encoded_model(name, fit, scale)


def linear_model() -> ModelSpec:
    """Ordinary least squares on standardised inputs."""
    return _estimator_model("linear", lambda: LinearRegression(regParam=0.0), scale=True)


def forest_model(trees: int = 200, depth: int = 30, seed: int = 42) -> ModelSpec:
    def make():
        return RandomForestRegressor(numTrees=trees, maxDepth=depth, featureSubsetStrategy="all", seed=seed)

    return _estimator_model("forest", make, scale=False)


def boosted_model(rounds: int = 200, depth: int = 4, rate: float = 0.05, seed: int = 42) -> ModelSpec:
    def make():
        return GBTRegressor(
            maxIter=rounds, stepSize=rate, maxDepth=depth, subsamplingRate=0.9, featureSubsetStrategy="0.9", seed=seed
        )

    return _estimator_model("boosted", make, scale=False)


def fourier_features(encoded: DataFrame, components: int, gamma: float, width: int, seed: int) -> DataFrame:
    """Random Fourier features of a Gaussian kernel; the matrix is width x components.

    A batch of rows is one block of numbers on its way to numpy and back, never a Python object for each row.
    """
    import numpy as np

    rng = np.random.default_rng(seed)
    weights = rng.normal(scale=np.sqrt(2 * gamma), size=(width, components))
    offsets = rng.uniform(0, 2 * np.pi, size=components)

    @F.arrow_udf("array<double>")
    def project(rows: pa.Array) -> pa.Array:
        matrix = rows.flatten().to_numpy().reshape(len(rows), width)
        mapped = np.sqrt(2.0 / components) * np.cos(matrix @ weights + offsets)
        ends = np.arange(0, mapped.size + 1, components, dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(mapped.reshape(-1)))

    mapped = project(vector_to_array("features"))
    return encoded.withColumn("features", array_to_vector(mapped))


def kernel_model(components: int = 200, penalty: float = 10.0, seed: int = 42) -> ModelSpec:
    """Gaussian-kernel regression by random Fourier features and a robust linear fit.

    Not a support vector machine: the same kernel and a loss of the same kind, at a cost linear
    in the rows.
    """

    def fit(train: DataFrame, target: str, features: list[str], encoder: PipelineModel) -> Fitted:
        # written once: the facts, the fit and its summary would each encode every row again
        encoded = materialize(encoder.transform(train).select("features", target), "encoded")
        facts = encoded.select(
            Summarizer.metrics("mean", "variance", "count").summary(F.col("features")).alias("s")
        ).select("s.*").head()
        width = len(facts["mean"])
        spread = float(sum(facts["variance"]) / width + facts["mean"].toArray().var()) or 1.0
        gamma = 1.0 / (width * spread)
        model = LinearRegression(
            loss="huber", labelCol=target, predictionCol="y_pred", regParam=1.0 / (penalty * facts["count"])
        ).fit(fourier_features(encoded, components, gamma, width, seed))

        def predict(df: DataFrame) -> DataFrame:
            mapped = fourier_features(encoder.transform(df), components, gamma, width, seed)
            return model.transform(mapped).select(*df.columns, "y_pred")

        return Fitted(predict)

    return _encoded_model("kernel", fit, scale=True)


def regression_specs(trees: int = 200, forest_depth: int = 30, rounds: int = 200, seed: int = 42) -> list[ModelSpec]:
    """The five baseline regressors."""
    return [
        mean_model(), linear_model(), kernel_model(seed=seed), forest_model(trees, forest_depth, seed),
        boosted_model(rounds, seed=seed),
    ]


def external_model(name: str, predict: Predictor) -> ModelSpec:
    """Bring your own fitted model: ``predict`` adds ``y_pred``."""
    return ModelSpec(name, lambda train, target, features: Fitted(predict))


def batch_model(name: str, make_predict, inputs: list[str], batch_size: int = 10_000) -> ModelSpec:
    """Bring your own model as a batch predictor: ``make_predict()`` runs once in each Python worker (to load the
    model) and gives a function from numpy columns to predictions. Rows are sent in Arrow batches."""
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql.types import DoubleType

    predict = predict_batch_udf(make_predict, return_type=DoubleType(), batch_size=batch_size)
    return external_model(name, lambda df: df.withColumn("y_pred", predict(*[F.col(c).cast("double") for c in inputs])))


def _each_fold(k: int, score, parallelism: int) -> DataFrame:
    """Union of the folds' scored rows; fits are submitted side by side, like a cross validator does."""
    with ThreadPoolExecutor(max_workers=max(1, min(k, parallelism))) as pool:
        return reduce(DataFrame.unionByName, list(pool.map(score, range(k))))


def out_of_fold(
    df: DataFrame, spec: ModelSpec, target: str, features: list[str], k: int, parallelism: int = 5, encoders: Encoders | None = None
) -> DataFrame:
    """Every row predicted by the model that did not see its fold; needs a ``fold`` column.

    ``encoders`` of the same rows and folds are shared between models.
    """

    def score(number: int) -> DataFrame:
        fitted = fit_model(spec, number, training_rows(df, number), target, features, encoders)
        return fitted.predict(df.filter(F.col("fold") == number))

    return _each_fold(k, score, parallelism)


def mean_out_of_fold(df: DataFrame, target: str) -> DataFrame:
    """Out-of-fold mean in closed form: total minus own fold, one pass for all folds."""
    sums = df.groupBy("fold").agg(F.sum(target).alias("_s"), F.count(target).alias("_n"))
    total = sums.agg(F.sum("_s").alias("s"), F.sum("_n").alias("n"))
    rest = sums.select(
        "fold",
        ((total.select("s").scalar() - F.col("_s")) / (total.select("n").scalar() - F.col("_n"))).alias("y_pred"),
    )
    # one row per fold, so broadcasting it is safe at any data size
    return df.join(F.broadcast(rest), "fold")


def line_out_of_fold(df: DataFrame, x: str, y: str) -> DataFrame:
    """Out-of-fold straight-line fit y ~ x in closed form, one pass for all folds.

    Each fold gives its counts, means and centred moments. They are moved to the grand mean, where
    "all folds minus one" subtracts numbers of the same size as the result.
    """
    cx, cy = F.col(x).cast("double"), F.col(y).cast("double")
    cells = df.filter(cx.isNotNull() & cy.isNotNull()).groupBy("fold").agg(
        F.count("*").alias("n"), F.avg(cx).alias("mx"), F.avg(cy).alias("my"),
        (F.var_pop(cx) * F.count("*")).alias("m2"), (F.covar_pop(cx, cy) * F.count("*")).alias("c"),
    )
    grand = cells.agg((F.sum(F.col("n") * F.col("mx")) / F.sum("n")).alias("gx"),
                      (F.sum(F.col("n") * F.col("my")) / F.sum("n")).alias("gy"))
    gx, gy = grand.select("gx").scalar(), grand.select("gy").scalar()
    dx, dy = F.col("mx") - gx, F.col("my") - gy
    moved = cells.select(
        "fold", F.col("n").cast("double").alias("n"), (F.col("n") * dx).alias("sx"), (F.col("n") * dy).alias("sy"),
        (F.col("m2") + F.col("n") * dx * dx).alias("xx"), (F.col("c") + F.col("n") * dx * dy).alias("xy"),
    )
    # one row per fold reaches this window
    everything = Window.partitionBy(F.lit(0))
    rest = moved.select("fold", *[(F.sum(m).over(everything) - F.col(m)).alias(m) for m in ("n", "sx", "sy", "xx", "xy")])
    slope = (F.col("xy") - F.col("sx") * F.col("sy") / F.col("n")) / (F.col("xx") - F.col("sx") * F.col("sx") / F.col("n"))
    lines = rest.select("fold", slope.alias("_slope"), "n", "sx", "sy").select(
        "fold", "_slope", (gy + F.col("sy") / F.col("n") - F.col("_slope") * (gx + F.col("sx") / F.col("n"))).alias("_intercept")
    )
    # one row per fold, so broadcasting it is safe at any data size
    joined = df.join(F.broadcast(lines), "fold")
    return joined.withColumn("y_pred", F.col("_intercept") + F.col("_slope") * cx).drop("_slope", "_intercept")


def fold_gram(df: DataFrame, names: list[str]) -> dict:
    """Per fold: rows, means and centred cross products of ``names``, from one mergeable aggregate over ``df``.

    What reaches the driver is one row per fold with a number for each pair of columns. Rows with a NULL in any
    of them are left out.
    """
    import numpy as np

    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1)]
    complete = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in names])
    cells = df.filter(complete & F.col("fold").isNotNull()).groupBy("fold").agg(
        F.count("*").alias("n"), F.array(*[F.avg(c) for c in names]).alias("means"),
        F.array(*[F.covar_pop(names[i], names[j]) for i, j in pairs]).alias("covariances"))
    found = {}
    for row in cells.toLocalIterator():
        products = np.zeros((len(names), len(names)))
        for (i, j), value in zip(pairs, row["covariances"], strict=True):
            products[i, j] = products[j, i] = value * row["n"]
        found[row["fold"]] = (row["n"], np.array(row["means"]), products)
    return found


def merge_grams(parts: list[tuple]):
    """Rows, means and centred cross products of several parts together; centred at each step, so nothing cancels."""
    n, means, products = 0, 0.0, 0.0
    for more, other, cross in parts:
        apart = other - means
        products = products + cross + (apart[:, None] * apart[None, :]) * (n * more / (n + more) if n else 0.0)
        means = means + apart * (more / (n + more))
        n += more
    return n, means, products


def linear_out_of_fold(df: DataFrame, inputs: dict[str, Column], target: str) -> DataFrame:
    """Out-of-fold least squares in closed form: ``df`` with ``y_pred``; two scans whatever the number of folds.

    A Gram matrix per fold is made in one aggregate; the rows outside a fold are the merge of the other matrices, and
    the normal equations are solved on the driver, least norm where inputs depend on each other. ``inputs``
    are named expressions without NULLs, categories as 0/1; a row with a NULL input, or alone with its
    fold, has no prediction.
    """
    import numpy as np

    names = [f"_x{i}" for i in range(len(inputs))]
    typed = df.withColumns({**{x: value.cast("double") for x, value in zip(names, inputs.values(), strict=True)}, "_y": F.col(target).cast("double")})
    grams = fold_gram(typed, [*names, "_y"])
    lines = {}
    for fold in grams:
        rest = [g for f, g in grams.items() if f != fold]
        if not rest:
            continue
        _, means, products = merge_grams(rest)
        # standardised, so that columns of very different size weigh alike
        size = np.sqrt(np.diag(products)[:-1])
        size[size == 0] = 1.0
        scaled = np.linalg.lstsq(products[:-1, :-1] / size[:, None] / size[None, :], products[:-1, -1] / size, rcond=None)[0] / size
        lines[fold] = [float(means[-1] - scaled @ means[:-1]), *map(float, scaled)]
    if not lines:
        return typed.drop(*names, "_y").withColumn("y_pred", F.lit(None).cast("double"))
    known = F.create_map(*[x for fold, line in lines.items() for x in (F.lit(fold), F.array(*map(F.lit, line)))])
    line = F.try_element_at(known, F.col("fold"))
    value = reduce(lambda a, b: a + b, [F.get("_line", F.lit(i + 1)) * F.col(x) for i, x in enumerate(names)], F.get("_line", F.lit(0)))
    return typed.withColumn("_line", line).withColumn("y_pred", value).drop(*names, "_y", "_line")


def line_model(x: str) -> ModelSpec:
    """Straight line on one column, fitted in one aggregation and applied lazily."""

    def fit(train: DataFrame, target: str, features: list[str]) -> Fitted:
        fit_row = train.agg(
            F.regr_slope(F.col(target), F.col(x).cast("double")).alias("slope"),
            F.regr_intercept(F.col(target), F.col(x).cast("double")).alias("intercept"),
        )
        slope, intercept = fit_row.select("slope").scalar(), fit_row.select("intercept").scalar()
        return Fitted(lambda df: df.withColumn("y_pred", intercept + slope * F.col(x).cast("double")))

    return ModelSpec(f"line_{x}", fit)


def loss_specs(trees: int = 200, depth: int = 30, rounds: int = 200, seed: int = 42) -> dict[str, tuple]:
    """Loss classifiers: (estimator, weighting) with weighting none, ratio or balanced."""
    boosted = lambda: GBTClassifier(
        maxIter=rounds, stepSize=0.05, maxDepth=4, subsamplingRate=0.9, featureSubsetStrategy="0.9", seed=seed)
    forest = lambda: RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed)
    return {
        "boosted_default_threshold": (boosted, "none"),
        "boosted_class_weighted": (boosted, "ratio"),
        "forest_balanced": (forest, "balanced"),
    }


def loss_probabilities(
    df: DataFrame, make, weighting: str, features: list[str], k: int, parallelism: int = 5, encoders: Encoders | None = None
) -> DataFrame:
    """Out-of-fold probability of loss as ``score``; class weights come from the training folds.

    ``encoders`` of the same rows and folds are shared between classifiers.
    """
    encoders = encoders or Encoders(features)

    def score(number: int) -> DataFrame:
        train = training_rows(df, number)
        encoder = encoders.of(number, train)
        encoded = encoder.transform(train).select("features", F.col("label").cast("double").alias("label"))
        facts = encoded.agg(F.sum("label").alias("pos"), F.count("*").alias("n")).head()
        pos, neg = facts["pos"] or 0.0, facts["n"] - (facts["pos"] or 0.0)
        if pos == 0:
            raise ValueError("the loss classifier needs at least one positive example")
        weight = {
            "none": F.lit(1.0),
            "ratio": F.when(F.col("label") == 1, F.lit(neg / pos)).otherwise(F.lit(1.0)),
            "balanced": F.when(F.col("label") == 1, F.lit((pos + neg) / (2 * pos))).otherwise(
                F.lit((pos + neg) / (2 * neg) if neg else 1.0)),
        }[weighting]
        model = make().setLabelCol("label").setWeightCol("_weight").fit(encoded.withColumn("_weight", weight))
        scored = model.transform(encoder.transform(df.filter(F.col("fold") == number)))
        return scored.select(*df.columns, vector_to_array("probability")[1].alias("score"))

    return _each_fold(k, score, parallelism)


def loss_label(df: DataFrame, qos_class: str = "Bronze") -> DataFrame:
    """Rows of one class with ``label`` = 1 when any packet was lost."""
    rate = F.col("packet_loss_rate").try_cast("double")
    return df.filter((F.col("qos_class") == qos_class) & rate.isNotNull()).withColumn("label", (rate > 0).cast("int"))
